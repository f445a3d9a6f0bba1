"""MinHash near-dedup (operator 6): circulant MinHash, banding, exact Jaccard verification, connected components.

A document's set: its distinct word shingles. Documents are linked if the Jaccard similarity of their sets reaches the
threshold, decided in integers on the full sets. A class is what links connect; its smallest doc_id stands for it.

Circulant MinHash needs two permutations: one scatters the shingles (sigma), the other (pi) is shifted by one place for each
signature coordinate, min over x of pi(sigma(x) + k). Both are bijections of the 64-bit integers. Bands of 4 coordinates, 16 of
them, miss a pair at 0.85 with probability 7e-6 (0.8: 1.2e-4 with 16, so lower thresholds take more bands).

How it scales. Documents with the same set are one class at once: their sets are told apart by a 128-bit sum, and only the
smallest doc_id goes on, so a group of copies, however large, is one member. A bucket never lists its pairs. First, each member
is compared with its bucket's centre (the member with most company over all bands: the original of a group of copies, as a rule), which
joins most of what belongs together. Buckets that still hold several components are gathered by centre and cut into tiles of bounded size;
a tile looks for links between components by prefix filter (two sets that reach the threshold share one of their rarest shingles), verifies
them on full sets in place, and gives at most a spanning forest. Components come from large-star/small-star rounds of joins; nothing of the
corpus goes to the driver but counts.

Cases. Null or empty text, or no words: empty set, n_shingles 0, alone. Fewer words than a shingle: the whole sequence is the
one shingle. Repeated rows: same set, same class; rows that share a doc_id and differ link what each of them is linked to. Null
doc_id: alone, component null, kept. Empty table: no rows. Other columns, whatever their names, are carried along by ``dedup``.
Very long texts: a text is worked on whole by one task, at some 60 bytes a byte of text; memory bounds a text, not the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, discard, lean, lean_call, materialize, mix, pieces, unused, utf8, words

_SHIFTS = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9))


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and where each text's begin."""
    _, _, h, first = words(buf, offsets)
    n = np.diff(first)
    out, sizes = [], np.zeros(len(n), np.int64)
    if len(h) >= k:
        s = np.zeros(len(h) - k + 1, U64)
        for j in range(k):
            s = (s ^ h[j : len(s) + j]) * _SHIFTS[0] + U64(j + 1)
            s ^= s >> U64(32)
        s = mix(s)
    for i in range(len(n)):
        if n[i] >= k:
            got = np.sort(s[first[i] : first[i + 1] - k + 1])
            got = got[np.r_[True, got[1:] != got[:-1]]]
        elif n[i]:
            one = np.zeros(1, U64)
            for x in h[first[i] : first[i + 1]]:
                one = mix((one ^ x) * _SHIFTS[1])
            got = one
        else:
            continue
        out.append(got)
        sizes[i] = len(got)
    return np.concatenate(out) if out else np.zeros(0, U64), np.r_[0, np.cumsum(sizes)]


def circulant_signatures(sets: np.ndarray, first: np.ndarray, coordinates: int, cells: int = 1 << 15) -> np.ndarray:
    """min over x of pi(sigma(x) + k), by row and k; rows of empty sets are all ones."""
    out = np.full((len(first) - 1, coordinates), ~U64(0), U64)
    full = np.flatnonzero(np.diff(first))
    sigma = mix(sets ^ _SHIFTS[2])
    i = 0
    while i < len(full):  # a few documents at a time stay in the processor's cache
        j = max(i + 1, int(np.searchsorted(first[full], first[full[i]] + cells)))
        j = min(j, len(full))
        x = sigma[first[full[i]] : first[full[j - 1] + 1]]
        at = first[full[i:j]] - first[full[i]]
        for k in range(coordinates):
            out[full[i:j], k] = np.minimum.reduceat(mix(x + U64(k)), at)
        i = j
    return out


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.r_[U64(0), np.cumsum(values)]
    return (total[first[1:]] - total[first[:-1]]).view(np.int64)


def _sketch(batches, k: int, bands: int, rows: int, block: int = 1 << 19):
    for batch in batches:
        buf, offsets = utf8(batch.column(1))
        for i, j in pieces(offsets, block):
            sets, first = shingle_sets(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
            n = np.diff(first)
            sig = circulant_signatures(sets, first, bands * rows)
            a, b = _sums(sets, first), _sums(mix(sets ^ _SHIFTS[1]), first)
            sig32 = np.ascontiguousarray((sig >> U64(32)).astype(np.uint32))
            yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([x.tobytes() for x in sig32], pa.binary())], ["doc_id", "n_shingles", "s1", "s2", "sig"])


def _band_rows(batches, bands: int, rows: int):
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, bands, rows)
        key = np.zeros((len(sig), bands), U64)
        for r in range(rows):
            key = mix((key ^ sig[:, :, r].astype(U64)) * _SHIFTS[0] + U64(r + 1))
        key ^= mix(np.arange(1, bands + 1, dtype=U64))
        own = [pa.array(np.repeat(batch.column(c).to_numpy(), bands), pa.int64()) for c in ("id", "s")]
        yield pa.record_batch([*own, pa.array(key.reshape(-1).view(np.int64), pa.int64())], ["id", "s", "band"])


def _verify(batches, percent: int):
    for batch in batches:
        a, b = batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist()
        keep = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
            lo, hi = sorted((len(x), len(y)))
            if 100 * lo < percent * hi:
                keep.append(False)
                continue
            z = np.concatenate([x, y])
            z.sort()
            both = int((z[1:] == z[:-1]).sum())
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        keep = pa.array(keep, pa.bool_())
        yield pa.record_batch([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])


def _sets(batches, k: int):
    for batch in batches:
        buf, offsets = utf8(batch.column(1))
        for i, j in pieces(offsets, 1 << 19):
            sets, first = shingle_sets(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
            yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(_sums(sets, first), pa.int64()), pa.array([sets[x:y].tobytes() for x, y in zip(first[:-1], first[1:], strict=True)], pa.binary())], ["id", "s", "set"])


def _tile_links(table: pa.Table, percent: int) -> pa.Table:
    """Links between members of different components in a tile (within block x, or between x and y where they differ), without those that follow from others."""
    ids, comp, side = (table.column(c).to_numpy() for c in ("id", "component", "side"))
    sets = [np.frombuffer(x.as_py(), U64) for x in table.column("set")]
    n = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), n)
    _, token, times = np.unique(flat, return_inverse=True, return_counts=True)
    # a shared shingle must be among the rarest n - ceil(n * percent / 100) + 1 of both; those in one set alone can't be shared
    order = np.lexsort((token, times[token], owner))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    first = order[(place < (n - (n * percent + 99) // 100 + 1)[owner[order]]) & (times[token[order]] > 1)]
    first = first[np.argsort(token[first], kind="stable")]
    who, key = owner[first], token[first]
    cuts = np.searchsorted(key, np.arange(len(times) + 1))
    mine = [[] for _ in sets]
    for i, k in zip(who.tolist(), key.tolist(), strict=True):
        mine[i].append(k)
    parent = {c: c for c in comp.tolist()}

    def root(c):
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    a, b = [], []
    two = (side == 2).any()
    for i in np.argsort(-n, kind="stable").tolist():
        if not mine[i]:
            continue
        other = np.unique(np.concatenate([who[cuts[k] : cuts[k + 1]] for k in mine[i]]))
        other = other[(100 * n[other] >= percent * n[i]) & ((n[other] < n[i]) | ((n[other] == n[i]) & (ids[other] > ids[i])))]
        if two:
            other = other[(side[other] == 2) != (side[i] == 2)]
        at = root(int(comp[i]))
        for j in other.tolist():
            if root(int(comp[j])) == at:
                continue
            z = np.concatenate([sets[i], sets[j]])
            z.sort()
            both = int((z[1:] == z[:-1]).sum())
            if 100 * both >= percent * (n[i] + n[j] - both):
                a.append(int(ids[i])), b.append(int(ids[j]))
                parent[at] = root(int(comp[j]))
                at = root(at)
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def components(links: DataFrame, tag: str = "links") -> DataFrame:
    """(id, component) of every id in links(a, b): the smallest id that links reach. Large-star and small-star rounds, to a fixpoint; a round's tables go when the next has read them."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), tag)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.filter("u <> v").distinct(), tag)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        small = materialize(small, tag)
        if edges.count() == small.count() and not edges.exceptAll(small).take(1):
            break
        discard(edges, large)
        edges = small
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))


def classes(docs: DataFrame, k: int = 3, percent: int = 85, bands: int = 16, rows: int = 4, tile: int = 2_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs(doc_id, text). Links: 100 * intersection >= percent * union; tile: shingles in a block.

    A member is a set, named by the smallest doc_id that has it and by its sum s; links and components are of doc_ids.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = materialize(docs.mapInArrow(lambda it: lean(_sketch(it, k, bands, rows)), "doc_id long, n_shingles long, s1 long, s2 long, sig binary"), "sketch")
    full = sketch.filter("n_shingles > 0 and doc_id is not null")
    same = full.groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("id"), F.min_by("sig", "doc_id").alias("sig"))
    members = materialize(same, "members")
    # an id whose rows differ links the sets that it has
    several = full.groupBy("doc_id").agg(F.min(F.struct("n_shingles", "s1", "s2")).alias("x"), F.max(F.struct("n_shingles", "s1", "s2")).alias("y")).filter("x <> y").select("doc_id")
    bridges = full.join(several, "doc_id", "left_semi").join(members.drop("sig"), ["n_shingles", "s1", "s2"]).select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    bridges = materialize(bridges.filter("a <> b").distinct(), "bridges")
    buckets = members.select("id", F.col("s1").alias("s"), "sig").mapInArrow(lambda it: lean(_band_rows(it, bands, rows)), "id long, s long, band long")
    counted = buckets.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    met = materialize(buckets.join(counted, "band"), "buckets")
    # each bucket's centre is the member with most company over all bands: the original of a group of copies, as a rule
    company = met.groupBy("id", "s").agg(F.sum("n").alias("company"))
    centres = met.join(company, ["id", "s"]).groupBy("band").agg(F.max(F.struct("company", (-F.col("id")).alias("o"), "id", "s")).alias("c")).select("band", F.col("c.id").alias("centre"), F.col("c.s").alias("centre_s"))
    shared = materialize(met.select("id", "s", "band").join(centres, "band"), "buckets")
    named = shared.select(F.col("id").alias("doc_id")).distinct()
    text = docs.filter("doc_id is not null").join(named.hint("shuffle_hash"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    sets = materialize(text.select("doc_id", "text").mapInArrow(lambda it: lean(_sets(it, k)), "id long, s long, set binary"), "sets")
    pairs = shared.filter("id <> centre").select(F.col("centre").alias("a"), F.col("centre_s").alias("a_s"), F.col("id").alias("b"), F.col("s").alias("b_s")).distinct()
    wide = pairs.join(sets.toDF("a", "a_s", "set_a"), ["a", "a_s"]).join(sets.toDF("b", "b_s", "set_b"), ["b", "b_s"])
    links = materialize(wide.mapInArrow(lambda it: lean(_verify(it, percent)), "a long, b long"), "star").unionByName(bridges)
    found = components(links)
    apart = shared.join(found, "id", "left").select("id", "s", "band", "centre", "centre_s", F.coalesce("component", "id").alias("component"))
    mixed = apart.groupBy("band").agg(F.count("*").alias("n"), F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 <> c1 and n > 2").select("band")
    n_of = members.select("id", F.col("s1").alias("s"), "n_shingles")
    left = materialize(apart.join(mixed, "band").select("centre", "centre_s", "id", "s", "component").distinct().join(n_of, ["id", "s"]), "left")
    # what is left around a centre falls into blocks of about tile shingles; block x meets blocks x, x + 1, ...
    sizes = left.groupBy("centre", "centre_s").agg(F.ceil(F.sum("n_shingles") / tile).cast("int").alias("blocks"))
    left = left.join(sizes, ["centre", "centre_s"]).withColumn("block", F.pmod(F.xxhash64("id", "s"), F.col("blocks")).cast("int"))
    ways = F.expr("""concat(
        transform(sequence(block, blocks - 1), y -> named_struct('x', block, 'y', y, 'side', if(y = block, 0, 1))),
        if(block > 0, transform(sequence(0, block - 1), x -> named_struct('x', x, 'y', block, 'side', 2)), cast(array() as array<struct<x:int,y:int,side:int>>)))""")
    tiles = left.join(sets, ["id", "s"]).select("id", "centre", "centre_s", "component", "set", F.explode(ways).alias("w")).select("id", "centre", "centre_s", "component", "set", "w.x", "w.y", "w.side")
    again = materialize(tiles.groupBy("centre", "centre_s", "x", "y").applyInArrow(lambda t: lean_call(_tile_links, t, percent), "a long, b long"), "tiles")
    if again.take(1):
        found = components(links.unionByName(again))
    discard(met, shared, sets)
    of_set = members.join(found, "id", "left").select("n_shingles", "s1", "s2", F.coalesce("component", "id").alias("component_id"))
    out = sketch.join(of_set.hint("shuffle_hash"), ["n_shingles", "s1", "s2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def dedup(docs: DataFrame, **kw) -> DataFrame:
    """The rows of docs whose document stands for its class; of rows that repeat one doc_id all stay."""
    name = unused(docs, "gone")
    gone = classes(docs, **kw).filter("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone[name], "left_anti")
