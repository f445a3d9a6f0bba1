"""Filter interaction audit (operator 11): every order of the filters, visited by swaps of neighbours, and Shapley values along the walk.

A document's mask has a bit for each filter that it fails. The corpus comes down to mask cells: for each part and mask, how many documents there are, how many of
them are good and how many toxic. The walk goes through all orders of n filters by plain changes, one swap of neighbours at a time. A swap changes what the two
swapped steps remove and nothing else: the first of them is summed from the cells anew, the second takes what is left of the two's sum, and all other steps stay.
A filter's removals are added up at each order that the walk visits; after the last order the sum over all orders, n! times the Shapley value, is complete.

How it scales. Texts are read once; a row of some 60 bytes goes on (digest, doc_id, part, mask). The first document of each text comes from a grouping with partial
sums. Copies are told from first documents by a join on digest and doc_id together, so a text that a third of all documents share is spread by doc_id. Cells are
counted before they are shuffled; a part is one row of 2^n cells, and the walk's tasks take parts in blocks.

Cases. Null or empty text: empty, fails A alone of the first four (0 words; 0 < 0 does not hold), and E if an earlier text is empty too. Null source: part ''. Null doc_id:
neither earlier nor later than any other, so it never fails E and makes no other fail. Repeated rows: each counts; of rows with one doc_id none is earlier. Repeated or missing
labels: good or toxic if any label of the document says so, neither without. Empty table: no rows. Other columns are ignored. Very long texts: a text's words are held at once,
at some 60 bytes a word.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize

LETTERS = "ABCDE"
_OTHER = bytes(set(range(256)) - set(string.ascii_uppercase.encode()))
_MARKS = frozenset(b"#$%&*|")


def failures(text: str) -> int:
    """Bits of the filters A to D that the text fails."""
    raw = text.encode()
    words = raw.split()  # at ASCII white space, as bytes do
    distinct = len(set(words))
    capitals = len(raw.translate(None, _OTHER))
    return (len(words) < 50) | (100 * distinct < 65 * len(words)) << 1 | (100 * capitals > 5 * len(text)) << 2 | (not _MARKS.isdisjoint(raw)) << 3


def _masks(batches):
    for batch in batches:
        masks, digests = [], []
        for text in batch.column("text"):
            text = text.as_py() or ""
            masks.append(failures(text))
            digests.append(hashlib.blake2b(text.encode(), digest_size=16).digest())
        yield pa.record_batch([batch.column("doc_id"), batch.column("part"), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"])


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bits in the order of LETTERS), n, good, toxic of docs(doc_id, text, source), labels(doc_id, quality, toxic)."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text")
    rows = materialize(rows.mapInArrow(lambda it: lean(_masks(it)), f"doc_id {kind}, part string, mask int, digest binary"), "masks")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    marks = labels.groupBy("doc_id").agg(*[F.coalesce(F.max((F.col(c) == 1).cast("long")), F.lit(0)).alias(own) for c, own in (("quality", "good"), ("toxic", "toxic"))])
    rows = rows.join(first, ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
    copy = F.col("is_first").isNull() & F.col("doc_id").isNotNull()
    mask = F.col("mask") + F.when(copy, 1 << LETTERS.index("E")).otherwise(0)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("good", "toxic")]
    return rows.groupBy("part", mask.alias("mask")).agg(F.count(F.lit(1)).alias("n"), *sums)


def plain_changes(n: int) -> Iterator[int]:
    """Places i of the n! - 1 swaps of i and i + 1 that visit all orders of n things, each once: the largest thing that still looks at a smaller one moves on."""
    order, looks = list(range(n)), [-1] * n
    while True:
        best = -1
        for i, x in enumerate(order):
            j = i + looks[x]
            if 0 <= j < n and order[j] < x and (best < 0 or x > order[best]):
                best = i
        if best < 0:
            return
        x = order[best]
        i = min(best, best + looks[x])
        order[i], order[i + 1] = order[i + 1], order[i]
        for y in range(x + 1, n):
            looks[y] = -looks[y]
        yield i


def walk(counts: np.ndarray, n: int) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """(order, removed) of all orders of n filters; counts: (parts, kinds, 2^n) cells; removed: (parts, kinds, n) by step, to be read before the next order."""
    masks = np.arange(1 << n)
    order = list(range(n))
    removed = np.zeros((*counts.shape[:2], n), np.int64)

    def taken_first(f: int, before: int) -> np.ndarray:
        return counts[:, :, (masks >> f & 1 == 1) & (masks & before == 0)].sum(2)

    before = 0
    for k, f in enumerate(order):
        removed[:, :, k] = taken_first(f, before)
        before |= 1 << f
    yield tuple(order), removed
    for i in plain_changes(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        both = removed[:, :, i] + removed[:, :, i + 1]
        removed[:, :, i] = taken_first(order[i], sum(1 << f for f in order[:i]))
        removed[:, :, i + 1] = both - removed[:, :, i]
        yield tuple(order), removed


def audit_cells(parts: list[str], counts: np.ndarray, letters: str = LETTERS) -> pa.RecordBatch:
    """All rows of some parts; counts: (parts, 3, 2^n) documents, good ones, toxic ones."""
    n, total = len(letters), counts[:, 0].sum(1)
    masks = np.arange(1 << n)
    fails = np.stack([counts[:, 0, masks >> f & 1 == 1].sum(1) for f in range(n)], 1)
    alone = np.stack([counts[:, 0, 1 << f] for f in range(n)], 1)
    shapley = np.zeros((len(parts), n), np.int64)
    orders, steps, rows = [], [], []
    for order, removed in walk(counts, n):
        at = list(order)
        shapley[:, at] += removed[:, 0]
        kept = total[:, None] - np.cumsum(removed[:, 0], 1)
        rows.append(np.stack([kept, removed[:, 0], fails[:, at] - removed[:, 0], alone[:, at], removed[:, 1], removed[:, 2]]))
        orders.append("".join(letters[f] for f in order))
        steps.append(at)
    values = np.stack(rows, 1)  # column, order, part, step
    values = np.concatenate([values, np.stack([shapley[:, at] for at in steps])[None]])
    names = pa.array(orders).take(pa.array(np.repeat(np.arange(len(orders)), len(parts) * n)))
    own = pa.array(parts, pa.string()).take(pa.array(np.tile(np.repeat(np.arange(len(parts)), n), len(orders))))
    step = pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders) * len(parts)))
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return pa.record_batch([own, names, step, *[pa.array(v.ravel()) for v in values]], ["part", "filter_order", "step", *columns])


def _audit(batches, block: int = 64):
    for batch in batches:
        for s in range(0, batch.num_rows, block):
            some = batch.slice(s, block)
            counts = np.zeros((some.num_rows, 3, 1 << len(LETTERS)), np.int64)
            for i, row in enumerate(some.column("cells").to_pylist()):
                for c in row:
                    counts[i, :, c["mask"]] = c["n"], c["good"], c["toxic"]
            yield audit_cells(some.column("part").to_pylist(), counts)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for each part, order of the five filters and step."""
    by_part = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 2^5 a part
    columns = ", ".join(f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return by_part.mapInArrow(_audit, f"part string, filter_order string, step int, {columns}")
