"""Suffix-array dedup (operator 3): repeated byte strings found by bucket-pointer refinement.

A byte is removed if a string of ``length`` bytes covers it that also starts earlier: in a document of smaller
doc_id, or earlier in the same document. Matches never cross documents; strings are judged on the input.

How it scales. Every string of ``length`` bytes holds ``length - q + 1`` q-grams; the one with the least hash is its
anchor, and equal strings have equal anchors. The strings of a text that share an anchor start one after the other, so
a text falls into runs, one an anchor. Texts are dealt to blocks of about ``block_bytes`` by hash of the id; the rest works on these blocks:
1. 40 bits of each run's anchor hash go to the part of that hash, where anchors met twice are told from the others.
   A block sends an anchor once, however often it has it.
2. Runs whose anchor is met twice go, as the bytes their strings cover, to the part of the anchor. Runs that are byte for
   byte the same are settled before that: all but the earliest are repeats, so a passage that a third of all texts share
   crosses the shuffle once a block.
3. In a part, runs are told apart by what follows and precedes the anchor, and what is left goes through bucket-pointer
   refinement: the first buckets are 8-grams; the suffixes of a bucket are split by the bucket numbers of later offsets,
   and the numbers that this gives are the keys of the next refinement (8, 16, 32, 64, ``length`` bytes). Suffixes alone in
   their bucket drop out. Nothing is hashed in that step, so its matches are exact.
   A hot anchor, one with more runs than a bound that follows from the corpus (``hot_least`` at least), would put all its runs, which differ at the edges of what they share, into one part. Its buckets are refined where the texts are:
   the identifiers of q-grams are refined by those of later offsets, and the identifiers that this gives are reused in the next step (24, 48, 96, 100 bytes). A block keeps the earliest of each bucket, and buckets
   are dealt by their identifiers; a bucket has one string a block at most. These identifiers have 128 bits; strings that share one are taken to be equal. The list of hot anchors is broadcast; it has less than 2^25 by the choice of the bound.
4. Spans go back to the blocks of their texts.

Cases. Null or empty text: no bytes, nothing removed. Texts shorter than ``length``: kept whole. Rows that are repeated
with one doc_id are equally early, so neither removes the other; spans found for an id hold for all its rows, cut to
their length. Null doc_id: such rows take no part and come back whole. Empty table: no rows. Other columns, whatever their
names, are carried by ``dedup`` and ignored by ``digest``. Very long texts: one is worked on whole by one task, at some 50 bytes a
byte of text, so memory bounds a text, not the corpus.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, lean, lean_call, materialize, merge_spans, mix, nullable, packed, pieces, ragged, shuffle_parts, unpacked, utf8

_ROWS = "part int, kind int, data binary"  # kind 0: for the part to work on; 1: passed on to the block "part"
_BLOCK = "block int, data binary"
#: Groups of runs for each block of texts: a task settles one at a time, at some 20 bytes a byte of its runs.
RUN_PARTS = 8


def _eights(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place, as a number; the last places are filled up with zeros."""
    x = np.zeros(len(buf) + 8, U64)
    x[: len(buf)] = buf
    x[:-1] |= x[1:] << U64(8)
    x[:-2] |= x[2:] << U64(16)
    x[:-4] |= x[4:] << U64(32)
    return x[: len(buf)]


def _eight_at(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """As _eights, from some places; past the end, from the last byte on."""
    at = np.minimum(at, len(buf) - 1)
    out = np.zeros((len(at), 8), np.uint8)
    for k in range(8):
        inside = at + k < len(buf)
        out[inside, k] = buf[at[inside] + k]
    return out.view(np.dtype("<u8")).ravel()


def _gram_hash(eight, n: int, q: int) -> np.ndarray:
    """Hash of the q bytes (a multiple of 8) from each of n places; eight(k): the 8 bytes that begin k further."""
    h = np.zeros(n, U64)
    for k in range(0, q, 8):
        h = (h ^ eight(k)) * U64(0x9E3779B97F4A7C15 + 2 * k)
        h ^= h >> U64(29)
    return mix(h)


def _runs(buf: np.ndarray, offsets: np.ndarray, length: int, q: int):
    """Of texts that follow one another in buf: (text, start in buf, strings, anchor in buf, anchor's hash) of each run."""
    none = np.zeros(0, np.int64)
    if len(buf) < length:
        return none, none, none, none, np.zeros(0, U64)
    x, n = _eights(buf), len(buf) - q + 1
    h = _gram_hash(lambda k: x[k : n + k], n, q)
    bits = 32  # of the hash, as many whatever the block's size: equal strings have equal anchors
    if len(h) >> bits:
        raise ValueError("a text of 4 GB or more")
    key = (h >> U64(bits) << U64(bits)) | np.arange(len(h), dtype=U64)  # the leftmost of equal hashes
    width, step, m = length - q + 1, 1, key
    while step * 2 <= width:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    if width > step:
        m = np.minimum(m[: len(m) - (width - step)], m[width - step :])
    anchor = (m & U64((1 << bits) - 1)).astype(np.int64)
    sizes = np.diff(offsets)
    long = np.flatnonzero(sizes >= length)
    at = ragged(offsets[long], sizes[long] - length + 1)
    if not len(at):
        return none, none, none, none, np.zeros(0, U64)
    text = np.repeat(long, sizes[long] - length + 1)
    a = anchor[at]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (text[1:] != text[:-1])])
    count = np.diff(np.r_[first, len(at)])
    return text[first], at[first], count, a[first], h[a[first]]


def _pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    head = np.array([len(arrays), *(x.nbytes for x in arrays)], np.int64).tobytes()
    return zstandard.compress(head + b"".join(x.tobytes() for x in arrays), level)


def _unpack(data: bytes, kinds: tuple) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8)
    out, at = [], 8 * (n + 1)
    for size, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(raw, kind, int(size) // np.dtype(kind).itemsize, at))
        at += int(size)
    return out


_KINDS = (np.int64, np.int32, np.uint16, np.uint16, np.uint8)  # owner, start, strings, anchor - start, bytes


def _same_runs(owner, start, texts) -> np.ndarray:
    """Whether the same bytes came earlier, for runs given in order of owner and start; equally early ones aren't earlier."""
    seen: dict[bytes, tuple] = {}
    late = np.zeros(len(texts), bool)
    for i, t in enumerate(texts):
        first = seen.setdefault(t, (owner[i], start[i]))
        late[i] = first != (owner[i], start[i])
    return late


def _rows(parts: list, kinds: list, data: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(parts, pa.int32()), pa.array(kinds, pa.int32()), pa.array(data, pa.binary())], ["part", "kind", "data"])


def _dealt(part: np.ndarray, at: np.ndarray):
    """(part, rows) for each part that rows ``at`` have."""
    if not len(at):
        return
    order = at[np.argsort(part[at], kind="stable")]
    p = part[order]
    cuts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    for x, y in zip(cuts, [*cuts[1:], len(p)], strict=True):
        yield int(p[x]), order[x:y]


_PRIME, _FACTOR = (1 << 31) - 1, 1103515245


def _block_of(owner: np.ndarray, parts: int) -> np.ndarray:
    """The block of each id; _block_column is the same in Spark."""
    return owner.astype(np.int64) % _PRIME * _FACTOR % _PRIME % parts


def _block_column(owner: Column, parts: int) -> Column:
    of_id = F.pmod(F.pmod(owner, F.lit(_PRIME).cast("long")) * F.lit(_FACTOR).cast("long"), F.lit(_PRIME).cast("long"))
    return F.pmod(F.coalesce(of_id, F.xxhash64("text")), F.lit(parts)).cast("int")


def _numbered(b: np.ndarray, o: np.ndarray, owners: np.ndarray, length: int, q: int):
    """The runs of some texts, with their owner and number in their text."""
    text, at, count, anchor, key = _runs(b, o, length, q)
    first = np.searchsorted(text, text)
    return text, at, count, anchor, key, owners[text].astype(np.int64), np.arange(len(text)) - first


_BITS = U64((1 << 40) - 1)


def _identifiers(buf: np.ndarray, at: np.ndarray, length: int, q: int) -> np.ndarray:
    """Bucket identifiers (two columns) of the ``length``-byte strings from each place: those of q-grams, refined by the identifiers of later offsets (q, 2q, ... further) that the last step gave."""
    x, n = _eights(buf), len(buf) - q + 1
    gram = _gram_hash(lambda k: x[k : n + k], n, q)
    out = np.empty((len(at), 2), U64)
    for c, factor in enumerate((0xD6E8FEB86659FD93, 0x9FB21C651E98DF25)):
        ids, width = gram, q
        while width < length:
            step = min(width, length - width)
            ids = mix(ids[:-step] * U64(factor) + (ids[step:] >> U64(23) ^ ids[step:] << U64(41)) + U64(width))
            width += step
        out[:, c] = ids[at]
    return out


def _firsts(owner: np.ndarray, start: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of strings by identifiers: places of one of the earliest in each bucket, and of those that are later than these."""
    order = np.lexsort((start, owner, ids[:, 1], ids[:, 0]))
    i, o, s = ids[order], owner[order], start[order]
    new = np.r_[True, (i[1:] != i[:-1]).any(1)] if len(i) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    group = np.repeat(first, np.diff(np.r_[first, len(i)])) if len(i) else first
    return order[first], order[(o != o[group]) | (s != s[group])]


def _anchors(batches, length: int, q: int, parts: int, block: int):
    """Step 1, where texts are: 40 bits of each anchor's hash to its part, and how often it is met here; runs whose anchor is met twice here are known."""
    for batch in batches:
        owners = batch.column(0).to_numpy(zero_copy_only=False)
        buf, offsets = utf8(batch.column(1))
        for i, j in pieces(offsets, block):
            _, _, _, _, key, owner, number = _numbered(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], owners[i:j], length, q)
            if not len(key):
                continue
            _, at, inverse, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            out, kinds, data = [], [], []
            known = np.flatnonzero(times[inverse] > 1)
            for p, w in _dealt(_block_of(owner, parts), known):
                out.append(p), kinds.append(1), data.append(_pack(owner[w], number[w].astype(np.uint32)))
            for p, w in _dealt(((key >> U64(44)) % U64(parts)).astype(np.int64), at):
                w = np.sort(w)
                out.append(p), kinds.append(0), data.append(_pack(owner[w], number[w].astype(np.uint32), key[w].astype(np.uint32), (key[w] >> U64(32)).astype(np.uint8), times[inverse[w]].astype(np.uint32)))
            yield _rows(out, kinds, data)


def _met_twice(table: pa.Table, parts: int, most: int) -> pa.Table:
    """Step 1, in a part: runs whose anchor another block has too, by the block of their owner; what is known is passed on. Block -1: anchors that are met more than ``most`` times."""
    out, data, own = [], [], []
    for p, kind, d in zip(*(table.column(c).to_pylist() for c in ("part", "kind", "data")), strict=True):
        if kind:
            out.append(p), data.append(d)
        else:
            own.append(_unpack(d, (np.int64, np.uint32, np.uint32, np.uint8, np.uint32)))
    if own:
        owner, number, low, high, times = (np.concatenate([x[k] for x in own]) for k in range(5))
        key = low.astype(np.int64) | high.astype(np.int64) << 32
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        hot = key[order][first][np.add.reduceat(times[order].astype(np.int64), first) > most]
        if len(hot):
            out.append(-1), data.append(_pack(hot))
        same = key[order][1:] == key[order][:-1]
        at = order[np.r_[False, same] | np.r_[same, False]]
        for p, w in _dealt(_block_of(owner, parts), at):
            out.append(p), data.append(_pack(owner[w], number[w]))
    return pa.table([pa.array(out, pa.int32()), pa.array(data, pa.binary())], ["block", "data"])


def _emit(docs: pa.Table, flags: pa.Table, length: int, q: int, parts: int, block: int, hot: np.ndarray, most_strings: int = 1 << 22) -> pa.Table:
    """Step 2: of one block's texts, the runs whose anchor is met twice; all but the earliest of equal ones are repeats already. Runs of hot anchors go string by string, by refined identifiers."""
    strings, waiting = [], 0

    def deal_strings() -> None:
        owner, start, ids = (np.concatenate([x[k] for x in strings]) for k in range(3))
        strings.clear()
        first, later = _firsts(owner, start, ids)
        span = merge_spans(owner[later], start[later], start[later] + length)
        for p, w in _dealt(_block_of(span[0], parts), np.arange(len(span[0]))):
            out.append(p), kinds.append(1), data.append(_pack(*(x[w] for x in span)))
        for p, w in _dealt((ids[:, 0] % U64(RUN_PARTS * parts)).astype(np.int64), first):
            out.append(p), kinds.append(2), data.append(_pack(owner[w], start[w].astype(np.int32), ids[w, 0], ids[w, 1]))

    found = [_unpack(x, (np.int64, np.uint32)) for x in flags.column("data").to_pylist()]
    out, kinds, data = [], [], []
    if docs.num_rows and found:
        flag_owner, flag_number = (np.concatenate([x[k] for x in found]) for k in range(2))
        order = np.lexsort((flag_number, flag_owner))
        flag_owner, flag_number = flag_owner[order], flag_number[order].astype(np.int64)
        docs = docs.select(["owner", "text"]).filter(pc.is_valid(docs.column("owner"))).sort_by("owner")
        owners = docs.column("owner").to_numpy()
        has = np.isin(owners, flag_owner)
        docs, owners = docs.filter(pa.array(has)), owners[has]
        buf, offsets = utf8(docs.column("text"))
        for i, j in pieces(offsets, block):
            o, b = offsets[i : j + 1] - offsets[i], buf[offsets[i] : offsets[j]]
            text, at, count, anchor, key, owner, number = _numbered(b, o, owners[i:j], length, q)
            lo, hi = np.searchsorted(flag_owner, owners[i], "left"), np.searchsorted(flag_owner, owners[j - 1], "right")
            wide = np.int64(max(int(number.max(initial=0)), int(flag_number[lo:hi].max(initial=0))) + 1)
            rank = np.searchsorted(np.unique(owners[i:j]), owner)
            flag = np.isin(rank * wide + number, np.searchsorted(np.unique(owners[i:j]), flag_owner[lo:hi]) * wide + flag_number[lo:hi])
            text, at, count, anchor, key, owner = (x[flag] for x in (text, at, count, anchor, key, owner))
            start = at - o[text]
            _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
            twice = np.flatnonzero(times[inverse] > 1)
            late = np.zeros(len(text), bool)
            if len(twice):
                twice = twice[np.lexsort((start[twice], owner[twice]))]
                raw = b.tobytes()
                late[twice] = _same_runs(owner[twice].tolist(), start[twice].tolist(), [raw[x : x + y] for x, y in zip(at[twice].tolist(), (count[twice] + length - 1).tolist(), strict=True)])
                span = merge_spans(owner[late], start[late], start[late] + count[late] + length - 1)
                for p, w in _dealt(_block_of(span[0], parts), np.arange(len(span[0]))):
                    out.append(p), kinds.append(1), data.append(_pack(*(x[w] for x in span)))
            is_hot = np.isin((key & _BITS).astype(np.int64), hot) & ~late
            if is_hot.any():
                at_all = ragged(at[is_hot], count[is_hot])
                strings.append((np.repeat(owner[is_hot], count[is_hot]), ragged(start[is_hot], count[is_hot]), _identifiers(b, at_all, length, q)))
                waiting += len(at_all)
                if waiting > most_strings:
                    deal_strings()
                    waiting = 0
            for p, w in _dealt(((key >> U64(20)) % U64(RUN_PARTS * parts)).astype(np.int64), np.flatnonzero(~late & ~is_hot)):
                out.append(p), kinds.append(0), data.append(_pack(owner[w], start[w].astype(np.int32), count[w].astype(np.uint16), (anchor[w] - at[w]).astype(np.uint16), b[ragged(at[w], count[w] + length - 1)], level=3))
    if strings:
        deal_strings()
    return pa.table([pa.array(out, pa.int32()), pa.array(kinds, pa.int32()), pa.array(data, pa.binary())], ["part", "kind", "data"])


def refine(buf: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Bucket of the ``length``-byte string from each place of ``at`` (equal numbers: equal strings), -1 where it is alone.

    Bucket-pointer refinement over the suffixes of buf: bucket numbers by 8-grams, then split by the bucket number at a later offset.
    """
    n = len(buf)
    wide = np.zeros(n, bool)
    need = np.zeros(n + 1, np.int64)
    np.add.at(need, at, 1)
    np.add.at(need, np.minimum(at + length - 7, n), -1)
    wide[:] = np.cumsum(need)[:n] > 0
    pointer = np.full(n, -1, np.int64)
    live = np.flatnonzero(wide)
    key = _eights(buf)[live]
    depth = 8
    while True:
        order = np.argsort(key, kind="stable")
        new = np.r_[True, key[order][1:] != key[order][:-1]] if len(order) else np.zeros(0, bool)
        bucket = np.cumsum(new) - 1
        size = np.bincount(bucket, minlength=1)
        pointer[:] = -1
        more = size[bucket] > 1 if len(order) else np.zeros(0, bool)
        pointer[live[order[more]]] = bucket[more]
        if depth == length:
            return pointer[at]
        step = min(depth, length - depth)
        live = np.flatnonzero(pointer[: n - step] >= 0)
        later = pointer[live + step]
        live, later = live[later >= 0], later[later >= 0]
        key = pointer[live] * np.int64(max(1, len(size))) + later
        depth += step


def _settle(table: pa.Table, length: int, q: int, parts: int) -> pa.Table:
    """Step 3: the spans that the runs of one part show to be repeats, and those that are passed on, by block."""
    owners, starts, ends = [], [], []
    blobs, strings, out, data = [], [], [], []
    for p, kind, d in zip(*(table.column(c).to_pylist() for c in ("part", "kind", "data")), strict=True):
        if kind == 1:
            out.append(p), data.append(d)
        elif kind == 2:
            strings.append(_unpack(d, (np.int64, np.int32, U64, U64)))
        else:
            blobs.append(_unpack(d, _KINDS))
    if strings:
        owner, start, low, high = (np.concatenate([x[k] for x in strings]) for k in range(4))
        del strings
        later = _firsts(owner, start, np.stack([low, high], 1))[1]
        owners.append(owner[later]), starts.append(start[later].astype(np.int64)), ends.append(start[later].astype(np.int64) + length)
    if blobs:
        owner, start, count, rel, buf = (np.concatenate([x[k] for x in blobs]) for k in range(5))
        del blobs
        start, count, rel = start.astype(np.int64), count.astype(np.int64), rel.astype(np.int64)
        size = count + length - 1
        at = np.cumsum(size) - size
        key = _gram_hash(lambda k: _eight_at(buf, at + rel + k), len(at), q)

        def shared(k, of=None):
            of = np.arange(len(k)) if of is None else of
            _, inv, n = np.unique(k[of], return_inverse=True, return_counts=True)
            return of[n[inv] > 1]

        def side(begin, n):
            """Hash of n bytes (8 to 64) from begin, with the anchor's."""
            h = key[w]
            for k in [*range(0, n - 8, 8), n - 8]:
                h = mix(h ^ _eight_at(buf, begin + k))
            return h

        w = shared(key)
        w = w[np.lexsort((start[w], owner[w]))]
        raw = buf.tobytes()
        late = _same_runs(owner[w].tolist(), start[w].tolist(), [raw[i : i + n] for i, n in zip(at[w].tolist(), size[w].tolist(), strict=True)])
        del raw
        v = w[late]
        owners.append(owner[v]), starts.append(start[v]), ends.append(start[v] + size[v])
        w = shared(key, w[~late])
        half = (length - q) // 2
        if len(w) and half >= 8:
            right = np.zeros(len(w), bool)
            left = np.zeros(len(w), bool)
            # strings of a run reach rel - count + 1 ... rel bytes before the anchor, and length - q less that after it
            has_r, has_l = rel[w] - count[w] + 1 < half + 1, rel[w] >= half
            for has, flag, begin in ((has_r, right, at[w] + rel[w] + q), (has_l, left, at[w] + rel[w] - half)):
                k = side(begin, half)
                flag[shared(k, np.flatnonzero(has))] = True
            w = w[right | left]
        if len(w):
            text = buf[ragged(at[w], size[w])]
            new_at = np.cumsum(size[w]) - size[w]
            place = ragged(new_at, count[w])
            who, begin = np.repeat(owner[w], count[w]), ragged(start[w], count[w])
            bucket = refine(text, place, length)
            ok = bucket >= 0
            bucket, who, begin = bucket[ok], who[ok], begin[ok]
            order = np.lexsort((begin, who, bucket))
            bucket, who, begin = bucket[order], who[order], begin[order]
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
            group = np.repeat(first, np.diff(np.r_[first, len(bucket)])) if len(bucket) else first
            later = (who != who[group]) | (begin != begin[group])
            owners.append(who[later]), starts.append(begin[later]), ends.append(begin[later] + length)
    if owners:
        span = merge_spans(np.concatenate(owners), np.concatenate(starts), np.concatenate(ends))
        for p, w in _dealt(_block_of(span[0], parts), np.arange(len(span[0]))):
            out.append(p), data.append(_pack(*(x[w] for x in span)))
    return pa.table([pa.array(out, pa.int32()), pa.array(data, pa.binary())], ["block", "data"])


def _apply(docs: pa.Table, spans: pa.Table, digests: bool) -> pa.Table:
    """Step 4: one block's rows, with what their spans leave."""
    found = [_unpack(x, (np.int64,) * 3) for x in spans.column("data").to_pylist()]
    owner, start, end = merge_spans(*(np.concatenate([x[k] for x in found]) for k in range(3))) if found else (np.zeros(0, np.int64),) * 3
    ids = docs.column("owner").to_pylist()
    buf, offsets = utf8(docs.column("text"))
    n_removed, n_spans, kept = [], [], []
    for i, own in enumerate(ids):
        raw = buf[offsets[i] : offsets[i + 1]]
        lo, hi = np.searchsorted(owner, [own, own + 1]) if own is not None else (0, 0)
        s, e = np.minimum(start[lo:hi], len(raw)), np.minimum(end[lo:hi], len(raw))
        s, e = s[e > s], e[e > s]
        if len(s):
            stay = np.ones(len(raw), bool)
            stay[ragged(s, e - s)] = False
            raw = raw[stay]
        n_removed.append(int((e - s).sum())), n_spans.append(len(s))
        kept.append(hashlib.sha256(raw).hexdigest() if digests else raw.tobytes().decode("utf-8", "ignore"))
    row = docs.column("row")
    out = pa.table({"row": row.cast(nullable(row.type))})
    for name, values in (("n_bytes", pa.array(np.diff(offsets), pa.int64())), ("n_removed", pa.array(n_removed, pa.int64())), ("n_spans", pa.array(n_spans, pa.int64())), ("kept", pa.array(kept, pa.string()))):
        out = out.append_column(name, values)
    return out


def _joined(docs: DataFrame, digests: bool, length: int = 100, q: int = 24, block: int = 1 << 20, block_bytes: int = 64 << 20, hot_least: int = 256) -> DataFrame:
    """docs(row, owner, text) as row, n_bytes, n_removed, n_spans, kept. row: a struct of whatever is to be carried."""
    if length < q + 16 or q % 8 or q < 8:
        raise ValueError("q must be a multiple of 8, and length at least q + 16")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, min(shuffle_parts(docs.sparkSession), -(-total // (1 << 20))), -(-total // block_bytes))
    dealt = docs.withColumn("block", _block_column(F.col("owner"), parts)).groupBy("block")
    rows = docs.select("owner", "text").filter(f"owner is not null and octet_length(text) >= {length}")
    anchors = rows.mapInArrow(lambda it: lean(_anchors(it, length, q, parts, block)), _ROWS)
    most = max(hot_least, total >> 25)  # so that less than 2^25 anchors are hot: there are fewer runs than bytes
    flags = materialize(anchors.groupBy("part").applyInArrow(lambda t: lean_call(_met_twice, t, parts, most), _BLOCK), "anchors")
    found = [_unpack(r["data"], (np.int64,))[0] for r in flags.filter("block = -1").select("data").collect()]
    hot = docs.sparkSession.sparkContext.broadcast(np.sort(np.concatenate([np.zeros(0, np.int64), *found])))
    flags = flags.filter("block >= 0")
    runs = dealt.cogroup(flags.groupBy("block")).applyInArrow(lambda d, f: lean_call(_emit, d, f, length, q, parts, block, hot.value), _ROWS)
    spans = runs.groupBy("part").applyInArrow(lambda t: lean_call(_settle, t, length, q, parts), _BLOCK)
    schema = f"row {dict(docs.dtypes)['row']}, n_bytes long, n_removed long, n_spans long, kept string"
    return dealt.cogroup(spans.groupBy("block")).applyInArrow(lambda d, f: lean_call(_apply, d, f, digests), schema)


def digest(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs(doc_id, text)."""
    rows = docs.select(F.struct("doc_id").alias("row"), F.col("doc_id").cast("long").alias("owner"), "text")
    return _joined(rows, True, **kw).select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))


def dedup(docs: DataFrame, **kw) -> DataFrame:
    """docs with repeats cut from text; what is left of a character cut in two goes too. n_chars, if there, is counted anew. A null text stays null."""
    row = F.struct(packed(docs, "text").alias("all"), F.col("text").isNull().alias("none"))
    out = _joined(docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("owner"), "text"), False, **kw)
    own = {"text": F.when(~F.col("row.none"), F.col("kept"))}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("row.all.n_chars"))
    return out.select(*unpacked(docs, "row.all", **own))
