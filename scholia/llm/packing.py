"""Best-fit packing (operator 4): documents into token sequences, by a configuration linear program over the length histogram.

A document longer than a sequence is cut into full pieces and a rest. Which lengths go together is decided on the histogram of
piece lengths alone (at most ``size`` numbers, whatever the corpus): a configuration is a multiset of lengths that fits a
sequence. The fractional program covers nearly all pieces by the fewest configurations, by multiplicative weights: prices of lengths fall
as they are covered, a knapsack dynamic program finds the configurations that the present prices pay most for, and each is used a
small step more. Uses are rounded to whole numbers, and what is left, much the same mixture of lengths, is packed best-fit, longest
first. Ranks of pieces within their length then turn the plan into places.

How it scales. Texts are tokenised once, where they are read; only (id, piece, length, checksum) goes on, to a table in the
shared folder. Ranks within a length come from counts by (length, salt), with as many salts as the length's count asks for, so a length that a
third of all pieces have is spread. The plan that goes to the executors is bounded by ``rounds`` times ``size`` configurations, whatever the corpus.

Cases. Null or empty text: one piece, the end token alone. Rows repeated with one doc_id are packed each. Null doc_id: packed
too. Empty table: no rows. Very long texts: any number of pieces.
"""

from __future__ import annotations

import functools
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, kept, lean, materialize, pieces, quoted, quoted_name, ragged, shuffle_parts, unused, utf8, words


class WordBpe:
    """Token ids of a word-end BPE vocabulary (tokenizers' JSON), as its own library gives them, with a table of words seen.

    The vocabulary's words end in a marker; here that is one byte that no UTF-8 text holds, so that a byte-pair encoder of
    merge ranks can be used for words that the table lacks. Texts fall at spaces and line ends into chunks that don't depend on
    each other. Chunks are looked up by 64-bit hash in an open-addressing table, many at a time; it takes the first ``most``
    chunks and is then left as it is (about 30 bytes a slot, so memory is bounded).
    """

    def __init__(self, path: str, most: int = 1_000_000):
        import json

        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
        ranks = {}
        for token, i in vocab.items():
            word_end = token.endswith("</w>") and token != "</w>"
            body = token[:-4] if word_end else token
            if all(c in byte_of for c in body):
                ranks.setdefault(bytes(byte_of[c] for c in body) + b"\xff" * word_end, i)
        free = max(vocab.values()) + 1
        for b in range(256):
            if bytes([b]) not in ranks:
                ranks[bytes([b])] = free
                free += 1
        self.path = path
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.unassigned = regex.compile(r"\p{Cn}").search
        self.piece = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.most, self.used, self.top = most, 0, 0
        bits = max(12, int(most * 1.6).bit_length())
        self.mask = U64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, U64)  # 0: free
        self.at = np.zeros(1 << bits, np.uint32)
        self.n = np.zeros(1 << bits, np.uint32)
        self.pool = np.zeros(1 << 16, "<u4")

    @functools.cached_property
    def own(self):
        """The vocabulary's own tokenizer: some 40 MB, so loaded when the first chunk needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def word(self, chunk: str) -> list[int]:
        # special tokens, letters whose lower case depends on more, and code points that libraries of other Unicode versions see differently
        if "<|" in chunk or "\u03a3" in chunk or "\u0130" in chunk or (not chunk.isascii() and self.unassigned(chunk)):
            return self.own.encode(chunk, add_special_tokens=False).ids
        low = (chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk)).lower()
        if low.isalpha():
            return self.piece(low.encode() + b"\xff")
        if low[:-1].isalpha() and low[-1] in ".,;:!?|":
            return self.piece(low[:-1].encode() + b"\xff") + self.piece(low[-1].encode() + b"\xff")
        ids: list[int] = []
        for w in self.split(low):
            ids += self.piece(w.encode() + b"\xff")
        return ids

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Slot of each hash, -1 where it isn't there."""
        out = np.full(len(h), -1, np.int64)
        todo, slot = np.arange(len(h)), h & self.mask
        while len(todo):
            key = self.keys[slot]
            hit = key == h[todo]
            out[todo[hit]] = slot[hit]
            go = ~hit & (key != 0)
            todo, slot = todo[go], (slot[go] + U64(1)) & self.mask
        return out

    def _add(self, h: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        todo, slot = np.arange(len(h)), h & self.mask
        while len(todo):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[todo[free]]  # of several for one slot, the last stays
            won = free & (self.keys[slot] == h[todo])
            self.at[slot[won]], self.n[slot[won]] = at[todo[won]], n[todo[won]]
            todo, slot = todo[~won], (slot[~won] + U64(1)) & self.mask
        self.used += len(h)

    def ids(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's begin."""
        start, length, h, first = words(buf, offsets, b" \n", False)
        h = np.where(h == 0, U64(1), h)
        slot = self._find(h)
        missing = np.flatnonzero(slot < 0)
        at, n, pool = self.at[slot].astype(np.int64), self.n[slot].astype(np.int64), self.pool
        if len(missing):
            new, one, back = np.unique(h[missing], return_index=True, return_inverse=True)
            one = missing[one]
            raw, flat, sizes = buf.tobytes(), [], []
            for s, e in zip(start[one].tolist(), (start[one] + length[one]).tolist(), strict=True):
                got = self.word(raw[s:e].decode())
                flat += got
                sizes.append(len(got))
            sizes = np.array(sizes, np.int64)
            fresh = np.array(flat, "<u4")
            place = np.cumsum(sizes) - sizes + self.top
            if self.top + len(fresh) > len(pool):
                pool = np.concatenate([pool[: self.top], np.zeros(max(self.top, len(fresh)) + len(fresh), "<u4")])
            pool[self.top : self.top + len(fresh)] = fresh
            at[missing], n[missing] = place[back], sizes[back]
            if self.used + len(new) <= self.most:
                self._add(new, place, sizes)
                self.pool, self.top = pool, self.top + len(fresh)
        ends = np.r_[0, np.cumsum(n)]
        return pool[ragged(at, n)], ends[first]


def _cut(batches, path: str, size: int, end: int, block: int = 1 << 19):
    tok = kept("word_bpe", path, WordBpe)
    stop = np.array([end], "<u4")
    for batch in batches:
        buf, offsets = utf8(batch.column("text"))
        rows, piece, start, length, crc = [], [], [], [], []
        for i, j in pieces(offsets, block):
            all_ids, at = tok.ids(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            for row, a, b in zip(range(i, j), at[:-1].tolist(), at[1:].tolist(), strict=True):
                ids = np.concatenate([all_ids[a:b], stop])
                for k, s in enumerate(range(0, len(ids), size)):
                    part = ids[s : s + size]
                    rows.append(row), piece.append(k), start.append(s), length.append(len(part)), crc.append(zlib.crc32(part))
        yield pa.record_batch([batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])


def token_pieces(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of docs(doc_id, text)."""
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(lambda it: _cut(it, tokenizer_path, size, end_id), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def price(worth: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room from 0 to size: the most worth of a multiset of lengths that fits (unbounded knapsack), and the length it takes first (0: the room is left by one)."""
    best, pick = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    lengths = np.flatnonzero(worth > 0)
    w = worth[lengths]
    until = np.searchsorted(lengths, np.arange(size + 1), "right")
    for c in range(1, size + 1):
        best[c] = best[c - 1]
        if n := until[c]:
            value = w[:n] + best[c - lengths[:n]]
            j = int(value.argmax())
            if value[j] > best[c] + 1e-15:
                best[c], pick[c] = value[j], lengths[j]
    return best, pick


def _columns(lengths: np.ndarray, pick: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each length the best configuration that holds it, out of one run of ``price``: (which, piece) of all pieces, by which."""
    stop = np.maximum.accumulate(np.where(pick > 0, np.arange(size + 1), 0))
    which, room = np.arange(len(lengths)), stop[size - lengths]
    out = [(which, lengths)]
    while True:
        go = room > 0
        which, room = which[go], room[go]
        if not len(which):
            break
        out.append((which, pick[room]))
        room = stop[room - pick[room]]
    which, piece = (np.concatenate([o[k] for o in out]) for k in range(2))
    order = np.lexsort((piece, which))
    return which[order], piece[order]


def fractional_cover(hist: np.ndarray, size: int, rounds: int, step: float = 0.3, share: float = 0.97) -> tuple[dict[tuple[int, ...], float], float]:
    """How often to use each configuration, so that together they come near to covering ``share`` of hist; and a lower bound on the sequences that hist needs.

    Multiplicative weights: a length's price is its share of a sequence, times exp(-rate) to the power of the share of it that is covered. The rate is so small that
    prices decide among configurations of equal fill, so what is covered least goes first. One run of the knapsack prices a column for each length; a round uses those
    that fill a sequence (but for one token in the last fifth of rounds), each by the fraction ``step`` of what its length lacks, and less where lengths in them lack less.
    Prices over the best configuration's worth are a solution of the dual program, which gives the bound.
    """
    target, done = hist * share, np.zeros(size + 1)
    has = np.flatnonzero(hist)
    columns: dict[tuple[int, ...], float] = {}
    bound = 0.0
    for r in range(rounds):
        left = target - done
        live = has[left[has] > 1e-6]
        if not len(live):
            break
        prices = np.zeros(size + 1)
        prices[has] = has / size * np.exp(-0.5 / size * done[has] / hist[has])
        best, pick = price(np.where(left > 1e-6, prices, 0), size)
        if len(live) == len(has):
            bound = max(bound, float(hist[has] @ prices[has]) / best[size])
        which, piece = _columns(live, pick, size)
        fills = np.bincount(which, piece, minlength=len(live)) >= size - (r >= rounds * 0.8)
        own = np.bincount(which[piece == live[which]], minlength=len(live))
        use = np.where(fills, left[live] * step / own, 0)
        need = np.bincount(piece, use[which], minlength=size + 1)
        enough = np.clip(left * (1 - 1e-6) / np.maximum(need, 1e-30), 0, 1)
        least = np.ones(len(live))
        np.minimum.at(least, which, enough[piece])
        use *= least
        done += np.bincount(piece, use[which], minlength=size + 1)
        cuts = np.searchsorted(which, np.arange(len(live) + 1))
        for i in np.flatnonzero(use > 1e-9).tolist():
            config = tuple(piece[cuts[i] : cuts[i + 1]].tolist())
            columns[config] = columns.get(config, 0.0) + float(use[i])
    return columns, bound


def rounded(columns: dict[tuple[int, ...], float], hist: np.ndarray, share: float = 0.97) -> dict[tuple[int, ...], int]:
    """Whole numbers of configurations: rounded down, then one more of those of largest remainder while ``share`` of hist has their pieces, so that the rest keeps all lengths."""
    left, out = np.ceil(hist * share).astype(np.int64), {}
    for config, use in columns.items():
        if n := int(use + 1e-9):
            out[config] = n
            np.subtract.at(left, list(config), n)
    for config in sorted(columns, key=lambda c: (int(columns[c] + 1e-9) - columns[c], c)):
        each = Counter(config)
        if all(left[x] >= n for x, n in each.items()):
            out[config] = out.get(config, 0) + 1
            np.subtract.at(left, list(config), 1)
    return out


def plan(hist: np.ndarray, size: int, rounds: int = 200) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, from rank, to rank, pieces a sequence, first sequence, first offset) that place every piece of hist. rounds=0: best fit alone."""
    hist = np.asarray(hist, np.int64)
    rank = np.zeros(size + 1, np.int64)
    rows, sequence = [], 0
    full = int(hist[size])
    if full:
        rows.append((size, 0, full, 1, 0, 0))
        rank[size], sequence = full, full
    rest = hist.copy()
    rest[size] = 0
    for config, times in sorted(rounded(fractional_cover(rest, size, rounds)[0], rest).items()):
        offset = 0
        for x, a in sorted(Counter(config).items(), reverse=True):
            rows.append((x, int(rank[x]), int(rank[x]) + times * a, a, sequence, offset))
            rank[x] += times * a
            offset += x * a
        sequence += times
    # best fit of the rest, longest first; sequences with as much room that follow one another go as a group (room, first, how many)
    open_: list[tuple[int, int, int]] = []
    for x in range(size, 0, -1):
        n = int(hist[x] - rank[x])
        while n:
            k = bisect_left(open_, (x, -1, -1))
            if k < len(open_):
                room, where, many = open_.pop(k)
            else:
                where, room, many = sequence, size, -(-n // (size // x))
                sequence += many
            each = min(room // x, max(1, n // many))
            used = min(many, n // each)
            rows.append((x, int(rank[x]), int(rank[x]) + used * each, each, where, size - room))
            rank[x] += used * each
            n -= used * each
            if room - x * each:
                insort(open_, (room - x * each, where, used))
            if many > used:
                insort(open_, (room, where + used, many - used))
    return rows


def _place(batches, table: np.ndarray, groups: np.ndarray, before: np.ndarray, rank_name: str, salt_name: str):
    """groups: length << 32 | salt of each group, ascending; before: pieces of its length in the groups before it."""
    key = table[:, 0] * (1 << 44) + table[:, 1]
    for batch in batches:
        length = batch.column("length").to_numpy()
        rank = batch.column(rank_name).to_numpy() + before[np.searchsorted(groups, length.astype(np.int64) << 32 | batch.column(salt_name).to_numpy())]
        row = table[np.searchsorted(key, length * (1 << 44) + rank, "right") - 1]
        k = rank - row[:, 1]
        names = [x for x in batch.schema.names if x not in (rank_name, salt_name)]
        out = [batch.column(x) for x in names] + [pa.array(row[:, 4] + k // row[:, 3], pa.int64()), pa.array(row[:, 5] + k % row[:, 3] * length, pa.int64())]
        yield pa.record_batch(out, [*names, "sequence_id", "offset"])


def pack(parts: DataFrame, size: int = 2048, rounds: int = 200, salt_rows: int = 1_000_000) -> DataFrame:
    """parts(..., length) with sequence_id and offset. parts must read the same whenever it is read (a table).

    Pieces of a length are ranked in groups of at most about salt_rows, so no task ranks more; the driver gets a count for each length, and one for each group.
    """
    hist = np.zeros(size + 1, np.int64)
    for x, n in parts.groupBy("length").count().collect():  # at most size rows
        hist[x] = n
    group = min(salt_rows, max(256, int(hist.sum()) // (4 * shuffle_parts(parts.sparkSession))))  # so that a length that many pieces have keeps no task longer than others
    salts = np.maximum(1, -(-hist // group))
    names, salt, rank = parts.columns, unused(parts, "salt"), unused(parts, "rank")
    many = F.element_at(F.array(*[F.lit(int(x)) for x in salts]), (F.col("length") + 1).cast("int")) if salts.max() > 1 else F.lit(1)
    salted = parts.withColumn(salt, F.pmod(F.xxhash64(*map(quoted, names)), many).cast("int"))
    counts = sorted((x << 32 | s, n) for x, s, n in salted.groupBy("length", salt).count().collect())
    groups, sizes = np.array([g for g, _ in counts], np.int64), np.array([n for _, n in counts], np.int64)
    before = np.cumsum(sizes) - sizes
    before -= before[np.searchsorted(groups, groups >> 32 << 32)]  # from the first group of its length on
    table = np.array(sorted(plan(hist, size, rounds)) or [(0, 0, 0, 1, 0, 0)], np.int64)
    ranked = salted.withColumn(rank, F.row_number().over(Window.partitionBy("length", salt).orderBy(*map(quoted, names))).cast("long") - 1)
    kind = ", ".join(f"{quoted_name(c)} {t}" for c, t in parts.dtypes)
    return ranked.mapInArrow(lambda it: lean(_place(it, table, groups, before, rank, salt)), f"{kind}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, size: int = 2048, end_id: int = 0, rounds: int = 200) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of docs(doc_id, text)."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    return pack(materialize(token_pieces(docs, tokenizer_path, size, end_id), "pieces"), size, rounds)
