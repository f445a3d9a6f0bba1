"""Language ID (operator 1): error-correcting output codes over byte n-grams.

Each language has a codeword; each bit is predicted by a binary classifier on hashed byte n-grams (3 and 4 bytes, spaces
kept as word edges), and the codeword of least loss over all bits wins, each bit's loss weighted by how sure and right its classifier is
on rows that it wasn't fitted on, every fifth of the chosen ones (loss-weighted decoding). For n languages the code is exhaustive up to 5 (2^(n-1) - 1 columns), else random
columns, more of them for more languages, chosen for the largest least distance between codewords.

Training is bounded: at most ``per_language`` rows of each language, chosen by hash of the id, whole texts, gathered on the driver as
feature counts. Prediction reads every whole text once, in place, and needs no shuffle; the model is some MB whatever the corpus.

Cases. Null text or no letter: ``und``, score 0. No training rows at all: ``und`` everywhere. Null lang: no training row. A text's score
is the share of the winner in the decoded losses (softmax), ``ambiguous`` where the runner-up is close. Rows repeated: each gets its row. Empty table: no rows.
Other columns, whatever their names, are carried by ``keep_identified``. Very long texts: a text's n-grams are held at once, at some 40 bytes a byte of text; outputs are summed in chunks.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, nullable, packed, pieces, unpacked, utf8

BITS = 14
_LETTER = regex.compile(r"\p{L}")


def _features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 3-gram and 4-gram slots of the bytes (ASCII folded to lower case, digits and marks to spaces), and whether each is inside its text."""
    low = _FOLD[buf].astype(np.uint32)
    n = len(low)
    x = np.zeros(n + 3, np.uint32)
    x[:n] = low
    three = x[:n] | (x[1 : n + 1] << np.uint32(8)) | (x[2 : n + 2] << np.uint32(16))
    four = three | (x[3 : n + 3] << np.uint32(24))
    shift = np.uint32(32 - BITS)
    slots = np.stack([(three * np.uint32(2654435761)) >> shift, ((four * np.uint32(2246822519)) >> shift) | np.uint32(1 << BITS)])
    ends = np.repeat(offsets[1:], np.diff(offsets))
    at = np.arange(n)
    return slots, np.stack([at + 3 <= ends, at + 4 <= ends])


_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def codewords(n: int, least: int = 24, seed: int = 7) -> np.ndarray:
    """n rows of +1 and -1, a row a language. Exhaustive for up to 5 languages; else the best of some random codes, of 12 columns for each doubling of n, ``least`` at least.

    No column is constant, and none equals another or its complement, so that each bit asks something of its own; columns are as many as it takes for the least distance to stay far above 2.
    """
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        cols = [c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(cols, float).T
    columns = min(2 ** (n - 1) - 1, max(least, math.ceil(12 * math.log2(n))))  # there are no more
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(50):
        found: dict[bytes, np.ndarray] = {}
        while len(found) < columns:
            c = rng.choice(np.array([1, -1], np.int8), n)
            c *= c[0]  # of a column and its complement the one that begins with 1
            if (c < 0).any():
                found[c.tobytes()] = c
        code = np.array(list(found.values()), float).T
        d = (columns - code @ code.T) / 2
        if (nearest := d[~np.eye(n, dtype=bool)].min()) > far:
            best, far = code, nearest
    return best


class Model:
    """Languages, codewords, classifier weights by n-gram slot and bit, and each bit's weight in decoding."""

    def __init__(self, langs: list[str], code: np.ndarray, w: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.langs, self.code, self.w, self.bias, self.trust = langs, code, w, bias, trust

    def margins(self, buf: np.ndarray, offsets: np.ndarray, chunk: int = 1 << 17) -> np.ndarray:
        """Mean classifier output of each text, by bit. A long text is summed in chunks."""
        n, bits = len(offsets) - 1, self.w.shape[1]
        sums, count = np.zeros((n, bits)), np.zeros(n)
        slots, ok = _features(buf, offsets)
        text = np.repeat(np.arange(n), np.diff(offsets))
        for a in range(0, len(buf), chunk):
            t = text[a : a + chunk]
            first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
            for s, o in zip(slots[:, a : a + chunk], ok[:, a : a + chunk], strict=True):
                v = self.w[s]
                v[~o] = 0
                sums[t[first]] += np.add.reduceat(v, first, axis=0)
                count[t[first]] += np.add.reduceat(o.astype(np.int64), first)
        return sums / np.maximum(count, 1)[:, None] + self.bias

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Winner, its score and whether the runner-up is close, by loss-weighted decoding (logistic loss)."""
        if not len(self.langs):
            return np.zeros(len(margins), np.int64), np.zeros(len(margins)), np.ones(len(margins), bool)
        loss = (np.logaddexp(0, -margins[:, None, :] * self.code[None]) * self.trust).sum(2)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        top = p.argmax(1)
        order = np.sort(p, 1)
        gap = order[:, -1] - (order[:, -2] if p.shape[1] > 1 else 0)
        return top, p[np.arange(len(p)), top], gap < 0.1


def _counts(batches):
    """lang and hashed n-gram shares of each training text (sparse)."""
    for batch in batches:
        buf, offsets = utf8(batch.column("text"))
        langs = batch.column("lang").to_pylist()
        names, slots_out, values = [], [], []
        for i, lang in enumerate(langs):
            b = buf[offsets[i] : offsets[i + 1]]
            slots, ok = _features(b, np.array([0, len(b)]))
            slot, n = np.unique(slots[ok], return_counts=True)
            if len(slot):
                names.append(lang), slots_out.append(slot.astype("<u2").tobytes()), values.append((n / n.sum()).astype("<f4").tobytes())
        yield pa.record_batch([pa.array(names, pa.string()), pa.array(slots_out, pa.binary()), pa.array(values, pa.binary())], ["lang", "slots", "shares"])


def _places(names: list[str]) -> np.ndarray:
    """Of each name, how many equal ones stand before it."""
    met: dict[str, int] = {}
    out = []
    for x in names:
        out.append(met.get(x, 0))
        met[x] = out[-1] + 1
    return np.array(out)


def train(rows: DataFrame, per_language: int = 400, epochs: int = 12, seed: int = 3) -> Model:
    """A model of rows(doc_id, text, lang), from at most per_language rows of each language, least hash of the id first."""
    share = rows.filter("lang is not null and text is not null").groupBy("lang").count().collect()
    if not share:
        return Model([], np.ones((0, 1)), np.zeros((2 << BITS, 1)), np.zeros(1), np.ones(1))
    if len(share) > 2000:
        raise ValueError("more than 2000 languages")
    # a hash threshold that lets about twice the bound through, then the bound itself; rows of one id, or without one, are told apart by their texts
    spark = rows.sparkSession
    limits = F.broadcast(spark.createDataFrame([(r["lang"], min(1.0, 2.0 * per_language / r["count"])) for r in share], "lang string, most double"))  # at most 2000 rows
    part = rows.filter("text is not null").select("lang", "text", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("h")).join(limits, "lang")
    part = part.filter(F.pmod("h", F.lit(1 << 20)) < F.col("most") * (1 << 20))
    part = part.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).filter(F.col("n") <= per_language)
    got = part.select("lang", "text").mapInArrow(lambda it: lean(_counts(it)), "lang string, slots binary, shares binary").collect()
    got = sorted(got, key=lambda r: (r["lang"], bytes(r["slots"]), bytes(r["shares"])))
    langs = sorted({r["lang"] for r in got})
    code = codewords(len(langs))
    if not got:
        return Model([], np.ones((0, 1)), np.zeros((2 << BITS, 1)), np.zeros(1), np.ones(1))
    slots = [np.frombuffer(r["slots"], "<u2").astype(np.int64) for r in got]
    x = [np.frombuffer(r["shares"], "<f4").astype(float) for r in got]
    y = code[[langs.index(r["lang"]) for r in got]]
    # rows of a language weigh alike in sum
    size = np.array([sum(r["lang"] == x for r in got) for x in langs])
    per = (len(got) / len(langs) / size)[[langs.index(r["lang"]) for r in got]]
    w, bias, grad2 = np.zeros((2 << BITS, code.shape[1])), np.zeros(code.shape[1]), np.full((2 << BITS, code.shape[1]), 1e-8)
    rng = np.random.default_rng(seed)
    unseen = _places([r["lang"] for r in got]) % 5 == 4
    fitted = np.flatnonzero(~unseen)
    for _ in range(epochs):
        for i in rng.permutation(fitted):
            m = x[i] @ w[slots[i]] + bias
            g = -y[i] / (1 + np.exp(np.clip(m * y[i], -30, 30))) * per[i]
            d = x[i][:, None] * g
            grad2[slots[i]] += d * d
            w[slots[i]] -= 0.5 * d / np.sqrt(grad2[slots[i]])
            bias -= 0.01 * g
    judged = np.flatnonzero(unseen) if unseen.any() else fitted  # too few rows to leave any out
    m = np.array([x[i] @ w[slots[i]] + bias for i in judged])
    sure = (per[judged, None] / (1 + np.exp(-np.clip(m * y[judged], -30, 30)))).sum(0) / per[judged].sum()  # mean probability of the right bit
    sure = np.clip(sure, 0.51, 0.999)
    trust = np.log(sure / (1 - sure))
    return Model(langs, code, w.astype(np.float32), bias, trust / trust.mean())


def _predict(batches, model: Model, block: int = 1 << 18):
    for batch in batches:
        buf, offsets = utf8(batch.column("text"))
        lang, score, close = [], [], []
        for i, j in pieces(offsets, block):
            o = offsets[i : j + 1] - offsets[i]
            b = buf[offsets[i] : offsets[j]]
            top, p, near = model.decode(model.margins(b, o))
            raw = b.tobytes()
            for k in range(j - i):
                letters = bool(model.langs) and _LETTER.search(raw[o[k] : o[k + 1]].decode("utf-8", "replace")) is not None
                lang.append(model.langs[top[k]] if letters else "und"), score.append(float(p[k]) if letters else 0.0), close.append(bool(near[k]) or not letters)
        names = [n for n in batch.schema.names if n in ("row", "kept_text")]
        yield pa.record_batch([*(batch.column(n).cast(nullable(batch.column(n).type)) for n in names), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())], [*names, "lang_pred", "score", "ambiguous"])


def identify(rows: DataFrame, model: Model) -> DataFrame:
    """rows(row, text[, kept_text]) as row[, kept_text], lang_pred, score, ambiguous. row: a struct of whatever is to be carried."""
    kind = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c in ("row", "kept_text"))
    return rows.mapInArrow(lambda it: lean(_predict(it, model)), f"{kind}, lang_pred string, score double, ambiguous boolean")


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1


def digest(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous; learned from the rows of docs(doc_id, text, lang) that aren't held out."""
    held = F.coalesce(held_out(), F.lit(False))
    model = train(docs.select("doc_id", "text", "lang").filter(~held), **kw)
    return identify(docs.select(F.struct("doc_id", held.alias("held_out")).alias("row"), "text"), model).select("row.doc_id", "row.held_out", "lang_pred", "score", "ambiguous")


def keep_identified(docs: DataFrame, **kw) -> DataFrame:
    """The rows of docs that have a language, with lang as predicted. All other columns come back as they were, whatever their names."""
    model = train(docs.select("doc_id", "text", "lang").filter(~F.coalesce(held_out(), F.lit(False))), **kw)
    found = identify(docs.select(packed(docs, "text", "lang").alias("row"), "text", F.col("text").alias("kept_text")), model).filter("lang_pred <> 'und'")
    return found.select(*unpacked(docs, "row", text=F.col("kept_text"), lang=F.col("lang_pred")))
