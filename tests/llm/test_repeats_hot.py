"""Suffix-array dedup where one passage stands in all documents."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholia.llm import repeats


def brute(texts, length=100):
    seen, out = set(), []
    for t in texts:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if s in seen:
                gone[i : i + length] = True
            seen.add(s)
        out.append((len(b), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


def corpus(n, shared, seed=2):
    rng = random.Random(seed)
    say = lambda k: "".join(rng.choice("abcdefghijklmnop ") for _ in range(k))
    passages = [say(k) for k in shared]
    return [say(rng.randrange(20, 260)) + rng.choice(passages) + say(rng.randrange(0, 90)) for _ in range(n)]


@pytest.mark.parametrize("shared", [(60,), (99,), (100,), (101, 101), (180, 240), (500, 23)])
def test_hot_anchors_against_brute_force(spark, shared):
    texts = corpus(300, shared)
    texts += texts[:20] + [texts[3] + texts[7], texts[5] * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for kw in ({"hot_least": 8, "block": 5_000, "block_bytes": 20_000}, {"hot_least": 1 << 30}):
        got = {r.doc_id: tuple(r)[1:] for r in repeats.digest(df, **kw).collect()}
        assert got == dict(enumerate(brute(texts)))


def test_a_footer_of_all_documents_is_spread(spark, monkeypatch):
    """60 bytes that all documents share remove nothing, and no part of step 3 gets more than three times the median."""
    texts = corpus(3000, (60,))
    rows = spark.createDataFrame(list(enumerate(texts)), "owner long, text string").withColumn("row", F.struct("owner"))
    sizes = spark.sparkContext.accumulator([], type("L", (__import__("pyspark").accumulators.AccumulatorParam,), {"zero": lambda s, v: [], "addInPlace": lambda s, a, b: a + b})())
    settle = repeats._settle

    def counted(table, *args):
        sizes.add([sum(len(x.as_py()) for x in table.column("data"))])
        return settle(table, *args)

    monkeypatch.setattr(repeats, "_settle", counted)
    monkeypatch.setattr(repeats, "shuffle_parts", lambda spark: 8)
    out = repeats._joined(rows, True, block=100_000, block_bytes=100_000)
    assert out.agg(F.sum("n_removed")).first()[0] == 0
    got = sorted(sizes.value)
    assert len(got) >= 8 and got[-1] <= 3 * got[len(got) // 2], got
