"""The network's fit: independent of partitions, and its steps along the gradient of its own log-probability."""

import random

import numpy as np
from pyspark.sql import functions as F

from scholia.llm import lmscore


def corpus(n, seed=5):
    rng = random.Random(seed)
    follow = {i: [rng.randrange(40) for _ in range(3)] for i in range(40)}
    out = []
    for _ in range(n):
        w, text = rng.randrange(40), []
        for _ in range(60):
            text.append(f"w{w}")
            w = rng.choice(follow[w])
        out.append(" ".join(text))
    return out


def test_fit_does_not_depend_on_partitions(spark):
    """64 partitions teach what one does: held-out words are far likelier than by their frequencies, and alike to 0.05."""
    df = spark.createDataFrame(list(enumerate(corpus(1200))), "doc_id long, text string")
    held, found = df.filter("doc_id < 100"), {}
    for parts in (1, 64):
        net, vocab = lmscore.fit(df.filter("doc_id >= 100").repartition(parts), classes=8, width=8, batch_words=256, rate=0.3)
        found[parts] = lmscore.score(held, net, vocab).agg(F.sum("log_probability") / F.sum("n_words")).first()[0]
    assert abs(found[1] - found[64]) < 0.05, found
    n = F.count(F.lit(1))
    words = df.filter("doc_id >= 100").select(F.explode(F.split("text", " ")).alias("w")).groupBy("w").agg(n.alias("n"))
    total = words.agg(F.sum("n")).first()[0]
    by_frequency = sum(r.n / total * np.log(r.n / total) for r in words.collect())
    assert min(found.values()) > by_frequency + 0.8, (found, by_frequency)
    # several learners, averaged in levels of two
    net, vocab = lmscore.fit(df.filter("doc_id >= 100").repartition(16), classes=8, width=8, batch_words=256, rate=0.3, learner_words=6_000, fan=2)
    several = lmscore.score(held, net, vocab).agg(F.sum("log_probability") / F.sum("n_words")).first()[0]
    assert several > by_frequency + 0.5, (several, by_frequency)


def test_steps_follow_the_gradient():
    """With memory so large that it is constant, a step is the gradient by a constant: it equals finite differences of the batch's log-probability."""
    rng = np.random.default_rng(3)
    net = lmscore.WindowNet(4, 5, seed=2)
    for x in net.parts():
        x[...] = rng.standard_normal(x.shape) * 0.3
    around, target = rng.integers(0, 17, (4, 30)), rng.integers(1, 17, 30)
    before = [x.astype(float).copy() for x in net.parts()]

    def score(parts):
        for x, value in zip(net.parts(), parts, strict=True):
            x[...] = value
        return float(net.log_probabilities(around, target).astype(float).sum())

    memory = [np.full(x.shape, 1e8, np.float32) for x in net.parts()]
    net.train(around, target, memory, rate=10.0)
    steps = [(x.astype(float) - b) * 1e4 / 10.0 for x, b in zip(net.parts(), before, strict=True)]
    for k, step in enumerate(steps):
        flat = rng.permutation(step.size)[:25]
        for i in flat:
            moved = [b.copy() for b in before]
            at = np.unravel_index(i, step.shape)
            moved[k][at] += 0.02
            up = score(moved)
            moved[k][at] -= 0.04
            slope = (up - score(moved)) / 0.04
            assert abs(slope - step[at]) < 0.02 + 0.02 * abs(slope), (k, at, slope, step[at])


def test_null_ids_and_long_texts(spark):
    long = " ".join(f"w{i % 50}" for i in range(200_000))
    df = spark.createDataFrame([(None, "w1 w2 w3"), (None, None), (3, long), (4, "w1 w2 w3"), (4, "w1 w2 w3")], "doc_id long, text string").withColumn("h", F.lit("clash")).withColumn("block", F.lit(1))
    net, vocab = lmscore.fit(df, classes=8, width=4, batch_words=4096)
    rows = lmscore.score(df, net, vocab).collect()
    assert sorted((r.doc_id or -1, r.n_words) for r in rows) == [(-1, 0), (-1, 3), (3, 200_000), (4, 3), (4, 3)]
    same = {round(r.log_probability, 5) for r in rows if r.n_words == 3}
    assert len(same) == 1
    whole = next(r.log_probability for r in rows if r.doc_id == 3)
    assert -200_000 * np.log(51) < whole < 0


def test_a_step_takes_each_softmax_at_once():
    import numpy as np

    from scholia.llm import lmscore

    rng = np.random.default_rng(2)
    net = lmscore.WindowNet(classes=8, width=4)
    net.by_word += rng.standard_normal(net.by_word.shape).astype(np.float32)
    net.word_bias += rng.standard_normal(net.word_bias.shape).astype(np.float32)
    around, target = rng.integers(0, 65, (4, 3000)).astype(np.int32), rng.integers(1, 65, 3000).astype(np.int32)
    target[target > 56] = 3  # a class without words, and more positions than a softmax takes at a time
    c, w = np.divmod(target - 1, 8)
    h = np.tanh(net.bias + sum(net.near[k][around[k]] for k in range(4))).astype(float)
    log = lambda z: z - np.log(np.exp(z).sum(1, keepdims=True))
    want = log(h @ net.by_class.T + net.class_bias)[np.arange(3000), c] + log(np.einsum("nd,nwd->nw", h, net.by_word[c]) + net.word_bias[c])[np.arange(3000), w]
    assert np.abs(net.log_probabilities(around, target) - want).max() < 1e-4
    calls, plain = [], lmscore._softmax
    lmscore._softmax = lambda z: calls.append(z.shape) or plain(z)
    try:
        net.train(around, target, [np.full(x.shape, 1.0, np.float32) for x in net.parts()], 0.1)
    finally:
        lmscore._softmax = plain
    assert calls == [(8, 3000)] * 2  # not one for each class
