"""LM scoring (operator 9): masked pseudo-likelihood by a bidirectional window network, trained in numpy.

The network predicts a word from the two before and the two after it: h = tanh(sum of a vector for each neighbour, by position, and a bias); then the word's
class, and the word within its class, each by softmax over h. A document's score is the sum over its words of the log-probability of each given both sides.

The vocabulary is the ``classes * classes - classes`` most frequent words of the whole corpus; each other word falls by hash into one of ``classes`` rest words.
The counts of all words are kept as a table that grows with the corpus: a word of a rest word has the rest word's probability times its own share of the rest
word's occurrences, and a word that the corpus doesn't hold has the share of one occurrence more.
Training is by local descent and averaging: in each of ``rounds`` rounds every learner starts from the present model and trains on its documents of that round
(by hash of the text), on every position; the models, weighted by positions, are averaged in a tree. A document is in one round, so the fit is one epoch of every position.
A learner trains on ``learner_words`` words or more, however the table is split: partitions are read together until they hold so many. So what a model learns between averages doesn't shrink as partitions grow in number.

How it scales. Word counts are summed in each batch before they are shuffled. A learner sends one model of fixed size (some 2 MB); models are averaged in groups of ``fan``, in as many
levels as it takes, so a task gets ``fan`` of them, and so does the driver. Scoring reads each text once, in place, with the model in the task; texts are cut into runs of
words for the matrices. Rare words' counts come by a join: a block of texts asks once for each distinct rare word, and keeps their places beside the scores.

Cases. Null or empty text, or no words: 0 words, log-probability 0, mean null. An empty corpus: the model as it begins. Repeated rows: each gets its row. Null doc_id: scored too.
Other columns are ignored. Very long texts: a text's words are held at once, at some 60 bytes a word.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, materialize, pieces, utf8, words

OFFSETS = (-2, -1, 1, 2)


class WindowNet:
    """Parameters and their use. Word ids: 0 is outside of the text, 1 + k is the k-th word; class k // classes."""

    def __init__(self, classes: int = 64, width: int = 16, seed: int = 5):
        rng = np.random.default_rng(seed)
        n = classes * classes
        self.classes = classes
        self.near = (rng.standard_normal((len(OFFSETS), n + 1, width)) * 0.3).astype(np.float32)
        self.bias = np.zeros(width, np.float32)
        self.by_class = (rng.standard_normal((classes, width)) * 0.1).astype(np.float32)
        self.class_bias = np.zeros(classes, np.float32)
        self.by_word = (rng.standard_normal((classes, classes, width)) * 0.1).astype(np.float32)
        self.word_bias = np.zeros((classes, classes), np.float32)
        self.rest = np.zeros(classes)  # occurrences of each rest word

    def parts(self) -> list[np.ndarray]:
        return [self.near, self.bias, self.by_class, self.class_bias, self.by_word, self.word_bias]

    def start_from(self, counts: np.ndarray) -> None:
        """Biases as the words' frequencies have them."""
        self.rest = counts[-self.classes :].copy()
        p = (counts + 1.0).reshape(self.classes, self.classes)
        self.class_bias[:] = np.log(p.sum(1) / p.sum())
        self.word_bias[:] = np.log(p / p.sum(1, keepdims=True))

    def hidden(self, around: np.ndarray) -> np.ndarray:
        h = self.near[0].take(around[0], 0)
        h += self.bias
        for k in range(1, len(OFFSETS)):
            h += self.near[k].take(around[k], 0)
        return np.tanh(h, out=h)

    def logits(self, h: np.ndarray, cuts: list[int], out: np.ndarray) -> None:
        """Of words within their classes, a column for each position; h: hidden values with a 1 behind, in order of their classes."""
        both = np.concatenate([self.by_word, self.word_bias[:, :, None]], 2)
        for k in range(self.classes):
            a, b = cuts[k], cuts[k + 1]
            if a < b:
                np.matmul(both[k], h[a:b].T, out=out[:, a:b])

    def log_probabilities(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log P(target | around) of each position; around: (positions, words). Ids may hold counts, as Vocabulary.ids gives them."""
        n = self.classes * self.classes
        count, target = (target - 1) // n, (target - 1) % n + 1
        h = self.hidden(np.where(around > n, (around - 1) % n + 1, around) if around.max(initial=0) > n else around)
        c, w = np.divmod(target - 1, self.classes)
        order = np.argsort(c.astype(np.uint16), kind="stable")
        h, c, w = _with_one(h, order), c[order], w[order]
        z = np.c_[self.by_class, self.class_bias] @ h.T
        p = _picked(z, c)
        self.logits(h, np.searchsorted(c, np.arange(self.classes + 1)).tolist(), z)
        p += _picked(z, w)
        out = np.empty(len(p), p.dtype)
        out[order] = p
        held = count > 0
        if held.any():
            out[held] += self.log_share(count[held], target[held] - 1 - n + self.classes)
        return out

    def log_share(self, count: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """log of words' shares of their rest words."""
        return np.log(count / (self.rest[bucket] + 1))

    def train(self, around: np.ndarray, target: np.ndarray, memory: list[np.ndarray], rate: float) -> None:
        """One step of adaptive descent on a batch; memory: sums of squares, one array for each of parts()."""
        n = len(target)
        c, w = np.divmod(target - 1, self.classes)
        order = np.argsort(c.astype(np.uint16), kind="stable")
        around, c, w, at = around.take(order, 1), c[order], w[order], np.arange(n)
        cuts = np.searchsorted(c, np.arange(self.classes + 1)).tolist()
        h = _with_one(self.hidden(around))
        z = np.c_[self.by_class, self.class_bias] @ h.T
        g = _softmax(z)
        g[c, at] -= 1
        dh, upper = g.T @ self.by_class, g @ h
        self.logits(h, cuts, z)
        g = _softmax(z)
        g[w, at] -= 1
        lower = np.zeros((self.classes, self.classes, h.shape[1]), h.dtype)
        for k in range(self.classes):
            a, b = cuts[k], cuts[k + 1]
            if a < b:
                mine = g[:, a:b]
                dh[a:b] += mine.T @ self.by_word[k]
                np.matmul(mine, h[a:b], out=lower[k])
        for value, kept, grad in ((self.by_class, memory[2], upper[:, :-1]), (self.class_bias, memory[3], upper[:, -1]), (self.by_word, memory[4], lower[:, :, :-1]), (self.word_bias, memory[5], lower[:, :, -1])):
            _step(value, kept, grad, rate)
        h = h[:, :-1]
        dh *= 1 - h * h
        _step(self.bias, memory[1], dh.sum(0), rate)
        for k in range(len(OFFSETS)):
            at = np.argsort(around[k].astype(np.uint16), kind="stable")  # ids are at most classes squared
            ids = around[k][at]
            first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            grad, rows = np.add.reduceat(dh.take(at, 0), first, axis=0), ids[first]
            squares = memory[0][k].take(rows, 0)
            squares += grad * grad
            memory[0][k][rows] = squares
            self.near[k][rows] -= rate * grad / np.sqrt(squares)


def _step(value: np.ndarray, memory: np.ndarray, grad: np.ndarray, rate: float) -> None:
    memory += grad * grad
    value -= rate * grad / np.sqrt(memory)


def _with_one(h: np.ndarray, order: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Rows of h in order, with a 1 behind each: biases are weights then."""
    out = np.ones((len(h), h.shape[1] + 1), h.dtype)
    out[:, :-1] = h[order]
    return out


#: Columns of a softmax taken at a time, so that they stay in a core's cache.
COLUMNS = 1024


def _softmax(z: np.ndarray) -> np.ndarray:
    """Of each column, in place: reductions over rows go along the memory."""
    for s in range(0, z.shape[1], COLUMNS):
        x = z[:, s : s + COLUMNS]
        x -= x.max(0)
        np.exp(x, out=x)
        x *= 1 / x.sum(0)
    return z


def _picked(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log softmax at one row of each column; z is lost."""
    out = np.empty(z.shape[1], z.dtype)
    for s in range(0, len(out), COLUMNS):
        x = z[:, s : s + COLUMNS]
        x -= x.max(0)
        mine = x[at[s : s + COLUMNS], np.arange(x.shape[1])]
        np.exp(x, out=x)
        out[s : s + COLUMNS] = mine - np.log(x.sum(0))
    return out


class Vocabulary:
    """Word hashes to ids 1 ... classes * classes: frequent words by rank, then the rest by hash. tail(h, n): all words' counts, not sent to tasks."""

    def __init__(self, hashes: np.ndarray, classes: int, tail: DataFrame | None = None):
        self.classes, self.tail = classes, tail
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"tail": None}

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Ids of a few words, on the driver: a rest word's holds the word's own count (1 if the corpus doesn't hold it), times classes * classes."""
        out = self.plain(h)
        rare = out > self.classes * self.classes - self.classes
        if rare.any() and self.tail is not None:
            n = dict(map(tuple, self.tail.filter(F.col("h").isin(np.unique(h[rare]).view(np.int64).tolist())).collect()))
            out[rare] += self.classes * self.classes * np.array([n.get(x, 1) for x in h[rare].view(np.int64).tolist()])
        return out

    def plain(self, h: np.ndarray) -> np.ndarray:
        rest = 1 + self.classes * self.classes - self.classes + (h % U64(self.classes)).astype(np.int64)
        if not len(self.sorted):
            return rest
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[at] == h, 1 + self.order[at], rest)


def _windows(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Neighbours (positions, words) of each word within its text, 0 outside."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = np.zeros((len(OFFSETS), len(ids)), ids.dtype)
    for k, o in enumerate(OFFSETS):
        if abs(o) < len(ids):
            a, b = (slice(0, -o), slice(o, None)) if o > 0 else (slice(-o, None), slice(0, o))
            out[k][a] = np.where(text[a] == text[b], ids[b], 0)
    return out


def _word_counts(batches):
    for batch in batches:
        buf, offsets = utf8(batch.column(0))
        for i, j in pieces(offsets, 1 << 22):
            h = words(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[2]
            new, n = np.unique(h, return_counts=True)
            yield pa.record_batch([pa.array(new.view(np.int64), pa.int64()), pa.array(n, pa.int64())], ["h", "n"])


def vocabulary(docs: DataFrame, classes: int = 64) -> tuple[Vocabulary, np.ndarray]:
    """The most frequent words of all texts, and the counts of all ids."""
    counts = docs.select("text").mapInArrow(_word_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "words")
    size = classes * classes - classes
    top = counts.orderBy(F.desc("n"), "h").limit(size).collect()
    hashes = np.array([r["h"] for r in top], np.int64).view(U64)
    n = np.zeros(classes * classes)
    n[: len(top)] = [r["n"] for r in top]
    bucket = F.pmod(F.pmod("h", F.lit(classes)) + F.when(F.col("h") < 0, pow(2, 64, classes)).otherwise(0), F.lit(classes))  # of h without sign
    for r in counts.groupBy(bucket.alias("b")).agg(F.sum("n").alias("n")).collect():
        n[size + r["b"]] = r["n"]
    np.subtract.at(n, size + (hashes % U64(classes)).astype(np.int64), n[: len(top)])
    return Vocabulary(hashes, classes, counts), n


def _train(batches, net: bytes, vocab: Vocabulary, rate: float, batch_words: int):
    model: WindowNet = pickle.loads(net)
    memory = [np.full(x.shape, 1.0, np.float32) for x in model.parts()]
    rng = np.random.default_rng(11)
    seen, held, kept = 0, [], 0
    for batch in batches:
        buf, offsets = utf8(batch.column(0))
        for i, j in pieces(offsets, 1 << 18):
            _, _, h, first = words(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            if not len(h):
                continue
            ids = vocab.plain(h).astype(np.int32)
            held.append((_windows(ids, first), ids))
            kept += len(ids)
            if kept >= batch_words * 8:
                seen += _descend(model, memory, held, rng, rate, batch_words)
                held, kept = [], 0
    if held:
        seen += _descend(model, memory, held, rng, rate, batch_words)
    if seen:
        yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([float(seen)]), pa.array([_dump(model.parts())], pa.binary())], ["task", "weight", "model"])


def _descend(model, memory, held, rng, rate, batch_words) -> int:
    around, target = np.concatenate([x[0] for x in held], 1), np.concatenate([x[1] for x in held])
    order = rng.permutation(len(target))
    for s in range(0, len(order), batch_words):
        at = order[s : s + batch_words]
        model.train(around.take(at, 1), target.take(at), memory, rate)
    return len(target)


def _dump(parts) -> bytes:
    return np.concatenate([x.ravel() for x in parts]).astype("<f4").tobytes()


def _average(table: pa.Table) -> pa.Table:
    weights = table.column("weight").to_numpy()
    total = None
    for w, m in zip(weights, table.column("model"), strict=True):
        x = np.frombuffer(m.as_py(), "<f4") * np.float32(w / weights.sum())
        total = x if total is None else total + x
    return pa.table({"task": pa.array([table.column("task")[0].as_py()], pa.int32()), "weight": pa.array([float(weights.sum())]), "model": pa.array([total.astype("<f4").tobytes()], pa.binary())})


def fit(docs: DataFrame, classes: int = 64, width: int = 16, rounds: int = 2, rate: float = 0.1, batch_words: int = 8192, fan: int = 8, learner_words: int = 2_000_000) -> tuple[WindowNet, Vocabulary]:
    """A network and its vocabulary, from all texts of docs(text)."""
    vocab, counts = vocabulary(docs, classes)
    learners = max(1, int(counts.sum() // (rounds * learner_words)))
    net = WindowNet(classes, width)
    net.start_from(counts)
    schema = "task int, weight double, model binary"
    for r in range(rounds):
        state = pickle.dumps(net)
        part = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(rounds)) == r).coalesce(learners)
        models = part.mapInArrow(lambda it, state=state: _train(it, state, vocab, rate, batch_words), schema)
        n = learners  # tasks are numbered below that
        while n > fan:
            n = -(-n // fan)
            models = models.groupBy((F.col("task") % n).alias("g")).applyInArrow(_average, schema)
            models = models.withColumn("task", F.col("task") % n)
        got = models.collect()  # at most fan
        if got:
            weight = sum(x["weight"] for x in got)
            flat = sum(np.frombuffer(x["model"], "<f4") * np.float32(x["weight"] / weight) for x in sorted(got, key=lambda x: x["task"]))
            at = 0
            for x in net.parts():
                x[...] = flat[at : at + x.size].reshape(x.shape)
                at += x.size
    return net, vocab


def _score(batches, net: bytes, vocab: Vocabulary, run: int):
    """A row for each block of texts: their numbers of words and scores by the network, the block's distinct rare words, and their places in each text."""
    model: WindowNet = pickle.loads(net)
    block, rest = TaskContext.get().partitionId() << 32, vocab.classes * vocab.classes - vocab.classes
    for batch in batches:
        buf, offsets = utf8(batch.column("text"))
        for i, j in pieces(offsets, 1 << 22):
            _, _, h, first = words(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            ids = vocab.plain(h)
            around = _windows(ids, first)
            p = np.zeros(len(ids))
            for s in range(0, len(ids), run):
                p[s : s + run] = model.log_probabilities(around[:, s : s + run], ids[s : s + run])
            ends = np.r_[0.0, np.cumsum(p)]
            rare = ids > rest
            new, at = np.unique(h[rare], return_inverse=True)
            n_rare = np.diff(np.r_[0, np.cumsum(rare)][first])
            cols = [batch.column("doc_id").slice(i, j - i), pa.array(np.diff(first), pa.int64()), pa.array(ends[first[1:]] - ends[first[:-1]], pa.float64()), pa.array(n_rare, pa.int64()), pa.array(new.view(np.int64), pa.int64()), pa.array(at, pa.int32())]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in cols]
            yield pa.record_batch([pa.array([block], pa.int64()), *lists], ["block", "doc_id", "n_words", "log_probability", "n_rare", "h", "at"])
            block += 1


def _with_shares(found: pa.Table, block: pa.Table, model: WindowNet) -> pa.Table:
    """Scores of a block's texts, with rare words' shares; found(pos, n): the counts of its distinct rare words."""
    doc_id, n_words, p, n_rare, h, at = (block.column(c).combine_chunks().flatten() for c in ("doc_id", "n_words", "log_probability", "n_rare", "h", "at"))
    n = np.ones(len(h))
    n[found.column("pos").to_numpy()] = found.column("n").to_numpy()
    share = model.log_share(n, (h.to_numpy().view(U64) % U64(model.classes)).astype(np.int64))
    ends = np.r_[0.0, np.cumsum(share[at.to_numpy()])][np.r_[0, np.cumsum(n_rare.to_numpy())]]
    return pa.table({"doc_id": doc_id, "n_words": n_words, "log_probability": pa.array(p.to_numpy() + np.diff(ends))})


def score(docs: DataFrame, net: WindowNet, vocab: Vocabulary, run: int = 8192) -> DataFrame:
    """doc_id, n_words, log_probability, mean_log_probability of docs(doc_id, text)."""
    state, kind = pickle.dumps(net), dict(docs.dtypes)["doc_id"]
    schema = f"block long, doc_id array<{kind}>, n_words array<long>, log_probability array<double>, n_rare array<long>, h array<long>, at array<int>"
    blocks = materialize(docs.select("doc_id", "text").mapInArrow(lambda it: _score(it, state, vocab, run), schema), "scores")
    found = blocks.select(F.col("block").alias("of"), F.posexplode("h").alias("pos", "h")).join(vocab.tail, "h").select("of", "pos", "n")
    own = WindowNet(net.classes, 1)
    own.rest = net.rest
    out = found.groupBy("of").cogroup(blocks.groupBy("block")).applyInArrow(lambda a, b: _with_shares(a, b, own), f"doc_id {kind}, n_words long, log_probability double")
    return out.withColumn("mean_log_probability", F.when(F.col("n_words") > 0, F.col("log_probability") / F.col("n_words")))


def fit_and_score(docs: DataFrame, **kw) -> DataFrame:
    net, vocab = fit(docs, **kw)
    return score(docs, net, vocab)
