"""Approximate nearest neighbours (operator 2): vantage-point trees, built once a shard and stored, by inner product.

Largest inner product is nearest distance once each vector x has one more coordinate, sqrt(M^2 - |x|^2), with M the largest norm of its tree,
and each query a zero there: |q - x|^2 = |q|^2 + M^2 - 2 q.x. A tree splits its points by their distance to a vantage point; a subtree
is left out for a query when the triangle inequality shows that nothing in it can be among the k nearest found so far. ``factor`` relaxes that:
the lower bound of a subtree's distance counts ``factor`` times; 1 is exact, larger is faster and misses some.

Bounds are taken at the scale of the vectors: a shard has a tree for each doubling of the norm, in which vectors are divided by M and queries by
their norm, so neither tiny nor huge vectors, nor both in one table, change what is found. Bounds only leave out; what may be in a result is scored
in double precision from the original vectors, in order of the coordinates, so equal vectors tie exactly; ties go to the smaller id.

How it scales. Vectors fall by hash into shards of about ``shard_rows``; each shard's trees are built by one task and stored in the shared folder, and so are
the queries, in blocks of ``query_block``. A search task has one block and a stripe of shards: it streams the shards' trees past its queries, and what it has found
in one shard prunes the next. Nothing but k results a query and stripe is shuffled; there are as many stripes as it takes to keep all cores busy, and one where blocks do.
Rows that are the same in id and vector are counted before they are dealt out, and of equal vectors in a shard only the k + 1 smallest ids can be in a
result, so a vector that a third of all rows share costs no task more.

Cases. Vectors null, zero, empty, or holding null or non-finite components take no part; null ids don't either. Vectors of different lengths are searched apart, each among its own length.
Rows that share an id are all candidates; a query doesn't meet rows of its own id; of queries that are the same in id and vector there is one. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, lean_call, load_file, materialize, save_file, table_path

#: Rounding of a bound, as a share of |q| M: distances are good to some 1e-8 of it where they are nearly 0.
SLACK = 4e-7
RESULT = "query long, query_id long, vec_id long, score double"


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows of x and q (one row, or as many), summed in order of the coordinates."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * q[..., d]
    return out


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by a power of two each, so that their largest component is 0.5 to 1, and the exponents: squares of these neither vanish nor overflow."""
    exponent = np.frexp(np.abs(x).max(1))[1]
    return np.ldexp(x, -exponent[:, None]), exponent


class Found:
    """The k best of each query so far."""

    def __init__(self, q: np.ndarray, q_ids: np.ndarray, k: int):
        self.q, self.q_ids, self.k = q, q_ids, k
        small, self.exponent = scaled(q)
        self.length = np.sqrt((small**2).sum(1))
        self.unit = small / self.length[:, None]
        self.score, self.id = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        self.computed = 0

    def least(self, who: np.ndarray, exponent: int) -> np.ndarray:
        """What an inner product of unit query and vector (times 2**-exponent) must reach to be among the k best."""
        return np.ldexp(self.score[who, -1], -self.exponent[who] - exponent) / self.length[who]

    def add(self, who: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        mine, at = np.unique(who, return_inverse=True)
        owner = np.r_[np.repeat(np.arange(len(mine)), self.k), at]
        s, i = np.r_[self.score[mine].ravel(), score], np.r_[self.id[mine].ravel(), ids]
        order = np.lexsort((i, -s, owner))
        owner, s, i = owner[order], s[order], i[order]
        first = np.searchsorted(owner, np.arange(len(mine)))
        top = (first[:, None] + np.arange(self.k)).ravel()
        self.score[mine], self.id[mine] = s[top].reshape(-1, self.k), i[top].reshape(-1, self.k)


class VpTree:
    """A vantage-point tree over rows of x of like norm (within a factor of 2); leaves hold up to leaf rows."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf: int = 512, seed: int = 1):
        self.leaf, self.rng = leaf, np.random.default_rng(seed)
        self.exponent = int(np.frexp(np.abs(x).max())[1])
        small = np.ldexp(x, -self.exponent)
        norm2 = (small**2).sum(1)
        self.most = float(np.sqrt(norm2.max()))
        self.wide = np.concatenate([small / self.most, np.sqrt(np.maximum(1 - norm2 / self.most**2, 0))[:, None]], 1)
        self.order = np.arange(len(x))
        self.root = self._build(0, len(x))
        self.x, self.ids, self.near = x[self.order], ids[self.order], np.ascontiguousarray(self.wide[self.order, :-1])
        del self.wide, self.order, self.rng

    def _distances(self, at: np.ndarray, vantage: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.wide[at] - vantage) ** 2).sum(1))

    def _build(self, a: int, b: int):
        if b - a <= self.leaf:
            return (a, b)
        at = self.order[a:b]
        # of a few points the one whose distances to some others differ most
        some = at[self.rng.integers(b - a, size=64)]
        vantage = self.wide[max(at[self.rng.integers(b - a, size=6)].tolist(), key=lambda i: float(self._distances(some, self.wide[i]).std()))]
        d = self._distances(at, vantage)
        s = np.argsort(d, kind="stable")
        if d[s[-1]] <= d[s[0]]:
            return (a, b)
        m = (b - a) // 2
        self.order[a:b] = at[s]
        d = d[s]
        return (a, b, vantage.copy(), (d[0], d[m - 1]), (d[m], d[-1]), self._build(a, a + m), self._build(a + m, b))

    def search(self, found: Found, factor: float) -> None:
        """Adds to found what this tree has."""

        def leaf(a: int, b: int, who: np.ndarray) -> None:
            ids, k = self.ids[a:b], found.k
            s = found.unit[who] @ self.near[a:b].T  # of unit vectors: good to some 1e-14
            found.computed += s.size
            s[found.q_ids[who][:, None] == ids[None]] = -np.inf
            cut = found.least(who, self.exponent) / self.most - 1e-12
            may = s >= cut[:, None]
            if b - a > k and len(many := np.flatnonzero(may.sum(1) > 2 * k)):
                may[many] = s[many] >= np.partition(s[many], b - a - k, axis=1)[:, b - a - k, None] - 1e-12
            at, col = np.nonzero(may & (s > -np.inf))
            if len(at):
                found.add(who[at], exact_scores(self.x[a + col], found.q[who[at]]), ids[col])

        def visit(node, who: np.ndarray) -> None:
            if not len(who):
                return
            if len(node) == 2:
                for s in range(node[0], node[1], 4096):
                    leaf(s, min(s + 4096, node[1]), who)
                return
            _, _, vantage, inner, outer, left, right = node
            d = np.sqrt(np.maximum(2 - 2 * (found.unit[who] @ vantage[:-1]), 0))
            near = d <= (inner[1] + outer[0]) / 2

            def worth(which, span):
                w, dist = who[which], d[which]
                low = factor * np.maximum(np.maximum(dist - span[1], span[0] - dist), 0)
                return w[1 - low * low / 2 + SLACK * factor >= found.least(w, self.exponent) / self.most]

            visit(left, worth(near, inner))
            visit(right, worth(~near, outer))
            visit(right, worth(near, outer))
            visit(left, worth(~near, inner))

        who = np.arange(len(found.q))
        visit(self.root, who[found.least(who, self.exponent) / self.most <= 1 + SLACK])


def plant(x: np.ndarray, ids: np.ndarray, k: int, leaf: int = 512) -> list[VpTree]:
    """The trees of a shard, of largest norms first. Of equal vectors the k + 1 smallest ids stay, k rows of each."""
    order = np.lexsort((ids, *x.T[::-1]))
    x, ids = x[order], ids[order]
    new = np.r_[True, (x[1:] != x[:-1]).any(1)]
    new_id = new | np.r_[True, ids[1:] != ids[:-1]]
    of_id, of_vector = np.cumsum(new_id) - 1, np.cumsum(new) - 1
    rank = of_id - of_id[np.flatnonzero(new)][of_vector]
    place = np.arange(len(x)) - np.flatnonzero(new_id)[of_id]
    keep = (rank <= k) & (place < k)
    x, ids = x[keep], ids[keep]
    small, exponent = scaled(x)
    band = np.floor(np.log2((small**2).sum(1)) / 2 + exponent + 0.5)  # lengths around a power of two are in one band
    return [VpTree(x[band == b], ids[band == b], leaf) for b in np.unique(band)[::-1]]


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return np.stack(table.column("v").to_numpy(zero_copy_only=False)).astype(float), table.column("id").to_numpy()


def _store(table: pa.Table, kind: str, folder: str, k: int, leaf: int) -> pa.Table:
    """Writes a shard's trees, or a block of queries; says which."""
    n, part = table.column("n")[0].as_py(), table.column("part")[0].as_py()
    x, ids = _matrix(table)
    copies = table.column("copies").to_numpy()
    if kind == "trees":
        made = plant(np.repeat(x, np.minimum(copies, k), axis=0), np.repeat(ids, np.minimum(copies, k)), k, leaf)
    else:
        order = np.lexsort((*x.T[::-1], ids))
        made = (x[order], ids[order])
    save_file(f"{folder}/{kind}-{n}-{part}", zstandard.compress(pickle.dumps(made), 1))
    return pa.table({"n": pa.array([n], pa.int32()), "part": pa.array([part], pa.int64())})


def _storer(*how):
    return lambda table: lean_call(_store, table, *how)


def _load(folder: str, kind: str, n: int, part: int):
    return pickle.loads(zstandard.decompress(load_file(f"{folder}/{kind}-{n}-{part}")))


def _search(batches, plan: list, folder: str, k: int, factor: float):
    """plan: (first task, vector length, shards, blocks, stripes), for tasks numbered by block, then stripe."""
    starts = np.array([p[0] for p in plan])
    for batch in batches:
        for task in batch.column("id").to_pylist():
            first, n, shards, blocks, stripes = plan[int(np.searchsorted(starts, task, "right")) - 1]
            block, stripe = divmod(task - first, stripes)
            q, q_ids = _load(folder, "queries", n, block)
            found = Found(q, q_ids, k)
            for shard in range(stripe, shards, stripes):
                for tree in _load(folder, "trees", n, shard):
                    tree.search(found, factor)
            at, col = np.nonzero(found.score > -np.inf)
            number = ((n * blocks + block) << 24) + at  # a block holds far fewer than 2**24 queries
            yield pa.record_batch([pa.array(number, pa.int64()), pa.array(q_ids[at], pa.int64()), pa.array(found.id[at, col], pa.int64()), pa.array(found.score[at, col], pa.float64())], ["query", "query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, factor: float = 1.0, shard_rows: int = 8192, query_block: int = 1024, leaf: int = 512, busy: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row of vectors(vec_id, embedding) whose vec_id is divisible by every. busy: tasks to have at least (twice the cores)."""
    spark = vectors.sparkSession
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null and size(v) > 0")
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    rows = materialize(rows.groupBy("id", "v").agg(F.count("*").alias("copies")).withColumn("n", F.size("v")), "vectors")
    sizes = rows.groupBy("n").agg(F.count("*").alias("rows"), F.sum((F.col("id") % every == 0).cast("long")).alias("queries")).orderBy("n").collect()  # a row a length
    busy = busy or 2 * spark.sparkContext.defaultParallelism
    plan, task = [], 0
    for n, total, asked in sizes:
        shards, blocks = -(-total // shard_rows), -(-asked // query_block)
        if asked:
            stripes = min(shards, max(1, -(-busy // blocks)))
            plan.append((task, n, shards, blocks, stripes))
            task += blocks * stripes
    if not task:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    folder = table_path(spark, "vantage-points")

    def number(column: str, seed: int):
        many = F.lit(1)
        for _, n, shards, blocks, _ in plan:
            many = F.when(F.col("n") == n, shards if column == "trees" else blocks).otherwise(many)
        return F.pmod(F.xxhash64("id", "v", F.lit(seed)), many)

    for kind, some in (("trees", rows.filter(F.col("n").isin(*[p[1] for p in plan]))), ("queries", rows.filter(F.col("id") % every == 0))):
        stored = some.withColumn("part", number(kind, len(kind))).groupBy("n", "part").applyInArrow(_storer(kind, folder, k, leaf), "n int, part long")
        there = {tuple(r) for r in stored.collect()}  # a row a file
        for _, n, shards, blocks, _ in plan:
            for part in range(shards if kind == "trees" else blocks):
                if (n, part) not in there:  # nothing fell into it
                    save_file(f"{folder}/{kind}-{n}-{part}", zstandard.compress(pickle.dumps([] if kind == "trees" else (np.zeros((0, n)), np.zeros(0, np.int64)))))
    found = spark.range(0, task, 1, task).mapInArrow(lambda it: lean(_search(it, plan, folder, k, factor)), RESULT)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
