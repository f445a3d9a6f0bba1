"""Vectors: unit length, cosine top-k, page centroids, best chunk by page, similar pages, an approximate index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.tables import new_path, stream_rows, written


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """v at length 1, as doubles; a zero vector stays. The norm is taken once, as a lambda's variable."""
    wide = F.transform(v, lambda x: x.cast("double"))
    both = F.transform(F.array(wide), lambda w: F.struct(w.alias("w"), F.sqrt(dot(w, w)).alias("n")))
    return F.element_at(F.transform(both, lambda b: F.transform(b["w"], lambda x: x / F.when(b["n"] > 0, b["n"]).otherwise(1.0))), 1)


def literal(query: list[float]) -> Column:
    return unit(F.array(*[F.lit(float(x)) for x in query]))


def search(chunks: DataFrame, query: list[float], k: int = 5) -> DataFrame:
    """The k rows of chunks(id, emb) of highest cosine with one query vector, best first."""
    return chunks.withColumn("score", dot(unit(F.col("emb")), literal(query))).orderBy(F.desc(F.round("score", 12)), "id").limit(k)


def centroids(chunks: DataFrame) -> DataFrame:
    """page, emb: mean of unit vectors by page, at unit length. Partial sums by (page, place); nothing is collected by page but one vector."""
    flat = chunks.select("page", F.posexplode(unit(F.col("emb"))).alias("p", "x")).groupBy("page", "p").agg(F.avg("x").alias("x"))
    return flat.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("emb")).select("page", unit(F.col("emb")).alias("emb"))


def _first(score: str, other: str, *by: str):
    """Of each group of ``by`` the row of highest score, of smallest ``other`` among equal ones (of any type that has an order)."""
    return F.min(F.struct((-F.col(score)).alias("s"), F.col(other).alias("o"))).alias("b")


def best_chunk_per_page(chunks: DataFrame, query: list[float], pages: DataFrame | None = None) -> DataFrame:
    """page, id, score of each page's best chunk, best first; of pages(page), if given."""
    rows = chunks if pages is None else chunks.join(pages, "page", "left_semi")
    scored = rows.select("page", "id", F.round(dot(unit(F.col("emb")), literal(query)), 12).alias("score"))
    best = scored.groupBy("page").agg(_first("score", "id")).select("page", F.col("b.o").alias("id"), (-F.col("b.s")).alias("score"))
    return best.orderBy(F.desc("score"), "id")


def matrix(column) -> np.ndarray:
    """The unit vectors of an Arrow column of lists of one length."""
    m = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _best(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k highest of each row, and all that equal the last of them."""
    if sims.shape[1] <= k:
        return np.nonzero(sims > -2)
    cut = np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k]
    return np.nonzero((sims >= cut[:, None]) & (sims > -2))


def _kept(best: np.ndarray, other: np.ndarray, sims: np.ndarray, theirs: np.ndarray) -> None:
    """Puts what ``sims`` (a row for each row of ``best``, a column for each of ``theirs``, later ones than those seen) has above the last of ``best`` into it, in place: scores above 0, best first, the earlier first of equal ones."""
    k = best.shape[1]
    last = np.maximum(best[:, -1], 0)
    row, col = np.divmod(np.flatnonzero(sims > (last + 4e-13)[:, None]), sims.shape[1])  # of one dimension: in two it takes several times as long
    if len(row) > 16 * k * len(best) and sims.shape[1] > k:  # at first, as long as everything is above
        row, col = _best(np.round(sims, 12), k)
    score = np.round(sims[row, col], 12)
    row, col, score = (x[score > last[row]] for x in (row, col, score))
    if not len(row):
        return
    some, at = np.unique(row, return_inverse=True)
    rows = np.concatenate([np.repeat(np.arange(len(some)), k), at])
    scores, others = np.concatenate([best[some].ravel(), score]), np.concatenate([other[some].ravel(), theirs[col]])
    order = np.lexsort((others, -scores, rows))
    counts = np.bincount(rows)
    first = order[(np.cumsum(counts) - counts)[:, None] + np.arange(k)]
    best[some], other[some] = scores[first], others[first]


def similar(vectors: DataFrame, k: int = 6, block: int = 512, structural: DataFrame | None = None, a_file: int = 1 << 16) -> DataFrame:
    """a, b, score, rank: each row's k most similar others of vectors(id, emb), score above 0; pairs in structural(a, b) don't count.

    All against all, as the definition has it, in blocks: the rows are written to the shared folder, in order of their ids, in files of some ``a_file`` rows, and a task streams them past each batch of its own rows, of which it keeps the k best.
    Of equal scores the first is kept, so groups of equal vectors, however large, cost no more than others. A row's structural pairs are left out where they are met: they travel beside the row, as numbers.
    """
    spark, folder = vectors.sparkSession, new_path(vectors.sparkSession, "vectors")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    some = written(vectors.filter("emb IS NOT NULL").select("id", F.transform("emb", lambda x: x.cast("double")).alias("emb")), "vectors")
    n = some.count()
    some.repartitionByRange(max(1, -(-n // a_file)), "id").sortWithinPartitions("id").withColumn("at", F.monotonically_increasing_id()).write.parquet(folder)
    rows = spark.read.schema(f"id {dict(vectors.dtypes)['id']}, emb array<double>, at long").parquet(folder)
    kind = rows.schema["id"].dataType
    of_id = to_arrow_type(kind)
    mine = rows.withColumn("gone", F.lit(None).cast("array<long>"))
    if structural is not None:
        gone = structural.select("a", "b").distinct().join(rows.select(F.col("id").alias("b"), "at"), "b").groupBy("a").agg(F.collect_list("at").alias("gone"))
        mine = rows.join(gone.withColumnRenamed("a", "id"), "id", "left")

    def run(batches):
        for have in batches:
            ids, own, m = have.column("id"), have.column("at").to_numpy(), matrix(have.column("emb"))
            best, other = np.full((len(m), k), -np.inf), np.full((len(m), k), -1)
            gone = have.column("gone")
            out = np.concatenate([own, gone.flatten().to_numpy(zero_copy_only=False).astype(np.int64)])  # a row isn't similar to itself
            of = np.concatenate([np.arange(len(own)), np.repeat(np.arange(len(own)), gone.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            order = np.argsort(out, kind="stable")
            out, of = out[order], of[order]
            for part in stream_rows(folder, block, ["at", "emb"]):
                theirs, t = part.column("at").to_numpy(), matrix(part.column("emb")).T
                if not len(theirs):
                    continue
                a, z = np.searchsorted(out, theirs[0]), np.searchsorted(out, theirs[-1], "right")
                hidden, col = of[a:z], np.searchsorted(theirs, out[a:z])
                for s in range(0, len(m), 256):
                    sims = m[s : s + 256] @ t
                    here = (hidden >= s) & (hidden < s + 256)
                    sims[hidden[here] - s, col[here]] = -2
                    _kept(best[s : s + 256], other[s : s + 256], sims, theirs)
            row, place = np.nonzero(best > 0)
            yield pa.record_batch([ids.take(pa.array(row)).cast(of_id), pa.array(other[row, place]), pa.array(best[row, place]), pa.array(place + 1, pa.int32())], ["a", "at", "score", "rank"])

    spread = mine.repartition(max(1, min(parts, -(-n // 256)), -(-n // 8192)))
    found = spread.mapInArrow(run, f"a {kind.simpleString()}, at long, score double, rank int")
    return found.join(rows.select("at", F.col("id").alias("b")), "at").select("a", "b", "score", "rank")


def top_k(questions: DataFrame, chunks: DataFrame, k: int = 5, question_block: int = 512) -> DataFrame:
    """qid, id, page, score, marker: the k chunks(id, page, emb) of highest cosine for each of questions(qid, emb), a stated set, against all chunks in blocks.

    Questions are written once to the shared folder and streamed past the chunks where these are read; of each batch of chunks k go on for a question.
    """
    folder = new_path(chunks.sparkSession, "questions")
    questions.filter("emb IS NOT NULL").select("qid", F.transform("emb", lambda x: x.cast("double")).alias("emb")).write.parquet(folder)
    kinds = {"qid": questions.schema["qid"].dataType, "id": chunks.schema["id"].dataType, "page": chunks.schema["page"].dataType}
    types = {n: to_arrow_type(t) for n, t in kinds.items()}

    def run(batches):
        for have in batches:
            if have.num_rows:
                mc, ids, pages = matrix(have.column("emb")), have.column("id"), have.column("page")
                for ask in stream_rows(folder, question_block):
                    sims = np.round(matrix(ask.column("emb")) @ mc.T, 12)
                    at, col = (pa.array(x) for x in _best(sims, k))
                    yield pa.record_batch([ask.column("qid").take(at).cast(types["qid"]), ids.take(col).cast(types["id"]), pages.take(col).cast(types["page"]), pa.array(sims[at.to_numpy(), col.to_numpy()])], ["qid", "id", "page", "score"])

    schema = ", ".join(f"{n} {t.simpleString()}" for n, t in kinds.items()) + ", score double"
    found = chunks.filter("emb IS NOT NULL").select("id", "page", "emb").mapInArrow(run, schema)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return found.withColumn("marker", F.row_number().over(w)).filter(F.col("marker") <= k)


def signatures(emb: Column, dim: int, tables: int, bits: int, seed: int = 17) -> Column:
    """Array of a bucket number for each table: on which side of ``bits`` random planes the vector lies."""
    planes = np.random.default_rng(seed).standard_normal((tables * bits, dim)).round(4)
    sides = [F.when(dot(emb, F.array(*[F.lit(float(x)) for x in p])) > 0, 1 << (i % bits)).otherwise(0) for i, p in enumerate(planes)]
    return F.array(*[sum(sides[t * bits + 1 : (t + 1) * bits], sides[t * bits]).cast("int") for t in range(tables)])


def approximate_top_k(questions: DataFrame, chunks: DataFrame, k: int = 5, tables: int = 12, bits: int = 6) -> DataFrame:
    """As ``top_k``, but only chunks that share a bucket with a question are scored: hyperplane hashing. Fewer bits or more tables find more; ``top_k`` is the exact way."""
    first = chunks.select(F.size("emb")).first()
    if first is None:
        return questions.limit(0).select("qid").join(chunks.limit(0).select("id", "page"), F.lit(True)).selectExpr("qid", "id", "page", "0D as score", "1 as marker")
    hashed = lambda df, *names: df.select(*names, unit(F.col("emb")).alias("v")).select(*names, "v", F.posexplode(signatures(F.col("v"), first[0], tables, bits)).alias("t", "h"))
    pairs = hashed(questions, "qid").select("qid", "t", "h").join(hashed(chunks, "id", "page").select("id", "t", "h"), ["t", "h"]).select("qid", "id").distinct()
    rows = pairs.join(questions.select("qid", unit(F.col("emb")).alias("q")), "qid").join(chunks.select("id", "page", unit(F.col("emb")).alias("c")), "id")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return rows.select("qid", "id", "page", F.round(dot(F.col("q"), F.col("c")), 12).alias("score")).withColumn("marker", F.row_number().over(w)).filter(F.col("marker") <= k)
