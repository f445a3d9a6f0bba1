"""Incremental page upserts: what a batch of edits changes, applied to a graph or appended to a store of versions; the last edit of each key behind a stream's foreachBatch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tables import written
from ..functions.text import first_heading
from ..operators import vector
from ..operators.index import chunks_of, embedded
from ..operators.knowledge import EDGE, Graph
from ..sinks.versions import Store


def latest(edits: DataFrame, key: str = "slug", order: str = "version") -> DataFrame:
    """The last edit of each key: by partial aggregation, whatever a key's share."""
    rest = [c for c in edits.columns if c != key]
    return edits.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("x")).select(key, "x.*")


def titled(edits: DataFrame) -> DataFrame:
    """slug, title, text: one edit a slug (the last by column version, if there is one; else the first by text), without a title under its first heading or its slug."""
    one = latest(edits, "slug", "version") if "version" in edits.columns else edits.groupBy("slug").agg(F.min(F.struct("text", "title")).alias("x")).select("slug", "x.*")
    return one.select("slug", F.coalesce("title", F.nullif(first_heading(F.col("text")), F.lit("")), "slug").alias("title"), F.coalesce("text", F.lit("")).alias("text"))


def upsert_pages(pages: DataFrame, chunks: DataFrame, edits: DataFrame, size: int = 180, overlap: int = 30) -> tuple[DataFrame, DataFrame]:
    """pages(slug, title) and chunks(id, slug, chunk_index, text) after edits(slug, text, title): chunks of an edited page are replaced."""
    new = titled(edits)
    cut = chunks_of(new.withColumn("page_start", F.lit(0)).withColumn("page_end", F.lit(0)), size, overlap).select("id", F.col("page").alias("slug"), "chunk_index", "text")
    return pages.join(new.select("slug"), "slug", "left_anti").select("slug", "title").unionByName(new.select("slug", "title")), chunks.join(new.select("slug"), "slug", "left_anti").unionByName(cut)


def nearest_pages(chunks: DataFrame, edited: DataFrame, k: int = 6) -> DataFrame:
    """src, dst, score: for each of edited(page), the k nearest other pages among those of the 6k chunks nearest to its mean vector (its own may be among these); score 1 less the least distance, 0 at least."""
    means = vector.centroids(chunks.join(edited, "page", "left_semi")).withColumnRenamed("page", "qid")
    near = vector.top_k(means, chunks, 6 * k).filter("qid <> page").groupBy("qid", "page").agg(F.max("score").alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "page")
    return near.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select(F.col("qid").alias("src"), F.col("page").alias("dst"), F.greatest("score", F.lit(0.0)).alias("score"))


def changes(graph: Graph, edits: DataFrame, embedder, similar_k: int = 6, size: int = 180, overlap: int = 30) -> dict[str, tuple[DataFrame, DataFrame]]:
    """What edits(slug, text, title[, version]) of several pages change: for pages, chunks and edges the new rows, and the slugs whose earlier rows (as GRAPH_KEYS says) they replace.

    A page that there is gets its title, a new one level 0, no pages of the source and no place in order. Its chunks and PART_OF edges are replaced, its SIMILAR_TO edges of both
    directions made anew, in both directions; its other edges stay. Pages of one batch see each other's new chunks.
    """
    new = written(titled(edits), "edits")
    slugs, kinds = new.select("slug"), dict(graph.pages.dtypes)
    blank = {"level": 0, "page_start": 0, "page_end": 0, "seq": -1}
    kept = new.join(graph.pages.drop("title"), "slug", "left")
    pages = kept.select(*[F.coalesce(c, F.lit(blank[c]).cast(kinds[c])).alias(c) if c in blank else F.col(c) for c in graph.pages.columns])
    cut = embedded(chunks_of(new.withColumn("page_start", F.lit(0)).withColumn("page_end", F.lit(0)), size, overlap), embedder).select(*graph.chunks.columns)
    cut = written(cut, "chunks")
    edited = slugs.withColumnRenamed("slug", "page")
    others = graph.chunks.join(edited, "page", "left_anti").select(*cut.columns)
    parts = cut.select(F.col("id").alias("src"), F.col("page").alias("dst"), F.lit("PART_OF").alias("rel"), F.lit(None).cast("double").alias("score"))
    near = nearest_pages(others.unionByName(cut), edited, similar_k).select(F.explode(F.array(F.struct("src", "dst", "score"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "score"))).alias("e")).select("e.*")
    near = near.groupBy("src", "dst").agg(F.max("score").alias("score")).withColumn("rel", F.lit("SIMILAR_TO"))
    return {"pages": (pages, slugs), "chunks": (cut, slugs), "edges": (written(parts.select(*EDGE).unionByName(near.select(*EDGE)), "edges"), slugs)}


#: For each table of a graph, the columns that hold a page's slug and the rows that an edit of that page replaces.
GRAPH_KEYS = {"pages": {"slug": "true"}, "chunks": {"page": "true"}, "edges": {"src": "rel = 'SIMILAR_TO'", "dst": "rel IN ('SIMILAR_TO', 'PART_OF')"}}


def upsert(graph: Graph, edits: DataFrame, embedder, similar_k: int = 6, size: int = 180, overlap: int = 30) -> Graph:
    """The graph after edits, as a view over the old tables and the new rows; ``GraphStore`` keeps it."""
    if not graph.writable:
        raise RuntimeError("the graph was opened for reading only")
    out = {}
    for name, (rows, slugs) in changes(graph, edits, embedder, similar_k, size, overlap).items():
        old = getattr(graph, name)
        for column, condition in GRAPH_KEYS[name].items():
            hit = slugs.select(F.col("slug").alias("_slug"), F.lit(True).alias("_hit"))
            old = old.join(hit, F.col(column) == F.col("_slug"), "left").filter(f"NOT coalesce(_hit AND ({condition}), false)").drop("_slug", "_hit")
        out[name] = old.select(*rows.columns).unionByName(rows)
    return Graph(out["pages"], out["chunks"], graph.entities, out["edges"], graph.writable)


class GraphStore:
    """A graph as tables that are changed by appending: an edit writes rows of its own pages, and their edges, whatever the graph's size."""

    def __init__(self, spark: SparkSession, path: str):
        self.store = Store(spark, path)

    @classmethod
    def create(cls, graph: Graph, path: str) -> GraphStore:
        tables = {name: (getattr(graph, name), keys) for name, keys in GRAPH_KEYS.items()}
        edges = graph.edges.repartitionByRange("src").select(*graph.edges.columns)  # sorted by src in each file; Bloom filters serve look-ups by dst
        Store.create(graph.spark, path, tables | {"edges": (edges, GRAPH_KEYS["edges"]), "entities": (graph.entities, {"key": "true"})})
        return cls(graph.spark, path)

    def graph(self, version: int | None = None) -> Graph:
        """The graph of one version, of all its tables alike."""
        version = self.store.versions()[-1] if version is None else version
        return Graph(*(self.store.read(name, version) for name in ("pages", "chunks", "entities", "edges")), self.store.path)

    def upsert(self, edits: DataFrame, embedder, similar_k: int = 6, size: int = 180, overlap: int = 30) -> int:
        return self.store.commit(changes(self.graph(), edits, embedder, similar_k, size, overlap))

    def delete(self, slugs: DataFrame) -> int:
        """Takes out pages(slug) with their chunks and the edges that GRAPH_KEYS names; references and mentions of what is gone stay in the store, as they do after edits."""
        now = self.graph()
        return self.store.commit({name: (getattr(now, name).limit(0), slugs.select("slug")) for name in GRAPH_KEYS})


def keep_latest(store: Store, table: str, batch: DataFrame, key: str = "slug", order: str = "version") -> int:
    """Commits the last edit of each key of a batch, unless the table holds a later one. The same batch again changes nothing."""
    columns = store.read(table).columns
    new = latest(batch.filter(F.col(key).isNotNull()), key, order).select(*columns)
    held = store.read(table).join(new.select(key), key, "left_semi")
    won = written(latest(held.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True))), key, order).filter("_new").select(*columns), "batch")
    return store.commit({table: (won, won.select(key))})


def stream_latest(edits: DataFrame, path: str, checkpoint: str, key: str = "slug", order: str = "version", compact_every: int = 32):
    """Keeps the last edit of each key in table ``latest`` of a store. A batch appends its own keys; old rows stay where they are until ``compact``, so that a driver lost at any point loses nothing."""

    def apply(batch: DataFrame, n: int) -> None:
        store = Store(batch.sparkSession, path)
        if not store.versions():
            Store.create(batch.sparkSession, path, {"latest": (batch.limit(0), {key: "true"})})
        if keep_latest(store, "latest", batch, key, order) % compact_every == 0:
            store.compact()

    return edits.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_versions(edits: DataFrame, key: str, order: str) -> DataFrame:
    return edits.withColumn("revision", F.row_number().over(Window.partitionBy(key).orderBy(order)))
