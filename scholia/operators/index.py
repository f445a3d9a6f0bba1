"""From page texts to a searchable index: chunks with provenance, embedders, build, save, load, search.

An embedder is anything with a name, ``embed_documents`` and ``embed_query``. Those here need no network; ``HttpEmbedder`` asks a server for vectors.
"""

from __future__ import annotations

import json
import zlib
from typing import Protocol, runtime_checkable
from urllib.request import Request, urlopen

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..functions.text import windows
from . import vector

#: Texts in a request to a server; texts that an embedder of this module's own takes at once.
BATCH, OWN_BATCH = 32, 1024


@runtime_checkable
class Embedder(Protocol):
    name: str

    def embed_documents(self, texts: list[str]) -> np.ndarray: ...

    def embed_query(self, text: str) -> np.ndarray: ...


class WordCounts:
    """How often each of some strings stands in a text, without overlaps; a text with none of them has a little of each."""

    batch = OWN_BATCH

    def __init__(self, vocabulary: list[str]):
        self.vocabulary = list(vocabulary)
        self.name = "counts:" + ",".join(self.vocabulary)

    def embed_documents(self, texts: list[str]) -> np.ndarray:
        rows = np.array([[t.count(w) for w in self.vocabulary] for t in texts], np.float32).reshape(len(texts), len(self.vocabulary))
        rows[~rows.any(1)] = 1e-6
        return rows

    def embed_query(self, text: str) -> np.ndarray:
        return self.embed_documents([text])[0]


class HashedWords:
    """Words, lower-cased, by hash into ``width`` signed slots."""

    batch = OWN_BATCH

    def __init__(self, width: int = 256):
        self.width, self.name = width, f"hash:{width}"

    def embed_documents(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width), np.float32)
        for row, text in zip(out, texts, strict=True):
            for w in text.lower().split():
                h = zlib.crc32(w.encode())
                row[h % self.width] += 1 if h >> 31 else -1
        return out

    def embed_query(self, text: str) -> np.ndarray:
        return self.embed_documents([text])[0]


class HttpEmbedder:
    """Vectors from a server that takes {"model", "input": [texts]} and gives {"embeddings": [vectors]}, ``BATCH`` texts a request."""

    def __init__(self, model: str, host: str = "http://localhost:11434", timeout: float = 120.0):
        self.model, self.host, self.timeout, self.name = model, host.rstrip("/"), timeout, f"http:{model}"

    def embed_documents(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros((0, 0), np.float32)
        out = []
        for s in range(0, len(texts), BATCH):
            body = json.dumps({"model": self.model, "input": texts[s : s + BATCH]}).encode()
            with urlopen(Request(f"{self.host}/api/embed", body, {"Content-Type": "application/json"}), timeout=self.timeout) as r:
                out += json.load(r)["embeddings"]
        return np.array(out, np.float32)

    def embed_query(self, text: str) -> np.ndarray:
        return self.embed_documents([text])[0]


def embedder_of(name: str, host: str | None = None) -> Embedder:
    """The embedder of a name as indexes keep it: ``counts:a,b``, ``hash:256``, or a server's model with or without ``http:``."""
    kind, _, rest = name.partition(":")
    if kind == "counts":
        return WordCounts(rest.split(","))
    if kind == "hash":
        return HashedWords(int(rest))
    return HttpEmbedder(rest if kind == "http" else name, *([host] if host else []))


def embedded(rows: DataFrame, embedder: Embedder, text: str = "text") -> DataFrame:
    """rows with emb: unit vectors of a text column, the embedder's ``batch`` of texts at a time (``BATCH``, if it names none), where the rows are. A worker loads the embedder once; null is the empty text, and a plan that doesn't use emb asks for none."""

    def load():
        def predict(texts: np.ndarray) -> np.ndarray:
            m = np.asarray(embedder.embed_documents([str(x) for x in texts.ravel()]), float)
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            return (m / np.where(norm > 0, norm, 1)).astype(np.float32)

        return predict

    vectors = predict_batch_udf(load, return_type=ArrayType(FloatType()), batch_size=getattr(embedder, "batch", BATCH))
    return rows.withColumn("emb", vectors(F.coalesce(text, F.lit(""))))


def chunks_of(pages: DataFrame, size: int = 180, overlap: int = 30) -> DataFrame:
    """id, page, title, page_start, page_end, chunk_index, text of pages(slug, title, page_start, page_end, text): word windows, by page and place."""
    cut = pages.select(F.col("slug").alias("page"), "title", "page_start", "page_end", F.posexplode(windows(F.col("text"), size, overlap)).alias("chunk_index", "text"))
    return cut.select(F.concat(F.col("page"), F.lit("#"), F.col("chunk_index").cast("string")).alias("id"), "page", "title", "page_start", "page_end", "chunk_index", "text")


class Index:
    """Chunks with unit vectors, and the embedder that made them."""

    def __init__(self, chunks: DataFrame, embedder: Embedder):
        self.chunks, self.embedder = chunks, embedder

    @classmethod
    def build(cls, pages: DataFrame, embedder: Embedder, size: int = 180, overlap: int = 30) -> Index:
        chunks = chunks_of(pages, size, overlap)
        if not chunks.take(1):
            raise ValueError("the pages hold no text to index")
        return cls(embedded(chunks, embedder), embedder)

    def save(self, path: str) -> Index:
        """Writes the index, and gives it as read back: vectors are made once."""
        spark = self.chunks.sparkSession
        self.chunks.write.mode("overwrite").parquet(f"{path}/chunks")
        spark.createDataFrame([(self.embedder.name,)], "embedder string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")
        return self.load(spark, path, self.embedder)

    @classmethod
    def load(cls, spark: SparkSession, path: str, embedder: Embedder | None = None) -> Index:
        if embedder is None:
            embedder = embedder_of(spark.read.schema("embedder string").json(f"{path}/meta").first()[0])
        return cls(spark.read.parquet(f"{path}/chunks"), embedder)

    def questions(self, rows: DataFrame) -> DataFrame:
        """rows(qid, question) with emb."""
        return embedded(rows, self.embedder, "question")

    def search(self, query: str, k: int = 5) -> DataFrame:
        """score, page, title, page_start, page_end, id, text of the k best chunks, best first."""
        found = vector.search(self.chunks, np.asarray(self.embedder.embed_query(query), float).tolist(), max(1, k))
        return found.select("score", "page", "title", "page_start", "page_end", "id", "text")

    def best_chunk_per_page(self, query: str, pages: list) -> DataFrame:
        """page, id, score, best first; no rows without pages."""
        spark = self.chunks.sparkSession
        some = spark.createDataFrame([(p,) for p in pages], f"page {dict(self.chunks.dtypes)['page']}")
        return vector.best_chunk_per_page(self.chunks, np.asarray(self.embedder.embed_query(query), float).tolist(), some)

    def retrieved(self, found: DataFrame) -> DataFrame:
        """found(qid, id, ...) with title, page_start, page_end, text."""
        return found.join(self.chunks.select("id", "title", "page_start", "page_end", "text"), "id")
