"""A stored approximate vector index: a layered navigable neighbour graph for each shard, with inserts, updates and deletions.

Vectors fall into shards by hash of their id. A shard's graph has layers: all rows on the lowest, about a sixteenth of each layer's on the next. A row links to near rows that lie in
different directions. A search begins at the top, and on each layer goes on from the best rows found; it keeps the ``ef`` best, and is done when each of these has been looked around from.
Building is inserting, in batches: a batch searches the graph so far, links to what it finds and to its own rows, and is linked back. Searches go in lockstep for many questions, as matrix products.

How it scales. A shard has about ``rows`` rows and is one row of the index table, some megabytes. The index is a store of versions (``sinks.versions``): inserts read and write the shards of the new rows' hashes only.
Questions are written once to the shared folder; a task reads them in blocks past each of its shards, so neither side is shuffled or sent through the driver. Each shard answers with k rows a question;
Spark keeps k of them before and after the shuffle. ``exact=True`` compares all rows of each shard instead.

Cases. Null vectors and those that are zero or not finite take no part. Repeated ids: the last insert holds; within one insert, the greatest vector. Ties: smaller id first. Fewer rows than k: all of them. Empty index, no questions: no rows.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.tables import new_path, stream_rows, written
from ..sinks.versions import Store


class Layers:
    """One shard's graph over rows 0, 1, ...; links are row numbers, -1 where there is none."""

    def __init__(self, dim: int, links: int = 12, ef: int = 64):
        self.most, self.ef = links, ef
        self.vectors = np.zeros((0, dim), np.float32)
        self.level = np.zeros(0, np.int8)
        self.links: list[np.ndarray] = [np.zeros((0, 2 * links), np.int32)]

    # Search

    def _beam(self, questions: np.ndarray, layer: int, entries: np.ndarray, ef: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The ef best rows found on a layer, best first (-1 where there are fewer), and their products."""
        m, n = len(questions), len(self.vectors)
        seen = np.zeros((m, n + 1), bool)
        seen[:, n] = True  # -1 ends up there
        rows = np.full((m, ef), -1, np.int64)
        score = np.full((m, ef), -np.inf, np.float32)
        done = np.ones((m, ef), bool)
        fresh, who = entries, np.arange(m)
        while True:
            fresh = np.sort(np.where(fresh < 0, n, fresh), axis=1)
            new = ~seen[who[:, None], fresh]
            new[:, 1:] &= fresh[:, 1:] != fresh[:, :-1]
            seen[who[:, None], fresh] = True
            at, col = np.nonzero(new)
            some = np.full(fresh.shape, -np.inf, np.float32)
            some[at, col] = np.einsum("ij,ij->i", questions[who[at]], self.vectors[fresh[at, col]])
            both = np.concatenate([score[who], some], 1)
            keep = np.argpartition(-both, ef - 1, axis=1)[:, :ef]
            line = np.arange(len(who))[:, None]
            score[who] = both[line, keep]
            rows[who] = np.concatenate([rows[who], fresh], 1)[line, keep]
            done[who] = np.concatenate([done[who], ~new], 1)[line, keep]
            open_ = np.where(done[who], -np.inf, score[who])
            width = min(wide, ef)
            best = np.argpartition(-open_, width - 1, axis=1)[:, :width]
            live = open_[line, best] > -np.inf
            go = live.any(1)
            who, best, live = who[go], best[go], live[go]
            if not len(who):
                break
            at = np.where(live, rows[who[:, None], best], -1)
            done[who[:, None], best] |= live
            near = self.links[layer][np.where(at < 0, 0, at)]
            near[at < 0] = -1
            fresh = near.reshape(len(who), -1).astype(np.int64)
        order = np.argsort(-score, axis=1, kind="stable")
        line = np.arange(m)[:, None]
        return np.where(score > -np.inf, rows, -1)[line, order], score[line, order]

    def search(self, questions: np.ndarray, ef: int, lowest: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Rows and products, best first, of unit vectors; down to layer ``lowest``."""
        top = max(int(self.level.max()), lowest)
        first = np.flatnonzero(self.level >= min(top, int(self.level.max())))[:64]
        found = np.broadcast_to(first, (len(questions), len(first)))
        for layer in range(min(top, int(self.level.max())), lowest, -1):
            found = self._beam(questions, layer, found, 8)[0]
        return self._beam(questions, lowest, found, ef)

    # Inserts

    def _diverse(self, rows: np.ndarray, score: np.ndarray, most: int, some: int = 512) -> np.ndarray:
        """Of candidates, best first, those that are nearer to the base than to any taken before; then the best of the others. ``some`` bases at a time, as their candidates' products with each other take the memory."""
        if len(rows) > some:
            return np.concatenate([self._diverse(rows[s : s + some], score[s : s + some], most) for s in range(0, len(rows), some)])
        there = score > -np.inf
        v = self.vectors[np.where(there, rows, 0)]
        between = np.einsum("bid,bjd->bij", v, v)
        taken, n = np.zeros(rows.shape, bool), np.zeros(len(rows), int)
        for j in range(rows.shape[1]):
            far = ~(taken[:, :j] & (between[:, j, :j] >= score[:, j, None])).any(1)
            taken[:, j] = far & there[:, j] & (n < most)
            n += taken[:, j]
        rank = np.argsort(np.where(taken, 0, 1) * rows.shape[1] + np.arange(rows.shape[1]), axis=1, kind="stable")[:, :most]
        line = np.arange(len(rows))[:, None]
        out = np.full((len(rows), most), -1, np.int32)
        out[:, : rank.shape[1]] = np.where(there[line, rank], rows[line, rank], -1)
        return out

    def _link(self, layer: int, new: np.ndarray, found: np.ndarray, score: np.ndarray) -> None:
        """Links new rows of a layer to what they found and to each other, and back."""
        most = self.links[layer].shape[1]
        own = self.vectors[new] @ self.vectors[new].T
        np.fill_diagonal(own, -np.inf)
        rows = np.concatenate([found, np.broadcast_to(new, own.shape)], 1)
        score = np.concatenate([np.where(found >= 0, score, -np.inf), own], 1)
        keep = np.argsort(-score, axis=1, kind="stable")[:, : max(self.ef, most)]
        line = np.arange(len(new))[:, None]
        self.links[layer][new] = self._diverse(rows[line, keep], score[line, keep], most)
        to, source = self.links[layer][new].ravel(), np.repeat(new, most)
        to, source = to[to >= 0].astype(np.int64), source[to >= 0]
        if not len(to):
            return
        near = np.einsum("ij,ij->i", self.vectors[to], self.vectors[source])
        order = np.lexsort((-near, to))
        to, source = to[order], source[order]
        at = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        place = np.arange(len(to)) - np.repeat(at, np.diff(np.r_[at, len(to)]))
        some = place < most
        back = np.full((len(at), most), -1, np.int64)
        back[(np.cumsum(np.r_[True, to[1:] != to[:-1]]) - 1)[some], place[some]] = source[some]
        base = to[at]
        both = np.concatenate([self.links[layer][base].astype(np.int64), back], 1)
        met = ((both[:, :, None] == both[:, None, :]) & np.tri(both.shape[1], k=-1, dtype=bool)).any(2)
        both = np.where(met, -1, both)
        score = np.where(both >= 0, np.einsum("bd,bjd->bj", self.vectors[base], self.vectors[np.maximum(both, 0)]), -np.inf)
        keep = np.argsort(-score, axis=1, kind="stable")
        line = np.arange(len(base))[:, None]
        self.links[layer][base] = self._diverse(both[line, keep], score[line, keep], most)

    def insert(self, vectors: np.ndarray, levels: np.ndarray, batch: int = 512) -> None:
        """Adds unit vectors as the next rows."""
        s = 0
        while s < len(vectors):
            n = len(self.vectors)
            e = min(len(vectors), s + max(64, min(batch, n)))
            some, level = vectors[s:e].astype(np.float32), levels[s:e]
            found = {}
            for layer in range(int(level.max()) + 1):
                mine = np.flatnonzero(level >= layer)
                if n and layer <= int(self.level.max()):
                    found[layer] = self.search(some[mine], self.ef, layer)
                else:
                    found[layer] = np.full((len(mine), 1), -1), np.full((len(mine), 1), -np.inf, np.float32)
            self.vectors, self.level = np.concatenate([self.vectors, some]), np.concatenate([self.level, level.astype(np.int8)])
            while len(self.links) <= int(level.max()):
                self.links.append(np.zeros((0, self.most), np.int32))
            for layer, links in enumerate(self.links):
                self.links[layer] = np.concatenate([links, np.full((len(self.vectors) - len(links), links.shape[1]), -1, np.int32)])
            for layer, (rows, score) in found.items():
                self._link(layer, n + np.flatnonzero(level >= layer), rows, score)
            s = e


def levels_of(ids: list, per_layer: int = 16) -> np.ndarray:
    """The highest layer of each id: by its hash, so that building again gives the same."""
    u = (np.array([zlib.crc32(repr(i).encode()) for i in ids], float) + 1) / (2**32 + 1)
    return np.minimum(-np.log(u) / np.log(per_layer), 8).astype(np.int8)


def _unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(float)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


class Shard:
    """Rows of a shard: ids, vectors as given, which of them are gone, and the graph over their directions."""

    def __init__(self, dim: int, links: int, ef: int, kind: str):
        self.ids: list = []
        self.vectors = np.zeros((0, dim), kind)
        self.gone = np.zeros(0, bool)
        self.graph = Layers(dim, links, ef)

    def change(self, ids: list, vectors: np.ndarray, deleted: set) -> Shard:
        """Adds rows and takes out those of the same ids, and deleted ones; built anew when half of the rows are gone."""
        out = set(ids) | deleted
        self.gone |= np.array([i in out for i in self.ids], bool)
        self.ids += ids
        self.vectors, self.gone = np.concatenate([self.vectors, vectors]), np.concatenate([self.gone, np.zeros(len(ids), bool)])
        if self.gone.mean() > 0.5:
            fresh = Shard(self.vectors.shape[1], self.graph.most, self.graph.ef, self.vectors.dtype.str)
            stay = np.flatnonzero(~self.gone)
            return fresh.change([self.ids[i] for i in stay], self.vectors[stay], set()) if len(stay) else fresh
        if ids:
            self.graph.insert(_unit(vectors), levels_of(ids))
        return self

    def dump(self) -> bytes:
        # directions follow from the vectors: they are not stored twice
        state = {k: v for k, v in self.graph.__dict__.items() if k != "vectors"}
        return zlib.compress(pickle.dumps((self.ids, self.vectors, self.gone, state), 5), 1)

    @classmethod
    def load(cls, data: bytes) -> Shard:
        shard = cls.__new__(cls)
        shard.ids, shard.vectors, shard.gone, state = pickle.loads(zlib.decompress(data))
        shard.graph = Layers.__new__(Layers)
        shard.graph.__dict__.update(state)
        shard.graph.vectors = _unit(shard.vectors).astype(np.float32) if len(shard.ids) else np.zeros(shard.vectors.shape, np.float32)
        return shard

    def nearest(self, questions: np.ndarray, k: int, ef: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(question, row, cosine) of the k nearest rows found, and all that equal the last; ef None: of all rows."""
        own = _unit(self.vectors)
        if ef is None or len(self.ids) <= ef:
            sims = np.round(questions @ own.T, 12)
            sims[:, self.gone] = -np.inf
            cut = np.partition(sims, -min(k, sims.shape[1]), axis=1)[:, -min(k, sims.shape[1])]
            at, row = np.nonzero((sims >= cut[:, None]) & (sims > -np.inf))
            return at, row, sims[at, row]
        rows, _ = self.graph.search(questions.astype(np.float32), max(ef, k))
        at, col = np.nonzero((rows >= 0) & ~self.gone[np.maximum(rows, 0)])
        row = rows[at, col]
        return at, row, np.round(np.einsum("ij,ij->i", questions[at], own[row]), 12)


def _shard_of(column: str, shards: int):
    return F.pmod(F.xxhash64(column), F.lit(shards)).cast("int")


def _usable(vectors: DataFrame) -> DataFrame:
    ok = F.expr("emb IS NOT NULL AND forall(emb, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(emb, x -> x <> 0)")
    return vectors.select("id", "emb").filter(ok)


class NeighbourIndex:
    """The stored index. ``shards`` and the graphs' settings are fixed when it is built."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.store = spark, path, Store(spark, path)

    @classmethod
    def build(cls, vectors: DataFrame, path: str, rows: int = 16_384, links: int = 12, ef: int = 64) -> NeighbourIndex:
        """From vectors(id, emb); ``rows`` a shard, about."""
        spark = vectors.sparkSession
        usable = _usable(vectors)
        n, dim = usable.agg(F.count(F.lit(1)), F.max(F.size("emb"))).first()
        settings = {"shards": max(1, -(-n // rows)), "links": links, "ef": ef, "dim": dim or 0, "id": dict(vectors.dtypes)["id"], "emb": dict(vectors.dtypes)["emb"]}
        about = spark.createDataFrame([tuple(settings.values())], "shards int, links int, ef int, dim int, id string, emb string")
        empty = spark.createDataFrame([], "shard int, data binary")
        Store.create(spark, path, {"shards": (empty, {"shard": "true"}), "settings": (about, {"id": "true"})})
        index = cls(spark, path)
        index.insert(vectors)
        return index

    def _settings(self) -> dict:
        return self.store.read("settings").first().asDict()

    def insert(self, vectors: DataFrame, deleted: DataFrame | None = None) -> int:
        """Adds vectors(id, emb), in place of rows of the same ids, and takes out deleted(id). Writes the shards that these fall into; gives the new version."""
        s = self._settings()
        new = _usable(vectors).groupBy("id").agg(F.max("emb").alias("emb"))
        rows = new.select(_shard_of("id", s["shards"]).alias("shard"), "id", "emb")
        if deleted is not None:
            gone = deleted.select("id").distinct().join(new.select("id"), "id", "left_anti")
            rows = rows.unionByName(gone.select(_shard_of("id", s["shards"]).alias("shard"), "id", F.lit(None).cast(s["emb"]).alias("emb")))
        rows = written(rows, "new-vectors")
        touched = rows.select("shard").distinct()
        before = self.store.read("shards").join(touched, "shard", "left_semi")
        kind = "<f4" if "float" in s["emb"] else "<f8"

        def change(add: pa.Table, have: pa.Table) -> pa.Table:
            shard = Shard.load(have.column("data")[0].as_py()) if have.num_rows else Shard(s["dim"], s["links"], s["ef"], kind)
            add = add.sort_by("id")
            emb, ids = add.column("emb"), add.column("id").to_pylist()
            here = [i for i in range(len(ids)) if emb[i].is_valid]
            some = np.array([emb[i].as_py() for i in here], kind).reshape(len(here), s["dim"])
            shard = shard.change([ids[i] for i in here], some, {ids[i] for i in range(len(ids)) if not emb[i].is_valid})
            return pa.table({"shard": pa.array([add.column("shard")[0].as_py()], pa.int32()), "data": pa.array([shard.dump()], pa.binary())})

        changed = rows.groupBy("shard").cogroup(before.groupBy("shard")).applyInArrow(change, "shard int, data binary")
        return self.store.commit({"shards": (changed, touched)})

    def search(self, questions: DataFrame, k: int = 5, ef: int = 96, exact: bool = False, version: int | None = None, block: int = 512) -> DataFrame:
        """qid, id, score (cosine), rank: the k rows nearest to each of questions(qid, emb)."""
        s = self._settings()
        q = _usable(questions.select(F.col("qid").alias("id"), F.transform("emb", lambda x: x.cast("double")).alias("emb"))).withColumnRenamed("id", "qid")
        folder = new_path(self.spark, "questions")
        q.write.parquet(folder)
        qid = questions.schema["qid"].dataType
        types = {"qid": to_arrow_type(qid), "id": to_arrow_type(self.store.read("settings").sparkSession.createDataFrame([], f"x {s['id']}").schema["x"].dataType)}
        beam = None if exact else ef

        def run(batches):
            for batch in batches:
                for data in batch.column("data"):
                    shard = Shard.load(data.as_py())
                    if not len(shard.ids):
                        continue
                    ids = np.array([*shard.ids, None], object)[:-1]
                    for some in stream_rows(folder, block):
                        asked = _unit(np.stack(some.column("emb").to_numpy(zero_copy_only=False)))
                        to, row, score = shard.nearest(asked, k, beam)
                        yield pa.record_batch([some.column("qid").take(pa.array(to)).cast(types["qid"]), pa.array(ids[row].tolist(), types["id"]), pa.array(score)], ["qid", "id", "score"])

        # a partition has few shards, however many there are: an Arrow batch holds all rows of its partition
        found = self.store.read("shards", version).repartition(s["shards"], "shard").select("data").mapInArrow(run, f"qid {qid.simpleString()}, id {s['id']}, score double")
        w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
