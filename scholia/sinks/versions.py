"""Tables that are changed by appending: deltas beside a base, manifests that say what a version holds, merging on read, compaction.

A store has some tables. A commit writes, for each table it changes, its new rows and the keys whose earlier rows they replace; nothing that was written before is touched. Then a manifest
of the next number is put in place, whole and only if no other writer was first; a version is what its manifest lists. Readers of an older version go on reading it.
A row is hidden if a later commit replaces its key. What a table's keys are is part of the store: columns, each with the condition on rows that it hides.

How it scales. A commit costs what it writes. A read joins rows with the last commit of each replaced key: a table of keys since the last compaction, small beside the base, and a plain
equi-join whatever its size. ``compact`` writes a table's rows as one base; it should follow every few dozen commits, since their names are part of a read's plan. ``vacuum`` deletes what no kept version lists.
Base rows are sorted within files by their first key and have Bloom filters on all of them, so that a look-up by either end of an edge opens few row groups.

Cases. Null keys are never replaced. Empty deltas and empty bases are tables without rows. Keys replaced without new rows are deletions. A writer that comes second takes the next number: of two commits that replace one key the later one holds.
Files of a commit whose writer was lost before its manifest are in no version.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Change = tuple[DataFrame, DataFrame | None]  # new rows; replaced keys, as the first column of a table


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # Files

    def _read(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.path}/{name}"))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put_if_absent(self, name: str, text: str) -> bool:
        """Writes a file whole under a name of its own, then gives it its name; False if that is taken."""
        at, mine = self._path(f"{self.path}/{name}"), self._path(f"{self.path}/.{uuid.uuid4().hex}")
        self._fs.mkdirs(at.getParent())
        out = self._fs.create(mine, False)
        out.write(bytearray(text.encode()))
        out.close()
        sc = self.spark.sparkContext
        jvm = sc._jvm
        none = sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), sc._jsc.hadoopConfiguration())
        try:
            context.rename(mine, at, none)  # fails if the name is taken
        except Exception:  # noqa: BLE001  a JVM error of many kinds: only whether the name is taken counts
            self._fs.delete(mine, False)
            if self._fs.exists(at):
                return False
            raise
        return True

    def versions(self) -> list[int]:
        at = self._path(f"{self.path}/manifests")
        names = [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n[:12]) for n in names if re.fullmatch(r"\d{12}\.json", n))

    def manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known:
            raise FileNotFoundError(f"no store at {self.path}")
        return json.loads(self._read(f"manifests/{known[-1] if version is None else version:012d}.json"))

    # Writing

    @classmethod
    def create(cls, spark: SparkSession, path: str, tables: dict[str, tuple[DataFrame, dict[str, str]]]) -> Store:
        """A store of tables: each a DataFrame and its keys, {column: SQL condition on the rows that a replaced key hides}."""
        store = cls(spark, path)
        about = {name: {"schema": df.schema.json(), "keys": keys, "commits": [store._write(name, df, None, keys)]} for name, (df, keys) in tables.items()}
        if not store._put_if_absent(f"manifests/{0:012d}.json", json.dumps({"version": 0, "tables": about})):
            raise FileExistsError(f"there is a store at {path}")
        return store

    def _write(self, table: str, rows: DataFrame, replaced: DataFrame | None, keys: dict[str, str]) -> dict:
        name = uuid.uuid4().hex
        writer = rows.sortWithinPartitions(next(iter(keys))).withColumn("_commit", F.lit(name)).write
        for k in keys:
            writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true")
        writer.parquet(f"{self.path}/{table}/rows-{name}")
        if replaced is not None:
            key = replaced.columns[0]
            replaced.select(F.col(key).alias("key")).filter("key is not null").distinct().withColumn("_commit", F.lit(name)).write.parquet(f"{self.path}/{table}/keys-{name}")
        return {"name": name, "keys": replaced is not None}

    def commit(self, changes: dict[str, Change], tries: int = 20) -> int:
        """Appends to some tables, all in one version; gives its number."""
        now = self.manifest()
        written = {t: self._write(t, rows, replaced, now["tables"][t]["keys"]) for t, (rows, replaced) in changes.items()}
        for _ in range(tries):
            for t, commit in written.items():
                now["tables"][t]["commits"].append(commit)
            now["version"] += 1
            if self._put_if_absent(f"manifests/{now['version']:012d}.json", json.dumps(now)):
                return now["version"]
            now = self.manifest()
        raise RuntimeError(f"{tries} other writers were first")

    def compact(self, tries: int = 5) -> int:
        """A version with the same rows as the last one, each table as one base."""
        for _ in range(tries):
            now = self.manifest()
            for t, about in now["tables"].items():
                if len(about["commits"]) > 1:
                    about["commits"] = [self._write(t, self.read(t, now["version"]), None, about["keys"])]
            now["version"] += 1
            if self._put_if_absent(f"manifests/{now['version']:012d}.json", json.dumps(now)):
                return now["version"]
        raise RuntimeError("other writers were first each time")

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes manifests but the last ``keep``, and folders of rows and keys that these don't list; gives the folders. No writer may be at work."""
        known = self.versions()
        kept = [self.manifest(v) for v in known[-keep:]]
        listed = {(t, c["name"]) for m in kept for t, about in m["tables"].items() for c in about["commits"]}
        gone = []
        for t in kept[-1]["tables"]:
            for f in self._fs.listStatus(self._path(f"{self.path}/{t}")):
                name = f.getPath().getName()
                if (t, name.partition("-")[2]) not in listed:
                    self._fs.delete(f.getPath(), True)
                    gone.append(f"{t}/{name}")
        for v in known[:-keep]:
            self._fs.delete(self._path(f"{self.path}/manifests/{v:012d}.json"), False)
        return sorted(gone)

    # Reading

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table's rows as of a version (the last one, if none is named)."""
        about = self.manifest(version)["tables"][table]
        from pyspark.sql.types import StringType, StructField, StructType

        schema = StructType.fromJson(json.loads(about["schema"]))
        mark = StructField("_commit", StringType())
        names = [c["name"] for c in about["commits"]]
        rows = self.spark.read.schema(StructType([*schema.fields, mark])).parquet(*[f"{self.path}/{table}/rows-{n}" for n in names])
        replacing = [c["name"] for c in about["commits"] if c["keys"]]
        if replacing:
            place = F.create_map(*[x for n, name in enumerate(names) for x in (F.lit(name), F.lit(n))])
            order: Column = F.element_at(place, F.col("_commit"))
            rows = rows.withColumn("_n", order)
            kind = next(f.dataType for f in schema.fields if f.name == next(iter(about["keys"])))
            keys = self.spark.read.schema(StructType([StructField("key", kind), mark])).parquet(*[f"{self.path}/{table}/keys-{n}" for n in replacing])
            last = keys.groupBy("key").agg(F.max(order).alias("_last"))
            for k, condition in about["keys"].items():
                hiding = last.select(F.col("key").alias("_key"), "_last")
                rows = rows.join(hiding, F.col(k) == F.col("_key"), "left").filter(f"NOT coalesce(_last > _n AND ({condition}), false)").drop("_key", "_last")
        return rows.select(*[F.col(f"`{f.name}`") for f in schema.fields])

    def size_of(self, version: int | None = None) -> dict[str, int]:
        """Bytes of each table's last commit: what it cost to write."""
        out = {}
        for t, about in self.manifest(version)["tables"].items():
            name = about["commits"][-1]["name"]
            both = [self._path(f"{self.path}/{t}/{kind}-{name}") for kind in ("rows", "keys")]
            out[t] = sum(self._fs.getContentSummary(p).getLength() for p in both if self._fs.exists(p))
        return out
