"""Tables in the folder that the driver and all executors share: where loops cut their lineage."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of this machine only where that is unset and the session runs in this process (tests)."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_scholia_dir", None)
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = sc._scholia_dir = "file://" + tempfile.mkdtemp(prefix="scholia-")
    return found


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, written to the shared folder and read back."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def version_of(df: DataFrame) -> str:
    """What tells versions of a table's files apart: their names, lengths and times, hashed."""
    sc = df.sparkSession.sparkContext
    found = []
    for name in sorted(df.inputFiles()):
        at = sc._jvm.org.apache.hadoop.fs.Path(name)
        status = at.getFileSystem(sc._jsc.hadoopConfiguration()).getFileStatus(at)
        found.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(found).encode()).hexdigest()


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/scholia/{tag}-{uuid.uuid4().hex}"


def stream_rows(path: str, rows: int, columns: list[str] | None = None) -> Iterator[pa.RecordBatch]:
    """In a task: the rows of a table in the shared folder, some at a time, whatever its size, in order of its files."""
    fs, top = file_system(path)
    for f in sorted(fs.get_file_info(pafs.FileSelector(top)), key=lambda f: f.path):
        if f.base_name.endswith(".parquet") and f.base_name[0] not in "._":
            with fs.open_input_file(f.path) as opened:
                yield from pq.ParquetFile(opened).iter_batches(rows, columns=columns)


def read_files(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """name, content of files below root. Spark's own listing leaves out names that begin with . or _, so the names are given."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, top = file_system(root)
        for f in frames:
            out = []
            for name in f["name"]:
                with fs.open_input_stream(f"{top}/{name}", compression=None) as x:
                    out.append(x.read())
            yield pd.DataFrame({"name": f["name"], "content": out})

    listed = spark.createDataFrame([(n,) for n in names], "name string").repartition(max(1, min(len(names), 4 * spark.sparkContext.defaultParallelism)))
    return listed.mapInPandas(run, "name string, content binary")
