"""What the training-data operators share: the shared folder, numpy views of Arrow text, span sets."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only where that setting is unset and the session runs in this process (tests) a folder of this machine is set instead.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_scholia_dir", None)
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="scholia-")
        sc.setCheckpointDir(found)
        sc._scholia_dir = found
    return found


def table_path(spark: SparkSession, tag: str) -> str:
    return os.path.join(shared_dir(spark), "scholia", f"{tag}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and it survives lost executors."""
    spark = df.sparkSession
    path = table_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def save_file(path: str, data: bytes) -> None:
    """Writes a file of a shared folder whole: under a name of its own first, so that attempts at the same file don't meet."""
    fs, at = file_system(path)
    fs.create_dir(os.path.dirname(at), recursive=True)
    mine = f"{os.path.dirname(at)}/.{os.path.basename(at)}.{uuid.uuid4().hex}"
    with fs.open_output_stream(mine, compression=None) as out:
        out.write(data)
    fs.move(mine, at)


def load_file(path: str) -> bytes:
    fs, at = file_system(path)
    with fs.open_input_stream(at, compression=None) as f:
        return f.read()


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize has written and nothing will read again."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        for path in {os.path.dirname(f) for f in df.inputFiles()}:
            if "/scholia/" in path:
                at = sc._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def quoted_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def quoted(name: str) -> Column:
    return F.col(quoted_name(name))


def unused(df: DataFrame, name: str) -> str:
    """name, with as many underscores in front as it takes to differ from all columns of df."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def packed(df: DataFrame, *apart: str) -> Column:
    """All columns of df but ``apart`` as one struct, so that an operator's own names can't clash with them; ``unpacked`` gives their columns back."""
    return F.struct(*[quoted(c).alias(c) for c in df.columns if c not in apart], F.lit(0).alias(unused(df, "nothing")))


def unpacked(df: DataFrame, struct: str, **own) -> list[Column]:
    """Columns of df in its order out of the struct that ``packed`` made, or from ``own`` (by name)."""
    return [own[c].alias(c) if c in own else F.col(f"{struct}.{quoted_name(c)}").alias(c) for c in df.columns]


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def nullable(kind: pa.DataType) -> pa.DataType:
    """The type with every field of its structs nullable, as Spark declares what comes back from Python."""
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, nullable(f.type)) for f in kind])
    if pa.types.is_list(kind):
        return pa.list_(pa.field(kind.value_field.name, nullable(kind.value_type)))
    if pa.types.is_map(kind):
        return pa.map_(kind.key_type, nullable(kind.item_type))
    return kind


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_kept: dict[tuple[str, str], object] = {}


def kept(kind: str, path: str, make):
    """make(path), kept for this worker's next tasks. A worker keeps one such object at most."""
    if (kind, path) not in _kept:
        _kept.clear()
        _kept[kind, path] = make(path)
    return _kept[kind, path]


def release() -> None:
    """Gives freed memory back to the system: workers outlive their tasks, beside tasks of other operators."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def lean(batches):
    """The batches of a task that needs no kept object; its memory is given back when it ends."""
    _kept.clear()
    try:
        yield from batches
    finally:
        release()


def lean_call(f, *args):
    """f(*args) of one group, with memory given back after it."""
    _kept.clear()
    try:
        return f(*args)
    finally:
        release()


def utf8(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string column, and n + 1 offsets into them; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if len(col) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int):
    """Runs (i, j) of rows of about ``most`` bytes; a longer row is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters neighbours."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each (start, length), one after the other."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)


def merge_spans(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of half-open spans by owner: sorted, maximal, without touching neighbours."""
    keep = end > start
    owner, start, end = owner[keep], start[keep], end[keep]
    if not len(owner):
        return owner, start, end
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    first = np.r_[True, owner[1:] != owner[:-1]]
    group = np.cumsum(first) - 1
    wide = int(end.max()) + 2
    top = np.maximum.accumulate(end + group * wide)
    new = np.r_[True, (start + group * wide)[1:] > top[:-1]] | first
    at = np.flatnonzero(new)
    last = np.r_[at[1:], len(owner)] - 1
    return owner[at], start[at], (top - group * wide)[last]


def words(buf: np.ndarray, offsets: np.ndarray, gaps: bytes = b" \t\n\v\f\r", lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and 64-bit hash of each word (run of bytes that aren't gaps; ASCII lower-cased first), and each text's word offsets."""
    n = len(buf)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    space = np.zeros(256, bool)
    space[list(gaps)] = True
    inside = ~space[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    starts = np.flatnonzero(begins)
    counts = np.searchsorted(starts, offsets)
    if not len(starts):
        return none, none, np.zeros(0, U64), counts
    at = np.flatnonzero(inside)
    first = np.flatnonzero(begins[at])
    length = np.diff(np.r_[first, len(at)])
    place = np.arange(len(at)) - np.repeat(first, length)
    powers = np.ones(int(length.max()) + 1, U64)
    powers[1:] = U64(0x9E3779B97F4A7C15)
    powers = np.multiply.accumulate(powers)
    table = _TABLE[_LOWER] if lower else _TABLE
    sums = np.add.reduceat(table[buf[at]] * powers[place], first)
    return starts, length, mix(sums ^ length.astype(U64) * U64(0xD6E8FEB86659FD93)), counts


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE = mix(np.arange(1, 257, dtype=U64) * U64(0x2545F4914F6CDD1D)) | U64(1)
