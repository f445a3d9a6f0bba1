"""WARC archives and their two-level capture index (operator 8).

Writing: a record a page, grouped into archive files; each record is a gzip member of its own, so it can be read by its range. Of pages
with equal payloads of at least ``revisit_from`` bytes the one with the smallest id is a response and the others are revisits that
refer to it; a revisit has no payload but the headers that name its digest and the record it refers to.

Index: captures sorted by URL key (host reversed: http://a.example.com/x -> com,example,a)/x) in compressed blocks of ``block_rows`` lines, in at most
``MOST_PARTS`` files; each file has a sparse directory beside it, with the first key and the range of each block. A lookup bisects the files by their first keys,
then the file's directory, reads the blocks that can hold the key by range, bisects their lines, and reads the records by range. ``lookup`` and the
query both do this for a table of URLs: the distinct keys are sorted, so a task reads each directory once.

How it scales. One shuffle of payloads (to join each page with its group's first id, pre-aggregated by digest), archives written and read where the rows are, by
pyarrow's file systems, in the shared folder. A file is named by its task's attempt, and captures carry that name, so what another attempt at the task writes is never read.
The index is range-partitioned by key, then file and place, so a popular URL's captures spread over files; what lookups pass on is a row for each block, and the driver gets a
row for each index file. Large groups of copies are revisits without payload, so they cost a header each.

Cases. Null html: empty payload. Null or odd url: written as it is ("" for null), key "-" with it. Repeated page_ids: each row is a record; equal payloads of one id are
responses all. Null page_id: a response record without an id. Empty table: an index without blocks. Other columns are ignored. Very long payloads: one record is held whole by one task.
"""

from __future__ import annotations

import gzip
import hashlib
import json
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, file_system, load_file, materialize, save_file, table_path

CRLF = b"\r\n"
_NAME = "urn:scholia:page:"


def url_key(url: str | None) -> str:
    """Reversed host, then path and query, in lower case for the host: sorts pages of a site, and sites of a domain, together."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return "-)" + (url or "")
    if not host:
        return "-)" + (url or "")
    return ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def _line(value: str | None) -> str:
    return (value or "").replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    digest = hashlib.sha256(payload).hexdigest()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_NAME}{'' if page_id is None else page_id}>", f"WARC-Target-URI: {_line(url)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}"]
    http = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), b"", b""]
    body = CRLF.join(http)
    if refers_to is None:
        body += payload
        head.append("Content-Type: application/http; msgtype=response")
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_NAME}{refers_to}>", "Content-Type: application/http; msgtype=response"]
    head.append(f"Content-Length: {len(body)}")
    return gzip.compress("\r\n".join(head).encode() + CRLF * 2 + body + CRLF * 2, 3, mtime=0)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record; a revisit's payload is empty. Raises ValueError where lengths don't match."""
    data = gzip.decompress(raw)
    head, _, rest = data.partition(CRLF * 2)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = rest[: int(headers["Content-Length"])]
    if rest[len(body) :] != CRLF * 2:
        raise ValueError("a WARC record of wrong length")
    return headers, body.partition(CRLF * 2)[2]


def _number(header: str | None) -> int | None:
    text = (header or "").strip("<>").removeprefix(_NAME)
    return int(text) if text else None


_CAPTURE = (("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("at", pa.int64()), ("size", pa.int64()))
CAPTURES = "key string, page_id long, file string, at long, size long"
#: Index files at most: the list of their first keys is read by every lookup task.
MOST_PARTS = 4096


def _batch(rows: list, kinds) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(cols, kinds, strict=True)], [n for n, _ in kinds])


def _write(batches, folder: str, most: int):
    """Writes archive files of about ``most`` bytes; gives the capture of each record."""
    fs, path = file_system(folder)
    task = TaskContext.get()
    fs.create_dir(path, recursive=True)
    n, out, name, at = 0, None, None, 0
    info = gzip.compress(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:scholia:info>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Length: 0\r\n\r\n\r\n\r\n", 3, mtime=0)
    for batch in batches:
        rows = []
        for page_id, url, html, refers in zip(*(batch.column(k) for k in ("page_id", "url", "html", "refers")), strict=True):
            if out is None:
                name, at = f"part-{task.partitionId():05d}-{n:04d}-{task.taskAttemptId()}.warc.gz", len(info)
                out = fs.open_output_stream(f"{path}/{name}", compression=None)
                out.write(info)
                n += 1
            data = record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass"), refers.as_py())
            out.write(data)
            rows.append((url_key(url.as_py()), page_id.as_py(), name, at, len(data)))
            at += len(data)
            if at >= most:
                out.close()
                out = None
        yield _batch(rows, _CAPTURE)
    if out is not None:
        out.close()


def _index(batches, folder: str, block_rows: int):
    """Writes one index file of sorted captures in compressed blocks, and its directory (first and last key, place, size of each block); gives the file's first and last key and name."""
    fs, path = file_system(folder)
    task = TaskContext.get()
    name = f"index-{task.partitionId():05d}-{task.taskAttemptId()}"
    at, out, lines, directory = 0, None, [], []

    def flush():
        nonlocal at, lines, out
        if out is None:
            fs.create_dir(path, recursive=True)
            out = fs.open_output_stream(f"{path}/{name}.gz", compression=None)
        data = _pack(lines)
        out.write(data)
        directory.append((lines[0][0], lines[-1][0], at, len(data)))
        at += len(data)
        lines = []

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            lines.append(row)
            if len(lines) == block_rows:
                flush()
    if lines:
        flush()
    if out is not None:
        out.close()
        save_file(f"{folder}/{name}.directory.gz", _pack(directory))
        yield _batch([(directory[0][0], directory[-1][1], name)], (("first", pa.string()), ("last", pa.string()), ("file", pa.string())))


def _pack(lines: list) -> bytes:
    return gzip.compress("".join(json.dumps(x, separators=(",", ":")) + "\n" for x in lines).encode(), 6, mtime=0)


def _unpack(data: bytes) -> list[list]:
    return [json.loads(x) for x in gzip.decompress(data).decode().split("\n")[:-1]]


def _spans(lasts: list[str], firsts: list[str], key: str) -> range:
    """Which of sorted, touching ranges can hold the key."""
    return range(bisect_left(lasts, key), bisect_right(firsts, key))


def _resolve(batches, folder: str, parts: list[tuple[str, str, str]], keep: int = 4):
    """Blocks that can hold sorted keys: bisection of the index files, then of a file's directory. One row a key and block."""
    firsts, lasts = [p[0] for p in parts], [p[1] for p in parts]
    cache: OrderedDict = OrderedDict()

    def directory(name: str):
        if name not in cache:
            rows = _unpack(load_file(f"{folder}/{name}.directory.gz"))
            cache[name] = ([r[0] for r in rows], [r[1] for r in rows], rows)
            while len(cache) > keep:
                cache.popitem(last=False)
        return cache[name]

    for batch in batches:
        rows = []
        for key in batch.column("key").to_pylist():
            for p in _spans(lasts, firsts, key):
                first, last, blocks = directory(parts[p][2])
                rows += [(key, parts[p][2], blocks[i][2], blocks[i][3]) for i in _spans(last, first, key)]
        yield _batch(rows, (("key", pa.string()), ("file", pa.string()), ("at", pa.int64()), ("size", pa.int64())))


def _captures(batches, folder: str):
    """The captures of the wanted keys in each block, by one range read of it and bisection of its lines."""
    fs, path = file_system(folder)
    f, open_name = None, None
    for batch in batches:
        for name, at, size, keys in zip(*(batch.column(k).to_pylist() for k in ("file", "at", "size", "keys")), strict=True):
            if name != open_name:
                if f is not None:
                    f.close()
                f, open_name = fs.open_input_file(f"{path}/{name}.gz"), name
            f.seek(at)
            lines = _unpack(f.read(size))
            names = [x[0] for x in lines]
            yield _batch([tuple(x) for k in keys for x in lines[bisect_left(names, k) : bisect_right(names, k)]], _CAPTURE)
    if f is not None:
        f.close()


class Archive:
    """A folder of archives with its index; ``parts``: first and last key and name of each index file, by first key."""

    def __init__(self, spark: SparkSession, folder: str, parts: list[tuple[str, str, str]]):
        self.spark, self.folder, self.parts = spark, folder, sorted(parts)

    def captures(self, keys: DataFrame) -> DataFrame:
        """The captures (key, page_id, file, at, size) of keys(key), each key's once, through the two levels of the index."""
        folder, parts = f"{self.folder}/index", self.parts
        # a key is looked up once; what goes on is a row a block, with those of its keys that are asked for
        ordered = keys.filter("key is not null").distinct().repartitionByRange("key").sortWithinPartitions("key")
        found = ordered.mapInArrow(lambda it: _resolve(it, folder, parts), "key string, file string, at long, size long")
        blocks = found.groupBy("file", "at", "size").agg(F.array_sort(F.collect_list("key")).alias("keys"))
        return blocks.sortWithinPartitions("file", "at").mapInArrow(lambda it: _captures(it, folder), CAPTURES)

    def records(self, captures: DataFrame) -> DataFrame:
        """page_id, url, record_type, refers_to, digest (as the header says), payload of captures(file, at, size), by range reads."""
        folder = self.folder
        kinds = (("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("payload", pa.binary()))

        def read(batches):
            fs, path = file_system(f"{folder}/warc")
            f, open_name = None, None
            for batch in batches:
                rows = []
                for name, at, size in zip(*(batch.column(k).to_pylist() for k in ("file", "at", "size")), strict=True):
                    if name != open_name:
                        if f is not None:
                            f.close()
                        f, open_name = fs.open_input_file(f"{path}/{name}"), name
                    f.seek(at)
                    headers, payload = parse(f.read(size))
                    rows.append((_number(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], headers["WARC-Type"], _number(headers.get("WARC-Refers-To")), headers["WARC-Payload-Digest"].removeprefix("sha256:"), payload))
                yield _batch(rows, kinds)
            if f is not None:
                f.close()

        # spread by file and place, so a task reads a stretch of an archive in order
        spread = captures.select("file", "at", "size").withColumn("_stretch", (F.col("at") / (4 << 20)).cast("int"))
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 1)
        return spread.repartition(parts, "file", "_stretch").sortWithinPartitions("file", "at").mapInArrow(read, "page_id long, url string, record_type string, refers_to long, digest string, payload binary")

    def find(self, urls: DataFrame) -> DataFrame:
        """The records of urls(url); rows of one key are asked for once."""
        key = F.udf(url_key, "string", useArrow=True)
        return self.records(self.captures(urls.select(F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url")).distinct().select(key("url").alias("key"))))

    def lookup(self, urls: list[str]) -> DataFrame:
        """The records of a few URLs."""
        return self.find(self.spark.createDataFrame([(u,) for u in urls], "url string"))


def write(pages: DataFrame, folder: str, revisit_from: int = 100, archive_bytes: int = 64 << 20, block_rows: int = 512) -> Archive:
    """Writes pages(page_id, url, html) as archives and index under folder."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n"))
    firsts = rows.filter(F.col("n") >= revisit_from).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1").select("digest", "first")
    rows = rows.join(firsts, "digest", "left").withColumn("refers", F.when(F.col("first") < F.col("page_id"), F.col("first")))
    captures = rows.select("page_id", "url", "html", "refers").mapInArrow(lambda it: _write(it, f"{folder}/warc", archive_bytes), CAPTURES)
    captures = materialize(captures, "captures")
    parts = min(MOST_PARTS, max(1, -(-captures.count() // (block_rows * 64))))
    order = captures.repartitionByRange(parts, "key", "file", "at").sortWithinPartitions("key", "file", "at")
    files = order.mapInArrow(lambda it: _index(it, f"{folder}/index", block_rows), "first string, last string, file string")
    archive = Archive(spark, folder, [tuple(r) for r in files.collect()])  # at most MOST_PARTS rows
    discard(captures)
    return archive


def round_trip(pages: DataFrame, **kw) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page, as read back from archives: every page's URL is looked up in the index."""
    spark = pages.sparkSession
    archive = write(pages, table_path(spark, "archive"), **kw)
    read = archive.find(pages.select("url")).withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("own", F.sha2("payload", 256)).drop("payload")
    read = materialize(read, "records")
    full = read.filter("record_type = 'response'").groupBy("page_id", "own").agg(F.min("bytes").alias("full_bytes")).toDF("refers_to", "digest", "full_bytes")
    back = read.join(full, ["refers_to", "digest"], "left")
    is_response = F.col("record_type") == "response"
    return back.select(
        "page_id", F.when(is_response, F.col("bytes")).otherwise(F.col("full_bytes")).alias("payload_bytes"), F.when(is_response, F.col("own")).otherwise(F.col("digest")).alias("payload_digest"), "record_type", "refers_to",
    )
