"""Named queries over what is stored and changed: the neighbour index, stores of versions, pages behind a stream, folders as sources. Each with its SQL, where SQL can say it."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tables import file_system, shared_folder, written
from ..operators.neighbours import NeighbourIndex
from ..sinks.versions import Store
from ..sources import formats, html
from ..streaming import pages as page_stream
from .catalog import _UNIT, chunk_rows, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def new_folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/scholia/{name}-{uuid.uuid4().hex}"


def neighbour_index(spark, sf_dir) -> NeighbourIndex:
    """Three quarters of the vectors built, the rest inserted; every seventh of these deleted and inserted again."""
    v = chunk_rows(spark, sf_dir).select("id", "emb")
    index = NeighbourIndex.build(v.filter("id % 4 <> 3"), new_folder(spark, "neighbours"))
    index.insert(v.filter("id % 4 = 3"))
    index.insert(v.limit(0), v.filter("id % 28 = 3").select("id"))
    index.insert(v.filter("id % 28 = 3"))
    return index


def hundredth(spark, sf_dir) -> DataFrame:
    return chunk_rows(spark, sf_dir).filter("id % 100 = 0").select(F.col("id").alias("qid"), "emb")


@query()
def ann_topk(spark, sf_dir):
    """Ten nearest rows of every hundredth vector by the graphs; tests hold its recall against all rows."""
    return neighbour_index(spark, sf_dir).search(hundredth(spark, sf_dir), 10).select("qid", "id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH u AS ({_UNIT}), s AS (SELECT q.id AS qid, c.id, round(list_dot_product(q.v, c.v), 12) AS s FROM u q JOIN u c ON q.id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS r FROM s) SELECT qid, id, CAST(r AS INT) AS rank, round(s, 6) AS score FROM r WHERE r <= 10")
def ann_exact_topk(spark, sf_dir):
    """The same index, all rows of its shards compared."""
    return neighbour_index(spark, sf_dir).search(hundredth(spark, sf_dir), 10, exact=True).select("qid", "id", "rank", F.round("score", 6).alias("score"))


_WINDOWS = """k AS (SELECT *, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 180 THEN 1 ELSE CAST(ceil((len(w) - 180) / 150.0) AS INT) + 1 END AS k FROM w),
e AS (SELECT *, unnest(range(k)) AS i FROM k) SELECT doc_id, CAST(i AS INT) AS chunk_index, array_to_string(list_slice(w, i * 150 + 1, i * 150 + 180), ' ') AS text FROM e"""


@query(rf"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 200 = 0 THEN 'again ' || doc_id || ' ' || text WHEN doc_id % 100 = 0 THEN 'edited ' || text ELSE text END AS text FROM documents WHERE doc_id % 250 <> 0 OR doc_id % 200 = 0),
w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM d), {_WINDOWS}""")
def store_upserts(spark, sf_dir):
    """Chunks of all documents after edits of every hundredth, deletions, a compaction and later edits, merged on read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chunks = lambda d: d.select("doc_id", F.posexplode(T.windows(F.col("text"))).alias("chunk_index", "text"))
    store = Store.create(spark, new_folder(spark, "store"), {"chunks": (chunks(docs), {"doc_id": "true"})})
    first = docs.filter("doc_id % 100 = 0")
    store.commit({"chunks": (chunks(first.withColumn("text", F.concat(F.lit("edited "), "text"))), first.select("doc_id"))})
    store.commit({"chunks": (chunks(docs.limit(0)), docs.filter("doc_id % 250 = 0").select("doc_id"))})
    store.compact()
    later = docs.filter("doc_id % 200 = 0")
    store.commit({"chunks": (chunks(later.withColumn("text", F.concat(F.lit("again "), "doc_id", F.lit(" "), "text"))), later.select("doc_id"))})
    return store.read("chunks")


@query("""WITH p AS (SELECT source || '/' || (doc_id % 7) AS slug, doc_id, text FROM documents), l AS (SELECT slug, arg_max(text, doc_id) AS text FROM p GROUP BY 1)
SELECT DISTINCT slug AS src, 'l' || length(unnest(string_split(text, ' '))) AS dst FROM l""")
def page_link_stream(spark, sf_dir):
    """Links of the last version of each page: documents arrive as edits of pages, state gives changes of edges, these are folded. A page links to the lengths of its words."""
    d = table(spark, sf_dir, "documents")
    lengths = F.array_distinct(F.transform(F.split("text", " ", -1), lambda w: F.concat(F.lit("l"), F.length(w).cast("string"))))
    stream = spark.readStream.schema(d.schema).parquet(f"{sf_dir}/documents.parquet*")
    edits = stream.select(F.concat("source", F.lit("/"), (F.col("doc_id") % 7).cast("string")).alias("slug"), F.col("doc_id").alias("version"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id")).alias("ts"), lengths.alias("links"))
    out, marks = new_folder(spark, "changes"), new_folder(spark, "marks")

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    page_stream.edge_changes(edits).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return page_stream.net_edges(spark.read.schema(page_stream.CHANGES).option("recursiveFileLookup", "true").parquet(out)).select("src", "dst")


def _html_sql(key: str) -> str:
    out = "coalesce(html, '')"
    for pattern in (r"(?s)<!--.*?-->", *(rf"(?is)<{t}(\s[^>]*)?>.*?(</{t}\s*>|$)" for t in sorted(html.SKIPPED, key=lambda t: (t != "script", t != "style", t)))):
        out = f"regexp_replace({out}, '{pattern}', '', 'g')"
    for pattern, to in ((r"(?i)<h([1-6])(\s[^>]*)?>", "chr(1) || '\\1'"), (r"(?i)</h[1-6]\s*>", "chr(2) || chr(10)"), (rf"(?i)<({'|'.join(sorted(html.BLOCKS))})(\s[^>]*[^/>])?>", "chr(10)"), (r"(?i)<(br|hr)\s*/>", "chr(10)"), (r"<[/!?]?[A-Za-z][^>]*>", "''")):
        out = f"regexp_replace({out}, '{pattern}', {to}, 'g')"
    for name, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        out = f"regexp_replace({out}, '&{name};?', '{char}', 'g')"
    tidy = lambda x: rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '[ \t\r\f\v]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"
    return f"""WITH p AS (SELECT {key} AS page_id, string_split({out}, chr(1)) AS parts FROM pages), e AS (SELECT page_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM p),
s AS (SELECT page_id, i, CASE WHEN i = 1 THEN 1 ELSE CAST(left(part, 1) AS INT) END AS level, CASE WHEN i > 1 THEN nullif(trim(string_split(substr(part, 2), chr(2))[1], ' ' || chr(10)), '') END AS title, {tidy("replace(CASE WHEN i = 1 THEN part ELSE substr(part, 2) END, chr(2), '')")} AS text FROM e)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INT) AS ord, level, title, text FROM s WHERE title IS NOT NULL OR text <> ''"""


@query(_html_sql("page_id"))
def html_sections(spark, sf_dir):
    """Sections of all pages, by the table function."""
    return html.html_sections(table(spark, sf_dir, "pages").select("page_id", "html"))


@query(_html_sql("page_id"))
def html_folder(spark, sf_dir):
    """The same from files: all pages are written to a folder, a subfolder a hash, and read as a data source. A subfolder has some 2,000 pages at most; where pages are written one is a Python string at a time."""
    folder = new_folder(spark, "pages")
    formats.register(spark)
    some = table(spark, sf_dir, "pages").select("page_id", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("html"))
    folders = max(16, -(-some.count() // 2000))

    def put(batches):
        for batch in batches:
            fs, top = file_system(folder)
            pages = batch.column("page_id").to_pylist()
            for to in {page % folders for page in pages}:
                fs.create_dir(f"{top}/{to}", recursive=True)
            for page, content in zip(pages, batch.column("html"), strict=True):
                with fs.open_output_stream(f"{top}/{page % folders}/{page}.html", compression=None) as out:
                    out.write(content.as_buffer())
            yield pa.record_batch([pa.array([len(pages)], pa.int64())], ["n"])

    written(some.mapInArrow(put, "n long"), "files")
    rows = spark.read.format("scholia_html").load(folder)
    return rows.select(F.regexp_extract("source", r"(\d+)\.html$", 1).cast("long").alias("page_id"), "ord", "level", "title", "text")
