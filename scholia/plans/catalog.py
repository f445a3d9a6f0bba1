"""Named queries over the driver's tables, with the SQL that gives the same rows.

Views: a ``source`` of documents is a document and its rows are pages, in order of doc_id; vectors are chunks and labels pages; suppliers are pages and the parts
they ship are entities; vectors' similarity gives the graph's edges.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prefix
from ..functions import text as T
from ..functions.tables import version_of, written
from ..operators import edit, entities, evaluate, graph, knowledge, references, render, restructure, retrieve, sample, vector
from ..operators import index as indexing
from ..sources import documents
from ..streaming import upsert


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark, sf_dir, **made) -> DataFrame:
    """Pages are numbered by keys alone, in ranges, so that no task gets a whole source; texts, or columns made of them, meet their numbers by doc_id."""
    made = made or {"text": F.col("text")}
    d = table(spark, sf_dir, "documents")
    keys = prefix.numbered(d.select("source", "doc_id"), ["source"], ["doc_id"]).withColumn("number", F.col("number").cast("int"))
    return keys.join(d.select("doc_id", *[x.alias(c) for c, x in made.items()]), "doc_id").select("source", "number", *made)


_DP = "dp AS (SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT) AS number, text FROM documents)"


def title():
    """A document's first line, cut."""
    return F.left(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit(60))


def outline(spark, sf_dir, titled: DataFrame | None = None) -> DataFrame:
    """titled(source, number, title): where not given, titles are cut before they meet their numbers, so no text is shuffled for them."""
    n = F.col("number")
    titled = pages(spark, sf_dir, title=title()) if titled is None else titled
    return titled.filter(n % 3 != 0).select("source", n.alias("ord"), (1 + (n * 7) % 3).alias("level"), "title", (n - n % 2).alias("page"))


_OL = "ol AS (SELECT source, number AS ord, 1 + (number * 7) % 3 AS level, left(split_part(text, chr(10), 1), 60) AS title, number - number % 2 AS page FROM dp WHERE number % 3 <> 0)"
_CUTS = f"""{_DP}, {_OL}, top AS (SELECT source, max(number) AS last FROM dp GROUP BY 1),
c0 AS (SELECT ol.*, last FROM ol JOIN top USING (source) WHERE level <= 2 AND page BETWEEN 1 AND last),
c1 AS (SELECT *, lag(page) OVER (PARTITION BY source ORDER BY ord) AS b FROM c0),
c2 AS (SELECT source, ord, page, title, level, last FROM c1 WHERE b IS NULL OR b <> page),
ff AS (SELECT source, arg_min(page, ord) AS f FROM c2 GROUP BY 1),
c3 AS (SELECT * FROM c2 UNION ALL SELECT top.source, -1, 1, 'Front Matter', 1, last FROM top LEFT JOIN ff USING (source) WHERE last >= 1 AND (f IS NULL OR f > 1)),
cut AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY ord) - 1 AS i, page, title, level, ord, last, coalesce(lead(page) OVER (PARTITION BY source ORDER BY ord), last + 1) AS next_page FROM c3)"""


def cuts(spark, sf_dir):
    return restructure.cuts(outline(spark, sf_dir), pages(spark, sf_dir))


def chunk_rows(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("page"), F.col("embedding").alias("emb"))


def mention_rows(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), F.col("l_partkey").alias("entity")).distinct()


def first_vector(spark, sf_dir) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0]]


def edge_rows(spark, sf_dir) -> DataFrame:
    """A graph over suppliers: parent s // 10, next s + 1, references by customers' nations, similar by shared remainders."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("s"))
    last = s.agg(F.max("s").alias("m"))
    none = F.lit(None).cast("double")
    child = s.filter("s >= 10").select(F.col("s").alias("src"), F.expr("s div 10").alias("dst"), F.lit("CHILD_OF").alias("rel"), none.alias("score"))
    nxt = s.crossJoin(F.broadcast(last)).filter("s < m").select(F.col("s").alias("src"), (F.col("s") + 1).alias("dst"), F.lit("NEXT").alias("rel"), none.alias("score"))
    ref = s.crossJoin(F.broadcast(last)).select(F.col("s").alias("src"), (F.col("s") * 7 % F.col("m") + 1).alias("dst"), F.lit("REFERENCES").alias("rel"), none.alias("score")).filter("src <> dst and src % 3 = 0")
    sim = s.crossJoin(F.broadcast(last)).select(F.col("s").alias("src"), (F.col("s") * 11 % F.col("m") + 1).alias("dst"), F.lit("SIMILAR_TO").alias("rel"), (1.0 / (1 + F.col("s") % 5)).alias("score")).filter("src <> dst and src % 2 = 0")
    return child.unionByName(nxt).unionByName(ref).unionByName(sim)


_EDGES = """s AS (SELECT CAST(s_suppkey AS BIGINT) AS s FROM supplier), m AS (SELECT max(s) AS m FROM s),
edges AS (SELECT s AS src, s // 10 AS dst, 'CHILD_OF' AS rel, CAST(NULL AS DOUBLE) AS score FROM s WHERE s >= 10
UNION ALL SELECT s, s + 1, 'NEXT', NULL FROM s, m WHERE s < m
UNION ALL SELECT s, s * 7 % m + 1, 'REFERENCES', NULL FROM s, m WHERE s <> s * 7 % m + 1 AND s % 3 = 0
UNION ALL SELECT s, s * 11 % m + 1, 'SIMILAR_TO', 1.0 / (1 + s % 5) FROM s, m WHERE s <> s * 11 % m + 1 AND s % 2 = 0)"""
_MENTIONS = "me AS (SELECT DISTINCT l_suppkey AS page, l_partkey AS entity FROM lineitem)"
_UNIT = "SELECT vec_id AS id, label AS page, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM embeddings"

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query(f"WITH u AS ({_UNIT}), q AS (SELECT v AS q FROM u ORDER BY id LIMIT 1) SELECT id, round(list_dot_product(v, q), 6) AS score FROM u, q ORDER BY round(list_dot_product(v, q), 12) DESC, id LIMIT 5")
def vec_topk(spark, sf_dir):
    return vector.search(chunk_rows(spark, sf_dir), first_vector(spark, sf_dir), 5).select("id", F.round("score", 6).alias("score"))


@query(f"WITH u AS ({_UNIT}), p AS (SELECT a.id AS a, b.id AS b, round(list_dot_product(a.v, b.v), 12) AS s FROM u a JOIN u b ON a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM p WHERE s > 0) SELECT a, b, CAST(r AS INT) AS rank, round(s, 6) AS score FROM r WHERE r <= 6")
def vec_similar_topk(spark, sf_dir):
    return vector.similar(chunk_rows(spark, sf_dir)).select("a", "b", "rank", F.round("score", 6).alias("score"))


@query(f"WITH u AS ({_UNIT}), f AS (SELECT page, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM u), a AS (SELECT page, p, avg(x) AS x FROM f GROUP BY 1, 2), n AS (SELECT page, sqrt(sum(x * x)) AS n FROM a GROUP BY 1) SELECT page, CAST(p - 1 AS INT) AS p, round(x / n, 6) AS x FROM a JOIN n USING (page)")
def page_centroid(spark, sf_dir):
    return vector.centroids(chunk_rows(spark, sf_dir)).select("page", F.posexplode("emb").alias("p", "x")).withColumn("x", F.round("x", 6))


@query(f"WITH u AS ({_UNIT}), q AS (SELECT v AS q FROM u ORDER BY id LIMIT 1), s AS (SELECT page, id, round(list_dot_product(v, q), 12) AS s FROM u, q), r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY s DESC, id) AS r FROM s) SELECT page, id, round(s, 6) AS score FROM r WHERE r = 1")
def best_chunk_per_page(spark, sf_dir):
    return vector.best_chunk_per_page(chunk_rows(spark, sf_dir), first_vector(spark, sf_dir)).select("page", "id", F.round("score", 6).alias("score"))


@query(f"WITH u AS ({_UNIT}), q AS (SELECT id AS qid, v AS q FROM u WHERE id % 100 = 0), s AS (SELECT qid, id, page, round(list_dot_product(v, q), 12) AS s FROM u, q), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS r FROM s) SELECT qid, id, page, CAST(r AS INT) AS marker, round(1 - s, 6) AS distance FROM r WHERE r <= 5")
def hybrid_search(spark, sf_dir):
    c = chunk_rows(spark, sf_dir)
    return retrieve.seeds(c.filter("id % 100 = 0").select(F.col("id").alias("qid"), "emb"), c, 5).select("qid", "id", "page", "marker", F.round(1 - F.col("score"), 6).alias("distance"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents),
k AS (SELECT *, len(w) AS n, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 180 THEN 1 ELSE CAST(ceil((len(w) - 180) / 150.0) AS INT) + 1 END AS k FROM w),
e AS (SELECT *, unnest(range(k)) AS i FROM k) SELECT doc_id, CAST(i AS INT) AS chunk_index, array_to_string(list_slice(w, i * 150 + 1, i * 150 + 180), ' ') AS text FROM e""")
def chunk_windows(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.windows(F.col("text"))).alias("chunk_index", "text"))


_STRIP = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


@query(f"""WITH {_CUTS} SELECT source, i, page AS page_start, greatest(next_page - 1, page) AS page_end, title, level, (SELECT count(*) FROM dp WHERE dp.source = cut.source AND number >= page AND number < next_page AND {_STRIP} <> '') AS n_pages,
coalesce((SELECT string_agg({_STRIP}, chr(10) || chr(10) ORDER BY number) FROM dp WHERE dp.source = cut.source AND number >= page AND number < next_page AND {_STRIP} <> ''), '') AS text FROM cut""")
def wiki_cuts_assembly(spark, sf_dir):
    return restructure.assemble(cuts(spark, sf_dir), pages(spark, sf_dir)).select("source", "i", "page_start", "page_end", "title", "level", "n_pages", "text")


@query(f"WITH {_CUTS} SELECT c.source, c.i, max(p.i) AS parent FROM cut c LEFT JOIN cut p ON p.source = c.source AND p.i < c.i AND p.level < c.level GROUP BY 1, 2")
def wiki_parent(spark, sf_dir):
    return restructure.parents(cuts(spark, sf_dir)).select("source", "i", "parent")


@query(f"WITH {_CUTS} SELECT c.source, i, o.ord AS sub_ord, o.title AS sub_title, o.level AS sub_level FROM cut c JOIN ol o ON o.source = c.source AND o.page >= c.page AND o.page < c.next_page AND o.ord <> c.ord")
def subsections(spark, sf_dir):
    return restructure.subsections(cuts(spark, sf_dir), outline(spark, sf_dir))


@query(f"WITH {_CUTS} SELECT source, i, lag(i) OVER (PARTITION BY source ORDER BY i) AS prev, lead(i) OVER (PARTITION BY source ORDER BY i) AS next FROM cut")
def page_neighbours(spark, sf_dir):
    return restructure.neighbours(cuts(spark, sf_dir)).select("source", "i", "prev", "next")


@query("WITH n AS (SELECT source, count(*) AS n_pages FROM documents GROUP BY 1) SELECT source, n_pages, CAST(coalesce(sum(n_pages) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM n")
def merge_offsets(spark, sf_dir):
    return restructure.merge_offsets(table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n_pages")))


def numbered(spark, sf_dir, of: DataFrame | None = None) -> DataFrame:
    """Whole pages, with a printed number two below their own above the text, and references to page number * 3 % 40 + 1 and to section number % 9 below it; every fifth page declares a section."""
    n = F.col("number")
    head = F.concat(F.when(n > 2, (n - 2).cast("string")).otherwise(""), F.when(n % 5 == 0, F.concat(F.lit("\n"), (n / 5 % 9).cast("int").cast("string"), F.lit(".1 Part of it"))).otherwise(""))
    foot = F.concat(F.lit("siehe Seite "), (n * 3 % 40 + 1).cast("string"), F.lit(" und Abschnitt "), (n % 9).cast("string"), F.lit(".1 ."))
    return (pages(spark, sf_dir) if of is None else of).withColumn("text", F.concat_ws("\n", head, "text", foot))


_NUM = f"""{_DP}, np AS (SELECT source, number, CASE WHEN number > 2 THEN CAST(number - 2 AS VARCHAR) ELSE '' END || CASE WHEN number % 5 = 0 THEN chr(10) || CAST(number // 5 % 9 AS VARCHAR) || '.1 Part of it' ELSE '' END
|| chr(10) || text || chr(10) || 'siehe Seite ' || CAST(number * 3 % 40 + 1 AS VARCHAR) || ' und Abschnitt ' || CAST(number % 9 AS VARCHAR) || '.1 .' AS text FROM dp)"""
_OFFSET = """v AS (SELECT source, number, unnest(t) AS p, generate_subscripts(t, 1) AS pos FROM (SELECT source, number, regexp_extract_all(regexp_replace(text, '[\\p{L}\\p{M}]', 'x', 'g'), '\\b(\\d{1,3})\\b', 1) AS t FROM np)),
k AS (SELECT v.source, number - CAST(p AS INT) AS k, number, pos FROM v JOIN (SELECT source, max(number) AS n FROM np GROUP BY 1) USING (source) WHERE CAST(p AS INT) BETWEEN 1 AND n AND number - CAST(p AS INT) BETWEEN 0 AND 40),
t AS (SELECT source, k, count(*) AS c, min(number * 10000000 + pos) AS f FROM k GROUP BY 1, 2), o AS (SELECT source, k AS "offset", row_number() OVER (PARTITION BY source ORDER BY c DESC, f) AS r FROM t)"""


@query(f"WITH {_NUM}, {_OFFSET} SELECT source, CAST(\"offset\" AS INT) AS \"offset\" FROM o WHERE r = 1")
def offset_mode(spark, sf_dir):
    return references.page_offsets(numbered(spark, sf_dir))


_SPANS = "sp AS (SELECT source, number, source || '-' || CAST((number - 1) // 4 AS VARCHAR) AS slug FROM dp)"


def spans(p: DataFrame) -> DataFrame:
    return p.groupBy("source", F.expr("(number - 1) div 4").alias("g")).agg(F.min("number").alias("page_start"), F.max("number").alias("page_end")).select("source", F.concat_ws("-", "source", "g").alias("slug"), "page_start", "page_end")


@query(f"""WITH {_NUM}, {_OFFSET}, {_SPANS}, r AS (SELECT source, number, CAST(unnest(regexp_extract_all(text, 'Seite (\\d{{1,3}})', 1)) AS INT) AS p FROM np)
SELECT DISTINCT a.slug AS src, b.slug AS dst FROM r JOIN o ON o.source = r.source AND o.r = 1 JOIN sp a ON a.source = r.source AND a.number = r.number
JOIN sp b ON b.source = r.source AND b.number = p + o."offset" WHERE a.slug <> b.slug""")
def page_refs(spark, sf_dir):
    p = numbered(spark, sf_dir)
    return references.page_reference_edges(p, spans(p), references.page_offsets(p))


@query(f"""WITH {_NUM}, {_SPANS}, h AS (SELECT source, CAST(number // 5 % 9 AS VARCHAR) || '.1' AS no, min(number) AS "to" FROM np WHERE number % 5 = 0 GROUP BY 1, 2)
SELECT DISTINCT a.slug AS src, b.slug AS dst FROM np JOIN h ON h.source = np.source AND no = CAST(np.number % 9 AS VARCHAR) || '.1' JOIN sp a ON a.source = np.source AND a.number = np.number JOIN sp b ON b.source = np.source AND b.number = "to" WHERE a.slug <> b.slug""")
def section_refs(spark, sf_dir):
    p = numbered(spark, sf_dir)
    return references.section_reference_edges(p, spans(p))


@query(f"WITH {_MENTIONS}, n AS (SELECT a.page AS a, b.page AS b, count(*) AS n FROM me a JOIN me b ON a.entity = b.entity AND a.page <> b.page GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM n) SELECT a, b, n FROM r WHERE r <= 6")
def shared_entity_topk(spark, sf_dir):
    return graph.top_shared(mention_rows(spark, sf_dir), 6)


@query(f"WITH {_MENTIONS}, n AS (SELECT entity, count(*) AS n FROM me GROUP BY 1) SELECT count(*) AS entities, count(*) FILTER (n = 1) AS singletons, count(*) FILTER (n > 1) AS cross_page FROM n")
def entity_singletons(spark, sf_dir):
    return graph.singletons(mention_rows(spark, sf_dir))


@query(f"WITH {_MENTIONS} SELECT entity, count(*) AS n FROM me GROUP BY 1 ORDER BY n DESC, entity LIMIT 12")
def entity_hubs(spark, sf_dir):
    return graph.entity_hubs(mention_rows(spark, sf_dir))


@query(f"WITH {_MENTIONS}, n AS (SELECT entity, count(*) AS n FROM me GROUP BY 1), r AS (SELECT page, entity, n, row_number() OVER (PARTITION BY page ORDER BY n DESC, entity) AS r FROM me JOIN n USING (entity)) SELECT page, entity, n, CAST(r AS INT) AS rank FROM r WHERE r <= 8")
def page_entities(spark, sf_dir):
    return graph.page_entities(mention_rows(spark, sf_dir))


@query(f"WITH {_EDGES} SELECT rel, count(*) AS n FROM edges GROUP BY 1")
def graph_stats(spark, sf_dir):
    return graph.stats(edge_rows(spark, sf_dir))


_DEG = "d AS (SELECT p, count(*) AS d FROM (SELECT src AS p FROM edges WHERE rel IN ('SIMILAR_TO', 'REFERENCES') UNION ALL SELECT dst FROM edges WHERE rel IN ('SIMILAR_TO', 'REFERENCES')) GROUP BY 1)"


@query(f"WITH {_EDGES}, {_DEG} SELECT s AS page, coalesce(d, 0) AS degree FROM s LEFT JOIN d ON p = s")
def graph_degrees(spark, sf_dir):
    return graph.degrees(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("page")), edge_rows(spark, sf_dir))


@query(f"WITH {_EDGES}, {_DEG}, {_MENTIONS}, f AS (SELECT s, coalesce(d, 0) AS d, s IN (SELECT src FROM edges WHERE rel = 'SIMILAR_TO' UNION SELECT dst FROM edges WHERE rel = 'SIMILAR_TO') AS sim, s IN (SELECT page FROM me) AS ent, d IS NOT NULL AS e FROM s LEFT JOIN d ON p = s) SELECT count(*) AS pages, count(*) FILTER (NOT sim) AS no_similar, count(*) FILTER (NOT ent) AS no_entities, count(*) FILTER (NOT ent AND NOT e) AS orphans, round(avg(d), 2) AS avg_degree FROM f")
def graph_health(spark, sf_dir):
    return graph.health(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("page")), edge_rows(spark, sf_dir), mention_rows(spark, sf_dir))


@query(f"""WITH {_EDGES}, {_MENTIONS}, sh AS (SELECT a.page AS a, b.page AS b, count(*) AS n FROM me a JOIN me b ON a.entity = b.entity AND a.page <> b.page GROUP BY 1, 2),
r AS (SELECT src, dst AS node, 0 AS g, 0.0 AS o FROM edges WHERE rel = 'CHILD_OF' UNION ALL SELECT dst, src, 1, 0 FROM edges WHERE rel = 'CHILD_OF' UNION ALL SELECT dst, src, 2, 0 FROM edges WHERE rel = 'NEXT' UNION ALL SELECT src, dst, 3, 0 FROM edges WHERE rel = 'NEXT'
UNION ALL SELECT src, dst, 4, 0 FROM edges WHERE rel = 'REFERENCES' UNION ALL SELECT dst, src, 5, 0 FROM edges WHERE rel = 'REFERENCES' UNION ALL SELECT a, b, 6, -n FROM sh UNION ALL SELECT src, dst, 7, -score FROM edges WHERE rel = 'SIMILAR_TO'),
k AS (SELECT *, row_number() OVER (PARTITION BY src, g ORDER BY o, node) AS k FROM r)
SELECT src, node, (['parent', 'child', 'prev', 'next', 'references', 'referenced_by', 'shared_entity', 'similar'])[min(g) + 1] AS rel FROM k WHERE k <= CASE g WHEN 4 THEN 8 WHEN 5 THEN 6 WHEN 6 THEN 6 WHEN 7 THEN 6 ELSE 1000000000 END GROUP BY 1, 2""")
def neighborhood(spark, sf_dir):
    return graph.neighborhood(edge_rows(spark, sf_dir), mention_rows(spark, sf_dir))


@query(f"""WITH RECURSIVE {_EDGES}, b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), h(node, hops) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT b.dst, hops + 1 FROM h JOIN b ON b.src = h.node WHERE hops < 3) SELECT node, CAST(min(hops) AS INT) AS hops FROM h GROUP BY 1""")
def path_hops(spark, sf_dir):
    return graph.hops(edge_rows(spark, sf_dir), 1, 3)


@query("""WITH r AS (SELECT doc_id % 50 AS qid, list(doc_id ORDER BY n_chars DESC, doc_id) AS ranked, list_filter(list(doc_id ORDER BY doc_id), lambda x: x % 7 = 0) AS expected FROM documents GROUP BY 1),
m AS (SELECT coalesce(1.0 / list_min(list_filter(list_transform(ranked, lambda x, i: CASE WHEN list_contains(expected, x) THEN i END), lambda i: i IS NOT NULL)), 0) AS rr, CAST(list_has_any(list_slice(ranked, 1, 8), expected) AS INT) AS hit, CASE WHEN len(expected) > 0 THEN len(list_intersect(list_slice(ranked, 1, 8), expected)) / len(expected) ELSE 0 END AS rec FROM r)
SELECT count(*) AS n, round(avg(rr), 6) AS mrr, round(avg(hit), 6) AS hit_rate, round(avg(rec), 6) AS recall, count(*) FILTER (hit = 0) AS misses FROM m""")
def eval_mrr_hit_recall(spark, sf_dir):
    """Every fiftieth document answers one question, longest first; those whose number is a multiple of seven are expected."""
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("qid"), F.col("doc_id").alias("page"), (-F.col("n_chars")).alias("o"))
    found = prefix.numbered(d, ["qid"], ["o", "page"], "rank")
    report = evaluate.report_rows(d.select("qid"), d.filter("page % 7 = 0"), found, 8)
    return report.select("n", *[F.round(c, 6).alias(c) for c in ("mrr", "hit_rate", "recall")], "misses")


_NAME = "array_to_string(list_filter(string_split_regex(regexp_replace(lower(p_name), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda x: x <> '' AND x NOT IN ('der', 'die', 'das', 'den', 'dem', 'des', 'ein', 'eine', 'einer', 'einen', 'einem', 'the', 'a', 'an')), ' ')"


@query(f"WITH n AS (SELECT p_partkey, {_NAME} AS x FROM part) SELECT p_partkey, CASE WHEN x LIKE '%en' AND length(x) >= 6 THEN left(x, length(x) - 2) WHEN x LIKE '%n' AND length(x) >= 5 THEN left(x, length(x) - 1) WHEN x LIKE '%e' AND length(x) >= 5 THEN left(x, length(x) - 1) ELSE x END AS key FROM n")
def entity_normalise(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.entity_key_name(F.col("p_name")).alias("key"))


@query("SELECT doc_id, CASE WHEN length(x) > 160 THEN rtrim(left(x, 160)) || '…' ELSE x END AS snippet FROM (SELECT doc_id, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''), ' ') AS x FROM documents)")
def snippets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query(r"""SELECT doc_id, coalesce(nullif(rtrim(left(trim(regexp_replace(regexp_replace(strip_accents(replace(replace(replace(replace(lower(regexp_replace(split_part(text, chr(10), 1), '^\s+|\s+$', '', 'g')), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')),
'[^\x00-\x7F]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '-'), 60), '-'), ''), 'section') AS slug FROM documents""")
def slugs(spark, sf_dir):
    """Slugs of all documents' first lines. (DuckDB has no compatibility decomposition, as of ligatures; tests hold such letters against Python.)"""
    return table(spark, sf_dir, "documents").select("doc_id", T.slug(F.split_part("text", F.lit("\n"), F.lit(1))).alias("slug"))


@query(r"""WITH r AS (SELECT doc_id, '<think>' || text || '</think>' || chr(10) || text || chr(10) || 'see [' || CAST(doc_id % 5 AS VARCHAR) || '] and [7], [' || CAST(doc_id % 5 AS VARCHAR) || ']' || chr(10) || chr(9) AS x FROM documents),
a AS (SELECT doc_id, regexp_replace(regexp_replace(x, '(?s)<think>.*?</think>', '', 'g'), '^\s+|\s+$', '', 'g') AS answer FROM r)
SELECT doc_id, answer, list_sort(list_distinct(list_transform(regexp_extract_all(answer, '\[(\d+)\]', 1), lambda x: CAST(x AS INT)))) AS cited FROM a""")
def citations(spark, sf_dir):
    k = (F.col("doc_id") % 5).cast("string")
    reply = F.concat(F.lit("<think>"), "text", F.lit("</think>\n"), "text", F.lit("\nsee ["), k, F.lit("] and [7], ["), k, F.lit("]\n\t"))
    said = table(spark, sf_dir, "documents").select("doc_id", T.strip_think(reply).alias("answer"))
    return said.select("doc_id", "answer", F.array_sort(T.citations(F.col("answer"))).alias("cited"))


@query("SELECT user_id, arg_max(value, {'t': ts, 'e': event_id}) AS value, count(*) AS revisions FROM events GROUP BY 1")
def latest_edits(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    last = upsert.latest(e.select("user_id", "value", F.struct("ts", "event_id").alias("version")), "user_id", "version")
    return last.select("user_id", "value").join(e.groupBy("user_id").agg(F.count("*").alias("revisions")), "user_id")


_CENTROIDS = "f AS (SELECT page, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM u), av AS (SELECT page, p, avg(x) AS x FROM f GROUP BY 1, 2), nn AS (SELECT page, sqrt(sum(x * x)) AS n FROM av GROUP BY 1), ce AS (SELECT page, list(x / n ORDER BY p) AS v FROM av JOIN nn USING (page) GROUP BY 1)"


@query(f"""WITH u AS ({_UNIT}), {_CENTROIDS}, {_MENTIONS}, q AS (SELECT id AS qid, v AS q FROM u WHERE id % 100 = 0),
s AS (SELECT qid, id, page, round(list_dot_product(v, q), 12) AS s FROM u, q), se AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS m FROM s) WHERE m <= 5),
sp AS (SELECT a.page AS src, b.page AS node, round(list_dot_product(a.v, b.v), 12) AS s FROM ce a JOIN ce b ON a.page <> b.page), si AS (SELECT src, node FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY s DESC, node) AS r FROM sp WHERE s > 0) WHERE r <= 6),
mp AS (SELECT * FROM me WHERE page IN (SELECT page FROM u)), sh AS (SELECT src, node FROM (SELECT a.page AS src, b.page AS node, row_number() OVER (PARTITION BY a.page ORDER BY count(*) DESC, b.page) AS r FROM mp a JOIN mp b ON a.entity = b.entity AND a.page <> b.page GROUP BY 1, 2) WHERE r <= 6),
ne AS (SELECT * FROM si UNION SELECT * FROM sh), sd AS (SELECT DISTINCT qid, page FROM se), ca AS (SELECT DISTINCT qid, node AS page FROM sd JOIN ne ON src = page EXCEPT SELECT qid, page FROM sd),
be AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY s.qid, s.page ORDER BY s DESC, id) AS r FROM s JOIN ca ON ca.qid = s.qid AND ca.page = s.page) WHERE r = 1),
ex AS (SELECT qid, id, page, s, 5 + row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS m FROM be)
SELECT qid, id, page, round(s, 6) AS score, CAST(m AS INT) AS marker, 'seed' AS kind FROM se UNION ALL SELECT qid, id, page, round(s, 6), CAST(m AS INT), 'related' FROM ex WHERE m <= 8""")
def graph_rag(spark, sf_dir):
    c = chunk_rows(spark, sf_dir)
    edges = vector.similar(vector.centroids(c).withColumnRenamed("page", "id")).select(F.col("a").cast("long").alias("src"), F.col("b").cast("long").alias("dst"), F.lit("SIMILAR_TO").alias("rel"), "score")
    c = c.withColumn("page", F.col("page").cast("long"))
    mentions = mention_rows(spark, sf_dir).withColumn("page", F.col("page").cast("long")).join(c.select("page"), "page", "left_semi")
    found = retrieve.graph_rag(c.filter("id % 100 = 0").select(F.col("id").alias("qid"), "emb"), c, edges, mentions)
    return found.select("qid", "id", F.col("page").cast("int").alias("page"), F.round("score", 6).alias("score"), F.col("marker").cast("int").alias("marker"), "kind")


@query(r"""WITH u AS (SELECT source, doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents WHERE regexp_matches(text, '\S')),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM u),
c AS (SELECT *, count(*) OVER (PARTITION BY source) AS m FROM r WHERE k % greatest(1, n // 40) = 0 AND k < 40 * greatest(1, n // 40))
SELECT source, left(string_agg(left(t, CAST(greatest(120, 6000 // m) AS INT)), chr(10) || '---' || chr(10) ORDER BY doc_id), 6000) AS sample FROM c GROUP BY 1""")
def corpus_sample(spark, sf_dir):
    return sample.sample_corpus(table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("ord"), "text"))


@query("""WITH v AS (SELECT doc_id, ['a', 'b', 'tie'][1 + doc_id % 3] AS v FROM documents), w AS (SELECT CASE WHEN v = 'tie' THEN 'tie' WHEN (v = 'a') = (doc_id % 2 = 0) THEN 'first' ELSE 'second' END AS w FROM v)
SELECT count(*) AS questions, count(*) FILTER (w = 'first') AS "first", count(*) FILTER (w = 'second') AS "second", count(*) FILTER (w = 'tie') AS tie FROM w""")
def judge_tally(spark, sf_dir):
    reply = F.concat(F.lit("<think>B?</think> Verdict: "), F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("tie")), (1 + F.col("doc_id") % 3).cast("int")), F.lit("."))
    return evaluate.judge_tally(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), reply.alias("reply")))


@query("""WITH p AS (SELECT p_partkey, p_name, p_partkey % 4 AS k, split_part(p_name, ' ', 1) AS w FROM part), o AS (SELECT *, (length(p_name) - length(replace(p_name, w, ''))) // length(w) AS n FROM p)
SELECT 'p' || p_partkey AS slug, CASE WHEN k = 2 THEN 'exists' WHEN k = 3 THEN 'missing' WHEN k = 0 AND n > 1 THEN 'not unique' ELSE 'ok' END AS status,
CASE WHEN k = 0 AND n = 1 THEN replace(p_name, w, 'new') WHEN k = 1 THEN p_name || chr(10) || chr(10) || '## ' || w || chr(10) || chr(10) || 'new' || chr(10) WHEN k <> 3 THEN p_name END AS text FROM o""")
def page_edits(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("slug", F.concat(F.lit("p"), "p_partkey")).withColumn("k", F.col("p_partkey") % 4)
    kind = F.element_at(F.array(F.lit("edit"), F.lit("append"), F.lit("create"), F.lit("append")), (F.col("k") + 1).cast("int"))
    edits = p.select("slug", kind.alias("kind"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("old"), F.lit("new").alias("new"))
    return edit.apply_edits(p.filter("k <> 3").select("slug", F.col("p_name").alias("text")), edits)


def page_tree(spark, sf_dir) -> DataFrame:
    cut = cuts(spark, sf_dir)
    above = restructure.parents(cut).select("source", "i", "parent")
    return restructure.slugged(restructure.assemble(cut, pages(spark, sf_dir)).join(above, ["source", "i"]))


_TREE = f"""{_CUTS}, tr AS (SELECT c.source, c.i, c.page AS page_start, greatest(c.next_page - 1, c.page) AS page_end, c.title, c.level, max(p.i) AS parent,
printf('%03d', c.i) || '-' || coalesce(nullif(rtrim(left(trim(regexp_replace(regexp_replace(translate(replace(replace(replace(replace(lower(trim(c.title)), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'),
'àáâãåçèéêëìíîïñòóôõùúûýÿ', 'aaaaaceeeeiiiinoooouuuyy'), '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '-'), 60), '-'), ''), 'section') AS slug
FROM cut c LEFT JOIN cut p ON p.source = c.source AND p.i < c.i AND p.level < c.level GROUP BY ALL)"""


@query(f"WITH {_TREE} SELECT source, i, CASE WHEN parent IS NULL THEN '' ELSE '  ' END || '- [' || title || '](pages/' || slug || '.md)' AS line FROM tr")
def wiki_index(spark, sf_dir):
    return render.index_lines(page_tree(spark, sf_dir))


@query(f"""WITH {_TREE}, ch AS (SELECT source, parent AS i, list(slug ORDER BY i) AS c FROM tr WHERE parent IS NOT NULL GROUP BY 1, 2),
su AS (SELECT c.source, c.i, list({{'title': o.title, 'level': o.level}} ORDER BY o.ord) AS s FROM cut c JOIN ol o ON o.source = c.source AND o.page >= c.page AND o.page < c.next_page AND o.ord <> c.ord GROUP BY 1, 2)
SELECT t.source, t.i, CAST(to_json({{'slug': t.slug, 'title': t.title, 'level': t.level, 'file': 'pages/' || t.slug || '.md', 'pdf_page_start': t.page_start, 'pdf_page_end': t.page_end, 'parent': p.slug,
'children': coalesce(c, []), 'n_tables': 0, 'n_images': 0, 'subsections': coalesce(s, [])}}) AS VARCHAR) AS entry
FROM tr t LEFT JOIN tr p ON p.source = t.source AND p.i = t.parent LEFT JOIN ch ON ch.source = t.source AND ch.i = t.i LEFT JOIN su ON su.source = t.source AND su.i = t.i""")
def wiki_manifest(spark, sf_dir):
    return render.manifest(page_tree(spark, sf_dir), restructure.subsections(cuts(spark, sf_dir), outline(spark, sf_dir)))


@query(f"""WITH {_TREE}, rt AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY i) AS k FROM tr WHERE parent IS NULL)
SELECT source, source || ': ' || string_agg(title, '; ' ORDER BY i) || CASE WHEN max(n) > 12 THEN '; …' ELSE '' END AS summary FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM rt) WHERE k <= 12 GROUP BY 1""")
def wiki_summary(spark, sf_dir):
    return render.summary(page_tree(spark, sf_dir))


#: Strings that the offline embedder counts.
VOCABULARY = ["the", "and", "tion", "der", "und", "que", "ment", "eau"]
_COUNTS = "[" + ", ".join(f"CAST((length(text) - length(replace(text, '{w}', ''))) // {len(w)} AS DOUBLE)" for w in VOCABULARY) + "]"
_EMBED = f"list_transform(k, lambda x: CAST(x / sqrt(list_dot_product(k, k)) AS FLOAT)) AS e FROM (SELECT *, CASE WHEN list_max(k0) > 0 THEN k0 ELSE list_transform(k0, lambda x: CAST(CAST(1e-6 AS FLOAT) AS DOUBLE)) END AS k FROM (SELECT *, {_COUNTS} AS k0"
_WINDOWS = r"""(SELECT {key}, i, array_to_string(list_slice(w, i * 150 + 1, i * 150 + 180), ' ') AS text FROM (SELECT *, unnest(range(CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 180 THEN 1 ELSE CAST(ceil((len(w) - 180) / 150.0) AS INT) + 1 END)) AS i
FROM (SELECT {key}, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM {table})))"""
_CH = "ch AS (SELECT {key}, i, text, list_transform(e, lambda x: CAST(x AS DOUBLE) / sqrt(list_dot_product(CAST(e AS DOUBLE[]), CAST(e AS DOUBLE[])))) AS v FROM (SELECT {key}, i, text, " + _EMBED + " FROM {windows}))))"


class Capitalised:
    """Stands in for a model that lists entities: the capitalised words of six letters and more, as one type."""

    name = "capitalised"

    def chat(self, messages: list[dict]) -> str:
        import json
        import re

        found = dict.fromkeys(re.findall(r"[A-Z][a-z]{5,}", messages[-1]["content"].split("\n\n", 1)[1]))
        return "Found: " + json.dumps([{"name": x, "type": "Feature"} for x in found])


class Build:
    """The graph of all documents' page trees, as a user would save it, and the tables on the way to it; each is written when a query first asks for it.

    Texts are shuffled three times: to their numbers, to the wiki pages that hold them, and by wiki page. The tree is made without them.
    """

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir = spark, sf_dir

    @functools.cached_property
    def numbered(self) -> DataFrame:
        return written(pages(self.spark, self.sf_dir, text=F.col("text"), title=title()), "numbered")

    @functools.cached_property
    def tree(self) -> DataFrame:
        titled = self.numbered.select("source", "number", "title")
        cut = written(restructure.cuts(outline(self.spark, self.sf_dir, titled), titled), "cuts")
        return written(knowledge.named(restructure.slugged(restructure.parents(cut)), many=True), "tree")

    @functools.cached_property
    def wiki(self) -> DataFrame:
        made = restructure.assemble(self.tree, self.numbered.select("source", "number", "text"), "slug", "parent_slug")
        return written(made.select("source", "i", "slug", "title", "level", "page_start", "page_end", "parent_slug", "text"), "wiki")

    @functools.cached_property
    def found(self) -> tuple[DataFrame, DataFrame]:
        return entities.extract(self.wiki, Capitalised(), ["Feature"], keep=lambda df: written(df, "names"))

    @functools.cached_property
    def entities(self) -> DataFrame:
        return written(self.found[0], "entities")

    @functools.cached_property
    def begun(self) -> DataFrame:
        """Mentions of pages' first 8000 characters, as the SQL of kg_health and kg_neighborhood has them; the graph itself is of whole texts."""
        said = entities.replies(entities.page_prompts(self.wiki, 8000), Capitalised(), {"Feature": ""})
        return written(entities.resolve(said, ["Feature"], lambda df: written(df, "names"))[1], "begun")

    @functools.cached_property
    def graph(self) -> knowledge.Graph:
        index = indexing.Index(written(indexing.Index.build(self.wiki, indexing.WordCounts(VOCABULARY)).chunks, "chunks"), None)
        cut = self.wiki.select("source", "i", "slug", "page_start", "page_end")
        seen = numbered(self.spark, self.sf_dir, self.numbered.select("source", "number", "text"))
        refs = references.references(seen, cut, references.page_offsets(seen))
        g = knowledge.Graph.build(self.wiki, index.chunks, refs, self.entities, self.found[1])
        return knowledge.Graph(*(written(getattr(g, n), n) for n in ("pages", "chunks", "entities", "edges")))


#: One build, with the application and the versions of the tables that it was made from.
_built: dict[tuple, Build] = {}


def build(spark, sf_dir) -> Build:
    """Made anew whenever a file of documents has another name, length or time."""
    key = (spark.sparkContext.applicationId, version_of(table(spark, sf_dir, "documents")))
    if key not in _built:
        _built.clear()
        _built[key] = Build(spark, sf_dir)
    return _built[key]


def knowledge_graph(spark, sf_dir) -> knowledge.Graph:
    return build(spark, sf_dir).graph


_WP = f"""{_TREE}, tx AS (SELECT c.source, c.i, coalesce(string_agg({_STRIP}, chr(10) || chr(10) ORDER BY number) FILTER ({_STRIP} <> ''), '') AS text FROM cut c LEFT JOIN dp ON dp.source = c.source AND number >= page AND number < next_page GROUP BY 1, 2),
wp AS (SELECT t.source, t.i, t.source || '/' || t.slug AS slug, t.title, t.level, t.page_start, t.page_end, p.source || '/' || p.slug AS parent_slug, text FROM tr t JOIN tx USING (source, i) LEFT JOIN tr p ON p.source = t.source AND p.i = t.parent)"""
_KEY = "CASE WHEN x LIKE '%en' AND length(x) >= 6 THEN left(x, length(x) - 2) WHEN x LIKE '%n' AND length(x) >= 5 THEN left(x, length(x) - 1) WHEN x LIKE '%e' AND length(x) >= 5 THEN left(x, length(x) - 1) ELSE x END"
_ENT = f"""er AS (SELECT slug, i, unnest(w) AS name, generate_subscripts(w, 1) AS pos FROM (SELECT slug, i, regexp_extract_all(left(text, 8000), '[A-Z][a-z]{{5,}}') AS w FROM wp)),
en AS (SELECT slug, i, pos, name, 'Feature::' || {_KEY} AS key, {_KEY} AS k FROM (SELECT *, lower(name) AS x FROM er)), ev AS (SELECT * FROM en WHERE length(k) BETWEEN 2 AND 40), me AS (SELECT DISTINCT slug AS page, key AS entity FROM ev)"""
_KG = f"""{_WP}, {_ENT}, {_CH.format(key="slug", windows=_WINDOWS.format(key="slug", table="wp"))}, u AS (SELECT slug AS page, slug || '#' || CAST(i AS VARCHAR) AS id, v FROM ch), {_CENTROIDS},
ti AS (SELECT slug AS a, parent_slug AS b FROM wp WHERE parent_slug IS NOT NULL UNION SELECT parent_slug, slug FROM wp WHERE parent_slug IS NOT NULL),
sp AS (SELECT a.page AS src, b.page AS dst, round(list_dot_product(a.v, b.v), 12) AS s FROM ce a JOIN ce b ON a.page <> b.page WHERE NOT EXISTS (SELECT 1 FROM ti WHERE ti.a = a.page AND ti.b = b.page)),
si AS (SELECT src, dst, s FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) AS r FROM sp WHERE s > 0) WHERE r <= 6),
{_NUM.split(", np AS", 1)[1].join(["np AS", ""])}, {_OFFSET.replace("v AS (", "vo AS (").replace("v.source", "vo.source").replace("FROM v JOIN", "FROM vo JOIN").replace("t AS (", "tt AS (").replace("FROM t)", "FROM tt)")},
ow AS (SELECT dp.source, number, arg_max(slug, i) AS slug FROM dp JOIN wp ON wp.source = dp.source AND number BETWEEN page_start AND page_end GROUP BY 1, 2),
rr AS (SELECT source, number, CAST(unnest(regexp_extract_all(text, 'Seite (\\d{{1,3}})', 1)) AS INT) AS p FROM np),
hh AS (SELECT source, CAST(number // 5 % 9 AS VARCHAR) || '.1' AS no, min(number) AS "to" FROM np WHERE number % 5 = 0 GROUP BY 1, 2),
re AS (SELECT DISTINCT a.slug AS src, b.slug AS dst FROM rr JOIN o ON o.source = rr.source AND o.r = 1 JOIN ow a ON a.source = rr.source AND a.number = rr.number JOIN ow b ON b.source = rr.source AND b.number = rr.p + o."offset" WHERE a.slug <> b.slug
UNION SELECT a.slug, b.slug FROM np JOIN hh ON hh.source = np.source AND no = CAST(np.number % 9 AS VARCHAR) || '.1' JOIN ow a ON a.source = np.source AND a.number = np.number JOIN ow b ON b.source = np.source AND b.number = "to" WHERE a.slug <> b.slug),
edges AS (SELECT slug AS src, parent_slug AS dst, 'CHILD_OF' AS rel, CAST(NULL AS DOUBLE) AS score FROM wp WHERE parent_slug IS NOT NULL
UNION ALL SELECT slug, nx, 'NEXT', NULL FROM (SELECT slug, lead(slug) OVER (PARTITION BY source ORDER BY i) AS nx FROM wp) WHERE nx IS NOT NULL UNION ALL SELECT id, page, 'PART_OF', NULL FROM u
UNION ALL SELECT src, dst, 'SIMILAR_TO', s FROM si UNION ALL SELECT src, dst, 'REFERENCES', NULL FROM re UNION ALL SELECT page, entity, 'MENTIONS', NULL FROM me)"""


def _whole(sql: str) -> str:
    """A knowledge graph's SQL with entities of whole texts."""
    return sql.replace("left(text, 8000)", "text")


@query(_whole(f"WITH {_KG} SELECT src, dst, rel, round(score, 6) AS score FROM edges"))
def kg_edges(spark, sf_dir):
    return knowledge_graph(spark, sf_dir).edges.select("src", "dst", "rel", F.round("score", 6).alias("score"))


@query(_whole(f"WITH {_WP}, {_ENT} SELECT key, arg_min(name, {{'i': i, 's': slug, 'a': pos}}) AS name, 'Feature' AS type FROM ev GROUP BY 1"))
def kg_entities(spark, sf_dir):
    return build(spark, sf_dir).entities


@query(_whole(f"WITH {_KG} SELECT rel, count(*) AS n FROM edges GROUP BY 1 UNION ALL SELECT 'Page', count(*) FROM wp UNION ALL SELECT 'Chunk', count(*) FROM u UNION ALL SELECT 'Entity', count(DISTINCT key) FROM ev"))
def kg_stats(spark, sf_dir):
    g = knowledge_graph(spark, sf_dir)
    nodes = [df.agg(F.lit(n).alias("rel"), F.count("*").alias("n")) for n, df in (("Page", g.pages), ("Chunk", g.chunks), ("Entity", g.entities))]
    return graph.stats(g.edges).unionByName(nodes[0]).unionByName(nodes[1]).unionByName(nodes[2])


_FLAGS = "pd AS (SELECT p, count(*) AS d FROM (SELECT src AS p FROM edges WHERE rel IN ('SIMILAR_TO', 'REFERENCES') UNION ALL SELECT dst FROM edges WHERE rel IN ('SIMILAR_TO', 'REFERENCES')) GROUP BY 1)"


@query(f"WITH {_KG}, {_FLAGS}, fl AS (SELECT slug, coalesce(d, 0) AS d, slug IN (SELECT src FROM si UNION SELECT dst FROM si) AS sim, slug IN (SELECT page FROM me) AS ent FROM wp LEFT JOIN pd ON p = slug) SELECT count(*) AS pages, count(*) FILTER (NOT sim) AS no_similar, count(*) FILTER (NOT ent) AS no_entities, count(*) FILTER (NOT ent AND d = 0) AS orphans, round(avg(d), 2) AS avg_degree FROM fl")
def kg_health(spark, sf_dir):
    g = knowledge_graph(spark, sf_dir)
    return graph.health(g.pages.select(F.col("slug").alias("page")), g.edges, build(spark, sf_dir).begun)


@query(f"WITH {_KG}, {_FLAGS} SELECT slug AS page, coalesce(d, 0) AS degree FROM wp LEFT JOIN pd ON p = slug ORDER BY degree DESC, page LIMIT 12")
def kg_hub_pages(spark, sf_dir):
    g = knowledge_graph(spark, sf_dir)
    return graph.hub_pages(g.pages.select(F.col("slug").alias("page")), g.edges)


@query(f"""WITH {_KG}, sh AS (SELECT a.page AS a, b.page AS b, count(*) AS n FROM me a JOIN me b ON a.entity = b.entity AND a.page <> b.page GROUP BY 1, 2),
ry AS (SELECT src, dst AS node, 0 AS g, 0.0 AS o FROM edges WHERE rel = 'CHILD_OF' UNION ALL SELECT dst, src, 1, 0 FROM edges WHERE rel = 'CHILD_OF' UNION ALL SELECT dst, src, 2, 0 FROM edges WHERE rel = 'NEXT' UNION ALL SELECT src, dst, 3, 0 FROM edges WHERE rel = 'NEXT'
UNION ALL SELECT src, dst, 4, 0 FROM edges WHERE rel = 'REFERENCES' UNION ALL SELECT dst, src, 5, 0 FROM edges WHERE rel = 'REFERENCES' UNION ALL SELECT a, b, 6, -n FROM sh UNION ALL SELECT src, dst, 7, -score FROM edges WHERE rel = 'SIMILAR_TO'),
kk AS (SELECT *, row_number() OVER (PARTITION BY src, g ORDER BY o, node) AS k FROM ry)
SELECT src, node, (['parent', 'child', 'prev', 'next', 'references', 'referenced_by', 'shared_entity', 'similar'])[min(g) + 1] AS rel FROM kk WHERE k <= CASE g WHEN 4 THEN 8 WHEN 5 THEN 6 WHEN 6 THEN 6 WHEN 7 THEN 6 ELSE 1000000000 END GROUP BY 1, 2""")
def kg_neighborhood(spark, sf_dir):
    g = knowledge_graph(spark, sf_dir)
    return graph.neighborhood(g.edges, build(spark, sf_dir).begun)


@query(f"""WITH {_CH.format(key="doc_id", windows=_WINDOWS.format(key="doc_id", table="documents"))}, qu AS (SELECT item_id AS qid, {_EMBED} FROM benchmark))),
sc AS (SELECT qid, CAST(doc_id AS VARCHAR) AS page, CAST(doc_id AS VARCHAR) || '#' || CAST(i AS VARCHAR) AS id, round(list_dot_product(v, list_transform(e, lambda x: CAST(x AS DOUBLE) / sqrt(list_dot_product(CAST(e AS DOUBLE[]), CAST(e AS DOUBLE[]))))), 12) AS s FROM ch, qu)
SELECT qid, id, page, round(s, 6) AS score, CAST(m AS INT) AS marker FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS m FROM sc) WHERE m <= 5""")
def bow_retrieve_topk(spark, sf_dir):
    """From texts to answers' sources: an index over all documents, and the five best chunks for each benchmark text."""
    zero = F.lit(0)
    pages_ = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("slug"), F.lit("").alias("title"), zero.alias("page_start"), zero.alias("page_end"), "text")
    index = indexing.Index.build(pages_, indexing.WordCounts(VOCABULARY))
    index = indexing.Index(written(index.chunks, "chunks"), index.embedder)
    asked = written(index.questions(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.coalesce("text", F.lit("")).alias("question"))), "questions")
    return retrieve.seeds(asked, index.chunks, 5).select("qid", "id", "page", F.round("score", 6).alias("score"), F.col("marker").cast("int").alias("marker"))


@query(r"""WITH s AS (SELECT doc_id, regexp_replace('# Part' || chr(10) || regexp_replace(text, '^\s+|\s+$', '', 'g') || chr(10) || '## More #' || chr(10) || '```' || chr(10) || '# no' || chr(10) || '```' || chr(10), '\r\n?', chr(10), 'g') AS t FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM s), f AS (SELECT *, regexp_matches(line, '^[ \t\x0B\f]*(```|~~~)') AS fence FROM l),
g AS (SELECT *, sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY pos) % 2 AS inside FROM f), h AS (SELECT *, inside = 0 AND NOT fence AND regexp_matches(line, '^(#{1,6})\s+(.*?)\s*#*\s*$') AS head FROM g),
i AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS sec FROM h),
j AS (SELECT doc_id, sec, max(CASE WHEN head THEN length(regexp_extract(line, '^(#{1,6})\s', 1)) END) AS level, max(CASE WHEN head THEN regexp_extract(line, '^(#{1,6})\s+(.*?)\s*#*\s*$', 2) END) AS title, regexp_replace(string_agg(line, chr(10) ORDER BY pos), '^\s+|\s+$', '', 'g') AS text FROM i GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sec) AS number FROM j WHERE title IS NOT NULL OR text <> '')
SELECT CAST(doc_id AS VARCHAR) AS source, CAST(number AS INT) AS number, text, title, CAST(level AS INT) AS level FROM k WHERE title IS NOT NULL""")
def markdown_documents(spark, sf_dir):
    """Whole documents, whatever marks they hold, as Markdown below a heading, with a second section whose fence holds a mark that is none, to pages and outline."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"), F.concat(F.lit("# Part\n"), T.strip(F.col("text")), F.lit("\n## More #\n```\n# no\n```\n")).alias("text"))
    d = documents.markdown_documents(texts)
    return d.pages.join(d.outline.select("source", F.col("page").alias("number"), "title", "level"), ["source", "number"]).select("source", "number", "text", "title", "level")
