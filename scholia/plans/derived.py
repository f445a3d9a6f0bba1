"""Named queries over merged documents, outlines, rendered pages, retriever pairs, paths and closures, and models' replies. Each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import entities, evaluate, graph, render, restructure, retrieve, vector
from ..streaming import upsert
from .catalog import _CENTROIDS, _DP, _EDGES, _NUM, _OL, _STRIP, _TREE, _UNIT, chunk_rows, cuts, edge_rows, numbered, outline, page_tree, pages, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


_SUMS = "n AS (SELECT source, count(*) AS n FROM dp GROUP BY 1), off AS (SELECT source, CAST(coalesce(sum(n) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS off FROM n)"


@query(f"WITH {_DP}, {_SUMS} SELECT source, CAST(number + off AS INT) AS number, text FROM dp JOIN off USING (source)")
def merged_pages(spark, sf_dir):
    return restructure.merge(pages(spark, sf_dir), outline(spark, sf_dir))[0].select("source", "number", "text")


@query(f"""WITH {_DP}, {_OL}, {_SUMS} SELECT source, CAST(ord AS INT) AS ord, CAST(level + 1 AS INT) AS level, title, CAST(CASE WHEN page > 0 THEN page + off ELSE -1 END AS INT) AS page FROM ol JOIN off USING (source)
UNION ALL SELECT source, -1, 1, source, off + 1 FROM off""")
def merged_outline(spark, sf_dir):
    return restructure.merge(pages(spark, sf_dir), outline(spark, sf_dir))[1].select("source", "ord", "level", "title", "page")


@query(rf"""WITH {_NUM}, l AS (SELECT source, number, list_slice(list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r\x0b\x0c]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), 1, 4) AS ls FROM np),
e AS (SELECT source, number, unnest(ls) AS raw, generate_subscripts(ls, 1) AS line FROM l),
f AS (SELECT source, number, line, regexp_extract(raw, '^(\d+(?:\.\d+)*)\s+(\p{{L}}.*)$', 1) AS no, regexp_replace(regexp_extract(raw, '^(\d+(?:\.\d+)*)\s+(\p{{L}}.*)$', 2), '\s+\d{{1,4}}$', '') AS title FROM e),
g AS (SELECT source, no, lower(title) AS k, min({{'p': number, 'l': line, 't': title}}) AS f, len(string_split(no, '.')) AS depth FROM f WHERE no <> '' AND length(title) >= 3 AND NOT regexp_matches(title, '[.,:;]$') GROUP BY source, no, lower(title)),
d AS (SELECT source, depth, count(*) AS c FROM g GROUP BY 1, 2), pick AS (SELECT source, coalesce(min(depth) FILTER (c >= 2), min(depth)) AS depth FROM d GROUP BY 1),
h AS (SELECT g.*, row_number() OVER (PARTITION BY source ORDER BY f.p, f.l, no) - 1 AS ord, count(*) OVER (PARTITION BY source) AS n FROM g JOIN pick USING (source, depth))
SELECT source, CAST(ord AS INT) AS ord, 1 AS level, no || ' ' || f.t AS title, f.p AS page FROM h WHERE n >= 3""")
def outline_synthesis(spark, sf_dir):
    """Outlines of all documents from the numbered headers of their pages."""
    return restructure.synthesize_outline(numbered(spark, sf_dir))


_LINK = "'[' || {0}.title || '](' || {0}.slug || '.md)'"


@query(f"""WITH {_TREE}, tx AS (SELECT c.source, c.i, coalesce(string_agg({_STRIP}, chr(10) || chr(10) ORDER BY number) FILTER ({_STRIP} <> ''), '') AS text FROM cut c LEFT JOIN dp ON dp.source = c.source AND number >= page AND number < next_page GROUP BY 1, 2),
ch AS (SELECT source, parent AS i, list('- ' || {_LINK.format("tr")} ORDER BY i) AS c FROM tr WHERE parent IS NOT NULL GROUP BY 1, 2),
su AS (SELECT c.source, c.i, list(repeat('  ', greatest(0, o.level - c.level - 1)) || '- ' || o.title ORDER BY o.ord) AS s FROM cut c JOIN ol o ON o.source = c.source AND o.page >= c.page AND o.page < c.next_page AND o.ord <> c.ord GROUP BY 1, 2),
nb AS (SELECT t.*, lag('← ' || {_LINK.format("t")}) OVER w AS b, lead({_LINK.format("t")} || ' →') OVER w AS a FROM tr t WINDOW w AS (PARTITION BY source ORDER BY i)),
p AS (SELECT nb.*, CASE WHEN q.i IS NOT NULL THEN {_LINK.format("q")} END AS up, c, s, text FROM nb LEFT JOIN tr q ON q.source = nb.source AND q.i = nb.parent LEFT JOIN ch ON ch.source = nb.source AND ch.i = nb.i LEFT JOIN su ON su.source = nb.source AND su.i = nb.i JOIN tx ON tx.source = nb.source AND tx.i = nb.i)
SELECT source, i, slug, array_to_string(['# ' || title, '', '{render.HOME}{render.TRAIL}' || coalesce(up || '{render.TRAIL}', '') || title, '', '*PDF pages ' || page_start || '–' || page_end || '*', '']
|| CASE WHEN c IS NOT NULL THEN ['**Subpages**', ''] || c || [''] ELSE [] END || CASE WHEN s IS NOT NULL THEN ['**Contents**', ''] || s || [''] ELSE [] END || ['---', ''] || CASE WHEN text <> '' THEN [text, ''] ELSE [] END
|| ['', '---', '', CASE WHEN coalesce(b, up, a) IS NULL THEN '{render.HOME}' ELSE concat_ws('{render.NAV}', b, '↑ ' || up, a) END, ''], chr(10)) AS markdown FROM p""")
def rendered_pages(spark, sf_dir):
    """All wiki pages as Markdown: trail, subpages, contents, text, navigation."""
    return render.page_markdown(page_tree(spark, sf_dir), restructure.subsections(cuts(spark, sf_dir), outline(spark, sf_dir)))


_PAGED = f"u AS (SELECT id, id // 25 AS page, v FROM ({_UNIT})), q AS (SELECT id AS qid, v AS q FROM u WHERE id % 100 = 0), s AS (SELECT qid, id, page, round(list_dot_product(v, q), 12) AS s FROM u, q)"
_FIRST = "(SELECT qid, page, row_number() OVER (PARTITION BY qid ORDER BY m) AS rank FROM (SELECT qid, page, min(m) AS m FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS m FROM s) WHERE m <= {k} GROUP BY 1, 2))"


def paged_chunks(spark, sf_dir) -> DataFrame:
    """Vectors as chunks of pages of 25."""
    return chunk_rows(spark, sf_dir).withColumn("page", F.expr("id div 25"))


def asked(chunks: DataFrame) -> DataFrame:
    return chunks.filter("id % 100 = 0").select(F.col("id").alias("qid"), "emb")


@query(f"WITH {_PAGED} SELECT qid, page, CAST(rank AS INT) AS rank FROM {_FIRST.format(k=48)} WHERE rank <= 8")
def semantic_pages(spark, sf_dir):
    c = paged_chunks(spark, sf_dir)
    return retrieve.semantic_pages(asked(c), c, 8).select("qid", "page", F.col("rank").cast("int").alias("rank"))


@query(f"""WITH {_PAGED}, {_CENTROIDS}, sp AS (SELECT a.page AS src, b.page AS node, round(list_dot_product(a.v, b.v), 12) AS s FROM ce a JOIN ce b ON a.page <> b.page), ne AS (SELECT src, node FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY s DESC, node) AS r FROM sp WHERE s > 0) WHERE r <= 6),
one AS (SELECT qid, page, rank FROM {_FIRST.format(k=30)} WHERE rank <= 5), sd AS (SELECT qid, page, rank FROM {_FIRST.format(k=30)} WHERE rank <= 3), ca AS (SELECT DISTINCT qid, node AS page FROM sd JOIN ne ON src = page EXCEPT SELECT qid, page FROM sd),
be AS (SELECT s.qid, s.page, max(s.s) AS s, min(id) AS id FROM s JOIN ca ON ca.qid = s.qid AND ca.page = s.page JOIN (SELECT qid, page, max(s) AS top FROM s GROUP BY 1, 2) t ON t.qid = s.qid AND t.page = s.page AND t.top = s.s GROUP BY 1, 2),
nd AS (SELECT qid, count(*) AS n FROM sd GROUP BY 1), two AS (SELECT qid, page, rank FROM sd UNION ALL SELECT qid, page, n + r FROM (SELECT be.*, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS r FROM be) JOIN nd USING (qid) WHERE r <= 2),
al AS (SELECT 'RAG' AS system, * FROM one UNION ALL SELECT 'GraphRAG', * FROM two), it AS (SELECT qid, [qid // 25, qid // 25 + 1] AS expected FROM q),
m AS (SELECT system, qid, coalesce(1.0 / min(rank) FILTER (list_contains(expected, page)), 0) AS rr, count(*) FILTER (rank <= 5 AND list_contains(expected, page)) AS hits FROM it JOIN al USING (qid) GROUP BY 1, 2)
SELECT system, count(*) AS n, round(avg(rr), 6) AS mrr, round(avg(CAST(hits > 0 AS INT)), 6) AS hit_rate, round(avg(hits / 2), 6) AS recall FROM m GROUP BY 1""")
def retriever_pair(spark, sf_dir):
    """Both retrievers with a budget of five pages, by meaning alone and by meaning and graph, held against the pages that are expected for each question."""
    c = paged_chunks(spark, sf_dir)
    edges = vector.similar(vector.centroids(c).withColumnRenamed("page", "id")).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("SIMILAR_TO").alias("rel"), "score")
    near = graph.neighborhood(edges, c.select("page", F.col("id").alias("entity")).limit(0))
    own = F.expr("qid div 25")
    items = asked(c).withColumn("expected", F.array(own, own + 1))
    reports = []
    for system, f in zip(("RAG", "GraphRAG"), retrieve.retrievers(c, near, 3, 2), strict=True):
        _, report = evaluate.evaluate(items, f, 5)
        reports.append(report.select(F.lit(system).alias("system"), "n", *[F.round(x, 6).alias(x) for x in ("mrr", "hit_rate", "recall")]))
    return reports[0].unionByName(reports[1])


@query("""WITH a AS (SELECT doc_id AS qid, [1 + doc_id % 4, 3, 9] AS marks, list_distinct(['p' || (doc_id % 6), 'p' || (doc_id % 5)]) AS expected FROM documents), s AS (SELECT doc_id AS qid, m AS marker, 'p' || ((doc_id + m) % 6) AS page FROM documents, range(1, 5) t(m)),
c AS (SELECT a.qid, expected, list_distinct(list(page)) AS pages FROM a JOIN s ON s.qid = a.qid AND list_contains(marks, marker) GROUP BY 1, 2)
SELECT qid, len(list_intersect(pages, expected)) > 0 AS cite_hit, round(len(list_intersect(pages, expected)) / len(expected), 6) AS expected_recall FROM c""")
def grounding(spark, sf_dir):
    """Which expected pages answers cite: an answer to each document's text, with three marks of which one names nothing."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), "text")
    page = lambda n: F.concat(F.lit("p"), n.cast("string"))
    answers = d.select("qid", F.concat(F.lit("["), (1 + F.col("qid") % 4).cast("string"), F.lit("] and "), F.substring("text", 1, 0), F.lit("[3], [9]")).alias("text"), F.array_distinct(F.array(page(F.col("qid") % 6), page(F.col("qid") % 5))).alias("expected"))
    sources = d.select("qid", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("marker")).withColumn("page", page((F.col("qid") + F.col("marker")) % 6))
    return evaluate.grounding(answers, sources).select("qid", "cite_hit", F.round("expected_recall", 6).alias("expected_recall"))


@query(f"""WITH u AS ({_UNIT}), {_CENTROIDS}, s AS (SELECT ce.page AS src, u.page AS dst, u.id, round(list_dot_product(ce.v, u.v), 12) AS s FROM ce, u WHERE ce.page % 3 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY s DESC, id) AS k FROM s), m AS (SELECT src, dst, max(s) AS s FROM k WHERE k <= 36 AND src <> dst GROUP BY 1, 2)
SELECT src, dst, round(greatest(s, 0), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) AS r FROM m) WHERE r <= 6""")
def nearest_pages(spark, sf_dir):
    """Pages next to every third page by their nearest chunks, as an edit of these would make them."""
    c = chunk_rows(spark, sf_dir)
    return upsert.nearest_pages(c, c.filter("page % 3 = 0").select("page").distinct()).select("src", "dst", F.round("score", 6).alias("score"))


@query("SELECT p_type AS type, count(*) AS n FROM part GROUP BY 1")
def entity_types(spark, sf_dir):
    return graph.entity_types(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_type").alias("type")))


@query(f"""WITH RECURSIVE {_EDGES}, b AS (SELECT src, dst, min(rel) AS rel FROM (SELECT src, dst, rel FROM edges UNION ALL SELECT dst, src, rel FROM edges) WHERE src <> dst GROUP BY 1, 2),
w(a, z, node, path, rels, h) AS (SELECT s, s * 37 % m + 1, s, [s], []::VARCHAR[], 0 FROM s, m WHERE s % 10 = 0 UNION ALL SELECT a, z, b.dst, list_append(path, b.dst), list_append(rels, b.rel), h + 1 FROM w JOIN b ON b.src = w.node WHERE h < 4 AND w.node <> z AND NOT list_contains(path, b.dst)),
r AS (SELECT *, row_number() OVER (PARTITION BY a, z ORDER BY h, path) AS r FROM w WHERE node = z)
SELECT s AS a, s * 37 % m + 1 AS b, CAST(h AS INT) AS hops, array_to_string(path, ' ') AS nodes, array_to_string(rels, ' ') AS rels FROM s CROSS JOIN m LEFT JOIN r ON r.r = 1 AND r.a = s AND r.z = s * 37 % m + 1 WHERE s % 10 = 0""")
def path_pairs(spark, sf_dir):
    """Shortest paths of up to four steps between many pairs of pages, with the relation of each step."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("a"))
    last = s.agg(F.max("a")).first()[0] or 1
    pairs = s.filter("a % 10 = 0").withColumn("b", F.col("a") * 37 % last + 1)
    found = graph.paths(edge_rows(spark, sf_dir), pairs, 4)
    return found.select("a", "b", F.col("hops").cast("int").alias("hops"), F.array_join(F.transform("nodes", lambda x: x.cast("string")), " ").alias("nodes"), F.array_join("rels", " ").alias("rels"))


@query(f"""WITH RECURSIVE {_EDGES}, c AS (SELECT src, dst FROM edges WHERE rel = 'CHILD_OF'), up(node, ancestor, depth) AS (SELECT src, dst, 1 FROM c UNION ALL SELECT node, c.dst, depth + 1 FROM up JOIN c ON c.src = up.ancestor) SELECT node, ancestor, CAST(depth AS INT) AS depth FROM up""")
def page_ancestry(spark, sf_dir):
    """Ancestors of all pages, and so descendants too."""
    return graph.ancestry(edge_rows(spark, sf_dir).filter("rel = 'CHILD_OF'").select(F.col("src").alias("node"), F.col("dst").alias("parent")))


#: Replies as models give them: clean, with talk around, of mixed elements, with nested values, broken, empty. {a} and {b} stand for words of the document.
REPLIES = (
    '[{{"name": "{a}", "type": "Tool"}}, {{"name": "{b}", "type": "Part"}}]',
    '<think>[{{"name": "no", "type": "Tool"}}]</think>Here: ```json\n[{{"type": "Tool", "name": " {a} "}}]\n```',
    '[1, "x", null, ["y"], {{"name": "{a}", "type": "Tool", "more": {{"k": [1]}}}}, {{"name": 7, "type": "Tool"}}, {{"name": "{b}"}}, {{"name": "{b}", "type": "None"}}]',
    '[{{"name": "{a}", "type": "Tool"}}, {{"name": "{b}", ',
    '{{"name": "{a}", "type": "Tool"}}',
    "none [] here",
    'a [1] b [{{"name": "{a}", "type": "Part"}}]',
    '[{{"name": "{a}", "type": ["Tool"]}}, {{"name": {{"x": 1}}, "type": "Part"}}, {{"name": "\\u0041{b}", "type": "Part"}}]',
)


def _reply_sql() -> str:
    each = " ".join(f"WHEN {k} THEN '" + r.format(a="#a#", b="#b#").replace("'", "''") + "'" for k, r in enumerate(REPLIES))
    return rf"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+') AS w FROM documents),
r AS (SELECT doc_id, replace(replace(CASE doc_id % {len(REPLIES)} {each} END, '#a#', coalesce(w[1], 'Aa')), '#b#', coalesce(w[-1], 'Bb')) AS reply FROM d),
s AS (SELECT doc_id, regexp_extract(regexp_replace(reply, '(?s)<think>.*?</think>', '', 'g'), '(?s)\[.*\]') AS span FROM r),
x AS (SELECT doc_id, unnest(json_extract(span, '$[*]')) AS x FROM s WHERE span <> '' AND json_valid(span))
SELECT doc_id, trim(json_extract_string(x, '$.name')) AS name, json_extract_string(x, '$.type') AS type FROM x WHERE json_type(x) = 'OBJECT' AND json_type(x, '$.name') = 'VARCHAR' AND json_type(x, '$.type') = 'VARCHAR' AND json_extract_string(x, '$.type') IN ('Tool', 'Part')"""


@query(_reply_sql())
def reply_entities(spark, sf_dir):
    """What eight kinds of replies name, clean and malformed ones."""
    w = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), F.lit(0))
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.try_element_at(w, F.lit(1)), F.lit("Aa")).alias("a"), F.coalesce(F.try_element_at(w, F.lit(-1)), F.lit("Bb")).alias("b"))
    reply = F.array(*[F.lit(r.format(a="#a#", b="#b#")) for r in REPLIES])
    said = F.replace(F.replace(F.get(reply, (F.col("doc_id") % len(REPLIES)).cast("int")), F.lit("#a#"), F.col("a")), F.lit("#b#"), F.col("b"))
    return d.select("doc_id", F.explode(entities.reply_entities(said, ["Tool", "Part"])).alias("e")).select("doc_id", "e.name", "e.type")
