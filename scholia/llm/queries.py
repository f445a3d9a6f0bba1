"""The operators' queries on the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, filteraudit, hilbert, langid, licenses, lmscore, neardup, packing, repair, repeats, tokencounts, vptree, warc

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark, sf_dir):
    return langid.digest(table(spark, sf_dir, "documents"))


def op2_vantage_point_search(spark, sf_dir):
    return vptree.nearest(table(spark, sf_dir, "embeddings"), k=20, every=20, factor=1.0)


def op3_suffix_dedup(spark, sf_dir):
    return repeats.digest(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_decontamination(spark, sf_dir):
    return decontam.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_minhash_neardup(spark, sf_dir):
    return neardup.classes(table(spark, sf_dir, "documents"), k=3, percent=85)


def op7_license_scan(spark, sf_dir):
    return licenses.digest(table(spark, sf_dir, "documents"))


def op8_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_lm_scoring(spark, sf_dir):
    return lmscore.fit_and_score(table(spark, sf_dir, "documents"))


def op10_token_counts(spark, sf_dir):
    return tokencounts.token_counts(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark, sf_dir):
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_hilbert_sharding(spark, sf_dir):
    return hilbert.digest(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark, sf_dir):
    return repair.digest(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_vantage_point_search, op3_suffix_dedup, op4_best_fit_packing, op5_decontamination, op6_minhash_neardup, op7_license_scan, op8_warc, op9_lm_scoring, op10_token_counts, op11_filter_audit, op12_hilbert_sharding, op13_conversation_repair)}

_OP5 = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS k FROM (SELECT item_id, {WORDS} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i + 1, i + k), ' ') AS s FROM (SELECT *, unnest(range(len(w) - k + 1)) AS i FROM b)),
dw AS (SELECT doc_id, i, k, array_to_string(list_slice(w, i + 1, i + k), ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM b) WHERE len(w) >= k)),
h AS (SELECT doc_id, item_id, i, dw.k FROM dw JOIN bw ON dw.k = bw.k AND dw.s = bw.s),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_OP6 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i + 1, i + 3), ' ') AS s FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 2, least(len(w), 1)))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, w.doc_id = c AS kept FROM w JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def _op7_sql() -> str:
    places = lambda phrase: f"((length(j) - length(replace(j, '{p}', ''))) // {len(p)})" if (p := "".join(f" {w} " for w in phrase.split())) else ""
    base, own = licenses.BASE, [p for _, keys in licenses.TEMPLATES for p in keys]
    names = lambda some: "array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN {' AND '.join(f'{places(p)} > 0' for p in keys)} THEN '{x}' END" for x, keys in some) + "], lambda x: x IS NOT NULL))), ',')"
    plain = [(label, (phrase,)) for phrase, label in base]
    starts = "list_concat(" + ", ".join(f"list_filter(range(len(w)), lambda i: list_slice(w, i + 1, i + {len(p.split())}) = [{', '.join(repr(x) for x in p.split())}])" for p, _ in base) + ")"
    count = lambda some: " + ".join(places(p) for p in some)
    return f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
j AS (SELECT doc_id, w, CASE WHEN len(w) > 0 THEN ' ' || array_to_string(w, '  ') || ' ' ELSE '' END AS j FROM d),
p AS (SELECT *, CASE WHEN {count([p for p, _ in base])} > 0 THEN {starts} END AS s FROM j)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST({count([p for p, _ in base])} AS BIGINT) AS n_base, CAST(list_min(s) AS BIGINT) AS first_word, CAST(list_max(s) AS BIGINT) AS last_word,
{names(plain)} AS base_labels, {names([*plain, *licenses.TEMPLATES])} AS labels, 1 - pow(CAST(0.5 AS DOUBLE), {count([*(p for p, _ in base), *own])}) AS score FROM p
"""


_OP8 = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""

_OP2 = r"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

_OP11 = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
d AS (SELECT doc_id, part, len(w) AS n, len(list_distinct(w)) AS k, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS caps, length(text) AS chars, regexp_matches(text, '[#$%&*|]') AS marks, min(doc_id) OVER (PARTITION BY text) AS first FROM w),
l AS (SELECT doc_id, coalesce(max(CAST(quality = 1 AS INT)), 0) AS good, coalesce(max(CAST(toxic = 1 AS INT)), 0) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, (n < 50)::INT + 2 * (100 * k < 65 * n)::INT + 4 * (100 * caps > 5 * chars)::INT + 8 * marks::INT + 16 * coalesce(first < d.doc_id, false)::INT AS m, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, m, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
f AS (SELECT unnest(range(5)) AS f),
o AS (SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT o, k, o[k] AS f, CAST(list_sum(list_transform(list_slice(o, 1, k - 1), lambda x: 1 << x)) AS INT) AS before FROM o, (SELECT unnest(range(1, 6)) AS k)),
r AS (SELECT part, o, k, f, sum(n) FILTER (m & (coalesce(before, 0) | (1 << f)) = 0) AS kept, sum(n) FILTER (m & (1 << f) <> 0 AND m & coalesce(before, 0) = 0) AS removed, sum(n) FILTER (m & (1 << f) <> 0 AND m & coalesce(before, 0) <> 0) AS redundant,
sum(n) FILTER (m = 1 << f) AS unique_fails, sum(good) FILTER (m & (1 << f) <> 0 AND m & coalesce(before, 0) = 0) AS good_lost, sum(toxic) FILTER (m & (1 << f) <> 0 AND m & coalesce(before, 0) = 0) AS toxic_lost FROM c, s GROUP BY 1, 2, 3, 4)
SELECT part, array_to_string(list_transform(o, lambda x: substr('ABCDE', x + 1, 1)), '') AS filter_order, CAST(k AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
"""


def _crc32(bytes_: str) -> str:
    """SQL for the CRC-32 of a list of bytes; the table follows from the polynomial."""
    table = [0] * 256
    for i in range(256):
        x = i
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        table[i] = x
    return f"xor(list_reduce({bytes_}, lambda h, b: xor(h >> 8, ({table}::BIGINT[])[(xor(h, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"


def _op12_sql(shards: int = 24, bits: int = 5) -> str:
    n, top = len(hilbert.DIMS), 1 << bits
    level = lambda k: " + ".join(f"((((codes[{j + 1}] >> {k}) & 1)) << {j})" for j in range(n))
    walk = f"list_reduce([{', '.join(level(k) for k in range(bits - 1, -1, -1))}]::BIGINT[], lambda a, b: list_transform([({hilbert.moves(n)}::BIGINT[])[(((a >> 40) << {n}) + b) + 1]], lambda m: ((m >> {n}) << 40) | (((a & 1099511627775) << {n}) + (m & {(1 << n) - 1})))[1], 0::BIGINT) & 1099511627775"
    linear = lambda c: f"coalesce((({c})::HUGEINT - min({c}) OVER ()) * {top} // (max({c}) OVER () - min({c}) OVER () + 1), 0)::BIGINT"
    rank = lambda c: f"((dense_rank() OVER (ORDER BY {c} NULLS FIRST) - 1) * {top} // (SELECT count(*) FROM (SELECT DISTINCT {c} FROM documents)))::BIGINT"
    return f"""
WITH b AS (SELECT doc_id, lang, source, octet_length(encode(coalesce(text, ''))) + 8 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, lang, source, size, length(bin(size * size)) AS octaves, {_crc32("list_transform(regexp_extract_all(h, '..'), lambda x: CAST('0x' || x AS BIGINT))")} AS crc FROM b),
c AS (SELECT *, [{rank('lang')}, {rank('source')}, {linear('octaves')}, {linear('doc_id')}] AS codes FROM s),
v AS (SELECT *, {walk} AS curve FROM c),
r AS (SELECT *, row_number() OVER (ORDER BY curve, crc, doc_id) - 1 AS rank, count(*) OVER () AS total FROM v),
p AS (SELECT *, rank * {shards} // total AS shard FROM r)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, CAST(shard AS INT) AS shard, CAST(rank - (shard * total + {shards - 1}) // {shards} AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM p
"""


_OP13 = rf"""
WITH k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: ascii(c))::BIGINT[] AS key FROM conversations),
f AS (SELECT *, {_crc32("key")} % 20 AS fault FROM k),
g AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE fault WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM f WHERE fault <> 0),
h AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS met, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank FROM g),
r AS (SELECT *, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair, blank OR met > 1 AS gone, left(role, 1) AS a, CAST(CASE WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 0 ELSE 3 END AS BIGINT) AS t FROM h),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND met > 1) AS duplicate, count(*) FILTER (NOT gone AND t > 0) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
list(struct_pack(gone := gone, a := a, t := t, line := role || ':' || text, text := text) ORDER BY i DESC) AS rows FROM r GROUP BY 1),
e AS (SELECT [struct_pack(c := 0::BIGINT, s := '', l := []::VARCHAR[]), struct_pack(c := 6::BIGINT, s := 'II', l := ['user:', 'assistant:']), struct_pack(c := 3::BIGINT, s := 'I', l := ['assistant:']), struct_pack(c := 0::BIGINT, s := '', l := []::VARCHAR[])] AS e),
x AS (SELECT c.*, list_reduce(rows, lambda v, r: list_transform([list_transform([1, 2, 3, 4], lambda q: list_min([struct_pack(c := v[q].c + 4, s := 'D' || v[q].s, l := v[q].l)]
 || CASE WHEN r.gone THEN [] ELSE [struct_pack(c := v[([3, 3, 4, 3])[q]].c + 3 + r.t, s := 'R' || v[([3, 3, 4, 3])[q]].s, l := list_prepend((['user:', 'user:', 'assistant:', 'user:'])[q] || r.text, v[([3, 3, 4, 3])[q]].l))] END
 || CASE WHEN r.gone OR NOT ((q = 1 AND r.a = 's') OR (q <> 3 AND r.a = 'u') OR (q = 3 AND r.a = 'a')) THEN [] ELSE [struct_pack(c := v[CASE r.a WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].c + r.t, s := 'K' || v[CASE r.a WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].s, l := list_prepend(r.line, v[CASE r.a WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].l))] END))],
 lambda b: list_transform([[least(b[3], struct_pack(c := b[4].c + 3, s := 'I' || b[4].s, l := list_prepend('assistant:', b[4].l))), least(b[4], struct_pack(c := b[3].c + 3, s := 'I' || b[3].s, l := list_prepend('user:', b[3].l)))]],
 lambda z: [least(b[1], struct_pack(c := z[1].c + 3, s := 'I' || z[1].s, l := list_prepend('user:', z[1].l))), least(b[2], struct_pack(c := z[1].c + 3, s := 'I' || z[1].s, l := list_prepend('user:', z[1].l))), z[1], z[2]])[1])[1], e)[1] AS x FROM c, e)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(x.x.c, 0) AS cost, coalesce(x.x.s, '') AS audit, sha256(coalesce(array_to_string(x.x.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN x ON o.conv_id IS NOT DISTINCT FROM x.conv_id
"""


SQL = {"op11_filter_audit": _OP11, "op12_hilbert_sharding": _op12_sql(), "op13_conversation_repair": _OP13, "op2_vantage_point_search": _OP2, "op8_warc": _OP8, "op5_decontamination": _OP5, "op6_minhash_neardup": _OP6, "op7_license_scan": _op7_sql()}
