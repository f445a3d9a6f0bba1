"""What grows faster than its input in a plain form: similar pages, shared entities, best chunks. Against brute force, on small blocks."""

import collections

import numpy as np
from pyspark.sql import functions as F

from scholia.operators import graph, retrieve, vector


def test_similar_pages_of_a_root_with_many_children(spark):
    rng = np.random.default_rng(3)
    v = np.round(rng.random((400, 4)), 1) + 0.1
    v[100:300] = v[7]  # equal vectors
    ids = [f"p{i:03d}" for i in range(400)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v, strict=True)], "id string, emb array<double>")
    ties = [(ids[0], x) for x in ids[1:350]] + [(x, ids[0]) for x in ids[1:350]]
    found = vector.similar(df, 3, block=64, structural=spark.createDataFrame(ties, "a string, b string")).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims, out = np.round(u @ u.T, 12), set(ties)
    for i, a in enumerate(ids):
        order = sorted((-sims[i, j], b) for j, b in enumerate(ids) if j != i and (a, b) not in out and sims[i, j] > 0)[:3]
        assert [(r.rank, r.b) for r in sorted((r for r in found if r.a == a), key=lambda r: r.rank)] == [(n + 1, b) for n, (_, b) in enumerate(order)]


def test_only_the_best_are_kept_whatever_is_equal():
    best, other = np.full((2, 3), -np.inf), np.full((2, 3), -1)
    for s in range(0, 4000, 1000):
        vector._kept(best, other, np.ones((2, 1000)), np.arange(s, s + 1000))
    assert other.tolist() == [[0, 1, 2]] * 2 and best.tolist() == [[1, 1, 1]] * 2


def test_most_shared_entities_of_hubs_in_runs_and_blocks(spark):
    rng = np.random.default_rng(5)
    said = {(f"s{p}", int(e)) for p in range(60) for e in rng.integers(0, 25, 6)} | {(f"s{p}", 99) for p in range(0, 60, 2)}
    m = spark.createDataFrame([*said, *said, (None, 1), ("s1", None)], "page string, entity int")
    have = collections.defaultdict(set)
    for p, e in said:
        have[p].add(e)
    want = {}
    for a in have:
        n = sorted((-len(have[a] & have[b]), b) for b in have if b != a and have[a] & have[b])[:4]
        want[a] = {(b, -x) for x, b in n}
    got = collections.defaultdict(set)
    for r in graph.top_shared(m, 4, weight=200, run=8).collect():
        got[r.a].add((r.b, r.n))
    assert got == want
    some = graph.top_shared(m, 4, m.filter("page IN ('s3', 's4')").select("page"), weight=50, run=16).collect()
    assert {(r.a, r.b, r.n) for r in some} == {(a, *x) for a in ("s3", "s4") for x in want[a]}


def test_best_chunks_of_pages_with_many_chunks(spark):
    rng = np.random.default_rng(9)
    v = rng.standard_normal((300, 5)).round(1)
    chunks = spark.createDataFrame([(f"p{i % 3}", i, x.tolist()) for i, x in enumerate(v)], "page string, id long, emb array<float>").repartition(3)
    asked = chunks.filter("id < 40").select(F.col("id").alias("qid"), "emb")
    wanted = asked.select("qid", F.concat(F.lit("p"), (F.col("qid") % 3).cast("string")).alias("page")).unionByName(asked.filter("qid % 2 = 0").select("qid", F.lit("p1").alias("page"))).distinct()
    got = {(r.qid, r.page): (r.id, r.score) for r in retrieve.best_of(asked, wanted, chunks, 7).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert len(got) == wanted.count()
    for (q, p), (i, score) in got.items():
        s = np.round(u[q] @ u.T, 6)
        assert (s[i], p) == (max(s[j] for j in range(300) if f"p{j % 3}" == p), f"p{i % 3}") and abs(score - s[i]) < 1e-5
    plan = retrieve.best_of(asked, wanted, chunks)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan  # blocks of chunks, not a row for each question and chunk


def test_no_text_is_shuffled_for_titles(spark, tmp_path):
    from scholia.plans import catalog

    spark.createDataFrame([(i, f"Title {i}\nbody", "s") for i in range(6)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    out = catalog.outline(spark, str(tmp_path))
    assert [r.title for r in out.orderBy("ord").collect()] == ["Title 0", "Title 1", "Title 3", "Title 4"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("split_part(") if "split_part(" in plan else plan.index("Join") < plan.index("element_at(")


def test_links_are_chosen_in_parts_as_in_one():
    import tracemalloc

    from scholia.operators.neighbours import Layers

    rng = np.random.default_rng(1)
    g = Layers(8)
    g.vectors = rng.standard_normal((500, 8)).astype(np.float32)
    rows = rng.integers(0, 500, (4000, 24))
    score = -np.sort(-rng.random((4000, 24)).astype(np.float32), axis=1)
    assert (g._diverse(rows, score, 12, 64) == g._diverse(rows, score, 12, 5000)).all()
    tracemalloc.start()
    g._diverse(rows, score, 12)
    assert tracemalloc.get_traced_memory()[1] < 12 << 20
    tracemalloc.stop()


def test_similar_pages_in_few_files_of_rows(spark):
    import pyarrow.dataset as ds

    from scholia.functions.tables import file_system

    rng = np.random.default_rng(4)
    v = rng.random((300, 4))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, emb array<double>").repartition(16)
    read, stream = [], vector.new_path
    vector.new_path = lambda *a: read.append(stream(*a)) or read[-1]
    try:
        one = vector.similar(df, 3, block=64).collect()
        many = vector.similar(df, 3, block=64, a_file=20).collect()
    finally:
        vector.new_path = stream
    files = [len(ds.dataset(file_system(p)[1], format="parquet").files) for p in read]
    assert files[0] == 1 and files[1] > 8 and sorted(one) == sorted(many) and len(one) == 900


def test_texts_do_not_go_to_their_parents(spark, tmp_path):
    from scholia.plans import catalog

    rows = [(i, f"Title {i}\nbody Kernel {i} " + "x" * 50, "s" if i % 2 else "t") for i in range(24)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    made = catalog.Build(spark, str(tmp_path))
    assert made.entities.select("name").collect() == [("Kernel",)]
    assert set(vars(made)) == {"spark", "sf_dir", "numbered", "tree", "wiki", "found", "entities"}  # no chunks, vectors or references for entities
    assert "text" not in made.tree.columns and [r.slug[:5] for r in made.tree.filter("i = 0").orderBy("slug").collect()] == ["s/000", "t/000"]
    whole = restructure_plainly(spark, str(tmp_path))
    assert sorted(made.wiki.collect()) == sorted(whole.collect())


def restructure_plainly(spark, folder):
    from scholia.operators import knowledge
    from scholia.plans import catalog

    return knowledge.wiki_pages(catalog.page_tree(spark, folder), many=True)


def test_ends_of_every_white_space_are_cut(spark):
    from scholia.functions import text as T

    odd = [chr(c) for c in range(1, 0x3100)]
    df = spark.createDataFrame([(f"{c}{c} a{c}b {c}", c) for c in odd] + [(c * 3, c) for c in odd] + [("", ""), (None, "")], "t string, c string")
    got = df.select("t", T.strip(F.col("t")).alias("s"), F.regexp_replace("t", rf"\A{T.SPACE}|{T.SPACE}\z", "").alias("r")).collect()
    assert [r.t for r in got if r.s != r.r] == []


def test_a_reply_is_read_once_and_texts_stay_where_they_are(spark):
    from scholia.operators import entities
    from scholia.plans.catalog import Capitalised

    pages = spark.createDataFrame([("a", 0, "T", "Kernel Driver"), ("b", 1, "U", "Kernel"), ("c", 2, "V", " ")], "slug string, i int, title string, text string")
    assert entities.replies(entities.page_prompts(pages), Capitalised(), {"Feature": ""}).columns == ["slug", "ord", "reply"]
    kept = []
    things, mentions = entities.extract(pages, Capitalised(), ["Feature"], keep=lambda df: kept.append(df.columns) or df)
    assert kept == [["slug", "ord", "at", "key", "name", "type"]]
    assert sorted(r.name for r in things.collect()) == ["Driver", "Kernel"] and mentions.count() == 3


def test_lists_of_pages_are_written_once_whatever_the_blocks(spark):
    rng = np.random.default_rng(8)
    said = {(f"p{p:03d}", int(e)) for p in range(300) for e in rng.integers(0, 400, 5)} | {(f"p{p:03d}", 999) for p in range(40, 300, 3)}
    m = spark.createDataFrame(sorted(said), "page string, entity int")
    have, of = collections.defaultdict(set), collections.defaultdict(set)
    for p, e in said:
        have[p].add(e)
        of[e].add(p)
    want = {(a, b, -x) for a in have for x, b in sorted((-len(have[a] & have[b]), b) for b in have if b != a and have[a] & have[b])[:3]}
    folders, path = [], graph.new_path
    graph.new_path = lambda *a: folders.append(path(*a)) or folders[-1]
    try:
        few, many = graph.top_shared(m, 3, run=64), graph.top_shared(m, 3, weight=300, run=64)
        some = graph.top_shared(m, 3, m.filter("entity = 999 AND page < 'p100'").select("page"), weight=100, run=16)
        assert {tuple(r) for r in few.collect()} == want == {tuple(r) for r in many.collect()}
        assert {tuple(r) for r in some.collect()} == {r for r in want if r[0] < "p100" and 999 in have[r[0]]}
    finally:
        graph.new_path = path
    one, two = (spark.read.parquet(f) for f in folders[:2])
    shared = {e: ps for e, ps in of.items() if len(ps) > 1}
    assert one.count() == two.count() == len(shared) - 1 + 5  # an entity of few pages is a row, however far apart these are; that of 87 pages is five runs
    assert two.select(F.sum(F.size("posts"))).first()[0] == sum(map(len, shared.values()))
    assert "InArrow" in many._jdf.queryExecution().toString() and "FlatMapGroupsInArrow" not in many._jdf.queryExecution().toString()  # no list is shuffled to blocks
