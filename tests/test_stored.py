"""Stores of versions, the neighbour index, pages behind a stream, folders as sources, running numbers, paths and closures."""

import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholia.functions import prefix
from scholia.operators import graph, index, knowledge, neighbours
from scholia.sinks.versions import Store
from scholia.sources import formats, html, readers
from scholia.streaming import pages as page_stream
from scholia.streaming import upsert


@pytest.fixture(scope="module")
def plain(spark):
    """Rows by key and value."""
    return lambda rows, schema="k string, v int": spark.createDataFrame(rows, schema)


def test_store(spark, plain, tmp_path):
    path = f"file://{tmp_path}/store"
    rows = lambda v=None: sorted((tuple(r) for r in Store(spark, path).read("t", v).collect()), key=repr)
    store = Store.create(spark, path, {"t": (plain([("a", 1), ("b", 2), (None, 3), ("b", 4)]), {"k": "true"}), "u": (plain([]), {"k": "v > 1"})})
    with pytest.raises(FileExistsError):
        Store.create(spark, path, {"t": (plain([]), {"k": "true"})})
    assert store.commit({"t": (plain([("b", 5), ("c", 6)]), plain([("b", 0), ("x", 0)]))}) == 1
    assert rows() == [("a", 1), ("b", 5), ("c", 6), (None, 3)] and rows(0) == [("a", 1), ("b", 2), ("b", 4), (None, 3)]
    assert store.commit({"t": (plain([]), plain([("a", 0), (None, 0)])), "u": (plain([("p", 1), ("p", 2)]), None)}) == 2
    store.commit({"u": (plain([]), plain([("p", 0)]))})  # hides rows with v > 1 alone
    assert rows() == [("b", 5), ("c", 6), (None, 3)] and [tuple(r) for r in store.read("u").collect()] == [("p", 1)]
    assert store.commit({"t": (plain([("a", 7)]), None)}) == 4  # new rows of a replaced key stay
    before = rows()
    assert store.compact() == 5 and rows() == before and rows(2) == [("b", 5), ("c", 6), (None, 3)] and len(store.manifest()["tables"]["t"]["commits"]) == 1
    gone = store.vacuum()
    assert len(gone) >= 6 and rows() == before and store.versions() == [5] and store.vacuum() == []
    store.commit({"t": (plain([("b", 8)]), plain([("b", 0)]))})
    assert ("b", 8) in rows() and ("b", 5) not in rows()
    with pytest.raises(FileNotFoundError):
        Store(spark, f"file://{tmp_path}/none").read("t")


def test_second_writer_takes_the_next_version(spark, plain, tmp_path):
    path = f"file://{tmp_path}/store"
    one = Store.create(spark, path, {"t": (plain([("a", 1)]), {"k": "true"})})
    two = Store(spark, path)
    seen = two.manifest()
    one.commit({"t": (plain([("a", 2)]), plain([("a", 0)]))})
    two.manifest, first = (lambda version=None: seen if not calls.append(1) and len(calls) == 1 else Store.manifest(two, version)), None  # as it was before the other commit
    calls = []
    assert two.commit({"t": (plain([("a", 3)]), plain([("a", 0)]))}) == 2 and first is None
    assert [tuple(r) for r in one.read("t").collect()] == [("a", 3)] and [tuple(r) for r in one.read("t", 1).collect()] == [("a", 2)]


WORDS = ["alpha", "beta", "gamma", "delta"]


def small_graph(spark, n=60):
    rng = random.Random(1)
    pages = [("s", i, f"{i:03d}-p", f"P{i}", 1, i + 1, i + 1, None, " ".join(rng.choice(WORDS) for _ in range(9))) for i in range(n)]
    wiki = spark.createDataFrame(pages, "source string, i int, slug string, title string, level int, page_start int, page_end int, parent_slug string, text string")
    return knowledge.Graph.build(wiki, index.Index.build(wiki, index.WordCounts(WORDS)).chunks)


def test_graph_store_writes_what_an_edit_changes(spark, tmp_path):
    g = small_graph(spark)
    store = upsert.GraphStore.create(g, f"file://{tmp_path}/g")
    base = store.store.size_of()
    edits = spark.createDataFrame([("003-p", "# Three\nalpha alpha", None, 1), ("new", "beta gamma", "New", 1)], "slug string, text string, title string, version int")
    version = store.upsert(edits, index.WordCounts(WORDS), similar_k=2)
    now, cost = store.graph(), store.store.size_of()
    whole = upsert.upsert(knowledge.Graph(g.pages, g.chunks, g.entities, g.edges, "x"), edits, index.WordCounts(WORDS), similar_k=2)
    for name in ("pages", "chunks", "edges"):
        rows = lambda x, name=name: sorted((repr(tuple(r)) for r in getattr(x, name).collect()))
        assert rows(now) == rows(whole), name
        assert rows(store.graph(version - 1)) == rows(g)
    delta = store.store.manifest()["tables"]["edges"]["commits"][-1]["name"]
    own = spark.read.parquet(f"file://{tmp_path}/g/edges/rows-{delta}").select("src", "dst").collect()
    assert all({r.src.split("#")[0], r.dst} & {"003-p", "new"} for r in own) and len(own) <= 12 and cost["pages"] < base["pages"]
    store.delete(spark.createDataFrame([("new",)], "slug string"))
    assert store.graph().pages.filter("slug = 'new'").count() == 0 and store.graph().edges.filter("dst = 'new' and rel = 'SIMILAR_TO'").count() == 0
    store.store.compact()
    assert store.graph().pages.count() == 60 and store.graph().neighborhood("003-p")["nodes"][0]["title"] == "Three"


def test_look_ups_open_few_row_groups(spark, tmp_path):
    """Edges lie sorted by src, and Bloom filters say which files hold a dst."""
    import pyarrow.parquet as pq

    rows = spark.range(4000).select(F.format_string("p%05d", "id").alias("src"), F.format_string("p%05d", (F.col("id") * 7) % 4000).alias("dst"))
    store = Store.create(spark, f"file://{tmp_path}/s", {"e": (rows.repartitionByRange(8, "src"), {"src": "true", "dst": "true"})})
    name = store.manifest()["tables"]["e"]["commits"][0]["name"]
    files = list((tmp_path / "s" / "e" / f"rows-{name}").glob("*.parquet"))
    spans = [(s.min, s.max) for f in files for s in [pq.ParquetFile(f).metadata.row_group(0).column(0).statistics]]
    assert len(files) == 8 and sum(a <= "p01234" <= b for a, b in spans) == 1
    read = store.read("e").filter("dst = 'p01234'")
    assert read.count() == 1 and "PushedFilters" in read._jdf.queryExecution().toString() and "EqualTo(dst,p01234)" in read._jdf.queryExecution().toString()


def vectors(n=3000, dim=24, seed=0):
    rng = np.random.default_rng(seed)
    near = rng.standard_normal((30, dim))
    return (near[rng.integers(0, 30, n)] + rng.standard_normal((n, dim)) * 0.8).astype(np.float32)


def nearest(v, ids, q, k):
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    w = q.astype(float) / np.linalg.norm(q.astype(float), axis=1, keepdims=True)
    sims = np.round(w @ u.T, 12)
    return [[ids[j] for j in np.lexsort((ids, -row))[:k]] for row in sims]


def test_neighbour_index(spark, tmp_path):
    v = vectors()
    ids = np.arange(len(v))
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in enumerate(v)] + [(90_000, None), (90_001, [0.0] * 24), (90_002, [float("nan")] * 24)], "id long, emb array<float>")
    start = neighbours.NeighbourIndex.build(df.filter("id % 5 <> 0"), f"file://{tmp_path}/a", rows=800)
    start.insert(df.filter("id % 5 = 0"))
    asked = df.filter("id % 100 = 0 and id < 90000").select(F.col("id").alias("qid"), "emb")
    want = dict(zip(ids[::100].tolist(), nearest(v, ids, v[::100], 10), strict=True))

    def found(**kw):
        out = {}
        for r in start.search(asked, 10, **kw).orderBy("qid", "rank").collect():
            out.setdefault(r.qid, []).append(r.id)
        return out

    assert found(exact=True) == want
    recall = np.mean([len(set(want[q]) & set(x)) / 10 for q, x in found().items()])
    assert recall >= 0.9, recall
    version = start.store.versions()[-1]
    # an update, a deletion and a second insert of the same id
    start.insert(spark.createDataFrame([(0, v[100].tolist())], "id long, emb array<float>"), spark.createDataFrame([(200,), (77_777,)], "id long"))
    got = start.search(asked.filter("qid in (100, 200)"), 3, exact=True).orderBy("qid", "rank").collect()
    assert [r.id for r in got if r.qid == 100][:2] == [0, 100] and 200 not in [r.id for r in got]
    assert [r.id for r in start.search(asked.filter("qid = 200"), 1, version=version).collect()] == [200]
    # most rows gone: their shard is built anew
    start.insert(df.limit(0), df.filter("id % 10 <> 3 and id < 90000").select("id"))
    left = start.search(asked, 400, exact=True).groupBy("qid").count().collect()
    assert {r["count"] for r in left} == {300} and len(left) == 30
    empty = neighbours.NeighbourIndex.build(df.limit(0), f"file://{tmp_path}/b")
    assert empty.search(asked, 3).count() == 0 and start.search(asked.limit(0), 3).count() == 0


def test_layers_find_what_is_near():
    v = vectors(4000, 32, 3)
    u = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    layers = neighbours.Layers(32)
    layers.insert(u, neighbours.levels_of(list(range(len(u)))))
    rows, score = layers.search(u[:200], 96)
    exact = np.argsort(-(u[:200] @ u.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) for a, b in zip(rows.tolist(), exact.tolist(), strict=True)]) >= 9.5
    assert (np.diff(score, axis=1) <= 0).all() and max(len(set(x[x >= 0])) for x in layers.links[0]) <= 24
    top = np.flatnonzero(layers.level >= 1)
    assert 100 < len(top) < 500 and all((layers.links[1][i] < 0).all() for i in np.flatnonzero(layers.level == 0)[:50])


def test_pages_behind_a_stream(spark, tmp_path):
    schema = "slug string, version long, ts timestamp, links array<string>"
    at = lambda day: __import__("datetime").datetime(2024, 1, 1) + __import__("datetime").timedelta(days=day)
    batches = [
        [("a", 1, at(1), ["b", "c"]), ("b", 5, at(1), ["a"]), (None, 1, at(1), ["x"]), ("z", None, at(1), ["x"])],
        [("a", 3, at(2), ["c", "d", "a", "d", None]), ("a", 2, at(2), ["q"]), ("b", 4, at(2), ["late"]), ("b", 5, at(2), ["a"]), ("c", 1, at(2), None)],
        [("a", 3, at(3), ["c", "d"]), ("c", 2, at(3), ["a", "b"]), ("c", 3, at(3), ["b"])],
    ]
    source, out = tmp_path / "in", f"file://{tmp_path}/out"
    source.mkdir()
    stream = spark.readStream.schema(schema).parquet(f"file://{source}")

    def keep(batch, n):
        batch.write.mode("overwrite").parquet(f"{out}/n={n}")

    def run(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"file://{source}")
        query = page_stream.edge_changes(stream, expire_days=30, late="2 days").writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"file://{tmp_path}/marks")
        query.trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(page_stream.CHANGES).option("recursiveFileLookup", "true").parquet(out)

    met = []
    for rows in batches:
        met += rows
        changes = run(rows)
        edges = {(r.src, r.dst) for r in page_stream.net_edges(changes).collect()}
        assert edges == {tuple(r) for r in page_stream.batch_edges(spark.createDataFrame(met, schema)).collect()}
    assert edges == {("a", "c"), ("a", "d"), ("b", "a"), ("c", "b")}
    log = [(r.src, r.dst, r.change, r.version) for r in changes.collect()]
    assert ("a", "b", "remove", 3) in log and not any(x[1] in ("q", "late") for x in log) and len(log) == len(set(log))
    # two months later: what wasn't edited since is forgotten, an edit of a page that was forgotten begins anew
    run([("new", 1, at(70), ["a"])])
    changes = run([("new", 2, at(70), ["a", "b"])])
    assert {(r.src, r.dst) for r in page_stream.net_edges(changes).collect()} == {("new", "a"), ("new", "b")}
    assert sorted((r.src, r.dst) for r in changes.filter("change = 'expire'").collect()) == sorted(edges)
    changes = run([("a", 9, at(71), ["x"])])
    assert {(r.src, r.dst) for r in page_stream.net_edges(changes).filter("src = 'a'").collect()} == {("a", "x")}


MARKDOWN = ["pre\n# One\nx\n```\n# no\n~~~\n## Two ##\ny", "", "# Only", "no heading\r\nat all\r# Yes\r\nz", "~~~\n# in\n", "#no\n####### no\n# \n", "\n\n# A\n\n\n# B\n  ```py\n# c\n  ```\n###   D  #  \nt\n", "a\n```\nx\n```\n```\n# y\n```\n# Z"]


def test_markdown_as_table_and_as_source(spark, tmp_path):
    rng = random.Random(8)
    pieces = ["# H", "## I #", "```", "~~~ x", "text", "", "  ", "#", "### J", "\ttab", "  ``` y", "#K"]
    texts = MARKDOWN + ["\n".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14))) for _ in range(150)]
    df = spark.createDataFrame([(f"{i:03d}.md", t) for i, t in enumerate(texts)], "source string, text string")
    rows = lambda d: sorted((r.source.rpartition("/")[2], r.ord, r.level, r.title, r.text) for r in d.collect())
    native = rows(readers.markdown_sections(df))
    assert native == sorted((f"{i:03d}.md", *s) for i, t in enumerate(texts) for s in formats.markdown_sections(t))
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / ".hidden").mkdir()
    for i, t in enumerate(texts):
        (tmp_path / ("" if i % 3 else "deep" if i % 2 else "deep/er") / f"{i:03d}.md").write_bytes(t.encode())
    (tmp_path / ".hidden" / "x.md").write_text("# no")
    (tmp_path / "x.html").write_text("<h1>no</h1>")
    formats.register(spark)
    read = spark.read.format("scholia_markdown").option("filesPerPartition", 7).load(f"file://{tmp_path}")
    assert rows(read) == native and read.rdd.getNumPartitions() > 5
    assert rows(spark.read.format("scholia_markdown").option("maxSections", 1).load(f"file://{tmp_path}")) == [r for r in native if r[1] < 1]
    some = read.filter(F.col("source").endswith("/001.md"))
    assert rows(some) == [r for r in native if r[0] == "001.md"]


def test_conditions_are_pushed_to_files(spark, tmp_path):
    for name in ("a", "b", "c"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"metadata": {"title": name, "page_count": 1, "format": "x"}, "outline": [{"level": 1, "title": "t"}], "pages": [{"number": 1, "text": name}, {"number": 2}]}))
    (tmp_path / "bad.json").write_text("{")
    formats.register(spark)
    load = lambda pushed="true": spark.read.format("scholia_parsed").option("pushdown", pushed).load(f"file://{tmp_path}")
    for where in (F.col("source") == f"file://{tmp_path}/a.json", F.col("source").isin(f"file://{tmp_path}/a.json", f"file://{tmp_path}/b.json"), F.col("source").startswith(f"file://{tmp_path}/c"), F.col("source").contains("/a.")):
        assert {tuple(r)[2] for r in load().filter(where).collect()} == {"meta", "outline", "page"}  # the broken file isn't opened
    with pytest.raises(Exception, match="bad.json"):
        load().collect()
    read = load("false")
    with pytest.raises(Exception, match="bad.json"):
        read.filter("source like '%a.json'").collect()  # not pushed down: all files are parsed
    got = spark.read.format("scholia_parsed").option("mode", "skip").load(f"file://{tmp_path}").filter("part = 'page'").orderBy("source", "ord").collect()
    assert [(r.number, r.text) for r in got] == [(1, "a"), (2, ""), (1, "b"), (2, ""), (1, "c"), (2, "")]
    (tmp_path / "q.jsonl").write_text('{"question": "q", "pages": "a"}\n# no\n\n{"question": "r", "expected": ["a", "b"]}\n{"question": "s"}')
    asked = spark.read.format("scholia_questions").load(f"file://{tmp_path}").orderBy("line").collect()
    assert [(r.line, r.question, r.expected) for r in asked] == [(0, "q", ["a"]), (3, "r", ["a", "b"]), (4, "s", [])]
    (tmp_path / "empty").mkdir()
    assert spark.read.format("scholia_html").load(f"file://{tmp_path}/empty").count() == 0
    with pytest.raises(Exception, match="(?i)no such file|not found|cannot"):
        spark.read.format("scholia_html").load(f"file://{tmp_path}/none").count()


def test_html_table_function_streams_and_checks(spark):
    page = "".join(f"<h2>S{i}</h2><p>t{i}" for i in range(500))
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id int, html string")
    assert html.html_sections(df).count() == 500 and html.html_sections(df, max_pages=3).orderBy("ord").select("title").collect()[-1].title == "S2"
    with pytest.raises(Exception, match="must be a string"):
        html.html_sections(df, "page_id").count()
    assert [x[2] for x in html.sections("<h1>a</h1>b<h2>c")] == ["a", "c"]


def test_running_numbers_and_totals(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 5 + ["a", None]), i, rng.choice([1, 2, None])) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, i int, n int").repartition(5)
    got = {r.i: r.number for r in prefix.numbered(df, ["g"], ["i"]).collect()}
    count = {}
    for g, i, _ in rows:
        count[g] = count.get(g, 0) + 1
        assert got[i] == count[g]
    totals = {r.i: r.before for r in prefix.running_total(df, "n", ["i"]).collect()}
    before = 0
    for _, i, n in rows:
        assert totals[i] == before
        before += n or 0
    assert prefix.numbered(df.limit(0), ["g"], ["i"]).count() == 0 and prefix.running_total(df.limit(0), "n", ["i"]).count() == 0
    assert [r.number for r in prefix.numbered(df, [], ["i"]).orderBy("i").limit(3).collect()] == [1, 2, 3]


def brute_path(edges, a, b, most):
    near = {}
    for s, d, r, _ in edges:
        if r in graph.PATH_RELATIONS and s != d:
            for x, y in ((s, d), (d, s)):
                near.setdefault(x, {})[y] = min(r, near.get(x, {}).get(y, r))
    front = [[a]]
    for hop in range(most + 1):
        done = [p for p in front if p[-1] == b]
        if done:
            p = min(done)
            return hop, p, [near[x][y] for x, y in zip(p, p[1:], strict=False)]
        front = [[*p, y] for p in front for y in near.get(p[-1], {}) if y not in p]
    return None, None, None


def test_paths_of_many_pairs(spark):
    rng = random.Random(4)
    names = [f"n{i:02d}" for i in range(24)]
    edges = [(rng.choice(names[:20]), rng.choice(names[:20]), rng.choice([*graph.PATH_RELATIONS, "MENTIONS"]), None) for _ in range(34)] + [("n22", "n23", "NEXT", None)]
    df = spark.createDataFrame(edges, "src string, dst string, rel string, score double")
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(30)] + [("n22", "n23"), ("n00", "n22"), ("n05", "n05"), (None, "n01"), ("n01", None)]
    got = {(r.a, r.b): (r.hops, r.nodes, r.rels) for r in graph.paths(df, spark.createDataFrame(pairs, "a string, b string"), 5).collect()}
    assert got.keys() == {p for p in pairs if None not in p}
    for a, b in got:
        assert got[a, b] == brute_path(edges, a, b, 5), (a, b)
    one = graph.find_path(df, *next(p for p in got if got[p][0] and got[p][0] > 1), 5)
    assert one is not None and graph.paths(df, spark.createDataFrame([], "a string, b string")).count() == 0


def test_ancestry(spark):
    tree = spark.createDataFrame([(i, i // 3 if i else None) for i in range(0, 200)] + [(500, 501), (501, 502)], "node long, parent long").filter("node <> parent or parent is null")
    got = {(r.node, r.ancestor): r.depth for r in graph.ancestry(tree).collect()}
    want = {}
    for i in range(1, 200):
        x, depth = i, 0
        while x > 0:
            x, depth = x // 3, depth + 1
            want[i, x] = depth
    assert got == want | {(500, 501): 1, (500, 502): 2, (501, 502): 1}
    edges = tree.select(F.col("node").alias("src"), F.col("parent").alias("dst"), F.lit("CHILD_OF").alias("rel"))
    assert {r.node for r in graph.descendants(edges, 5).collect()} == {i for i in range(200) if (i, 5) in want}
    start = time.time()
    assert graph.ancestry(tree.limit(0)).count() == 0 and time.time() - start < 60


def test_reports_with_and_without_lists(spark):
    from scholia.operators import evaluate

    rng = random.Random(9)
    items = [(q, rng.sample(range(30), rng.randrange(0, 25)), rng.choices(range(30), k=rng.randrange(0, 4))) for q in range(40)]
    lists = spark.createDataFrame(items, "qid int, ranked array<int>, expected array<int>")
    found = spark.createDataFrame([(q, p, i + 1) for q, ranked, _ in items for i, p in enumerate(ranked)], "qid int, page int, rank int")
    expected = spark.createDataFrame([(q, p) for q, _, some in items for p in some], "qid int, page int")
    one, two = evaluate.report(lists, 5).first(), evaluate.report_rows(lists.select("qid"), expected, found, 5).first()
    assert (one.n, one.misses) == (two.n, two.misses) == (40, two.misses) and all(abs(one[c] - two[c]) < 1e-9 for c in ("mrr", "hit_rate", "recall"))
    none = evaluate.report_rows(lists.select("qid").limit(0), expected, found, 5).first()
    assert (none.n, none.mrr, none.misses) == (0, 0.0, 0)
