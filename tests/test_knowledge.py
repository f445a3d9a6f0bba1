"""From pages to index and graph, and what is asked of them; upserts; entities; evaluation."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholia.functions.tables import written
from scholia.operators import entities, evaluate, graph, index, knowledge, references, restructure, retrieve, vector
from scholia.streaming import upsert

WORDS = ["alpha", "beta", "gamma", "nautilus"]
TEXTS = {"000-a": "alpha alpha common nautilus", "001-b": "beta common nautilus", "002-c": "gamma gamma nautilus common"}


@pytest.fixture(scope="module")
def wiki(spark):
    rows = [("s", 0, "000-a", "A", 1, 1, 2, None, TEXTS["000-a"]), ("s", 1, "001-b", "B", 2, 3, 3, "000-a", TEXTS["001-b"]), ("s", 2, "002-c", "C", 1, 4, 6, None, TEXTS["002-c"])]
    return spark.createDataFrame(rows, "source string, i int, slug string, title string, level int, page_start int, page_end int, parent_slug string, text string").cache()


@pytest.fixture(scope="module")
def indexed(spark, wiki, tmp_path_factory):
    return index.Index.build(wiki, index.WordCounts(WORDS)).save(str(tmp_path_factory.mktemp("index")))


@pytest.fixture(scope="module")
def built(spark, wiki, indexed, tmp_path_factory):
    refs = spark.createDataFrame([("000-a", "002-c"), ("000-a", "nowhere"), ("001-b", "001-b")], "src string, dst string")
    things = spark.createDataFrame([("T::x", "X", "T"), ("T::y", "Y", "T")], "key string, name string, type string")
    mentions = spark.createDataFrame([("000-a", "T::x"), ("001-b", "T::x"), ("001-b", "T::y"), ("002-c", "T::y"), ("gone", "T::y")], "page string, entity string")
    return knowledge.Graph.build(wiki, indexed.chunks, refs, things, mentions).save(str(tmp_path_factory.mktemp("graph")))


def test_index(spark, wiki, indexed):
    c = indexed.chunks.orderBy("id").collect()
    assert [r.id for r in c] == ["000-a#0", "001-b#0", "002-c#0"] and (c[2].title, c[2].page_start, c[2].page_end, c[2].chunk_index) == ("C", 4, 6, 0)
    assert all(abs(np.linalg.norm(r.emb) - 1) < 1e-6 for r in c)
    assert indexed.search("gamma", 2).first().page == "002-c" and indexed.search("beta", 99).count() == 3
    assert [r.page for r in indexed.best_chunk_per_page("beta", ["002-c", "001-b"]).collect()] == ["001-b", "002-c"] and indexed.best_chunk_per_page("beta", []).count() == 0
    with pytest.raises(ValueError):
        index.Index.build(wiki.withColumn("text", F.lit(" ")), index.WordCounts(WORDS))
    assert index.embedder_of("counts:a,b").embed_query("a ba").tolist() == [2, 1] and index.embedder_of("hash:8").embed_documents(["x", "y z"]).shape == (2, 8)
    assert isinstance(index.embedder_of("bge-m3"), index.HttpEmbedder) and isinstance(index.HashedWords(), index.Embedder) and index.HttpEmbedder("m").embed_documents([]).shape == (0, 0)
    assert np.allclose(index.WordCounts(WORDS).embed_query("none"), 1e-6)


def test_top_k_and_its_approximation(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((600, 8)) + np.repeat(rng.standard_normal((20, 8)) * 2, 30, axis=0)
    df = spark.createDataFrame([(f"c{i:03d}", i // 30, v.tolist()) for i, v in enumerate(x)], "id string, page int, emb array<double>")
    q = df.filter("id like '%00' or id like '%55'").select(F.col("id").alias("qid"), "emb")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in vector.top_k(q, df.repartition(6), 5, question_block=3).collect():
        got.setdefault(r.qid, []).append((r.marker, r.id))
    for name, rows in got.items():
        score = np.round(u @ u[int(name[1:])], 12)
        assert [i for _, i in sorted(rows)] == [f"c{i:03d}" for i in sorted(range(600), key=lambda i: (-score[i], i))[:5]]
    near = vector.approximate_top_k(q, df, 5).collect()
    exact = {(n, i) for n, rows in got.items() for _, i in rows}
    assert len({(r.qid, r.id) for r in near} & exact) >= 0.9 * len(exact)
    assert sorted((r.a, r.b) for r in vector.similar(df.select("id", "emb"), 2, block=100).collect()) == sorted((r.a, r.b) for r in vector.similar(df.select("id", "emb"), 2).collect())


def test_graph_build_and_queries(spark, wiki, indexed, built):
    e = {(r.src, r.dst, r.rel) for r in built.edges.collect()}
    assert {x for x in e if x[2] in ("CHILD_OF", "NEXT", "REFERENCES")} == {("001-b", "000-a", "CHILD_OF"), ("000-a", "001-b", "NEXT"), ("001-b", "002-c", "NEXT"), ("000-a", "002-c", "REFERENCES")}
    assert ("001-b", "000-a", "SIMILAR_TO") not in e and ("000-a", "002-c", "SIMILAR_TO") in e and ("gone", "T::y", "MENTIONS") not in e
    s = built.stats()
    assert (s["pages"], s["chunks"], s["entities"], s["child_of"], s["next"], s["part_of"], s["mentions"], s["entity_types"]) == (3, 3, 2, 1, 2, 3, 4, [{"type": "T", "count": 2}])
    near = built.neighborhood("000-a")
    assert {n["slug"]: n["rel"] for n in near["nodes"]} == {"000-a": "center", "001-b": "child", "002-c": "references"}
    assert [x["type"] for x in near["edges"]] == ["child", "next", "references", "shared_entity", "similar"] and 0 < near["edges"][-1]["score"] <= 1
    with pytest.raises(KeyError):
        built.neighborhood("none")
    more = built.explore("001-b")
    assert more["root"] == "001-b" and {n["id"] for n in more["nodes"]} == {"001-b", "000-a", "002-c", "T::x", "T::y"} and {"source": "001-b", "target": "T::x", "type": "mentions"} in more["edges"]
    assert [n["id"] for n in built.expand("entity", "T::y")["nodes"]] == ["001-b", "002-c"] and built.page_entities("001-b")[0]["pages"] == 2
    assert built.entities_for_page("001-b") == [{"name": "X", "type": "T"}, {"name": "Y", "type": "T"}] and built.has_entities()
    assert [h["slug"] for h in built.pages_for_entity("x")] == ["000-a", "001-b"] and built.pages_for_entity("zz") == []
    p = built.find_path("000-a", "002-c")
    assert (p["hops"], p["titles"], p["rels"]) == (1, ["A", "C"], ["REFERENCES"]) and built.find_path("000-a", "000-a")["hops"] == 0
    with pytest.raises(KeyError):
        built.find_path("000-a", "none")
    assert built.hybrid_search(index.WordCounts(WORDS).embed_query("gamma nautilus").tolist())[0]["page_slug"] == "002-c"
    h = built.health()
    assert (h["pages"], h["entities"], h["cross_page_entities"], h["orphans"], h["pages_no_entities"]) == (3, 2, 2, [], 0) and h["top_pages"][0]["slug"] in ("000-a", "002-c")
    again = knowledge.Graph.build(wiki, indexed.chunks, None)
    assert again.stats()["references"] == 0 and knowledge.Graph.build(wiki, indexed.chunks).edges.exceptAll(again.edges).count() == 0
    with pytest.raises(ValueError):
        knowledge.Graph.build(wiki, indexed.chunks.limit(0))
    assert [r.node for r in graph.descendants(built.edges, "000-a").collect()] == ["001-b"] and graph.collapsed(built.edges, "000-a").filter("src = '001-b' or dst = '001-b'").count() == 0
    assert graph.merged(built.edges, built.edges).count() == built.edges.count()


def test_hub_entities_in_blocks(spark):
    m = spark.createDataFrame([(p, "hub") for p in range(40)] + [(1, "e"), (2, "e")], "page int, entity string")
    assert {(r.a, r.b): r.n for r in graph.shared_entities(m, block=4).collect()} == {(a, b): 2 if {a, b} == {1, 2} else 1 for a in range(40) for b in range(40) if a != b}


def test_path_is_the_first_of_the_shortest(spark):
    e = spark.createDataFrame([("a", "c", "NEXT"), ("c", "d", "NEXT"), ("a", "b", "SIMILAR_TO"), ("d", "b", "CHILD_OF"), ("d", "b", "REFERENCES"), ("x", "y", "NEXT"), ("a", "k", "MENTIONS"), ("k", "d", "MENTIONS")], "src string, dst string, rel string").withColumn("score", F.lit(0.0))
    assert graph.find_path(e, "a", "d") == (["a", "b", "d"], ["SIMILAR_TO", "CHILD_OF"]) and graph.find_path(e, "a", "y") is None and graph.find_path(e, "a", "d", 1) is None


def test_retrieval(spark, indexed, built):
    q = written(indexed.questions(spark.createDataFrame([(1, "gamma"), (2, "beta")], "qid int, question string")), "q")
    near = graph.neighborhood(built.edges, built.mentions)
    plain, both = retrieve.retrievers(indexed.chunks, near, 1, 1)
    assert sorted((r.qid, r.rank, r.page) for r in plain(q).filter("rank = 1").collect()) == [(1, 1, "002-c"), (2, 1, "001-b")]
    assert {(r.qid, r.rank, r.page) for r in both(q).collect()} >= {(1, 1, "002-c"), (2, 1, "001-b"), (1, 2, "000-a")}
    assert retrieve.retrievers(indexed.chunks, None)[1] is None and retrieve.retrievers(indexed.chunks, near, 5, 0)[1] is None
    assert retrieve.clamped(None, None) == (5, 3) and retrieve.clamped(99, -1) == (20, 0) and retrieve.clamped(0, 99, 10) == (1, 10)
    found = written(retrieve.graph_rag(q, indexed.chunks, built.edges, built.mentions, 1, 2), "found")
    rows = indexed.retrieved(found)

    class Echo:
        def chat(self, messages):
            return "<think>x</think> see [1]\n" + messages[1]["content"][-5:]

    asked = spark.createDataFrame([(1, "gamma"), (2, "beta"), (3, "none")], "qid int, question string")
    said = {r.qid: r.answer for r in retrieve.answers(asked, rows, Echo()).collect()}
    assert said == {1: "see [1]\ngamma", 2: "see [1]\n beta", 3: retrieve.NOTHING}
    prompt = {r.qid: r.prompt for r in retrieve.prompts(asked, rows).collect()}
    assert prompt[1].startswith("[1] C, pages 4–6\ngamma") and "related" in prompt[1] and prompt[3] is None
    items = q.join(spark.createDataFrame([(1, ["002-c"]), (2, ["000-a", "zz"])], "qid int, expected array<string>"), "qid")
    scored, report = evaluate.evaluate(items, both, 2)
    assert (report.first().n, report.first().mrr) == (2, 0.5 if not [r for r in scored.filter("qid = 2").collect()][0].rr else 0.75)
    graded = evaluate.grounding(spark.createDataFrame([(1, "[1] and [3]", ["a", "c"]), (2, "none", [])], "qid int, text string, expected array<string>"), spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "x")], "qid int, marker int, page string"))
    assert {(r.qid, r.cite_hit, r.expected_recall) for r in graded.collect()} == {(1, True, 0.5), (2, False, 0.0)}
    shown = evaluate.judge_prompts(spark.createDataFrame([(0, "q", "one", "two"), (1, "q", "one", "")], "ord int, question string, first string, second string")).orderBy("ord").collect()
    assert "A:\none" in shown[0].prompt and "A:\n(no answer)\n\nB:\none" in shown[1].prompt


def test_upsert_refreshes_similarity(spark, built, tmp_path):
    path = str(tmp_path / "g")
    built.save(path)
    edits = spark.createDataFrame([("003-d", "# Delta\n\ngamma gamma nautilus", None, 1), ("001-b", "old", None, 1), ("001-b", "beta", "New B", 2)], "slug string, text string, title string, version int")
    with pytest.raises(RuntimeError):
        upsert.upsert(knowledge.Graph.load(spark, path), edits, index.WordCounts(WORDS))
    g = upsert.upsert(knowledge.Graph.load(spark, path, writable=True), edits, index.WordCounts(WORDS), similar_k=2)
    pages = {r.slug: tuple(r) for r in g.pages.collect()}
    assert pages["003-d"] == ("003-d", "Delta", 0, 0, 0, -1) and pages["001-b"][1] == "New B" and pages["001-b"][2] == 2 and len(pages) == 4
    assert {r.id: r.text for r in g.chunks.collect()} == {"000-a#0": TEXTS["000-a"], "002-c#0": TEXTS["002-c"], "003-d#0": "# Delta gamma gamma nautilus", "001-b#0": "beta"}
    e = {(r.src, r.dst): r.score for r in g.edges.filter("rel = 'SIMILAR_TO'").collect()}
    assert max((e[k], k[1]) for k in e if k[0] == "003-d")[1] == "002-c" and all((b, a) in e and e[b, a] == s for (a, b), s in e.items() if "003-d" in (a, b)) and ("003-d", "003-d") not in e
    n = {r["rel"]: r["n"] for r in graph.stats(g.edges).collect()}
    assert (n["CHILD_OF"], n["NEXT"], n["PART_OF"], n["MENTIONS"], n["REFERENCES"]) == (1, 2, 4, 4, 1)


def test_references(spark):
    texts = ["Kapitel 1\nx", "1.1 Erster Teil\nx", "siehe Abschnitt 1.1 und Kap. 1, Kapiteln 9", "2 Anderes Thema\nAbschn. 1.1", "Seite 3"]
    pages = spark.createDataFrame([(s, i + 1, t) for s in ("one", "two") for i, t in enumerate(texts[: 5 if s == "one" else 3])], "source string, number int, text string")
    spans = spark.createDataFrame([(s, f"{s}-{i}", i, i + (i == 1), i) for s in ("one", "two") for i in range(1, 6)], "source string, slug string, page_start int, page_end int, i int")
    got = {tuple(r) for r in references.section_reference_edges(pages, spans).collect()}
    assert got == {("one-3", "one-2"), ("one-3", "one-1"), ("one-4", "one-2"), ("two-3", "two-2"), ("two-3", "two-1")}
    both = {tuple(r) for r in references.references(pages, spans, spark.createDataFrame([("one", 1), ("two", 0)], "source string, offset int")).collect()}
    assert both == got | {("one-5", "one-4")}
    late = spark.createDataFrame([("s", "999-x", 1, 1, 999), ("s", "1000-x", 1, 1, 1000)], "source string, slug string, page_start int, page_end int, i int")
    assert references.owners(late).first().slug == "1000-x"


def test_merge_and_assembly(spark):
    pages = spark.createDataFrame([(s, n, f" {s}{n}\n" if n != 2 else "\n \u00a0", [{"page_number": n}], []) for s in "ab" for n in (1, 2)], "source string, number int, text string, tables array<struct<page_number:int>>, images array<string>")
    outline = spark.createDataFrame([("a", 0, 1, "A1", 1), ("a", 1, 1, "A2", -1), ("b", 0, 1, "B1", 1), ("b", 1, 1, "B2", 2)], "source string, ord int, level int, title string, page int")
    p, o = restructure.merge(pages, outline)
    assert sorted((r.source, r.number) for r in p.collect()) == [("a", 1), ("a", 2), ("b", 3), ("b", 4)]
    assert sorted((r.level, r.title, r.page) for r in o.collect()) == [(1, "a", 1), (1, "b", 3), (2, "A1", 1), (2, "A2", -1), (2, "B1", 3), (2, "B2", 4)]
    one, same = restructure.merge(pages.filter("source = 'a'"), outline.filter("source = 'a'"))
    assert one.count() == 2 and same.count() == 2 and {r.level for r in same.collect()} == {1}
    got = restructure.assemble(restructure.cuts(outline, pages), pages).filter("source = 'a'").first()
    assert (got.text, got.n_pages, [t.page_number for t in got.tables], got.images) == ("a1", 1, [1, 2], [])


def named(reply, types):
    """(name, type) pairs of a reply, in plain Python."""
    span = re.search(r"\[.*\]", re.sub(r"(?s)<think>.*?</think>", "", reply or ""), re.DOTALL)
    try:
        items = json.loads(span[0]) if span else []
    except ValueError:
        items = []
    return [(x["name"].strip(), x["type"]) for x in items if isinstance(x, dict) and isinstance(x.get("name"), str) and isinstance(x.get("type"), str) and x["type"] in types]


def test_entities(spark, wiki):
    types = {"Part": "a piece", "Tool": ""}
    said = 'I found: [{"name": " Hüllkurve ", "type": "Part"}, {"name": "Die Hüllkurven", "type": "Part"}, {"name": 5, "type": "Part"}, {"name": "x", "type": "Part"}, 7, "t", {"name": "Axe", "type": "Weapon"}, {"name": "1234", "type": "Tool"}, {"type": "Tool"}] done'
    column = lambda t: spark.createDataFrame([(t,)], "t string").select(entities.reply_entities(F.col("t"), list(types)).alias("e")).first().e
    for text in (said, "none", "[1, 2", "<think>[1]</think> []", None, '[{"name": "A b", "type": "Tool"}]', "[] and ]"):
        assert [(x.name, x.type) for x in column(text)] == named(text, types), text
    assert named(said, types)[0] == ("Hüllkurve", "Part") and named('[{"name": "a", "type": ["Tool"]}, {"name": "b", "type": "Tool"}]', types) == [("b", "Tool")]

    class Model:
        def __init__(self, replies):
            self.replies = replies

        def chat(self, messages):
            title = messages[1]["content"].split("\n")[0]
            if title == "Title: B":
                raise OSError("no model")
            return self.replies.get(title, "[]")

    first, second = Model({"Title: A": said}), Model({"Title: C": '[{"name": "Hammer", "type": "Tool"}]'})
    things, mentions = entities.extract(wiki, first, types, retry=second, retry_from=5, keep=lambda df: written(df, "replies"))
    assert {tuple(r) for r in things.collect()} == {("Part::hullkurv", "Hüllkurve", "Part"), ("Tool::hammer", "Hammer", "Tool")}
    assert {tuple(r) for r in mentions.collect()} == {("000-a", "Part::hullkurv"), ("002-c", "Tool::hammer")}
    assert entities.extract(wiki, first, types, keep=lambda df: written(df, "replies"))[0].count() == 1
    assert [len(r.text) for r in entities.page_prompts(wiki, 5).collect()] == [5, 5, 5] and "* Part (a piece)\n* Tool" in entities.extraction_rules(types)
    wild = '<think>[{"name": "no"}]</think>Sure [see below]:\n```json\n[{"name": "Tool", "description": "x"}, {"name": "tool"}, {"name": " "}, {"name": "Part"}]\n```'
    assert [x["name"] for x in entities.proposals(wild)] == ["Tool", "tool", "Part"] and entities.proposals("none") == []
    assert entities.proposals('[{"name": "A", "examples": ["x"]}]') == [{"name": "A", "examples": ["x"]}]

    class Late:
        n = 0

        def chat(self, messages):
            self.n += 1
            return wild if self.n == 3 else json.dumps([])

    assert entities.propose_types(Late(), "text", 7) == [{"name": "Tool", "description": "x"}, {"name": "Part", "description": ""}] and entities.propose_types(Late(), "text", 7, attempts=2) == []
