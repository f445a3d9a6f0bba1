import json

import numpy as np
from pyspark.sql import functions as F

from scholia.functions import ontology
from scholia.functions import text as T
from scholia.operators import edit, evaluate, graph, references, render, restructure, sample, vector
from scholia.plans import build, catalog
from scholia.sinks.versions import Store
from scholia.sources import html, readers
from scholia.streaming import upsert


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()[0]


def test_windows_and_text(spark):
    assert one(spark, "a b c d e", lambda c: T.windows(c, 2, 1)) == ["a b", "b c", "c d", "d e"]
    assert one(spark, " \n ", T.windows) == []
    assert one(spark, "a\nb\n\nc\td", T.normalize_text) == "a b\nc d"
    assert one(spark, "x <think>a\nb</think>done", T.strip_think) == "x done"
    assert one(spark, "see [1] and [12], [1]", T.citations) == [1, 12]
    assert one(spark, "<think>A</think> I choose B.", T.verdict) == "b"
    assert one(spark, "no idea", T.verdict) == "tie"
    for title in ("Über/Größe »x«", "  ", "Škoda Łódź ő", "ﬁne ½ ㎏ x²", "\u00a0Café — №5\t", "Ελλάδα", "𝐁old", "x" * 70, "a" * 59 + "- b", "日本 ABC", "Ǆ é\u0301"):
        assert T.slugify(title) == one(spark, title, T.slug), title
    assert T.slugify("Über/Größe »x«") == "ueber-groesse-x" and T.slugify("Škoda Łódź ő") == "skoda-odz-o" and T.slugify("  ") == "section"
    assert one(spark, "<think>a</think>\n\n\u00a0Yes [1]\n", T.strip_think) == "Yes [1]"
    assert one(spark, "\t\u2003a b\x85\n", T.strip) == "a b" and one(spark, " \u00a0", T.strip) == ""
    assert [one(spark, x, T.source_type) for x in ("HTTP://a/b.pdf", "x/y.HTML", "a.pdf", "a.txt", "a.markdown", "src", "a.bin")] == ["web", "web", "pdf", "text", "markdown", "unknown", "unknown"]
    assert spark.range(1).select(T.source_type(F.lit("src"), True)).first()[0] == "code"
    stems = {"https://en.example.org/wiki/Graph_theory": "Graph_theory", "http://a.org/x/page.html?q=1": "page", "http://a.org/": "a.org", "docs/a.b.pdf": "a.b", "a.pdf": "a", "http://a.org/ü b.php": "ü-b"}
    assert {x: one(spark, x, T.source_stem) for x in stems} == stems
    names = [("ab", True), ("a", False), ("123", False), ("x" * 41, False), ("x1", True)]
    assert [one(spark, x, T.entity_name_ok) for x, _ in names] == [ok for _, ok in names]
    assert one(spark, "Die Hüllkurven", T.entity_key_name) == one(spark, "hullkurve", T.entity_key_name)


def test_restructure(spark):
    pages = spark.createDataFrame([("s", 1, "intro text"), ("s", 2, "usage text"), ("s", 3, "reference text")], "source string, number int, text string")
    outline = spark.createDataFrame([("s", 0, 1, "Intro", 1), ("s", 1, 2, "Setup", 1), ("s", 2, 2, "Usage", 2), ("s", 3, 3, "Details", 2), ("s", 4, 1, "Reference", 3)], "source string, ord int, level int, title string, page int")
    cut = restructure.cuts(outline, pages)
    got = restructure.assemble(cut, pages).orderBy("i").collect()
    assert [(r.title, r.page_start, r.page_end, r.text) for r in got] == [("Intro", 1, 1, "intro text"), ("Usage", 2, 2, "usage text"), ("Reference", 3, 3, "reference text")]
    assert [r.parent for r in restructure.parents(cut).orderBy("i").collect()] == [None, 0, None]
    subs = restructure.subsections(cut, outline).orderBy("sub_ord").collect()
    assert [(r.i, r.sub_title) for r in subs] == [(0, "Setup"), (1, "Details")]
    late = outline.filter("ord = 4")
    assert [r.title for r in restructure.cuts(late, pages).orderBy("i").collect()] == ["Front Matter", "Reference"]


def test_outline_synthesis(spark):
    texts = ["cover", "10 Big Topic 7\nx", "10.1 First\nx", "10.1 First\ny", "10.2 Second\nz", "10.3 Third"]
    pages = spark.createDataFrame([("s", i + 1, t) for i, t in enumerate(texts)], "source string, number int, text string")
    got = [(r.level, r.title, r.page) for r in restructure.synthesize_outline(pages).orderBy("ord").collect()]
    assert got == [(1, "10.1 First", 3), (1, "10.2 Second", 5), (1, "10.3 Third", 6)]
    assert restructure.synthesize_outline(pages.filter("number < 4")).count() == 0


def test_references(spark):
    rows = [("s", p, f"{p - 2} Seite 4" if p == 3 else f"{p - 2}" if p > 2 else "x") for p in range(1, 7)]
    pages = spark.createDataFrame(rows, "source string, number int, text string")
    offsets = references.page_offsets(pages)
    assert offsets.first().offset == 2
    spans = spark.createDataFrame([("s", f"p{i}", i, i) for i in range(1, 7)], "source string, slug string, page_start int, page_end int")
    assert [tuple(r) for r in references.page_reference_edges(pages, spans, offsets).collect()] == [("p3", "p6")]


def test_markdown_html(spark):
    docs = spark.createDataFrame([("a", "pre\n# Intro\nx\n```\n# no\n```\n## Sub\ny\n# Methods ##\n")], "source string, text string")
    got = [(r.level, r.title) for r in readers.markdown_sections(docs).orderBy("ord").collect()]
    assert got == [(1, None), (1, "Intro"), (2, "Sub"), (1, "Methods")]
    page = "<head><title>t</title></head><nav>no</nav><p>pre</p><h1>A</h1><p>x</p><h2>B <i>c</i></h2>y<script>no</script><h1>D</h1>"
    got = html.html_sections(spark.createDataFrame([(page,)], "html string")).orderBy("ord").collect()
    assert [(r.level, r.title) for r in got] == [(1, None), (1, "A"), (2, "B c"), (1, "D")] and "no" not in " ".join(r.text for r in got)
    assert [r.title for r in readers.markdown_sections(docs, max_pages=2).orderBy("ord").collect()] == [None, "Intro"]


HTML = {
    "<header><h1>In header</h1></header>x": [(1, "In header", "In header\nx")],
    "<template>no</template>yes<svg>no</svg>": [(1, None, "yes")],
    "a<br>b<br/>c<hr>d<hr/>e": [(1, None, "ab\nc d\ne".replace("c d", "cd"))],
    "<p>a</p><p>b</p>": [(1, None, "a\nb")],
    "<div><p>a</p></div>\n\n<div>\n\n<p>b</p></div>": [(1, None, "a\n\nb")],
    "<figure>x<figcaption>cap</figcaption></figure>y": [(1, None, "x\ncapy")],
    "<h3> T </h3><h2></h2><p>z": [(3, "T", "T"), (2, None, "z")],
    "<aside>no<form>no</form></aside>a  b\t c": [(1, None, "a b c")],
    "<title>doc</title><h1>A</h1>": [(1, "A", "A")],
    "x &amp; y&nbsp;z": [(1, None, "x & y\xa0z")],
    "": [],
    "<!-- <h1>no</h1> -->a<!DOCTYPE x><h1 class='a>b'>Q</h1>c<form>rest <h2>gone": [(1, None, "a"), (1, "Q", "Q\nc")],
    "<script>var a = '<h1>x</h1>'; </scriptx> </script>z<script>never ends <h1>": [(1, None, "z")],
    "a < b <h2>open <p>para": [(1, None, "a < b"), (2, "open para", "open\npara")],
    "<H1>Big</H1 ><P/>t<style/>u": [(1, "Big", "Big\ntu")],
}


def test_html_rules(spark):
    df = spark.createDataFrame(list(enumerate(HTML)), "n int, html string")
    got = {n: [] for n in range(len(HTML))}
    for r in html.html_sections(df).orderBy("n", "ord").collect():
        got[r.n].append((r.level, r.title, r.text))
    assert [got[n] for n in range(len(HTML))] == list(HTML.values())


def test_eval_and_graph(spark):
    lines = spark.createDataFrame([("# c",), ("",), ('{"question": "q", "pages": "a"}',), ('{"question": "r", "expected": ["a", "b"]}',)], "value string")
    assert [(r.question, r.expected) for r in readers.eval_set(lines).collect()] == [("q", ["a"]), ("r", ["a", "b"])]
    df = spark.createDataFrame([(list("abcd"), ["c"]), (list("abcd"), ["x"])], "ranked array<string>, expected array<string>")
    r = evaluate.report(df, 3).first()
    assert (r.n, round(r.mrr, 6), r.hit_rate, r.misses) == (2, round(1 / 6, 6), 0.5, 1)
    e = spark.createDataFrame([("b", "a", "CHILD_OF", None), ("a", "b", "NEXT", None), ("b", "c", "NEXT", None), ("a", "c", "SIMILAR_TO", 0.5)], "src string, dst string, rel string, score double")
    m = spark.createDataFrame([("a", "e1"), ("b", "e1"), ("b", "e2"), ("c", "e2")], "page string, entity string")
    near = {(r.src, r.node): r.rel for r in graph.neighborhood(e, m).collect()}
    assert near["a", "b"] == "child" and near["b", "a"] == "parent" and near["a", "c"] == "similar" and near["c", "b"] == "prev"
    assert graph.find_path(e, "a", "c") == (["a", "c"], ["SIMILAR_TO"]) and graph.find_path(e, "a", "a") == (["a"], [])
    assert tuple(graph.singletons(m).first()) == (2, 0, 2)


def test_graph_rag(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((450, 6)) + np.repeat(rng.standard_normal((15, 6)), 30, axis=0)
    page = np.arange(450) // 30
    ships = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, 25, 300), rng.integers(0, 80, 300), strict=True)})
    spark.createDataFrame([(i, x[i].tolist(), int(page[i])) for i in range(450)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame(ships, "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = np.stack([u[page == p].mean(0) for p in range(15)])
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    by = {p: {e for s, e in ships if s == p} for p in range(15)}
    want, only_shared = set(), False
    for q in range(0, 450, 100):
        score = np.round(u @ u[q], 12)
        top = sorted(range(450), key=lambda i: (-score[i], i))
        seeds = {int(page[i]) for i in top[:5]}
        similar, shared = set(), set()
        for p in seeds:
            others = [o for o in range(15) if o != p]
            similar |= set(sorted((o for o in others if c[p] @ c[o] > 0), key=lambda o: -(c[p] @ c[o]))[:6])
            shared |= set(sorted((o for o in others if by[p] & by[o]), key=lambda o: (-len(by[p] & by[o]), o))[:6])
        best = [next(i for i in top if page[i] == p) for p in (similar | shared) - seeds]
        more = sorted(best, key=lambda i: (-score[i], i))[:3]
        only_shared |= any(int(page[i]) not in similar for i in more)
        want |= {(q, i, int(page[i]), k + 1, "seed") for k, i in enumerate(top[:5])} | {(q, i, int(page[i]), k + 6, "related") for k, i in enumerate(more)}
    assert only_shared
    assert {(r.qid, r.id, r.page, r.marker, r.kind) for r in catalog.graph_rag(spark, str(tmp_path)).collect()} == want


def test_similar_skips_structure(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.5, 0.5])], "id long, emb array<double>")
    s = spark.createDataFrame([(1, 2)], "a long, b long")
    assert [r.b for r in vector.similar(v, 1, structural=s).filter("a = 1").collect()] == [3]


def test_upsert_and_stream(spark, tmp_path):
    pages = spark.createDataFrame([("a", "A")], "slug string, title string")
    chunks = spark.createDataFrame([("a#0", "a", 0, "old")], "id string, slug string, chunk_index int, text string")
    edits = spark.createDataFrame([("a", "# New\nbody", None)], "slug string, text string, title string")
    p, c = upsert.upsert_pages(pages, chunks, edits)
    assert [tuple(r) for r in p.collect()] == [("a", "New")] and [r.text for r in c.collect()] == ["# New body"]
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "slug string, version int, text string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    upsert.stream_latest(stream, f"file://{tmp_path}/out", str(tmp_path / "cp")).awaitTermination()
    kept = lambda: sorted(tuple(r) for r in Store(spark, f"file://{tmp_path}/out").read("latest").select("slug", "version", "text").collect())
    assert kept() == [("a", 2, "y"), ("b", 1, "z")]
    spark.createDataFrame([("a", 3, "w"), ("c", 1, "v"), ("b", 0, "old")], rows.schema).write.mode("append").parquet(str(tmp_path / "in"))
    upsert.stream_latest(stream, f"file://{tmp_path}/out", str(tmp_path / "cp")).awaitTermination()
    assert kept() == [("a", 3, "w"), ("b", 1, "z"), ("c", 1, "v")]
    assert sorted((r.slug, r.version, r.revision) for r in upsert.running_versions(rows, "slug", "version").collect()) == [("a", 1, 1), ("a", 2, 2), ("b", 1, 1)]


def test_render(spark):
    rows = [("s", 0, "000-a", "A", 1, 1, 2, "text a", None), ("s", 1, "001-b", "B", 2, 3, 3, "", 0), ("s", 2, "002-c", "C", 1, 4, 4, None, None)]
    pages = spark.createDataFrame(rows, "source string, i int, slug string, title string, level int, page_start int, page_end int, text string, parent int")
    subs = spark.createDataFrame([("s", 0, 5, "Sub", 3)], "source string, i int, sub_ord int, sub_title string, sub_level int")
    assert [r.line for r in render.index_lines(pages).orderBy("i").collect()] == ["- [A](pages/000-a.md)", "  - [B](pages/001-b.md)", "- [C](pages/002-c.md)"]
    a, b, c = (r.markdown for r in render.page_markdown(pages, subs).orderBy("i").collect())
    assert a == "# A\n\n[🏠 Home](../index.md) › A\n\n*PDF pages 1–2*\n\n**Subpages**\n\n- [B](001-b.md)\n\n**Contents**\n\n  - Sub\n\n---\n\ntext a\n\n\n---\n\n[B](001-b.md) →\n"
    assert "[🏠 Home](../index.md) › [A](000-a.md) › B" in b and b.endswith("← [A](000-a.md) · ↑ [A](000-a.md) · [C](002-c.md) →\n") and c.endswith("---\n\n\n---\n\n← [B](001-b.md)\n")
    got = [json.loads(r.entry) for r in render.manifest(pages, subs).orderBy("i").collect()]
    assert got[0]["children"] == ["001-b"] and got[1]["parent"] == "000-a" and got[2]["parent"] is None and got[0]["subsections"] == [{"title": "Sub", "level": 3}]


def test_edits_samples_and_builds(spark):
    pages = spark.createDataFrame([("a", "x y x"), ("b", "one\n---\nfoot")], "slug string, text string")
    rows = [("a", "edit", "x", "z"), ("b", "append", "H", "body"), ("c", "create", "T", " body "), ("d", "edit", "x", "y"), ("e/", "create", "T", "b")]
    got = {r.slug: (r.status, r.text) for r in edit.apply_edits(pages, spark.createDataFrame(rows, "slug string, kind string, old string, new string")).collect()}
    assert got == {"a": ("not unique", "x y x"), "b": ("ok", "one\n\n## H\n\nbody\n\n---\nfoot"), "c": ("ok", "# T\n\nbody\n"), "d": ("missing", None), "e/": ("invalid slug", None)}
    texts = spark.createDataFrame([("s", i, f"t{i}" if i % 2 else " ") for i in range(20)], "source string, ord int, text string")
    assert sample.sample_corpus(texts, n=3).first().sample == "t1\n---\nt7\n---\nt13"
    kinds = spark.createDataFrame([(0, " Tool", None), (1, "tool", "x"), (2, "", "y"), (3, "Part", "z")], "ord int, name string, description string")
    assert [tuple(r) for r in sample.distinct_types(kinds).collect()] == [(0, "Tool", ""), (3, "Part", "z")]
    now = build.fingerprints([["a.md", 3, 1]], {})
    there = dict.fromkeys(build.STAGES, True)
    assert build.stale(now, now, there) == [] and build.stale(now, now, there, force=True) == list(build.STAGES)
    assert build.stale(now, build.fingerprints([["a.md", 3, 1]], {"similar_k": 9}), there) == ["graph"]
    assert build.status(now, now, there | {"wiki": False})["wiki"] == "missing" and build.stale({}, now, there, only={"index"}) == ["index"]


def test_cuts_stay_themselves_in_joins(spark):
    pages = spark.createDataFrame([(f"s{s}", p, f"t{p}") for s in range(20) for p in range(1, 8)], "source string, number int, text string")
    outline = spark.createDataFrame([(f"s{s}", p, 1 + p % 2, f"c{p}", p) for s in range(19) for p in range(2, 8)], "source string, ord int, level int, title string, page int")
    cut = restructure.cuts(outline.repartition(7), pages.repartition(5))
    both = restructure.assemble(cut, pages).join(restructure.parents(cut).select("source", "i", "parent"), ["source", "i"]).collect()
    want = [("Front Matter", None), *((f"c{p}", p - 2 if p % 2 else None) for p in range(2, 8))]
    assert sorted((r.source, r.i, r.title, r.parent) for r in both) == sorted([(f"s{s}", i, *x) for s in range(19) for i, x in enumerate(want)] + [("s19", 0, "Front Matter", None)])


def test_document_markdown_and_summary(spark):
    meta = spark.createDataFrame([("s", "T", "a.pdf", 2, ""), ("e", "", None, 0, None)], "source string, title string, source_path string, page_count int, author string")
    outline = spark.createDataFrame([("s", 0, 1, "A", 1), ("s", 1, 2, "B", 2)], "source string, ord int, level int, title string, page int")
    rows = [("s", 1, " x ", [{"rows": [["h", None], ["a\nb"]]}]), ("s", 2, None, None)]
    pages = spark.createDataFrame(rows, "source string, number int, text string, tables array<struct<rows:array<array<string>>>>")
    got = {(r.source, r.ord): r.markdown for r in render.document_markdown(meta, outline, pages).collect()}
    assert got["s", 0] == "# T\n\n## Document metadata\n\n- **Source:** a.pdf\n- **Pages:** 2\n\n## Table of contents\n\n- A (p. 1)\n  - B (p. 2)\n"
    assert got["s", 1] == "\n---\n\n## Page 1\n\nx\n\n\n**Table 1.1**\n\n| h |  |\n| --- | --- |\n| a b |  |\n"
    assert got["s", 2] == "\n---\n\n## Page 2\n" and got["e", 0] == "# Untitled Document\n\n## Document metadata\n\n"
    tree = spark.createDataFrame([("s", i, f"p{i}", None if i % 2 == 0 else i - 1) for i in range(30)], "source string, i int, title string, parent int")
    assert render.summary(tree).first().summary == "s: " + "; ".join(f"p{i}" for i in range(0, 24, 2)) + "; …"


def test_ontology():
    assert ontology.types_of(None) == ontology.types_of([" "]) == ontology.types_of({}) == ontology.DEFAULT_TYPES
    assert ontology.types_of([" A : x ", "B"]) == ontology.types_of({"A": "x ", " ": "y", "B": ""}) == {"A": "x", "B": ""}
    assert ontology.lines_of([{"name": "A", "description": " x"}, "B", {"name": " "}]) == ["A: x", "B"]
