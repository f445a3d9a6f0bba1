"""Readers and writers: documents of any source, JSON and wiki files there and back."""

import json
import sys
import threading
import types
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from scholia.operators import restructure
from scholia.sinks import wiki as sink
from scholia.sources import documents, readers


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture
def repo(tmp_path):
    files = {"README.md": "hello", "src/a.py": "print(1)\n```\n", "src/b.PY": "x", ".env": "no", "x.env": "K=1", "Dockerfile": "FROM x", "node_modules/z.js": "no", ".git/c.py": "no", "data.bin": "no", "nul.py": "a\0b", "big.py": "x" * 60, "bin/d.py": "no", "src/.h.py": "y", "src/__init__.py": "z"}
    for name, text in files.items():
        path = tmp_path / "proj" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return tmp_path / "proj"


def test_code(spark, repo):
    got = readers.code_files(spark, f"file://{repo}", max_bytes=50)
    assert [r.path for r in got.collect()] == ["Dockerfile", "README.md", "src/.h.py", "src/__init__.py", "src/a.py", "src/b.PY", "x.env"]
    d = documents.parse_source(spark, str(repo), max_pages=4)
    pages = rows(d.pages.select("number", "text"), "number")
    assert pages[0][1] == "# proj\n\n3 source file(s).\n\n## Files\n\n- `Dockerfile`\n- `README.md`\n- `big.py`"
    assert pages[1][1] == "`Dockerfile`\n\n````\nFROM x\n````" and pages[2][1] == "`README.md`\n\nhello" and pages[3][1].startswith("`big.py`\n\n````python\n")
    assert rows(d.outline.select("ord", "level", "title", "page"), "ord")[:2] == [(0, 1, "proj", 1), (1, 2, "Dockerfile", 2)] and d.meta.first().title == "proj" and d.meta.first().format == "code"
    assert "*(no source files found)*" in documents.code_documents(spark, str(repo), max_bytes=0).pages.first().text


def test_markdown_and_html(spark, tmp_path):
    (tmp_path / "a.md").write_text("pre\n# Intro\nx\n```\n# no\n~~~\n## Sub\ny\n# Methods ##\n")
    d = documents.parse_source(spark, str(tmp_path / "a.md"))
    assert rows(d.outline.select("level", "title", "page"), "page") == [(1, "Intro", 2), (2, "Sub", 3), (1, "Methods", 4)] and d.meta.first().title == "Intro" and d.meta.first().page_count == 4
    assert rows(d.pages.select("number", "text"), "number")[1] == (2, "# Intro\nx\n```\n# no\n~~~")
    assert documents.parse_source(spark, str(tmp_path / "a.md"), max_pages=2).pages.count() == 2
    (tmp_path / "b.txt").write_text("no heading")
    d = documents.parse_source(spark, str(tmp_path / "b.txt"))
    assert d.outline.count() == 0 and d.meta.first().title == "b"
    (tmp_path / "c.html").write_text("<p>pre<h2>Two</h2>x<h1>One</h1>y")
    d = documents.parse_source(spark, str(tmp_path / "c.html"))
    assert d.meta.first().title == "One" and rows(d.pages.select("number", "text"), "number") == [(1, "pre"), (2, "Two\nx"), (3, "One\ny")]
    with pytest.raises(ValueError):
        documents.parse_source(spark, str(tmp_path / "x.bin"))
    with pytest.raises(FileNotFoundError):
        documents.parse_source(spark, str(tmp_path / "none.md"))


def test_url(spark):
    class Page(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.send_header("Content-Type", "text/html; charset=latin-1")
            self.end_headers()
            self.wfile.write("<h1>Grüße</h1>x".encode("latin-1"))

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Page)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    d = documents.parse_source(spark, f"http://127.0.0.1:{server.server_port}/p")
    assert d.meta.first().title == "Grüße" and d.pages.first().text == "Grüße\nx"
    server.shutdown()


def test_sources(spark, repo, tmp_path):
    (tmp_path / "b.md").write_text("b")
    (tmp_path / "a.txt").write_text("a")
    names = lambda xs: [x.rsplit("/", 1)[1] for x in xs]
    assert names(documents.expand_sources([str(tmp_path), str(tmp_path / "*.md"), str(repo / "src")])) == ["a.txt", "b.md", "src"]
    assert documents.expand_sources(["HTTP://x/y"]) == ["HTTP://x/y"]
    with pytest.raises(FileNotFoundError):
        documents.expand_sources([str(tmp_path / "*.pdf")])
    assert documents.is_supported("x.HTM") and documents.is_supported(str(repo)) and not documents.is_supported("x.bin")
    assert documents.source_exists("http://x") and documents.source_exists(str(repo)) and not documents.source_exists(str(tmp_path / "none"))
    texts = readers.read_texts(spark, str(tmp_path / "b.md")).first()
    assert texts.text == "b" and texts.source.endswith("/b.md")


def test_json_round_trip(spark, tmp_path):
    whole = {"metadata": {"source_path": "x.pdf", "page_count": 2, "title": "X", "author": "me"}, "outline": [{"level": 1, "title": "A", "page": 1}, {"level": 2, "title": "B"}], "pages": [{"number": 1, "text": "one", "tables": [{"page_number": 1, "rows": [["h", None], ["a"]]}]}, {"number": 2}]}
    (tmp_path / "x.json").write_text(json.dumps(whole))
    d = documents.read_json(spark, str(tmp_path / "x.json"))
    again = documents.from_json(documents.to_json(d))
    for one, two, order in ((d.pages, again.pages, "number"), (d.outline, again.outline, "ord"), (d.meta, again.meta, "source")):
        assert rows(one, order) == rows(two, order)
    assert [(r.number, r.text, len(r.tables)) for r in d.pages.orderBy("number").collect()] == [(1, "one", 1), (2, "", 0)] and d.pages.orderBy("number").first().tables[0].rows == [["h", None], ["a"]]
    assert [(r.title, r.page) for r in d.outline.orderBy("ord").collect()] == [("A", 1), ("B", -1)] and d.stats() == {"pages": 2, "tables": 1, "images": 0}
    assert documents.read_json(spark, str(tmp_path / "x.json")).with_outline().outline.count() == 2


def test_pdf_through_a_stand_in(spark, tmp_path, monkeypatch):
    (tmp_path / "a.pdf").write_bytes(b"one\ntwo\none")
    (tmp_path / "fitz.py").write_text(
        "class Table:\n    bbox = (0, 0, 1, 1)\n    def extract(self):\n        return [['h'], [None]]\n"
        "class Found:\n    tables = [Table()]\n"
        "class Page:\n    def __init__(self, text):\n        self.text = text\n    def get_text(self):\n        return self.text\n"
        "    def find_tables(self):\n        if self.text == 'two':\n            raise ValueError('bad')\n        return Found()\n    def get_images(self, full):\n        return [(7,)]\n"
        "class Doc(list):\n    page_count = 3\n    metadata = {'title': 'T', 'author': None}\n    def get_toc(self):\n        return [[1, 'A', 1], [2, 'B', -1]]\n"
        "    def extract_image(self, x):\n        return {'ext': 'png', 'image': b'i', 'width': 1, 'height': 2}\n"
        "def open(stream, filetype):\n    return Doc(Page(x) for x in stream.decode().split())\n"
    )
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "fitz.py"))
    d = documents.parse_source(spark, str(tmp_path / "a.pdf"), image_dir=str(tmp_path / "img"))
    got = d.pages.orderBy("number").collect()
    assert [(r.number, r.text, len(r.tables), len(r.images)) for r in got] == [(1, "one", 1, 1), (2, "two", 0, 0), (3, "one", 1, 0)]
    assert rows(d.outline.select("title", "page"), "title") == [("A", 1), ("B", -1)] and d.meta.first().title == "T" and d.meta.first().author == ""
    assert (tmp_path / "img" / "a-p1-7.png").read_bytes() == b"i" and d.stats()["images"] == 1
    assert isinstance(sys.modules.pop("fitz", None), types.ModuleType | None)


def test_wiki_files(spark, tmp_path):
    pages = spark.createDataFrame([("s", n, t) for n, t in enumerate(["one", "two", "three"], 1)], "source string, number int, text string")
    outline = spark.createDataFrame([("s", 0, 1, "Ä one", 1), ("s", 1, 2, "Two", 2), ("s", 2, 3, "In two", 2), ("s", 3, 1, "Three", 3)], "source string, ord int, level int, title string, page int")
    cut = restructure.cuts(outline, pages)
    tree = restructure.slugged(restructure.assemble(cut, pages).join(restructure.parents(cut).select("source", "i", "parent"), ["source", "i"]))
    subs = restructure.subsections(cut, outline)
    (tmp_path / "w" / "pages").mkdir(parents=True)
    (tmp_path / "w" / "pages" / "999-old.md").write_text("old")
    assert sink.write_wiki(tree, subs, str(tmp_path / "w"), "My wiki", "s") == 3
    assert sorted(p.name for p in (tmp_path / "w" / "pages").glob("*.md")) == ["000-ae-one.md", "001-two.md", "002-three.md"]
    assert (tmp_path / "w" / "index.md").read_text() == "# My wiki\n\n- [Ä one](pages/000-ae-one.md)\n  - [Two](pages/001-two.md)\n- [Three](pages/002-three.md)\n"
    manifest = json.loads((tmp_path / "w" / "wiki.json").read_text())
    assert manifest["title"] == "My wiki" and manifest["page_count"] == 3 and [p["slug"] for p in manifest["pages"]] == ["000-ae-one", "001-two", "002-three"] and manifest["pages"][1]["subsections"] == [{"title": "In two", "level": 3}]
    assert rows(sink.read_manifest(spark, str(tmp_path / "w")).select("slug", "title"), "slug") == [("000-ae-one", "Ä one"), ("001-two", "Two"), ("002-three", "Three")]
    (tmp_path / "w" / "wiki.json").unlink()
    (tmp_path / "w" / "pages" / "plain.md").write_text("no heading")
    assert rows(sink.read_manifest(spark, str(tmp_path / "w")), "slug")[2:] == [("002-three", "Three"), ("plain", "plain")]
