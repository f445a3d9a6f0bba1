"""Parsed documents: any source to pages, outline and metadata; the same as JSON and back."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tables import file_system
from ..operators import restructure
from . import html, readers

MARKDOWN, HTML, PDF = (".md", ".markdown", ".txt"), (".html", ".htm"), (".pdf",)
TABLE = "struct<page_number:int,rows:array<array<string>>,bbox:array<double>>"
IMAGE = "struct<page_number:int,xref:int,path:string,width:int,height:int,ext:string>"
META = ("source_path string", "page_count int", "title string", "author string", "subject string", "keywords string", "creator string", "producer string", "format string")
PAGES = f"source string, number int, text string, tables array<{TABLE}>, images array<{IMAGE}>"
JSON = f"metadata struct<{','.join(x.replace(' ', ':') for x in META)}>, outline array<struct<level:int,title:string,page:int>>, pages array<struct<number:int,text:string,tables:array<{TABLE}>,images:array<{IMAGE}>>>"


@dataclass
class Documents:
    """pages(source, number, text, tables, images), outline(source, ord, level, title, page), meta(source, source_path, page_count, title, ..., format), all by source."""

    pages: DataFrame
    outline: DataFrame
    meta: DataFrame

    def __add__(self, other: Documents) -> Documents:
        return Documents(*(a.unionByName(b) for a, b in ((self.pages, other.pages), (self.outline, other.outline), (self.meta, other.meta))))

    def with_outline(self, header_lines: int = 4) -> Documents:
        """Documents without an outline get one from their running headers."""
        bare = self.pages.join(self.outline.select("source"), "source", "left_anti")
        return Documents(self.pages, self.outline.unionByName(restructure.synthesize_outline(bare, header_lines)), self.meta)

    def stats(self) -> dict:
        n = self.pages.agg(F.count("*").alias("pages"), F.sum(F.size("tables")).alias("tables"), F.sum(F.size("images")).alias("images")).first()
        return {"pages": n["pages"], "tables": n["tables"] or 0, "images": n["images"] or 0}


def documents_of(sections: DataFrame, kind: str, fallback=None, path=None) -> Documents:
    """Sections(source, ord, level, title, text) as documents: section i is page i + 1; those with a title are the outline; the first title of level 1 that isn't empty is the document's, else ``fallback`` (a column of source)."""
    empty = [F.array().cast(f"array<{t}>").alias(c) for c, t in (("tables", TABLE), ("images", IMAGE))]
    number = (F.col("ord") + 1).cast("int")
    pages = sections.select("source", number.alias("number"), "text", *empty)
    outline = sections.filter("title is not null").select("source", F.col("ord").cast("int").alias("ord"), F.col("level").cast("int").alias("level"), "title", number.alias("page"))
    first = F.min_by("title", F.when((F.col("level") == 1) & (F.col("title") != ""), F.col("ord")))
    name = T.source_stem(F.col("source")) if fallback is None else fallback
    of = sections.groupBy("source").agg(F.count("*").cast("int").alias("page_count"), first.alias("t"))
    blank = [F.lit("").alias(c) for c in ("author", "subject", "keywords", "creator", "producer")]
    meta = of.select("source", (F.col("source") if path is None else F.lit(path)).alias("source_path"), "page_count", F.coalesce("t", name).alias("title"), *blank, F.lit(kind).alias("format"))
    return Documents(pages, outline, meta)


def is_url(source: str) -> bool:
    return source.lower().startswith(("http://", "https://"))


def is_supported(source: str) -> bool:
    return is_url(source) or os.path.isdir(source) or os.path.splitext(source)[1].lower() in (*MARKDOWN, *HTML, *PDF)


def source_exists(source: str) -> bool:
    """A URL is taken to be there."""
    return is_url(source) or os.path.exists(source)


def fetch(urls: DataFrame, timeout: float = 30.0, agent: str = "scholia/1") -> DataFrame:
    """source, text of urls(source): what each URL gives, in the character set that it names, else UTF-8."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for url in f["source"]:
                with urlopen(Request(url, headers={"User-Agent": agent}), timeout=timeout) as r:
                    out.append(r.read().decode(r.headers.get_content_charset() or "utf-8", "replace"))
            yield pd.DataFrame({"source": f["source"], "text": out})

    return urls.select("source").mapInPandas(run, "source string, text string")


def html_documents(texts: DataFrame, max_pages: int | None = None) -> Documents:
    """Documents of texts(source, text) in HTML."""
    return documents_of(html.html_sections(texts.select("source", "text"), "text", max_pages).select("source", "ord", "level", "title", "text"), "html")


def markdown_documents(texts: DataFrame, max_pages: int | None = None) -> Documents:
    return documents_of(readers.markdown_sections(texts, max_pages), "markdown")


def code_documents(spark: SparkSession, root: str, max_pages: int | None = None, max_bytes: int = 500_000) -> Documents:
    name = os.path.basename(os.path.abspath(urlsplit(root).path)) or "repo"
    return documents_of(readers.code_sections(readers.code_files(spark, root, max_bytes), name, max_pages), "code", F.lit(name), root)


def pdf_documents(spark: SparkSession, path: str, max_pages: int | None = None, tables: bool = True, image_dir: str | None = None) -> Documents:
    """Documents of PDF files, by PyMuPDF where it is installed; a table that can't be read is left out; an image is written once a document, at its first page, below image_dir: a folder that all executors see."""
    import importlib

    importlib.import_module("fitz")  # say here, not in a task, that it is missing
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("source"), "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz

        for f in frames:
            for source, content in zip(f["source"], f["content"], strict=True):
                doc, rows, seen = fitz.open(stream=bytes(content), filetype="pdf"), [], set()
                for k, page in enumerate(doc):
                    if max_pages is not None and k >= max_pages:
                        break
                    found, images = [], []
                    if tables:
                        try:
                            found = [{"page_number": k + 1, "rows": t.extract(), "bbox": [float(x) for x in t.bbox]} for t in page.find_tables().tables]
                        except Exception:  # noqa: BLE001  a page whose tables can't be read still has its text
                            found = []
                    for x in page.get_images(full=True) if image_dir else ():
                        if x[0] not in seen:
                            seen.add(x[0])
                            image = doc.extract_image(x[0])
                            name = f"{image_dir}/{os.path.splitext(os.path.basename(source))[0]}-p{k + 1}-{x[0]}.{image['ext']}"
                            fs, at = file_system(name)
                            fs.create_dir(os.path.dirname(at), recursive=True)
                            with fs.open_output_stream(at, compression=None) as out:
                                out.write(image["image"])
                            images.append({"page_number": k + 1, "xref": x[0], "path": name, "width": image["width"], "height": image["height"], "ext": image["ext"]})
                    rows.append({"number": k + 1, "text": page.get_text(), "tables": found, "images": images})
                about = doc.metadata or {}
                entries = [{"level": level, "title": title, "page": page} for level, title, page, *_ in doc.get_toc()]
                yield pd.DataFrame({"source": [source], "metadata": [{"source_path": source, "page_count": doc.page_count} | {c: about.get(c) or "" for c in ("title", "author", "subject", "keywords", "creator", "producer", "format")}], "outline": [entries], "pages": [rows]})

    return _split(files.mapInPandas(run, f"source string, {JSON}"))


def parse_source(spark: SparkSession, source: str, max_pages: int | None = None, tables: bool = True, image_dir: str | None = None) -> Documents:
    """Documents of a URL, folder or file, by its kind."""
    end = os.path.splitext(source)[1].lower()
    if is_url(source):
        return html_documents(fetch(spark.createDataFrame([(source,)], "source string")), max_pages)
    if os.path.isdir(source):
        return code_documents(spark, source, max_pages)
    if end in PDF:
        return pdf_documents(spark, source, max_pages, tables, image_dir)
    if end not in (*MARKDOWN, *HTML):
        raise ValueError(f"unsupported source type {end or '(none)'!r}: {source}")
    if not os.path.isfile(source):
        raise FileNotFoundError(source)
    texts = spark.read.text(source, wholetext=True).select(F.lit(source).alias("source"), F.col("value").alias("text"))
    return html_documents(texts, max_pages) if end in HTML else markdown_documents(texts, max_pages)


def expand_sources(specs: list[str]) -> list[str]:
    """Files and URLs of specs: a folder stands for its supported files (itself, as code, if it has none), a pattern for what it matches; each once, in order."""
    out: dict[str, str] = {}
    for spec in specs:
        if is_url(spec):
            found = [spec]
        elif os.path.isdir(spec):
            inside = sorted(e.path for e in os.scandir(spec) if e.is_file() and os.path.splitext(e.name)[1].lower() in (*MARKDOWN, *HTML, *PDF))
            found = inside or [spec]
        elif any(c in spec for c in "*?["):
            found = sorted(x for x in glob.glob(spec) if is_supported(x))
        else:
            found = [spec] if os.path.exists(spec) else []
        if not found:
            raise FileNotFoundError(f"nothing to read at {spec}")
        for x in found:
            out.setdefault(x if is_url(x) else os.path.realpath(x), x)
    return list(out.values())


def to_json(docs: Documents) -> DataFrame:
    """source, json: each document as one JSON object. A document fits into a row; a corpus need not."""
    of = lambda df, order, *cols: df.groupBy("source").agg(F.array_sort(F.collect_list(F.struct(order, F.struct(*cols).alias("x")))).alias("s")).select("source", F.transform("s", lambda s: s["x"]).alias("x"))
    pages, outline = of(docs.pages, "number", "number", "text", "tables", "images"), of(docs.outline, "ord", "level", "title", "page")
    about = F.struct(*[x.split()[0] for x in META])
    rows = docs.meta.select("source", about.alias("metadata")).join(outline.withColumnRenamed("x", "outline"), "source", "left").join(pages.withColumnRenamed("x", "pages"), "source", "left")
    return rows.select("source", F.to_json(F.struct("metadata", "outline", "pages")).alias("json"))


def from_json(rows: DataFrame) -> Documents:
    """Documents of rows(source, json); outline, pages, tables, images and texts may be missing."""
    return _split(rows.select("source", F.from_json("json", JSON).alias("d")).select("source", "d.*"))


def _split(whole: DataFrame) -> Documents:
    none = lambda t: F.array().cast(f"array<{t}>")
    p = whole.select("source", F.explode("pages").alias("p"))
    pages = p.select("source", "p.number", F.coalesce("p.text", F.lit("")).alias("text"), F.coalesce("p.tables", none(TABLE)).alias("tables"), F.coalesce("p.images", none(IMAGE)).alias("images"))
    outline = whole.select("source", F.posexplode("outline").alias("ord", "o")).select("source", "ord", "o.level", "o.title", F.coalesce("o.page", F.lit(-1)).alias("page"))
    return Documents(pages, outline, whole.select("source", "metadata.*"))


def read_json(spark: SparkSession, path: str) -> Documents:
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("json"))
    return from_json(rows)
