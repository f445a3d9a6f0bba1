"""A wiki as files: a Markdown file a page, an index, a manifest; and the manifest read back.

Pages are written by the tasks that hold them; the driver streams the index and the manifest, a line or an entry at a time.
"""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import file_system, read_files
from ..functions.text import strip
from ..operators import render


def write_wiki(tree: DataFrame, subs: DataFrame, folder: str, title: str = "", source: str = "") -> int:
    """Writes pages/SLUG.md, index.md and wiki.json of one wiki's page tree below a folder that all executors see; files of pages that are gone are deleted. Gives the number of pages."""
    fs, top = file_system(folder)
    fs.create_dir(f"{top}/pages", recursive=True)
    for old in fs.get_file_info(pafs.FileSelector(f"{top}/pages")):
        if old.base_name.endswith(".md"):
            fs.delete_file(old.path)

    def put(frames):
        own, at = file_system(folder)
        for f in frames:
            for slug, markdown in zip(f["slug"], f["markdown"], strict=True):
                with own.open_output_stream(f"{at}/pages/{slug}.md", compression=None) as out:
                    out.write(markdown.encode())
            yield pd.DataFrame({"n": [len(f)]})

    n = render.page_markdown(tree, subs).select("slug", "markdown").mapInPandas(put, "n long").agg(F.sum("n")).first()[0] or 0
    with fs.open_output_stream(f"{top}/index.md", compression=None) as out:
        out.write(f"# {title}\n\n".encode())
        for r in render.index_lines(tree).orderBy("source", "i").toLocalIterator():
            out.write(f"{r['line']}\n".encode())
    with fs.open_output_stream(f"{top}/wiki.json", compression=None) as out:
        out.write(('{"title": ' + json.dumps(title, ensure_ascii=False) + ', "source": ' + json.dumps(source, ensure_ascii=False) + f', "page_count": {n}, "pages": [').encode())
        for k, r in enumerate(render.manifest(tree, subs).orderBy("source", "i").toLocalIterator()):
            out.write((("," if k else "") + "\n" + r["entry"]).encode())
        out.write(b"\n]}\n")
    return n


def write_pages(pages: DataFrame, folder: str) -> int:
    """Writes pages(slug, text) as files of a wiki's folder, in place of those of the same slugs; gives their number. A file is whole before it gets its name."""

    def put(frames):
        fs, top = file_system(folder)
        fs.create_dir(f"{top}/pages", recursive=True)
        for f in frames:
            for slug, text in zip(f["slug"], f["text"], strict=True):
                mine = f"{top}/pages/.{slug}.{uuid.uuid4().hex}"
                with fs.open_output_stream(mine, compression=None) as out:
                    out.write(text.encode())
                fs.move(mine, f"{top}/pages/{slug}.md")
            yield pd.DataFrame({"n": [len(f)]})

    return pages.select("slug", "text").mapInPandas(put, "n long").agg(F.sum("n")).first()[0] or 0


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """slug, title of a wiki's pages, in order: of wiki.json where there is one, else of the files, with the first heading as title."""
    fs, top = file_system(folder)
    if fs.get_file_info(f"{top}/wiki.json").type == pafs.FileType.File:
        whole = spark.read.text(f"{folder}/wiki.json", wholetext=True)
        pages = F.from_json("value", "pages array<struct<slug:string,title:string,level:int,pdf_page_start:int,pdf_page_end:int,parent:string,children:array<string>>>")["pages"]
        return whole.select(F.posexplode(pages).alias("ord", "p")).select("ord", "p.*").orderBy("ord")
    return read_pages(spark, folder).withColumn("title", F.coalesce(F.nullif(strip(F.regexp_extract("text", r"(?m)^# (.*)$", 1)), F.lit("")), "slug")).select("slug", "title").orderBy("slug")


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """slug, text of the page files."""
    fs, top = file_system(folder)
    names = sorted(x.base_name for x in fs.get_file_info(pafs.FileSelector(f"{top}/pages", allow_not_found=True)) if x.base_name.endswith(".md"))
    return read_files(spark, f"{folder}/pages", names).select(F.regexp_extract("name", r"^(.*)\.md$", 1).alias("slug"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
