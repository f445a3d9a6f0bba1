"""Printed-page and section cross-references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import page_references, strip


def page_offsets(pages: DataFrame, most: int = 40) -> DataFrame:
    """source, offset: the commonest physical less printed page number (0 to most) over all 1- to 3-digit numbers; the first met of equal ones; 0 where there is none."""
    n = pages.groupBy("source").agg(F.max("number").alias("n"))
    votes = pages.select("source", "number", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?U)\b(\d{1,3})\b"), F.lit(1))).alias("at", "p")).withColumn("p", F.col("p").cast("int"))
    votes = votes.join(n, "source").filter("p between 1 and n").withColumn("k", F.col("number") - F.col("p")).filter(F.col("k").between(0, most))
    tally = votes.groupBy("source", "k").agg(F.count("*").alias("c"), F.min(F.struct("number", "at")).alias("first"))
    w = Window.partitionBy("source").orderBy(F.desc("c"), "first")
    best = tally.withColumn("r", F.row_number().over(w)).filter("r = 1").select("source", "k")
    return n.select("source").join(best, "source", "left").select("source", F.coalesce("k", F.lit(0)).cast("int").alias("offset"))


def owners(spans: DataFrame) -> DataFrame:
    """source, number, slug: the wiki page of each physical page; of pages that overlap, the later one in reading order (column i, or the order of page_start)."""
    order = F.struct("i") if "i" in spans.columns else F.struct("page_start", "slug")
    rows = spans.filter("page_start <= page_end").select("source", "slug", order.alias("o"), F.explode(F.sequence("page_start", "page_end")).alias("number"))
    return rows.groupBy("source", "number").agg(F.max_by("slug", "o").alias("slug"))


def _edges(refs: DataFrame, where: DataFrame) -> DataFrame:
    """src, dst of refs(source, number, to), between the wiki pages of both."""
    src = refs.join(where.withColumnRenamed("slug", "src"), ["source", "number"])
    return src.join(where.select("source", F.col("number").alias("to"), F.col("slug").alias("dst")), ["source", "to"]).filter("src <> dst").select("src", "dst").distinct()


def page_reference_edges(pages: DataFrame, spans: DataFrame, offsets: DataFrame) -> DataFrame:
    """src, dst: wiki pages that refer to others by printed page. spans(source, slug, page_start, page_end[, i]); a reference stays in its source."""
    refs = pages.select("source", "number", F.explode(page_references(F.col("text"))).alias("printed")).join(offsets, "source").withColumn("to", F.col("printed") + F.col("offset"))
    return _edges(refs, owners(spans))


def section_pages(pages: DataFrame, header_lines: int = 3) -> DataFrame:
    """source, no, to: the first page whose header declares a numbered section or chapter."""
    split = F.transform(F.split("text", r"[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]"), strip)  # what stands between \r and \n is a blank line more, and those are left out
    lines = pages.select("source", "number", F.posexplode(F.slice(F.filter(split, lambda x: x != ""), 1, header_lines)).alias("line", "raw"))
    chapter = F.regexp_extract("raw", r"(?U)^Kapitel\s+(\d{1,3})\b", 1)
    section = F.regexp_extract("raw", r"(?U)^(\d{1,3}(?:\.\d{1,3})*)\s+[\w&&[^\d]][^\n]{1,70}?\s*$", 1)
    return lines.withColumn("no", F.when(chapter != "", chapter).otherwise(section)).filter("no <> ''").groupBy("source", "no").agg(F.min_by("number", F.struct("number", "line")).alias("to"))


def section_reference_edges(pages: DataFrame, spans: DataFrame, header_lines: int = 3) -> DataFrame:
    """src, dst: references to numbered sections, resolved to the first page of the same source whose header declares the number."""
    said = F.regexp_extract_all("text", F.lit(r"(?U)(?=[KA])\b(?:Kapiteln?|Kap\.|Abschnitte?|Abschn\.)\s+(\d{1,3}(?:\.\d{1,3})*)"), F.lit(1))
    return _edges(pages.select("source", "number", F.explode(said).alias("no")).join(section_pages(pages, header_lines), ["source", "no"]), owners(spans))


def references(pages: DataFrame, spans: DataFrame, offsets: DataFrame | None = None) -> DataFrame:
    """src, dst: all cross-references, by printed page and by section, each within its source. offsets(source, offset): found from the pages where not given."""
    offsets = page_offsets(pages) if offsets is None else offsets
    return page_reference_edges(pages, spans, offsets).unionByName(section_reference_edges(pages, spans)).distinct()
