"""Documents to page trees: cuts of an outline, page assembly, parents, subsections, merging, outline synthesis.

All functions work on many documents at once, by the key column ``source``; windows never cross it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prefix import running_total
from ..functions.text import slug, strip


def cuts(outline: DataFrame, pages: DataFrame, split_level: int = 2) -> DataFrame:
    """source, i, page, next_page, title, level, ord: where pages begin. Entries of one page in a row are one cut; a Front Matter page goes first where needed."""
    if split_level < 1:
        raise ValueError("split_level must be at least 1")
    top = pages.groupBy("source").agg(F.max("number").alias("last")).filter("last >= 1")
    o = outline.select(F.col("source").alias("_of"), "ord", "page", "title", "level")
    o = top.join(o, (F.col("source") == F.col("_of")) & (F.col("level") <= split_level) & F.col("page").between(1, F.col("last")), "left")
    w = Window.partitionBy("source").orderBy("ord")
    o = o.withColumn("before", F.lag("page").over(w)).filter("before is null or before <> page")
    # the front matter comes out of its source's first row, not of a union: after one, Spark 4.1 may take a source's rows for being in one partition where they are not
    own, front = F.struct("ord", "page", "title", "level"), F.struct(F.lit(-1).alias("ord"), F.lit(1).alias("page"), F.lit("Front Matter").alias("title"), F.lit(1).alias("level"))
    first = F.col("before").isNull() & (F.col("page").isNull() | (F.col("page") > 1))
    every = o.select("source", "last", F.explode(F.array_compact(F.array(F.when(first, front), F.when(F.col("page").isNotNull(), own)))).alias("c")).select("source", "last", "c.*")
    return every.select("source", (F.row_number().over(w) - 1).alias("i"), "page", F.lead("page", 1).over(w).alias("n"), "title", "level", "ord", "last").withColumn("next_page", F.coalesce("n", F.col("last") + 1)).drop("n")


def assemble(cut: DataFrame, pages: DataFrame, *along: str) -> DataFrame:
    """source, i, title, level, ord, page_start, page_end, next_page, n_pages, text: texts of [cut, next cut), blank ones left out; arrays tables and images too, in page order, where pages has them; columns ``along`` of cut as they are.

    The range join is an equi-join on (source, number), as a cut names the few pages it spans.
    """
    extra = [c for c in ("tables", "images") if c in pages.columns]
    spans = cut.withColumn("number", F.explode_outer(F.when(F.col("next_page") > F.col("page"), F.sequence("page", F.col("next_page") - 1))))
    both = spans.join(pages.select("source", "number", strip(F.col("text")).alias("text"), *extra), ["source", "number"], "left")
    texts = F.transform(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("number", "text")))), lambda x: x["text"])
    each = [F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("number", F.col(c).alias("x")))), lambda x: F.coalesce(x["x"], F.array().cast(dict(pages.dtypes)[c])))).alias(c) for c in extra]
    out = both.groupBy("source", "i", "title", "level", "ord", "page", "next_page", *along).agg(F.count(F.when(F.col("text") != "", 1)).alias("n_pages"), F.array_join(texts, "\n\n").alias("text"), *each)
    return out.select("source", "i", "title", "level", "ord", F.col("page").alias("page_start"), F.greatest(F.col("next_page") - 1, "page").alias("page_end"), "next_page", "n_pages", "text", *extra, *along)


def parents(cut: DataFrame, deepest: int = 6) -> DataFrame:
    """cut with parent: number of the nearest page before it of a smaller level."""
    w = Window.partitionBy("source").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    best = F.lit(None).cast("int")
    for level in range(2, deepest + 1):
        best = F.when(F.col("level") == level, F.last(F.when(F.col("level") < level, F.col("i")), ignorenulls=True).over(w)).otherwise(best)
    return cut.withColumn("parent", best)


def subsections(cut: DataFrame, outline: DataFrame) -> DataFrame:
    """source, i, sub_ord, sub_title, sub_level: outline entries within a page's span, but for its own."""
    spans = cut.filter("next_page > page").select("source", "i", F.col("ord").alias("own"), F.explode(F.sequence("page", F.col("next_page") - 1)).alias("page"))
    return outline.join(spans, ["source", "page"]).filter("ord <> own").select("source", "i", F.col("ord").alias("sub_ord"), F.col("title").alias("sub_title"), F.col("level").alias("sub_level"))


def slugged(pages: DataFrame) -> DataFrame:
    return pages.withColumn("slug", F.concat(F.format_string("%03d", F.col("i")), F.lit("-"), slug(F.col("title"))))


def neighbours(pages: DataFrame) -> DataFrame:
    w = Window.partitionBy("source").orderBy("i")
    return pages.withColumn("prev", F.lag("i").over(w)).withColumn("next", F.lead("i").over(w))


def merge_offsets(sizes: DataFrame) -> DataFrame:
    """source, n_pages, offset: pages of the sources before, in order of source."""
    return running_total(sizes, "n_pages", ["source"], "offset").withColumn("offset", F.col("offset").cast("long"))


def merge(pages: DataFrame, outline: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages and outline of all sources as one document, ``number`` and ``page`` running on; each source is a level-1 entry above its own. A single source is left as it is."""
    offsets = merge_offsets(pages.groupBy("source").agg(F.count("*").alias("n_pages")))
    if len(offsets.take(2)) < 2:
        return pages, outline
    moved_pages = pages.join(offsets.select("source", "offset"), "source").withColumn("number", (F.col("number") + F.col("offset")).cast("int")).select(*pages.columns)
    moved = outline.join(offsets, "source").withColumn("level", F.col("level") + 1).withColumn("page", F.when(F.col("page") > 0, F.col("page") + F.col("offset")).otherwise(-1).cast("int"))
    roots = offsets.select("source", F.lit(-1).alias("ord"), F.lit(1).alias("level"), F.col("source").alias("title"), (F.col("offset") + 1).cast("int").alias("page"))
    return moved_pages, moved.select("source", "ord", "level", "title", "page").unionByName(roots)


def synthesize_outline(pages: DataFrame, header_lines: int = 4, least: int = 3) -> DataFrame:
    """source, ord, level, title, page from numbered running headers, by source; no rows where fewer than ``least`` sections show."""
    lines = pages.select("source", "number", F.posexplode(F.filter(F.transform(F.split("text", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), strip), lambda x: x != "")).alias("line", "raw")).filter(F.col("line") < header_lines)
    pattern = r"(?U)^(\d+(?:\.\d+)*)\s+(\p{L}.*)$"
    found = lines.select("source", "number", "line", F.regexp_extract("raw", pattern, 1).alias("no"), F.regexp_replace(F.regexp_extract("raw", pattern, 2), r"\s+\d{1,4}$", "").alias("title"))
    found = found.filter((F.col("no") != "") & (F.length("title") >= 3) & ~F.col("title").rlike(r"[.,:;]$"))
    one = found.groupBy("source", "no", F.lower("title").alias("k")).agg(F.min(F.struct("number", "line", "title")).alias("f")).withColumn("depth", F.size(F.split("no", r"\.")))
    depths = one.groupBy("source", "depth").count()
    pick = depths.groupBy("source").agg(F.coalesce(F.min(F.when(F.col("count") >= 2, F.col("depth"))), F.min("depth")).alias("depth"))
    kept = one.join(pick, ["source", "depth"])
    w = Window.partitionBy("source").orderBy("f.number", "f.line", "no")
    kept = kept.withColumn("ord", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("source")))
    return kept.filter(F.col("n") >= least).select("source", "ord", F.lit(1).alias("level"), F.concat_ws(" ", "no", "f.title").alias("title"), F.col("f.number").alias("page"))
