"""Page trees as Markdown: pages, index lines, manifests.

Pages are rows (source, i, slug, title, level, page_start, page_end, parent, text), where ``i`` is the reading order, which is the tree's pre-order too.
Every page is rendered where it lies; only links to other pages take joins, of titles and slugs, by (source, i).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import markdown_table, strip
from .graph import ancestry

#: What rendered pages say.
HOME, TRAIL, NAV = "[🏠 Home](../index.md)", " › ", " · "


def link(title: Column, slug: Column, folder: str = "") -> Column:
    return F.concat(F.lit("["), title, F.lit(f"]({folder}"), slug, F.lit(".md)"))


def ancestors(pages: DataFrame) -> DataFrame:
    """pages with trail: (i, title, slug) of the pages above, root first: the tree's closure by a recursive query, then one join for their names."""
    place = lambda i: F.struct(F.col("source").alias("source"), F.col(i).alias("i"))
    up = ancestry(pages.filter("parent is not null").select(place("i").alias("node"), place("parent").alias("parent")))
    above = pages.select(place("i").alias("ancestor"), "title", "slug")
    named = up.join(above, "ancestor").select("node", F.struct((-F.col("depth")).alias("up"), F.col("ancestor.i").alias("i"), "title", "slug").alias("a"))
    trails = named.groupBy("node").agg(F.array_sort(F.collect_list("a")).alias("_trail"))  # a page has few above it
    trail = F.transform("_trail", lambda x: F.struct(x["i"].alias("i"), x["title"].alias("title"), x["slug"].alias("slug")))
    out = pages.join(trails.select("node.source", "node.i", trail.alias("trail")), ["source", "i"], "left")
    return out.select(*pages.columns, F.coalesce("trail", F.array().cast(f"array<struct<i:{dict(pages.dtypes)['i']},title:string,slug:string>>")).alias("trail"))


def _some(when: Column, *parts) -> Column:
    """The lines of all parts (columns of arrays, or texts) if the condition holds, else none."""
    arrays = [F.array(F.lit(p)) if isinstance(p, str) else p for p in parts]
    return F.when(when, F.concat(*arrays)).otherwise(F.array().cast("array<string>"))


def page_markdown(pages: DataFrame, subs: DataFrame) -> DataFrame:
    """source, i, slug, markdown of each page; subs(source, i, sub_ord, sub_title, sub_level). Columns tables and images are rendered where there are such."""
    w = Window.partitionBy("source").orderBy("i")
    near = F.struct("title", "slug")
    heavy = [c for c in ("text", "tables", "images") if c in pages.columns]  # these meet the rest in the last join alone
    slim = pages.drop(*heavy)
    out = ancestors(slim).withColumn("_before", F.lag(near).over(w)).withColumn("_after", F.lead(near).over(w))
    below = slim.filter("parent is not null").select("source", F.col("parent").alias("_of"), F.struct("i", "title", "slug").alias("_c")).groupBy("source", "_of").agg(F.array_sort(F.collect_list("_c")).alias("_children"))
    listed = subs.select("source", "i", F.struct("sub_ord", "sub_title", "sub_level").alias("_s")).groupBy("source", "i").agg(F.array_sort(F.collect_list("_s")).alias("_subs"))
    out = out.join(below.withColumnRenamed("_of", "i"), ["source", "i"], "left").join(listed, ["source", "i"], "left").join(pages.select("source", "i", *heavy), ["source", "i"])
    trail = F.array_join(F.concat(F.array(F.lit(HOME)), F.transform("trail", lambda x: link(x["title"], x["slug"])), F.array("title")), TRAIL)
    sub = lambda s: F.concat(F.repeat(F.lit("  "), F.greatest(F.lit(0), s["sub_level"] - F.col("level") - 1)), F.lit("- "), s["sub_title"])
    before = F.when(F.col("_before").isNotNull(), F.concat(F.lit("← "), link(F.col("_before.title"), F.col("_before.slug"))))
    above = F.when(F.size("trail") > 0, F.concat(F.lit("↑ "), link(F.try_element_at("trail", F.lit(-1))["title"], F.try_element_at("trail", F.lit(-1))["slug"])))
    after = F.when(F.col("_after").isNotNull(), F.concat(link(F.col("_after.title"), F.col("_after.slug")), F.lit(" →")))
    nav = F.array_join(F.array_compact(F.array(before, above, after)), NAV)
    text = strip(F.coalesce("text", F.lit("")))
    parts = [
        F.array(F.concat(F.lit("# "), "title"), F.lit(""), trail, F.lit(""), F.concat(F.lit("*PDF pages "), F.col("page_start").cast("string"), F.lit("–"), F.col("page_end").cast("string"), F.lit("*")), F.lit("")),
        _some(F.col("_children").isNotNull(), "**Subpages**", "", F.transform("_children", lambda c: F.concat(F.lit("- "), link(c["title"], c["slug"]))), ""),
        _some(F.col("_subs").isNotNull(), "**Contents**", "", F.transform("_subs", sub), ""),
        F.array(F.lit("---"), F.lit("")),
        _some(text != "", F.array(text), ""),
    ]
    if "tables" in pages.columns:
        head = lambda t, j: F.concat(F.lit("\n**Table "), (j + 1).cast("string"), F.lit("** *(PDF p. "), t["page_number"].cast("string"), F.lit(")*\n\n"), markdown_table(t["rows"]), F.lit("\n"))
        parts.append(_some(F.size("tables") > 0, F.transform("tables", head)))
    if "images" in pages.columns:
        image = lambda m: F.concat(F.lit("\n![p"), m["page_number"].cast("string"), F.lit(" #"), m["xref"].cast("string"), F.lit("](../../images/"), F.element_at(F.split(m["path"], r"[/\\]"), -1), F.lit(")"))
        parts.append(_some(F.size("images") > 0, F.transform("images", image)))
    parts.append(F.array(F.lit(""), F.lit("---"), F.lit(""), F.when(nav == "", F.lit(HOME)).otherwise(nav), F.lit("")))
    return out.select("source", "i", "slug", F.array_join(F.concat(*parts), "\n").alias("markdown"))


def index_lines(pages: DataFrame) -> DataFrame:
    """source, i, line: the nested table of contents, one row a page, so that no index has to fit into a row."""
    return ancestors(pages).select("source", "i", F.concat(F.repeat(F.lit("  "), F.size("trail")), F.lit("- "), link(F.col("title"), F.col("slug"), "pages/")).alias("line"))


def manifest(pages: DataFrame, subs: DataFrame) -> DataFrame:
    """source, i, entry: the page's JSON entry in its wiki's manifest."""
    below = pages.filter("parent is not null").select("source", F.col("parent").alias("_of"), F.struct("i", "slug").alias("_c")).groupBy("source", "_of").agg(F.array_sort(F.collect_list("_c")).alias("_children"))
    listed = subs.select("source", "i", F.struct("sub_ord", F.col("sub_title").alias("title"), F.col("sub_level").alias("level")).alias("_s")).groupBy("source", "i").agg(F.array_sort(F.collect_list("_s")).alias("_subs"))
    above = pages.select("source", F.col("i").alias("parent"), F.col("slug").alias("_parent"))
    out = pages.join(above, ["source", "parent"], "left").join(below.withColumnRenamed("_of", "i"), ["source", "i"], "left").join(listed, ["source", "i"], "left")
    count = lambda c: F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0)) if c in pages.columns else F.lit(0)
    none = F.array().cast("array<string>")
    entry = F.struct(
        "slug", "title", "level", F.concat(F.lit("pages/"), "slug", F.lit(".md")).alias("file"), F.col("page_start").alias("pdf_page_start"), F.col("page_end").alias("pdf_page_end"), F.col("_parent").alias("parent"),
        F.coalesce(F.transform("_children", lambda c: c["slug"]), none).alias("children"), count("tables").alias("n_tables"), count("images").alias("n_images"),
        F.coalesce(F.transform("_subs", lambda s: F.struct(s["title"].alias("title"), s["level"].alias("level"))), F.array().cast("array<struct<title:string,level:int>>")).alias("subsections"),
    )
    return out.select("source", "i", F.to_json(entry, {"ignoreNullFields": "false"}).alias("entry"))


def summary(pages: DataFrame, most: int = 12) -> DataFrame:
    """source, summary: the source and the titles of its first root pages. Roots are ranked before any are gathered, so a group holds at most ``most``."""
    w = Window.partitionBy("source")
    top = pages.filter("parent is null").select("source", "i", "title").withColumn("_k", F.row_number().over(w.orderBy("i"))).withColumn("_n", F.count("*").over(w)).filter(F.col("_k") <= most)
    titles = F.transform(F.array_sort(F.collect_list(F.struct("i", "title"))), lambda x: x["title"])
    more = F.when(F.max("_n") > most, "; …").otherwise("")
    return top.groupBy("source").agg(F.array_join(titles, "; ").alias("t"), more.alias("m")).select("source", F.concat("source", F.lit(": "), "t", "m").alias("summary"))


#: What the bullets of a document's metadata are called, by column.
LABELS = {"source_path": "Source", "page_count": "Pages", "author": "Author", "producer": "Producer"}


def document_markdown(meta: DataFrame, outline: DataFrame, pages: DataFrame) -> DataFrame:
    """source, ord, markdown: a document's head (ord 0) and pages. Joined by line ends in this order they are the document; none has to fit into a row.

    meta(source, title, and those of LABELS that there are), outline(source, ord, level, title, page), pages(source, number, text[, tables][, images]).
    Bullets without a value, and a list of contents without entries, are left out; null text is empty.
    """
    value = lambda c: F.nullif(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("0"))
    bullets = [F.concat(F.lit(f"- **{label}:** "), value(c)) for c, label in LABELS.items() if c in meta.columns]
    entry = F.concat(F.repeat(F.lit("  "), F.greatest(F.lit(0), F.col("level") - 1)), F.lit("- "), "title", F.lit(" (p. "), F.col("page").cast("string"), F.lit(")"))
    toc = outline.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("ord", entry.alias("line")))).alias("_toc"))
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("Untitled Document"))
    none = F.array().cast("array<string>")
    head = [F.array(F.concat(F.lit("# "), title, F.lit("\n")), F.lit("## Document metadata\n")), F.array_compact(F.array(*bullets)) if bullets else none, F.array(F.lit(""))]
    head.append(_some(F.col("_toc").isNotNull(), "## Table of contents\n", F.transform("_toc", lambda x: x["line"]), ""))
    first = meta.join(toc, "source", "left").select("source", F.lit(0).alias("ord"), F.array_join(F.concat(*head), "\n").alias("markdown"))
    number, text = F.col("number").cast("string"), strip(F.coalesce("text", F.lit("")))
    body = [F.array(F.concat(F.lit("\n---\n\n## Page "), number, F.lit("\n"))), _some(text != "", F.array(text), "")]
    if "tables" in pages.columns:
        table = lambda t, k: F.array(F.concat(F.lit("\n**Table "), number, F.lit("."), (k + 1).cast("string"), F.lit("**\n")), markdown_table(t["rows"]), F.lit(""))
        body.append(F.coalesce(F.flatten(F.transform("tables", table)), none))
    if "images" in pages.columns:
        image = lambda m: F.concat(F.lit("\n![image p"), m["page_number"].cast("string"), F.lit(" #"), m["xref"].cast("string"), F.lit("]("), m["path"], F.lit(")"))
        body.append(F.coalesce(F.transform("images", image), none))
    return first.unionByName(pages.select("source", F.col("number").alias("ord"), F.array_join(F.concat(*body), "\n").alias("markdown")))
