"""Edits of Markdown pages, as a batch: replace a unique passage, append a section, create a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def occurrences(text: Column, part: Column) -> Column:
    """How often part stands in text, without overlaps; 0 for an empty part."""
    return F.when(F.length(part) > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")).otherwise(0)


def with_section(text: Column, heading: Column, body: Column) -> Column:
    """text with a section at its end, before the last rule, below which the footer stands."""
    section = F.concat(F.lit("\n## "), heading, F.lit("\n\n"), body, F.lit("\n"))
    head, foot = (F.regexp_extract(text, r"(?s)^(.*)(\n---\n.*)$", g) for g in (1, 2))
    return F.when(foot != "", F.concat(head, F.lit("\n"), section, foot)).otherwise(F.concat(F.regexp_replace(text, r"\s+$", ""), F.lit("\n"), section))


def new_page(title: Column, body: Column) -> Column:
    """A page of body, under a title unless body brings its own."""
    b = strip(body)
    return F.when(b.startswith("# "), F.concat(b, F.lit("\n"))).otherwise(F.concat(F.lit("# "), title, F.lit("\n\n"), b, F.lit("\n")))


def apply_edits(pages: DataFrame, edits: DataFrame) -> DataFrame:
    """slug, status, text of each of edits(slug, kind, old, new), at most one a page, over pages(slug, text).

    kind edit: old becomes new; append: heading old, body new; create: title old, body new. Status ``ok``, or why nothing was written
    (``missing``, ``exists``, ``invalid slug``, ``not found``, ``not unique``, ``unknown kind``); text is what the page holds afterwards.
    """
    both = edits.select("slug", "kind", F.coalesce("old", F.lit("")).alias("old"), F.coalesce("new", F.lit("")).alias("new")).join(pages.select("slug", "text"), "slug", "left")
    kind, there, n = F.col("kind"), F.col("text").isNotNull(), occurrences(F.col("text"), F.col("old"))
    valid = F.coalesce(F.col("slug").rlike(r"^[A-Za-z0-9._-]+$"), F.lit(False))
    status = (
        F.when(~valid, "invalid slug").when(~F.coalesce(kind.isin("edit", "append", "create"), F.lit(False)), "unknown kind").when((kind == "create") & there, "exists")
        .when((kind != "create") & ~there, "missing").when((kind == "edit") & (n == 0), "not found").when((kind == "edit") & (n > 1), "not unique").otherwise("ok")
    )
    text = (
        F.when(F.col("status") != "ok", F.col("text")).when(kind == "edit", F.replace("text", F.col("old"), F.col("new")))
        .when(kind == "append", with_section(F.col("text"), F.col("old"), F.col("new"))).otherwise(new_page(F.col("old"), F.col("new")))
    )
    return both.withColumn("status", status).select("slug", "status", text.alias("text"))
