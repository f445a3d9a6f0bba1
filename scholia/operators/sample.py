"""Spread samples of a corpus, for prompts that propose its entity types."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prefix import numbered
from ..functions.text import strip


def sample_corpus(texts: DataFrame, n: int = 40, budget: int = 6000, least: int = 120) -> DataFrame:
    """source, sample from texts(source, ord, text): about n texts of each source, evenly spread, cut to budget characters in all.

    Places are told from keys alone, in ranges; only the chosen texts are joined back. A source without text has no row.
    """
    usable = texts.filter(strip(F.col("text")) != "")
    w = Window.partitionBy("source")  # of chosen rows alone: n a source at most
    keys = numbered(usable.select("source", "ord"), ["source"], ["ord"], "_r").withColumn("_k", F.col("_r") - 1)
    sizes = keys.groupBy(F.col("source").alias("_source")).agg(F.max("_r").alias("_n"))
    ranked = keys.join(sizes, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "_r")
    step = F.greatest(F.lit(1), F.expr(f"_n div {n}"))
    chosen = ranked.filter((F.col("_k") % step == 0) & (F.col("_k") < step * n)).withColumn("_of", F.count("*").over(w))
    cut = chosen.join(usable, ["source", "ord"]).withColumn("t", F.left(strip(F.col("text")), F.greatest(F.lit(least), F.expr(f"{budget} div _of")).cast("int")))
    listed = F.array_sort(F.collect_list(F.struct("ord", "t")))
    return cut.groupBy("source").agg(F.left(F.array_join(F.transform(listed, lambda x: x["t"]), "\n---\n"), F.lit(budget)).alias("sample"))


def distinct_types(proposals: DataFrame, n: int = 7) -> DataFrame:
    """ord, name, description: the first of each name (whatever its case) of proposals(ord, name, description), the first n in all."""
    named = proposals.withColumn("name", strip(F.col("name"))).filter("name <> ''").withColumn("description", strip(F.coalesce("description", F.lit(""))))
    one = named.groupBy(F.lower("name").alias("_key")).agg(F.min_by(F.struct("ord", "name", "description"), "ord").alias("p"))
    return one.select("p.*").orderBy("ord").limit(n)
