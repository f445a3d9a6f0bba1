"""Ranking metrics over many questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reciprocal_rank(ranked: Column, expected: Column) -> Column:
    """1 over the first place that holds an expected item, over the whole list; 0 where none does."""
    places = F.filter(F.transform(ranked, lambda x, i: F.when(F.array_contains(expected, x), i + 1)), lambda i: i.isNotNull())
    return F.coalesce(1.0 / F.array_min(places), F.lit(0.0))


def hit_at_k(ranked: Column, expected: Column, k: int) -> Column:
    return F.coalesce(F.arrays_overlap(F.slice(ranked, 1, k), expected).cast("double"), F.lit(0.0))


def recall_at_k(ranked: Column, expected: Column, k: int) -> Column:
    n = F.size(F.array_distinct(expected))
    return F.when(n > 0, F.size(F.array_intersect(F.slice(ranked, 1, k), expected)) / n).otherwise(0.0)


def report(results: DataFrame, k: int = 8) -> DataFrame:
    """One row of results(ranked, expected): n, mrr, hit_rate, recall, misses."""
    r = results.select(reciprocal_rank(F.col("ranked"), F.col("expected")).alias("rr"), hit_at_k(F.col("ranked"), F.col("expected"), k).alias("hit"), recall_at_k(F.col("ranked"), F.col("expected"), k).alias("rec"))
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return r.agg(F.count("*").alias("n"), mean("rr").alias("mrr"), mean("hit").alias("hit_rate"), mean("rec").alias("recall"), F.coalesce(F.sum((F.col("hit") == 0).cast("long")), F.lit(0)).alias("misses"))


def report_rows(items: DataFrame, expected: DataFrame, found: DataFrame, k: int = 8) -> DataFrame:
    """As ``report``, where neither ranked nor expected pages of an item need fit into a list: items(qid), expected(qid, page), found(qid, page, rank from 1)."""
    wanted = expected.select("qid", "page").distinct()
    first = found.groupBy("qid", "page").agg(F.min("rank").alias("rank"))
    met = wanted.join(first, ["qid", "page"], "left").groupBy("qid").agg(F.min("rank").alias("best"), F.count_if(F.col("rank") <= k).alias("hits"), F.count(F.lit(1)).alias("n"))
    each = items.select("qid").distinct().join(met, "qid", "left").select(
        F.coalesce(1.0 / F.col("best"), F.lit(0.0)).alias("rr"), (F.coalesce("hits", F.lit(0)) > 0).cast("double").alias("hit"), F.coalesce(F.col("hits") / F.col("n"), F.lit(0.0)).alias("rec")
    )
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return each.agg(F.count(F.lit(1)).alias("n"), mean("rr").alias("mrr"), mean("hit").alias("hit_rate"), mean("rec").alias("recall"), F.coalesce(F.sum((F.col("hit") == 0).cast("long")), F.lit(0)).alias("misses"))


def grounding(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """qid, cite_hit, expected_recall of answers(qid, text, expected) whose [n] marks name sources(qid, marker, page)."""
    from ..functions.text import citations

    cited = answers.select("qid", "expected", F.explode_outer(citations(F.col("text"))).alias("marker")).join(sources, ["qid", "marker"], "left")
    g = cited.groupBy("qid", "expected").agg(F.collect_set("page").alias("pages"))
    n = F.size(F.array_distinct("expected"))
    both = F.size(F.array_intersect("pages", "expected"))
    return g.select("qid", (both > 0).alias("cite_hit"), F.when(n > 0, both / n).otherwise(0.0).alias("expected_recall"))


def judge_tally(replies: DataFrame) -> DataFrame:
    """questions, first, second, tie of replies(ord, reply). On odd questions the judge saw the second system's answer as A, so its verdict turns."""
    from ..functions.text import verdict

    said = replies.select("ord", verdict(F.col("reply")).alias("v"))
    won = F.when(F.col("v") == "tie", "tie").when((F.col("v") == "a") == (F.col("ord") % 2 == 0), "first").otherwise("second")
    return said.select(won.alias("w")).agg(F.count("*").alias("questions"), *[F.count_if(F.col("w") == c).alias(c) for c in ("first", "second", "tie")])


def ranked_lists(items: DataFrame, found: DataFrame) -> DataFrame:
    """items(qid, expected, ...) with ranked: the pages of found(qid, page, rank) in order; empty where none were found."""
    of = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "page"))).alias("s")).select("qid", F.transform("s", lambda s: s["page"]).alias("ranked"))
    kind = of.schema["ranked"].dataType.simpleString()
    return items.join(of, "qid", "left").withColumn("ranked", F.coalesce("ranked", F.array().cast(kind)))


def evaluate(items: DataFrame, retrieve, k: int = 8) -> tuple[DataFrame, DataFrame]:
    """Each of items(qid, emb, expected) with rr, hit and recall, and the report over all. retrieve: questions(qid, emb) to pages(qid, page, rank)."""
    rows = ranked_lists(items, retrieve(items.select("qid", "emb")))
    scored = rows.withColumn("rr", reciprocal_rank(F.col("ranked"), F.col("expected"))).withColumn("hit", hit_at_k(F.col("ranked"), F.col("expected"), k)).withColumn("recall", recall_at_k(F.col("ranked"), F.col("expected"), k))
    return scored, report(rows, k)


def judge_prompts(answers: DataFrame) -> DataFrame:
    """ord, prompt of answers(ord, question, first, second): on odd questions the second system's answer is shown as A."""
    even = F.col("ord") % 2 == 0
    text = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("(no answer)"))
    a, b = F.when(even, text("first")).otherwise(text("second")), F.when(even, text("second")).otherwise(text("first"))
    return answers.select("ord", F.concat(F.lit("Question: "), "question", F.lit("\n\nA:\n"), a, F.lit("\n\nB:\n"), b).alias("prompt"))


JUDGE = "Two answers to one question follow, A and B. Say which is more correct, more specific and more complete, whatever its length or form. Reply with one word: A, B or tie."


def answer_report(graded: DataFrame) -> DataFrame:
    """system, cite_hit, expected_recall: means of graded(system, cite_hit, expected_recall)."""
    return graded.groupBy("system").agg(F.avg(F.col("cite_hit").cast("double")).alias("cite_hit"), F.avg("expected_recall").alias("expected_recall"))
