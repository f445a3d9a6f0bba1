"""Retrieval for many questions at once: seeds by cosine, expansion over the graph, equal budgets, answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.tables import new_path, stream_rows, written
from ..functions.text import strip_think
from .graph import neighborhood
from .vector import matrix, top_k

#: Relations that lead from a seed to pages worth adding.
EXPANDS = ("references", "referenced_by", "similar", "shared_entity")
#: What is answered where nothing was found.
NOTHING = "Nothing in the index matches this question."
RULES = "Answer from the numbered excerpts alone, name each excerpt that you use by its number in square brackets, and say so if they do not hold the answer."


def seeds(questions: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """qid, id, page, score, marker: the k best chunks of each question."""
    return top_k(questions, chunks, k)


def related_pages(found: DataFrame, near: DataFrame) -> DataFrame:
    """qid, page: pages that lead from the found pages along EXPANDS, without the found ones. near(src, node, rel): every page's neighbourhood."""
    pages = found.select("qid", "page").distinct()
    leads = near.filter(F.col("rel").isin(*EXPANDS)).select(F.col("src").alias("page"), F.col("node").alias("to"))
    return pages.join(leads, "page").select("qid", F.col("to").alias("page")).distinct().join(pages, ["qid", "page"], "left_anti")


def best_of(questions: DataFrame, candidates: DataFrame, chunks: DataFrame, question_block: int = 512) -> DataFrame:
    """qid, page, id, score: the best chunk of each candidate page. Only chunks of candidates are scored.

    Questions are written once to the shared folder, with their pages, and streamed past the chunks where these are read; a batch of chunks gives a row for a question and page, so neither a page of many chunks nor one of many questions is a task of its own.
    """
    folder = new_path(chunks.sparkSession, "candidates")
    wide = lambda c: F.transform(c, lambda x: x.cast("double"))
    candidates.groupBy("qid").agg(F.collect_set("page").alias("pages")).join(questions.filter("emb IS NOT NULL").select("qid", wide("emb").alias("emb")), "qid").write.parquet(folder)
    pages = chunks.sparkSession.read.schema(f"pages array<{dict(chunks.dtypes)['page']}>").parquet(folder).select(F.explode("pages").alias("page")).distinct()
    kinds = {"qid": questions.schema["qid"].dataType, "page": chunks.schema["page"].dataType, "id": chunks.schema["id"].dataType}
    types = {n: to_arrow_type(t) for n, t in kinds.items()}

    def run(batches):
        for have in batches:
            if not have.num_rows:
                continue
            have = have.sort_by([("page", "ascending"), ("id", "ascending")])
            known = have.column("page").dictionary_encode()
            code = known.indices.to_numpy()
            start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            ends, m, ids = np.r_[start[1:], len(code)], matrix(have.column("emb")), have.column("id")
            for ask in stream_rows(folder, question_block):
                lists = ask.column("pages")
                at = pc.index_in(lists.flatten().cast(types["page"]), value_set=known.dictionary).fill_null(-1).to_numpy()
                who = np.repeat(np.arange(len(ask)), lists.value_lengths().to_numpy())[at >= 0]
                at = at[at >= 0]
                order = np.argsort(at, kind="stable")
                who, at = who[order], at[order]
                q, col, score = matrix(ask.column("emb")), np.zeros(len(at), np.int64), np.zeros(len(at))
                first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else at
                for s, e in zip(first, np.r_[first[1:], len(at)], strict=True):
                    sims = np.round(q[who[s:e]] @ m[start[at[s]] : ends[at[s]]].T, 12)
                    best = sims.argmax(1)  # the first of equal ones: the smallest id
                    col[s:e], score[s:e] = start[at[s]] + best, sims[np.arange(e - s), best]
                yield pa.record_batch([ask.column("qid").take(pa.array(who)).cast(types["qid"]), known.dictionary.take(pa.array(at)).cast(types["page"]), ids.take(pa.array(col)).cast(types["id"]), pa.array(score)], ["qid", "page", "id", "score"])

    rows = chunks.filter("emb IS NOT NULL").select("page", "id", "emb").join(pages, "page", "left_semi")
    scored = rows.mapInArrow(run, ", ".join(f"{n} {t.simpleString()}" for n, t in kinds.items()) + ", score double")
    best = scored.groupBy("qid", "page").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("id").alias("o"))).alias("b"))
    return best.select("qid", "page", F.col("b.o").alias("id"), (-F.col("b.s")).alias("score"))


def expand(questions: DataFrame, found: DataFrame, chunks: DataFrame, near: DataFrame, k: int = 3) -> DataFrame:
    """qid, id, page, score, marker of the best chunk of the k best pages related to the found pages; markers run on."""
    best = best_of(questions, related_pages(found, near), chunks)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    last = found.groupBy("qid").agg(F.max("marker").alias("last"))
    return best.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).join(last, "qid").select("qid", "id", "page", "score", (F.col("last") + F.col("r")).alias("marker"))


def graph_rag(questions: DataFrame, chunks: DataFrame, edges: DataFrame, mentions: DataFrame, top_k: int = 5, expand_k: int = 3) -> DataFrame:
    """qid, id, page, score, marker, kind: seeds, then related pages' chunks."""
    found = written(seeds(questions, chunks, top_k), "seeds")  # read by all that follows
    out = found.select("qid", "id", "page", "score", "marker", F.lit("seed").alias("kind"))
    if expand_k <= 0:
        return out
    near = neighborhood(edges, mentions, found.select("page").distinct())
    return out.unionByName(expand(questions, found, chunks, near, expand_k).withColumn("kind", F.lit("related")))


def semantic_pages(questions: DataFrame, chunks: DataFrame, n: int = 8) -> DataFrame:
    """qid, page, rank: distinct pages of the best max(6n, 30) chunks, at most n."""
    top = seeds(questions, chunks, max(6 * n, 30)).groupBy("qid", "page").agg(F.min("marker").alias("m"))
    w = Window.partitionBy("qid").orderBy("m")
    return top.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("qid", "page", "rank")


def graph_pages(questions: DataFrame, chunks: DataFrame, near: DataFrame, top_k: int = 5, expand_k: int = 3) -> DataFrame:
    """qid, page, rank: the top_k semantic pages, then the expand_k best pages related to them."""
    first = semantic_pages(questions, chunks, top_k)
    more = expand(questions, first.withColumnRenamed("rank", "marker"), chunks, near, expand_k)
    return first.unionByName(more.select("qid", "page", F.col("marker").alias("rank")))


def retrievers(chunks: DataFrame, near: DataFrame | None, top_k: int = 5, expand_k: int = 3) -> tuple[Callable, Callable | None]:
    """Two functions of questions(qid, emb) to pages(qid, page, rank), with the same budget: by meaning alone, and by meaning and graph (None without a graph or room for it)."""
    plain = lambda q: semantic_pages(q, chunks, top_k + expand_k)
    if near is None or expand_k <= 0:
        return plain, None
    return plain, lambda q: graph_pages(q, chunks, near, top_k, expand_k)


def clamped(top_k: int | None, expand_k: int | None, longest: int = 20) -> tuple[int, int]:
    """Budgets as a service takes them: 1 to ``longest`` seeds, 0 to 10 related pages."""
    return min(longest, max(1, int(5 if top_k is None else top_k))), min(10, max(0, int(3 if expand_k is None else expand_k)))


def prompts(questions: DataFrame, retrieved: DataFrame) -> DataFrame:
    """qid, question, prompt (null where nothing was retrieved) of questions(qid, question) and retrieved(qid, marker, kind, title, page_start, page_end, text)."""
    tag = F.when(F.col("kind") == "related", ", related").otherwise("")
    one = F.concat(F.lit("["), F.col("marker").cast("string"), F.lit("] "), "title", F.lit(", pages "), F.col("page_start").cast("string"), F.lit("–"), F.col("page_end").cast("string"), tag, F.lit("\n"), "text")
    listed = retrieved.select("qid", F.struct("marker", one.alias("x")).alias("s")).groupBy("qid").agg(F.array_sort(F.collect_list("s")).alias("s"))
    excerpts = F.array_join(F.transform("s", lambda s: s["x"]), "\n\n")
    return questions.join(listed, "qid", "left").select("qid", "question", F.when(F.size("s") > 0, F.concat(excerpts, F.lit("\n\nQuestion: "), "question")).alias("prompt"))


def ask(prompted: DataFrame, chat, system: str = RULES) -> DataFrame:
    """qid, question, prompt, reply: chat's reply to each prompt, none where there is no prompt. Write the result before using it twice, or models are asked twice."""

    def reply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            said = [None if p is None or pd.isna(p) else chat.chat([{"role": "system", "content": system}, {"role": "user", "content": p}]) for p in f["prompt"]]
            yield f.assign(reply=said)

    kinds = ", ".join(f"{c} {t}" for c, t in prompted.dtypes)
    return prompted.mapInPandas(reply, f"{kinds}, reply string")


def answers(questions: DataFrame, retrieved: DataFrame, chat) -> DataFrame:
    """qid, question, answer: without the model's thoughts; a fixed text, and no call, where nothing was retrieved."""
    return ask(prompts(questions, retrieved), chat).select("qid", "question", F.coalesce(strip_think(F.col("reply")), F.lit(NOTHING)).alias("answer"))
