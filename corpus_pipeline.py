"""Documents in, training sequences out: language, near copies, repeated passages, benchmark leaks, packing.

Every stage takes all that its predecessor kept. All but the last return the columns of documents, whatever else these are called. Null and empty texts, texts without
a letter among them, end with the first stage; repeated rows are decided alike; a null doc_id is kept as it is. An empty table gives an empty result. Very long texts go through whole.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from scholia.llm import common, decontam, langid, neardup, packing, repeats


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts too); lang becomes the predicted language, also where it was null."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each class: five-word shingles, Jaccard similarity of 0.8 or more. Rows of a null doc_id, and all rows of a doc_id that is kept, stay."""
    return neardup.dedup(docs, k=5, percent=80, bands=24)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts byte strings that stand earlier in the corpus; a text may become empty, its row stays. Rows of a null doc_id come back whole; of rows of one doc_id none is earlier."""
    return repeats.dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or all words of a shorter one; those without words stay, whatever the benchmark holds."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), remove="documents")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places all pieces in sequences of 2048 tokens; a text that is empty by now has one piece, the end token. Other columns are left out."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language), ("minhash_near_dedup", near_duplicates), ("suffix_array_dedup", repeated_passages), ("benchmark_decontamination", decontamination), ("best_fit_packing", pack)]

#: Stages 1, 3 and 5 have no SQL form; tests/llm/test_pipeline.py holds the rows of a run against a brute-force version of all five stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = os.path.join(common.shared_dir(spark), "scholia", f"pipeline-{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = os.path.join(top, f"{k}-{name}")
            docs.write.option("compression", "zstd").parquet(path)
            if k:
                common.discard(before)
            docs = before = spark.read.parquet(path)
    return docs
