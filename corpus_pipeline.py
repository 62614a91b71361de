"""A corpus pipeline of five stages, each a function of (spark, docs, sf_dir).

A stage works on all rows that its predecessor kept and, but for the last, returns the
columns of `documents`, extra ones included.  Rows of a null text are empty documents (the
toxicity model's bias, its score without evidence, decides on them); near-dedup keeps or
drops rows that repeat a doc_id together, the other stages judge each row by its text; an
empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywood.llm import decontaminate, neardup, packing, substrings, toxicity
from tallywood.llm.common import table, unused, without, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.3 or more go."""
    (score,) = unused(docs, "score")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_scores(docs, model, score).filter(F.col(score) < 0.3).drop(score)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the smallest doc_id stays."""
    found = neardup.near_duplicates(docs.select("doc_id", "text"), words=5, percent=80, bands=24, rows=4)
    gone = written(found.filter("not kept").select("doc_id").distinct(), "gone")
    return without(docs, gone, "doc_id")


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages of 35 words that also stand elsewhere are removed from the texts."""
    (cut,) = unused(docs, "cut")
    done = substrings.deduplicate(docs, keep_digest=False, into=cut)
    new = {"text": F.when(F.col(f"{cut}.n_removed") > 0, F.col(f"{cut}.kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(new["text"]).cast("long")
    return done.withColumns(new).select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window similar to a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
