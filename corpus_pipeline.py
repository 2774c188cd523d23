"""Corpus pipeline over ``documents``: toxicity, line dedup, near copies, decontamination, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each one to
the shared folder and reads it back, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.llm import benchmark_matches, bpe_replay, jaccard_join, line_chunks, string_kernel
from packloom.llm.core import session, table
from packloom.llm.queries import TOXIC_FROM, toxicity_model, vocabulary
from packloom.llm.words import WORD
from packloom.session import staged


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the toxicity limit; NULL texts score as empty ones and stay."""
    session(spark)
    scored = string_kernel.score(docs, toxicity_model(spark, docs, sf_dir), out="__score")
    return scored.where(F.col("__score") < TOXIC_FROM).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated multi-line chunks; one that is left without a word goes."""
    session(spark)
    done = line_chunks.dedup_lines(docs)
    done = done.where((F.col(line_chunks.REMOVED) == 0) | F.col("text").rlike(WORD))
    n_chars = F.when(F.col(line_chunks.REMOVED) > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", n_chars).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies."""
    session(spark)
    return jaccard_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its error budget."""
    return benchmark_matches.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    session(spark)
    ranks, pattern = vocabulary()
    done = bpe_replay.encode(docs.select("doc_id", "text"), ranks, pattern, bpe_replay.SEGMENTS)
    return done.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("token_ids", token_ids),
]

# Learned scores and string distances have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
