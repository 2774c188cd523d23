"""The queries op1 to op13, each over its whole table."""

from __future__ import annotations

import os
import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    benchmark_matches,
    bpe_replay,
    fill_middle,
    jaccard_join,
    line_chunks,
    merkle_manifest,
    path_templates,
    preference_pairs,
    quality_rules,
    repeated_spans,
    string_kernel,
    text_density,
    topk_search,
)
from .core import LLM_ORACLES, LLM_QUERIES, registered, table

__all__ = ["LLM_ORACLES", "LLM_QUERIES"]

TOXIC_FROM = 0.7


def vocabulary(path: str | None = None) -> tuple[dict[bytes, int], str]:
    """Ranks and split pattern of the public multilingual vocabulary; ``path`` names another rank file."""
    import public_tokenizers

    with open(path or os.environ.get("PACKLOOM_RANKS") or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        return bpe_replay.parse_ranks(lines), public_tokenizers.PATTERN


@registered("op10_bpe_replay")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    ranks, pattern = vocabulary()
    return bpe_replay.round_trip(table(spark, folder, "documents"), ranks, pattern, bpe_replay.SEGMENTS)


@registered("op3_quality_rules", quality_rules.ORACLE)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, folder, "documents"))


@registered("op5_benchmark_matches")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return benchmark_matches.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@registered("op7_line_chunks")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the digest of what is left of it."""
    done = line_chunks.dedup_lines(table(spark, folder, "documents"))
    return done.select("doc_id", line_chunks.REMOVED, F.length("text").cast("bigint").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


@registered("op8_jaccard_join")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.near_copies(table(spark, folder, "documents"))


@registered("op6_repeated_spans")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    done = repeated_spans.remove_repeats(table(spark, folder, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def toxicity_model(spark: SparkSession, docs: DataFrame, folder: str) -> string_kernel.Model:
    """Trained on the labelled documents outside the held-out third."""
    seen = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    return string_kernel.fit(seen, table(spark, folder, "labels"))


@registered("op2_string_kernel")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    done = string_kernel.score(docs.select("doc_id", "text"), toxicity_model(spark, docs, folder))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return done.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


@registered("op1_text_density")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return text_density.extract(table(spark, folder, "pages"))


@registered("op4_path_templates", path_templates.ORACLE)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Labels are joined by id: a page is good if its label says quality 1 and not toxic."""
    good = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("page_id"), F.coalesce(good, F.lit(0)).alias("good"))
    return path_templates.judged(table(spark, folder, "pages"), labels)


@registered("op9_preference_pairs", preference_pairs.ORACLE)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return preference_pairs.formatted(preference_pairs.neighbour_pairs(table(spark, folder, "conversations")))


@registered("op11_merkle_manifest", merkle_manifest.ORACLE)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """A proof for every document, tried on its text with A-Z lower-cased where crc32 of its id is divisible by 3.

    A NULL id is a leaf like any other, before all ids, and is not tampered with.
    """
    docs = table(spark, folder, "documents")
    cells = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.when(touched, merkle_manifest.leaf_hash(*cells, lowered))
    done = merkle_manifest.manifest(docs, F.col("lang"), F.col("doc_id"), merkle_manifest.leaf_hash(*cells, F.col("text")), tampered)
    return done.select(
        F.col("row").alias("doc_id"), "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


@registered("op12_fill_middle", fill_middle.ORACLE)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a fill-in-the-middle sample and restored from it, as digests."""
    done = fill_middle.fill_in_middle(table(spark, folder, "documents").select("doc_id", "text"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")
    )


@registered("op13_topk_search", topk_search.ORACLE)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """The five best neighbours of every vector whose id is divisible by 50."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return topk_search.top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors)
