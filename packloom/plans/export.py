"""Source records to clean JSON Lines, Parquet shards and a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.clean import skip_reasons, skip_report
from ..session import fixed_splits
from ..sources.files import marked, shard_manifest, unmarked, write_manifest, write_shards
from ..sources.records import EXPORT_COLUMNS, read_records, with_input_position, write_json

KEY, BAD = "_key", "_bad_row"


def judged_records(records: DataFrame, manifest: DataFrame | None, base: str, parsed_ok: str | None = None) -> DataFrame:
    """Records in export form with the ``reason`` each skipped one is skipped for.

    ``parsed_ok`` names a flag column: rows where it is false count as parse failures.
    """
    full = records.withColumns(
        {
            "before_image_path": tx.join_path(base, F.col("original_image_path")),
            "after_image_path": tx.join_path(base, F.col("edited_image_path")),
        }
    )
    judged = skip_reasons(
        full, manifest, ["instruction", "reasoning"], "before_image_path", "after_image_path", parsed_ok
    )
    return judged.withColumns(
        {
            "instruction": tx.strip(F.col("instruction")),
            "reasoning": tx.strip(F.col("reasoning")),
            "rules": tx.strip(F.coalesce("rules", F.lit(""))),
        }
    )


def export_rows(records: DataFrame, manifest: DataFrame | None, base: str) -> DataFrame:
    """The five export columns of the records that pass; other columns ride along unchanged."""
    kept = judged_records(records, manifest, base).filter(F.col("reason").isNull())
    extra = [c for c in records.columns if c not in (*EXPORT_COLUMNS, "original_image_path", "edited_image_path")]
    return kept.select(*EXPORT_COLUMNS, *extra)


def export(
    spark: SparkSession,
    source: str,
    base: str,
    out: str,
    manifest: DataFrame | None = None,
    n_chunks: int = 8,
    seed: int = 42,
) -> DataFrame:
    """Run the export below ``out`` and return the skip counts.

    Texts move twice, into the JSON order and into their shards, and no more: the file joins
    carry paths and positions only, and their verdicts are written once. The positions of
    rows whose images are missing travel with the texts into the same tasks, which drop those rows.
    """
    with fixed_splits(spark):
        read = with_input_position(read_records(spark, source, bad_rows=BAD)).withColumn("_parsed", F.col(BAD).isNull())
        staged = f"{out}/staged"
        judged_records(read, manifest, base, "_parsed").select("input_pos", "reason").write.parquet(staged)
        verdicts = spark.read.parquet(staged)
        # Equal records differ by their input position, so every row has its own shuffle key.
        missing = verdicts.filter(F.col("reason") == "missing_images").select("input_pos", F.to_json("input_pos").alias(KEY))
        whole = judged_records(read, None, base, "_parsed").filter(F.col("reason").isNull()).select(*EXPORT_COLUMNS, "input_pos")
        write_json(unmarked(marked(whole, missing, "input_pos").repartitionByRange("input_pos"), "input_pos"), f"{out}/json")
        keyed = whole.withColumn(KEY, F.to_json("input_pos")).drop("input_pos")
        write_shards(keyed, f"{out}/shards", n_chunks, KEY, seed, skipped=missing)
    write_manifest(shard_manifest(spark, f"{out}/shards"), f"{out}/manifest")
    return skip_report(verdicts)
