"""Resumable sample feed and its running progress."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.sampling import progress_ledger


def read_feed(spark: SparkSession, source: str, schema: StructType, max_files: int = 8, fmt: str = "parquet") -> DataFrame:
    """Files as a stream; corrupt files are skipped, the checkpoint remembers what was read."""
    return (
        spark.readStream.format(fmt)
        .schema(schema)
        .option("maxFilesPerTrigger", max_files)
        .option("ignoreCorruptFiles", "true")
        .load(source)
    )


def stream_feed(
    spark: SparkSession,
    source: str,
    schema: StructType,
    out: str,
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame] = lambda df: df,
    max_files: int = 8,
    fmt: str = "parquet",
) -> StreamingQuery:
    """Turn new source files into feed rows and stop; a restart goes on after the last batch."""
    rows = transform(read_feed(spark, source, schema, max_files, fmt))
    return (
        rows.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_progress(rows: DataFrame, keys: Sequence[str], place: Sequence[str]) -> DataFrame:
    """Furthest place per (data set, worker) as a streaming aggregate for update mode."""
    return progress_ledger(rows, keys, place)


def write_progress(ledger: DataFrame, out: str, checkpoint: str, keys: Sequence[str]) -> StreamingQuery:
    """Keep each batch's changed ledger rows; ``read_progress`` takes the furthest per key.

    Places only grow, so the union of all batches needs no ordering between them.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        ledger.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_progress(spark: SparkSession, out: str, keys: Sequence[str], place: Sequence[str]) -> DataFrame:
    return progress_ledger(spark.read.parquet(out), keys, place)
