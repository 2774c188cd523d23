"""File listings, Parquet folders, shards and their manifest."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.draws import digest
from ..operators.rank import even_chunks
from ..session import child_folders

COMPARED = 256  # chunks at most whose rows are told apart by comparison


def list_files(spark: SparkSession, dirs: Sequence[str], suffix: str = ".parquet") -> DataFrame:
    """Files of the folders (local, HDFS, any Hadoop path): ``path, length``.

    Only names and sizes are read, since the content column is pruned. The listing has
    no order; sort before relying on one.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(list(dirs))
    return found.select("path", "length")


def file_manifest(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Every file below a folder: ``path`` without the scheme of local files, ``length``."""
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
    )
    return found.select(F.regexp_replace("path", r"^file:/+", "/").alias("path"), "length")


def read_parquet_dirs(spark: SparkSession, dirs: Sequence[str], schema: StructType | str | None = None, skip_corrupt: bool = True) -> DataFrame:
    """Rows of all folders. A missing folder is an error, a corrupt file is skipped.

    With a schema no file is opened to find one, so the first may be corrupt as well.
    """
    reader = spark.read.option("ignoreCorruptFiles", str(skip_corrupt).lower())
    return (reader.schema(schema) if schema else reader).parquet(*dirs)


def read_counted(spark: SparkSession, dirs: Sequence[str], schema: StructType | str, path: str = "path") -> DataFrame:
    """``read_parquet_dirs`` with the file each row came from; see ``lost_files``."""
    return read_parquet_dirs(spark, dirs, schema).select("*", F.col("_metadata.file_path").alias(path))


def lost_files(spark: SparkSession, dirs: Sequence[str], rows: DataFrame, schema: StructType | str, path: str = "path") -> DataFrame:
    """Ledger of what a read that skips corrupt files left out: ``path, reason, length, n_lost``.

    ``rows`` are the rows that were read (``read_counted``), best from a written table, since
    they are counted by file. They are held against the listing and against the row counts
    of the files' footers, for which no data is read. ``no_rows``: no footer could be read,
    so it is not known how many rows are lost, or the footer says there are none.
    ``cut_off``: some rows could not be decoded.
    """
    name = lambda c: F.regexp_replace(c, "^file:/+", "file:/").alias("path")
    listed = list_files(spark, dirs).select(name("path"), "length")
    counted = spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(*dirs)
    footers = counted.groupBy(name("_metadata.file_path")).agg(F.count(F.lit(1)).alias("_rows"))
    seen = rows.groupBy(name(path)).agg(F.count(F.lit(1)).alias("_seen"))
    held = listed.join(footers, "path", "left").join(seen, "path", "left").withColumn("n_lost", F.col("_rows") - F.coalesce("_seen", F.lit(0)))
    reason = F.when(F.col("_rows").isNull(), F.lit("no_rows")).when(F.col("n_lost") > 0, F.lit("cut_off"))
    return held.withColumn("reason", reason).where("reason IS NOT NULL").select("path", "reason", "length", "n_lost")


def lost_report(ledger: DataFrame) -> DataFrame:
    """Files, bytes and rows lost per reason."""
    return ledger.groupBy("reason").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes"), F.sum("n_lost").alias("n_rows")
    )


def marked(df: DataFrame, skipped: DataFrame, key: str, skip: str = "_skip") -> DataFrame:
    """Rows and a mark (``skip``, the other columns NULL) for each key of ``skipped``, to be brought together by the caller's exchange."""
    marks = skipped.select(key).where(F.col(key).isNotNull()).withColumn(skip, F.lit(True))
    return df.withColumn(skip, F.lit(False)).unionByName(marks, allowMissingColumns=True)


def unmarked(df: DataFrame, *keys: str, skip: str = "_skip") -> DataFrame:
    """Rows of ``marked`` whose keys have no mark; for tables that lie together by some of the keys already."""
    found = df.withColumn(skip, F.max(skip).over(Window.partitionBy(*keys)))
    return found.where(~F.col(skip)).drop(skip)


def _chunked(df: DataFrame, key: str, n: int, seed: int, skipped: DataFrame | None = None) -> DataFrame:
    """Rows with their ``chunk`` (see ``even_chunks``) and ``_place``, which sorts them in it, ties by key.

    Keys alone are ranked, without those of ``skipped``. Every chunk is a range of digests,
    so rows find theirs by comparison with the n - 1 digests where chunks begin, and do not
    move for it; ``skipped`` comes as marks (see ``marked``). Where a chunk begins between
    equal digests (repeated keys), or for very many chunks, whole rows are ranked.
    """
    kept = lambda rows: rows if skipped is None else rows.join(skipped.select(key), key, "left_anti")
    ends = []
    if n <= COMPARED:
        placed = even_chunks(kept(df.select(key)), key, n, seed).withColumn("_digest", digest(seed, F.col(key)))
        ends = placed.groupBy("chunk").agg(F.min("_digest").alias("low"), F.max("_digest").alias("high")).orderBy("chunk").collect()
    if n > COMPARED or any(a.high == b.low for a, b in zip(ends, ends[1:])):
        return even_chunks(kept(df), key, n, seed, chunk="chunk", position="_place")
    begun = F.array(*[F.lit(row.low) for row in ends[1:]]).cast("array<string>")
    chunk = F.size(F.filter(begun, lambda low: low <= F.col("_place"))).cast("bigint")
    rows = df if skipped is None else marked(df, skipped, key)
    return rows.withColumn("_place", digest(seed, F.col(key))).withColumn("chunk", chunk)


def write_shards(
    df: DataFrame, path: str, n: int, key: str, seed: int = 42, mode: str = "errorifexists", skipped: DataFrame | None = None
) -> None:
    """Exactly n Parquet shards ``chunk=i`` of near-equal size, rows in seeded order.

    One exchange brings each chunk to a task of its own, which sorts and writes it. Rows
    whose key is in ``skipped`` are left out; they are found in that task, not by a join.
    """
    # By the very column, so that what stands together by chunk need not move again.
    chunks = _chunked(df, key, n, seed, skipped).withColumn("chunk", F.col("chunk").cast("int")).repartitionById(n, F.col("chunk"))
    if skipped is not None and "_skip" in chunks.columns:
        chunks = unmarked(chunks, "chunk", "_place", key)
    ordered = chunks.sortWithinPartitions("chunk", "_place", key)
    hidden = [c for c in ("_place", key) if c.startswith("_")]
    ordered.drop(*hidden).write.mode(mode).partitionBy("chunk").parquet(path)
    spark = df.sparkSession
    written = set(child_folders(spark, path))
    for i in range(n):
        if f"chunk={i}" not in written:  # fewer rows than shards: an empty shard file
            empty = spark.createDataFrame([], df.drop(*hidden).schema)
            empty.coalesce(1).write.parquet(f"{path}/chunk={i}")


def _footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    for batch in batches:
        rows = []
        for path in batch["path"]:
            system, inner = fs.FileSystem.from_uri(path)
            with system.open_input_file(inner) as f:
                meta = pq.ParquetFile(f).metadata
                rows.append((path, meta.num_row_groups, meta.num_rows))
        yield pd.DataFrame(rows, columns=["path", "num_row_groups", "num_rows"])


def shard_manifest(spark: SparkSession, path: str, tasks: int = 64) -> DataFrame:
    """Row groups and rows per Parquet file, from the footers; no data page is read."""
    files = list_files(spark, [path]).select("path").repartition(tasks)
    return files.mapInPandas(_footers, "path string, num_row_groups bigint, num_rows bigint")


def write_manifest(manifest: DataFrame, path: str, mode: str = "errorifexists") -> None:
    manifest.write.mode(mode).json(path)
