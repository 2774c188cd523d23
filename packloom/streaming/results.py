"""Judge results as they finish: the latest row per key and a running report.

The latest rows live in Spark's state store: a batch changes the keys it brings and nothing
else, and Spark frees old versions (``spark.sql.streaming.minBatchesToRetain``). Readers
take the state as a table; there is no second copy of it in files.

The report is kept by retraction. A keyed state holds what each key last counted for; a
changed key sends minus its old and plus its new score, and only these differences are
summed. Neither the result table nor the state is read again for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..session import child_folders, drop_folder

# Scores are summed as decimals, so that taking one back leaves nothing behind.
EXACT = "decimal(28,10)"
# Buckets of keys of the running report, fixed for a checkpoint; 10 million keys are 600 a bucket.
BUCKETS = 1 << 14


def read_stream(spark: SparkSession, source: str, schema: StructType, fmt: str = "parquet", max_files: int = 10) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files).load(source)


def latest_rows(rows: DataFrame, key: str = "item_key", seq: str = "seq") -> DataFrame:
    """(key, latest): the row with the highest ``seq`` per key, as a streaming aggregate for update mode.

    Of several rows with the same ``seq`` the largest in the order of the other columns counts;
    a NULL ``seq`` comes before all others.
    """
    rest = [c for c in rows.columns if c not in (key, seq)]
    return rows.groupBy(key).agg(F.max(F.struct(seq, *rest)).alias("latest"))


def stream_results(
    spark: SparkSession,
    source: str,
    schema: StructType,
    checkpoint: str,
    key: str = "item_key",
    seq: str = "seq",
    fmt: str = "parquet",
    max_files: int = 10,
    changed: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Take in all result files that are there, continuing after the last finished batch.

    ``changed`` gets the latest rows of the keys a batch touched, and the batch id; after a
    failure it may get the same batch again.
    """
    latest = latest_rows(read_stream(spark, source, schema, fmt, max_files), key, seq)
    out = latest.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if changed:
        return out.foreachBatch(lambda batch, batch_id: changed(batch.select(key, "latest.*"), batch_id)).start()
    return out.format("noop").start()


def read_results(spark: SparkSession, checkpoint: str, schema: StructType, key: str = "item_key") -> DataFrame:
    """Latest row per key as of the last finished batch: the state store read as a table.

    Before the first batch there are no rows.
    """
    if not child_folders(spark, f"{checkpoint}/commits"):
        return spark.createDataFrame([], schema)
    state = spark.read.format("statestore").load(checkpoint)
    latest = state.schema["value"].dataType.names[0]
    names = [c for c in schema.fieldNames() if c != key]
    return state.select(F.col("key")[key].alias(key), *[F.col("value")[latest][c].alias(c) for c in names]).select(*schema.fieldNames())


def score_changes(
    rows: DataFrame, key: str = "item_key", seq: str = "seq", name: str = "name", score: str = "score", buckets: int = BUCKETS
) -> DataFrame:
    """(name, score, scored, counted): what each key's batch takes from one name and adds to another.

    Per key the state holds ``seq``, name and score of the row that counts. A key whose row
    does not change sends nothing; one that changes its score only sends the difference in
    two rows, minus the old one and plus the new one.

    Python is called once per bucket of keys and batch, not once per key: a bucket's state is
    one row with an array per column, written when a key of the bucket changes. Keys are held
    as text.
    """
    text = F.col(key).cast("string")
    one = rows.select(F.pmod(F.xxhash64(text), F.lit(buckets)).alias("bucket"), text.alias("key"), F.col(seq).cast("bigint").alias("seq"), F.col(name).alias("name"), F.col(score).cast(EXACT).alias("score"))

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {k: row for k, *row in zip(*state.get)} if state.exists else {}
        rank = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "", r[2] is not None, r[2] or Decimal(0))
        new: dict[str | None, list] = {}
        for part in parts:
            for k, s, n, x in zip(part["key"], part["seq"], part["name"], part["score"]):
                row = [None if pd.isna(s) else int(s), n, None if pd.isna(x) else x]
                last = new[k] if k in new else held.get(k)
                if last is None or rank(row) > rank(last):
                    new[k] = row
        out = []
        for k, row in new.items():
            for (_, n, x), sign in (([(held[k], -1)] if k in held else []) + [(row, 1)]):
                out.append((n, sign * (x if x is not None else Decimal(0)), sign * int(x is not None), sign))
        if new:
            held.update(new)
            state.update((list(held), *map(list, zip(*held.values()))))
        yield pd.DataFrame(out, columns=["name", "score", "scored", "counted"])

    state = f"keys array<string>, seqs array<bigint>, names array<string>, scores array<{EXACT}>"
    # Sequence numbers travel as text: pandas would turn a bigint with NULLs into doubles.
    one = one.withColumn("seq", F.col("seq").cast("string"))
    return one.groupBy("bucket").applyInPandasWithState(
        step, f"name string, score {EXACT}, scored bigint, counted bigint", state, "update", GroupStateTimeout.NoTimeout
    )


SUMS = "name string, total decimal(38,10), scored bigint, counted bigint"


def _versions(spark: SparkSession, path: str, below: int | None = None) -> list[int]:
    """Finished report versions in batch order."""
    found = sorted(int(c.split("=", 1)[1]) for c in child_folders(spark, path) if c.startswith("batch="))
    return [n for n in found if (below is None or n < below) and "_SUCCESS" in child_folders(spark, f"{path}/batch={n}")]


def keep_report(path: str, keep: int = 2) -> Callable[[DataFrame, int], None]:
    """foreachBatch function that adds a batch's changes to the sums per name in ``path``.

    A version has one row per name and is named by its batch, so a replayed batch overwrites
    what it wrote. The last ``keep`` versions stay, older ones are removed.
    """

    def write(changes: DataFrame, batch_id: int) -> None:
        spark = changes.sparkSession
        sums = changes.select("name", F.col("score").alias("total"), "scored", "counted")
        before = _versions(spark, path, batch_id)
        if before:
            sums = spark.read.schema(SUMS).parquet(f"{path}/batch={before[-1]}").unionByName(sums)
        total = F.sum("total").cast("decimal(38,10)").alias("total")
        merged = sums.groupBy("name").agg(total, F.sum("scored").alias("scored"), F.sum("counted").alias("counted"))
        merged.where("counted > 0").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        for old in before[: len(before) + 1 - keep]:
            drop_folder(spark, f"{path}/batch={old}")

    return write


def stream_report(
    spark: SparkSession,
    source: str,
    schema: StructType,
    path: str,
    checkpoint: str,
    fmt: str = "parquet",
    max_files: int = 10,
    columns: Sequence[str] = ("item_key", "seq", "name", "score"),
) -> StreamingQuery:
    """Keep the report in ``path`` up to date with all result files that are there."""
    changes = score_changes(read_stream(spark, source, schema, fmt, max_files), *columns)
    out = changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return out.foreachBatch(keep_report(path)).start()


def mean(total: Column, n: Column) -> Column:
    return F.when(n > 0, total.cast("double") / n)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """(name, score, n_scored): mean score per name over the latest row of every key, NULL names left out."""
    found = _versions(spark, path)
    sums = spark.read.schema(SUMS).parquet(f"{path}/batch={found[-1]}") if found else spark.createDataFrame([], SUMS)
    return sums.where(F.col("name").isNotNull()).select("name", mean(F.col("total"), F.col("scored")).alias("score"), F.col("scored").alias("n_scored"))
