"""Exact ranks over a whole table, or within a few large groups, without one big task.

A plain ``row_number() over (order by ...)`` sends every row to one task, and
``partition by source`` sends a source with a third of the table to one task. Here rows
fall into *cells*: ranges of the sort key that are small and in sort order. Only
cell counts are summed globally; rows are ranked inside their cell.

    rows --hash(cell)--> row_number per cell --+
                                               +-- sort-merge join on cell, no new exchange
    counts per cell --> running sum -----------+   of the rows

Seeded orders have md5 prefixes as cells. Any other order goes through ``range_rank``:
one range exchange, the rows of each range counted, offsets added back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import digest
from ..session import staged

PART_ROWS = 1_000_000  # rows of a range at most, on average
DIGITS = 4  # 65,536 cells: about 1.5 million rows per cell at 10^11 rows


def hash_cell(digest_col: Column, digits: int = DIGITS) -> Column:
    """Cell of an md5 sort key: its prefix. Even by construction."""
    return F.substring(digest_col, 1, digits)


def number_cell(position: Column, width: int) -> Column:
    """Cell of a dense non-negative position: fixed-width ranges, zero-padded to sort as text."""
    return F.lpad(F.floor(position / F.lit(width)).cast("string"), 19, "0")


def _name(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def cell_rank(
    df: DataFrame,
    cell: Column,
    order: Sequence[Column],
    within: Sequence[str] = (),
    rank: str = "rank",
    total: str | None = None,
    shared: bool = False,
) -> DataFrame:
    """Add a 0-based rank in ``order``, per group of the few columns in ``within``.

    ``cell`` must never decrease along ``order``. ``total`` names an optional column with
    the group's row count. ``shared`` gives rows equal in ``order`` the same rank.
    """
    group = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in within]
    keyed = df.withColumn("_group", F.concat_ws("\x1f", *group) if group else F.lit("")).withColumn("_cell", cell)
    counts = keyed.groupBy("_group", "_cell").agg(F.count(F.lit(1)).alias("_rows"))
    # At most (groups x cells) rows, whatever the table size.
    by_group = Window.partitionBy("_group")
    offsets = counts.select(
        "_group",
        "_cell",
        (F.sum("_rows").over(by_group.orderBy("_cell")) - F.col("_rows")).alias("_offset"),
        F.sum("_rows").over(by_group).alias("_total"),
    )
    in_cell = Window.partitionBy("_group", "_cell").orderBy(*order)
    ranked = keyed.withColumn("_rn", (F.rank() if shared else F.row_number()).over(in_cell))
    out = ranked.join(offsets, ["_group", "_cell"]).withColumn(
        rank, F.col("_offset") + F.col("_rn").cast("bigint") - F.lit(1)
    )
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.select(*df.columns, rank, *([total] if total else []))


def shuffle_rank(
    df: DataFrame,
    key: str | Column,
    seed: int,
    within: Sequence[str] = (),
    rank: str = "rank",
    total: str | None = None,
    digits: int = DIGITS,
) -> DataFrame:
    """Rank in the seeded shuffle order: md5 of ``seed|key``, then the key."""
    keyed = df.withColumn("_digest", digest(seed, _name(key)))
    out = cell_rank(
        keyed, hash_cell(F.col("_digest"), digits), [F.col("_digest"), _name(key)], within, rank, total
    )
    return out.drop("_digest")


def global_rank(df: DataFrame, key: str, seed: int = 0, rank: str = "rank") -> DataFrame:
    return shuffle_rank(df, key, seed, rank=rank)


def seeded_shuffle(df: DataFrame, key: str, seed: int) -> DataFrame:
    """The table in its seeded order; a range-partitioned sort, so it scales out."""
    return df.orderBy(digest(seed, F.col(key)), F.col(key))


def range_rank(
    df: DataFrame,
    order: Sequence[Column],
    within: Sequence[str] = (),
    rank: str = "rank",
    total: str | None = None,
    unique: bool = False,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """0-based rank in any sort order, per group of ``within``, by one range exchange.

    Rows are dealt to sorted ranges of (``within``, ``order``) and written with their place
    in their range. Only the rows per range and group are counted and summed up; the sums
    are added back to the places. The number of ranges grows with the rows, and any
    orderable type will do: nothing is cast or cut into quantiles.

    Rows equal in ``order`` follow their place in the input, which also spreads a value
    that holds much of the table over several ranges. For that the table is written once
    before; ``unique`` says that no two rows are equal in ``order`` and saves the writing.
    NULL keys rank first or last as ``order`` says, NULL groups are a group.
    """
    spark = df.sparkSession
    by = [*[F.col(c) for c in within], *order]
    if not unique:
        df, by = staged(df.withColumn("__row", F.monotonically_increasing_id()), "rank-rows"), [*by, F.col("__row")]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // part_rows))
    sorted_rows = df.repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    placed = staged(sorted_rows.withColumn("__range", F.shiftright("__at", 33)), "ranked")
    counts = placed.groupBy("__range", *within).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    by_group = Window.partitionBy(*within)
    # One row per range that a group reaches into, whatever the table size.
    before = counts.select(
        F.col("__range").alias("__of"),
        *[F.col(c).alias(f"__of_{i}") for i, c in enumerate(within)],
        (F.sum("__rows").over(by_group.orderBy("__range")) - F.col("__rows") - F.col("__first")).alias("__shift"),
        F.sum("__rows").over(by_group).alias("__total"),
    )
    on = F.col("__range") == F.col("__of")
    for i, c in enumerate(within):
        on = on & F.col(c).eqNullSafe(F.col(f"__of_{i}"))
    columns = [F.col(c) for c in df.columns if c != "__row" or unique]
    out = placed.join(before, on).select(
        *columns, (F.col("__at") + F.col("__shift")).alias(rank), *([F.col("__total").alias(total)] if total else [])
    )
    return out


def value_rank(
    df: DataFrame,
    value: Column,
    tie: Column | None = None,
    within: Sequence[str] = (),
    rank: str = "rank",
    total: str | None = None,
    shuffle_ties: bool = False,
) -> DataFrame:
    """0-based rank by a column of any orderable type; see ``range_rank``.

    Ties go by ``tie`` or, with ``shuffle_ties``, by the md5 of ``tie``.
    """
    order = [value] if tie is None else [value, digest(0, tie), tie] if shuffle_ties else [value, tie]
    return range_rank(df, order, within, rank, total)


def even_chunks(df: DataFrame, key: str, n: int, seed: int, chunk: str = "chunk", position: str = "position") -> DataFrame:
    """n near-equal chunks of the seeded shuffle; the first ``N mod n`` get one row more.

    Adds the chunk number and the row's position in its chunk.
    """
    ranked = shuffle_rank(df, key, seed, rank="_rank", total="_n")
    rank, total = F.col("_rank"), F.col("_n")
    base, extra = F.floor(total / n), total % n
    head = extra * (base + 1)  # rows in the longer chunks
    return (
        ranked.withColumn(
            chunk,
            F.when(rank < head, F.floor(rank / (base + 1)))
            .otherwise(extra + F.floor((rank - head) / F.greatest(base, F.lit(1))))
            .cast("bigint"),
        )
        .withColumn(
            position,
            F.when(rank < head, rank % (base + 1)).otherwise((rank - head) % F.greatest(base, F.lit(1))).cast("bigint"),
        )
        .drop("_rank", "_n")
    )


def shard_floor(df: DataFrame, key: str, world: int, workers: int | None, seed: int = 42) -> DataFrame:
    """Seeded assignment to ranks and loader workers that drops both remainders.

    ``workers=None`` is the single-process loader: worker 0 takes the rank's rows in
    order. With workers, each worker reads its slice backwards. Adds rank, worker and
    the row's reading position.
    """
    ranked = shuffle_rank(df, key, seed, rank="_rank", total="_n")
    per_rank = F.floor(F.col("_n") / world)
    out = ranked.withColumn("_per_rank", per_rank).filter(F.col("_rank") < F.col("_per_rank") * world)
    out = out.withColumn("rank", F.floor(F.col("_rank") / F.col("_per_rank")).cast("bigint")).withColumn(
        "_local", F.col("_rank") % F.col("_per_rank")
    )
    if workers is None:
        out = out.withColumn("worker", F.lit(0).cast("bigint")).withColumn("position", F.col("_local"))
    else:
        out = out.withColumn("_per_worker", F.floor(F.col("_per_rank") / workers)).filter(
            F.col("_local") < F.col("_per_worker") * workers
        )
        out = out.withColumn("worker", F.floor(F.col("_local") / F.col("_per_worker")).cast("bigint")).withColumn(
            "position", F.col("_per_worker") - 1 - F.col("_local") % F.col("_per_worker")
        )
    return out.withColumn("position", F.col("position").cast("bigint")).select(*df.columns, "rank", "worker", "position")


def shard_ceil(df: DataFrame, world: int, ranked: str = "rank", total: str = "total", shard: str = "shard") -> DataFrame:
    """Contiguous slices of ``ceil(N/world)`` rows of an already ranked table; none dropped."""
    size = F.ceil(F.col(total) / world)
    return df.withColumn(shard, F.floor(F.col(ranked) / size).cast("bigint"))
