"""Taking, repeating, mixing and resuming rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.draws import digest, uniform
from .rank import cell_rank, number_cell, range_rank, shuffle_rank


def _wanted(n: int | str | None) -> int | None:
    """None, 'None' and numbers below 1 all mean: keep everything."""
    if n is None or n == "None" or int(n) <= 0:
        return None
    return int(n)


def take_first(df: DataFrame, n: int | str | None, source: str, position: str, seed: int | None = None) -> DataFrame:
    """First n rows of every source, in position order or, with ``seed``, shuffled order.

    Positions may be of any orderable type. One path for every n: the first n of each
    (source, salt), which Spark limits before it shuffles, then exact ranks of what is left
    by a range exchange, or by md5 cells for the shuffled order. Both spread a source with
    a third of the table over tasks; the salts grow with the shuffle partitions.
    """
    n = _wanted(n)
    if n is None:
        return df
    order = [F.col(position)] if seed is None else [digest(seed, F.col(position)), F.col(position)]
    # Salted by whole rows, so that equal positions are spread too.
    hashed = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]
    salt = F.pmod(F.xxhash64(*hashed), F.lit(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    in_salt = F.row_number().over(Window.partitionBy(source, "_salt").orderBy(*order))
    left = df.withColumn("_salt", salt).withColumn("_rn", in_salt).filter(F.col("_rn") <= n).drop("_salt", "_rn")
    if seed is None:
        ranked = range_rank(left, order, within=[source], rank="_rank")
    else:
        ranked = shuffle_rank(left, position, seed, within=[source], rank="_rank")
    return ranked.filter(F.col("_rank") < n).drop("_rank")


FEW_POSITIONS = 100_000  # saved places that may be sent to every task: about 10 MB

# Turns of one row that one task writes; a row with more is dealt to several.
TURNS = 100_000


def expand_turns(df: DataFrame, last: Column, out: str) -> DataFrame:
    """Each row once for every number 0..``last`` in column ``out``; none for a ``last`` below 0 or NULL.

    Rows go out as chunks of ``TURNS`` numbers first, the chunks are exchanged, and numbers
    are written inside chunks: a row that is repeated very often is no work for one task.
    """
    hashed = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]
    zero = F.lit(0).cast("bigint")
    chunks = df.withColumn("_last", last.cast("bigint")).where("_last >= 0")
    chunks = chunks.withColumn("_first", F.explode(F.sequence(zero, F.col("_last"), F.lit(TURNS).cast("bigint"))))
    # A fixed number: merged back by size, the few chunk rows would meet in one task again.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = chunks.repartition(parts, F.xxhash64(*hashed, "_first"))
    inside = F.sequence(F.col("_first"), F.least(F.col("_last"), F.col("_first") + (TURNS - 1)))
    return dealt.withColumn(out, F.explode(inside)).drop("_last", "_first")


def cycle_to(
    files: DataFrame,
    wanted: DataFrame,
    source: str = "source",
    path: str = "path",
    n: str = "n_wanted",
    seed: int = 0,
) -> DataFrame:
    """Repeat or cut each source's file list to exactly the wanted number of entries.

    ``wanted`` has one row per source. The list order is the seeded one, since a folder
    listing has none. A wanted source without files is an error. Adds ``entry``, the
    0-based place in the list.
    """
    ranked = shuffle_rank(files, path, seed, within=[source], rank="_at", total="_len").select(
        F.col(source).alias("_source"), path, "_at", "_len"
    )
    joined = wanted.join(ranked, F.col(source) == F.col("_source"), "left")
    # The check stands outside the division: an expression that is NULL whenever ``_at`` is would let the left join become an inner one.
    missing = F.raise_error(F.concat(F.lit("no files for source "), F.col(source))).cast("bigint")
    last = F.when(F.col("_len").isNull() & (F.col(n) > 0), missing).otherwise(F.floor((F.col(n) - 1 - F.col("_at")) / F.col("_len")))
    repeated = expand_turns(joined.select(source, path, "_at", "_len", last.alias("_reps")), F.col("_reps"), "_rep")
    return repeated.select(source, path, (F.col("_rep") * F.col("_len") + F.col("_at")).alias("entry"))


def expand_row_groups(files: DataFrame, manifest: DataFrame, path: str = "path") -> DataFrame:
    """One row per (file, row group) for the files the manifest knows; others vanish."""
    known = manifest.select(F.col("path").alias("_path"), "num_row_groups")
    groups = F.sequence(F.lit(0).cast("bigint"), F.col("num_row_groups").cast("bigint") - 1)
    return (
        files.join(known, F.col(path) == F.col("_path"))
        .filter("num_row_groups > 0")
        .select(*files.columns, F.explode(groups).alias("rg_idx"))
    )


def gather_shards(parts: Sequence[DataFrame], rank: str = "rank") -> DataFrame:
    """All ranks' tables as one, with the rank each row came from."""
    tagged = [df.withColumn(rank, F.lit(i).cast("bigint")) for i, df in enumerate(parts)]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df)
    return out


def resume_after(
    df: DataFrame, positions: DataFrame, keys: Sequence[str], place: Sequence[str], epoch: str | None = None
) -> DataFrame:
    """Skip everything up to and including the saved place of each (data set, worker).

    ``positions`` has one row per worker: the keys plus the same place columns. Keys
    without a saved place start from the beginning. With ``epoch``, only epoch 0 skips.
    """
    saved = positions.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.struct(*[F.col(p).cast("bigint").alias(p) for p in place]).alias("_saved")
    )
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(k) == F.col(f"_k_{k}"))
    here = F.struct(*[F.col(p).cast("bigint").alias(p) for p in place])
    keep = F.col("_saved").isNull() | (here > F.col("_saved"))
    if epoch:
        keep = keep | (F.col(epoch) > 0)
    # One row per worker and data set: sent to the feed while it is that small, so the feed stays where it is.
    if positions.limit(FEW_POSITIONS + 1).count() <= FEW_POSITIONS:
        saved = F.broadcast(saved)
    return df.join(saved, on, "left").filter(keep).select(*df.columns)


def resume_scan(
    spark: SparkSession, folders: Mapping[str, str], positions: DataFrame, source: str = "source", path: str = "path", row: str = "row", schema: str | None = None
) -> DataFrame:
    """Rows of Parquet data sets after each one's saved file and row, with ``source``, ``path`` and ``row``.

    ``folders`` maps a data set to its folder; its files count in path order. ``positions``
    has one row per data set: the file and the 0-based row in it that were read last. Saved
    files become bounds on the file's path, which Spark applies when it lists the files, so
    finished files are never opened; only in the file at the bound rows are skipped by their
    number. A data set without a position is read from its beginning.
    """
    saved = {r[source]: (r[path], r[row]) for r in positions.select(source, path, row).limit(len(folders) + 1).collect()}
    reader = spark.read.schema(schema) if schema else spark.read
    parts = []
    for name, folder in folders.items():
        rows = reader.parquet(folder)
        file, at = F.col("_metadata.file_path"), F.col("_metadata.row_index")
        if name in saved:
            rows = rows.where(file >= saved[name][0]).where((file > saved[name][0]) | (at > saved[name][1]))
        parts.append(rows.select("*", F.lit(name).alias(source), file.alias(path), at.alias(row)))
    return reduce(DataFrame.unionByName, parts)


def repeat_epochs(df: DataFrame, k: int, epoch: str = "epoch") -> DataFrame:
    """k passes over the table, numbered from 0."""
    passes = F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint"))
    return df.select("*", F.explode(passes).alias(epoch))


def cumulative_weights(weights: Mapping[str, float]) -> list[tuple[str, float]]:
    total = sum(weights.values())
    if total <= 0:
        raise ValueError("the weights must sum to more than 0")
    out, running = [], 0.0
    for name, weight in weights.items():
        running += weight
        out.append((name, running / total))
    return out


def draw_groups(spark: SparkSession, weights: Mapping[str, float], n_draws: int, seed: int) -> DataFrame:
    """n draws of a group: the first group whose cumulative weight exceeds the draw."""
    draws = spark.range(n_draws).withColumnRenamed("id", "draw_id")
    u = uniform(seed, F.col("draw_id"), "mix")
    cumulative = cumulative_weights(weights)
    # A draw no bound exceeds falls back to the first group, as in the loop it mirrors.
    group = F.lit(cumulative[0][0])
    for name, bound in reversed(cumulative):
        group = F.when(u < F.lit(bound), F.lit(name)).otherwise(group)
    return draws.withColumn("group", group)


def mix(
    feed: DataFrame,
    weights: Mapping[str, float],
    n_draws: int,
    seed: int,
    group: str = "group",
    place: str = "place",
    draws_per_cell: int = 1_000_000,
) -> DataFrame:
    """Weighted mixture of feeds: n draws, each group read in order and wrapped at its end.

    ``place`` is the row's 0-based number in its group's feed. Every feed row is expanded
    to the turns it will serve and joined on (group, turn), which is unique on both
    sides: a small group drawn very often makes no hot key. A drawn group without rows, or
    whose places are not 0 to its size - 1, is an error: its draws could not be delivered.
    """
    draws = draw_groups(feed.sparkSession, weights, n_draws, seed)
    turns = cell_rank(draws, number_cell(F.col("draw_id"), draws_per_cell), [F.col("draw_id")], ["group"], rank="_turn")
    size, far, near = F.count(F.lit(1)), F.max(place), F.min(place)
    sizes = feed.groupBy(group).agg(F.when((near == 0) & (far == size - 1) & (F.count(place) == size), size).alias("_size"))
    demand = draws.groupBy("group").agg(F.count(F.lit(1)).alias("_demand")).withColumnRenamed("group", "_g")
    # At most one row per group; both come out of partial aggregates.
    gap = F.raise_error(F.concat(F.lit("mix: no rows, or gaps between the places, in group "), "_g")).cast("bigint")
    plan = demand.join(sizes, F.col("_g") == F.col(group), "left").select("_g", F.coalesce("_size", gap).alias("_size"), "_demand")
    last = F.floor((F.col("_demand") - 1 - F.col(place)) / F.col("_size"))
    supply = feed.join(plan, F.col(group) == F.col("_g")).select(*[F.col(c) for c in feed.columns], "_size", last.alias("_cycles"))
    supply = expand_turns(supply, F.col("_cycles"), "_cycle").withColumn("_serve", F.col("_cycle") * F.col("_size") + F.col(place))
    supply = supply.drop("_size", "_cycles")
    turns = turns.select("draw_id", F.col("group").alias("_group"), "_turn")
    return (
        turns.join(supply, (F.col("_group") == F.col(group)) & (F.col("_turn") == F.col("_serve")))
        .select("draw_id", F.col("_cycle").alias("cycle"), *feed.columns)
    )


def length_filter(df: DataFrame, max_len: int, length: str = "length") -> DataFrame:
    """Drop samples longer than the limit; equal length stays."""
    return df.filter(F.col(length) <= max_len)


def sample_k(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """k rows without replacement; a top-k, so no full sort."""
    return df.orderBy(digest(seed, F.col(key)), F.col(key)).limit(k)


def progress_ledger(df: DataFrame, keys: Sequence[str], place: Sequence[str]) -> DataFrame:
    """Furthest place reached per (data set, worker)."""
    furthest = F.max(F.struct(*place)).alias("_place")
    return df.groupBy(*keys).agg(furthest).select(*keys, *[F.col(f"_place.{p}").alias(p) for p in place])


def pending(items: DataFrame, done: DataFrame, key: str = "item_key", retry_errors: bool = False) -> DataFrame:
    """Items without a result; an error result counts as done unless asked otherwise."""
    if retry_errors:
        done = done.filter(F.col("error").isNull())
    return items.join(done.select(key), key, "left_anti")


def pending_outputs(items: DataFrame, manifest: DataFrame, output: Column) -> DataFrame:
    """Items whose output file is not in the manifest yet."""
    known = manifest.select(F.col("path").alias("_path"))
    return items.join(known, output == F.col("_path"), "left_anti")
