"""Ranks, chunks and shards at their edges."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from packloom.operators import rank as rk
from packloom.operators import sampling as sa


def ids(spark, n):
    return spark.range(n).select(F.col("id"))


@pytest.mark.parametrize("n_rows,n", [(0, 3), (1, 3), (2, 3), (3, 3), (100, 7), (101, 7)])
def test_even_chunks(spark, n_rows, n):
    rows = rk.even_chunks(ids(spark, n_rows), "id", n, 42).collect()
    sizes = Counter(r.chunk for r in rows)
    base, extra = divmod(n_rows, n)
    assert [sizes.get(i, 0) for i in range(n)] == [base + (i < extra) for i in range(n)]
    for chunk, size in sizes.items():
        assert sorted(r.position for r in rows if r.chunk == chunk) == list(range(size))
    order = [r.id for r in sorted(rows, key=lambda r: (r.chunk, r.position))]
    assert order == sorted(range(n_rows), key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest())


def test_one_hot_group_and_null_group(spark):
    rows = [(None if i % 5 == 0 else "hot" if i % 3 else "x", i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, id bigint")
    for ranked in (rk.shuffle_rank(df, "id", 1, within=["g"]), rk.value_rank(df, F.col("id"), within=["g"])):
        got = ranked.collect()
        assert len(got) == 500
        for g in (None, "hot", "x"):
            mine = [r for r in got if r.g == g]
            assert sorted(r["rank"] for r in mine) == list(range(len(mine)))


def test_value_rank_with_heavy_ties_and_nulls(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 1.0, 1.0, 1.0, -2.5, float(i)])) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, v double")
    got = {r.id: r["rank"] for r in rk.value_rank(df, F.col("v"), F.col("id")).collect()}
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0.0, r[0]))
    assert [got[i] for i, _ in want] == list(range(400))


def test_a_heavy_value_is_split_over_ranges(spark, monkeypatch):
    """Without a tie-break too: three quarters of the rows hold one value, no range holds them all."""
    written = []
    monkeypatch.setattr(rk, "staged", lambda df, name, write=rk.staged: written.append(write(df, name)) or written[-1])
    df = spark.range(4000).select("id", F.when(F.col("id") % 4 > 0, "hot").otherwise(F.col("id").cast("string")).alias("v"))
    got = rk.range_rank(df, [F.col("v")], part_rows=250).collect()
    ranges = written[-1].filter("v = 'hot'").groupBy("__range").count().collect()
    assert len(ranges) >= 8 and max(r["count"] for r in ranges) < 1000
    assert sorted(r["rank"] for r in got) == list(range(4000))
    assert [r.v for r in sorted(got, key=lambda r: r["rank"])] == sorted(r.v for r in got)


@pytest.mark.parametrize("parts", [20, 10**6])
def test_range_rank_of_any_type_with_groups(spark, parts):
    """Strings, dates and structs, NULL keys and groups, repeated rows, both directions."""
    rng = random.Random(parts)
    rows = [(rng.choice(["a", "b", None]), rng.choice(["x", "y", "\u00e9", "zz", "", None]), i // 2) for i in range(300)]
    df = spark.createDataFrame([r for r in rows for _ in range(2)], "g string, s string, n bigint")
    order = [F.struct("s", F.lit(1)), F.to_date(F.lit("2024-01-01")), F.col("n").desc()]
    got = rk.range_rank(df, order, ["g"], total="t", part_rows=parts).collect()
    for g in ("a", "b", None):
        mine = sorted((r for r in got if r.g == g), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(len(mine))) and {r.t for r in mine} == {len(mine)}
        key = lambda s, n: (s is not None, (s or "").encode(), -n)
        assert [key(r.s, r.n) for r in mine] == sorted(key(s, n) for h, s, n in rows if h == g for _ in range(2))


def test_range_rank_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "g string, v string")
    assert rk.range_rank(empty, [F.col("v")], ["g"], total="t").collect() == []


def test_range_rank_moves_rows_once(spark):
    """One range exchange; what comes after it joins a few counts, and no window sees the rows."""
    df = spark.range(1000).select("id", F.col("id").cast("string").alias("wide"))
    plan = rk.range_rank(df, [F.col("id")], unique=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan and plan.count("Window [sum") == 1


@pytest.mark.parametrize("special", [float("inf"), float("-inf"), 0.0, None])
def test_frequent_special_values_rank_right(spark, special):
    rows = [(i, special if i % 3 else float(i - 300)) for i in range(600)] + [(600, 1.7976931348623157e308), (601, -1.7976931348623157e308)]
    df = spark.createDataFrame(rows, "id bigint, v double")
    got = {r.id: r["rank"] for r in rk.value_rank(df, F.col("v"), F.col("id")).collect()}
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0.0, r[0]))
    assert [got[i] for i, _ in want] == list(range(602))


@pytest.mark.parametrize("n_rows", [0, 5, 23, 100])
def test_shard_floor_drops_only_remainders(spark, n_rows):
    world, workers = 4, 3
    rows = rk.shard_floor(ids(spark, n_rows), "id", world, workers).collect()
    per_worker = n_rows // world // workers
    assert Counter((r["rank"], r.worker) for r in rows) == Counter(
        {(a, b): per_worker for a in range(world) for b in range(workers) if per_worker}
    )
    single = rk.shard_floor(ids(spark, n_rows), "id", world, None).collect()
    assert len(single) == n_rows // world * world


def test_workers_read_backwards_single_loader_forwards(spark):
    order = sorted(range(24), key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest())
    rows = rk.shard_floor(ids(spark, 24), "id", 2, 2).collect()
    mine = [r.id for r in sorted(rows, key=lambda r: r.position) if r["rank"] == 1 and r.worker == 0]
    assert mine == order[12:18][::-1]
    single = rk.shard_floor(ids(spark, 24), "id", 2, None).collect()
    assert [r.id for r in sorted(single, key=lambda r: r.position) if r["rank"] == 1] == order[12:]


def test_shard_ceil_loses_nothing(spark):
    ranked = rk.shuffle_rank(ids(spark, 10), "id", 1, total="total")
    assert Counter(r.shard for r in rk.shard_ceil(ranked, 4).collect()) == {0: 3, 1: 3, 2: 3, 3: 1}


@pytest.mark.parametrize("n", [None, "None", 0, -1])
def test_take_first_keeps_all(spark, n):
    df = ids(spark, 9).withColumn("s", F.lit("a"))
    assert sa.take_first(df, n, "s", "id").count() == 9


@pytest.mark.parametrize("n", [5, 700, 200_000])
def test_take_first_of_string_positions(spark, n):
    """One path for every n: the same rows as a plain sort, for positions that are no numbers."""
    df = spark.range(3000).select(F.concat(F.lit("p"), F.col("id") * 7 % 3000).alias("at"), F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("s"))
    rows = [(r["at"], r.s) for r in df.collect()]
    for seed in (None, 2):
        key = (lambda at: at) if seed is None else (lambda at: (hashlib.md5(f"2|{at}".encode()).hexdigest(), at))
        want = {(at, s) for s in ("hot", "cold") for at in sorted((a for a, b in rows if b == s), key=key)[:n]}
        assert {(r["at"], r.s) for r in sa.take_first(df, n, "s", "at", seed=seed).collect()} == want


def test_take_first_counts_equal_positions(spark):
    df = spark.range(900).select(F.lit("s").alias("s"), (F.col("id") % 2).alias("at"))
    assert sorted(r["at"] for r in sa.take_first(df, 500, "s", "at").collect()) == [0] * 450 + [1] * 50


def test_cycle_cuts_repeats_and_refuses_empty_sources(spark):
    files = spark.createDataFrame([("a", f"a{i}") for i in range(3)] + [("b", f"b{i}") for i in range(9)], "source string, path string")
    wanted = spark.createDataFrame([("a", 8), ("b", 4)], "source string, n_wanted bigint")
    rows = sa.cycle_to(files, wanted).collect()
    assert sorted(r.entry for r in rows if r.source == "a") == list(range(8))
    assert sorted(r.entry for r in rows if r.source == "b") == list(range(4))
    first = {r.entry: r.path for r in rows if r.source == "a"}
    assert all(first[i] == first[i % 3] for i in range(8))
    missing = spark.createDataFrame([("c", 2)], "source string, n_wanted bigint")
    with pytest.raises(Exception, match="no files for source c"):
        sa.cycle_to(files, missing).collect()


def test_cycle_asks_no_files_of_a_source_that_wants_none(spark):
    files = spark.createDataFrame([("a", "a0"), (None, "x0")], "source string, path string")
    wanted = spark.createDataFrame([("a", 2), ("c", 0), ("d", None), (None, None)], "source string, n_wanted bigint")
    assert sorted(map(tuple, sa.cycle_to(files, wanted).collect())) == [("a", "a0", 0), ("a", "a0", 1)]


def test_mix_needs_weight_and_never_draws_a_zero_group(spark):
    with pytest.raises(ValueError):
        sa.cumulative_weights({"a": 0.0})
    feed = spark.createDataFrame([("a", 0), ("b", 0), ("b", 1)], "group string, place bigint")
    rows = sa.mix(feed, {"zero": 0.0, "a": 1.0, "b": 3.0}, 200, 5, draws_per_cell=16).orderBy("draw_id").collect()
    assert [r.draw_id for r in rows] == list(range(200))
    assert {r.group for r in rows} == {"a", "b"}
    b = [r.place for r in rows if r.group == "b"]
    assert b == [i % 2 for i in range(len(b))]


def test_resume_skips_up_to_and_with_the_saved_place(spark):
    df = spark.createDataFrame([("d", 0, i // 3, i % 3) for i in range(9)] + [("d", 1, 0, 0)], "name string, worker bigint, rg bigint, row bigint")
    saved = spark.createDataFrame([("d", 0, 1, 1)], "name string, worker bigint, rg bigint, row bigint")
    rows = sa.resume_after(sa.repeat_epochs(df, 2), saved, ["name", "worker"], ["rg", "row"], epoch="epoch").collect()
    assert sorted((r.rg, r.row) for r in rows if r.epoch == 0 and r.worker == 0) == [(1, 2), (2, 0), (2, 1), (2, 2)]
    assert len([r for r in rows if r.epoch == 0 and r.worker == 1]) == 1
    assert len([r for r in rows if r.epoch == 1]) == 10


@pytest.mark.parametrize("rows", [[("a", 0)], [("a", 0), ("b", 0), ("b", 2)]])
def test_mix_refuses_to_lose_draws(spark, rows):
    feed = spark.createDataFrame(rows, "group string, place bigint")
    with pytest.raises(Exception, match="group b"):
        sa.mix(feed, {"a": 1.0, "b": 1.0}, 50, 5).collect()
