"""Resuming at the scan, two-step expansion, and the ledger of lost files."""

import pytest
from pyspark.sql import functions as F

from packloom.operators import sampling as sa
from packloom.sources import files as fi


@pytest.fixture
def folders(spark, tmp_path):
    out = {}
    for name in ("one", "two"):
        spark.range(100).select(F.col("id"), F.lit(name).alias("s")).coalesce(1).write.option("maxRecordsPerFile", 10).parquet(str(tmp_path / name))
        out[name] = str(tmp_path / name)
    return out


def test_finished_files_are_not_opened(spark, folders):
    nothing = spark.createDataFrame([], "source string, path string, row bigint")
    whole = sa.resume_scan(spark, folders, nothing)
    assert whole.count() == 200
    saved = whole.where("source = 'one' AND id IN (34)").select("source", "path", "row")
    rest = sa.resume_scan(spark, folders, saved)
    assert sorted(r.id for r in rest.where("source = 'one'").collect()) == list(range(35, 100))
    assert rest.where("source = 'two'").count() == 100
    # Three of ten files lie before the bound: they are not listed for the scan, nor is anything exchanged.
    plan = rest.where("source = 'one'")._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "Exchange" not in text and "file_path" in text
    metrics = rest.where("source = 'one'")
    metrics.collect()
    scans, todo = [], [metrics._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if "FileSourceScan" in node.getClass().getSimpleName():
            scans.append(node.metrics().apply("numFiles").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    assert scans and min(scans) == 7


def test_a_place_in_the_last_file_or_of_the_last_row(spark, folders):
    whole = sa.resume_scan(spark, {"one": folders["one"]}, spark.createDataFrame([], "source string, path string, row bigint"))
    for last, left in ((99, []), (98, [99]), (9, list(range(10, 100)))):
        saved = whole.where(F.col("id") == last).select("source", "path", "row")
        assert sorted(r.id for r in sa.resume_scan(spark, {"one": folders["one"]}, saved).collect()) == left


def test_resume_after_leaves_the_feed_where_it_is(spark):
    feed = spark.range(1000).select((F.col("id") % 3).cast("string").alias("source"), F.col("id").alias("row_idx"))
    saved = spark.createDataFrame([("0", 500), ("1", 10)], "source string, row_idx bigint")
    rest = sa.resume_after(feed, saved, ["source"], ["row_idx"])
    assert "hashpartitioning" not in rest._jdf.queryExecution().executedPlan().toString()
    want = [i for i in range(1000) if i % 3 == 2 or i % 3 == 0 and i > 500 or i % 3 == 1 and i > 10]
    assert sorted(r.row_idx for r in rest.collect()) == want


@pytest.mark.parametrize("few", [0, 100_000])
def test_resume_after_with_many_positions_is_the_same(spark, few, monkeypatch):
    monkeypatch.setattr(sa, "FEW_POSITIONS", few)
    feed = spark.range(300).select((F.col("id") % 3).cast("string").alias("source"), F.col("id").alias("row_idx"))
    saved = spark.createDataFrame([("0", 150), ("1", 10)], "source string, row_idx bigint")
    got = sa.resume_after(feed, saved, ["source"], ["row_idx"]).collect()
    assert len(got) == 100 + 49 + 96


def test_a_row_drawn_millions_of_times_lies_in_many_tasks(spark):
    one = spark.createDataFrame([("hot", 2_999_999), ("cold", 2), ("none", -1), ("null", None)], "name string, last bigint")
    rows = sa.expand_turns(one, F.col("last"), "turn")
    tasks = rows.groupBy("name", F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("a"), F.max("turn").alias("b")).collect()
    hot = [r for r in tasks if r.name == "hot"]
    assert sum(r.n for r in hot) == 3_000_000 and len(hot) >= 6 and max(r.n for r in hot) < 1_200_000
    assert min(r.a for r in hot) == 0 and max(r.b for r in hot) == 2_999_999
    assert {r.name for r in tasks} == {"hot", "cold"}
    assert rows.where("name = 'hot'").select("turn").distinct().count() == 3_000_000


def test_a_corrupt_file_gives_one_ledger_row(spark, tmp_path):
    """Its neighbours' rows come through; a file whose rows were decoded in part is named with the number lost."""
    for name in "abc":
        spark.range(50).coalesce(1).write.parquet(str(tmp_path / name))
    broken = tmp_path / "a" / "broken.parquet"
    broken.write_bytes(b"PAR1 no such thing")
    dirs = [str(tmp_path / n) for n in "abc"]
    rows = fi.read_counted(spark, dirs, "id bigint")
    assert rows.count() == 150
    got = fi.lost_files(spark, dirs, rows, "id bigint").collect()
    assert [(r.path.rsplit("/", 1)[1], r.reason, r.length, r.n_lost) for r in got] == [("broken.parquet", "no_rows", 18, None)]
    partly = rows.where(~(F.col("path").contains("/b/") & (F.col("id") >= 20)))
    report = {r.reason: (r.n_files, r.n_rows) for r in fi.lost_report(fi.lost_files(spark, dirs, partly, "id bigint")).collect()}
    assert report == {"no_rows": (1, None), "cut_off": (1, 30)}
