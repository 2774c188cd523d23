"""Streaming results equal batch results, across restarts and replays."""

import random

import pytest

from packloom.operators.evaluation import latest_judgements
from packloom.streaming import feed as sf
from packloom.streaming import results as sr

SCHEMA = "item_key string, name string, seq bigint, score bigint"


def rows(lo, hi, seed):
    rng = random.Random(seed)
    return [(f"k{rng.randint(0, 40)}", rng.choice("xyz"), s, rng.randint(1, 5)) for s in range(lo, hi)]


def add(spark, new, source):
    spark.createDataFrame(new, SCHEMA).repartition(3).write.mode("append").parquet(source)


def plain_report(everything):
    latest = {}
    for key, name, seq, score in everything:
        if key not in latest or seq > latest[key][0]:
            latest[key] = (seq, name, score)
    by_name = {}
    for _, name, score in latest.values():
        by_name.setdefault(name, []).append(score)
    scored = {n: [s for s in scores if s is not None] for n, scores in by_name.items() if n is not None}
    return sorted((n, sum(s) / len(s) if s else None, len(s)) for n, s in scored.items())


def test_restart_continues_and_equals_batch(spark, tmp_path):
    """Latest rows and the report over three restarts; keys change their name and score, names vanish, values are NULL."""
    source, checkpoint, reported, report = (str(tmp_path / p) for p in ("in", "cp", "cp2", "report"))
    schema = spark.createDataFrame([], SCHEMA).schema
    assert sr.read_results(spark, checkpoint, schema).collect() == [] == sr.read_report(spark, report).collect()
    everything = []
    for round_no in range(3):
        new = rows(round_no * 60, round_no * 60 + 60, round_no)
        new = [(k, None if q % 11 == 0 else "once" if round_no == 0 and k == "k7" else n, q, None if q % 7 == 0 else s) for k, n, q, s in new]
        if round_no:
            new.append(("k7", "z", round_no * 60 + 60, 4))
        everything += new
        add(spark, new, source)
        sr.stream_results(spark, source, schema, checkpoint, max_files=2).awaitTermination()
        got = sorted(map(repr, sr.read_results(spark, checkpoint, schema).collect()))
        want = latest_judgements(spark.createDataFrame(everything, SCHEMA)).select("item_key", "name", "seq", "score").collect()
        assert got == sorted(map(repr, want))
        sr.stream_report(spark, source, schema, report, reported, max_files=2).awaitTermination()
        assert sorted(tuple(r) for r in sr.read_report(spark, report).collect()) == [(n, m and pytest.approx(m), c) for n, m, c in plain_report(everything)]


def test_a_batch_costs_what_it_brings(spark, tmp_path):
    """Twelve batches of four new keys and one old one: state rows updated and rows out stay alike while the table grows."""
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    schema = spark.createDataFrame([], SCHEMA).schema
    for i in range(12):
        new = [("old", "x", i, i)] + [(f"k{i}-{j}", "y", i * 10 + j, 1) for j in range(4)]
        spark.createDataFrame(new, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    out = []
    job = sr.stream_results(spark, source, schema, checkpoint, max_files=1, changed=lambda batch, i: out.append(batch.count()))
    job.awaitTermination()
    state = [p.stateOperators[0] for p in job.recentProgress if p.numInputRows]
    assert out == [5] * 12 and [s.numRowsUpdated for s in state] == [5] * 12
    assert [s.numRowsTotal for s in state] == [5 + 4 * i for i in range(12)]
    # One delta file per state partition and batch; nothing else is written as the table grows.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for version in range(2, 13):
        assert len(list((tmp_path / "cp" / "state").rglob(f"{version}.delta"))) == parts


def test_only_differences_reach_the_report(spark, tmp_path):
    source, checkpoint, path = (str(tmp_path / p) for p in ("in", "cp", "report"))
    schema = spark.createDataFrame([], SCHEMA).schema
    seen = []

    def take(new):
        spark.createDataFrame(new, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        changes = sr.score_changes(sr.read_stream(spark, source, schema, max_files=1))
        seen.clear()

        def step(batch, batch_id):
            seen.extend(sorted((r.name, float(r.score), r.scored, r.counted) for r in batch.collect()))
            sr.keep_report(path)(batch, batch_id)

        changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start().awaitTermination()

    take([("a", "x", 1, 4), ("b", "x", 1, 2), ("a", "x", 0, 5)])
    assert seen == [("x", 2.0, 1, 1), ("x", 4.0, 1, 1)]
    take([("a", "y", 2, 1), ("b", "x", 1, 2), ("b", "x", 0, 5)])
    assert seen == [("x", -4.0, -1, -1), ("y", 1.0, 1, 1)]
    take([("b", "y", 3, None)])
    assert seen == [("x", -2.0, -1, -1), ("y", 0.0, 0, 1)]
    assert [tuple(r) for r in sr.read_report(spark, path).collect()] == [("y", 1.0, 1)]


def test_a_replayed_batch_changes_nothing_and_old_reports_go(spark, tmp_path):
    schema = f"name string, score {sr.EXACT}, scored bigint, counted bigint"
    from decimal import Decimal

    batches = [spark.createDataFrame([("x", Decimal(i), 1, 1), ("y", Decimal(1), 1, 1)], schema) for i in range(4)]
    write = sr.keep_report(str(tmp_path))
    for i, batch in enumerate(batches):
        write(batch, i)
    before = sorted(map(tuple, sr.read_report(spark, str(tmp_path)).collect()))
    assert before == [("x", 1.5, 4), ("y", 1.0, 4)]
    write(batches[3], 3)
    assert sorted(map(tuple, sr.read_report(spark, str(tmp_path)).collect())) == before
    assert sr._versions(spark, str(tmp_path)) == [2, 3]
    (tmp_path / "batch=9").mkdir()  # unfinished
    assert sorted(map(tuple, sr.read_report(spark, str(tmp_path)).collect())) == before


def test_feed_reads_each_file_once(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / p) for p in ("in", "out", "cp"))
    schema = spark.range(1).schema
    for round_no in range(2):
        spark.range(round_no * 50, round_no * 50 + 50).repartition(4).write.mode("append").parquet(source)
        sf.stream_feed(spark, source, schema, out, checkpoint, max_files=3).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(100))


def test_the_report_calls_python_per_bucket_of_keys(spark, tmp_path):
    """Many keys of one bucket, NULL ones too, share one state row; later batches take back what the keys counted for."""
    from packloom.streaming import results as sr

    schema = "item_key string, seq bigint, name string, score double"
    rows = [[(f"k{i}" if i else None, 1, "ab"[i % 2], float(i)) for i in range(40)], [(f"k{i}" if i else None, 2, "a", None if i == 3 else 1.0) for i in range(0, 40, 3)] + [("k1", 0, "b", 99.0)]]
    source, seen = str(tmp_path / "in"), []
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        changes = sr.score_changes(sr.read_stream(spark, source, spark.createDataFrame([], schema).schema), buckets=2)
        out = changes.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
        out.foreachBatch(lambda df, _: seen.extend(map(tuple, df.collect()))).start().awaitTermination()
    latest = {}
    for part in rows:
        for k, s, n, x in part:
            latest[k] = max(latest.get(k, (-1,)), (s, n, x), key=lambda r: r[0])
    for name in "ab":
        mine = [x for _, n, x in latest.values() if n == name]
        got = [r for r in seen if r[0] == name]
        assert (float(sum(r[1] for r in got)), sum(r[2] for r in got), sum(r[3] for r in got)) == (sum(x or 0 for x in mine), sum(x is not None for x in mine), len(mine))
    state = spark.read.format("statestore").load(str(tmp_path / "c"))
    assert state.count() == 2
