"""Files in, files out."""

import gzip
import hashlib
import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from packloom.operators import registry as rg
from packloom.plans.export import export
from packloom.sources import files as fi
from packloom.sources import records as rc
from packloom.sources import reports as rp

RECORDS = [
    {"instruction": " do ", "reasoning": "why", "rules": " r ", "original_image_path": "b/1.png", "edited_image_path": "a/1.png"},
    {"instruction": "é \"q\"", "reasoning": " x\ny ", "original_image_path": "b/2.png", "edited_image_path": "a/2.png"},
    {"instruction": "", "reasoning": "why", "original_image_path": "b/3.png", "edited_image_path": "a/3.png"},
    {"instruction": "i", "reasoning": "r", "rules": None, "original_image_path": "b/4.png", "edited_image_path": "a/4.png"},
]


def as_rows(df):
    return [tuple(r) for r in df.collect()]


def test_array_lines_and_blank_lines_read_alike(spark, tmp_path):
    (tmp_path / "array.json").write_text(" \n\n" + json.dumps(RECORDS, indent=2, ensure_ascii=False))
    (tmp_path / "lines.json").write_text("\n\n" + "\n \n".join(json.dumps(r) for r in RECORDS) + "\n\n")
    array = rc.read_records(spark, str(tmp_path / "array.json"))
    lines = rc.read_records(spark, str(tmp_path / "lines.json")).filter("instruction IS NOT NULL")
    assert as_rows(array) == as_rows(lines) and array.count() == 4
    assert rc.is_json_array(spark, str(tmp_path / "array.json")) and not rc.is_json_array(spark, str(tmp_path / "lines.json"))


def test_a_folder_of_arrays_and_lines_loses_no_row(spark, tmp_path):
    (tmp_path / "a.json").write_text(" " * 3000 + json.dumps(RECORDS[:2]))
    (tmp_path / "b.json").write_text("\n".join(json.dumps(r) for r in RECORDS))
    (tmp_path / "d.json.gz").write_bytes(gzip.compress(json.dumps(RECORDS[2:]).encode()))
    (tmp_path / "c.json").write_text("")
    found = rc.read_records(spark, str(tmp_path)).filter("original_image_path IS NOT NULL")
    assert sorted(r.original_image_path for r in found.collect()) == sorted(r["original_image_path"] for r in RECORDS * 2)


def test_user_code_sees_whole_numbers_beside_nulls(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(big, 5), (2, None)], "k bigint, n bigint").coalesce(1)
    schema = StructType([StructField("seen", StringType())])
    assert {(r.k, r.seen, r.error) for r in rg.map_items(df, lambda row: {"seen": repr(row["n"])}, "k", schema).collect()} == {(big, "5", None), (2, "None", None)}
    rows = rg.rows_to_segments(df, lambda row: [{"k": row["k"], "n": row["n"]}], df.schema)
    assert {tuple(r) for r in rows.collect()} == {(big, 5), (2, None)}


def test_bad_rows_are_kept_apart(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text(json.dumps(RECORDS[0]) + "\n{broken\n")
    df = rc.read_records(spark, str(tmp_path / "x.jsonl"), bad_rows="bad").cache()
    assert sorted(r.bad is None for r in df.collect()) == [False, True]


def test_tables_keep_quotes_breaks_and_blanks(spark, tmp_path):
    rows = [(1, 'a "q", b'), (2, "line\nbreak"), (3, "  pad "), (4, "ü\t;")]
    df = spark.createDataFrame(rows, "i int, t string")
    for fmt in ("csv", "tsv", "jsonl", "json"):
        path = str(tmp_path / f"t.{fmt}")
        rc.write_table(df, path)
        back = rc.read_table(spark, path, df.schema)
        assert sorted(as_rows(back)) == rows
    text = "".join(p.read_text() for p in (tmp_path / "t.csv").glob("part-*"))
    assert '"1","a ""q"", b"' in text and text.startswith('"i","t"')
    with pytest.raises(ValueError):
        rc.write_table(df, str(tmp_path / "t.xyz"))


def test_json_keeps_input_order_and_text(spark, tmp_path):
    df = spark.range(500).select(F.col("id").alias("input_pos"), F.concat(F.lit("é"), F.col("id").cast("string")).alias("v")).repartition(7)
    rc.write_json(df, str(tmp_path / "j"))
    lines = [l for p in sorted((tmp_path / "j").glob("part-*")) for l in p.read_text().splitlines()]
    assert lines == [json.dumps({"v": f"é{i}"}, ensure_ascii=False, separators=(",", ":")) for i in range(500)]


@pytest.mark.parametrize("n_rows,n", [(10, 3), (2, 4)])
def test_exactly_n_shards_with_a_manifest(spark, tmp_path, n_rows, n):
    path = str(tmp_path / "s")
    fi.write_shards(spark.range(n_rows), path, n, "id", seed=1)
    manifest = fi.shard_manifest(spark, path, tasks=2).collect()
    base, extra = divmod(n_rows, n)
    assert sorted((r.num_rows for r in manifest), reverse=True) == [base + (i < extra) for i in range(n)]
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(n_rows))


def test_corrupt_files_are_skipped_missing_folders_are_not(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "a"))
    (tmp_path / "a" / "broken.parquet").write_bytes(b"PAR1 no such thing")
    assert fi.read_parquet_dirs(spark, [str(tmp_path / "a")], "id bigint").count() == 5
    with pytest.raises(Exception):
        fi.read_parquet_dirs(spark, [str(tmp_path / "a")], "id bigint", skip_corrupt=False).count()
    with pytest.raises(Exception):
        fi.read_parquet_dirs(spark, [str(tmp_path / "missing")], "id bigint").count()


def test_export_end_to_end(spark, tmp_path):
    for name in ("b/1.png", "a/1.png", "b/2.png", "a/2.png", "b/3.png", "a/3.png", "b/4.png"):
        os.makedirs(tmp_path / "data" / name.split("/")[0], exist_ok=True)
        (tmp_path / "data" / name).write_bytes(b"x")
    (tmp_path / "in.json").write_text(json.dumps(RECORDS))
    base, out = str(tmp_path / "data"), str(tmp_path / "out")
    counts = export(spark, str(tmp_path / "in.json"), base, out, fi.file_manifest(spark, base), n_chunks=2)
    assert {r.reason: r.n_rows for r in counts.collect()} == {"kept": 2, "missing_fields": 1, "missing_images": 1}
    lines = [json.loads(l) for p in sorted((tmp_path / "out" / "json").glob("part-*")) for l in p.read_text().splitlines()]
    assert [l["instruction"] for l in lines] == ["do", 'é "q"']
    assert lines[1] == {
        "before_image_path": f"{base}/b/2.png", "after_image_path": f"{base}/a/2.png", "instruction": 'é "q"', "reasoning": "x\ny", "rules": ""
    }
    shards = spark.read.parquet(f"{out}/shards")
    assert shards.columns == [*rc.EXPORT_COLUMNS, "chunk"] and shards.count() == 2
    manifest = spark.read.json(f"{out}/manifest").collect()
    assert sorted(r.num_rows for r in manifest) == [1, 1]


def test_export_counts_parse_failures_and_may_skip_the_file_test(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text("\n".join([json.dumps(RECORDS[0]), "{broken", "", json.dumps(RECORDS[2])]))
    counts = export(spark, str(tmp_path / "in.jsonl"), "/data", str(tmp_path / "out"), n_chunks=2)
    assert {r.reason: r.n_rows for r in counts.collect()} == {"kept": 1, "parse_failures": 1, "missing_fields": 1}


def test_report_file(spark, tmp_path):
    rows = [(4, "Class-x", 2.5, 37.5, 0.5), (0, "Overall", 3.0, 50.0, 1.0), (1, "Overall_Reasoning", 3.0, 50.0, None)]
    report = spark.createDataFrame(rows, "ordinal bigint, metric string, score_origin double, score_percentage double, accuracy double")
    rp.write_report(report, str(tmp_path / "r"))
    text = next((tmp_path / "r").glob("part-*")).read_text().splitlines()
    assert text == ["-,Score-Origin,Score-Percentage,Accuracy", "Overall,3.0,50.0,1.0", "Overall_Reasoning,3.0,50.0,", "Class-x,2.5,37.5,0.5"]


def test_config_groups():
    groups = rg.read_config(
        {
            "edit": {"dataset_names": ["d"], "weight": 1, "is_mandatory": True, "num_used_data": [8],
                     "image_transform_args": {"image_stride": 16, "max_image_size": 1024, "min_image_size": 512}},
            "chat": {"dataset_names": ["c"], "frame_sampler_args": {"max_num_frames": 12}, "shuffle_lines": True,
                     "image_transform_args": {"image_stride": 14, "max_image_size": 980, "min_image_size": 378, "max_pixels": 2007040}},
        }
    )
    from packloom.functions.geometry import CHAT_VIT, TRAIN_VAE

    assert groups[0].image == TRAIN_VAE and groups[0].is_mandatory and groups[0].weight == 1.0
    assert groups[1].image == CHAT_VIT and groups[1].frames.max_num_frames == 12 and groups[1].weight == 0.0
    with pytest.raises(ValueError):
        rg.read_config({"x": {}})
    with pytest.raises(KeyError):
        rg.build_source("nobody", None)


def test_workers_find_the_package_from_another_folder(tmp_path):
    code = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "from packloom.session import local_session\n"
        "from packloom.functions import text\n"
        "spark = local_session(1)\n"
        "def run(batches):\n"
        "    import packloom.operators.packing\n"
        "    yield from batches\n"
        "print('rows', spark.range(3).mapInArrow(run, 'id bigint').count())\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code, root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "rows 3" in done.stdout, done.stderr[-2000:]


@pytest.mark.parametrize("keys", ["id", "cast(id % 5 as string)", "cast('x' as string)"])
def test_every_shard_is_one_task_and_rows_move_once(spark, tmp_path, monkeypatch, keys):
    """Shards are those of ranking whole rows; only keys are ranked unless a shard begins between equal keys."""
    ranked = []
    monkeypatch.setattr(fi, "even_chunks", lambda df, *a, _of=fi.even_chunks, **k: ranked.append(df.columns) or _of(df, *a, **k))
    df = spark.range(1000).select(F.expr(keys).alias("k"), F.repeat(F.lit("x"), 50).alias("text"))
    fi.write_shards(df, str(tmp_path / "s"), 6, "k", seed=3)
    back = spark.read.parquet(str(tmp_path / "s"))
    sizes = {r.chunk: r["count"] for r in back.groupBy("chunk").count().collect()}
    assert [sizes[i] for i in range(6)] == [167] * 4 + [166] * 2
    assert ranked == [["k"]] if keys == "id" else ranked == [["k"], ["k", "text"]]
    want = fi.even_chunks(df, "k", 6, 3)
    assert sorted((r.chunk, r.k) for r in back.collect()) == sorted((r.chunk, r.k) for r in want.collect())
    for i in range(6):
        assert len(list((tmp_path / "s" / f"chunk={i}").glob("*.parquet"))) == 1
    rows = fi._chunked(spark.range(1000), "id", 6, 3)
    tasks = rows.repartitionById(6, F.col("chunk").cast("int")).groupBy(F.spark_partition_id().alias("task")).agg(F.countDistinct("chunk").alias("n")).collect()
    assert [r.n for r in tasks] == [1] * 6


def test_staged_files_are_written_by_the_tasks_that_read(spark, tmp_path, monkeypatch):
    """read_records deals its rows to no fixed number of files; lost_files brings only the German rows to one task."""
    from packloom.catalog import QUERIES, Tables

    d = tmp_path / "in"
    rows = [(i, "text " * 20, ["en", "de", "fr"][i % 3], "s", 100) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.repartition(12).write.parquet(str(d / "documents.parquet"))
    dealt = []
    real = type(docs).repartition
    monkeypatch.setattr(type(docs), "repartition", lambda df, *a: dealt.append((a, df.count())) or real(df, *a))
    assert QUERIES["read_records"](Tables(spark, str(d))).count() == 300
    assert dealt == []
    got = {r.reason: (r.n_files, r.n_rows) for r in QUERIES["lost_files"](Tables(spark, str(d))).collect()}
    assert got == {"cut_off": (1, 100), "no_rows": (2, None)}
    assert dealt == [((1,), 100)]


def test_export_moves_texts_into_their_order_and_shards_only(spark, tmp_path):
    """Equal rows, missing files on either side and rows without texts; texts may not travel through the file joins."""
    text = lambda i: hashlib.sha512(str(i).encode()).hexdigest() * 20
    n = 400
    rows = [
        {"instruction": text(i // 2) if i % 7 else "", "reasoning": "r", "rules": None, "original_image_path": f"b/{i // 2 % 50}.png", "edited_image_path": f"a/{i // 2 % 60}.png"}
        for i in range(n)
    ]
    for part in range(4):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{part}.jsonl").write_text("\n".join(json.dumps(r) for r in rows[part * 100 : part * 100 + 100]))
    files = [f"d/b/{i}.png" for i in range(50) if i % 5] + [f"d/a/{i}.png" for i in range(60) if i % 4]
    manifest = spark.createDataFrame([(f,) for f in files], "path string")
    wanted = [r for r in rows if r["instruction"] and "d/" + r["original_image_path"] in files and "d/" + r["edited_image_path"] in files]
    out = str(tmp_path / "out")
    before = spark.conf.get("spark.sql.files.minPartitionNum", None)
    counts = {r.reason: r.n_rows for r in export(spark, str(tmp_path / "in"), "d", out, manifest, n_chunks=3).collect()}
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) == before
    assert counts["kept"] == len(wanted) and sum(counts.values()) == n
    lines = [json.loads(line) for p in sorted((tmp_path / "out" / "json").glob("part-*")) for line in p.read_text().splitlines()]
    assert [line["instruction"] for line in lines] == [r["instruction"] for r in wanted]
    shards = spark.read.parquet(f"{out}/shards").collect()
    assert sorted(r.instruction for r in shards) == sorted(r["instruction"] for r in wanted)
    sizes = [sum(r.chunk == i for r in shards) for i in range(3)]
    assert max(sizes) - min(sizes) <= 1
    assert spark.read.parquet(f"{out}/staged").columns == ["input_pos", "reason"]


def test_shards_leave_out_skipped_keys(spark, tmp_path):
    rows = spark.range(1000).selectExpr("CAST(id AS STRING) AS k", "id AS n")
    gone = rows.where("n % 3 = 0").select("k")
    plain = rows.where("n % 3 <> 0")
    for n in (4, 300):
        fi.write_shards(rows, str(tmp_path / f"a{n}"), n, "k", 5, skipped=gone)
        fi.write_shards(plain, str(tmp_path / f"b{n}"), n, "k", 5)
        one, two = (sorted(map(tuple, spark.read.parquet(str(tmp_path / f"{x}{n}")).collect())) for x in "ab")
        assert one == two and len(one) == 666
    marks = fi.marked(rows, gone, "k").withColumn("chunk", F.expr("CAST(n % 4 AS INT)")).repartitionById(4, F.col("chunk"))
    plan = fi.unmarked(marks, "chunk", "k")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
