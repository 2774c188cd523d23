"""Reader and writer queries: the given tables out to files and back."""

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators import evaluation as ev
from ..plans.export import export
from ..session import work_folder
from ..sources import files as fi
from ..sources import records as rc
from ..sources import reports as rp
from .cleaning import EXPORT, EXPORTED
from .core import query
from .evaluation import REPORT, STEPS, scored

FIELDS = ["instruction", "reasoning", "rules", "original_image_path", "edited_image_path"]


def _texts(columns) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


@query("read_records", f"SELECT {', '.join(FIELDS)} FROM samples", "samples")
def _(t):
    path = work_folder(t.spark, "records")
    t["samples"].select(*FIELDS).write.json(path)
    return rc.read_records(t.spark, path)


def _round_trip(t, fmt: str):
    path = f"{work_folder(t.spark, 'table')}.{fmt}"
    rows = t["samples"].select(F.col("sample_id").cast("string").alias("sample_id"), "instruction", "reasoning")
    rc.write_table(rows, path)
    return rc.read_table(t.spark, path, _texts(["sample_id", "instruction", "reasoning"]))


TEXTS = "SELECT cast(sample_id AS string) AS sample_id, {} AS instruction, reasoning FROM samples"


# A quoted empty field and a missing one look alike in CSV: both read as missing.
@query("table_csv", TEXTS.format("nullif(instruction, '')"), "samples")
def _(t):
    return _round_trip(t, "csv")


@query("table_tsv", TEXTS.format("nullif(instruction, '')"), "samples")
def _(t):
    return _round_trip(t, "tsv")


@query("table_jsonl", TEXTS.format("instruction"), "samples")
def _(t):
    return _round_trip(t, "jsonl")


@query("list_files")
def _(t):
    return fi.list_files(t.spark, [t.folder]).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


@query("file_manifest")
def _(t):
    return fi.file_manifest(t.spark, t.folder)


@query("read_parquet_dirs", "SELECT doc_id, lang, text FROM documents UNION ALL SELECT page_id, 'page', html FROM pages")
def _(t):
    root = work_folder(t.spark, "dirs")
    t["documents"].select("doc_id", "lang", "text").write.parquet(f"{root}/a")
    t["pages"].select(F.col("page_id").alias("doc_id"), F.lit("page").alias("lang"), F.col("html").alias("text")).write.parquet(f"{root}/b")
    return fi.read_parquet_dirs(t.spark, [f"{root}/a", f"{root}/b"])


@query(
    "lost_files",
    """SELECT 'cut_off' AS reason, 1::bigint AS n_files, count(*)::bigint AS n_rows FROM documents WHERE lang = 'de'
UNION ALL SELECT 'no_rows', 2, NULL""",
)
def _(t):
    """One folder per language; the read loses the German file whole, and two files hold no row at all."""
    root = work_folder(t.spark, "lost")
    docs = t["documents"].select("doc_id", "lang", "text")
    # Only the German file has to be one, as the read loses one file; the other rows are written
    # by the tasks that read them.
    german = F.col("lang") == "de"
    docs.where(~german | F.col("lang").isNull()).write.partitionBy("lang").parquet(f"{root}/in")
    docs.where(german).repartition(1).write.mode("append").partitionBy("lang").parquet(f"{root}/in")
    languages = [r.lang for r in docs.select("lang").distinct().collect()]
    dirs = [f"{root}/in/lang={lang}" for lang in languages] + [f"{root}/none", f"{root}/nothing"]
    for empty in dirs[-2:]:
        docs.select("doc_id", "text").where("false").coalesce(1).write.parquet(empty)
    read = fi.read_counted(t.spark, dirs, "doc_id bigint, text string").where(~F.col("path").contains("lang=de/"))
    report = fi.lost_report(fi.lost_files(t.spark, dirs, read, "doc_id bigint, text string"))
    return report.select("reason", "n_files", "n_rows")


@query("write_shards", "SELECT ntile(6) OVER (ORDER BY md5('42|' || cast(doc_id AS string)), doc_id) - 1 AS chunk, doc_id, text FROM documents")
def _(t):
    path = work_folder(t.spark, "shards")
    fi.write_shards(t["documents"].select("doc_id", "text"), path, 6, "doc_id")
    return t.spark.read.parquet(path).select(F.col("chunk").cast("bigint").alias("chunk"), "doc_id", "text")


@query("shard_manifest", "SELECT chunk, count(*) AS num_rows, 1::bigint AS num_row_groups FROM (SELECT ntile(6) OVER (ORDER BY doc_id) - 1 AS chunk FROM documents) GROUP BY chunk")
def _(t):
    path = work_folder(t.spark, "shards")
    fi.write_shards(t["documents"].select("doc_id", "lang"), path, 6, "doc_id")
    chunk = F.regexp_extract("path", r"chunk=(\d+)", 1).cast("bigint")
    return fi.shard_manifest(t.spark, path).select(chunk.alias("chunk"), "num_rows", "num_row_groups")


@query("write_json", "SELECT doc_id, text, CASE WHEN lang = 'fr' THEN NULL ELSE lang END AS lang FROM documents")
def _(t):
    path = work_folder(t.spark, "json")
    rows = t["documents"].select("doc_id", "text", F.when(F.col("lang") != "fr", F.col("lang")).alias("lang"), F.col("doc_id").alias("input_pos"))
    rc.write_json(rows, path)
    return t.spark.read.schema("doc_id bigint, text string, lang string").json(path)


@query(
    "export_shards",
    f"SELECT * EXCLUDE (sample_id) FROM ({EXPORTED})",
    "samples image_files",
    EXPORT,
)
def _(t):
    root = work_folder(t.spark, "export")
    t["samples"].select(*FIELDS).write.json(f"{root}/source")
    export(t.spark, f"{root}/source", "data", f"{root}/out", t["image_files"], n_chunks=5)
    return t.spark.read.parquet(f"{root}/out/shards").select(*rc.EXPORT_COLUMNS)


@query("write_report", f"SELECT metric, score_origin, score_percentage, accuracy FROM ({REPORT})", "items judgements", STEPS)
def _(t):
    path = work_folder(t.spark, "report")
    rp.write_report(ev.report(scored(t)), path)
    back = t.spark.read.csv(path, header=True, schema="metric string, score_origin double, score_percentage double, accuracy double")
    return back.select("metric", *[F.round(c, 6).alias(c) for c in ("score_origin", "score_percentage", "accuracy")])


@query(
    "by_name_map",
    """SELECT name, unnest(generate_series(0, 2)) AS slot, round(unnest([avg(score), 25 * (avg(score) - 1), avg(complete)]), 6) AS value
FROM scored WHERE name IS NOT NULL GROUP BY name""",
    "items judgements",
    STEPS,
)
def _(t):
    one = rp.by_name_map(ev.by_name(scored(t)))
    entries = one.select(F.explode(F.from_json("value", "map<string,array<double>>")).alias("name", "values"))
    return entries.select("name", F.posexplode("values").alias("slot", "value")).select(
        "name", F.col("slot").cast("bigint").alias("slot"), F.round("value", 6).alias("value")
    )
