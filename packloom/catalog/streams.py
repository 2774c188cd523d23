"""Streaming queries: files of the given tables taken in batch by batch."""

from pyspark.sql import functions as F

from ..operators import registry as rg
from ..operators import segments as sg
from ..session import work_folder
from ..streaming import feed as sf
from ..streaming import results as sr
from .cleaning import duck_strip
from .core import query
from .segments import EDITS, SHOWN, _edit_sql

STAGED_FILES = 6
LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY event_id DESC) AS rn FROM result_stream) WHERE rn = 1"


def _staged_results(t):
    """(folder, schema): the results as files that the stream takes in batch by batch."""
    root = work_folder(t.spark, "results")
    rows = t["result_stream"].select("item_key", "name", F.col("event_id").alias("seq"), "score")
    rows.repartition(STAGED_FILES).write.parquet(f"{root}/in")
    return root, rows.schema


@query("stream_results", f"SELECT item_key, name, event_id AS seq, score FROM ({LATEST})", "result_stream")
def _(t):
    root, schema = _staged_results(t)
    sr.stream_results(t.spark, f"{root}/in", schema, f"{root}/checkpoint", max_files=2).awaitTermination()
    return sr.read_results(t.spark, f"{root}/checkpoint", schema)


@query("stream_report", f"SELECT name, round(avg(score), 6) AS score, count(score) AS n_scored FROM ({LATEST}) GROUP BY name", "result_stream")
def _(t):
    root, schema = _staged_results(t)
    sr.stream_report(t.spark, f"{root}/in", schema, f"{root}/report", f"{root}/checkpoint", max_files=2).awaitTermination()
    return sr.read_report(t.spark, f"{root}/report").withColumn("score", F.round("score", 6))


# Keys that change their name and score: the name is that of the event, the key the user's.
MOVING = """SELECT * FROM (SELECT 'user#' || cast(user_id AS string) AS item_key, event_id AS seq, CASE WHEN user_id % 7 = 0 AND event_id % 3 = 0 THEN NULL ELSE event_type END AS name,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE round(value, 2) END AS score FROM events) e"""


@query(
    "stream_report_moving",
    f"""SELECT name, round(avg(score), 6) AS score, count(score) AS n_scored FROM
  (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY seq DESC) AS rn FROM ({MOVING}) m) WHERE rn = 1 AND name IS NOT NULL GROUP BY name""",
)
def _(t):
    root = work_folder(t.spark, "moving")
    rows = t.sql(MOVING, "events")
    rows.repartition(STAGED_FILES).write.parquet(f"{root}/in")
    sr.stream_report(t.spark, f"{root}/in", rows.schema, f"{root}/report", f"{root}/checkpoint", max_files=2).awaitTermination()
    return sr.read_report(t.spark, f"{root}/report").withColumn("score", F.round("score", 6))


@query("stream_feed", "SELECT sample_id, source, n_tokens + 2 AS length FROM feed", "feed")
def _(t):
    root = work_folder(t.spark, "feed")
    rows = t["feed"].select("sample_id", "source", "n_tokens")
    rows.repartition(STAGED_FILES).write.parquet(f"{root}/in")
    lengths = lambda df: df.select("sample_id", "source", (F.col("n_tokens") + 2).alias("length"))
    sf.stream_feed(t.spark, f"{root}/in", rows.schema, f"{root}/out", f"{root}/checkpoint", lengths, max_files=2).awaitTermination()
    return t.spark.read.parquet(f"{root}/out")


@query(
    "stream_progress",
    "SELECT source, rg_idx, row_idx FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rg_idx DESC, row_idx DESC) AS rn FROM feed) WHERE rn = 1",
    "feed",
)
def _(t):
    root = work_folder(t.spark, "progress")
    rows = t["feed"].select("source", "rg_idx", "row_idx")
    rows.repartition(STAGED_FILES).write.parquet(f"{root}/in")
    ledger = sf.stream_progress(sf.read_feed(t.spark, f"{root}/in", rows.schema, 2), ["source"], ["rg_idx", "row_idx"])
    sf.write_progress(ledger, f"{root}/out", f"{root}/checkpoint", ["source"]).awaitTermination()
    return sf.read_progress(t.spark, f"{root}/out", ["source"], ["rg_idx", "row_idx"])


@query("registered_source", _edit_sql(r"regexp_replace(instruction, '\s+$', '')", duck_strip("reasoning")), "samples", {"edits": EDITS})
def _(t):
    rg.register_source("plain_edit", lambda df, keys: sg.edit_segments(df, keys, style="plain"))
    return rg.build_source("plain_edit", t.sql(EDITS, "samples"), keys=["sample_id"]).select(*SHOWN)


@query(
    "map_items",
    """SELECT item_key, CASE WHEN reference_effect IS NULL THEN '' ELSE 'seen ' || cast(length(reference_effect) AS string) END AS judge1,
  CASE WHEN reference_effect IS NULL THEN 'ValueError(''no reference'')' END AS error FROM items""",
    "items",
)
def _(t):
    from pyspark.sql.types import StringType, StructField, StructType

    def judge(item: dict) -> dict:
        if item["reference_effect"] is None:
            raise ValueError("no reference")
        return {"judge1": f"seen {len(item['reference_effect'])}"}

    schema = StructType([StructField("judge1", StringType())])
    return rg.map_items(t["items"].select("item_key", "reference_effect"), judge, "item_key", schema)


@query("rows_to_segments", "SELECT doc_id, unnest(generate_series(0, length(source)::bigint - 1)) AS seg_pos FROM documents WHERE lang <> 'de'")
def _(t):
    from pyspark.sql.types import LongType, StructField, StructType

    def parse(row: dict) -> list[dict]:
        if row["lang"] == "de":
            raise ValueError("unreadable row")
        return [{"doc_id": row["doc_id"], "seg_pos": i} for i in range(len(row["source"]))]

    schema = StructType([StructField("doc_id", LongType()), StructField("seg_pos", LongType())])
    return rg.rows_to_segments(t["documents"].select("doc_id", "lang", "source"), parse, schema)
