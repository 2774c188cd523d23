"""Evaluation and leaderboard queries."""

from pyspark.sql import functions as F

from ..functions import scores as sc
from ..operators import evaluation as ev
from ..operators import leaderboard as lb
from ..operators.sampling import pending
from .core import Tables, query


def _duck_score(c: str) -> str:
    def number(label):
        groups = rf"regexp_extract_all({c}, '(?i)\*?\*?{label}\*?\*?:?\s*([\d*\s,\n]*)', 1)"
        return rf"try_cast(regexp_extract(list_filter({groups}, lambda x: regexp_matches(x, '\d'))[1], '\d+') AS bigint)"

    return f"coalesce({number('Final Score')}, {number('Final Scores')})"


PARSED = f"""SELECT item_key, idx, seq, error, {_duck_score('judge1')} AS s1, {_duck_score('judge2')} AS s2, {_duck_score('judge3')} AS s3
FROM judgements"""
LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY seq DESC) AS rn FROM parsed) WHERE rn = 1"
SCORED = """SELECT item_key, idx, name, CASE WHEN ok THEN s1 END AS appr_consistency, CASE WHEN ok THEN s2 END AS reasoning,
  CASE WHEN ok THEN s3 END AS visual_plausibility, CASE WHEN ok THEN 'succeed' ELSE 'failed' END AS match_log,
  CASE WHEN ok THEN 0.3::double * s1 + 0.5::double * s2 + 0.2::double * s3 END AS score,
  CASE WHEN ok THEN CASE WHEN s1 = 5 AND s2 = 5 AND s3 = 5 THEN 1 ELSE 0 END END AS complete
FROM (SELECT i.item_key, i.idx, i.name, l.s1, l.s2, l.s3,
        l.s1 IS NOT NULL AND l.s2 IS NOT NULL AND l.s3 IS NOT NULL AS ok
      FROM items i LEFT JOIN latest l ON l.item_key = i.item_key)"""
STEPS = {"parsed": PARSED, "latest": LATEST, "scored": SCORED}


def scored(t: Tables):
    return ev.scored_items(t["items"], t["judgements"])


@query("first_score", f"SELECT item_key, seq, {_duck_score('judge1')} AS score FROM judgements", "judgements")
def _(t):
    return t["judgements"].select("item_key", "seq", sc.first_score(F.col("judge1")).alias("score"))


@query(
    "latest_judgements",
    "SELECT item_key, seq, judge1, judge2, judge3, error FROM "
    "(SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY seq DESC) AS rn FROM judgements) WHERE rn = 1",
    "judgements",
)
def _(t):
    return ev.latest_judgements(t["judgements"].drop("idx"))


@query(
    "error_rows",
    """SELECT i.item_key, '' AS judge1, '' AS judge2, '' AS judge3,
  CASE WHEN r.path IS NULL THEN 'Image not found: ' || i.reference_path ELSE 'Cannot find edited image at: ' || i.output_path END AS error
FROM items i LEFT JOIN (SELECT DISTINCT path FROM output_files) r ON r.path = i.reference_path
LEFT JOIN (SELECT DISTINCT path FROM output_files) o ON o.path = i.output_path
WHERE r.path IS NULL OR o.path IS NULL""",
    "items output_files",
)
def _(t):
    return ev.error_rows(t["items"], t["output_files"])


@query(
    "attach_judgements",
    "SELECT i.item_key, i.name, j.judge1, j.judge2, j.judge3, j.error FROM items i LEFT JOIN "
    "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY seq DESC) AS rn FROM judgements) WHERE rn = 1) j "
    "ON j.item_key = i.item_key",
    "items judgements",
)
def _(t):
    latest = ev.latest_judgements(t["judgements"])
    return ev.attach_judgements(t["items"], latest).select("item_key", "name", "judge1", "judge2", "judge3", "error")


@query(
    "scored_items",
    "SELECT item_key, appr_consistency, reasoning, visual_plausibility, match_log, round(score, 6) AS score, complete FROM scored",
    "items judgements",
    STEPS,
)
def _(t):
    return scored(t).select(
        "item_key", *ev.DIMENSIONS, "match_log", F.round("score", 6).alias("score"), "complete"
    )


@query(
    "overall",
    "SELECT round(avg(score), 6) AS score, round(avg(complete), 6) AS complete, round(avg(reasoning), 6) AS reasoning, "
    "round(avg(appr_consistency), 6) AS appr_consistency, round(avg(visual_plausibility), 6) AS visual_plausibility FROM scored",
    "items judgements",
    STEPS,
)
def _(t):
    means = ev.overall(scored(t))
    return means.select(*[F.round(c, 6).alias(c) for c in means.columns])


@query(
    "by_name",
    "SELECT name, round(avg(score), 6) AS score, round(25 * (avg(score) - 1), 6) AS percent, round(avg(complete), 6) AS complete "
    "FROM scored WHERE name IS NOT NULL GROUP BY name",
    "items judgements",
    STEPS,
)
def _(t):
    return ev.by_name(scored(t)).select("name", *[F.round(c, 6).alias(c) for c in ("score", "percent", "complete")])


REPORT = """
SELECT ordinal, metric, round(s, 6) AS score_origin, round(25 * (s - 1), 6) AS score_percentage, round(a, 6) AS accuracy FROM (
  SELECT 0::bigint AS ordinal, 'Overall' AS metric, avg(score) AS s, avg(complete) AS a FROM scored
  UNION ALL SELECT 1, 'Overall_Reasoning', avg(reasoning), NULL FROM scored
  UNION ALL SELECT 2, 'Overall_ApprConsistency', avg(appr_consistency), NULL FROM scored
  UNION ALL SELECT 3, 'Overall_VisualPlausibility', avg(visual_plausibility), NULL FROM scored
  UNION ALL SELECT 4, 'Class-' || name, avg(score), avg(complete) FROM scored WHERE name IS NOT NULL GROUP BY name)"""


@query("evaluation_report", REPORT, "items judgements", STEPS)
def evaluation_report(t):
    return ev.report(scored(t)).select(
        "ordinal", "metric", *[F.round(c, 6).alias(c) for c in ("score_origin", "score_percentage", "accuracy")]
    )


@query("match_report", "SELECT name, match_log, count(*) AS n_items FROM scored GROUP BY name, match_log", "items judgements", STEPS)
def _(t):
    return ev.match_report(scored(t))


@query(
    "pending_items",
    "SELECT item_key, idx FROM items WHERE item_key NOT IN (SELECT item_key FROM judgements)",
    "items judgements",
)
def _(t):
    return pending(t["items"], t["judgements"]).select("item_key", "idx")


@query(
    "pending_items_retry",
    "SELECT item_key, idx FROM items WHERE item_key NOT IN (SELECT item_key FROM judgements WHERE error IS NULL)",
    "items judgements",
)
def _(t):
    return pending(t["items"], t["judgements"], retry_errors=True).select("item_key", "idx")


@query(
    "duplicate_keys",
    "SELECT item_key, count(*) AS n_items FROM result_stream GROUP BY item_key HAVING count(*) > 1",
    "result_stream",
)
def _(t):
    return ev.duplicate_keys(t["result_stream"])


DUCK_UNITS = r"""SELECT *, CASE WHEN u_at > 0 AND value IS NOT NULL THEN
cast(cast(value * scale AS bigint) AS string) ELSE cell END AS plain
FROM (SELECT *, CASE WHEN trim(head) = '' THEN 0.0::double WHEN regexp_matches(trim(head), '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') THEN try_cast(trim(head) AS double) END AS value
  FROM (SELECT *, substr(cell, 1, u_at - 1) AS head FROM (
    SELECT *, CASE WHEN instr(cell, 'M') > 0 THEN instr(cell, 'M') ELSE instr(cell, 'B') END AS u_at,
      CASE WHEN instr(cell, 'M') > 0 THEN 1e6::double ELSE 1e9::double END AS scale FROM cells)))"""
DUCK_SHOWN = r"SELECT *, regexp_replace(plain, '</?[a-z][a-z0-9]*\b[^>]*>', '', 'gi') AS shown FROM units"
DUCK_KEYS = r"""SELECT page_id, cell, CASE WHEN digits = '' THEN 0.0::double ELSE try_cast(digits AS double) END AS as_number,
  lower(shown) AS as_string, lower(string_split(shown, ' ')[-1]) AS as_last
FROM (SELECT *, regexp_replace(shown, '[^-\d.]', '', 'g') AS digits FROM shown)"""
UNITS = {"units": DUCK_UNITS, "shown": DUCK_SHOWN, "keys": DUCK_KEYS}


@query("sort_keys", "SELECT page_id, as_number, md5(as_string) AS as_string, as_last FROM keys", "cells", UNITS)
def _(t):
    cell = F.col("cell")
    return t["cells"].select(
        "page_id",
        lb.sort_key(cell, "number").alias("as_number"),
        F.md5(lb.sort_key(cell, "string")).alias("as_string"),
        lb.sort_key(cell, "last").alias("as_last"),
    )


@query(
    "sort_rank",
    "SELECT page_id, row_number() OVER (ORDER BY coalesce(-as_number, 'inf'::double), page_id) - 1 AS sort_rank FROM keys",
    "cells",
    UNITS,
)
def _(t):
    return lb.sort_rank(t["cells"], "cell", "number", "page_id", descending=True).select("page_id", "sort_rank")


def _sorted_as(kind: str, descending: bool):
    return lambda t: lb.sort_rank(t["cells"], "cell", kind, "page_id", descending).select("page_id", "sort_rank")


for _kind, _sql, _down in (("string", "as_string", False), ("last", "as_last", True), ("raw", "cell", True)):
    query(
        f"sort_rank_{_kind}",
        f"SELECT page_id, row_number() OVER (ORDER BY {_sql}{' DESC' if _down else ''} NULLS LAST, page_id) - 1 AS sort_rank FROM keys",
        "cells",
        UNITS,
    )(_sorted_as(_kind, _down))


@query(
    "sort_dates",
    """SELECT event_id, coalesce(epoch_ms(try_cast(d AS timestamp)), 0) AS sort_key FROM (
  SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'not a date ' || event_type ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS d FROM events)""",
)
def _(t):
    cell = F.concat(
        F.lit("<i>"),
        F.when(F.col("event_id") % 6 == 0, F.concat(F.lit("not a date "), F.col("event_type"))).otherwise(
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
        ),
        F.lit("</i>"),
    )
    return lb.sort_by(t["events"].withColumn("cell", cell), "cell", "date", "event_id").select("event_id", "sort_key")


DATE_CELLS = ["yyyy/MM/dd", "M/d/yyyy HH:mm:ss", "MMMM d, yyyy", "d MMM yyyy HH:mm", "EEE, dd MMM yyyy HH:mm:ss 'GMT'", "yyyy-MM-dd'T'HH:mm:ss"]


@query(
    "sort_date_forms",
    """SELECT event_id, epoch_ms(CASE WHEN event_id % 6 IN (0, 2) THEN date_trunc('day', ts)::timestamp WHEN event_id % 6 = 3 THEN date_trunc('minute', ts)::timestamp
  ELSE date_trunc('second', ts)::timestamp END) AS sort_key FROM events""",
)
def _(t):
    cell = F.lit(None)
    for i, form in enumerate(DATE_CELLS):
        cell = F.when(F.col("event_id") % len(DATE_CELLS) == i, F.date_format("ts", form)).otherwise(cell)
    # In a tag, so that the M of a month is no unit.
    return lb.sort_by(t["events"].withColumn("cell", F.concat(F.lit("<i>"), cell, F.lit("</i>"))), "cell", "date", "event_id").select("event_id", "sort_key")


@query(
    "leaderboard",
    """SELECT model, round(s, 6) AS score, rank() OVER (ORDER BY s DESC) AS rank,
  rank() OVER (ORDER BY s DESC) <= 3 AS marked, model = 'src4' AS pinned
FROM (SELECT model, avg(score) AS s FROM model_scores GROUP BY model)""",
    "model_scores",
)
def _(t):
    return lb.leaderboard(t["model_scores"], pinned="src4").withColumn("score", F.round("score", 6))


@query(
    "format_scores",
    "SELECT model, CASE WHEN model = 'src4' THEN 'n/a' ELSE printf('%.1f', round(s, 1)) END AS shown "
    "FROM (SELECT model, avg(score) AS s FROM model_scores GROUP BY model)",
    "model_scores",
)
def _(t):
    means = t["model_scores"].groupBy("model").agg(F.avg("score").alias("s"))
    text = F.when(F.col("model") == "src4", "n/a").otherwise(F.col("s").cast("string"))
    return means.select("model", lb.fmt1(text).alias("shown"))


@query(
    "category_matrix",
    "SELECT model, " + ", ".join(f"round(avg(CASE WHEN category = '{c}' THEN score END), 6) AS {c}" for c in ("en", "de", "fr", "es"))
    + " FROM model_scores GROUP BY model",
    "model_scores",
)
def _(t):
    wide = lb.category_matrix(t["model_scores"], ["en", "de", "fr", "es"])
    return wide.select("model", *[F.round(c, 6).alias(c) for c in ("en", "de", "fr", "es")])


@query(
    "compare_answers",
    """SELECT d.doc_id, coalesce(b.text, '') AS first_answer, coalesce(cast(l.quality AS string), '') AS second_answer, '' AS third_answer
FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def _(t):
    answers = {
        "first_answer": t["benchmark"].select(F.col("item_id").alias("doc_id"), F.col("text").alias("response")),
        "second_answer": t["labels"].select("doc_id", F.col("quality").cast("string").alias("response")),
        "third_answer": None,
    }
    return lb.compare(t["documents"].select("doc_id"), answers, "doc_id")
