"""Judge results to item scores and reports. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as sc

ANSWERS = ("judge1", "judge2", "judge3")
DIMENSIONS = ("appr_consistency", "reasoning", "visual_plausibility")  # scored from judge1..3

# Types that a hash aggregate updates in place.
FIXED_WIDTH = {"boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz"}


def parse_answers(judgements: DataFrame) -> DataFrame:
    """Replace the three answer texts by their scores.

    Done before any shuffle, so later joins carry three numbers instead of three texts.
    """
    scored = {dim: sc.first_score(F.col(a)) for dim, a in zip(DIMENSIONS, ANSWERS)}
    return judgements.withColumns(scored).drop(*ANSWERS)


def latest_judgements(df: DataFrame, key: str = "item_key", seq: str = "seq") -> DataFrame:
    """One row per key, the one with the highest ``seq``.

    ``max_by`` combines before the shuffle, so a key with very many attempts is no hot spot.
    Columns of fixed width are each picked by hash, all from the same row since every
    aggregate meets the rows in the same order; with a text among them one struct is picked
    after a sort. Equal ``seq``: one of the rows, whole.
    """
    rest = [c for c in df.columns if c not in (key, seq)]
    if all(kind in FIXED_WIDTH for name, kind in df.dtypes if name in (*rest, seq)):
        picked = [F.max_by(c, seq).alias(c) for c in rest]
        return df.groupBy(key).agg(F.max(seq).alias(seq), *picked)
    best = F.max_by(F.struct(*rest, seq), F.col(seq)).alias("_best")
    return df.groupBy(key).agg(best).select(key, *[F.col(f"_best.{c}").alias(c) for c in [seq, *rest]])


def error_rows(items: DataFrame, manifest: DataFrame, output: str = "output_path", reference: str = "reference_path") -> DataFrame:
    """Failure rows for items whose output or reference image is missing.

    Empty answers plus an error text; the reference image is looked at first.
    """
    from .clean import file_flags

    flagged = file_flags(items, manifest, [output, reference])
    error = F.when(
        ~F.col(f"{reference}_exists"), F.concat(F.lit("Image not found: "), F.col(reference))
    ).when(~F.col(f"{output}_exists"), F.concat(F.lit("Cannot find edited image at: "), F.col(output)))
    return (
        flagged.withColumn("error", error)
        .filter(F.col("error").isNotNull())
        .select("item_key", *[F.lit("").alias(a) for a in ANSWERS], "error")
    )


def attach_judgements(items: DataFrame, judgements: DataFrame, key: str = "item_key") -> DataFrame:
    """Every item with its judgement; an item without one gets NULLs."""
    clash = [c for c in judgements.columns if c in items.columns and c != key]
    return items.join(judgements.drop(*clash), key, "left")


def gate_scores(df: DataFrame) -> DataFrame:
    """All three dimensions or none: one unreadable answer voids the other two."""
    whole = F.lit(True)
    for dim in DIMENSIONS:
        whole = whole & F.col(dim).isNotNull()
    df = df.withColumn("_whole", whole)
    df = df.withColumns({dim: F.when(F.col("_whole"), F.col(dim)) for dim in DIMENSIONS})
    return df.withColumn("match_log", F.when(F.col("_whole"), "succeed").otherwise("failed")).drop("_whole")


def score_items(df: DataFrame) -> DataFrame:
    """Add the weighted score and the completion flag to gated rows."""
    dims = [F.col(d) for d in DIMENSIONS]
    return df.withColumn("score", sc.weighted_score(*dims)).withColumn("complete", sc.complete(*dims))


def scored_items(items: DataFrame, judgements: DataFrame, key: str = "item_key", seq: str = "seq") -> DataFrame:
    """Items joined to their latest judgement, gated and scored.

    Only the key, the order and the three scores of a judgement take part in the shuffle.
    """
    scores = parse_answers(judgements.select(key, seq, *ANSWERS))
    return score_items(gate_scores(attach_judgements(items, latest_judgements(scores, key, seq), key)))


def overall(df: DataFrame) -> DataFrame:
    """Five means over all items; NULLs are skipped."""
    return df.agg(*[F.avg(c).alias(c) for c in ("score", "complete", "reasoning", "appr_consistency", "visual_plausibility")])


def by_name(df: DataFrame) -> DataFrame:
    """Mean score, its percentage and completion per name; NULL names are dropped."""
    return (
        df.filter(F.col("name").isNotNull())
        .groupBy("name")
        .agg(F.avg("score").alias("score"), F.avg("complete").alias("complete"))
        .withColumn("percent", sc.to_percent(F.col("score")))
        .select("name", "score", "percent", "complete")
    )


def report(df: DataFrame) -> DataFrame:
    """Overall rows and one row per class, in report order (``ordinal``, then metric).

    Sums per name come first, so the grouping sets (), (name) expand one row per name and
    not one per item. ``grouping_id`` keeps the total apart from NULL names, which count
    in the total but get no class row.
    """
    measures = ("score", "complete", "reasoning", "appr_consistency", "visual_plausibility")
    sums = df.groupBy("name").agg(
        *[F.sum(c).cast("double").alias(f"_sum_{c}") for c in measures], *[F.count(c).alias(f"_n_{c}") for c in measures]
    )
    means = (
        sums.groupingSets([[], [F.col("name")]], F.col("name"))
        .agg(
            F.grouping_id().alias("_total"),
            *[F.try_divide(F.sum(f"_sum_{c}"), F.sum(f"_n_{c}")).alias(c) for c in measures],
        )
        .filter((F.col("_total") == 1) | F.col("name").isNotNull())
    )

    def line(metric, score, accuracy, ordinal):
        return F.struct(
            F.lit(ordinal).cast("bigint").alias("ordinal"),
            metric.alias("metric"),
            score.alias("score_origin"),
            accuracy.cast("double").alias("accuracy"),
        )

    none = F.lit(None)
    totals = F.array(
        line(F.lit("Overall"), F.col("score"), F.col("complete"), 0),
        line(F.lit("Overall_Reasoning"), F.col("reasoning"), none, 1),
        line(F.lit("Overall_ApprConsistency"), F.col("appr_consistency"), none, 2),
        line(F.lit("Overall_VisualPlausibility"), F.col("visual_plausibility"), none, 3),
    )
    classes = F.array(line(F.concat(F.lit("Class-"), F.col("name")), F.col("score"), F.col("complete"), 4))
    lines = means.select(F.inline(F.when(F.col("_total") == 1, totals).otherwise(classes)))
    return lines.select(
        "ordinal", "metric", "score_origin", sc.to_percent(F.col("score_origin")).alias("score_percentage"), "accuracy"
    ).orderBy("ordinal", "metric")


def match_report(df: DataFrame) -> DataFrame:
    return df.groupBy("name", "match_log").agg(F.count(F.lit(1)).alias("n_items"))


def duplicate_keys(items: DataFrame, key: str = "item_key") -> DataFrame:
    """Keys used by more than one item; such items share one judgement."""
    return items.groupBy(key).agg(F.count(F.lit(1)).alias("n_items")).filter("n_items > 1")
