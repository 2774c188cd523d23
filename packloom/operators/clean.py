"""Row cleaning, file checks and judge request building."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as tx
from ..functions.draws import choice, uniform


def require_fields(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows where any of the texts is NULL or empty; blank-only text stays."""
    for c in cols:
        df = df.filter(F.length(c) > 0)
    return df


def file_flags(df: DataFrame, manifest: DataFrame, paths: Sequence[str], path: str = "path") -> DataFrame:
    """Add ``<col>_exists`` per path column by joining the file manifest.

    No hint: Spark broadcasts the manifest only while its measured size allows it.
    """
    known = manifest.select(F.col(path).alias("_path")).distinct()
    for c in paths:
        hit = known.select(F.col("_path").alias(f"_{c}"), F.lit(True).alias("_hit"))
        df = (
            df.join(hit, F.col(c) == F.col(f"_{c}"), "left")
            .withColumn(f"{c}_exists", F.coalesce("_hit", F.lit(False)))
            .drop("_hit", f"_{c}")
        )
    return df


def skip_reasons(
    df: DataFrame,
    manifest: DataFrame | None,
    required: Sequence[str],
    before: str,
    after: str,
    parsed_ok: str | None = None,
) -> DataFrame:
    """Keep every row and say why it would be skipped.

    ``reason`` is NULL, ``parse_failures``, ``missing_fields`` or ``missing_images``, the
    earlier test winning; ``missing_path`` is the missing file reported, the *before*
    image first. Without a manifest no file is looked for. The texts are tested before the
    files are joined, so they move with the paths only where the caller selects them.
    """
    lacking = ~tx.present(F.col(required[0]))
    for c in required[1:]:
        lacking = lacking | ~tx.present(F.col(c))
    df = df.withColumn("_lacking", lacking)
    if manifest is None:
        flagged = df.withColumns({f"{c}_exists": F.lit(True) for c in (before, after)})
    else:
        flagged = file_flags(df, manifest, [before, after])
    no_before, no_after = ~F.col(f"{before}_exists"), ~F.col(f"{after}_exists")
    reason = F.when(F.col("_lacking"), "missing_fields").when(no_before | no_after, "missing_images")
    if parsed_ok:
        reason = F.when(~F.col(parsed_ok), "parse_failures").otherwise(reason)
    return (
        flagged.withColumn("reason", reason)
        .withColumn(
            "missing_path",
            F.when(F.col("reason") == "missing_images", F.when(no_before, F.col(before)).otherwise(F.col(after))),
        )
        .drop("_lacking", f"{before}_exists", f"{after}_exists")
    )


def check_files(df: DataFrame, manifest: DataFrame, paths: Sequence[str]) -> DataFrame:
    """Keep rows whose files all exist: one left-semi join per path column."""
    known = manifest.select(F.col("path").alias("_path"))
    for c in paths:
        df = df.join(known, F.col(c) == F.col("_path"), "left_semi")
    return df


def skip_report(df: DataFrame, reason: str = "reason") -> DataFrame:
    """Row counts by skip reason; kept rows count under ``kept``."""
    return df.groupBy(F.coalesce(F.col(reason), F.lit("kept")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


def resolve_first(
    df: DataFrame, manifest: DataFrame, stem: str, suffixes: Sequence[str] = ("png", "jpg", "jpeg"), out: str = "resolved"
) -> DataFrame:
    """First existing file ``stem.suffix`` in suffix order, NULL if none exists.

    The manifest is reduced to one row per stem before the join, so no row is multiplied.
    """
    suffix = F.element_at(F.split("path", r"\."), -1)
    order = F.array_position(F.array(*[F.lit(s) for s in suffixes]), suffix)
    best = (
        manifest.filter(suffix.isin(*suffixes))
        .select("path", order.alias("_prio"), F.regexp_replace("path", r"\.[^.]*$", "").alias("_stem"))
        .groupBy("_stem")
        .agg(F.min(F.struct("_prio", "path"))["path"].alias(out))
    )
    return df.join(best, F.col(stem) == F.col("_stem"), "left").drop("_stem")


def pick_caption(df: DataFrame, key: str, captions: str = "captions", seed: int = 0, out: str = "caption") -> DataFrame:
    """One caption per row out of a JSON map; ``' '`` for an empty map, bad JSON drops the row."""
    parsed = F.from_json(captions, "map<string,string>")
    values = F.map_values(F.col("_map"))
    picked = choice(uniform(seed, F.col(key), "caption"), values)
    return (
        df.filter(F.try_parse_json(F.col(captions)).isNotNull())
        .withColumn("_map", parsed)
        .filter(F.col("_map").isNotNull())
        .withColumn(out, F.when(F.size("_map") == 0, F.lit(" ")).otherwise(picked))
        .drop("_map")
    )


def parse_rows(df: DataFrame, column: str, schema: StructType | str, out: str = "row") -> DataFrame:
    """Parse JSON text permissively: adds ``out`` and the flag ``parsed_ok``."""
    ok = F.try_parse_json(F.col(column)).isNotNull()
    return df.withColumn("parsed_ok", ok).withColumn(out, F.when(F.col("parsed_ok"), F.from_json(column, schema)))


def drop_bad_rows(df: DataFrame, column: str, schema: StructType | str, out: str = "row") -> DataFrame:
    """Parse JSON text and drop exactly the rows that do not parse."""
    return parse_rows(df, column, schema, out).filter("parsed_ok").drop("parsed_ok")


def unchanged_variant(
    df: DataFrame,
    key: str,
    p: float = 0.2,
    seed: int = 0,
    instruction: str = "instruction",
    reasoning: str = "reasoning",
    before: str = "before_image_path",
    after: str = "after_image_path",
) -> DataFrame:
    """With probability p turn a row into a no-op edit of its own source image.

    Needs the columns ``unchanged_instruction`` and ``unchanged_reasoning``; without them
    the table passes through.
    """
    if not {"unchanged_instruction", "unchanged_reasoning"} <= set(df.columns):
        return df
    hit = uniform(seed, F.col(key), "unchanged") < F.lit(p)
    return df.withColumns(
        {
            instruction: F.when(hit, F.col("unchanged_instruction")).otherwise(F.col(instruction)),
            reasoning: F.when(hit, F.col("unchanged_reasoning")).otherwise(F.col(reasoning)),
            after: F.when(hit, F.col(before)).otherwise(F.col(after)),
        }
    )


def judge_requests(
    items: DataFrame,
    templates: Mapping[int, str],
    original: str = "original_path",
    reference: str = "reference_path",
    output: str = "output_path",
    keep: Sequence[str] = ("item_key", "name", "idx"),
) -> DataFrame:
    """Three rows per item: ``dim`` and ``parts``, an array of (type, value).

    1 compares original and output, 2 sees original, reference and output, 3 the output
    alone. ``templates`` holds the wording per dimension with the holes ``{instruct}``
    and ``{reference}``.
    """
    def part(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), value.alias("value"))

    instruct = tx.with_rules(F.col("instruction"), F.col("rules"), "judge")
    images = {1: [original, output], 2: [original, reference, output], 3: [output]}
    rows = [
        F.struct(
            F.lit(dim).cast("bigint").alias("dim"),
            F.array(
                part("text", tx.fill_prompt(templates[dim], instruct=instruct, reference=F.col("reference_effect"))),
                *[part("image", F.col(c)) for c in images[dim]],
            ).alias("parts"),
        )
        for dim in (1, 2, 3)
    ]
    return items.select(*[c for c in items.columns if c in keep], F.inline(F.array(*rows)))


def message_content(parts: Column) -> Column:
    """Chat content of (type, value) parts.

    With an image: typed parts in order. Text only: one text, the parts joined by newlines.
    """
    def typed(p: Column) -> Column:
        is_text = p["type"] == "text"
        return F.struct(
            F.when(is_text, F.lit("text")).otherwise(F.lit("image_url")).alias("type"),
            F.when(is_text, p["value"]).alias("text"),
            F.when(~is_text, p["value"]).alias("url"),
            F.when(~is_text, F.lit("high")).alias("detail"),
        )

    joined = F.array(
        F.struct(
            F.lit("text").alias("type"),
            F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("text"),
            F.lit(None).cast("string").alias("url"),
            F.lit(None).cast("string").alias("detail"),
        )
    )
    return F.when(F.exists(parts, lambda p: p["type"] == "image"), F.transform(parts, typed)).otherwise(joined)


def messages(parts: Column, system: str | None = None) -> Column:
    """``array<struct<role, content>>`` with an optional system row first."""
    def row(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    user = row("user", message_content(parts))
    if system is None:
        return F.array(user)
    text = F.array(F.struct(F.lit("text").alias("type"), F.lit(system).alias("value")))
    return F.array(row("system", message_content(text)), user)
