"""Typed sorting, leaderboards and side-by-side answers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import staged
from .rank import cell_rank, range_rank

SORT_TYPES = ("number", "string", "date", "last", "raw", "none")


_MONTH = r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b\.?"
_WEEKDAY = r"(?i)^\s*(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\b[.,]?\s*"
DATE_FORMS = ("y/M/d", "M/d/y", "MMM d y", "d MMM y")


def date_millis(c: Column) -> Column:
    """Milliseconds of a date text, NULL if it is none.

    ISO forms; else slashes or month names in English, month before day unless the year
    comes first, with or without weekday, commas, time of day and a UTC mark.
    """
    words = F.regexp_replace(F.regexp_replace(c, _WEEKDAY, ""), r"(?i)\s*(?:GMT|UTC|Z)\s*$", "")
    words = F.trim(F.regexp_replace(F.regexp_replace(words, _MONTH, "$1 "), r"[\s,]+", " "))
    forms = [F.try_to_timestamp(F.initcap(words), F.lit(f"{form}[ H:mm[:ss]]")) for form in DATE_FORMS]
    return F.unix_millis(F.coalesce(F.try_to_timestamp(c), *forms))


def sort_key(c: Column, kind: str) -> Column:
    """Comparable value of a cell's text for one of the sort types."""
    shown = tx.strip_tags(tx.parse_units(c))
    if kind == "number":
        digits = F.regexp_replace(shown, r"[^-\d.]", "")
        return F.when(digits == "", F.lit(0.0)).otherwise(digits.try_cast("double"))
    if kind == "date":
        return F.coalesce(date_millis(shown), F.lit(0).cast("bigint"))
    if kind == "last":
        return F.lower(F.element_at(F.split(shown, " "), -1))
    if kind == "raw":
        return c
    if kind == "none":
        return F.lit(None).cast("string")
    return F.lower(shown)


def sort_by(df: DataFrame, column: str, kind: str, position: str, descending: bool = False) -> DataFrame:
    """Rows in typed order; equal keys keep their input position in both directions."""
    key = sort_key(F.col(column), kind)
    keyed = df.withColumn("sort_key", key)
    if kind == "none":
        return keyed.orderBy(position)
    return keyed.orderBy(F.col("sort_key").desc() if descending else F.col("sort_key").asc(), F.col(position))


def sort_rank(df: DataFrame, column: str, kind: str, position: str, descending: bool = False) -> DataFrame:
    """``sort_by`` as a table ``position, sort_key, sort_rank`` for any sort type.

    Equal keys keep their input position in both directions, and NULL (a text that is no
    number) goes last in both. Only the position and the key are moved; ``none`` ranks by
    the position alone.
    """
    if kind not in SORT_TYPES:
        raise ValueError(f"unknown sort type {kind!r}")
    # Written once: the range exchange samples its input, and the texts are to be parsed a single time.
    keys = staged(df.select(position, sort_key(F.col(column), kind).alias("sort_key")), "sort-keys")
    key = F.col("sort_key")
    by_key = key.desc_nulls_last() if descending else key.asc_nulls_last()
    return range_rank(keys, [F.col(position)] if kind == "none" else [by_key, F.col(position)], rank="sort_rank")


def leaderboard(
    scores: DataFrame,
    model: str = "model",
    score: str = "score",
    pinned: str | None = None,
    scale: tuple[float, float] = (0.0, 100.0),
) -> DataFrame:
    """Mean score per model with its rank; equal scores share a rank, ranks 1-3 are marked.

    The pinned model comes first whatever its rank. ``scale`` is the usual score range;
    it only spreads the ranking work, scores outside it are ranked all the same.
    """
    means = scores.groupBy(model).agg(F.avg(score).alias(score))
    falling = means.withColumn("_falling", -F.col(score))
    # NULL scores go last: behind every cell width_bucket can give.
    cell = F.lpad(
        F.coalesce(F.width_bucket("_falling", F.lit(-scale[1]), F.lit(-scale[0]), F.lit(1000)), F.lit(9999)).cast("string"), 4, "0"
    )
    ranked = cell_rank(falling, cell, [F.col("_falling").asc_nulls_last()], rank="_above", shared=True)
    out = ranked.withColumn("rank", F.col("_above") + 1).drop("_falling", "_above")
    out = out.withColumn("marked", F.col("rank") <= 3).withColumn(
        "pinned", F.coalesce(F.col(model) == F.lit(pinned), F.lit(False)) if pinned else F.lit(False)
    )
    return out.orderBy(F.col("pinned").desc(), "rank", model)


def fmt1(c: Column) -> Column:
    """Numbers with one decimal, other texts as they are."""
    number = c.try_cast("double")
    return F.when(number.isNotNull() & ~F.isnan(number), F.format_string("%.1f", F.round(number, 1))).otherwise(
        c.cast("string")
    )


def category_matrix(
    scores: DataFrame, categories: Sequence[str], model: str = "model", category: str = "category", score: str = "score"
) -> DataFrame:
    """One row per model, one column per listed category; the fixed list saves a scan."""
    return scores.groupBy(model).pivot(category, list(categories)).agg(F.avg(score))


def compare(
    questions: DataFrame, answers: Mapping[str, DataFrame | None], key: str, response: str = "response"
) -> DataFrame:
    """Each question once, with one answer column per model.

    ``answers`` maps a column name to a table (key, response); ``None`` is a model that
    is not loaded and answers ``''``. Of several answers to a question the smallest text counts.
    """
    out = questions
    for column, table in answers.items():
        if table is None:
            out = out.withColumn(column, F.lit(""))
            continue
        side = table.groupBy(key).agg(F.min(response).alias(column))
        out = out.join(side, key, "left").withColumn(column, F.coalesce(column, F.lit("")))
    return out
