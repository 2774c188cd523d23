"""Report sinks. Reports are aggregates with one row per class, so one file is right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def report_table(report: DataFrame) -> DataFrame:
    """The report with its published column names, in report order."""
    return report.orderBy("ordinal", "metric").select(
        F.col("metric").alias("-"),
        F.col("score_origin").alias("Score-Origin"),
        F.col("score_percentage").alias("Score-Percentage"),
        F.col("accuracy").alias("Accuracy"),
    )


def write_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    report_table(report).coalesce(1).write.mode(mode).csv(path, header=True)


def _triple() -> Column:
    return F.array(F.col("score"), F.col("percent"), F.col("complete"))


def by_name_map(by_name: DataFrame) -> DataFrame:
    """One row with the JSON map name -> [score, percent, complete]."""
    entries = F.array_sort(F.collect_list(F.struct(F.col("name").alias("key"), _triple().alias("value"))))
    return by_name.agg(F.to_json(F.map_from_entries(entries), {"ignoreNullFields": "false"}).alias("value"))


def write_by_name(by_name: DataFrame, path: str, mode: str = "errorifexists") -> None:
    by_name_map(by_name).coalesce(1).write.mode(mode).text(path)
