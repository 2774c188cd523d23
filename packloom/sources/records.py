"""JSON, JSON Lines, CSV and TSV tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..session import first_characters

TRAINING_RECORD = StructType(
    [
        StructField(c, StringType())
        for c in ("instruction", "reasoning", "rules", "original_image_path", "edited_image_path")
    ]
)
EXPORT_COLUMNS = ("before_image_path", "after_image_path", "instruction", "reasoning", "rules")


def is_json_array(spark: SparkSession, path: str) -> bool:
    """True if a file's first non-blank character is an opening bracket."""
    return b"[" in first_characters(spark, path).values()


def read_records(spark: SparkSession, path: str, schema: StructType = TRAINING_RECORD, bad_rows: str | None = None) -> DataFrame:
    """JSON arrays and JSON Lines, told apart file by file by the first non-blank character.

    Lines are split over tasks; blank lines are skipped. An array is read by one task per
    file, as the format cannot be split, and streamed there; large inputs belong in JSON
    Lines. ``bad_rows`` names a column that keeps the text of rows that do not parse;
    without it they fail no job but come as NULL rows. A folder that holds both kinds
    comes as a union, which has no file metadata.
    """
    reader = spark.read.option("mode", "PERMISSIVE")
    if bad_rows:
        schema = StructType([*schema.fields, StructField(bad_rows, StringType())])
        reader = reader.option("columnNameOfCorruptRecord", bad_rows)
    reader = reader.schema(schema)
    first = first_characters(spark, path)
    arrays = [file for file, character in first.items() if character == b"["]
    lines = [file for file, character in first.items() if character not in (b"[", b"")]
    if arrays and lines:
        return reader.json(arrays, multiLine=True).unionByName(reader.json(lines, multiLine=False))
    return reader.json(path, multiLine=bool(arrays))


def with_input_position(df: DataFrame, out: str = "input_pos") -> DataFrame:
    """Sortable input position of rows read from files: file, block, row in the task."""
    at = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return df.select("*", at.alias(out))


_SEPARATOR = {"csv": ",", "tsv": "\t"}
# Quotes inside a field are doubled, blanks at its ends are part of it.
_QUOTING = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _suffix(path: str) -> str:
    return path.rstrip("/").rsplit(".", 1)[-1].lower()


def read_table(spark: SparkSession, path: str, schema: StructType, fmt: str | None = None) -> DataFrame:
    """Table by suffix: json, jsonl, csv or tsv."""
    kind = fmt or _suffix(path)
    if kind in _SEPARATOR:
        # Fields may hold line breaks, so a file is read by one task; write many files.
        return spark.read.schema(schema).csv(path, sep=_SEPARATOR[kind], header=True, multiLine=True, **_QUOTING)
    if kind == "jsonl":
        return spark.read.schema(schema).json(path)
    if kind == "json":
        return read_records(spark, path, schema)
    raise ValueError(f"unknown table suffix {kind!r}: use json, jsonl, csv or tsv")


def write_table(df: DataFrame, path: str, fmt: str | None = None, mode: str = "errorifexists") -> None:
    """Table by suffix; CSV and TSV quote every field and carry a header."""
    kind = fmt or _suffix(path)
    if kind in _SEPARATOR:
        df.write.mode(mode).csv(path, sep=_SEPARATOR[kind], header=True, quoteAll=True, encoding="UTF-8", **_QUOTING)
    elif kind in ("json", "jsonl"):
        df.write.mode(mode).option("ignoreNullFields", "false").json(path)
    else:
        raise ValueError(f"unknown table suffix {kind!r}: use json, jsonl, csv or tsv")


def write_json(df: DataFrame, path: str, order: str | Sequence[str] = "input_pos", mode: str = "errorifexists") -> None:
    """JSON Lines in input order, non-ASCII text kept; the order columns are not written."""
    order = [order] if isinstance(order, str) else list(order)
    df.orderBy(*order).drop(*order).write.mode(mode).option("ignoreNullFields", "false").json(path)
