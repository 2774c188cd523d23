"""Line dedup by chunks of lines that depend on nothing outside themselves.

A chunk is a line that holds a word and the next such line, with what blank lines stand
between: the hash rolls over two lines and cuts at each. No cut depends on the lines before
a passage or on a text's end, so a repeated passage of two lines or more is covered whole,
wherever it stands, and an exact copy from its first line to its last. Chunks that occur
more than once in the corpus are found by digest; those few are then compared byte by byte,
and all but the first (smallest document id) are cut from their documents.

Only digests of chunks are shuffled at first. Texts move once, by document id; the bytes
of a chunk move only if its digest came up twice. Both counts combine before their
shuffle, so a chunk shared by a third of all documents is one row per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

# Characters that make no word; a line of nothing else is blank.
BLANK = " \t\x0b\x0c\r"


def chunks(text: str | None) -> list[tuple[int, int]]:
    """[first line, line after the last) of the chunks of a text's \\n-split lines; neighbours share a line."""
    if not text:
        return []
    held = [i for i, line in enumerate(text.split("\n")) if line.strip(BLANK)]
    return [(a, b + 1) for a, b in zip(held, held[1:])]


def multi_line(text: str | None) -> list[tuple[bytes, str, int, int]]:
    """(digest, bytes as text, first line, end) of the chunks of a text."""
    found = []
    lines = text.split("\n") if text else []
    for a, b in chunks(text):
        body = "\n".join(lines[a:b])
        found.append((hashlib.blake2b(body.encode(), digest_size=16).digest(), body, a, b))
    return found


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, id) of the chunks of each text."""
    for batch in batches:
        keys, digests = [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = [d for d, _, _, _ in multi_line(text)]
            keys += [key] * len(own)
            digests += own
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(keys, pa.int64())], names=["digest", "id"])


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, bytes, id) of the chunks whose digest is among the document's candidates."""
    for batch in batches:
        rows: dict[tuple[bytes, str], int] = {}
        for key, text, marked in zip(*(c.to_pylist() for c in batch.columns)):
            marked = set(marked or ())
            if marked:
                for digest, body, _, _ in multi_line(text):
                    if digest in marked:
                        at = (digest, body)
                        rows[at] = min(key, rows.get(at, key))
        yield pa.RecordBatch.from_arrays(
            [pa.array([d for d, _ in rows], pa.binary()), pa.array([b for _, b in rows], pa.string()), pa.array(list(rows.values()), pa.int64())],
            names=["digest", "body", "id"],
        )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text, lines removed): texts without the candidates whose first holder is another document or an earlier place."""
    for batch in batches:
        row, *rest = batch.columns
        texts, removed = [], []
        for text, marked, first in zip(*(c.to_pylist() for c in rest)):
            marked, first, gone = set(marked or ()), set(first or ()), []
            for digest, _, a, b in multi_line(text) if marked else ():
                if digest in first:
                    first.discard(digest)
                elif digest in marked:
                    gone.append((a, b))
            dropped = {i for a, b in gone for i in range(a, b)}
            if dropped:
                text = "\n".join([line for i, line in enumerate(text.split("\n")) if i not in dropped])
            texts.append(text)
            removed.append(len(dropped))
        yield pa.RecordBatch.from_arrays([row, pa.array(texts, pa.string()), pa.array(removed, pa.int64())], names=["row", "text", "removed"])


REMOVED = "n_lines_removed"


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of df with repeated multi-line passages cut from ``text``, and ``n_lines_removed``.

    The first holder of a chunk, by document id and then by place, keeps it but for lines that
    another repeated chunk covers; each line cut has an equal one before it. Single lines and
    blank lines around a passage stay. NULL and empty texts pass; so do rows whose id is NULL. Rows that
    share an id count as one document, each keeping the chunks that document holds first.
    A column that is already called ``n_lines_removed`` is replaced.
    """
    df = df.drop(REMOVED)
    narrow = df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    digest, ident, body = StructField("digest", BinaryType()), StructField("id", LongType()), StructField("body", StringType())
    found = narrow.mapInArrow(_digests, StructType([digest, ident]))
    often = found.groupBy("digest").count().where("count > 1").select("digest")
    marked = found.join(often, "digest").groupBy("id").agg(F.collect_set("digest").alias("marked"))
    bodies = narrow.join(marked, "id").select("id", "text", "marked").mapInArrow(_bodies, StructType([digest, body, ident]))
    first = bodies.groupBy("digest", "body").agg(F.min("id").alias("id")).groupBy("id").agg(F.collect_set("digest").alias("first"))
    # The other columns travel as one, so their names cannot clash with those used here.
    row = F.struct(*[F.col(c) for c in df.columns if c != text]).alias("row")
    wide = df.select(row, F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    wide = wide.join(marked, "id", "left").join(first, "id", "left").select("row", "text", "marked", "first")
    schema = StructType([wide.schema["row"], wide.schema["text"], StructField("removed", LongType())])
    done = wide.mapInArrow(_cut, schema)
    return done.select(*[F.col("text").alias(c) if c == text else F.col("row")[c].alias(c) for c in df.columns], F.col("removed").alias(REMOVED))
