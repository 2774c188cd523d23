"""Benchmark decontamination by pigeonhole edit matching.

An item of m words may differ from a passage by k = floor(m * EDIT_RATE) word edits. Cut
into k + 1 pieces, at least one piece of such a passage is untouched, so an exact search
for pieces finds every match. Around each piece hit, Myers' bit-parallel distance (one bit
per item word, one step per document word) gives the least edit distance of the item to
any passage there.

Items go out in blocks of at most BLOCK_BYTES, one after the other: a block is broadcast,
the documents are searched for it, the hits are added to one table in the shared folder, and
the block is released before the next one is fetched. So neither the driver nor an executor
holds more than one block, and the plan does not grow with the benchmark; the documents are
read once per block. Documents are only mapped, never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import work_folder

EDIT_RATE = 0.2
BLOCK_BYTES = 8 << 20
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    """Lower-case words without punctuation."""
    return _WORD.findall(text.lower()) if text else []


def pieces(n_words: int, rate: float = EDIT_RATE) -> list[tuple[int, int]]:
    """[begin, end) of the error budget plus one pieces of an item, of nearly equal size."""
    n = min(n_words, int(n_words * rate) + 1)
    return [(n_words * i // n, n_words * (i + 1) // n) for i in range(n)] if n else []


def myers(masks: dict[str, int], m: int, words: list[str]) -> tuple[int, int]:
    """Least edit distance of a pattern of m words to a run of ``words``, and the end of the first such run.

    ``masks`` has, per word, the bits of its places in the pattern.
    """
    every, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best, end = every, 0, m, m, 0
    for at, word in enumerate(words):
        eq = masks.get(word, 0)
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & every
        hp = vn | (every & ~(d0 | vp))
        hn = d0 & vp
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = (hp << 1) & every
        hn = (hn << 1) & every
        vp = hn | (every & ~(d0 | hp))
        vn = hp & d0
        if score < best:
            best, end = score, at + 1
    return best, end


class Matcher:
    """Items of one block, ready to be searched for."""

    def __init__(self, items: list[tuple[int, list[str]]], rate: float) -> None:
        self.items = []
        found: dict[str, list[tuple[int, int]]] = {}
        for item_id, words in items:
            masks: dict[str, int] = {}
            for i, word in enumerate(words):
                masks[word] = masks.get(word, 0) | 1 << i
            for a, b in pieces(len(words), rate):
                found.setdefault(f" {' '.join(words[a:b])} ", []).append((len(self.items), a))
            self.items.append((item_id, len(words), int(len(words) * rate), masks))
        self.machine = ahocorasick.Automaton()
        for piece, places in found.items():
            self.machine.add_word(piece, (len(piece), places))
        if found:
            self.machine.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item id, least edits, word after the passage) of the items within their budget."""
        words = words_of(text)
        if not words or not len(self.machine):
            return []
        joined = f" {' '.join(words)} "
        seen: dict[int, list[tuple[int, int]]] = {}
        starts: dict[int, int] | None = None
        for end, (size, places) in self.machine.iter(joined):
            if starts is None:
                starts, at = {}, 0
                for i, word in enumerate(words):
                    starts[at] = i
                    at += len(word) + 1
            first = starts[end - size + 1]
            for item, offset in places:
                _, m, k, _ = self.items[item]
                lo, hi = max(0, first - offset - k), min(len(words), first - offset + m + k)
                spans = seen.setdefault(item, [])
                if spans and lo <= spans[-1][1] and lo >= spans[-1][0]:
                    spans[-1] = (spans[-1][0], max(hi, spans[-1][1]))
                else:
                    spans.append((lo, hi))
        out = []
        for item, spans in seen.items():
            item_id, m, k, masks = self.items[item]
            edits, end = min((d, lo + e) for lo, hi in spans for d, e in [myers(masks, m, words[lo:hi])])
            if edits <= k:
                out.append((item_id, edits, end))
        return out


def blocks(items: DataFrame, item_key: str, text: str) -> Iterator[list[tuple[int, list[str]]]]:
    """Items with a word, in blocks of at most BLOCK_BYTES (or one item), fetched one partition at a time."""
    block, size = [], 0
    for row in items.where(F.col(item_key).isNotNull()).select(F.col(item_key).cast("bigint"), F.col(text)).distinct().toLocalIterator():
        words = words_of(row[1])
        if words:
            block.append((row[0], words))
            size += len(row[1].encode("utf-8", "surrogatepass"))
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    yield block


def contaminated(df: DataFrame, items: DataFrame, rate: float = EDIT_RATE, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_edits, end_word): each document with each item it holds within the item's error budget.

    Distances are counted in words, compared in lower case and without punctuation; the
    smallest one in the document and the end of its first passage are given. NULL and
    empty texts and items without a word match nothing; rows with a NULL id are left out.
    Repeated rows give one row. Further columns are not read. The search runs when this is
    called; what is returned reads the hits.
    """
    spark, hits = df.sparkSession, work_folder(df.sparkSession, "hits")
    schema = StructType([StructField(n, LongType()) for n in (key, item_key, "n_edits", "end_word")])
    narrow = df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint"), F.col(text))

    def search(block: list[tuple[int, list[str]]]) -> None:
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate)
            for batch in batches:
                rows = [(doc, *hit) for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for hit in matcher.matches(t)]
                columns = list(zip(*rows)) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=schema.names)

        narrow.mapInArrow(run, schema).write.mode("append").parquet(hits)
        shared.destroy()

    for block in blocks(items, item_key, item_text):
        search(block)
    found = spark.read.schema(schema).parquet(hits)
    return found.groupBy(key, item_key).agg(F.min(F.struct("n_edits", "end_word")).alias("best")).select(key, item_key, "best.n_edits", "best.end_word")


def decontaminate(df: DataFrame, items: DataFrame, rate: float = EDIT_RATE, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """df without the documents that hold an item; rows with a NULL id are kept."""
    hit = contaminated(df, items, rate, key, text, item_key, item_text).select(F.col(key).alias("__hit")).distinct()
    return df.join(hit, F.col(key).cast("bigint") == F.col("__hit"), "left_anti")
