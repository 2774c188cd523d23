"""Substring dedup with suffix automata: every word of a run of 20 words that came before goes.

A window of 20 words has an anchor, the 6 words in it with the smallest hash. Equal windows
have equal anchors, so windows are compared only within one anchor. The steps:

1. Anchors of all documents are counted; those met once cannot hold a repeat.
2. Around each other anchor, the words of the windows it stands for (20 to 34) are sent to
   the anchor's shard. An anchor met more than HOT times is split: its windows go out one
   by one, keyed by their own words, so that no shard grows with a hot passage.
3. A shard reads its runs in document order and streams each against a suffix automaton of
   the runs before it: the matching statistic at each word is the longest run of words that
   ends there and occurred before. Where it is 20 or more, a window is a repeat. The
   automaton then takes the run in, word by word, so repeats inside the run count too.
4. Documents take back which of their windows came first; all other windows of step 2 are
   repeats, and the words they cover are removed.

Automata of whole reference shards cannot be broadcast under a bound that holds for any
corpus, and streaming every document past every shard grows with the square of the corpus.
Routing runs by anchor keeps each automaton small and meets every pair of equal windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..session import staged
from .words import WordBatch, split_words, word_batches

WINDOW, ANCHOR = 20, 6
PLACES = WINDOW - ANCHOR + 1
HOT = 1000


def anchors(words: WordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of windows with one anchor: text, anchor hash, first window in the text, number of windows."""
    hashes = words.windows(ANCHOR)
    total = len(words.hashes)
    none = np.zeros(0, dtype=np.int64)
    if total < WINDOW:
        return none, none.astype(np.uint64), none, none

    def lower(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(hashes[a] <= hashes[b], a, b)

    best = np.arange(len(hashes))
    for width in (1, 2, 4):
        best = lower(best[:-width], best[width:])
    best = lower(best[: len(best) - (PLACES - 8)], best[PLACES - 8 :])
    counts = np.diff(words.first)
    text = np.repeat(np.arange(len(counts)), counts)[: total - WINDOW + 1]
    start = np.arange(total - WINDOW + 1)
    start = start[start + WINDOW <= words.first[text + 1]]
    text, best = text[start], best[start]
    if not len(start):
        return none, none.astype(np.uint64), none, none
    new = np.ones(len(start), dtype=bool)
    new[1:] = (best[1:] != best[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], hashes[best[at]], start[at] - words.first[text[at]], np.diff(np.append(at, len(start)))


def _anchor_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, sub, anchor hashes, first windows, numbers of windows) of each text that has a window."""
    for batch in batches:
        ids, subs = (np.array(batch.column(i).to_pylist(), dtype=np.int64) for i in (0, 1))
        out: list[tuple] = []
        for lo, _, words in word_batches(batch.column(2)):
            text, keys, first, n = anchors(words)
            have, at = np.unique(text, return_index=True)
            keys = keys.astype(np.int64)
            for t, a, b in zip(have, at, [*at[1:], len(text)]):
                out.append((ids[lo + t], subs[lo + t], keys[a:b], first[a:b].astype(np.int32), n[a:b].astype(np.int32)))
        one, sub, *lists = zip(*out) if out else ((), (), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(one, pa.int64()), pa.array(sub, pa.int64()), pa.array(lists[0], pa.list_(pa.int64())), pa.array(lists[1], pa.list_(pa.int32())), pa.array(lists[2], pa.list_(pa.int32()))],
            names=["id", "sub", "anchors", "firsts", "counts"],
        )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, words, id, sub, first window, windows): what goes to the shards, each run once per batch."""
    for batch in batches:
        rows: dict[tuple[int, str], tuple[int, int, int, int]] = {}
        for ident, sub, text, marked in zip(*(c.to_pylist() for c in batch.columns)):
            words = split_words(text)
            for mark in marked:
                first, n = mark["first"], mark["n"]
                if mark["hot"]:
                    for at in range(first, first + n):
                        run = " ".join(words[at : at + WINDOW])
                        key = int.from_bytes(hashlib.blake2b(run.encode(), digest_size=8).digest(), "little", signed=True)
                        rows[key, run] = min((ident, sub, at, 1), rows.get((key, run), (ident, sub, at, 1)))
                else:
                    run = mark["anchor"], " ".join(words[first : first + n + WINDOW - 1])
                    rows[run] = min((ident, sub, first, n), rows.get(run, (ident, sub, first, n)))
        ids, subs, firsts, counts = zip(*rows.values()) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.string()), pa.array(ids, pa.int64()), pa.array(subs, pa.int64()), pa.array(firsts, pa.int32()), pa.array(counts, pa.int32())],
            names=["key", "run", "id", "sub", "first", "n"],
        )


class SuffixAutomaton:
    """Suffix automaton over words of several runs, grown while the next run is read."""

    def __init__(self) -> None:
        self.edges: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _copy(self, state: int, length: int) -> int:
        self.edges.append(dict(self.edges[state]))
        self.link.append(self.link[state])
        self.length.append(length)
        self.link[state] = len(self.link) - 1
        return len(self.link) - 1

    def _redirect(self, at: int, word: str, old: int, new: int) -> None:
        while at >= 0 and self.edges[at].get(word) == old:
            self.edges[at][word] = new
            at = self.link[at]

    def extend(self, last: int, word: str) -> int:
        """State of the run so far plus one word."""
        edges, link, length = self.edges, self.link, self.length
        known = edges[last].get(word)
        if known is not None:
            if length[known] == length[last] + 1:
                return known
            copy = self._copy(known, length[last] + 1)
            self._redirect(last, word, known, copy)
            return copy
        state = len(link)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and word not in edges[at]:
            edges[at][word] = state
            at = link[at]
        if at >= 0:
            known = edges[at][word]
            if length[known] == length[at] + 1:
                link[state] = known
            else:
                copy = self._copy(known, length[at] + 1)
                self._redirect(at, word, known, copy)
                link[state] = copy
        return state

    def stream(self, words: list[str]) -> list[int]:
        """Matching statistic at each word against all before it; takes the words in."""
        edges, link, length = self.edges, self.link, self.length
        state, matched, last, out = 0, 0, 0, []
        for word in words:
            while state and word not in edges[state]:
                state = link[state]
                matched = length[state]
            following = edges[state].get(word)
            if following is None:
                state, matched = 0, 0
            else:
                state, matched = following, matched + 1
            out.append(matched)
            last = self.extend(last, word)
            while state and matched <= length[link[state]]:
                state = link[state]
        return out


def _first_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, sub, first window, bits of the windows that came first) of the runs of each shard, read in order."""
    key, seen, alone, automaton = None, set(), None, None

    def fresh(words: list[str], n: int) -> int:
        bits = 0
        for at, longest in enumerate(automaton.stream(words)[WINDOW - 1 :]):
            if longest < WINDOW:
                bits |= 1 << at
        return bits

    for batch in batches:
        out = []
        for k, run, ident, sub, first, n in zip(*(c.to_pylist() for c in batch.columns)):
            if k != key:
                key, seen, alone, automaton = k, set(), None, None
            if run in seen:
                continue
            seen.add(run)
            words = run.split(" ")
            # A first run can only repeat itself, at most 14 words on; then it has at most
            # 14 different words. Else its automaton is made when a second run comes.
            if alone is None and automaton is None and len(set(words)) >= PLACES:
                alone = words
                out.append((ident, sub, first, (1 << n) - 1))
                continue
            if automaton is None:
                automaton = SuffixAutomaton()
                if alone is not None:
                    automaton.stream(alone)
            bits = fresh(words, n)
            if bits:
                out.append((ident, sub, first, bits))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
        columns = list(zip(*out)) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["id", "sub", "first", "bits"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, words, removed words, kept text) from texts, their compared windows and those that came first."""
    for batch in batches:
        row, *rest = batch.columns
        n_words, n_removed, kept = [], [], []
        for text, marked, first in zip(*(c.to_pylist() for c in rest)):
            words = split_words(text)
            change = [0] * (len(words) + 1)
            came_first = {x["first"] + i for x in first or () for i in range(PLACES) if x["bits"] >> i & 1}
            for mark in marked or ():
                for at in range(mark["first"], mark["first"] + mark["n"]):
                    if at not in came_first:
                        change[at] += 1
                        change[at + WINDOW] -= 1
            left = [w for w, depth in zip(words, accumulate(change)) if not depth] if marked else words
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            kept.append(" ".join(left))
        yield pa.RecordBatch.from_arrays([row, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["row", "n_words", "n_removed", "kept"])


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): per row, the words no earlier equal window covers, joined by blanks.

    Earlier means a smaller id, or the same document and an earlier start. Rows that share
    an id and text count as one document; texts that share an id are documents of their own,
    ordered by a 64-bit hash of the text (``sub``). NULL, empty and blank texts have no
    words. Rows with a NULL id keep all their words and are no source of repeats. An id that
    is no whole number is an error. Further columns are not read.
    """
    texts = df.select(F.col(key).alias("row"), F.col(key).cast("bigint").alias("id"), F.xxhash64(text).alias("sub"), F.col(text).alias("text"))
    keyed = texts.where("id IS NOT NULL")
    ints, longs = ArrayType(IntegerType()), ArrayType(LongType())
    number, place = [StructField("id", LongType()), StructField("sub", LongType())], StructField("first", IntegerType())
    lists = staged(
        keyed.select("id", "sub", "text").mapInArrow(_anchor_lists, StructType([*number, StructField("anchors", longs), StructField("firsts", ints), StructField("counts", ints)])),
        "anchors",
    )
    # Written, so that the join below has a plain exchange on either side and Spark can split a hot anchor.
    often = staged(lists.select(F.explode("anchors").alias("anchor")).groupBy("anchor").count().where("count > 1"), "often")
    each = lists.select("id", "sub", F.inline(F.arrays_zip("anchors", "firsts", "counts"))).toDF("id", "sub", "anchor", "first", "n")
    marks = each.join(often, "anchor").select("id", "sub", F.struct("anchor", "first", "n", (F.col("count") > HOT).alias("hot")).alias("mark"))
    marked = staged(marks.distinct().groupBy("id", "sub").agg(F.collect_list("mark").alias("marked")), "marked")
    runs = texts.join(marked, ["id", "sub"]).select("id", "sub", "text", "marked").mapInArrow(
        _runs, StructType([StructField("key", LongType()), StructField("run", StringType()), *number, place, StructField("n", IntegerType())])
    )
    shards = runs.repartition("key").sortWithinPartitions("key", "id", "sub", "first")
    came = shards.mapInArrow(_first_windows, StructType([*number, place, StructField("bits", LongType())]))
    came = staged(came.groupBy("id", "sub").agg(F.collect_list(F.struct("first", "bits")).alias("came")), "first_windows")
    wide = texts.join(marked, ["id", "sub"], "left").join(came, ["id", "sub"], "left").select("row", "text", "marked", "came")
    schema = StructType([wide.schema["row"], StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())])
    return wide.mapInArrow(_removed, schema).select(F.col("row").alias(key), "n_words", "n_removed", "kept")
