"""Byte-level BPE by replaying the merges over the words of a part of the corpus.

A tokenizer's ranks say which byte strings are tokens and in which order neighbours are
joined. Instead of running a merge loop per word, each task gathers the distinct words of
its texts that its worker has not met before and lays their bytes out in one array. Each
pass over it joins the lowest-ranked pair of every word, and only the two neighbours of a
joined place are looked up again. Words of many bytes, which would need many passes, go by
an inverted index from rank to the positions whose pair would make that token; there ranks
are taken lowest first. The words a worker remembers are bounded in bytes; forgetting one
only means replaying it again.

Encoding is map-only: texts are read once, nothing is shuffled, a lost task is run again.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .words import kept, text_slices

# Bytes of words, with their ids, that one worker remembers between batches.
MEMORY_BYTES = 96 << 20
# A longer word is replayed whenever it comes, not remembered.
REMEMBERED_WORD = 256
# Blanks with the word after them; Latin letters and digits end before ASCII punctuation, so a
# word is not met anew with every mark behind it. No match of the split pattern of the public
# byte-level vocabularies goes on from a non-blank to a blank, or from a letter or digit to
# punctuation (an apostrophe is left with its word), so it never reaches across these.
SEGMENTS = (
    r"[^\S\x1c-\x1f]*+(?:[0-9A-Za-zÀ-ÖØ-öø-ÿ]++(?![^\s!-&(-/:-@\[-`{-~])|[\S\x1c-\x1f]++)"
    r"|[^\S\x1c-\x1f]+"
)
# New words are replayed in groups of about so many bytes; the lists of a replay take some 200 bytes per byte.
GROUP_BYTES = 1 << 18
# Words of more bytes are replayed by the index: a pass makes one join in a word and reads all of it.
PASSED_WORD = 64
# Texts are cut into pieces in slices of about so many characters; the pieces take some 20 bytes per character.
SLICE_CHARS = 1 << 18


def parse_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """Token bytes -> rank from lines of base64 token and rank."""
    pairs = (line.split() for line in lines if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def read_ranks(spark, path: str) -> dict[bytes, int]:
    """Ranks from a file that Spark can read; its size is the vocabulary's, not the corpus's."""
    return parse_ranks(row.value.encode() for row in spark.read.text(path).collect())


class Ranks:
    """A vocabulary made ready for replay: bytes to ranks and, per pair of tokens, what they join to.

    A pair joins if its bytes are a token; the pairs are all cuts of a token into two tokens,
    so their number is bounded by the vocabulary's total length.
    """

    def __init__(self, ranks: Mapping[bytes, int]) -> None:
        self.ranks = ranks
        self.shift = max(ranks.values()).bit_length()
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << self.shift | right] = rank
        self.bytes_pairs = np.array(
            [[self.pairs.get(int(a) << self.shift | int(b), -1) for b in self.single] for a in self.single], dtype=np.int64
        )
        # The pairs once more as sorted arrays; the last entry is no pair.
        keys = np.fromiter(self.pairs, dtype=np.int64, count=len(self.pairs))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.joined = np.append(np.fromiter(self.pairs.values(), dtype=np.int64, count=len(keys))[order], -1)

    def joins(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of what each left and right token join to, -1 where they do not."""
        wanted = left << self.shift | right
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.joined[at], -1)

    def opened(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The single bytes' tokens of all words, the rank of each with the next in its word (or -1), the words' ends."""
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        ends = np.cumsum([len(word) for word in words])
        ranks = np.full(len(data), -1, dtype=np.int64)
        ranks[:-1] = self.bytes_pairs[data[:-1], data[1:]]
        ranks[ends - 1] = -1
        return self.single[data], ranks, ends


def replay(words: list[bytes], vocabulary: Ranks) -> list[bytes]:
    """Token ids of each word as little-endian 32-bit integers.

    The word is one token if it is in the vocabulary. Otherwise the lowest-ranked pair of
    neighbours is joined, leftmost first, until no pair of neighbours is a token.
    """
    ranks = vocabulary.ranks
    found = [ranks[w].to_bytes(4, "little") if w in ranks else b"" for w in words]
    cut = [k for k, word in enumerate(words) if word and not found[k]]
    for some, way in (([k for k in cut if len(words[k]) <= PASSED_WORD], by_passes), ([k for k in cut if len(words[k]) > PASSED_WORD], by_index)):
        if some:
            for k, ids in zip(some, way([words[k] for k in some], vocabulary)):
                found[k] = ids
    return found


def by_passes(words: list[bytes], vocabulary: Ranks) -> list[bytes]:
    """Token ids of words that are not empty; each pass makes the next join of every word."""
    parts, rank_at, ends = vocabulary.opened(words)
    lengths = np.diff(ends, prepend=0)
    starts = ends - lengths
    none = (1 << 31) - 1
    rank_at[rank_at < 0] = none
    open_words = np.arange(len(words))
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(open_words):
        # The lowest rank of each word and, below it, the leftmost place that has it.
        lowest = np.minimum.reduceat(rank_at << 32 | np.arange(len(parts)), starts)
        rank, at = lowest >> 32, lowest & 0xFFFFFFFF
        going = rank < none
        if not going.all():
            stay = np.repeat(going, lengths)
            done.append((open_words[~going], lengths[~going], parts[~stay]))
            at = (at - np.cumsum(np.where(going, 0, lengths)))[going]
            parts, rank_at, rank, open_words, lengths = parts[stay], rank_at[stay], rank[going], open_words[going], lengths[going]
            starts = np.cumsum(lengths) - lengths
        parts[at] = rank
        rank_at[at] = none
        has_right, has_left = at + 2 < starts + lengths, at > starts
        for here, left, right in (
            (at[has_right], rank[has_right], parts[at[has_right] + 2]),
            (at[has_left] - 1, parts[at[has_left] - 1], rank[has_left]),
        ):
            new = vocabulary.joins(left, right)
            new[new < 0] = none
            rank_at[here] = new
        stay = np.ones(len(parts), dtype=bool)
        stay[at + 1] = False
        parts, rank_at = parts[stay], rank_at[stay]
        lengths = lengths - 1
        starts = starts - np.arange(len(starts))
    raw = np.concatenate([x[2] for x in done]).astype("<u4").tobytes()
    found = [b""] * len(words)
    lo = 0
    for k, hi in zip(chain.from_iterable(x[0].tolist() for x in done), (4 * np.cumsum(np.concatenate([x[1] for x in done]))).tolist()):
        found[k] = raw[lo:hi]
        lo = hi
    return found


def by_index(words: list[bytes], vocabulary: Ranks) -> list[bytes]:
    """Token ids of words that are not empty, rank by rank over an inverted index.

    Words do not touch each other, so all words that hold a pair are served when its rank
    comes up. A join can make a pair of a lower rank than its own; the index then goes back
    to it before it continues, so the order inside every word is the loop's order.
    """
    pairs, shift = vocabulary.pairs.get, vocabulary.shift
    tokens, first_ranks, ends = vocabulary.opened(words)
    n = len(tokens)
    parts = tokens.tolist()
    # The next and the last part of the same word, -1 where there is none.
    following, previous = np.arange(1, n + 1), np.arange(-1, n - 1)
    following[ends - 1] = -1
    previous[[0, *ends[:-1]]] = -1
    after, before, rank_at = following.tolist(), previous.tolist(), first_ranks.tolist()
    # Inverted index: rank -> places whose pair makes that token.
    order = np.argsort(first_ranks, kind="stable")
    keys, at = np.unique(first_ranks[order], return_index=True)
    index = {int(key): part.tolist() for key, part in zip(keys, np.split(order, at[1:])) if key >= 0}
    waiting = sorted(index)
    while waiting:
        rank = heappop(waiting)
        places = index.pop(rank)
        places.sort()
        for k, i in enumerate(places):
            if rank_at[i] != rank:
                continue
            j = after[i]
            parts[i] = rank
            beyond = after[i] = after[j]
            rank_at[j] = -1
            lowest = rank
            if beyond >= 0:
                before[beyond] = i
                new = rank_at[i] = pairs(rank << shift | parts[beyond], -1)
                if new >= 0:
                    if new in index:
                        index[new].append(i)
                    else:
                        index[new] = [i]
                        heappush(waiting, new)
                    lowest = min(lowest, new)
            else:
                rank_at[i] = -1
            left = before[i]
            if left >= 0:
                new = rank_at[left] = pairs(parts[left] << shift | rank, -1)
                if new >= 0:
                    if new in index:
                        index[new].append(left)
                    else:
                        index[new] = [left]
                        heappush(waiting, new)
                    lowest = min(lowest, new)
            if lowest < rank and k + 1 < len(places):
                if rank in index:
                    index[rank].extend(places[k + 1 :])
                else:
                    index[rank] = places[k + 1 :]
                    heappush(waiting, rank)
                break
    found = []
    for i in [0, *ends[:-1].tolist()]:
        ids = []
        while i >= 0:
            ids.append(parts[i])
            i = after[i]
        found.append(np.array(ids, dtype="<u4").tobytes())
    return found


class Encoder:
    """Texts to little-endian 32-bit ids. A worker keeps one for all its tasks.

    ``pattern`` finds the words, each encoded for itself. ``segments`` may name coarser
    pieces no match of ``pattern`` reaches across; a text is then cut into these, and both
    patterns run in full only on pieces the worker has not met.
    """

    def __init__(self, ranks: Mapping[bytes, int], pattern: str, segments: str | None) -> None:
        self.vocabulary, self.split = Ranks(ranks), regex.compile(pattern).findall
        self.cut = re.compile(segments).findall if segments else self.split
        self.known: dict[str, bytes] = {}
        self.size = 0

    def learn(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        """Pieces that are not remembered with their ids, in groups of bounded size."""
        for group in text_slices(pieces, GROUP_BYTES):
            parts = list(map(self.split, group))
            words = list(set().union(*parts))
            codes = dict(zip(words, replay([w.encode() for w in words], self.vocabulary)))
            yield from zip(group, [codes[x[0]] if len(x) == 1 else b"".join([codes[w] for w in x]) for x in parts])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [ids for some in text_slices(texts, SLICE_CHARS) for ids in self._encode(some)]

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [self.cut(text) if text else [] for text in texts]
        met = list(set().union(*cut))
        ids = dict(zip(met, map(self.known.get, met)))
        new = dict(self.learn([w for w, x in ids.items() if x is None]))
        ids.update(new)
        if self.size > MEMORY_BYTES:
            self.known = {w: x for w, x in ids.items() if w not in new and len(w) <= REMEMBERED_WORD}
            self.size = sum(len(w) + len(x) + 150 for w, x in self.known.items())
        short = {w: x for w, x in new.items() if len(w) <= REMEMBERED_WORD}
        self.known.update(short)
        self.size += sum(len(w) + len(x) + 150 for w, x in short.items())
        return [b"".join(map(ids.__getitem__, pieces)) for pieces in cut]


def encoder_of(ranks: Mapping[bytes, int], pattern: str, segments: str | None, name: str) -> Encoder:
    """This worker's encoder of a vocabulary, named by its digest."""
    return kept((name, pattern, segments), lambda: Encoder(ranks, pattern, segments))


def digest_of(ranks: Mapping[bytes, int]) -> str:
    """Digest that names a vocabulary."""
    whole = hashlib.sha256()
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        whole.update(b"%d %d " % (rank, len(token)) + token)
    return whole.hexdigest()


def _field(column: str, kind, df: DataFrame) -> StructType:
    return StructType([f for f in df.schema.fields if f.name != column] + [StructField(column, kind)])


def _appended(df: DataFrame, column: str, name: str, kind, make: Callable[[], Callable[[pa.Array], pa.Array]]) -> DataFrame:
    """df with ``name`` computed from ``column`` batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            kept = [f for f in batch.schema.names if f != name]
            arrays = [batch.column(batch.schema.get_field_index(f)) for f in kept]
            yield pa.RecordBatch.from_arrays([*arrays, step(batch.column(batch.schema.get_field_index(column)))], names=[*kept, name])

    return df.mapInArrow(run, _field(name, kind, df))


def encode(df: DataFrame, ranks: Mapping[bytes, int], pattern: str, segments: str | None = None, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the token ids of every whole text as an array of integers.

    NULL and empty texts get an empty array. A column called ``out`` is replaced; all
    other columns and repeated rows pass unchanged. The ranks must hold all 256 bytes.
    ``ranks`` is sent to the workers once: its size is fixed by the vocabulary.
    """
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"the ranks lack the single bytes {missing[:5]}")
    shared, name = df.sparkSession.sparkContext.broadcast(dict(ranks)), digest_of(ranks)

    def make():
        encoder = encoder_of(shared.value, pattern, segments, name)

        def step(column: pa.Array) -> pa.Array:
            found = encoder.encode(column.to_pylist())
            offsets = np.zeros(len(found) + 1, dtype=np.int64)
            np.cumsum([len(x) // 4 for x in found], out=offsets[1:])
            values = pa.array(np.frombuffer(b"".join(found), dtype="<i4"), type=pa.int32())
            return pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), values)

        return step

    return _appended(df, text, out, ArrayType(IntegerType()), make)


def decode(df: DataFrame, ranks: Mapping[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes of the token ids as a binary column.

    NULL ids give NULL, an empty array empty bytes; an id outside the vocabulary or NULL
    inside an array raises.
    """
    top = max(ranks.values(), default=-1)
    table: list[bytes | None] = [None] * (top + 1)
    for token, rank in ranks.items():
        table[rank] = token
    shared = df.sparkSession.sparkContext.broadcast(table)

    def make():
        tokens = shared.value

        def one(codes: list[int] | None) -> bytes | None:
            if codes is None:
                return None
            if any(c is None or not 0 <= c < len(tokens) or tokens[c] is None for c in set(codes)):
                raise ValueError("an id is not in the vocabulary")
            return b"".join([tokens[c] for c in codes])

        return lambda column: pa.array([one(x) for x in column.to_pylist()], type=pa.binary())

    return _appended(df, ids, out, BinaryType(), make)


def round_trip(df: DataFrame, ranks: Mapping[bytes, int], pattern: str, segments: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, number of ids, digest of the ids as 32-bit little-endian, digest of the decoded bytes.

    Encoding, decoding and digests happen in the same task, so ids are never written out
    where only their digests are asked for.
    """
    shared, name = df.sparkSession.sparkContext.broadcast(dict(ranks)), digest_of(ranks)
    schema = StructType([
        StructField(key, df.schema[key].dataType), StructField("n_tokens", LongType()),
        StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        encoder = encoder_of(ranks, pattern, segments, name)
        tokens = np.empty(max(ranks.values()) + 1, dtype=object)
        for token, rank in ranks.items():
            tokens[rank] = token
        for batch in batches:
            rows = []
            for ids in encoder.encode(batch.column(1).to_pylist()):
                back = b"".join(tokens[np.frombuffer(ids, dtype="<u4")].tolist())
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()))
            n, a, b = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=schema.names)

    return df.select(F.col(key), F.col(text)).mapInArrow(run, schema)
