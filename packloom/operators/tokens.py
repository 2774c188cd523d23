"""Byte-pair token ids.

Texts are split into words in the JVM. Encoding is one map-side pass: word arrays cross to
Python in Arrow batches, where each distinct word of a batch is looked up once and each
worker remembers the words it has met. Joining single words back to a dictionary instead would shuffle every
(document, word) pair twice and put the commonest words on a few hot keys.
``word_dictionary`` is the distinct-word job for vocabulary statistics.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from ..session import spread

# Fixed value: the word split pattern of the byte-level tokenizer.
WORD_PATTERN = (
    r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}| ?[^\s\p{L}\p{N}]+[\r\n]*"
    r"|\s*[\r\n]+|\s+(?!\S)|\s+"
)
# Words a worker remembers, some 400 bytes each; older ones are forgotten first. Longer words
# than REMEMBERED characters are encoded each time, so that the memory has a size.
WORD_MEMORY, REMEMBERED = 1 << 18, 64
# Words (of an encoding) or ids (of a decoding) that a worker handles at a time, whole texts at least.
SLICE = 1 << 18


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(c: Column) -> Column:
    """Unicode NFC. Plain ASCII texts never leave the JVM."""
    return F.coalesce(_nfc(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def pretokens(c: Column) -> Column:
    """Words of a text by the tokenizer's split pattern."""
    return F.regexp_extract_all(c, F.lit("(?U)" + WORD_PATTERN), 0)


def byte_alphabet() -> dict[int, str]:
    """Printable character per byte: visible Latin-1 bytes are themselves, the rest follow U+0100."""
    visible = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)}


def parse_merges(lines: Sequence[str]) -> list[tuple[str, str]]:
    """Merge rules in rank order from a merges file's lines."""
    rules = [line.split() for line in lines if line.strip() and not line.startswith("#version:")]
    return [(a, b) for a, b in rules]


def merge_vocabulary(merges: Sequence[tuple[str, str]]) -> dict[str, int]:
    """Smallest vocabulary for a merge list: the byte alphabet, then each merged symbol."""
    symbols = list(byte_alphabet().values()) + [a + b for a, b in merges]
    return {symbol: i for i, symbol in enumerate(dict.fromkeys(symbols))}


def _merge_word(symbols: list[str], ranks: Mapping[tuple[str, str], int]) -> list[str]:
    """Join the lowest-ranked neighbours, all of them at once, until none has a rank."""
    while len(symbols) > 1:
        ranked = [ranks[p] for p in zip(symbols, symbols[1:]) if p in ranks]
        if not ranked:
            break
        best = min(ranked)
        joined, held = [], None
        for symbol in symbols:
            if held is not None and ranks.get((held, symbol)) == best:
                joined.append(held + symbol)
                held = None
            else:
                if held is not None:
                    joined.append(held)
                held = symbol
        if held is not None:
            joined.append(held)
        symbols = joined
    return symbols


def _encoder(df: DataFrame, merges: Sequence[tuple[str, str]], vocab: Mapping[str, int], unk: int):
    """Function word -> ids for use inside tasks. The broadcast tables are the tokenizer's, fixed in size."""
    tables = df.sparkSession.sparkContext.broadcast(
        ({pair: i for i, pair in enumerate(merges)}, dict(vocab), byte_alphabet())
    )

    def make():
        ranks, codes, alphabet = tables.value

        def fresh(word: str) -> tuple[int, ...]:
            symbols = _merge_word([alphabet[b] for b in word.encode("utf-8")], ranks)
            return tuple([codes.get(s, unk) for s in symbols])

        known = lru_cache(WORD_MEMORY)(fresh)
        return lambda word: known(word) if len(word) <= REMEMBERED else fresh(word)

    return make


def _slices(lists: pa.ListArray, most: int = SLICE) -> Iterator[pa.ListArray]:
    """Consecutive rows that hold about ``most`` elements together; one row at least."""
    offsets, lo = lists.offsets.to_numpy(), 0
    while lo < len(lists):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lists.slice(lo, hi - lo)
        lo = hi


def _encode_batch(texts: pa.ListArray, encode: Callable[[str], tuple[int, ...]]) -> pa.ListArray:
    """Ids of texts given as word lists: each distinct word of the slice is encoded once, its
    ids are gathered for every use by array arithmetic. The lists hold no NULLs."""
    used = texts.flatten().dictionary_encode()
    coded = [encode(word) for word in used.dictionary.to_pylist()]
    sizes = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
    values = np.fromiter(chain.from_iterable(coded), dtype=np.int64, count=int(sizes.sum()))
    word = used.indices.to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(sizes[word])])
    first = np.cumsum(sizes) - sizes
    taken = np.empty(ends[-1], dtype=np.int64)
    # The places of the ids are made for some words at a time: a single text may be long.
    for lo in range(0, len(word), SLICE):
        some, n_ids = word[lo : lo + SLICE], sizes[word[lo : lo + SLICE]]
        a, b = ends[lo], ends[min(lo + SLICE, len(word))]
        taken[a:b] = values[np.repeat(first[some] - ends[lo : lo + len(some)], n_ids) + np.arange(a, b)]
    bounds = texts.offsets.to_numpy()
    return pa.ListArray.from_arrays(pa.array(ends[bounds - bounds[0]], pa.int32()), pa.array(taken))


def bpe_encode(df: DataFrame, merges: Sequence[tuple[str, str]], vocab: Mapping[str, int], text: str, unk: int = -1, out: str = "ids") -> DataFrame:
    """Add the token ids of a text column and their number ``n_tokens``; NULL text has no ids.

    A symbol outside the vocabulary gets ``unk``; byte-level vocabularies cover every text.
    """
    make = _encoder(df, merges, vocab, unk)

    @F.arrow_udf(ArrayType(LongType()))
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = make()
        for batch in batches:
            for texts in _slices(batch):
                yield _encode_batch(texts, encode)

    words = F.coalesce(pretokens(nfc(F.col(text))), F.array().cast("array<string>"))
    return spread(df).withColumn(out, ids(words)).withColumn("n_tokens", F.size(out).cast("bigint"))


def word_dictionary(df: DataFrame, merges: Sequence[tuple[str, str]], vocab: Mapping[str, int], text: str, unk: int = -1) -> DataFrame:
    """Distinct words with their number of uses and their ids, each word encoded once.

    Counting combines before the shuffle, so common words cost one row per task.
    """
    counted = spread(df.select(text)).select(F.explode(pretokens(nfc(F.col(text)))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n_uses"))
    make = _encoder(df, merges, vocab, unk)

    @F.pandas_udf(ArrayType(LongType()))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make()
        for batch in batches:
            yield batch.map(encode)

    return counted.withColumn("ids", ids(F.col("word")))


def _arrays(rows: pa.ListArray) -> Iterator[np.ndarray | None]:
    """Each row's numbers, None for a NULL row; a NULL inside a row becomes NaN."""
    values, bounds = rows.values.to_numpy(zero_copy_only=False), rows.offsets.to_numpy()
    for known, a, b in zip(rows.is_valid().to_pylist(), bounds, bounds[1:]):
        yield values[a:b] if known else None


def bpe_decode(df: DataFrame, vocab: Mapping[str, int], ids: str = "ids", out: str = "text") -> DataFrame:
    """Text of token ids; broken byte runs show the replacement character.

    NULL ids give NULL; a NULL or unknown id inside an array raises.
    """
    back = {char: b for b, char in byte_alphabet().items()}
    known = {i: bytes(back[c] for c in s if c in back) for s, i in vocab.items()}
    table = df.sparkSession.sparkContext.broadcast(known)

    @F.arrow_udf(StringType())
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = table.value
        for batch in batches:
            for rows in _slices(batch):
                texts = (None if xs is None else b"".join([pieces[i] for i in xs.tolist()]).decode("utf-8", "replace") for xs in _arrays(rows))
                yield pa.array(texts, pa.string())

    return df.withColumn(out, decode(F.col(ids)))
