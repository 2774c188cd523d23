"""Words and word windows of whole Arrow text columns, as NumPy arrays.

A word is a run of bytes other than blank, tab, line feed, vertical tab, form feed and
carriage return. All six are single UTF-8 bytes, so words are found on the bytes without
decoding. Hashes only route rows and choose candidates; every operator compares the words
themselves (or full shingle sets) before it decides.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator
from functools import lru_cache
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

T = TypeVar("T")

# Spark regular expression of one word, as the contracts state it.
WORD = r"[^\x20\x09-\x0D]+"

# Texts are hashed in slices of about so many bytes; the temporaries are some 60 bytes per byte.
SLICE_BYTES = 1 << 20

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


_KEPT: dict[Hashable, object] = {}


def kept(key: Hashable, make: Callable[[], T]) -> T:
    """What a worker keeps from task to task: the last thing asked for, so operators that follow each other do not add up."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Release what earlier operators left in this worker; called where a task of another operator begins."""
    _KEPT.clear()


def text_slices(texts: list[str | None], size: int) -> Iterator[list[str | None]]:
    """Consecutive whole texts of about ``size`` characters together, at least one."""
    lo = n = 0
    for k, text in enumerate(texts):
        n += len(text or "")
        if n >= size:
            yield texts[lo : k + 1]
            lo, n = k + 1, 0
    if lo < len(texts):
        yield texts[lo:]


def split_words(text: str | None) -> list[str]:
    """The words of one text; NULL has none."""
    if not text:
        return []
    for blank in "\t\n\x0b\x0c\r":
        text = text.replace(blank, " ")
    return [word for word in text.split(" ") if word]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of the values over all 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, dtype=np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


@lru_cache(2)
def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(int(_BASE), -1, 1 << 64)
    return _powers(int(_BASE), n), _powers(inverse, n)


class WordBatch:
    """Word boundaries and hashes of consecutive texts.

    ``first[d]:first[d + 1]`` are the words of text d; ``hashes`` has one value per word.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray) -> None:
        word = _IS_WORD[data]
        begin, end = word.copy(), word.copy()
        begin[1:] &= ~word[:-1]
        end[:-1] &= ~word[1:]
        edges = bounds[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        begin[edges] |= word[edges]
        end[edges - 1] |= word[edges - 1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(starts, bounds)
        size = 1 << max(SLICE_BYTES.bit_length(), int(len(data) + 1).bit_length())
        powers, inverses = _tables(size)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
        self.hashes = mixed((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))

    def windows(self, size: int) -> np.ndarray:
        """Hash of the ``size`` words from each word on; runs past a text's end are the caller's to leave out."""
        n = max(0, len(self.hashes) - size + 1)
        out = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            out = out * _STEP + self.hashes[k : k + n]
        return mixed(out)


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and text bounds of a string column; NULL reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def word_batches(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, WordBatch]]:
    """(first text, text after the last, words) for slices of whole texts of a column."""
    data, bounds = texts_of(column)
    n, lo = len(bounds) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(bounds, bounds[lo] + SLICE_BYTES, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, WordBatch(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
        lo = hi
