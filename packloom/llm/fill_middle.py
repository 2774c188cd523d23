"""Fill-in-the-middle samples: documents cut in three and put together again around markers.

A text is cut into chunks where a rolling hash of its last bytes says so, so passages that
documents share fall into the same chunks wherever they stand. A worker remembers each chunk
by its content: the number of code points that begin in it, whether a marker stands in it,
and the bytes at its edges. Summaries are reused only for equal bytes. Adding them up gives
the length of a document in code points and the chunk that holds a cut; only that chunk is
looked at again. Markers across chunk edges are found in the joined edge bytes.

Python returns two byte offsets per document; texts are put together and taken apart again
by built-in functions.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import _tables, mixed, texts_of

# Marker texts before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")

WINDOW = 16  # bytes that decide on a cut
MASK = np.uint64(511)  # one cut in 512 bytes on average
LONGEST = 1 << 14  # bytes of a chunk at most: texts without cuts are cut here
SLICE_BYTES = 1 << 20  # texts are hashed in slices of about so many bytes
MEMO_BYTES = 16 << 20  # content kept by a worker, twice


class Memo:
    """Summaries by content, in two generations of bounded size."""

    def __init__(self, most: int = MEMO_BYTES) -> None:
        self.most, self.size = most, 0
        self.young: dict[bytes, tuple] = {}
        self.old: dict[bytes, tuple] = {}

    def summary(self, chunk: bytes, markers: tuple[bytes, ...], edge: int) -> tuple:
        """(code points that begin here, holds a marker, first bytes, last bytes)."""
        found = self.young.get(chunk)
        if found is None:
            # Looked up by hash, taken only if the bytes are equal, as any Python mapping does.
            found = self.old.get(chunk)
            if found is None:
                found = (_points(chunk), any(m in chunk for m in markers), chunk[:edge], chunk[-edge:] if edge else b"")
            if self.size > self.most:
                self.old, self.young, self.size = self.young, {}, 0
            self.young[chunk] = found
            self.size += len(chunk) + 200
        return found


def _starts(chunk: bytes) -> np.ndarray:
    """True where a code point begins: at every byte but 10xxxxxx."""
    return (np.frombuffer(chunk, dtype=np.uint8) & 0xC0) != 0x80


def _points(chunk: bytes) -> int:
    return int(np.count_nonzero(_starts(chunk)))


_MEMO = Memo()  # of this worker


def chunk_ends(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Byte offsets where chunks of consecutive texts end; every text's end is one."""
    powers, inverses = _tables(SLICE_BYTES + WINDOW + 1)
    found = [np.zeros(0, dtype=np.int64)]
    # A window's hash is the same in whatever slice it is computed, so long texts need no long tables.
    for lo in range(0, len(data), SLICE_BYTES):
        part = data[max(0, lo - WINDOW + 1) : lo + SLICE_BYTES]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers[: len(part)], out=sums[1:])
        hashes = mixed((sums[WINDOW:] - sums[:-WINDOW]) * inverses[: max(0, len(part) + 1 - WINDOW)])
        found.append(np.flatnonzero((hashes & MASK) == 0) + (max(0, lo - WINDOW + 1) + WINDOW))
    ends = np.concatenate(found)
    # A window that reaches into the text before decides nothing.
    ends = ends[ends - bounds[np.searchsorted(bounds, ends, side="left") - 1] >= WINDOW]
    ends = np.union1d(ends, bounds[1:])
    gaps = np.diff(ends, prepend=0)
    far = np.flatnonzero(gaps > LONGEST)
    if len(far):
        more = [np.arange(ends[i] - gaps[i] + LONGEST, ends[i], LONGEST) for i in far]
        ends = np.union1d(ends, np.concatenate(more))
    return ends


def cuts_of(column: pa.Array, first: pa.Array, second: pa.Array, markers: tuple[str, ...] = MARKERS, memo: Memo | None = None) -> pa.Array:
    """Per text: code points, whether a marker is in it, and two cuts in code points and in bytes.

    ``first`` and ``second`` are numbers; modulo the code points plus one they give the
    cuts, the smaller one first. NULL texts read as empty.
    """
    memo = memo or _MEMO
    marks = tuple(m.encode() for m in markers)
    edge = max(map(len, marks)) - 1
    data, bounds = texts_of(column)
    rows = []
    lo = 0
    while lo < len(bounds) - 1:
        hi = int(np.searchsorted(bounds, bounds[lo] + SLICE_BYTES, side="right")) - 1
        hi = min(len(bounds) - 1, max(hi, lo + 1))
        part = data[bounds[lo] : bounds[hi]]
        edges = bounds[lo : hi + 1] - bounds[lo]
        ends, raw = chunk_ends(part, edges).tolist() if len(part) else [], part.tobytes()
        k = 0
        for d in range(hi - lo):
            start, end = int(edges[d]), int(edges[d + 1])
            begins, before, points, marked, tail = [], [], 0, False, b""
            at = start
            while at < end:
                while ends[k] <= at:
                    k += 1
                chunk = raw[at : ends[k]]
                count, inside, head, last = memo.summary(chunk, marks, edge)
                joint = tail + head
                marked = marked or inside or any(m in joint for m in marks)
                tail = last if len(chunk) >= edge else (tail + chunk)[-edge:]
                begins.append(at)
                before.append(points)
                points += count
                at = ends[k]
            a, b = first[lo + d].as_py() % (points + 1), second[lo + d].as_py() % (points + 1)
            places = []
            for cut in (min(a, b), max(a, b)):
                if cut == points:
                    places.append(end - start)
                    continue
                j = bisect_right(before, cut) - 1
                stop = begins[j + 1] if j + 1 < len(begins) else end
                places.append(begins[j] - start + int(np.flatnonzero(_starts(raw[begins[j] : stop]))[cut - before[j]]))
            rows.append((points, marked, min(a, b), max(a, b), *places))
        lo = hi
    names = ("n", "marked", "from_point", "to_point", "from_byte", "to_byte")
    kinds = (pa.int64(), pa.bool_(), *[pa.int64()] * 4)
    columns = list(zip(*rows)) or [()] * 6
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


CUTS = "n bigint, marked boolean, from_point bigint, to_point bigint, from_byte bigint, to_byte bigint"


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers below 2 ** 32 from sha256 of ``seed:key``; a NULL key reads as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def fill_in_middle(
    df: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    seed: int = 1,
    percent: int = 90,
    spm_percent: int = 20,
    markers: tuple[str, str, str] = MARKERS,
) -> DataFrame:
    """Add n, form, prefix_chars, middle_chars and output.

    ``percent`` of the texts become samples, ``spm_percent`` of those with the suffix first
    (``spm``), the others with the prefix first (``psm``); the rest, empty texts and texts
    that hold a marker stay as they are (``plain``, no lengths). Draws come from the key
    alone, so rows of the same key are cut by the same numbers; a NULL key is an empty one.
    NULL texts read as empty. The added names replace columns of the same name.
    """

    @F.arrow_udf(f"struct<{CUTS}>")
    def cut(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        return cuts_of(texts, first, second, markers)

    whole = F.coalesce(F.col(text), F.lit(""))
    h = draws(F.col(key), seed)
    keyed = df.withColumns({f"__h{i + 1}": c for i, c in enumerate(h)}).withColumn("__text", whole)
    known = keyed.withColumn("__cut", cut("__text", "__h1", "__h2"))
    plain = (F.col("__cut.n") == 0) | F.col("__cut.marked") | (F.col("__h3") % 100 >= percent)
    form = F.when(plain, F.lit("plain")).when(F.col("__h4") % 100 < spm_percent, F.lit("spm")).otherwise(F.lit("psm"))
    raw, a, b = F.col("__text").cast("binary"), F.col("__cut.from_byte").cast("int"), F.col("__cut.to_byte").cast("int")
    piece = lambda at, n: F.substring(raw, at + 1, n).cast("string")
    prefix, middle, suffix = piece(F.lit(0), a), piece(a, b - a), piece(b, F.octet_length("__text") - b)
    p, s, m = (F.lit(x) for x in markers)
    output = (
        F.when(F.col("form") == "plain", F.col("__text"))
        .when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
        .otherwise(F.concat(s, suffix, p, prefix, m, middle))
    )
    cut_at = lambda c: F.when(F.col("form") != "plain", c)
    added = {
        "n": F.col("__cut.n"),
        "prefix_chars": cut_at(F.col("__cut.from_point")),
        "middle_chars": cut_at(F.col("__cut.to_point") - F.col("__cut.from_point")),
    }
    out = known.withColumn("form", form).withColumn("output", output).withColumns(added)
    kept = [c for c in df.columns if c not in ("n", "form", "prefix_chars", "middle_chars", "output")]
    return out.select(*kept, "n", "form", "prefix_chars", "middle_chars", "output")


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text an output was made of; it holds no marker, so the first of each one splits it."""
    p, s, m = markers

    def three(first: str, second: str) -> tuple[Column, Column, Column]:
        i = F.instr(output, F.lit(second))
        rest = F.substr(output, i + len(second))
        j = F.instr(rest, F.lit(m))
        return F.substr(output, F.lit(len(first) + 1), i - 1 - len(first)), F.substr(rest, F.lit(1), j - 1), F.substr(rest, j + len(m))

    prefix, suffix, middle = three(p, s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = three(s, p)
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(prefix, middle, suffix))


ORACLE = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(cast(doc_id AS VARCHAR), '')) AS hex FROM documents),
d AS (SELECT doc_id, text, length(text) AS n, ('0x' || substr(hex, 1, 8))::BIGINT AS h1, ('0x' || substr(hex, 9, 8))::BIGINT AS h2,
  ('0x' || substr(hex, 17, 8))::BIGINT AS h3, ('0x' || substr(hex, 25, 8))::BIGINT AS h4 FROM h),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
t AS (SELECT *, substr(text, 1, a) AS p, substr(text, a + 1, b - a) AS m, substr(text, b + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM t"""
