"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a column expression on one text (lengths, symbols, stop words, lines,
repeated word windows), every rule a row of a table; no user function, no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import WORD

# The symbols the contract counts, and white space between words.
SYMBOLS = "#*$%&|<>"
BLANK = r"[\x20\x09-\x0D]"
# Marks cut from words before they are compared with stop words.
MARKS = ".,;:!?"
WINDOW = 5

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in is that it for as was with be by on not he this are or his from at which but have an had they you were "
    "their one all we can her has there been if more when will would who so no "
    "der die und das von zu mit den im nicht ein eine sich auf für ist dem "
    "le les des et est du dans qui au pour pas sur plus par une ce avec "
    "de la que el en y los del se las por un para con una su al lo como más pero sus"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep texts whose ``measure`` is in [low, high]; texts of fewer than ``from_words`` words pass."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


# Rules beside the contract's base: each measure is a ratio of two whole numbers.
RULES = (
    Rule("word_length", "chars_per_word", 2.5, 12.0),
    Rule("symbols", "symbols_per_word", None, 0.1),
    Rule("shouting", "exclamations_per_word", None, 0.3),
    Rule("stop_words", "stop_words_per_word", 0.06, None, 20),
    Rule("repeated_lines", "repeated_lines_per_line", None, 0.5),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words covered by a window of five words that is in the array more than once.

    Window hashes tell which texts hold no repeat at all. Only the others sort their
    windows by hash, compare neighbours of equal hash as text, and measure the union of
    the repeated ones.
    """
    places = F.sequence(F.lit(0), F.size(words) - WINDOW)
    hashes = F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))

    def text(window: Column) -> Column:
        return F.array_join(F.slice(words, window["i"] + 1, WINDOW), " ")

    def same(a: Column, b: Column) -> Column:
        return F.coalesce((a["h"] == b["h"]) & (text(a) == text(b)), F.lit(False))

    def ordered(h: Column) -> Column:
        return F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def found(s: Column) -> Column:
        repeats = F.filter(s, lambda w, k: same(w, F.get(s, k - 1)) | same(w, F.get(s, k + 1)))
        return F.sort_array(F.transform(repeats, lambda w: w["i"]))

    def covered(at: Column) -> Column:
        gaps = F.transform(F.sequence(F.lit(1), F.size(at)), lambda k: F.coalesce(F.least(F.get(at, k) - F.get(at, k - 1), F.lit(WINDOW)), F.lit(WINDOW)))
        return F.when(F.size(at) > 0, F.aggregate(gaps, F.lit(0), lambda a, b: a + b)).otherwise(0)

    repeats = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(let(ordered(h), found), covered))
    return F.when(F.size(words) <= WINDOW, 0).otherwise(let(hashes, repeats))


def measures(text: Column) -> Column:
    """Struct of the base measures of one text; NULL reads as empty."""
    text = F.coalesce(text, F.lit(""))

    def of(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n", -1), lambda line: line.rlike(WORD))
        # A text cut at its white space has empty strings at its ends only.
        cut = F.array_remove(F.split(t, rf"{BLANK}+", -1), "")
        words = let(
            cut,
            lambda ws: F.struct(
                F.size(ws).cast("bigint").alias("n"), F.length(F.array_join(ws, "")).cast("bigint").alias("chars"),
                repeated_words(ws).cast("bigint").alias("repeat"),
            ),
        )
        counted = let(lines, lambda ls: F.struct(F.size(ls).cast("bigint").alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint").alias("dup")))
        plain = F.split(F.lower(t), rf"(?:{BLANK}|[{MARKS}])+")
        return F.struct(
            words.alias("words"),
            F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("bigint").alias("n_symbols"),
            (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))).cast("bigint").alias("n_exclamations"),
            F.size(F.filter(plain, lambda w: w.isin(STOP_WORDS))).cast("bigint").alias("n_stop_words"),
            counted.alias("lines"),
        )

    return let(text, of)


def failed(rule: Rule, measure: Column, n_words: Column) -> Column:
    """Whether a text breaks a rule."""
    out = F.lit(False)
    if rule.low is not None:
        out = out | (measure < rule.low)
    if rule.high is not None:
        out = out | (measure > rule.high)
    return out & (n_words >= rule.from_words) & (n_words > 0)


def quality_rules(df: DataFrame, rules: Sequence[Rule] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, base measures, ``base_failed``, the broken rules' names, ``kept``.

    NULL and empty texts have no words and fail the base. Rows with equal or NULL keys are
    judged each for itself; further columns are not read, so their names cannot clash.
    """
    m = F.col("m")
    ratio = lambda a, b: a / F.when(b > 0, b)
    known = {
        "chars_per_word": ratio(m["words"]["chars"], m["words"]["n"]),
        "symbols_per_word": ratio(m["n_symbols"], m["words"]["n"]),
        "exclamations_per_word": ratio(m["n_exclamations"], m["words"]["n"]),
        "stop_words_per_word": ratio(m["n_stop_words"], m["words"]["n"]),
        "repeated_lines_per_line": ratio(m["lines"]["dup"], m["lines"]["n"]),
    }
    n = m["words"]["n"]
    base = (n < MIN_WORDS) | (100 * m["words"]["repeat"] > MAX_REPEAT_PERCENT * n)
    broken = F.array_compact(F.array(*[F.when(F.coalesce(failed(r, known[r.measure], n), F.lit(False)), F.lit(r.name)) for r in rules]))
    # explode keeps the measures in one column of their own, so no later projection repeats them.
    measured = df.select(F.col(key), F.explode(F.array(measures(F.col(text)))).alias("m"))
    return measured.select(
        key, n.alias("n_words"), m["words"]["chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"),
        m["lines"]["dup"].alias("n_dup_lines"), m["words"]["repeat"].alias("n_repeat_words"),
        base.alias("base_failed"), F.array_join(broken, ",").alias("broken_rules"), (~base & (F.size(broken) == 0)).alias("kept"),
    )


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT rid, i, array_to_string(ws[i:i+4], ' ') AS g FROM w, unnest(range(1, len(ws) - 3)) AS u(i)),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g),
v AS (SELECT rid, i - lag(i) OVER (PARTITION BY rid ORDER BY i) AS gap FROM c WHERE n > 1),
r AS (SELECT rid, sum(least(5, coalesce(gap, 5))) AS n FROM v GROUP BY rid),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
k AS (SELECT rid, count(*) AS n, count(DISTINCT line) AS u FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (
  SELECT w.rid, doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    length(t) - length(replace(t, '!', '')) AS n_exclamations,
    len(list_filter(string_split(lower(regexp_replace(t, '[.,;:!?\x20\x09-\x0D]+', ' ', 'g')), ' '), lambda x: x IN ({_STOP}))) AS n_stop,
    coalesce(k.n, 0) AS n_lines, coalesce(k.n - k.u, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM w LEFT JOIN k ON k.rid = w.rid LEFT JOIN r ON r.rid = w.rid),
j AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    CASE WHEN word_chars < 2.5 * n_words OR word_chars > 12 * n_words THEN 'word_length' END AS r1,
    CASE WHEN n_words > 0 AND n_symbols / n_words > 0.1::DOUBLE THEN 'symbols' END AS r2,
    CASE WHEN n_words > 0 AND n_exclamations / n_words > 0.3::DOUBLE THEN 'shouting' END AS r3,
    CASE WHEN n_words >= 20 AND n_stop / n_words < 0.06::DOUBLE THEN 'stop_words' END AS r4,
    CASE WHEN n_lines > 0 AND n_dup_lines / n_lines > 0.5 THEN 'repeated_lines' END AS r5
  FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  concat_ws(',', r1, r2, r3, r4, r5) AS broken_rules,
  NOT base_failed AND concat_ws(',', r1, r2, r3, r4, r5) = '' AS kept
FROM j
"""
