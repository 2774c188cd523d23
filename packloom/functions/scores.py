"""Scores from judge answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The score label patterns, the singular one tried first. Between the label
# and the first digits may stand stars, a colon, blanks and commas, so the first match is
# the first label that has a number.
FINAL_SCORE = r"(?i)Final Score\*?\*?:?\s*[*\s,]*(\d+)"
FINAL_SCORES = r"(?i)Final Scores\*?\*?:?\s*[*\s,]*(\d+)"

# Weight of each dimension in the item score.
W_CONSISTENCY, W_REASONING, W_PLAUSIBILITY = 0.3, 0.5, 0.2
TOP_SCORE = 5


def first_score(answer: Column) -> Column:
    """First number after the first score label that has digits; NULL if none."""
    number = lambda pattern: F.regexp_extract(answer, pattern, 1).try_cast("bigint")
    return F.coalesce(number(FINAL_SCORE), number(FINAL_SCORES))


def weighted_score(consistency: Column, reasoning: Column, plausibility: Column) -> Column:
    return (
        F.lit(W_CONSISTENCY) * consistency + F.lit(W_REASONING) * reasoning + F.lit(W_PLAUSIBILITY) * plausibility
    )


def complete(consistency: Column, reasoning: Column, plausibility: Column) -> Column:
    """1 if all three are top scores, 0 if not, NULL if any is missing."""
    known = consistency.isNotNull() & reasoning.isNotNull() & plausibility.isNotNull()
    top = (consistency == TOP_SCORE) & (reasoning == TOP_SCORE) & (plausibility == TOP_SCORE)
    return F.when(known, top.cast("int"))


def to_percent(score: Column) -> Column:
    """1..5 onto 0..100."""
    return F.lit(25) * (score - F.lit(1))
