"""Text and path columns used by cleaning, prompting and reporting."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and markers whose matches must stay as users know them.
CODE_FENCE = r"(?is)^\s*```(?:json|js|javascript)?\s*\n(.*)\n```\s*$"
IMAGE_REFERENCE = r"<image_start>\[([^\]]+)\]<image_end>"
IMAGE_PLACEHOLDER = "<IMAGE_PLACEHOLDER>"
THOUGHT_LABEL = r"THOUGHT\s*\d+:\s*"
HTML_TAG = r"(?i)</?[a-z][a-z0-9]*\b[^>]*>"
FRAME_NUMBER = r"_(\d+).jpg$"
TURN_START = r"<\|im_start\|>"
TURN_END = "<|im_end|>"

# The white space characters of Unicode and the four separators next to them.
WHITE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Remove white space, Unicode included, from both ends; only the ends are looked at."""
    return F.trim(c, F.lit(WHITE))


def strip_right(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITE))


def strip_quotes(c: Column) -> Column:
    """Strip white space, then the runs of double quotes at both ends."""
    return F.trim(strip(c), F.lit('"'))


def squeeze(c: Column) -> Column:
    """Every run of white space becomes one blank."""
    return F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " ")


def present(c: Column) -> Column:
    """True for a non-NULL, non-empty text; blank-only text is present."""
    return F.coalesce(F.length(c) > 0, F.lit(False))


def join_path(base: Column | str, rel: Column) -> Column:
    """Join two paths with one slash; an absolute second path wins."""
    base = F.lit(base) if isinstance(base, str) else base
    joined = F.when(base.endswith("/") | (base == ""), F.concat(base, rel)).otherwise(
        F.concat(base, F.lit("/"), rel)
    )
    return F.when(rel.startswith("/"), rel).otherwise(joined)


def with_rules(instruction: Column, rules: Column, style: str) -> Column:
    """Put the rules before the instruction.

    ``train``: non-empty rules, blank between. ``inference``: any non-NULL rules, even
    empty, blank between. ``judge``: non-empty rules, newline between.
    """
    if style == "train":
        return F.when(present(rules), F.concat(rules, F.lit(" "), instruction)).otherwise(instruction)
    if style == "inference":
        return F.when(rules.isNotNull(), F.concat(rules, F.lit(" "), instruction)).otherwise(instruction)
    if style == "judge":
        return F.when(present(rules), F.concat(rules, F.lit("\n"), instruction)).otherwise(instruction)
    raise ValueError(f"unknown style {style!r}: use train, inference or judge")


def wrap_think(c: Column, strip_text: bool = True) -> Column:
    return F.concat(F.lit("<think>"), strip(c) if strip_text else c, F.lit("</think>"))


def split_think(c: Column, after_think: bool = False) -> Column:
    """The model's turn: after the first start marker, before the first end marker.

    NULL where a marker needed is missing. ``after_think`` keeps only the stripped part
    behind ``</think>`` unless that part is empty.
    """
    turn = F.get(F.split(F.substring_index(c, TURN_END, 1), TURN_START), 1)
    if not after_think:
        return turn
    tail = F.get(F.split(turn, "</think>"), 1)
    return F.when(tail == "", turn).when(tail.isNotNull(), strip(tail))


def strip_code_fence(c: Column) -> Column:
    """Content of a text that is one Markdown code fence; other texts unchanged."""
    return F.regexp_replace(c, CODE_FENCE, "$1")


def image_refs(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(IMAGE_REFERENCE), 1)


def mask_image_refs(c: Column) -> Column:
    return F.regexp_replace(c, IMAGE_REFERENCE, IMAGE_PLACEHOLDER)


def drop_thought_labels(c: Column) -> Column:
    return F.regexp_replace(c, THOUGHT_LABEL, "")


def canonicalize(c: Column, keep: str | None = None) -> Column:
    """Delete ASCII punctuation, squeeze white space, strip; ``keep`` survives as a whole."""
    def bare(part: Column) -> Column:
        return F.regexp_replace(part, r"\p{Punct}+", "")  # Java: the 32 ASCII characters

    if keep:
        quoted = "\\Q" + keep.replace("\\E", "\\E\\\\E\\Q") + "\\E"
        c = F.array_join(F.transform(F.split(c, quoted), bare), keep)
    else:
        c = bare(c)
    return strip(squeeze(c))


def fill_prompt(template: str, **values: Column) -> Column:
    """Fill ``{name}`` holes of a template in one pass; NULL values count as empty.

    The holes are found in the template only, so braces inside the values are plain text.
    """
    pieces: list[Column] = []
    for literal, field, _, _ in string.Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if field is not None:
            pieces.append(F.coalesce(values[field].cast("string"), F.lit("")))
    return F.concat(*pieces) if pieces else F.lit("")


def item_key(name: Column, idx: Column) -> Column:
    """``name#idx``; a missing part reads ``None`` as users of the result files know it."""
    return F.concat_ws(
        "#", F.coalesce(name.cast("string"), F.lit("None")), F.coalesce(idx.cast("string"), F.lit("None"))
    )


def output_path(folder: str, name: Column, idx: Column, suffix: str = "png") -> Column:
    return F.concat(
        F.lit(folder.rstrip("/") + "/"), name.cast("string"), F.lit("/"), idx.cast("string"), F.lit(f".{suffix}")
    )


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, HTML_TAG, "")


# A number or nothing before the first unit letter, as a browser reads numbers.
_UNIT_HEAD = r"(?U)^[\s\x1c-\x1f]*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)?[\s\x1c-\x1f]*([MB])"


def number_text(v: Column) -> Column:
    """Shortest plain decimal text of a double: 1500000.0 -> 1500000, 2.50 -> 2.5."""
    text = v.try_cast("decimal(38,10)").cast("string")
    return F.regexp_replace(text, r"\.?0+$", "")


def parse_units(c: Column) -> Column:
    """``1.5M`` -> 1500000 and ``7B`` -> 7000000000; M is looked for before B.

    The number is the text before the unit, blank meaning 0; anything else leaves the
    value as it is.
    """
    number, unit = F.regexp_extract(c, _UNIT_HEAD, 1), F.regexp_extract(c, _UNIT_HEAD, 2)
    value = F.when(number == "", F.lit(0.0)).otherwise(number.try_cast("double"))
    scaled = number_text(value * F.when(unit == "M", F.lit(1e6)).otherwise(F.lit(1e9)))
    # A leading number and B do not count when an M comes later.
    counts = (unit == "M") | ((unit == "B") & ~c.contains("M"))
    return F.when(counts, F.coalesce(scaled, c)).otherwise(c)


def frame_number(path: Column) -> Column:
    """Digits of ``_<digits>.jpg`` at the end of the file name, else -1."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    digits = F.regexp_extract(name, FRAME_NUMBER, 1)
    return F.coalesce(F.when(digits != "", digits.try_cast("bigint")), F.lit(-1).cast("bigint"))


def data_url(content: Column, mime: str = "image/jpeg") -> Column:
    """Base64 data URL; session setting ``chunkBase64String`` must be off (see session.py)."""
    return F.concat(F.lit(f"data:{mime};base64,"), F.base64(content))


