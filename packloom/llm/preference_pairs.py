"""Preference formatting: one prompt, two masked completions.

The longest common turn prefix of a chosen and a rejected conversation is rendered once as
the prompt; what follows in each is its completion. A completion's mask says which of its
characters count for the loss: the assistant's words and their end mark.

All of it is column expressions. A conversation is one output value, so its turns are
gathered in one row; pairs are joined by conversation id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED_ROLE = "assistant"
END = "<|end|>\n"


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(END))), "")


def _spans(turns: Column) -> Column:
    """[begin, end) character ranges of a rendered completion that count for the loss, as ``b-e,b-e``."""

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(_head(t))
        end = begin + F.length(t["text"]) + len(END)
        span = F.concat(begin.cast("string"), F.lit("-"), end.cast("string"))
        spans = F.when(t["role"] == TRAINED_ROLE, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.aggregate(turns, start, step, lambda acc: F.array_join(acc["spans"], ","))


def conversations(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(conv, turns): each conversation's distinct turns as an array in order of turn, role, text."""
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # Equal turns of a conversation, however often they come, are one before they are gathered.
    plain = turns.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("conv"), turn.alias("t")).distinct()
    return plain.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def formatted(pairs: DataFrame) -> DataFrame:
    """(pair_id, n_common, prompt, chosen, chosen_mask, rejected, rejected_mask) from (pair_id, chosen, rejected) turn arrays.

    Turns are common while role and text agree; turn numbers may differ. If one side is NULL
    (a conversation without a partner), the other is a completion to an empty prompt and the
    missing side's columns are NULL. If one side is the other's beginning, its completion is
    empty.
    """
    least = F.least(F.size("chosen"), F.size("rejected"))
    same = F.transform(F.sequence(F.lit(0), F.greatest(least - 1, F.lit(0))), lambda i: (F.get("chosen", i)["role"] == F.get("rejected", i)["role"]) & (F.get("chosen", i)["text"] == F.get("rejected", i)["text"]))
    stop = F.array_position(same, False)
    common = F.when(F.col("chosen").isNull() | F.col("rejected").isNull() | (least == 0), 0).when(stop > 0, stop - 1).otherwise(least)
    # explode keeps the count in a column of its own.
    counted = pairs.select("pair_id", "chosen", "rejected", F.explode(F.array(common.cast("int"))).alias("n"))
    rest = lambda side: F.slice(F.col(side), F.col("n") + 1, F.greatest(F.size(side), F.lit(0)))
    whole = F.coalesce("chosen", "rejected")
    return counted.select(
        "pair_id", F.col("n").cast("bigint").alias("n_common"), _rendered(F.slice(whole, 1, F.col("n"))).alias("prompt"),
        _rendered(rest("chosen")).alias("chosen"), _spans(rest("chosen")).alias("chosen_mask"),
        _rendered(rest("rejected")).alias("rejected"), _spans(rest("rejected")).alias("rejected_mask"),
    )


def neighbour_pairs(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Pairs of conversations 2i (chosen) and 2i + 1 (rejected), as turn arrays; a missing side is NULL."""
    each = conversations(turns, key)
    side = lambda odd, name: each.where(F.pmod("conv", F.lit(2)) == odd).select(F.floor(F.col("conv") / 2).cast("bigint").alias("pair_id"), F.col("turns").alias(name))
    return side(0, "chosen").join(side(1, "rejected"), "pair_id", "full_outer")


_RENDER = "array_to_string(list_transform({x}, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), '')"


def _side(name: str) -> str:
    """Completion and mask of one side, turn by turn."""
    return f"""
{name}_t AS (SELECT pair_id, generate_subscripts({name}, 1) AS i, unnest({name}) AS t, n FROM n),
{name}_l AS (SELECT pair_id, i, t.role AS role, length(t.role) + 5 AS head, length(t.text) + 8 AS body FROM {name}_t WHERE i > n),
{name}_p AS (SELECT *, sum(head + body) OVER (PARTITION BY pair_id ORDER BY i) AS e FROM {name}_l),
{name}_m AS (SELECT pair_id, string_agg((e - body)::BIGINT || '-' || e::BIGINT, ',' ORDER BY i) AS mask FROM {name}_p WHERE role = 'assistant' GROUP BY pair_id),"""


ORACLE = f"""
WITH d AS (SELECT DISTINCT conv_id AS conv, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv, list({{'role': role, 'text': text}} ORDER BY turn, role, text) AS turns FROM d GROUP BY conv),
p AS (SELECT coalesce(a.conv, b.conv - 1) // 2 AS pair_id, a.turns AS chosen, b.turns AS rejected
  FROM (SELECT * FROM c WHERE conv % 2 = 0) a FULL JOIN (SELECT * FROM c WHERE conv % 2 <> 0) b ON b.conv = a.conv + 1),
n AS (SELECT *, CASE WHEN chosen IS NULL OR rejected IS NULL THEN 0 ELSE
    coalesce(list_min(list_filter(range(1, 1 + least(len(chosen), len(rejected))), lambda i: chosen[i] <> rejected[i])) - 1, least(len(chosen), len(rejected))) END AS n FROM p),
{_side('chosen')}{_side('rejected')}
z AS (SELECT 1)
SELECT n.pair_id::BIGINT AS pair_id, n::BIGINT AS n_common, {_RENDER.format(x='coalesce(chosen, rejected)[1:n]')} AS prompt,
  {_RENDER.format(x='chosen[n + 1:]')} AS chosen, CASE WHEN chosen IS NOT NULL THEN coalesce(cm.mask, '') END AS chosen_mask,
  {_RENDER.format(x='rejected[n + 1:]')} AS rejected, CASE WHEN rejected IS NOT NULL THEN coalesce(rm.mask, '') END AS rejected_mask
FROM n LEFT JOIN chosen_m cm ON cm.pair_id = n.pair_id LEFT JOIN rejected_m rm ON rm.pair_id = n.pair_id
"""
