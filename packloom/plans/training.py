"""Segments and lengths to packed, laid-out training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import layout as ly
from ..operators.packing import PackRule, pack
from ..operators.rank import even_chunks
from ..operators.segments import sample_lengths
from ..session import staged


def placed_segments(
    segments: DataFrame,
    rule: PackRule,
    n_shards: int,
    seed: int = 42,
    dropout: bool = False,
) -> DataFrame:
    """Shuffle samples into even shards, pack each shard, give each segment its pack.

    Choose ``n_shards`` to grow with the sample count; a shard is one sequential task
    over its ids and lengths. Lengths and packs, three narrow columns each, are written
    to the shared folder: the segments are summed once, and a lost executor costs no more
    than its own tasks.
    """
    if dropout:
        segments = ly.drop_conditions(segments, seed)
        lengths = ly.kept_lengths(segments)
    else:
        lengths = sample_lengths(segments)
    shards = even_chunks(staged(lengths, "lengths"), "sample_id", n_shards, seed, chunk="shard", position="seq")
    packs = staged(pack(shards, rule, kept="kept" if dropout else None), "packs")
    return ly.packed_segments(segments, packs)


def pack_segments(segments: DataFrame, rule: PackRule, n_shards: int, seed: int = 42, dropout: bool = False) -> DataFrame:
    """Packed segments with their offsets and positions, one row each."""
    return ly.rope_positions(ly.segment_offsets(placed_segments(segments, rule, n_shards, seed, dropout)))


def training_records(segments: DataFrame, rule: PackRule, n_shards: int, special: ly.SpecialTokens, seed: int = 42, dropout: bool = False) -> DataFrame:
    """Nested pack rows ready to be written as Parquet."""
    return ly.pack_records(placed_segments(segments, rule, n_shards, seed, dropout), special, seed=seed)
