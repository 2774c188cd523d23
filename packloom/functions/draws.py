"""Keyed random draws.

A draw depends on (seed, key, tag) only, so a retried task, another partitioning
or another engine sees the same number. Nothing here uses ``rand()``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed: int | str, key: Column) -> Column:
    """Hex md5 of ``seed|key``: the sort key of every seeded shuffle."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit(""))))


def uniform(seed: int | str, key: Column, tag: str | Column) -> Column:
    """Uniform double in [0, 1) from the first 48 bits of an md5."""
    tag_col = F.lit(tag) if isinstance(tag, str) else tag.cast("string")
    text = F.concat(
        F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("")), F.lit("|"), tag_col
    )
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def uniform_int(u: Column, lo: Column, hi: Column) -> Column:
    """Integer uniform in [lo, hi) from a uniform double."""
    return (lo + F.floor(u * (hi - lo))).cast("bigint")


def choice(u: Column, values: Column) -> Column:
    """Uniform element of an array, NULL for an empty one."""
    return F.get(values, F.floor(u * F.size(values)).cast("int"))


def normal(u1: Column, u2: Column) -> Column:
    """Standard normal from two uniform draws (Box-Muller); 1-u1 keeps the log finite."""
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1)) * F.cos(F.lit(2.0) * F.pi() * u2)
