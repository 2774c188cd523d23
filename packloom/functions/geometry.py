"""Image size arithmetic; no pixels are touched."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .draws import uniform, uniform_int


@dataclass(frozen=True)
class ResizeRule:
    """Limits of a resize: longest side, shortest side, grid step, pixel budget."""

    max_size: int
    min_size: int
    stride: int
    max_pixels: int | None = 14 * 14 * 9 * 1024


# The size limits of the published training and inference settings.
TRAIN_VAE = ResizeRule(1024, 512, 16)
TRAIN_VIT = ResizeRule(518, 224, 14)
INFER_OUTPUT = ResizeRule(1024, 512, 16, None)  # size of the picture to make: no pixel budget
INFER_VIT = ResizeRule(980, 378, 14)
CHAT_VIT = ResizeRule(980, 378, 14, 2007040)


def _on_grid(value: Column, stride: int) -> Column:
    step = F.lit(float(stride))
    return F.greatest(step, F.bround(value / step) * step)


def _scaled(side: Column, scale: Column, stride: int) -> Column:
    return _on_grid(F.bround(side * scale), stride)


def resized(width: Column, height: Column, rule: ResizeRule, n_images: Column | int = 1) -> Column:
    """``struct<width,height>`` after the resize.

    Three steps: fit both side limits; if over the pixel budget shared by ``n_images``,
    shrink by the area ratio; if still longer than the limit, shrink to it. All rounding
    is half-to-even.
    """
    count = F.lit(float(n_images)) if isinstance(n_images, int) else n_images.cast("double")

    def fit(pair: Column) -> Column:
        w, h = pair["width"], pair["height"]
        scale = F.least(F.lit(float(rule.max_size)) / F.greatest(w, h), F.lit(1.0))
        scale = F.greatest(scale, F.lit(float(rule.min_size)) / F.least(w, h))
        return both(w, h, scale)

    def both(w: Column, h: Column, scale: Column) -> Column:
        return F.struct(
            _scaled(w, scale, rule.stride).alias("width"), _scaled(h, scale, rule.stride).alias("height")
        )

    def within_pixels(pair: Column) -> Column:
        w, h = pair["width"], pair["height"]
        budget = F.lit(float(rule.max_pixels)) / count
        return F.when(w * h > budget, both(w, h, budget / (w * h))).otherwise(pair)

    def within_side(pair: Column) -> Column:
        w, h = pair["width"], pair["height"]
        limit = F.lit(float(rule.max_size))
        longest = F.greatest(w, h)
        return F.when(longest > limit, both(w, h, limit / longest)).otherwise(pair)

    steps = [fit] + ([within_pixels] if rule.max_pixels else []) + [within_side]
    # One-element array + transform binds each step's result once instead of
    # repeating the previous step's expression four times over.
    pair = F.array(F.struct(width.cast("double").alias("width"), height.cast("double").alias("height")))
    for step in steps:
        pair = F.transform(pair, step)
    out = F.get(pair, 0)
    return F.struct(out["width"].cast("bigint").alias("width"), out["height"].cast("bigint").alias("height"))


def image_tokens(width: Column, height: Column, stride: int) -> Column:
    """Tokens of a resized image: whole pixels per squared stride."""
    return F.floor(width * height / F.lit(stride * stride)).cast("bigint")


def drawn_size(seed: int, key: Column, lo: int, hi: int) -> Column:
    """Frame count drawn uniformly from [lo, hi]."""
    return uniform_int(uniform(seed, key, "n_frames"), F.lit(lo), F.lit(hi + 1))
