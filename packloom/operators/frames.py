"""Which frames of a video to use. Frame numbers only; nothing is decoded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import uniform, uniform_int
from ..functions.text import frame_number
from .rank import value_rank

_NONE = "array<bigint>"


def _empty() -> Column:
    return F.array().cast(_NONE)


def _range(n: Column) -> Column:
    """0 .. n-1, empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)).otherwise(_empty())


def _floor_div(a: Column, b: Column) -> Column:
    return F.floor(a / b).cast("bigint")


def random_frames(vlen: Column, n: Column, seed: int, key: Column) -> Column:
    """Sorted sample of n distinct frame numbers.

    Frames are ordered by a keyed draw and the first n taken: uniform without replacement.
    """
    tagged = F.transform(
        _range(vlen), lambda i: F.struct(uniform(seed, key, F.concat(F.lit("f"), i.cast("string"))).alias("u"), i.alias("i"))
    )
    taken = F.slice(F.array_sort(tagged), F.lit(1), F.greatest(F.least(n, vlen), F.lit(0)).cast("int"))
    return F.array_sort(F.transform(taken, lambda s: s["i"]))


def interval_frames(vlen: Column, n: Column, mode: str, fix_start: int | None = None, seed: int = 0, key: Column | None = None) -> Column:
    """n frame numbers, one per equal interval of the video, padded with the last one.

    ``middle`` takes each interval's centre, ``fix_start`` its start plus a constant,
    ``rand`` a draw that never hits the interval's last frame. If any interval has a
    single frame, ``rand`` falls back to a sorted random subset.
    """
    vlen, n = vlen.cast("bigint"), n.cast("bigint")
    k = F.least(n, vlen)
    lo = lambda i: _floor_div(i * vlen, k)
    hi = lambda i: _floor_div((i + 1) * vlen, k) - 1
    if mode == "rand":
        if key is None:
            raise ValueError("mode rand needs a key column for its draws")
        drawn = F.transform(
            _range(k), lambda i: uniform_int(uniform(seed, key, F.concat(F.lit("i"), i.cast("string"))), lo(i), hi(i))
        )
        crowded = F.exists(_range(k), lambda i: lo(i) >= hi(i))
        frames = F.when(crowded, random_frames(vlen, k, seed, key)).otherwise(drawn)
    elif fix_start is not None:
        frames = F.transform(_range(k), lambda i: lo(i) + F.lit(fix_start))
    elif mode == "middle":
        frames = F.transform(_range(k), lambda i: _floor_div(lo(i) + hi(i), F.lit(2)))
    else:
        raise ValueError(f"unknown mode {mode!r}: use middle or rand, or give fix_start")
    padding = F.transform(_range(n - k), lambda _: F.element_at(frames, -1))
    return F.when((k > 0) & (n > k), F.concat(frames, padding)).otherwise(frames)


def fps_frames(vlen: Column, fps: Column, rate: float, max_frames: int = -1) -> Column:
    """Centres of the 1/rate-second stretches, half-even rounded, inside the video."""
    delta = 1.0 / rate
    duration = vlen.cast("double") / fps
    # Same count as a half-open float range: points from delta/2 up to duration + delta/2.
    count = F.ceil(((duration + F.lit(delta / 2)) - F.lit(delta / 2)) / F.lit(delta)).cast("bigint")
    step = (delta / 2 + delta) - delta / 2  # the spacing such a range really has
    centres = F.transform(_range(count), lambda i: F.bround((F.lit(delta / 2) + i * F.lit(step)) * fps).cast("bigint"))
    inside = F.filter(centres, lambda f: f < vlen)
    return F.slice(inside, 1, max_frames) if max_frames > 0 else inside


def spread_frames(vlen: Column, n: Column) -> Column:
    """n frame numbers evenly spread from first to last, both included, truncated."""
    last = vlen.cast("bigint") - 1
    return F.transform(
        _range(n), lambda i: F.when(n > 1, _floor_div(i * last, F.greatest(n - 1, F.lit(1)))).otherwise(F.lit(0)).cast("bigint")
    )


def step_frames(vlen: Column, fps: Column, target: float) -> Column:
    """Every ``fps/target``-th frame before the last one, truncated."""
    step = fps.cast("double") / F.lit(float(target))
    count = F.ceil((vlen - 1) / step)
    return F.transform(_range(count), lambda i: F.floor(i * step).cast("bigint"))


def clip_length(vlen: Column, fps: Column, start: Column, end: Column) -> Column:
    """Frames in the clip; the whole video where no clip is given."""
    return F.when(start.isNotNull(), F.floor((end - start) * fps)).otherwise(vlen).cast("bigint")


def clip_frames(frames: Column, fps: Column, start: Column) -> Column:
    """Move clip-relative frame numbers to their place in the whole video."""
    shift = F.coalesce(F.floor(start * fps), F.lit(0)).cast("bigint")
    return F.transform(frames, lambda f: f + shift)


def plan_rows(df: DataFrame, keys: list[str], frames: Column) -> DataFrame:
    """One row per planned frame with its place in the plan."""
    return df.select(*keys, F.posexplode(frames).alias("slot", "frame")).withColumn("slot", F.col("slot").cast("bigint"))


def folder_frames(
    files: DataFrame, folder: str = "folder", path: str = "path", max_frames: int = 8, min_frames: int = 4, seed: int = 0, mode: str = "middle"
) -> DataFrame:
    """Frames of image folders: files in frame-number order, thinned only when too many.

    Equal numbers have no order of their own (a listing has none): the md5 of the path
    decides. The wanted count is drawn per folder from [min_frames, max_frames]. Ranks and folder
    lengths come from a range exchange, so a folder of any length is spread over tasks; the
    plan itself is a few numbers per folder.
    """
    numbered = files.withColumn("frame_no", frame_number(F.col(path)))
    ranked = value_rank(numbered, F.col("frame_no"), F.col(path), [folder], rank="_at", total="_len", shuffle_ties=True)
    wanted = uniform_int(uniform(seed, F.col(folder), "n_frames"), F.lit(min_frames), F.lit(max_frames + 1))
    folders = (
        files.groupBy(folder)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_want", wanted)
        .filter(F.col("_n") > F.col("_want"))
        .select(
            F.col(folder).alias("_folder"),
            F.posexplode(interval_frames(F.col("_n"), F.col("_want"), mode, seed=seed, key=F.col(folder))).alias("_slot", "_frame"),
        )
    )
    thin = F.col("_len") > wanted
    whole = ranked.filter(~thin).select(folder, path, F.col("_at").alias("slot"))
    chosen = (
        ranked.filter(thin)
        .join(folders, (F.col(folder) == F.col("_folder")) & (F.col("_at") == F.col("_frame")))
        .select(folder, path, F.col("_slot").cast("bigint").alias("slot"))
    )
    return whole.unionByName(chosen)
