"""Offsets, positions, weights and masks of packed segments.

Input is the segment table with its pack: ``shard, pack_no, pack_pos, sample_id,
seg_pos, kind, n_tokens, enable_cfg, loss`` and optionally ``dropped, split_start,
split_end, frame_delta``. Windows run per pack, whose size the token budget bounds; one
exchange on the pack serves the per-sample windows too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import normal, uniform

PACK = ["shard", "pack_no"]
IN_SAMPLE = [*PACK, "pack_pos"]

# Dropout probability per condition kind.
P_TEXT, P_VIT, P_VAE = 0.1, 0.4, 0.1


def _optional(df: DataFrame, name: str, default: Column) -> Column:
    return F.coalesce(F.col(name), default) if name in df.columns else default


def _dropped(df: DataFrame) -> Column:
    return _optional(df, "dropped", F.lit(False))


def _segment_key() -> Column:
    return F.concat(F.col("sample_id").cast("string"), F.lit(":"), F.col("seg_pos").cast("string"))


def packed_segments(segments: DataFrame, packs: DataFrame) -> DataFrame:
    """Segments with the pack of their sample; samples that were not packed fall away."""
    placed = packs.filter(F.col("status") == "packed").drop("status", "length")
    return segments.join(placed, "sample_id")


def drop_conditions(segments: DataFrame, seed: int, p_text: float = P_TEXT, p_vit: float = P_VIT, p_vae: float = P_VAE) -> DataFrame:
    """Flag condition segments as ``dropped`` with a probability per kind.

    The rows stay, since a dropped image still moves the position counter.
    """
    p = F.when(F.col("kind") == "text", F.lit(p_text)).when(F.col("kind") == "vit_image", F.lit(p_vit)).otherwise(F.lit(p_vae))
    hit = uniform(seed, _segment_key(), "drop") < p
    return segments.withColumn("dropped", (F.col("enable_cfg") == 1) & hit)


def segment_length(df: DataFrame) -> Column:
    """Places a segment takes in the pack: its tokens and two marks, none when dropped."""
    return F.when(_dropped(df), F.lit(0)).otherwise(F.col("n_tokens") + 2).cast("bigint")


def kept_lengths(segments: DataFrame) -> DataFrame:
    """Full and kept length per sample, for packing with dropout."""
    return segments.groupBy("sample_id").agg(
        F.sum(F.col("n_tokens") + 2).cast("bigint").alias("length"), F.sum(segment_length(segments)).alias("kept")
    )


def segment_offsets(df: DataFrame) -> DataFrame:
    """Add ``seg_len`` and ``start``, the segment's first index in its pack."""
    w = Window.partitionBy(*PACK).orderBy("pack_pos", "seg_pos").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("seg_len", segment_length(df)).withColumn(
        "start", (F.sum("seg_len").over(w) - F.col("seg_len")).cast("bigint")
    )


def rope_step(df: DataFrame) -> Column:
    """Positions a segment moves on: text by its length (not at all when dropped), a vit image
    by 1, a vae image by its ``frame_delta``, else by 1 as a condition and 0 as a target."""
    dropped, delta = _dropped(df), _optional(df, "frame_delta", F.lit(None).cast("bigint"))
    return (
        F.when(F.col("kind") == "text", F.when(dropped, F.lit(0)).otherwise(F.col("n_tokens") + 2))
        .when((F.col("kind") == "vit_image") | dropped, F.lit(1))
        .otherwise(F.coalesce(delta, F.when(F.col("loss") == 0, F.lit(1)).otherwise(F.lit(0))))
        .cast("bigint")
    )


def rope_positions(df: DataFrame) -> DataFrame:
    """Add ``rope``, the segment's first position id; every sample starts at 0."""
    step = rope_step(df)
    w = Window.partitionBy(*IN_SAMPLE).orderBy("seg_pos").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_step", step).withColumn("rope", (F.sum("_step").over(w) - F.col("_step")).cast("bigint")).drop("_step")


def loss_weight(m: Column, mode: str = "square") -> Column:
    """Weight of each of m loss places: 1/sqrt(m), 1/m or 1."""
    x = m.cast("double")
    if mode == "square":
        w = F.lit(1.0) / F.sqrt(x)
    elif mode == "sample":
        w = F.lit(1.0) / x
    elif mode == "token":
        w = F.lit(1.0)
    else:
        raise ValueError(f"unknown mode {mode!r}: use square, sample or token")
    return F.when(m == 0, F.lit(0.0)).otherwise(w)


def loss_weights(df: DataFrame, mode: str = "square") -> DataFrame:
    """Loss stretch per text segment with loss: ``first``, ``last`` and ``weight``.

    It covers the opening mark and the text; needs ``start`` from ``segment_offsets``.
    """
    m = F.col("n_tokens") + 1
    return df.filter((F.col("kind") == "text") & (F.col("loss") == 1) & ~_dropped(df)).select(
        *IN_SAMPLE,
        "sample_id",
        "seg_pos",
        F.col("start").alias("first"),
        (F.col("start") + m - 1).alias("last"),
        loss_weight(m, mode).alias("weight"),
    )


def loss_tokens(weights: DataFrame) -> DataFrame:
    """One row per loss place."""
    return weights.select(*PACK, F.explode(F.sequence("first", "last")).alias("index"), "weight")


def with_splits(df: DataFrame) -> DataFrame:
    """Add ``split_no``: segments count on unless ``split_start`` is false."""
    starts = _optional(df, "split_start", F.lit(True)).cast("int")
    w = Window.partitionBy(*IN_SAMPLE).orderBy("seg_pos").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("split_no", F.sum(starts).over(w).cast("bigint"))


def _timestep(seed: int, sample_id: Column, split_no: Column, loss: Column) -> Column:
    key = F.concat(sample_id.cast("string"), F.lit(":"), split_no.cast("string"))
    step = normal(uniform(seed, key, "t1"), uniform(seed, key, "t2"))
    return F.when(loss == 1, step).otherwise(F.lit(float("-inf")))


def with_timesteps(df: DataFrame, seed: int) -> DataFrame:
    """Add ``timestep``: one normal draw per split for target images, minus infinity for
    condition images, NULL for other segments."""
    value = _timestep(seed, F.col("sample_id"), F.col("split_no"), F.col("loss"))
    return with_splits(df).withColumn("timestep", F.when((F.col("kind") == "vae_image") & ~_dropped(df), value))


def timesteps(df: DataFrame, seed: int) -> DataFrame:
    """Noise step per vae image; ``first``/``last`` are its places without its marks."""
    return (
        with_timesteps(df, seed)
        .filter(F.col("timestep").isNotNull())
        .select(
            *IN_SAMPLE,
            "sample_id",
            "seg_pos",
            "split_no",
            "loss",
            "timestep",
            (F.col("start") + 1).alias("first"),
            (F.col("start") + F.col("n_tokens")).alias("last"),
        )
    )


def attention_mode(df: DataFrame) -> Column:
    """causal for text, noise for a target image that is no video frame, full otherwise."""
    delta = _optional(df, "frame_delta", F.lit(None).cast("bigint"))
    noisy = (F.col("kind") == "vae_image") & (F.col("loss") == 1) & delta.isNull()
    return F.when(F.col("kind") == "text", "causal").when(noisy, "noise").otherwise("full")


def splits(df: DataFrame) -> DataFrame:
    """Splits of each sample: length and attention mode, the first segment deciding the mode."""
    kept = df.filter(~_dropped(df))
    numbered = with_splits(kept.withColumn("_mode", attention_mode(kept)).withColumn("_len", F.col("n_tokens") + 2))
    return numbered.groupBy(*IN_SAMPLE, "sample_id", "split_no").agg(
        F.sum("_len").cast("bigint").alias("split_len"), F.min_by("_mode", "seg_pos").alias("mode")
    )


def visible_pairs(split_rows: DataFrame) -> DataFrame:
    """Number of visible (query, key) pairs per sample.

    Inside a split n(n+1)/2 if causal, else n squared; towards earlier splits n times
    the places of those that are not noise. A running sum, so no pair is ever formed.
    """
    n = F.col("split_len")
    open_len = F.when(F.col("mode") == "noise", F.lit(0)).otherwise(n)
    before = Window.partitionBy(*IN_SAMPLE).orderBy("split_no").rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col("mode") == "causal", F.expr("split_len * (split_len + 1) div 2")).otherwise(n * n)
    return (
        split_rows.withColumn("_open", open_len)
        .withColumn("_pairs", own + n * F.coalesce(F.sum("_open").over(before), F.lit(0)))
        .groupBy(*IN_SAMPLE, "sample_id")
        .agg(F.sum("_pairs").cast("bigint").alias("visible"), F.sum(n).cast("bigint").alias("sample_len"))
    )


def patch_positions(height: Column, width: Column, patch: int, side: int, interpolate: bool = False) -> Column:
    """Position id of every patch, row by row, on a grid ``side`` wide.

    Plain: row * side + column. ``interpolate`` stretches the image over the whole grid.
    """
    rows, cols = F.floor(height / patch).cast("bigint"), F.floor(width / patch).cast("bigint")

    def places(n: Column) -> Column:
        line = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(line, lambda i: F.call_function("div", i * side, n)) if interpolate else line

    if not interpolate:  # the places of a row are consecutive
        ends = lambda r: F.sequence(r * side, r * side + cols - 1)
        return F.flatten(F.transform(places(rows), lambda r: F.when(cols > 0, ends(r)).otherwise(F.array().cast("array<bigint>"))))
    # Row and column places are bound once per image, then only added.
    grid = F.array(F.struct(F.transform(places(rows), lambda r: r * side).alias("r"), places(cols).alias("c")))
    return F.get(F.transform(grid, lambda g: F.flatten(F.transform(g["r"], lambda r: F.transform(g["c"], lambda c: r + c)))), 0)


def pad_stats(images: DataFrame, packs: DataFrame, max_total: int) -> DataFrame:
    """Padding cost per pack: common image size, padded and real area, tail length.

    ``images``: vae image segments with ``width`` and ``height``. ``packs``: places used
    per pack (``shard, pack_no, used``). The tail is one more causal split.
    """
    area = images.groupBy(*PACK).agg(
        F.count(F.lit(1)).alias("n_images"),
        F.max("height").alias("max_height"),
        F.max("width").alias("max_width"),
        F.sum(F.col("width") * F.col("height")).cast("bigint").alias("real_area"),
    )
    return packs.join(area, PACK, "left").select(
        *PACK,
        "used",
        (F.lit(max_total) - F.col("used")).cast("bigint").alias("tail_pad"),
        F.coalesce("n_images", F.lit(0)).alias("n_images"),
        "max_height",
        "max_width",
        "real_area",
        (F.col("n_images") * F.col("max_height") * F.col("max_width")).alias("padded_area"),
    )


@dataclass(frozen=True)
class SpecialTokens:
    bos: int
    eos: int
    start_of_image: int
    end_of_image: int


def _laid(segs: Column) -> Column:
    """One walk over a pack's sorted segments: ``total`` places and, per segment, ``at``.

    Offsets run over the pack; positions and split numbers start anew with each sample.
    ``opens_sample`` and ``opens_split`` mark the first kept segment of each.
    """
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    begin = F.struct(
        zero.alias("total"), zero.alias("rope"), zero.alias("split"), none.alias("sample"), none.alias("kept"),
        F.array().cast("array<struct<start:bigint,rope:bigint,split:bigint,opens_sample:boolean,opens_split:boolean>>").alias("at"),
    )

    def step(acc: Column, s: Column) -> Column:
        same = acc["sample"].eqNullSafe(s["pack_pos"])
        rope = F.when(same, acc["rope"]).otherwise(zero)
        split = F.when(same, acc["split"]).otherwise(zero) + s["starts"]
        head = ~s["dropped"] & ~acc["kept"].eqNullSafe(s["pack_pos"])
        place = F.struct(
            acc["total"].alias("start"), rope.alias("rope"), split.alias("split"), head.alias("opens_sample"),
            (head | (~s["dropped"] & (s["starts"] == 1))).alias("opens_split"),
        )
        return F.struct(
            (acc["total"] + s["seg_len"]).alias("total"), (rope + s["step"]).alias("rope"), split.alias("split"),
            s["pack_pos"].alias("sample"), F.when(s["dropped"], acc["kept"]).otherwise(s["pack_pos"]).alias("kept"),
            F.concat(acc["at"], F.array(place)).alias("at"),
        )

    return F.aggregate(segs, begin, step)


def pack_records(df: DataFrame, special: SpecialTokens, mode: str = "square", seed: int | None = None) -> DataFrame:
    """One nested row per pack, the form trainers read.

    Needs packed segments with ``text_ids`` (array, NULL for images). Offsets, positions,
    splits and lengths come from one walk over the pack's segments; places are written out
    after it, so nothing wider than a segment is sorted. Targets are trained with a draw
    by ``seed``, else by the column ``timestep``, else not at all. Fields of a kind the
    pack lacks are NULL; a pack whose segments were all dropped has no row.
    """
    big = lambda c: c.cast("bigint")
    empty, no_weights = F.array().cast("array<bigint>"), F.array().cast("array<double>")
    optional = [F.col(c).cast("bigint").alias(c) for c in ("width", "height") if c in df.columns]
    segment = F.struct(
        big(F.col("pack_pos")).alias("pack_pos"),
        "seg_pos",
        "sample_id",
        "kind",
        big(F.col("n_tokens")).alias("n"),
        (F.col("loss") == 1).alias("loss"),
        _dropped(df).alias("dropped"),
        segment_length(df).alias("seg_len"),
        rope_step(df).alias("step"),
        _optional(df, "split_start", F.lit(True)).cast("bigint").alias("starts"),
        attention_mode(df).alias("mode"),
        (_optional(df, "special_token_loss", F.lit(0)) == 1).alias("special_loss"),
        big(_optional(df, "special_token_label", F.lit(None).cast("bigint"))).alias("special_label"),
        _optional(df, "timestep", F.lit(float("-inf"))).alias("timestep"),
        F.coalesce(F.col("text_ids"), empty).alias("ids"),
        *optional,
    )
    # The rows are narrow and the arrays made from them wide. A number given here keeps
    # adaptive execution from merging the packs into few tasks by their narrow size.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packs = df.select(*PACK, segment.alias("_seg")).repartition(parts, *PACK)
    packs = packs.groupBy(*PACK).agg(F.array_sort(F.collect_list("_seg")).alias("_segs"))
    packs = packs.withColumn("_laid", _laid(F.col("_segs"))).where(F.col("_laid.total") > 0)
    both = F.zip_with("_segs", F.col("_laid.at"), lambda s, at: F.struct(s.alias("s"), at.alias("at")))
    packs = packs.select(
        *PACK, F.col("_laid.total").alias("sequence_length"), F.filter(both, lambda x: ~x["s"]["dropped"]).alias("_kept")
    )

    lit = lambda x: F.array(F.lit(x).cast("bigint"))
    run = lambda a, b: F.when(b >= a, F.sequence(a, b)).otherwise(empty)
    start, end = lambda x: x["at"]["start"], lambda x: x["at"]["start"] + x["s"]["n"] + 1
    of = lambda kind, then, otherwise=empty: lambda x: F.when(x["s"]["kind"] == kind, then(x)).otherwise(otherwise)
    inner = lambda x: run(start(x) + 1, end(x) - 1)
    text_loss = lambda x: (x["s"]["kind"] == "text") & x["s"]["loss"]
    with_special = lambda then, special_part, otherwise=empty: lambda x: F.concat(
        F.when(text_loss(x), then(x)).otherwise(otherwise), F.when(x["s"]["special_loss"], special_part(x)).otherwise(otherwise)
    )
    if seed is None:
        drawn = lambda x: x["s"]["timestep"]
    else:
        drawn = lambda x: _timestep(seed, x["s"]["sample_id"], x["at"]["split"], x["s"]["loss"].cast("int"))
    fields = {
        "packed_text_ids": of("text", lambda x: F.concat(lit(special.bos), x["s"]["ids"], lit(special.eos)), F.concat(lit(special.start_of_image), lit(special.end_of_image))),
        "packed_text_indexes": lambda x: F.when(x["s"]["kind"] == "text", run(start(x), end(x))).otherwise(F.array(start(x), end(x))),
        "packed_position_ids": lambda x: F.when(
            x["s"]["kind"] == "text", run(x["at"]["rope"], x["at"]["rope"] + x["s"]["n"] + 1)
        ).otherwise(F.array_repeat(x["at"]["rope"], (x["s"]["n"] + 2).cast("int"))),
        "packed_label_ids": with_special(lambda x: F.concat(x["s"]["ids"], lit(special.eos)), lambda x: F.array(x["s"]["special_label"])),
        "ce_loss_indexes": with_special(lambda x: run(start(x), end(x) - 1), lambda x: F.array(end(x))),
        "ce_loss_weights": with_special(
            lambda x: F.array_repeat(loss_weight(x["s"]["n"] + 1, mode), (x["s"]["n"] + 1).cast("int")), lambda x: F.array(F.lit(1.0)), no_weights
        ),
        "packed_vae_token_indexes": of("vae_image", inner),
        "packed_timesteps": of("vae_image", lambda x: F.array_repeat(drawn(x), x["s"]["n"].cast("int")), no_weights),
        "mse_loss_indexes": lambda x: F.when((x["s"]["kind"] == "vae_image") & x["s"]["loss"], inner(x)).otherwise(empty),
        "packed_vit_token_indexes": of("vit_image", inner),
        "vit_token_seqlens": of("vit_image", lambda x: F.array(x["s"]["n"])),
    }
    for c in ("width", "height"):
        if c in df.columns:
            fields[f"vae_{c}s"] = of("vae_image", lambda x, c=c: F.array(x["s"][c]))
    always = {"packed_text_ids", "packed_text_indexes", "packed_position_ids"}

    def gathered(name: str) -> Column:
        whole = F.flatten(F.transform("_kept", fields[name]))
        return whole if name in always else F.get(F.filter(F.array(whole), lambda a: F.size(a) > 0), 0)

    def lengths(opens: str) -> Column:
        """Distances between the offsets where samples or splits open."""
        heads = F.transform(F.filter("_kept", lambda x: x["at"][opens]), start)
        return F.zip_with(F.concat(F.slice(heads, 2, F.size(heads)), F.array("sequence_length")), heads, lambda b, a: b - a)

    return packs.select(
        *PACK,
        "sequence_length",
        lengths("opens_sample").alias("sample_lens"),
        lengths("opens_split").alias("split_lens"),
        F.transform(F.filter("_kept", lambda x: x["at"]["opens_split"]), lambda x: x["s"]["mode"]).alias("attn_modes"),
        *[gathered(k).alias(k) for k in fields],
    )
