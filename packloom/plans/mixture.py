"""A mixture configuration as one DataFrame graph: sources to limits, segments, lengths, draws and packs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import ResizeRule, image_tokens, resized
from ..operators.packing import PackRule, pack
from ..operators.rank import shuffle_rank
from ..operators.registry import FeedGroup, build_source
from ..operators.sampling import mix, take_first
from ..session import staged
from . import feeds as _feeds  # noqa: F401  (registers the feeds the library brings along)

MARKS = 2  # places a segment takes beside its tokens


def image_counts(width: Column, height: Column, kind: Column, group: FeedGroup) -> Column:
    """Tokens of an image segment after the resize of its group and kind; NULL for an unknown size."""

    def count(rule: ResizeRule | None) -> Column:
        if rule is None:
            return F.lit(None).cast("bigint")
        size = resized(width, height, rule)
        return image_tokens(size["width"], size["height"], rule.stride)

    known = width.isNotNull() & height.isNotNull()
    return F.when(known & (kind == "vit_image"), count(group.vit_image)).when(known, count(group.image))


def group_lengths(
    group: FeedGroup, sources: Mapping[str, DataFrame], images: DataFrame, key: str, text_tokens: Callable[[Column], Column]
) -> DataFrame:
    """(source, key, length) of a group's samples: their limits, segments, and tokens from texts and image sizes.

    ``images`` has path, width and height. Texts are counted where they are read and go no
    further; only image paths are joined. A sample with an image of unknown size, or of a
    kind the group has no resize rule for, is left out, as one whose image cannot be read is.
    """
    limits = [*group.num_used_data, *[None] * len(group.dataset_names)]
    parts = []
    for name, limit in zip(group.dataset_names, limits):
        if name not in sources:
            raise KeyError(f"group {group.name!r} names an unknown data set {name!r}")
        rows = sources[name].withColumn("source", F.lit(name))
        rows = take_first(rows, limit, "source", key, seed=group.shuffle_seed if group.shuffle_lines else None)
        segments = build_source(group.name, rows, keys=["source", key], **group.options)
        text = F.coalesce(text_tokens(F.col("text")), F.lit(0)).cast("bigint")
        parts.append(segments.select("source", key, "kind", "image", F.when(F.col("kind") == "text", text).alias("n_tokens")))
    segments = reduce(DataFrame.unionByName, parts)
    sizes = images.select(F.col("path").alias("image"), "width", "height")
    pictures = segments.where("kind <> 'text'").join(sizes, "image", "left")
    pictures = pictures.withColumn("n_tokens", image_counts(F.col("width"), F.col("height"), F.col("kind"), group))
    counted = segments.where("kind = 'text'").select("source", key, "n_tokens").unionByName(pictures.select("source", key, "n_tokens"))
    total = counted.groupBy("source", key).agg(F.sum(F.col("n_tokens") + MARKS).alias("length"), F.count("n_tokens").alias("_known"), F.count(F.lit(1)).alias("_all"))
    return total.where("_known = _all").select("source", key, F.col("length").cast("bigint").alias("length"))


def training_feed(
    groups: Sequence[FeedGroup],
    sources: Mapping[str, DataFrame],
    images: DataFrame,
    n_draws: int,
    n_shards: int,
    text_tokens: Callable[[Column], Column],
    rule: PackRule = PackRule(),
    key: str = "sample_id",
    seed: int = 42,
) -> DataFrame:
    """(shard, pack_no, pack_pos, status, length, draw_id, group, source, key): what each trainer reads.

    Every draw takes the next sample of a group chosen by weight, a group that ends starts
    again; draw d goes to shard d modulo ``n_shards``. Mandatory groups open every pack by a
    sample of theirs, which has no draw. Lengths are written once; what follows moves ids
    and lengths only.
    """
    lengths = [group_lengths(g, sources, images, key, text_tokens).select(F.lit(g.name).alias("group"), "source", key, "length") for g in groups]
    units = staged(reduce(DataFrame.unionByName, lengths), "lengths").withColumn("unit", F.concat_ws("|", "group", "source", F.col(key).cast("string")))
    feed = staged(shuffle_rank(units, "unit", seed, within=["group"], rank="place").drop("unit"), "feed")
    who = lambda draw: F.struct(draw.cast("bigint").alias("draw_id"), "group", "source", key).alias("sample")
    drawn = mix(feed, {g.name: g.weight for g in groups}, n_draws, seed, group="group")
    draw = F.col("draw_id")
    samples = drawn.select(F.pmod(draw, F.lit(n_shards)).alias("shard"), F.floor(draw / n_shards).cast("bigint").alias("seq"), who(draw), "length")
    number = {g.name: i for i, g in enumerate(groups) if g.is_mandatory}
    heads = None
    if number:
        of = F.element_at(F.create_map(*[F.lit(x) for pair in number.items() for x in pair]), F.col("group"))
        heads = feed.where(F.col("group").isin(list(number))).select(of.alias("group_no"), F.col("place").alias("seq"), who(F.lit(None)), "length")
    packs = pack(samples, rule, sample="sample", heads=heads, n_shards=n_shards, groups=tuple(number.values()))
    return packs.select("shard", "pack_no", "pack_pos", "status", "length", "sample_id.*")
