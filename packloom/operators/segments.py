"""Samples to text and image segments, and their token counts.

One row per segment. ``order`` columns, never row order, carry the sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.draws import choice, uniform, uniform_int

# The opening text of a reasoning edit and the markers in chats.
REASONING_PROMPT = (
    "You should first think about the planning process in the mind and then generate the image. "
    "The planning process is enclosed within <think> </think> tags, "
    "i.e. <think> planning process here </think> image here"
)
IMAGE_MARK = "<image>"
VIDEO_MARK = "<video>"

SEGMENT = (
    "struct<seg_pos:bigint,kind:string,text:string,image:string,enable_cfg:int,loss:int,"
    "special_token_loss:int,special_token_label:int>"
)


def _segment(pos, kind: str, text: Column | None = None, image: Column | None = None, enable_cfg=1, loss=0) -> Column:
    none = F.lit(None).cast("string")
    pos = F.lit(pos) if isinstance(pos, int) else pos
    return F.struct(
        pos.cast("bigint").alias("seg_pos"),
        F.lit(kind).alias("kind"),
        (text if text is not None else none).alias("text"),
        (image.cast("string") if image is not None else none).alias("image"),
        F.lit(enable_cfg).alias("enable_cfg"),
        (F.lit(loss) if isinstance(loss, int) else loss.cast("int")).alias("loss"),
        F.lit(0).alias("special_token_loss"),
        F.lit(None).cast("int").alias("special_token_label"),
    )


def chat_segments(chat: DataFrame, keys: list[str], turn: str = "turn", speaker: str = "speaker", value: str = "value", n_images: str = "n_images") -> DataFrame:
    """Segments of chat turns, ordered by (turn, piece, part).

    Human turns are cut at the image marks: non-blank pieces stripped, an image behind a
    piece while more text follows and the sample has that many images (counted anew in
    each turn). Model turns carry loss. Other speakers vanish.
    """
    def cell(part: int, kind: str, text: Column | None, loss: int) -> Column:
        return F.struct(
            F.lit(part).cast("bigint").alias("part"),
            F.lit(kind).alias("kind"),
            (text if text is not None else F.lit(None).cast("string")).alias("text"),
            F.lit(0).alias("enable_cfg"),
            F.lit(loss).alias("loss"),
        )

    v = F.col(value)
    marked = (F.col(speaker) == "human") & v.contains(IMAGE_MARK)
    pieces = F.when(marked, F.split(v, IMAGE_MARK)).otherwise(F.array(v))
    rows = (
        chat.filter(F.col(speaker).isin("human", "gpt"))
        .withColumn("_marked", marked)
        .withColumn("_n", F.size(pieces))
        .select("*", F.posexplode(pieces).alias("_at", "_text"))
        .withColumn("piece", F.col("_at").cast("bigint"))
    )
    stripped = tx.strip(F.col("_text"))
    text = F.when(F.col("_marked"), F.when(stripped != "", stripped)).otherwise(F.col("_text"))
    image = F.col("_marked") & (F.col("piece") < F.col("_n") - 1) & (F.col("piece") < F.col(n_images))
    rows = rows.withColumn("_out", text)
    cells = F.when(
        F.col(speaker) == "gpt", F.array(cell(0, "text", F.col("_out"), 1))
    ).otherwise(F.array(cell(0, "text", F.col("_out"), 0), cell(1, "vit_image", None, 0)))
    shown = F.filter(
        cells, lambda x: ((x["kind"] == "text") & x["text"].isNotNull()) | ((x["kind"] == "vit_image") & image)
    )
    return rows.withColumn("_shown", shown).select(*keys, turn, "piece", F.inline("_shown"))


def expand_video_marker(chat: DataFrame, sample: str, n_frames: str, is_video: Column, turn: str = "turn", value: str = "value") -> DataFrame:
    """Put one image mark per frame for the video mark of a video chat's first turn.

    A video chat whose first turn lacks the mark is dropped whole. Only turn 0 rows of
    such chats are compared, so the join side stays narrow.
    """
    flagged = chat.withColumn("_video", is_video)
    first = F.col("_video") & (F.col(turn) == 0)
    broken = flagged.filter(first & ~F.col(value).contains(VIDEO_MARK)).select(sample).distinct()
    marks = F.repeat(F.lit(IMAGE_MARK), F.col(n_frames).cast("int"))
    return (
        flagged.join(broken, sample, "left_anti")
        .withColumn(value, F.when(first, F.replace(F.col(value), F.lit(VIDEO_MARK), marks)).otherwise(F.col(value)))
        .drop("_video")
    )


def drop_empty_text(segments: DataFrame, tokens: str = "n_tokens") -> DataFrame:
    """A text of no tokens makes no segment."""
    return segments.filter((F.col("kind") != "text") | (F.col(tokens) > 0))


def require_loss(segments: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Drop samples without any loss segment, and rows without a sample.

    A window over the sample reads the input once; its exchange serves later sums per sample.
    """
    trained = F.max(F.coalesce(F.col("loss") == 1, F.lit(False))).over(Window.partitionBy(sample))
    flagged = segments.filter(F.col(sample).isNotNull()).withColumn("_trained", trained)
    return flagged.filter("_trained").drop("_trained")


def edit_segments(rows: DataFrame, keys: list[str], style: str = "rules", before: str = "before_image_path", after: str = "after_image_path", prompt: str = REASONING_PROMPT) -> DataFrame:
    """Six segments of a reasoning edit: prompt, source image twice, instruction, reasoning, target.

    ``rules``: rules put before the instruction, quotes and blanks stripped. ``plain``:
    no rules, instruction only right-stripped, reasoning stripped inside the tags.
    ``json``: texts as they are; rows with an empty field are dropped.
    """
    instruction, reasoning = F.col("instruction"), F.col("reasoning")
    if style == "rules":
        instruction = tx.strip_right(tx.with_rules(tx.strip_quotes(instruction), F.col("rules"), "train"))
        reasoning = tx.wrap_think(tx.strip_quotes(reasoning))
    elif style == "plain":
        instruction, reasoning = tx.strip_right(instruction), tx.wrap_think(reasoning)
    elif style == "json":
        for c in ("instruction", "reasoning", before, after):
            rows = rows.filter(F.length(c) > 0)
        reasoning = tx.wrap_think(reasoning, strip_text=False)
    else:
        raise ValueError(f"unknown style {style!r}: use rules, plain or json")
    source, target = F.col(before), F.col(after)
    rows = rows.withColumn("_instruction", instruction).withColumn("_reasoning", reasoning)
    return rows.select(
        *keys,
        F.inline(
            F.array(
                _segment(0, "text", text=F.lit(prompt)),
                _segment(1, "vae_image", image=source),
                _segment(2, "vit_image", image=source),
                _segment(3, "text", text=F.col("_instruction")),
                _segment(4, "text", text=F.col("_reasoning"), loss=1),
                _segment(5, "vae_image", image=target, enable_cfg=0, loss=1),
            )
        ),
    )


def chain_plan(rows: DataFrame, key: str, seed: int, images: str = "image_list") -> DataFrame:
    """Draw the stretch of a multi-turn edit: ``start``, ``end`` and ``joined``.

    start is uniform over all but the last image, end at most two images further; a
    stretch of two turns is joined into one instruction half the time, giving up its
    last image when that is the chain's last.
    """
    n = F.size(images).cast("bigint")
    k = F.col(key)
    df = rows.filter(F.size(images) >= 2)
    df = df.withColumn("start", uniform_int(uniform(seed, k, "start"), F.lit(0), n - 1))
    df = df.withColumn(
        "_end", uniform_int(uniform(seed, k, "end"), F.col("start") + 1, F.least(F.col("start") + 3, n))
    )
    df = df.withColumn("joined", (F.col("_end") - F.col("start") > 1) & (uniform(seed, k, "join") < F.lit(0.5)))
    return df.withColumn(
        "end", F.when(F.col("joined") & (F.col("_end") == n - 1), F.col("_end") - 1).otherwise(F.col("_end"))
    ).drop("_end")


def chain_segments(rows: DataFrame, key: str, seed: int, images: str = "image_list", instructions: str = "instruction_list") -> DataFrame:
    """Segments of a multi-turn edit: source image, then per turn an instruction and an image.

    Each instruction is a uniform choice among its alternatives. Images inside the
    stretch carry loss and serve as conditions as well (three segments).
    """
    planned = chain_plan(rows, key, seed, images)
    image = lambda i: F.get(F.col(images), i.cast("int"))
    text = lambda i: choice(
        uniform(seed, F.col(key), F.concat(F.lit("alt"), i.cast("string"))), F.get(F.col(instructions), i.cast("int") - 1)
    )
    start, end = F.col("start"), F.col("end")
    steps = F.sequence(start + 1, end)
    head = F.array(_segment(0, "vae_image", image=image(start)), _segment(1, "vit_image", image=image(start)))

    sentences = F.transform(steps, lambda i: F.concat(text(i), F.lit(".")))
    together = F.array(
        _segment(2, "text", text=F.array_join(sentences, " ")),
        _segment(3, "vae_image", image=image(end), enable_cfg=0, loss=1),
    )

    def turn(i: Column) -> Column:
        base = F.lit(2) + (i - start - 1) * 4
        last = F.array(
            _segment(base, "text", text=text(i)), _segment(base + 1, "vae_image", image=image(i), enable_cfg=0, loss=1)
        )
        more = F.array(_segment(base + 2, "vae_image", image=image(i)), _segment(base + 3, "vit_image", image=image(i)))
        return F.when(i == end, last).otherwise(F.concat(last, more))

    apart = F.flatten(F.transform(steps, turn))
    return planned.select(key, F.inline(F.concat(head, F.when(F.col("joined"), together).otherwise(apart))))


def caption_segments(rows: DataFrame, keys: list[str], caption: str = "caption", image: str = "image") -> DataFrame:
    """Caption text as a droppable condition, then the target image with loss."""
    return rows.select(
        *keys,
        F.inline(
            F.array(
                _segment(0, "text", text=F.col(caption)),
                _segment(1, "vae_image", image=F.col(image), enable_cfg=0, loss=1),
            )
        ),
    )


def video_segments(rows: DataFrame, keys: list[str], frames: str = "frames", loss: bool = True, enable_cfg: int = 1) -> DataFrame:
    """One image segment per chosen frame; all frames of a video form one split.

    ``frames`` is an ordered array of frame numbers. ``frame_delta`` is the step to the
    next frame, NULL on the last.
    """
    exploded = rows.select(*keys, F.col(frames).alias("_f"), F.posexplode(frames).alias("_i", "frame"))
    n = F.size("_f")
    return exploded.select(
        *keys,
        F.col("_i").cast("bigint").alias("seg_pos"),
        F.lit("vae_image").alias("kind"),
        "frame",
        F.lit(0 if loss else enable_cfg).alias("enable_cfg"),
        F.lit(int(loss)).alias("loss"),
        (F.col("_i") == 0).alias("split_start"),
        (F.col("_i") == n - 1).alias("split_end"),
        (F.get("_f", F.col("_i") + 1) - F.col("frame")).cast("bigint").alias("frame_delta"),
    )


def sample_lengths(segments: DataFrame, sample: str = "sample_id", tokens: str = "n_tokens") -> DataFrame:
    """Tokens and packed length per sample; packing adds two marks per segment."""
    return (
        segments.groupBy(sample)
        .agg(F.sum(tokens).cast("bigint").alias("num_tokens"), F.count(F.lit(1)).alias("n_segments"))
        .withColumn("length", F.col("num_tokens") + 2 * F.col("n_segments"))
    )
