"""What each trainer reads: files to row groups to rank and worker, and the named feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import segments as sg
from ..operators.clean import pick_caption
from ..operators.rank import shard_floor
from ..operators.registry import register_source
from ..operators.sampling import cycle_to, expand_row_groups, resume_after


def reading_plan(
    files: DataFrame,
    wanted: DataFrame,
    manifest: DataFrame,
    world: int,
    workers: int | None,
    seed: int = 42,
    saved: DataFrame | None = None,
) -> DataFrame:
    """Row groups per rank and worker in reading order, resumed after the saved places.

    ``files``: source, path. ``wanted``: source, n_wanted. ``saved``: rank, worker,
    position. A file listed several times gives its row groups as often.
    """
    listed = expand_row_groups(cycle_to(files, wanted, seed=seed), manifest)
    unit = F.concat_ws("|", "path", "entry", "rg_idx")
    plan = shard_floor(listed.withColumn("unit", unit), "unit", world, workers, seed)
    return plan if saved is None else resume_after(plan, saved, ["rank", "worker"], ["position"])


def chat_feed(df: DataFrame, keys: list[str]) -> DataFrame:
    return sg.require_loss(sg.chat_segments(df, keys), keys[0])


def caption_feed(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    return sg.caption_segments(pick_caption(df, key, seed=seed), [key])


def register_feeds() -> None:
    """The feeds the library brings along, by name."""
    register_source("reasoning_edit", sg.edit_segments)
    register_source("edit_chain", sg.chain_segments)
    register_source("caption", caption_feed)
    register_source("chat", chat_feed)


register_feeds()
