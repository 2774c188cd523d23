"""Judge results to reports, and the work lists that come before them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import evaluation as ev
from ..operators.rank import shard_ceil, value_rank
from ..operators.sampling import pending_outputs


def evaluate(items: DataFrame, judgements: DataFrame) -> DataFrame:
    """The report over all items, from raw judge answers."""
    return ev.report(ev.scored_items(items, judgements))


def generation_work(items: DataFrame, manifest: DataFrame, folder: str, world: int, position: str = "idx") -> DataFrame:
    """Items without an output, with prompt, output path and generation rank.

    Ranks are contiguous slices of all items in position order; finished items are
    skipped after slicing, as each rank skips its own.
    """
    ranked = value_rank(items, F.col(position), rank="_rank", total="_n")
    sliced = shard_ceil(ranked, world, "_rank", "_n", "rank")
    work = sliced.withColumns(
        {
            "prompt": tx.with_rules(F.col("instruction"), F.col("rules"), "inference"),
            "output_path": tx.output_path(folder, F.col("name"), F.col("idx")),
            "think_path": tx.output_path(folder, F.col("name"), F.col("idx"), "txt"),
        }
    )
    return pending_outputs(work, manifest, F.col("output_path")).drop("_rank", "_n")
