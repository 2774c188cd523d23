"""The judge's work list: what is still to be judged, as messages with the images in them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import clean as cl
from ..operators import segments as sg
from ..operators.evaluation import ANSWERS
from ..operators.sampling import pending
from ..session import staged

MOST_BYTES = 20 << 20  # of one image; a row holds three


def _message(parts: Column, urls: Column, system: str | None) -> Column:
    """Messages of (type, value) parts whose image paths are replaced by data URLs."""
    value = lambda p: F.when(p["type"] == "image", F.element_at(urls, p["value"])).otherwise(p["value"])
    return cl.messages(F.transform(parts, lambda p: F.struct(p["type"].alias("type"), value(p).alias("value"))), system)


def judge_work(
    items: DataFrame,
    done: DataFrame,
    files: DataFrame,
    templates: Mapping[int, str],
    system: str | None = None,
    mime: str = "image/jpeg",
    most_bytes: int = MOST_BYTES,
    suffixes: Sequence[str] = ("png", "jpg", "jpeg"),
    retry_errors: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(requests, failures): three requests for every item that can be judged now, an error row for every other.

    ``items`` have ``item_key``, ``instruction``, ``rules``, ``reference_effect``, ``original_path``,
    ``reference_path`` and ``output_stem``, the output's path without its suffix; ``done``
    the judged keys; ``files`` path, length and content, as the ``binaryFile`` source gives
    them. Requests are (item_key, dim, messages), failures what a judge returns for them:
    empty answers and an error, for a missing reference, output or original, or one above
    ``most_bytes``.

    Everything is decided on keys, paths and lengths; contents come last. Each file that is
    needed is joined once, whatever number of requests shows it, and its data URL is moved
    to the items that need it; the requests are written out from there without an exchange.
    """
    todo = pending(items, done, retry_errors=retry_errors)
    listing = files.select("path", "length")
    names = todo.select("item_key", "original_path", "reference_path", "output_stem")
    found = cl.resolve_first(names, listing, "output_stem", suffixes, out="output_path")
    wanted = [("reference", F.col("reference_path")), ("output", F.col("output_path")), ("original", F.col("original_path"))]
    paths = found.select("item_key", "output_stem", F.inline(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(r).alias("role"), p.alias("path")) for i, (r, p) in enumerate(wanted)])))
    sized = paths.join(listing.groupBy("path").agg(F.max("length").alias("length")), "path", "left")
    missing = F.when(F.col("role") == "output", F.concat(F.lit("Cannot find edited image at: "), "output_stem", F.lit(f".{suffixes[0]}"))).otherwise(
        F.concat(F.lit("Image not found: "), F.coalesce("path", F.lit("None")))
    )
    error = F.when(F.col("length").isNull(), missing).when(F.col("length") > most_bytes, F.concat(F.lit("Image too large: "), "path"))
    checked = sized.groupBy("item_key").agg(
        F.min(F.when(error.isNotNull(), F.struct("place", error.alias("error")))).alias("first"), F.collect_list(F.struct("role", "path")).alias("images")
    )
    checked = staged(checked.select("item_key", F.col("first.error").alias("error"), "images"), "judge-files")
    failures = checked.where("error IS NOT NULL").select("item_key", *[F.lit("").alias(a) for a in ANSWERS], "error")

    needed = checked.where("error IS NULL").select("item_key", F.inline("images"))
    contents = files.select("path", tx.data_url(F.col("content"), mime).alias("url")).join(needed.select("path").distinct(), "path", "left_semi")
    contents = contents.groupBy("path").agg(F.first("url").alias("url"))
    ready = needed.join(contents, "path").groupBy("item_key").agg(
        F.map_from_entries(F.collect_set(F.struct("path", "url"))).alias("urls"), F.max(F.when(F.col("role") == "output", F.col("path"))).alias("output_path")
    )
    texts = todo.drop("output_path").join(ready, "item_key")
    requests = cl.judge_requests(texts, templates, keep=("item_key", "urls"))
    return requests.select("item_key", "dim", _message(F.col("parts"), F.col("urls"), system).alias("messages")), failures


def json_edit_feed(rows: DataFrame, keys: list[str], files: DataFrame, before: str = "before_image_path", after: str = "after_image_path") -> DataFrame:
    """Edit segments of JSON records, for records whose two image files are there.

    The file test runs on the keys' paths before any text is cut into segments.
    """
    return sg.edit_segments(cl.check_files(rows, files, [before, after]), keys, style="json", before=before, after=after)
