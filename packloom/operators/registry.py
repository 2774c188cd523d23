"""Extension points: named feeds, user row functions, config groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.geometry import ResizeRule

Builder = Callable[..., DataFrame]
_BUILDERS: dict[str, Builder] = {}


def register_source(name: str, builder: Builder) -> Builder:
    """Name a feed: a function from source table (and options) to a segment table."""
    _BUILDERS[name] = builder
    return builder


def build_source(name: str, df: DataFrame, **options: Any) -> DataFrame:
    if name not in _BUILDERS:
        raise KeyError(f"no source named {name!r}; known: {sorted(_BUILDERS)}")
    return df.transform(_BUILDERS[name], **options)


def registered_sources() -> list[str]:
    return sorted(_BUILDERS)


def rows_to_segments(df: DataFrame, fn: Callable[[dict], list[dict]], schema: StructType) -> DataFrame:
    """User code from one row to any number of rows; a row whose call fails is skipped."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                try:
                    out.extend(fn(row))
                except Exception:  # the contract: one bad row never fails the job
                    continue
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.mapInArrow(run, schema)


def map_items(df: DataFrame, fn: Callable[[dict], dict], key: str, schema: StructType) -> DataFrame:
    """User code over work items; a failing item yields empty texts and an ``error``.

    ``schema`` lists the string columns ``fn`` returns; key and error are added.
    """
    names = schema.fieldNames()
    full = StructType([df.schema[key], *schema.fields, StructField("error", StringType())])
    arrow = to_arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    result, error = fn(row), None
                except Exception as exc:
                    result, error = {n: "" for n in names}, repr(exc)
                out.append({key: row[key], **{n: result.get(n) for n in names}, "error": error})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.mapInArrow(run, full)


@dataclass(frozen=True)
class FrameRule:
    """How many frames of a video to take and where."""

    max_num_frames: int = -1
    min_num_frames: int = 8
    sample: str = "rand"


@dataclass(frozen=True)
class FeedGroup:
    """One group of a training mixture."""

    name: str
    dataset_names: tuple[str, ...]
    weight: float = 0.0
    is_mandatory: bool = False
    num_used_data: tuple[int | str | None, ...] = ()
    image: ResizeRule | None = None
    vit_image: ResizeRule | None = None
    frames: FrameRule | None = None
    shuffle_lines: bool = False
    shuffle_seed: int = 0
    options: Mapping[str, Any] = field(default_factory=dict)


def _resize(args: Mapping[str, Any] | None) -> ResizeRule | None:
    if args is None:
        return None
    extra = {"max_pixels": args["max_pixels"]} if "max_pixels" in args else {}
    return ResizeRule(args["max_image_size"], args["min_image_size"], args["image_stride"], **extra)


def read_config(config: Mapping[str, Mapping[str, Any]]) -> list[FeedGroup]:
    """Feed groups of a parsed YAML or JSON mixture file."""
    groups = []
    for name, args in config.items():
        args = dict(args)
        if "dataset_names" not in args:
            raise ValueError(f"group {name!r} lists no dataset_names")
        frames = args.pop("frame_sampler_args", None)
        groups.append(
            FeedGroup(
                name=name,
                dataset_names=tuple(args.pop("dataset_names")),
                weight=float(args.pop("weight", 0.0)),
                is_mandatory=bool(args.pop("is_mandatory", False)),
                num_used_data=tuple(args.pop("num_used_data", ())),
                image=_resize(args.pop("image_transform_args", None)),
                vit_image=_resize(args.pop("vit_image_transform_args", None)),
                frames=FrameRule(**frames) if frames else None,
                shuffle_lines=bool(args.pop("shuffle_lines", False)),
                shuffle_seed=int(args.pop("shuffle_seed", 0)),
                options=args,
            )
        )
    return groups
