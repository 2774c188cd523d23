"""Greedy token-budget packing.

The rule is sequential, so it runs per shard: shards of bounded size come from
``even_chunks`` or ``shard_floor``, their number grows with the data, and only ids and
lengths travel. Segments are joined to the result afterwards. A feed may come in parts: the
state of each shard is a row that the next part starts from.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain, groupby, islice
from math import gcd

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .rank import range_rank

PACKED, TOO_LONG, LOST, SAVE = "packed", "too_long", "lost", "saved"


@dataclass(frozen=True)
class PackRule:
    """Budgets of a pack. Defaults are the published loader defaults."""

    expected: int = 32768
    max_total: int = 36864
    max_sample: int = 16384
    prefer_buffer: int = 16384
    buffer: int = 50
    on_overflow: str = "carry"  # or "drop": the sample that closes a pack is lost

    def __post_init__(self) -> None:
        if self.on_overflow not in ("carry", "drop"):
            raise ValueError("on_overflow must be carry or drop")


# The published training run.
TRAINING_RULE = PackRule(expected=35000, max_total=35000, max_sample=35000)


class HeadFeed:
    """Heads of one mandatory group as they come in; when all are used they come round again."""

    def __init__(self, group: int, heads: Iterable[tuple] = ()) -> None:
        self.group, self.coming, self.used, self.turn = group, deque(heads), [], 0

    def next(self) -> tuple:
        if not self.coming:
            self.coming.extend(self.used)
            self.used.clear()
        if not self.coming:
            raise ValueError(f"mandatory group {self.group} has no sample left to open a pack")
        head = self.coming.popleft()
        self.used.append(head)
        self.turn += 1
        return head


def _pack_shard(
    arrivals: Iterator[tuple], heads: list, rule: PackRule, state: dict | None = None, more: bool = False
) -> Iterator[tuple]:
    """Yield (sample, pack_no, pack_pos, status) for one shard.

    Samples are (id, length, kept length). ``heads`` holds a feed, or a list of samples, for
    each mandatory group; one of each opens every pack, and a list that ends starts again.
    ``state`` is where the shard stopped and takes up where it stops now. With ``more`` the
    open pack and the buffer stay in it instead of being flushed.
    """
    state = {} if state is None else state
    waiting: deque = deque(state.get("waiting") or ())
    carried: deque = deque(state.get("carried") or ())  # the sample that closed the last pack, to open the next one
    feeds = [h if isinstance(h, HeadFeed) else HeadFeed(g, [x for x in h if x[1] < rule.max_sample]) for g, h in enumerate(heads)]
    pack_no, filled, members, regular = (state.get(k) or 0 for k in ("pack_no", "filled", "members", "regular"))

    def place(sample):
        nonlocal filled, members
        filled += sample[2]
        members += 1
        return sample[0], pack_no, members - 1, PACKED

    def close():
        nonlocal pack_no, filled, members, regular
        if members:
            pack_no += 1
        filled = members = regular = 0

    upcoming = next(arrivals, None)
    draining = False
    while upcoming is not None or not more and (carried or waiting):
        if upcoming is None and not carried and not draining:
            draining = True  # the feed is over: flush, then the buffer goes by the same rules
            close()
        if filled == 0:
            for feed in feeds:
                yield place(feed.next())
        if carried:
            sample, fresh = carried.popleft(), False
        elif waiting and (draining or filled < rule.prefer_buffer):
            sample, fresh = waiting.popleft(), False
        else:
            sample, fresh = upcoming, True
            upcoming = next(arrivals, None)

        if sample[1] > rule.max_sample:
            yield sample[0], None, None, TOO_LONG
        elif filled + sample[1] > rule.max_total:
            if fresh and len(waiting) < rule.buffer:
                waiting.append(sample)
            elif rule.on_overflow == "drop":
                close()
                yield sample[0], None, None, LOST
            elif not regular:
                # Too long beside the mandatory heads, so it would not fit the next pack either.
                yield sample[0], None, None, LOST
            else:
                close()
                carried.append(sample)
        else:
            regular += 1
            yield place(sample)
            if filled >= rule.expected:
                close()
    state.update(pack_no=pack_no, filled=filled, members=members, regular=regular, waiting=list(waiting), carried=list(carried))


# Kinds of rows in a shard's feed, besides heads with the number of their group.
ARRIVAL, SAVED = -1, -2


def _pack_batches(batches: Iterator[pa.RecordBatch], rule: PackRule, groups: tuple[int, ...], more: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    columns = ("shard", "head", "sample_id", "length", "kept", "state")

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in columns))

    def results():
        for shard, members in groupby(rows(), key=lambda r: r[0]):
            feeds = {g: HeadFeed(g) for g in groups}
            state: dict = {}

            def arrivals(members=members, feeds=feeds, state=state):
                for _, head, sample, length, kept, saved in members:
                    whole = ((sample, length), length, kept)
                    if head == SAVED:
                        item = lambda x: ((x["sample_id"], x["length"]), x["length"], x["kept"])
                        state.update(saved, waiting=[item(x) for x in saved["waiting"]], carried=[item(x) for x in saved["carried"]])
                        for g, turn in saved["turns"]:
                            feeds[g].turn = turn
                    elif head == ARRIVAL:
                        yield whole
                    else:
                        feeds[head].coming.append(whole)

            feed = arrivals()
            # Reads a saved state, which comes first, before the loop looks at it.
            first = next(feed, None)
            for (sample, length), *rest in _pack_shard(chain([first] if first else [], feed), list(feeds.values()), rule, state, more):
                yield (shard, sample, length, *rest, None)
            if more:
                item = lambda x: {"sample_id": x[0][0], "length": x[1], "kept": x[2]}
                numbers = {k: state[k] for k in ("pack_no", "filled", "members", "regular")}
                held = {k: [item(x) for x in state[k]] for k in ("waiting", "carried")}
                yield shard, None, None, None, None, SAVE, {**numbers, **held, "turns": [(g, f.turn) for g, f in feeds.items()]}

    stream = results()
    while chunk := list(islice(stream, 20_000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*chunk), schema)], schema=schema)


def _dealt_heads(samples: DataFrame, heads: DataFrame, rule: PackRule, n_shards: int, groups: Sequence[int], saved: DataFrame | None, order: Column) -> tuple[DataFrame, tuple[int, ...]]:
    """Each shard's heads in turn: head number (shard + turn * n_shards) modulo the group's size, without end.

    A shard opens no more packs than samples come to it, so it gets that many heads, or one
    whole round if that is shorter. Head j stands before the j-th arrival: no pack needs it
    sooner, but for those that buffered samples open.
    """
    fitting = heads.where(F.col("length") < rule.max_sample)
    # One row per mandatory group of the configuration.
    sizes = {r["head"]: r["n"] for r in heads.groupBy("head").agg(F.count(F.when(F.col("length") < rule.max_sample, 1)).alias("n")).collect()}
    known = tuple(sorted(set(groups) | set(sizes)))
    for g in known:
        if not sizes.get(g):
            raise ValueError(f"mandatory group {g} has no sample below {rule.max_sample} tokens")
    if not known:
        return heads, known
    ranked = range_rank(fitting, [order, F.col("sample_id")], ["head"], rank="place").select("head", "place", "sample_id", "length", "kept")
    needs = samples.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    if saved is None:
        needs = needs.withColumn("turns", F.lit(None).cast("map<bigint,bigint>"))
    else:
        needs = needs.join(saved.select("shard", F.col("state.turns").alias("turns")), "shard", "full")
    rounds = F.array(*[F.struct(F.lit(g).cast("bigint").alias("head"), F.lit(sizes[g]).cast("bigint").alias("m"), F.lit(sizes[g] // gcd(sizes[g], n_shards)).cast("bigint").alias("period")) for g in known])
    needs = needs.select("shard", (F.coalesce("n", F.lit(0)) + rule.buffer + 3).alias("n"), "turns", F.explode(rounds).alias("g")).select("shard", "n", "turns", "g.*")
    turn = F.coalesce(F.element_at("turns", F.col("head")), F.lit(0).cast("bigint"))
    dealt = needs.select("shard", "head", "m", turn.alias("turn"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.least("n", "period") - 1)).alias("j"))
    dealt = dealt.select("shard", "head", "j", F.pmod(F.col("shard") + (F.col("turn") + F.col("j")) * n_shards, F.col("m")).alias("place"))
    at = F.greatest(F.col("j") - (rule.buffer + 1), F.lit(0).cast("bigint"))
    return dealt.join(ranked, ["head", "place"]).select("shard", "head", at.alias("at"), "j", "sample_id", "length", "kept"), known


def pack_part(
    samples: DataFrame,
    rule: PackRule = PackRule(),
    state: DataFrame | None = None,
    more: bool = True,
    shard: str = "shard",
    seq: str = "seq",
    sample: str = "sample_id",
    length: str = "length",
    kept: str | None = None,
    heads: DataFrame | None = None,
    head_group: str = "group_no",
    n_shards: int | None = None,
    groups: Sequence[int] = (),
) -> DataFrame:
    """Pack one part of the feed: the rows of ``pack`` and, with ``more``, one row per shard with its state.

    A state row has the status ``saved``; ``split_part`` takes the two apart. ``state`` holds
    the states of the part before (shard, state): its open pack, the sample carried over, the
    buffer and the turns of the mandatory groups. Parts packed one after the other give the
    packs of the whole feed. Shards without new samples keep their state.
    """
    whole = lambda c: F.col(c).cast("bigint")
    narrow = lambda df, at: df.select(F.col(shard).alias("shard"), whole(at).alias("at"), F.col(sample).alias("sample_id"), whole(length).alias("length"), whole(kept or length).alias("kept"))
    rows = narrow(samples, seq)
    kind = rows.schema["sample_id"].dataType.simpleString()  # any type, a struct of names and numbers too
    item = f"array<struct<sample_id:{kind},length:bigint,kept:bigint>>"
    saved_as = f"struct<pack_no:bigint,filled:bigint,members:bigint,regular:bigint,waiting:{item},carried:{item},turns:map<bigint,bigint>>"
    nothing = F.lit(None).cast(saved_as).alias("state")
    first = F.lit(0).cast("bigint")
    feed = rows.select("shard", F.lit(ARRIVAL).cast("bigint").alias("head"), "at", first.alias("j"), "sample_id", "length", "kept", nothing)
    known = tuple(groups)
    if heads is not None or known:
        if not n_shards:
            raise ValueError("mandatory heads are dealt to n_shards shards, numbered from 0")
        if heads is None:
            raise ValueError(f"mandatory groups {list(known)} have no samples")
        fill = whole(kept if kept in heads.columns else length)
        own = heads.select(whole(head_group).alias("head"), F.col(seq).alias("order"), F.col(sample).alias("sample_id"), whole(length).alias("length"), fill.alias("kept"))
        dealt, known = _dealt_heads(rows, own, rule, n_shards, known, state, F.col("order"))
        if known:
            feed = feed.unionByName(dealt.withColumn("state", nothing))
    if state is not None:
        feed = feed.unionByName(
            state.select(
                "shard", F.lit(SAVED).cast("bigint").alias("head"), F.lit(None).cast("bigint").alias("at"), first.alias("j"),
                F.lit(None).cast(kind).alias("sample_id"), F.lit(None).cast("bigint").alias("length"), F.lit(None).cast("bigint").alias("kept"), F.col("state").cast(saved_as).alias("state"),
            )
        )
    numbers = [StructField(c, LongType()) for c in ("length", "pack_no", "pack_pos")]
    saved_type = feed.schema["state"].dataType
    schema = StructType([StructField("shard", feed.schema["shard"].dataType), StructField("sample_id", feed.schema["sample_id"].dataType), *numbers, StructField("status", StringType()), StructField("state", saved_type)])
    # A state has no place and comes first, heads come before the arrival at their place.
    ordered = feed.repartition("shard").sortWithinPartitions("shard", F.col("at").asc_nulls_first(), F.col("head") < 0, "head", "j")
    arrow = to_arrow_schema(schema)
    return ordered.mapInArrow(lambda batches: _pack_batches(batches, rule, known, more, arrow), schema)


def split_part(part: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(packs, states) of a part; write the part first, both are read from it."""
    return part.where(F.col("status") != SAVE).drop("state"), part.where(F.col("status") == SAVE).select("shard", "state")


def pack(samples: DataFrame, rule: PackRule = PackRule(), state: DataFrame | None = None, **columns) -> DataFrame:
    """Assign samples to packs: ``shard, sample_id, length, pack_no, pack_pos, status``.

    Samples arrive in ``seq`` order per shard, counted from 0 or more. ``kept`` is the length
    left after dropout: packs fill by it, while the fit test uses the full length. ``heads``
    (same columns plus ``head_group``) are the mandatory groups' feeds, dealt to ``n_shards``
    shards in turn; one of each group opens every pack, and a group without a fitting sample,
    or one of ``groups`` without any, is an error. ``state`` goes on where ``pack_part`` stopped.
    """
    return pack_part(samples, rule, state, more=False, **columns).drop("state")


def pack_next_fit(samples: DataFrame, expected: int, max_total: int, max_sample: int, **columns: str) -> DataFrame:
    """Packing without look-ahead: a sample that does not fit opens the next pack."""
    rule = PackRule(expected=expected, max_total=max_total, max_sample=max_sample, prefer_buffer=0, buffer=0)
    return pack(samples, rule, **columns)


def pack_report(packs: DataFrame, max_total: int) -> DataFrame:
    """One row: packs, samples, mean and lowest fill, and what was left out."""
    per_pack = packs.groupBy("shard", "pack_no", "status").agg(
        F.sum("length").alias("_tokens"), F.count(F.lit(1)).alias("_n")
    )
    packed = F.col("status") == PACKED
    count = lambda status: F.coalesce(F.sum(F.when(F.col("status") == status, F.col("_n"))), F.lit(0)).cast("bigint")
    fill = F.when(packed, F.col("_tokens") / F.lit(float(max_total)))
    return per_pack.agg(
        F.count(F.when(packed, F.lit(1))).alias("n_packs"),
        count(PACKED).alias("n_samples"),
        F.avg(fill).alias("mean_fill"),
        F.min(fill).alias("min_fill"),
        F.max(F.when(packed, F.col("_n"))).cast("bigint").alias("most_samples"),
        count(TOO_LONG).alias("n_too_long"),
        count(LOST).alias("n_lost"),
    )
