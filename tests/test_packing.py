"""The pack loop against a plain restatement, and its invariants."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from packloom.operators.packing import PACKED, TOO_LONG, PackRule, _pack_shard, pack, pack_part, split_part
from packloom.session import staged


def restated(lengths, rule):
    """Packs as lists of sample numbers, and what was left out; no mandatory heads."""
    packs, too_long, lost = [], [], []
    feed = list(enumerate(lengths))
    buffer, current, filled = [], [], 0
    flushed = False
    carry = None
    while feed or buffer or carry:
        if not feed and carry is None and not flushed:
            flushed = True
            if current:
                packs.append(current)
            current, filled = [], 0
        if carry is not None:
            (sample, fresh), carry = (carry, False), None
        elif buffer and (flushed or filled < rule.prefer_buffer):
            sample, fresh = buffer.pop(0), False
        else:
            sample, fresh = feed.pop(0), True
        i, n = sample
        if n > rule.max_sample:
            too_long.append(i)
        elif filled + n <= rule.max_total:
            current.append(i)
            filled += n
            if filled >= rule.expected:
                packs.append(current)
                current, filled = [], 0
        elif fresh and len(buffer) < rule.buffer:
            buffer.append(sample)
        elif rule.on_overflow == "drop":
            if current:
                packs.append(current)
            current, filled = [], 0
            lost.append(i)
        elif not current:
            lost.append(i)
        else:
            packs.append(current)
            current, filled = [], 0
            carry = sample
    if current:
        packs.append(current)
    return packs, too_long, lost


def run(lengths, rule, heads=()):
    out = list(_pack_shard(iter([(i, n, n) for i, n in enumerate(lengths)]), [list(h) for h in heads], rule))
    packs = {}
    for sample, pack_no, pos, status in out:
        if status == PACKED:
            packs.setdefault(pack_no, []).append((pos, sample))
    return [[s for _, s in sorted(packs[k])] for k in sorted(packs)], out


rules = st.builds(
    lambda expected, slack, sample, prefer, buffer, overflow: PackRule(expected, expected + slack, sample, prefer, buffer, overflow),
    st.integers(5, 60), st.integers(0, 20), st.integers(5, 80), st.integers(0, 60), st.integers(0, 4), st.sampled_from(["carry", "drop"]),
)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60), rules)
def test_same_as_restatement(lengths, rule):
    want, too_long, lost = restated(lengths, rule)
    got, out = run(lengths, rule)
    assert got == want
    assert [s for s, *_, status in out if status == TOO_LONG] == too_long
    assert [s for s, *_, status in out if status == "lost"] == lost


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60), rules)
def test_every_sample_once_and_no_pack_over_budget(lengths, rule):
    got, out = run(lengths, rule)
    assert Counter(s for s, *_ in out) == Counter(range(len(lengths)))
    assert all(sum(lengths[i] for i in p) <= rule.max_total for p in got)


def test_heads_open_every_pack_and_wrap():
    rule = PackRule(expected=10, max_total=12, max_sample=10, prefer_buffer=0, buffer=0)
    got, _ = run([5, 5, 5, 5], rule, heads=[[("a", 4, 4), ("long", 10, 10), ("b", 3, 3)]])
    assert [p[0] for p in got] == ["a", "b", "a", "b"]  # a head must be below the limit, not at it
    assert all(len(p) == 2 for p in got)


def test_heads_that_end_too_long_or_missing_are_refused():
    rule = PackRule(expected=10, max_total=12, max_sample=10)
    with pytest.raises(ValueError, match="mandatory group 1"):
        run([5, 5], rule, heads=[[("a", 4, 4)], [("long", 10, 10)]])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60), rules, st.lists(st.integers(0, 60), max_size=3))
def test_parts_give_the_packs_of_one_go(lengths, rule, cuts):
    """State handed from part to part, empty parts and empty states included."""
    whole = list(_pack_shard(iter([(i, n, n) for i, n in enumerate(lengths)]), [], rule))
    state, out, at = {}, [], 0
    for cut in sorted(min(c, len(lengths)) for c in cuts):
        out += _pack_shard(iter([(i, lengths[i], lengths[i]) for i in range(at, cut)]), [], rule, state, more=True)
        at = cut
    out += _pack_shard(iter([(i, lengths[i], lengths[i]) for i in range(at, len(lengths))]), [], rule, state)
    assert out == whole


def test_dropout_fills_by_kept_length():
    rule = PackRule(expected=10, max_total=10, max_sample=10, prefer_buffer=0, buffer=0)
    out = list(_pack_shard(iter([("a", 8, 2), ("b", 8, 8), ("c", 3, 3)]), [], rule))
    assert [(s, p) for s, p, *_ in out] == [("a", 0), ("b", 0), ("c", 1)]


def test_spark_packs_each_shard_like_the_function(spark):
    rng = random.Random(5)
    rows = [(shard, seq, f"s{shard}-{seq}", rng.randint(1, 50)) for shard in range(7) for seq in range(rng.randint(0, 90))]
    rng.shuffle(rows)
    rule = PackRule(100, 120, 45, 60, 3)
    df = spark.createDataFrame(rows, "shard bigint, seq bigint, sample_id string, length bigint").repartition(5)
    got = {(r.shard, r.sample_id): (r.pack_no, r.pack_pos, r.status) for r in pack(df, rule).collect()}
    want = {}
    for shard in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == shard), key=lambda r: r[1])
        for s, no, pos, status in _pack_shard(iter([(r[2], r[3], r[3]) for r in mine]), [], rule):
            want[(shard, s)] = (no, pos, status)
    assert got == want


def feed_rows(rng, shards, most):
    return [(shard, seq, 10_000 * shard + seq, rng.randint(1, 50)) for shard in range(shards) for seq in range(rng.randint(0, most))]


COLUMNS = "shard bigint, seq bigint, sample_id bigint, length bigint"


def test_heads_are_dealt_in_turn_and_come_round(spark):
    """Two groups, one smaller than the shards: every pack of every shard opens with the heads of its turn."""
    rng = random.Random(8)
    rows = feed_rows(rng, 6, 60) + [(6, 0, 77, 5)]
    rule = PackRule(100, 120, 45, 60, 3)
    heads = [(0, i, 900 + i, 10 if i != 2 else 45) for i in range(4)] + [(1, i, 950 + i, 7) for i in range(40)]
    df = spark.createDataFrame(rows, COLUMNS)
    head_df = spark.createDataFrame(heads, "group_no bigint, seq bigint, sample_id bigint, length bigint")
    got = {}
    for r in pack(df, rule, heads=head_df, n_shards=7).collect():
        if r.status == PACKED:
            got.setdefault((r.shard, r.pack_no), {})[r.pack_pos] = r.sample_id
    cycles = [[900, 901, 903], [950 + i for i in range(40)]]
    assert {shard for shard, _ in got} == {r[0] for r in rows}
    for (shard, no), members in got.items():
        assert [members[0], members[1]] == [c[(shard + no * 7) % len(c)] for c in cycles]


def test_missing_groups_and_shard_counts_raise(spark):
    df = spark.createDataFrame([(0, 0, 1, 5)], COLUMNS)
    heads = spark.createDataFrame([(0, 0, 9, 999)], "group_no bigint, seq bigint, sample_id bigint, length bigint")
    rule = PackRule(100, 120, 45, 60, 3)
    with pytest.raises(ValueError, match="group 0 has no sample below 45"):
        pack(df, rule, heads=heads, n_shards=1)
    with pytest.raises(ValueError, match="group 3 has no sample"):
        pack(df, rule, heads=heads.withColumn("length", F.lit(4)), n_shards=1, groups=[0, 3])
    with pytest.raises(ValueError, match="n_shards"):
        pack(df, rule, heads=heads)


@pytest.mark.parametrize("with_heads", [False, True])
def test_spark_parts_equal_one_go(spark, with_heads):
    """Halves at another place per shard, NULL ids and ids above 2 ** 53, a shard that ends early and one that starts late."""
    rng = random.Random(12)
    rows = [(s, q, None if i % 17 == 0 else (1 << 60) + i, n) for i, (s, q, _, n) in enumerate(feed_rows(rng, 6, 70))] + [(7, 0, 5, 9)]
    rule = PackRule(100, 120, 45, 60, 3)
    df = spark.createDataFrame(rows, COLUMNS)
    extra = {}
    if with_heads:
        heads = spark.createDataFrame([(0, i, i, 5 + i) for i in range(9)], "group_no bigint, seq bigint, sample_id bigint, length bigint")
        extra = {"heads": heads, "n_shards": 8}
    text = lambda df: sorted(map(repr, df.collect()))
    whole = text(pack(df, rule, **extra))
    early = F.col("seq") < F.col("shard") * 9
    first, states = split_part(staged(pack_part(df.where(early), rule, **extra), "part"))
    second = pack(df.where(~early), rule, states, **extra)
    assert text(first.unionByName(second)) == whole
    assert any("1152921504606846977" in r or "11529215046068469" in r for r in whole)
