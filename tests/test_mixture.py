"""From a mixture configuration to packs."""

import pytest
from pyspark.sql import functions as F

from packloom.operators import segments as sg
from packloom.operators.packing import PackRule
from packloom.operators.registry import read_config, register_source
from packloom.plans.mixture import group_lengths, training_feed

RESIZE = {"image_stride": 16, "max_image_size": 64, "min_image_size": 32}
VIT = {"image_stride": 14, "max_image_size": 56, "min_image_size": 28}
RULE = PackRule(expected=120, max_total=160, max_sample=100, prefer_buffer=60, buffer=3)


def edits(spark, n):
    rows = [(i, "make it " + "red " * (i % 4), "because", None, f"b{i}", f"a{i}") for i in range(n)]
    return spark.createDataFrame(rows, "sample_id bigint, instruction string, reasoning string, rules string, before_image_path string, after_image_path string")


def images(spark, n, lost=()):
    rows = [(f"{k}{i}", 64, 32) for i in range(n) for k in "ab" if (k, i) not in lost]
    return spark.createDataFrame(rows, "path string, width bigint, height bigint")


def words(c):
    return F.size(F.split(c, r"\s+"))


def group(**more):
    return read_config({"reasoning_edit": {"dataset_names": ["one"], "image_transform_args": RESIZE, "vit_image_transform_args": VIT, **more}})[0]


def test_lengths_count_texts_and_resized_images(spark):
    got = group_lengths(group(), {"one": edits(spark, 5)}, images(spark, 5, {("a", 2), ("b", 3)}), "sample_id", words).collect()
    prompt = len(sg.REASONING_PROMPT.split())
    # 64 x 32 at stride 16 is 8 tokens, twice; 56 x 28 at stride 14 is 8; six segments with two marks each.
    want = {i: 12 + prompt + 2 + i % 4 + 1 + 8 + 8 + 8 for i in (0, 1, 4)}
    assert {r.sample_id: r.length for r in got} == want  # samples 2 and 3 lack an image


def test_a_kind_without_a_rule_leaves_its_samples_out(spark):
    assert group_lengths(group(vit_image_transform_args=None), {"one": edits(spark, 3)}, images(spark, 3), "sample_id", words).collect() == []


def test_limits_and_unknown_data_sets(spark):
    got = group_lengths(group(num_used_data=[4]), {"one": edits(spark, 9)}, images(spark, 9), "sample_id", words).collect()
    assert sorted(r.sample_id for r in got) == [0, 1, 2, 3]
    with pytest.raises(KeyError, match="unknown data set 'one'"):
        group_lengths(group(), {}, images(spark, 1), "sample_id", words)


def test_draws_wrap_and_mandatory_groups_open_every_pack(spark):
    register_source("plain_test", lambda df, keys: sg.edit_segments(df, keys, style="plain"))
    common = {"image_transform_args": RESIZE, "vit_image_transform_args": VIT}
    config = read_config({
        "reasoning_edit": {"dataset_names": ["one"], "weight": 2, **common},
        "plain_test": {"dataset_names": ["two", "three"], "num_used_data": [3, 2], "weight": 0, "is_mandatory": True, **common},
    })
    sources = {"one": edits(spark, 7), "two": edits(spark, 7), "three": edits(spark, 7)}
    rows = training_feed(config, sources, images(spark, 7), 40, 3, words, RULE).collect()
    drawn = sorted(r.draw_id for r in rows if r.draw_id is not None)
    assert drawn == list(range(40)) and {r.group for r in rows if r.draw_id is not None} == {"reasoning_edit"}
    for r in rows:
        if r.draw_id is not None:
            assert r.shard == r.draw_id % 3
    first = {}
    for r in rows:
        if r.status == "packed" and r.pack_pos == 0:
            first[r.shard, r.pack_no] = (r.group, r.source, r.sample_id)
    assert {g for g, _, _ in first.values()} == {"plain_test"}
    assert {x[1:] for x in first.values()} <= {("two", 0), ("two", 1), ("two", 2), ("three", 0), ("three", 1)}


def test_real_token_ids_can_be_counted(spark):
    """Texts counted by a byte-pair encoder: the tokens of the column replace the words."""
    from packloom.operators.tokens import pretokens

    got = group_lengths(group(), {"one": edits(spark, 2)}, images(spark, 2), "sample_id", lambda c: F.size(pretokens(c))).collect()
    assert len(got) == 2 and all(r.length > 24 for r in got)
