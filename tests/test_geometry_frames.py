"""Resize geometry and frame plans against plain Python and NumPy."""

import random

import numpy as np
from pyspark.sql import functions as F

from packloom.functions import geometry as ge
from packloom.operators import frames as fr
from packloom.operators import segments as sg


def resize(w, h, rule, n=1):
    def scaled(w, h, s):
        grid = lambda x: max(rule.stride, int(round(x / rule.stride) * rule.stride))
        return grid(round(w * s)), grid(round(h * s))

    s = max(min(rule.max_size / max(w, h), 1.0), rule.min_size / min(w, h))
    w, h = scaled(w, h, s)
    if rule.max_pixels and w * h > rule.max_pixels / n:
        w, h = scaled(w, h, rule.max_pixels / n / (w * h))
    if max(w, h) > rule.max_size:
        w, h = scaled(w, h, rule.max_size / max(w, h))
    return w, h


def test_resize(spark):
    rng = random.Random(8)
    shapes = [(rng.randint(1, 5000), rng.randint(1, 5000), rng.randint(1, 6)) for _ in range(800)]
    shapes += [(1, 4000, 1), (10000, 10, 2), (512, 512, 1), (1024, 1024, 3), (16, 16, 1)]
    df = spark.createDataFrame([(i, *s) for i, s in enumerate(shapes)], "i int, w bigint, h bigint, n int")
    for rule in (ge.TRAIN_VAE, ge.INFER_OUTPUT, ge.TRAIN_VIT, ge.CHAT_VIT, ge.ResizeRule(700, 300, 14, 90_000)):
        got = {r.i: (r.s.width, r.s.height) for r in df.select("i", ge.resized(F.col("w"), F.col("h"), rule, F.col("n")).alias("s")).collect()}
        for i, (w, h, n) in enumerate(shapes):
            assert got[i] == resize(w, h, rule, n), (w, h, n, rule)
            assert got[i][0] % rule.stride == got[i][1] % rule.stride == 0


def frames_of(spark, column, vlens, n=6, fps=25):
    df = spark.createDataFrame([(v, n, fps) for v in vlens], "vlen bigint, n bigint, fps int")
    return {r.vlen: r.f for r in df.select("vlen", column.alias("f")).collect()}


VLENS = [1, 2, 5, 6, 7, 30, 299]


def intervals(vlen, n):
    k = min(n, vlen)
    cuts = [i * vlen // k for i in range(k + 1)]
    return list(zip(cuts, [c - 1 for c in cuts[1:]]))


def padded(frames, n):
    return frames + [frames[-1]] * (n - len(frames))


def test_middle_and_fixed_start(spark):
    got = frames_of(spark, fr.interval_frames(F.col("vlen"), F.col("n"), "middle"), VLENS)
    assert got == {v: padded([(a + b) // 2 for a, b in intervals(v, 6)], 6) for v in VLENS}
    got = frames_of(spark, fr.interval_frames(F.col("vlen"), F.col("n"), "middle", fix_start=3), VLENS)
    assert got == {v: padded([a + 3 for a, _ in intervals(v, 6)], 6) for v in VLENS}


def test_random_stays_inside_its_intervals(spark):
    got = frames_of(spark, fr.interval_frames(F.col("vlen"), F.col("n"), "rand", seed=1, key=F.col("vlen")), VLENS)
    for v in VLENS:
        assert len(got[v]) == 6
        spans = intervals(v, 6)
        if all(a < b for a, b in spans):
            assert all(a <= f < b for f, (a, b) in zip(got[v], spans))
        else:  # too short: a sorted subset of distinct frames, padded
            head = got[v][: min(6, v)]
            assert head == sorted(set(head)) and set(head) <= set(range(v))


def test_fps_spread_and_step(spark):
    got = frames_of(spark, fr.fps_frames(F.col("vlen"), F.col("fps"), 3.0), VLENS)
    for v in VLENS:
        seconds = np.arange(0 + 1 / 6, v / 25 + 1 / 6, 1 / 3)
        assert got[v] == [f for f in np.around(seconds * 25).astype(int).tolist() if f < v]
    got = frames_of(spark, fr.spread_frames(F.col("vlen"), F.lit(5)), VLENS)
    assert got == {v: [i * (v - 1) // 4 for i in range(5)] for v in VLENS}
    got = frames_of(spark, fr.step_frames(F.col("vlen"), F.col("fps"), 4.0), VLENS)
    assert got == {v: [int(i) for i in np.arange(0, v - 1, 25 / 4.0)] for v in VLENS}


def test_chat_segments_edges(spark):
    rows = [
        (1, 0, "human", "<image> a <image>b<image>", 2),
        (1, 1, "gpt", " kept <image> as is ", 2),
        (1, 2, "system", "gone", 2),
        (2, 0, "human", "<image>", 0),
        (3, 0, "human", " plain ", 1),
    ]
    df = spark.createDataFrame(rows, "sample_id bigint, turn bigint, speaker string, value string, n_images bigint")
    got = sg.chat_segments(df, ["sample_id"]).orderBy("sample_id", "turn", "piece", "part").collect()
    assert [(r.sample_id, r.kind, r.text, r.loss) for r in got] == [
        (1, "vit_image", None, 0), (1, "text", "a", 0), (1, "vit_image", None, 0), (1, "text", "b", 0),
        (1, "text", " kept <image> as is ", 1), (3, "text", " plain ", 0),
    ]
    assert {r.sample_id for r in sg.require_loss(sg.chat_segments(df, ["sample_id"])).collect()} == {1}


def test_chain_stays_inside_the_images(spark):
    rows = [(i, [f"i{j}" for j in range(n)], [[f"t{j}{a}" for a in range(3)] for j in range(n - 1)]) for i, n in enumerate([1, 2, 3, 4, 9] * 30)]
    df = spark.createDataFrame(rows, "k bigint, image_list array<string>, instruction_list array<array<string>>")
    plan = {r.k: r for r in sg.chain_plan(df, "k", 3).collect()}
    assert set(plan) == {k for k, images, _ in rows if len(images) > 1}
    for k, images, _ in rows:
        if k in plan:
            p = plan[k]
            assert 0 <= p.start < p.end <= min(p.start + 2, len(images) - 1)
    segments = {}
    for r in sg.chain_segments(df, "k", 3).orderBy("seg_pos").collect():
        segments.setdefault(r.k, []).append(r)
    for k, rows_of in segments.items():
        p = plan[k]
        turns = 1 if p.joined else p.end - p.start
        assert sum(r.kind == "text" for r in rows_of) == turns
        assert rows_of[-1].image == f"i{p.end}" and rows_of[-1].loss == 1 and rows_of[-1].enable_cfg == 0
        assert len(rows_of) == 2 + 4 * turns - 2
