"""Layout columns against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from packloom.operators import layout as ly

COLUMNS = (
    "shard bigint, pack_no bigint, pack_pos bigint, sample_id bigint, seg_pos bigint, kind string, n_tokens bigint, "
    "enable_cfg int, loss int, split_start boolean, split_end boolean, frame_delta bigint, dropped boolean, text_ids array<bigint>"
)


def random_rows(seed, packs=6):
    rng = random.Random(seed)
    rows, sample = [], 0
    for p in range(packs):
        for pos in range(rng.randint(1, 4)):
            sample += 1
            for seg in range(rng.randint(1, 5)):
                kind = rng.choice(["text", "vit_image", "vae_image"])
                n = rng.randint(1, 6)
                loss = rng.randint(0, 1) if kind != "vit_image" else 0
                dropped = loss == 0 and rng.random() < 0.2
                ids = [rng.randint(10, 99) for _ in range(n)] if kind == "text" else None
                rows.append((0, p, pos, sample, seg, kind, n, 1 - loss, loss, True, True, None, dropped, ids))
    return rows


def walk(rows):
    """Straight restatement over one pack's rows: offsets, rope, arrays."""
    out = {k: [] for k in ("ids", "indexes", "positions", "labels", "ce", "vae", "mse", "vit", "samples", "splits", "modes")}
    starts, curr = {}, 0
    for pos in sorted({r[2] for r in rows}):
        rope, length = 0, 0
        for r in sorted((r for r in rows if r[2] == pos), key=lambda r: r[4]):
            *_, seg, kind, n, _, loss, _, _, delta, dropped, ids = r[:14]
            starts[(r[3], seg)] = (curr, rope)
            if dropped:
                rope += kind != "text"
                continue
            if kind == "text":
                out["ids"] += [1, *ids, 2]
                out["indexes"] += range(curr, curr + n + 2)
                out["positions"] += range(rope, rope + n + 2)
                if loss:
                    out["labels"] += [*ids, 2]
                    out["ce"] += range(curr, curr + n + 1)
                out["modes"].append("causal")
                rope += n + 2
            else:
                out["ids"] += [3, 4]
                out["indexes"] += [curr, curr + n + 1]
                out["positions"] += [rope] * (n + 2)
                out["vae" if kind == "vae_image" else "vit"] += range(curr + 1, curr + 1 + n)
                noisy = kind == "vae_image" and loss
                if noisy:
                    out["mse"] += range(curr + 1, curr + 1 + n)
                out["modes"].append("noise" if noisy else "full")
                rope += 0 if noisy else 1
            out["splits"].append(n + 2)
            curr += n + 2
            length += n + 2
        if length:
            out["samples"].append(length)
    return starts, out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pack_records_like_a_walk(spark, seed):
    rows = random_rows(seed)
    df = ly.rope_positions(ly.segment_offsets(spark.createDataFrame(rows, COLUMNS)))
    placed = {(r.sample_id, r.seg_pos): (r.start, r.rope) for r in df.collect()}
    special = ly.SpecialTokens(1, 2, 3, 4)
    records = {r.pack_no: r for r in ly.pack_records(ly.with_timesteps(df, 9), special).collect()}
    for p in {r[1] for r in rows}:
        starts, want = walk([r for r in rows if r[1] == p])
        assert {k: placed[k] for k in starts} == starts
        if not want["samples"]:
            assert p not in records
            continue
        got = records[p]
        names = {
            "packed_text_ids": "ids", "packed_text_indexes": "indexes", "packed_position_ids": "positions",
            "packed_label_ids": "labels", "ce_loss_indexes": "ce", "packed_vae_token_indexes": "vae",
            "mse_loss_indexes": "mse", "packed_vit_token_indexes": "vit",
        }
        for column, key in names.items():
            assert (got[column] or []) == list(want[key]), column
        assert got.sample_lens == want["samples"] and sum(want["samples"]) == got.sequence_length
        assert got.split_lens == want["splits"] and got.attn_modes == want["modes"]
        assert len(got.packed_timesteps or []) == len(want["vae"])


def test_records_draw_by_seed_and_merge_splits(spark):
    rows = [
        (0, 0, 1, 2, 0, "text", 2, 1, 0, True, True, None, True, [5, 6]),
        (0, 0, 1, 2, 1, "vae_image", 3, 0, 1, True, True, None, False, None),
        (0, 0, 0, 1, 0, "text", 3, 1, 0, True, True, None, False, [7, 8, 9]),
        (0, 0, 0, 1, 1, "vae_image", 4, 0, 1, True, False, 5, False, None),
        (0, 0, 0, 1, 2, "vae_image", 4, 0, 1, False, False, 7, False, None),
        (0, 0, 0, 1, 3, "vae_image", 4, 0, 1, False, True, None, False, None),
        (0, 1, 0, 3, 0, "text", 2, 1, 0, True, True, None, True, [1, 1]),
    ]
    df = spark.createDataFrame(rows, COLUMNS)
    special = ly.SpecialTokens(1, 2, 3, 4)
    (got,) = ly.pack_records(df, special, seed=9).collect()
    assert got.sample_lens == [23, 5] and got.split_lens == [5, 18, 5] and got.attn_modes == ["causal", "full", "noise"]
    assert got.packed_position_ids == [*range(5), *[5] * 6, *[10] * 6, *[17] * 6, *[0] * 5]
    assert len(set(got.packed_timesteps)) == 2 and got.packed_timesteps[0] == got.packed_timesteps[11]
    (column,) = ly.pack_records(ly.with_timesteps(df, 9), special).collect()
    assert column.packed_timesteps == got.packed_timesteps
    assert got.packed_vit_token_indexes is None and got.packed_label_ids is None


def test_records_of_no_rows(spark):
    assert ly.pack_records(spark.createDataFrame([], COLUMNS), ly.SpecialTokens(1, 2, 3, 4), seed=1).collect() == []


def test_record_plan_has_no_window(spark):
    df = spark.createDataFrame(random_rows(1), COLUMNS)
    plan = ly.pack_records(df, ly.SpecialTokens(1, 2, 3, 4), seed=1)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1


def test_visible_pairs_count_a_brute_mask(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for sample in range(60):
        layout = [(rng.randint(1, 7), rng.choice(["causal", "full", "noise"])) for _ in range(rng.randint(1, 6))]
        ids = np.repeat(np.arange(len(layout)), [n for n, _ in layout])
        modes = np.array([m for _, m in layout])[ids]
        q, k = np.meshgrid(np.arange(len(ids)), np.arange(len(ids)), indexing="ij")
        same = ids[q] == ids[k]
        visible = ((q >= k) | (same & (modes[q] != "causal"))) & ~((modes[k] == "noise") & ~same)
        want[sample] = int(visible.sum())
        rows += [(0, 0, sample, sample, i, n, m) for i, (n, m) in enumerate(layout)]
    df = spark.createDataFrame(rows, "shard bigint, pack_no bigint, pack_pos bigint, sample_id bigint, split_no bigint, split_len bigint, mode string")
    assert {r.sample_id: r.visible for r in ly.visible_pairs(df).collect()} == want


def test_video_frames_share_a_split(spark):
    rows = [
        (0, 0, 0, 1, 0, "text", 3, 1, 0, True, True, None, False, None),
        (0, 0, 0, 1, 1, "vae_image", 4, 0, 1, True, False, 5, False, None),
        (0, 0, 0, 1, 2, "vae_image", 4, 0, 1, False, False, 7, False, None),
        (0, 0, 0, 1, 3, "vae_image", 4, 0, 1, False, True, None, False, None),
    ]
    df = spark.createDataFrame(rows, COLUMNS)
    got = ly.splits(df).orderBy("split_no").collect()
    assert [(r.split_len, r.mode) for r in got] == [(5, "causal"), (18, "full")]
    laid = ly.rope_positions(ly.segment_offsets(df))
    assert [r.rope for r in laid.orderBy("seg_pos").collect()] == [0, 5, 10, 17]
    steps = [r.timestep for r in ly.with_timesteps(laid, 1).orderBy("seg_pos").collect()]
    assert steps[0] is None and steps[1] == steps[2] == steps[3]


def test_stretched_patches_like_float_buckets(spark):
    side = 64
    shapes = [(h, w) for h in (1, 2, 3, 7, 31, 33, 63, 64) for w in (1, 5, 13, 48, 64)]
    df = spark.createDataFrame([(h * 16, w * 16) for h, w in shapes], "h bigint, w bigint")
    got = {(r.h // 16, r.w // 16): r.p for r in df.select("h", "w", ly.patch_positions(F.col("h"), F.col("w"), 16, side, True).alias("p")).collect()}
    bounds = np.arange(1, side) / side
    for h, w in shapes:
        rows = np.searchsorted(bounds, np.arange(h) / h + 1e-12, side="right")
        cols = np.searchsorted(bounds, np.arange(w) / w + 1e-12, side="right")
        assert got[(h, w)] == (rows[:, None] * side + cols).flatten().tolist()


@pytest.mark.parametrize("name", ["patch_positions", "patch_positions_stretched"])
def test_position_sums_move_no_patch_rows(spark, name):
    """Positions are summed where they are made; images of one id count together."""
    from packloom.catalog import QUERIES

    class T(dict):
        spark = None

    sizes = [(1, 640, 480), (1, 640, 480), (2, 300, 900)]
    images = spark.createDataFrame(sizes, "image_id bigint, width int, height int")
    df = QUERIES[name](T(images=images))
    assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()
    got = {r.image_id: r for r in df.collect()}
    assert set(got) == {1, 2} and got[1].n % 2 == 0
    once = {r.image_id: r for r in QUERIES[name](T(images=images.distinct())).collect()}
    assert [2 * x for x in once[1][1:]] == list(got[1][1:])


def test_positions_of_missing_sides_are_none(spark):
    df = spark.createDataFrame([(32, 48), (None, 48), (32, None), (8, 48), (48, 8)], "h int, w int")
    rows = [r.p for r in df.select(ly.patch_positions(F.col("h"), F.col("w"), 16, 64).alias("p")).collect()]
    assert rows == [[0, 1, 2, 64, 65, 66], [], [], [], []]
