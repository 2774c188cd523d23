"""Merkle manifest, fill-in-middle and exact top-k against plain restatements and at their edges."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from packloom.llm import fill_middle as fm
from packloom.llm import merkle_manifest as mm
from packloom.llm import topk_search as tk

sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


# --- Merkle manifest -------------------------------------------------------------------


def plain_tree(leaves, fanout):
    """(root, siblings per leaf level by level, as (left, right))."""
    proofs = [[] for _ in leaves]
    nodes, members = list(leaves), [[i] for i in range(len(leaves))]
    while len(nodes) > 1:
        above, grouped = [], []
        for i in range(0, len(nodes), fanout):
            run = nodes[i : i + fanout]
            for j in range(len(run)):
                for leaf in members[i + j]:
                    proofs[leaf].append(("".join(run[:j]), "".join(run[j + 1 :])))
            above.append(sha("".join(run)))
            grouped.append(sum(members[i : i + fanout], []))
        nodes, members = above, grouped
    return nodes[0], proofs


def plain_manifest(rows, fanout):
    """rows (lang, doc_id, leaf, seen) to the sorted result."""
    langs = sorted({r[0] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        mine = sorted((r for r in rows if r[0] == lang), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3] or ""))
        trees[lang] = (mine, *plain_tree([r[2] for r in mine], fanout))
    root, tops = plain_tree([trees[x][1] for x in langs], fanout)
    out = []
    for lang, top in zip(langs, tops):
        mine, subroot, proofs = trees[lang]
        for (_, doc_id, leaf, seen), proof in zip(mine, proofs):
            node = seen or leaf
            for left, right in proof + top:
                node = sha(left + node + right)
            out.append((doc_id, leaf, subroot, root, "".join(a + b for a, b in proof + top), node))
    return sorted(out, key=repr)


@pytest.mark.parametrize("fanout,levels,n", [(2, 1, 90), (8, 1, 700), (3, 2, 200), (8, 4, 60)])
def test_manifest_equals_plain_trees(spark, fanout, levels, n):
    """Several rounds of the butterfly, ragged last groups, a NULL, an empty and a one-leaf tree, repeated rows."""
    rng = random.Random(n)
    langs = ["en"] * 6 + ["de", "de", "", None, "é", "zz"]
    rows = [(rng.choice(langs), rng.choice([None, *range(n)]), sha(str(i // 2)), sha(f"x{i}") if i % 3 == 0 else None) for i in range(n)]
    rows += [("one", 5, sha("lone"), None)] + rows[:7]
    df = spark.createDataFrame(rows, "lang string, doc_id bigint, leaf string, seen string").withColumn("tree", F.lit("clash")).withColumn("pos", F.lit(0)).repartition(5)
    got = mm.manifest(df, F.col("lang"), F.col("doc_id"), F.col("leaf"), F.col("seen"), fanout, levels)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_manifest(rows, fanout)


def test_manifest_of_nothing_and_of_one_row(spark):
    schema = "lang string, doc_id bigint, leaf string"
    run = lambda rows: mm.manifest(spark.createDataFrame(rows, schema), F.col("lang"), F.col("doc_id"), F.col("leaf")).collect()
    assert run([]) == []
    leaf = sha("a")
    assert [tuple(r) for r in run([(None, None, leaf)])] == [(None, leaf, leaf, leaf, "", leaf)]


def test_leaf_keeps_null_empty_and_byte_counts(spark):
    rows = [(None, ""), (12, "éx"), (-3, None)]
    got = spark.createDataFrame(rows, "a bigint, b string").select(mm.leaf_hash(F.col("a"), F.col("b")).alias("h")).collect()
    assert [r.h for r in got] == [sha("-0:"), sha("2:123:éx"), sha("2:-3-")]


# --- fill in the middle ------------------------------------------------------------------


def plain_middle(doc_id, text):
    text = text or ""
    digest = sha("1:" + ("" if doc_id is None else str(doc_id)))
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    if not text or any(m in text for m in fm.MARKERS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def odd_texts(rng, n):
    words = ["a", "<", ">", "P", "<P", "S>", "<M>", "é", "中", "\U0001f600", "\n", "é", "word " * 20, "\x00"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    shared = "".join(rng.choice("abcdefgh é") for _ in range(5000))
    return texts + [None, "", "x", "<", "<P>", shared, "1" + shared, shared + shared, "z" * 100_000, "\U0001f600" * 40_000, "<P" + "y" * 70_000 + ">"]


def test_middle_equals_plain_cuts_and_restores(spark):
    rng = random.Random(7)
    rows = [(None if i % 50 == 7 else i // 2, t) for i, t in enumerate(odd_texts(rng, 300))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n", F.lit("clash")).withColumn("kept", F.lit(1))
    done = fm.fill_in_middle(df).withColumn("back", fm.restored(F.col("output"), F.col("form")))
    assert done.columns == ["doc_id", "text", "kept", "n", "form", "prefix_chars", "middle_chars", "output", "back"]
    got = done.collect()
    assert len(got) == len(rows) and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_middle(r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert fm.fill_in_middle(df.limit(0)).collect() == []


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_markers_across_chunk_edges_are_found(monkeypatch, size):
    """Chunks of a few bytes: every marker crosses edges, every code point may be split."""
    monkeypatch.setattr(fm, "LONGEST", size)
    rng = random.Random(size)
    texts = odd_texts(rng, 60)[:-4]
    number = pa.array([rng.randrange(1 << 32) for _ in texts])
    other = pa.array([rng.randrange(1 << 32) for _ in texts])
    got = fm.cuts_of(pa.array(texts, pa.string()), number, other, memo=fm.Memo()).to_pylist()
    for text, x, y, r in zip(texts, number.to_pylist(), other.to_pylist(), got):
        text = text or ""
        a, b = sorted((x % (len(text) + 1), y % (len(text) + 1)))
        assert (r["n"], r["marked"], r["from_point"], r["to_point"]) == (len(text), any(m in text for m in fm.MARKERS), a, b)
        assert (r["from_byte"], r["to_byte"]) == (len(text[:a].encode()), len(text[:b].encode()))


def test_shared_passages_share_chunks_and_slices_do_not_matter(monkeypatch):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(20_000)).encode()
    data = b"".join([b"head" * 99, passage])
    ends = lambda raw: fm.chunk_ends(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))
    whole, alone = ends(data), ends(passage)
    cut = lambda raw, at: {raw[a:b] for a, b in zip([0, *at], at)}
    assert len(cut(data, whole) & cut(passage, alone)) > 0.9 * len(alone) > 20
    monkeypatch.setattr(fm, "SLICE_BYTES", 1000)
    assert ends(data).tolist() == whole.tolist()


def test_memo_stays_small_and_right():
    memo, rng = fm.Memo(most=2000), random.Random(1)
    for _ in range(500):
        chunk = bytes(rng.randrange(256) for _ in range(rng.randint(1, 40)))
        points, marked, head, tail = memo.summary(chunk, (b"<P>",), 2)
        assert points == sum(b & 0xC0 != 0x80 for b in chunk) and marked == (b"<P>" in chunk) and (head, tail) == (chunk[:2], chunk[-2:])
    assert sum(len(c) for g in (memo.young, memo.old) for c in g) < 6000


# --- exact top-k -------------------------------------------------------------------------


def plain_top(rows, k, is_query):
    def whole(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(256 * x) for x in v]

    good = [(i, whole(v)) for i, v in rows if i is not None and whole(v) is not None]
    out = []
    for i, q in good:
        if is_query(i):
            found = [(max(-tk.LIMIT, min(tk.LIMIT, sum(a * b for a, b in zip(q, c)))), j) for j, c in good if j != i and len(c) == len(q)]
            found = sorted(found, key=lambda x: (-x[0], x[1]))[:k]
            out += [(i, rank + 1, j, score) for rank, (score, j) in enumerate(found)]
    return sorted(out)


def vector_rows(seed):
    rng = random.Random(seed)
    draw = lambda size=1.0: [rng.uniform(-size, size) for _ in range(6)]
    hot = draw()
    rows = [(i, hot if i % 3 == 0 else draw()) for i in range(240)]
    rows += [(300, None), (None, draw()), (301, [1.0, None] + draw()[:4]), (302, [float("nan")] * 6), (303, [float("inf")] + draw()[:5])]
    rows += [(304, []), (350, []), (305, draw()[:3]), (400, draw()[:3]), (50, draw()), (50, hot), (7, hot)]
    return rows, draw


@pytest.mark.parametrize("k,bins", [(1, 4096), (5, 16), (300, 64)])
def test_top_k_equals_brute_force(spark, monkeypatch, k, bins):
    """Ties over a hot vector, repeated and NULL ids, bad components, other lengths, more wanted than there are, many rounds and blocks."""
    monkeypatch.setattr(tk, "QUERY_ROWS", 3)
    monkeypatch.setattr(tk, "CANDIDATE_ROWS", 40)
    rows, _ = vector_rows(k)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("block", F.lit("clash")).withColumn("n", F.lit(1))
    got = tk.top_k(df.where("vec_id % 10 = 0"), df, k, bins=bins).collect()
    assert sorted(map(tuple, got)) == plain_top(rows, k, lambda i: i % 10 == 0)


def test_top_k_of_large_numbers_stays_exact(spark):
    rows, draw = vector_rows(11)
    rows = [(i, draw(10.0 ** (i % 5 * 4))) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = tk.top_k(df, df, 4).collect()
    assert sorted(map(tuple, got)) == plain_top(rows, 4, lambda i: True)


def test_top_k_of_empty_tables(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [0.5])], "vec_id bigint, embedding array<float>")
    assert tk.top_k(df.limit(0), df).collect() == [] == tk.top_k(df, df.limit(0)).collect()
    assert [tuple(r) for r in tk.top_k(df.where("vec_id = 1"), df).collect()] == [(1, 1, 2, 256 * 128)]


def test_blocks_meet_once_and_their_copies_are_not_broadcast(spark, monkeypatch):
    """Each side is copied for its cells, which Spark's estimate leaves out: at 600,000 vectors a broadcast of them ended the query."""
    monkeypatch.setattr(tk, "QUERY_ROWS", 3)
    monkeypatch.setattr(tk, "CANDIDATE_ROWS", 10)
    df = spark.createDataFrame([(i, [i / 100, 0.5, -0.25]) for i in range(100)], "vec_id bigint, embedding array<float>")
    queries = tk.blocks(df.where("vec_id % 10 = 0"), "vec_id", "embedding", tk.SCALE, 3, "queries")
    candidates = tk.blocks(df, "vec_id", "embedding", tk.SCALE, 10, "candidates")
    state = queries.selectExpr("block as q_block", "0 as row", "0L as edge", "1L as span", "1L as want")
    met = tk._meet(queries, candidates, state, (4, 3))
    pairs = [(r.q_block, bytes(r.c_ids)) for r in met.collect()]
    assert len(pairs) == len(set(pairs)) == queries.count() * candidates.count()
    joins = [line for line in met._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line and "down" in line]
    assert joins and not [line for line in joins if "Broadcast" in line]
