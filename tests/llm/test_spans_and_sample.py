"""Repeated spans where texts share an id; the toxicity sample and its edge rows."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from packloom.llm import repeated_spans, string_kernel
from packloom.llm.queries import LLM_QUERIES

from ..compare import ROOT

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def run(prefix, n):
    return " ".join(f"{prefix}{i}" for i in range(n))


@pytest.mark.parametrize("hot", [1000, 1])
def test_texts_that_share_an_id_are_documents_of_their_own(spark, hot, monkeypatch):
    monkeypatch.setattr(repeated_spans, "HOT", hot)
    a, b = run("a", 80), run("b", 60)
    rows = [(1, a), (2, a), (2, "b c d"), (2, "x " + b + " y"), (2, b), (3, b + " " + a), (3, "tail " + b), (3, "tail " + b), (None, a), (4, None), (4, ""), (4, a)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("sub", F.lit("clash")).withColumn("marked", F.lit(1))
    subs = {t: s for t, s in df.where("text IS NOT NULL").select("text", F.xxhash64("text")).collect()}
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in repeated_spans.remove_repeats(df).collect())
    seen, want = set(), {}
    for key in sorted({(i, subs.get(t, 0), t or "") for i, t in rows if i is not None}):
        words, gone = WORD.findall(key[2]), set()
        for at in range(len(words) - 19):
            window = tuple(words[at : at + 20])
            if window in seen:
                gone.update(range(at, at + 20))
            seen.add(window)
        want[key[0], key[2]] = (key[0], len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone))
    assert got == sorted([want[i, t or ""] for i, t in rows if i is not None] + [(0, 80, 0, a)])


def test_the_sample_is_the_smallest_digests_of_each_label(spark):
    texts = [f"text number {i // 2}" for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(7, "other text of seven"), (None, "no id"), (9, None), (7, texts[7])], "doc_id bigint, text string")
    docs = docs.withColumn("name", F.lit("clash")).withColumn("id", F.lit(1)).withColumn("label", F.lit(5))
    labels = [(i, int(i % 5 == 0)) for i in range(380)] + [(7, 1), (11, None), (None, 1), (12, 3), (7, 1)]
    labels = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = string_kernel.sampled(docs, labels, rows=30).collect()
    joined = docs.select("doc_id", "text").join(labels, "doc_id").where("text IS NOT NULL AND toxic IN (0, 1)").collect()
    marked = {t: max(r.toxic for r in joined if r.text == t) for t in {r.text for r in joined}}
    want = set()
    for label in (0, 1):
        names = sorted((hashlib.sha256(t.encode()).hexdigest(), t) for t, y in marked.items() if y == label)
        want |= {(t, label) for _, t in names[:30]}
    assert {(r.text, r.label) for r in got} == want and len(got) == 60


def test_no_text_is_shuffled_for_the_sample(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(
        string_kernel, "staged", lambda df, name, write=string_kernel.staged: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name)
    )
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, toxic int")
    string_kernel.sampled(docs, labels).collect()
    assert len(plans) == 2
    for plan in plans:
        for line in plan.splitlines():
            assert not re.search(r"Exchange hashpartitioning\(.*text", line)


@pytest.mark.parametrize("labels", [[], [(4, 1)], [(4, 0)], [(4, 1), (6, 0), (9, 1)]])
def test_edge_rows_are_fitted_and_scored(spark, labels):
    """No labels, one side only, both; NULL, empty, blank, very long texts and a NULL id are scored 0 to 1."""
    long = " ".join(f"w{i % 97}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "you idiot"), (5, long), (6, long), (None, "no id " * 30), (8, "x" * 50_000), (4, "you idiot"), (9, "é 日本 🙂\r\nß")]
    df = spark.createDataFrame([(*r, "s", 1.5, 3) for r in rows], "doc_id bigint, text string, row string, score double, words int")
    model = string_kernel.fit(df, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    got = string_kernel.score(df, model).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(map(str, (r[0] for r in rows)))
    assert all(0 <= r.score <= 1 and r.row == "s" and r.words == 3 for r in got)
    blank = {r.score for r in got if r.doc_id in (1, 2, 3)}
    assert len(blank) == 1 and blank.pop() < 0.7
    assert string_kernel.score(df.limit(0), model).collect() == []


def test_toxicity_reaches_what_the_readme_says(spark):
    """Held-out labelled rows of the largest table: 0.8 of the toxic ones, 0.01 of the clean ones at most."""
    folder = f"{ROOT}/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    rows = LLM_QUERIES["op2_string_kernel"](spark, folder).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.8 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)


def test_training_holds_a_block_of_word_features_at_a_time():
    """The features of 12,000 words, 25 MB, are never in memory whole, and the machine is the same."""
    import random
    import tracemalloc

    from packloom.llm import string_kernel

    draw = random.Random(5)
    clean = sorted({"".join(draw.choices("etaoinsrhld", k=draw.randint(4, 9))) for _ in range(12_500)} - {"kaput", "kaputt"})[:12_000]
    suspects = [(w, 9, 0) for w in ("kaputt", "wirdkub", "fobkaw")]
    tracemalloc.start()
    try:
        model = string_kernel.fit_words(suspects, [w for w, _, _ in suspects], [(w, 1) for w in clean])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(model.codes) > 200
    assert peak < 40e6
    assert min(model.margins([w for w, _, _ in suspects])) > max(model.margins(clean[:500]))
