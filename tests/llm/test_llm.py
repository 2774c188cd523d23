"""The corpus operators against plain restatements, SQL checks, round trips and edge rows."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

pytest.importorskip("packloom.llm")

from pyspark.sql import functions as F  # noqa: E402

from packloom.llm import (  # noqa: E402
    benchmark_matches,
    bpe_replay,
    jaccard_join,
    line_chunks,
    path_templates,
    preference_pairs,
    quality_rules,
    repeated_spans,
    stages,
    string_kernel,
    text_density,
)
from packloom.llm.queries import LLM_ORACLES, LLM_QUERIES, vocabulary  # noqa: E402

from ..compare import ROOT, differences, duck  # noqa: E402

FOLDER = f"{ROOT}/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, id bigint, row string, marked string, __score string, digest string"


def docs(spark, texts):
    """Documents numbered from 0, with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 7, "r", "m", "s", "d") for i, t in enumerate(texts)], DOCS)


def odd_rows(spark):
    long = " ".join(f"w{i % 97}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, long), (6, long), (7, "a b\n" * 50), (None, "no id " * 30), (8, "x" * 50_000), (4, "one"), (9, "é 日本 🙂\r\nß")]
    return spark.createDataFrame([(*r, 7, "r", "m", "s", "d") for r in rows], DOCS)


def texts_of(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_matches_duckdb(spark, name):
    assert differences(LLM_QUERIES[name](spark, FOLDER), duck(FOLDER), LLM_ORACLES[name]) is None


@pytest.mark.parametrize("empty", [True, False])
def test_edge_rows(spark, empty):
    df = odd_rows(spark).where("false") if empty else odd_rows(spark)
    n = df.count()
    ranks, pattern = vocabulary()
    assert quality_rules.quality_rules(df).count() == n
    assert bpe_replay.round_trip(df, ranks, pattern, bpe_replay.SEGMENTS).count() == n
    assert set(bpe_replay.encode(df, ranks, pattern).columns) == {*df.columns, "ids"}
    lines = line_chunks.dedup_lines(df)
    assert lines.columns == [*df.columns, line_chunks.REMOVED] and lines.count() == n
    assert repeated_spans.remove_repeats(df).count() == n
    near = jaccard_join.near_copies(df)
    assert near.count() == df.where("doc_id IS NOT NULL").select("doc_id").distinct().count()
    assert jaccard_join.one_of_each(df).count() == (0 if empty else n - 1)
    items = spark.createDataFrame([(1, None), (2, ""), (3, "no id no id"), (None, "one"), (4, "zz yy xx ww")], "item_id bigint, text string")
    assert benchmark_matches.contaminated(df, items).count() == 0
    assert benchmark_matches.contaminated(df, items.where("false")).count() == 0
    model = string_kernel.fit_words([], [], [])
    assert string_kernel.score(df, model).columns == [*df.columns, "score"]
    pages = df.selectExpr("doc_id AS page_id", "text AS url", "text AS html", "row", "digest")
    assert text_density.extract(pages).count() == n
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1)], "page_id bigint, good int")
    assert path_templates.judged(pages, labels).count() == n
    turns = df.selectExpr("doc_id AS conv_id", "id AS turn", "row AS role", "text", "digest")
    pairs = preference_pairs.formatted(preference_pairs.neighbour_pairs(turns)).collect()
    assert len(pairs) == (0 if empty else 5)


def test_html_main_text():
    page = (
        "<html><body class='has-sidebar'><header><h1>Site</h1></header><nav><a href=x>a</a></nav><div class='ad'>buy</div>"
        "<article><h1>T &amp; u</h1><p>One <b>t</b>wo.<br>three<p>4 &lt; 5&nbsp;!<div class='comments'><p>me too</div>"
        "<form>name</form></article><aside>s</aside><script>var a='</p>';</script><footer>f</footer>"
    )
    assert text_density.main_text(page) == "T & u One two. three 4 < 5 !"
    assert [text_density.main_text(x) for x in (None, "", "<p>", "<script>x", "<!-- open")] == [""] * 5
    assert text_density.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_html_pages_hold_their_article(spark):
    from html import unescape

    for r in LLM_QUERIES["op1_text_density"](spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        inner = re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1|br)>", " ", inner))
        assert r.text == " ".join(unescape(inner).split()) and r.n_chars == len(r.text)


def test_kernel_is_the_subsequence_kernel():
    def slow(a, b):
        total = 0.0
        for p in itertools.combinations(range(len(a)), string_kernel.ORDER):
            for q in itertools.combinations(range(len(b)), string_kernel.ORDER):
                if [a[i] for i in p] == [b[j] for j in q]:
                    total += string_kernel.DECAY ** (p[-1] - p[0] + 1 + q[-1] - q[0] + 1)
        return total

    pairs = [("idiot", "idxiot"), ("abcabc", "abc"), ("ab", "abc"), ("aaaa", "aaa"), ("", "abc")]
    got = string_kernel.kernel(string_kernel._codes([a for a, _ in pairs]), string_kernel._codes([b for _, b in pairs]))
    assert got == pytest.approx([slow(a, b) for a, b in pairs])


def test_features_are_all_kernel_values():
    """Every value, small ones included; words under three letters and letters no landmark has count as they do in the kernel."""
    marks = ["idiot", "abcabcabc", "worthless", "ß", "é日本語"]
    words = ["idiot", "i", "", "zzz", "tabcot", "aabbcc", "日本x語", "worth" * 4, "x" * 24, *marks]
    model = string_kernel._first_model(marks)
    model.weights, model.bias = np.array([3.0, -1.0, 0.5, 7.0, 2.0]), -0.25
    one = lambda a, b: float(string_kernel.kernel(string_kernel._codes([a]), string_kernel._codes([b]))[0])
    want = [[one(w, m) / max((one(w, w) * one(m, m)) ** 0.5, 1e-30) for m in marks] for w in words]
    assert model.features(words) == pytest.approx(np.array(want))
    assert model.margins(words).tolist() == pytest.approx([sum(v * h for v, h in zip(row, model.weights)) + model.bias for row in want])
    empty = string_kernel._first_model([])
    assert empty.features(["idiot"]).shape == (1, 0) and empty.margins(["idiot", ""]).tolist() == [-1.0, -1.0]


def test_toxicity_held_out(spark):
    folder = f"{ROOT}/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    rows = LLM_QUERIES["op2_string_kernel"](spark, folder).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted for r in toxic) >= 0.6 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.1 * len(clean)
    wins = sum((a.score > b.score) + 0.5 * (a.score == b.score) for a in toxic for b in clean)
    assert wins >= 0.9 * len(toxic) * len(clean)


def test_gapped_insults_are_close():
    clean = [(w, 9) for w in "the quick brown fox jumps over lazy dogs while reading modern literature".split()]
    model = string_kernel.fit_words([("idiot", 9, 0), ("worthless", 9, 0)], ["idiot", "worthless"], clean)
    margin = lambda w: model.margins([string_kernel.letters_of(w)])[0]
    assert all(margin(w) > 0 for w in ("idiot", "i.d.i.o.t", "idxiot", "worth_less", "worthlessly"))
    assert all(margin(w) < 0 for w in ("modern", "reading", "zebra"))
    assert "idiot" in string_kernel.words_of("you I D I O T you")


def test_benchmark_distance_and_pieces():
    rng = random.Random(1)

    def slow(pattern, words):
        row = list(range(len(pattern) + 1))
        best = row[-1]
        for w in words:
            new = [0]
            for i, p in enumerate(pattern):
                new.append(min(new[-1] + 1, row[i + 1] + 1, row[i] + (p != w)))
            row = new
            best = min(best, row[-1])
        return best

    for _ in range(200):
        pattern = [rng.choice("abcd") for _ in range(rng.randint(1, 12))]
        words = [rng.choice("abcd") for _ in range(rng.randint(0, 20))]
        masks = {c: sum(1 << i for i, p in enumerate(pattern) if p == c) for c in pattern}
        assert benchmark_matches.myers(masks, len(pattern), words)[0] == slow(pattern, words)
        # Whatever is within the budget is found through a piece.
        k = int(len(pattern) * 0.2)
        found = benchmark_matches.Matcher([(5, pattern)], 0.2).matches(" ".join(words))
        assert bool(found) == (slow(pattern, words) <= k)


def test_benchmark_edits_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(benchmark_matches, "BLOCK_BYTES", 1)
    words = [f"w{i}" for i in range(40)]
    near = [*words[:7], "new", *words[8:20], *words[21:]]
    far = [w if i % 3 else "other" for i, w in enumerate(words)]
    df = docs(spark, ["a b " + " ".join(near) + " c", " ".join(far), "Q1 " * 9 + " ".join(words).upper()])
    items = spark.createDataFrame([(10, " ".join(words)), (11, "not in there at all")], "item_id bigint, text string")
    assert sorted((r.doc_id, r.item_id, r.n_edits) for r in benchmark_matches.contaminated(df, items).collect()) == [(0, 10, 2), (2, 10, 0)]
    assert [r.doc_id for r in benchmark_matches.decontaminate(df, items).collect()] == [1]


def test_blocks_are_released_and_share_one_plan(spark, monkeypatch):
    """Many blocks: one scan of the hits, every broadcast destroyed, the same rows as one block."""
    words = [f"w{i}" for i in range(60)]
    df = docs(spark, [" ".join(words[k : k + 30]) for k in range(0, 30, 5)])
    items = spark.createDataFrame([(k, " ".join(words[k : k + 8])) for k in range(0, 50, 4)], "item_id bigint, text string")
    whole = sorted(map(tuple, benchmark_matches.contaminated(df, items).collect()))
    released = []
    kind = type(spark.sparkContext.broadcast(0))
    monkeypatch.setattr(kind, "destroy", lambda self, blocking=False, destroy=kind.destroy: released.append(self) or destroy(self, blocking))
    monkeypatch.setattr(benchmark_matches, "BLOCK_BYTES", 60)
    found = benchmark_matches.contaminated(df, items)
    assert len(released) > 5
    assert found._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1
    assert whole and sorted(map(tuple, found.collect())) == whole


@pytest.mark.parametrize("hot", [1000, 2])
def test_repeats_against_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(repeated_spans, "HOT", hot)
    texts = texts_of(spark)
    periodic = "a b c " * 40 + " ".join(f"u{i}" for i in range(30)) + " a b c" * 20
    texts.update({5000: periodic, 5001: periodic[5:] + " end", 5002: "", 5003: "z " * 60})
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in repeated_spans.remove_repeats(df).collect()}
    seen = set()
    for key in sorted(texts):
        words = WORD.findall(texts[key] or "")
        gone = set()
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                gone.update(range(i, i + 20))
            seen.add(window)
        assert got[key] == (len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)), key


def test_line_chunks_against_brute_force(spark):
    rng = random.Random(3)
    block = [f"shared line {i}" for i in range(12)]
    own = lambda k: [f"own {k} {rng.random()}" for _ in range(6)]
    texts = ["\n".join(own(k) + (block if k % 2 else block[:3] + ["inserted"] + block[3:]) + own(k)) for k in range(8)]
    texts += ["same\nsame\nsame\nsame\nsame", "\n".join(block * 2), "", "single", "\n\n\n\n"]
    got = {r.doc_id: (r.text, r[line_chunks.REMOVED]) for r in line_chunks.dedup_lines(docs(spark, texts)).collect()}
    seen = set()
    for key, text in enumerate(texts):
        lines, gone = text.split("\n"), set()
        for _, body, a, b in line_chunks.multi_line(text):
            if body in seen:
                gone.update(range(a, b))
            seen.add(body)
        assert got[key] == ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone))
    assert sum(n for _, n in got.values()) > 20


def test_line_passages_against_runs_of_lines(spark):
    rng = random.Random(11)
    passages = [[f"passage {n} {k} line {i}" for i in range(n)] for n in (2, 3, 4) for k in range(6)]
    passages[0].insert(1, " ")
    texts = []
    for k in range(40):  # each between lines of its own, at the start, at the end, or beside another
        lines = [x for j in range(3) for x in (rng.choice(passages) + [f"own {k} {j} {i}" for i in range(rng.randrange(3))])]
        texts.append("\n".join([f"head {k}"] * rng.randrange(2) + lines))
    texts += ["once\n\nheld", "once\nheld", "\n once\n\nheld", "x\nonce\n\nheld\n"]
    got = {r.doc_id: (r.text, r[line_chunks.REMOVED]) for r in line_chunks.dedup_lines(docs(spark, texts)).collect()}
    before: set[str] = set()
    for key, text in enumerate(texts):
        lines, gone = text.split("\n"), set()
        for a in range(len(lines)):
            ends = [b for b in range(a + 2, len(lines) + 1) if lines[a].strip() and lines[b - 1].strip()]
            gone.update(i for b in ends if "\n".join(lines[a:b]) in before for i in range(a, b))
            before.update("\n".join(lines[a:b]) for b in ends)
        assert got[key] == ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)), key


def test_exact_copies_leave_no_remnant(spark):
    import corpus_pipeline

    rng = random.Random(4)
    texts = ["\n".join(f"text {k} line {i}" for i in range(k % 9 + 2)) for k in range(30)]
    texts += ["\n".join(rng.choice(["", " \t", f"gap {k} {i}"]) for i in range(12)) + f"\nend {k}\nlast {k}\n\n" for k in range(30)]
    df = docs(spark, texts * 3).withColumn("n_chars", F.length("text").cast("bigint"))
    left = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_dedup(spark, df, FOLDER).collect()}
    assert left == {k: (text, len(text)) for k, text in enumerate(texts)}


def test_near_copies_against_brute_force(spark):
    rng = random.Random(5)
    texts = texts_of(spark)
    base = [f"v{rng.randrange(500)}" for _ in range(120)]
    for k in range(60):  # one group of near copies, some of them two balls apart
        words = list(base)
        for _ in range(k % 5):
            words[rng.randrange(120)] = f"e{k}"
        texts[9000 + k] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.near_copies(df).collect()}
    sets = {}
    for key, text in texts.items():
        words = WORD.findall(text or "")
        sets[key] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())
    links = {k: set() for k in texts}
    for a, b in itertools.combinations(sorted(texts), 2):
        common = len(sets[a] & sets[b])
        if common and common / len(sets[a] | sets[b]) >= 0.8:
            links[a].add(b)
            links[b].add(a)
    for key in texts:
        reached, todo = {key}, [key]
        while todo:
            for other in links[todo.pop()] - reached:
                reached.add(other)
                todo.append(other)
        assert got[key] == (min(reached), len(links[key])), key


def test_bands_reach_the_recall():
    bands, rows = jaccard_join.bands_and_rows(0.8, 0.9999)
    assert bands * rows <= jaccard_join.MOST_HASHES and 1 - (1 - 0.8**rows) ** bands >= 0.9999


def test_components_of_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101)], "a bigint, b bigint")
    got = {r.id: r.root for r in stages.components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and {got[i] for i in (100, 101, 103)} == {100}


def test_bpe_equals_the_library(spark):
    import numpy as np
    import public_tokenizers
    import tiktoken

    ranks, pattern = vocabulary()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    odd = ["a" * 3000, "ab" * 999, " " * 999 + "x", "\n \n\t\n", "<|endoftext|>", "it's I'LL \x1c\x1d\x85   z"]
    odd += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x600), rng.randrange(0x3000, 0xA000), 9, 10, 32, 0x1F600])) for _ in range(80)) for _ in range(200)]
    encoders = [bpe_replay.Encoder(ranks, pattern, s) for s in (None, bpe_replay.SEGMENTS)]
    for text in odd:
        want = np.array(library.encode_ordinary(text), dtype="<u4").tobytes()
        assert [e.encode([text])[0] for e in encoders] == [want, want]
    texts = texts_of(spark)
    for r in LLM_QUERIES["op10_bpe_replay"](spark, FOLDER).collect():
        ids = np.array(library.encode_ordinary(texts[r.doc_id] or ""), dtype="<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_bpe_column_round_trip(spark):
    ranks, pattern = vocabulary()
    df = bpe_replay.decode(bpe_replay.encode(docs(spark, ["é 日本 x", None, ""]), ranks, pattern), ranks)
    assert [bytes(r.decoded).decode() for r in df.orderBy("doc_id").collect()] == ["é 日本 x", "", ""]


def test_small_and_deep_branches_keep_their_verdict(spark):
    # 30 equal sections of a host, 2 of them bad; below a fixed beginning, one bad branch at the sixth segment.
    urls = [(f"http://wide.net/s{i % 30}/p{i}", i % 30 >= 2) for i in range(1200)]
    urls += [(f"http://deep.net/a/b/c/d/e/{'bad' if i % 4 == 0 else f'g{i % 4}'}/p{i}", i % 4 != 0) for i in range(400)]
    urls += [(f"http://plain.net/a/b/c/d/e{i}/f/g", i % 9 != 0) for i in range(90)]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "page_id bigint, url string")
    labels = spark.createDataFrame([(i, int(g)) for i, (_, g) in enumerate(urls)], "page_id bigint, good int")
    got = {r.page_id: r for r in path_templates.judged(pages, labels).collect()}
    for i, (url, good) in enumerate(urls):
        if "plain" in url:
            assert (got[i].template, got[i].verdict) == ("/*/*/*/*/**", "allow")
        else:
            assert got[i].verdict == ("allow" if good else "block"), url
    assert {r.template for r in got.values() if r.host == "deep.net" and r.verdict == "block"} == {"/*/*/*/*/*/bad/**"}
    assert {r.template for r in got.values() if r.host == "wide.net"} == {"/s0/*", "/s1/*", "/*/*"}


def test_preference_prefix(spark):
    turns = spark.createDataFrame(
        [(0, 0, "user", "q"), (0, 1, "assistant", "good"), (1, 0, "user", "q"), (1, 1, "assistant", "bad"), (1, 2, "user", "why"), (2, 0, "user", "alone"), (0, 0, "user", "q")],
        "conv_id bigint, turn bigint, role string, text string",
    )
    first, second = preference_pairs.formatted(preference_pairs.neighbour_pairs(turns)).orderBy("pair_id").collect()
    assert (first.n_common, first.prompt) == (1, "<|user|>\nq<|end|>\n")
    assert first.chosen == "<|assistant|>\ngood<|end|>\n" and first.chosen_mask == "14-26"
    assert first.rejected_mask == "14-25" and first.rejected.endswith("<|user|>\nwhy<|end|>\n")
    assert (second.n_common, second.prompt, second.rejected, second.rejected_mask) == (0, "", None, None)


def test_pipeline_stages(spark):
    import corpus_pipeline

    folder = f"{ROOT}/sf0.001"
    df = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = df.columns, df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, folder).cache()
        assert seen.columns == columns, name
        assert seen.count() > 0
    # What is left has no benchmark item, no near copies and no repeated chunk.
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    assert benchmark_matches.contaminated(seen, items).count() == 0
    assert jaccard_join.near_copies(seen).where("n_links > 0").count() == 0
    kept = {r.doc_id for r in seen.collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == kept


@pytest.mark.parametrize("empty", [True, False])
def test_stages_on_odd_rows(spark, empty):
    """NULLs, empty and long texts, repeated rows and clashing columns pass each stage; only copies and repeated lines go."""
    import corpus_pipeline

    folder = f"{ROOT}/sf0.001"
    df = odd_rows(spark).withColumn("n_chars", F.length("text").cast("bigint"))
    df = df.where("false") if empty else df
    every = sorted(str(r.doc_id) for r in df.collect())
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, df, folder)
        left = sorted(str(r.doc_id) for r in got.collect())
        if name == "token_ids":
            assert got.columns == ["doc_id", "n_tokens", "ids"] and left == every
            assert all(r.n_tokens == 0 and r.ids == [] for r in got.where("doc_id <= 2").collect())
            continue
        assert got.columns == df.columns, name
        assert left == [i for i in every if not (name == "near_copies" and i == "6")], name
        if name == "line_dedup" and not empty:
            one = got.where("doc_id = 7").first()
            assert one.text.split() == ["a", "b"] and one.n_chars == len(one.text)
            assert got.where("doc_id = 1 AND text IS NULL AND n_chars IS NULL").count() == 1
