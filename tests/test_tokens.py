"""Byte-pair encoding against a slow restatement."""

import random
import unicodedata

import regex
from pyspark.sql import functions as F

from packloom.catalog.segments import MERGES, VOCAB
from packloom.operators import tokens as tk


def slow_ids(text):
    alphabet = tk.byte_alphabet()
    out = []
    for word in regex.findall(tk.WORD_PATTERN, unicodedata.normalize("NFC", text)):
        symbols = [alphabet[b] for b in word.encode("utf-8")]
        for a, b in MERGES * 2:  # rank order; a second round must change nothing
            i = 0
            while i < len(symbols) - 1:
                if symbols[i] == a and symbols[i + 1] == b:
                    symbols[i : i + 2] = [a + b]
                i += 1
        out += [VOCAB[s] for s in symbols]
    return out


TEXTS = [
    "Then the other thing, don't WE'LL  see 12345?", "", " \n\n lead\r\n x ", "de l'équation, le fin é", "été   wide　gap",
    "日本語 text 🙂🙂", "tabs\t\tend  ", "'S 'T it's", "thth ththth   the", None,
]


def test_encode_and_decode(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    rows = {r.i: r for r in tk.bpe_decode(tk.bpe_encode(df, MERGES, VOCAB, "text"), VOCAB, out="back").collect()}
    for i, text in enumerate(TEXTS):
        assert rows[i].ids == slow_ids(text or ""), text
        assert rows[i].back == unicodedata.normalize("NFC", text or "")
        assert rows[i].n_tokens == len(rows[i].ids)


def test_words_split_like_the_pattern(spark, tables):
    docs = tables["documents"].select("text", tk.pretokens(F.col("text")).alias("w")).collect()
    assert all(r.w == regex.findall(tk.WORD_PATTERN, r.text) for r in docs)


def test_unknown_symbols_take_the_unk_id(spark):
    df = spark.createDataFrame([("zz",)], "text string")
    vocab = {"a": 0}
    assert tk.bpe_encode(df, [], vocab, "text", unk=7).first().ids == [7, 7]


def test_broken_bytes_are_replaced(spark):
    alphabet = tk.byte_alphabet()
    ids = [VOCAB[alphabet[b]] for b in b"ok\xff\xc3"]
    df = spark.createDataFrame([(ids,)], "ids array<bigint>")
    assert tk.bpe_decode(df, VOCAB).first().text == b"ok\xff\xc3".decode("utf-8", "replace")


def test_dictionary_counts_words(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the", "then", "on"]) for _ in range(30)) for _ in range(20)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.word: (r.n_uses, r.ids) for r in tk.word_dictionary(df, MERGES, VOCAB, "text").collect()}
    assert sum(n for n, _ in got.values()) == 600
    assert all(ids == slow_ids(w) for w, (_, ids) in got.items())


def test_decode_null_and_unknown_ids(spark):
    import pytest

    from packloom.operators.tokens import bpe_decode

    vocab = {"a": 0, "b": 1}
    df = spark.createDataFrame([(1, [0, 1]), (2, None), (3, [])], "k int, ids array<bigint>")
    assert [r.text for r in bpe_decode(df, vocab).orderBy("k").collect()] == ["ab", None, ""]
    with pytest.raises(Exception, match="KeyError"):
        bpe_decode(spark.createDataFrame([(1, [0, 9])], "k int, ids array<bigint>"), vocab).collect()


def test_cluster_needs_a_shared_folder():
    import pytest

    from packloom.session import checkpoint_dir

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())


def test_batches_of_words_like_single_words():
    import pyarrow as pa

    from packloom.operators.tokens import _encode_batch

    encode = lambda word: tuple(word.encode())
    texts = [["ab", "c"], [], ["c", "c", "ab", ""], ["é"]]
    want = [[b for word in words for b in word.encode()] for words in texts]
    whole = pa.array(texts, pa.list_(pa.string()))
    assert _encode_batch(whole, encode).to_pylist() == want
    assert _encode_batch(whole.slice(2), encode).to_pylist() == want[2:]
    assert _encode_batch(whole.slice(1, 1), encode).to_pylist() == [[]]
    assert _encode_batch(whole.slice(0, 0), encode).to_pylist() == []


def test_batches_are_cut_by_elements_and_long_words_are_not_kept(spark, monkeypatch):
    """A batch of many words is handled in slices of whole texts, a long text in slices of words."""
    import pyarrow as pa

    lists = pa.array([["a"] * n for n in (3, 0, 2, 9, 1, 0)], pa.list_(pa.string()))
    cuts = [[len(x) for x in part.to_pylist()] for part in tk._slices(lists.slice(1), 4)]
    assert sum(cuts, []) == [0, 2, 9, 1, 0] and all(sum(c) <= 4 or len(c) == 1 for c in cuts)
    monkeypatch.setattr(tk, "SLICE", 5)
    words = [["ab", "c", "", "é"] * 4, ["c"], []]
    assert tk._encode_batch(pa.array(words, pa.list_(pa.string())), lambda w: tuple(w.encode())).to_pylist() == [list("".join(w).encode()) for w in words]
    df = spark.createDataFrame([("x" * 5000 + " then",)], "text string")
    make = tk._encoder(df, MERGES, VOCAB, -1)
    assert list(make()("x" * 5000)) == slow_ids("x" * 5000)
