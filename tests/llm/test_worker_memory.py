"""What the Python workers of the pipeline's operators hold."""

import random
import tracemalloc

import pytest

from packloom.llm import bpe_replay, string_kernel, words

RANKS = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"cd": 257, b"abcd": 258}


def _texts(n_texts=600, n_words=250):
    draw = random.Random(3)
    return [" ".join("".join(draw.choices("abcdefgh", k=8)) for _ in range(n_words)) for _ in range(n_texts)]


def _peak(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_encoding_holds_a_slice_and_the_remembered_words(monkeypatch):
    monkeypatch.setattr(bpe_replay, "MEMORY_BYTES", 1 << 20)
    texts = _texts()
    encoder = bpe_replay.Encoder(RANKS, r" ?\S+|\s+", bpe_replay.SEGMENTS)
    assert _peak(lambda: encoder.encode(texts)) < 120


def test_examining_holds_the_words_of_a_slice(spark, monkeypatch):
    found = {}

    def run_of(df, run, schema):
        found["run"] = run
        return df.mapInArrow_(run, schema)

    frame = type(spark.range(0))
    monkeypatch.setattr(frame, "mapInArrow_", frame.mapInArrow, raising=False)
    monkeypatch.setattr(frame, "mapInArrow", run_of)
    sizes = []
    monkeypatch.setattr(string_kernel.Model, "margins", lambda self, some: sizes.append(len(some)) or string_kernel.np.zeros(len(some)))
    model = string_kernel.fit_words([], [], [])
    df = spark.createDataFrame([("a",)], "text string")
    string_kernel.examine(df, model)
    import pyarrow as pa

    texts = _texts()
    batch = pa.RecordBatch.from_arrays([pa.array([{"text": t} for t in texts]), pa.array(texts)], names=["row", "text"])
    (out,) = found["run"](iter([batch]))
    assert out.num_rows == len(texts) and set(out.column(3).to_pylist()) <= set(range(240, 251))
    assert max(sizes) <= string_kernel.SLICE_CHARS // 4


@pytest.mark.parametrize("texts", [[], [None], ["", None, "ab cd", "x" * 50, "abcd " * 9, None]])
def test_slices_are_whole_texts_in_order(texts, monkeypatch):
    whole = bpe_replay.Encoder(RANKS, r" ?\S+|\s+", bpe_replay.SEGMENTS).encode(texts)
    for size in (1, 7, 1000):
        assert [t for some in words.text_slices(texts, size) for t in some] == texts
        monkeypatch.setattr(bpe_replay, "SLICE_CHARS", size)
        assert bpe_replay.Encoder(RANKS, r" ?\S+|\s+", bpe_replay.SEGMENTS).encode(texts) == whole


def test_a_worker_keeps_one_thing_only():
    one = words.kept("one", list)
    assert words.kept("one", list) is one
    words.kept("two", dict)
    assert words.kept("one", list) is not one
    words.forget()
    assert not words._KEPT
