"""The judge's work list: what is asked, what fails, and where contents travel."""

import base64

import pytest
from pyspark.sql import functions as F

from packloom.plans.judging import judge_work

TEMPLATES = {1: "same? {instruct}", 2: "why? {instruct} {reference}", 3: "look"}


@pytest.fixture
def folder(spark, tmp_path):
    for name, size in {"in1.png": 3, "in2.png": 4, "ref.png": 5, "out1.jpg": 6, "out1.jpeg": 7, "out2.png": 8, "big.png": 5000, "out5.png": 2}.items():
        (tmp_path / name).write_bytes(bytes([size % 251]) * size)
    return f"file:{tmp_path}"


def items(spark, root):
    rows = [
        ("a", "do", "r", "e", "in1.png", "ref.png", "out1"),  # output as jpg, before jpeg
        ("b", "do", None, None, "in2.png", "ref.png", "out2"),
        ("c", "do", None, None, "in1.png", "gone.png", "out9"),  # reference first, then output
        ("d", "do", None, None, "in1.png", "ref.png", "out9"),
        ("e", "do", None, None, "big.png", "ref.png", "out5"),
        ("f", "do", None, None, "lost.png", "ref.png", "out5"),
        ("g", "do", None, None, "in1.png", "ref.png", "in1"),  # one file in two roles
        ("done", "do", None, None, "in1.png", "ref.png", "out1"),
        ("n", "do", None, None, "in1.png", None, "out1"),
    ]
    place = lambda x: None if x is None else f"{root}/{x}"
    rows = [(k, i, r, e, place(o), place(ref), place(s)) for k, i, r, e, o, ref, s in rows]
    return spark.createDataFrame(rows, "item_key string, instruction string, rules string, reference_effect string, original_path string, reference_path string, output_stem string")


def test_requests_hold_images_and_failures_their_reason(spark, folder):
    files = spark.read.format("binaryFile").load(folder)
    done = spark.createDataFrame([("done",), ("else",)], "item_key string")
    work, failures = judge_work(items(spark, folder), done, files, TEMPLATES, system="be strict", most_bytes=1000)
    got = {(r.item_key, r.dim): r.messages for r in work.collect()}
    assert sorted(got) == [(k, d) for k in "abg" for d in (1, 2, 3)]
    url = lambda n: "data:image/jpeg;base64," + base64.b64encode(bytes([n]) * n).decode()
    system, user = got["a", 2]
    assert system.role == "system" and system.content[0].text == "be strict"
    assert [(c.type, c.text, c.url) for c in user.content] == [
        ("text", "why? r\ndo e", None), ("image_url", None, url(3)), ("image_url", None, url(5)), ("image_url", None, url(6)),
    ]
    assert [c.url for c in got["g", 1][1].content] == [None, url(3), url(3)]
    error = {r.item_key: r.error.replace(folder + "/", "") for r in failures.collect()}
    assert error == {
        "c": "Image not found: gone.png", "d": "Cannot find edited image at: out9.png", "e": "Image too large: big.png",
        "f": "Image not found: lost.png", "n": "Image not found: None",
    }


def test_contents_are_read_once_and_only_at_the_end(spark, folder):
    files = spark.read.format("binaryFile").load(folder)
    done = spark.createDataFrame([], "item_key string, error string")
    work, failures = judge_work(items(spark, folder), done, files, TEMPLATES, retry_errors=True)
    scans = lambda df: [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan binaryFile" in x]
    assert len([s for s in scans(work) if "content" in s.split("ReadSchema")[1]]) == 1
    assert not scans(failures)
    assert {r.item_key for r in work.select("item_key").collect()} == {"a", "b", "e", "g", "done"}


def test_nothing_to_do(spark, folder):
    files = spark.read.format("binaryFile").load(folder)
    some = items(spark, folder)
    work, failures = judge_work(some, some.select("item_key"), files, TEMPLATES)
    assert work.collect() == [] == failures.collect()
