"""Words on pages and answers of models on small cases: nulls, edges, brackets, faults in order, empty tables."""

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import page_words
from tallyframe.operators import tokens as T


def test_page_and_clip_text(spark):
    lines = spark.createDataFrame([(1, 7, 2, "b"), (1, 7, 1, "a"), (1, 7, 3, None), (1, 6, 1, "x"), (2, 6, 1, "y")], "d int, p int, o int, t string")
    assert [tuple(r) for r in T.page_text(lines, "d", "p", 7, "o", "t").collect()] == [(1, "a b")]
    boxes = spark.createDataFrame([(1, 1, 0.0, 2.0, 0.0, 1.0), (2, 1, 5.0, 6.0, 0.0, 1.0), (3, 2, 0.0, 9.0, 0.0, 9.0), (4, None, 0.0, 9.0, 0.0, 9.0)], "box int, p int, x0 double, x1 double, y0 double, y1 double")
    words = spark.createDataFrame([(1, 2.0, 0.0, "b"), (1, 1.0, 0.0, "a"), (1, 0.0, 1.0, "c"), (1, 2.1, 0.0, "out"), (None, 1.0, 1.0, "n"), (2, 1.0, None, "n")], "p int, x double, y double, word string")
    got = {r["box"]: r["clip"] for r in T.clip_text(boxes, words, "p").collect()}
    assert got == {1: "a b c", 2: "", 3: "", 4: ""}
    assert T.clip_text(boxes.limit(0), words, "p").count() == 0


@pytest.mark.parametrize(
    ("pieces", "amounts"),
    [
        (["-", "5.00"], ["-5.00"]),
        (["−", "1,000"], ["-1,000"]),
        (["(", "5.00", ")"], ["(5.00)"]),
        (["(", "5.00"], [None]),
        (["5.00", ")"], [None]),
        (["x", "5.00", "6"], ["5.00", "6"]),
        (["-", None, "5.00"], ["5.00"]),
        ([], []),
    ],
)
def test_joined_amounts(spark, pieces, amounts):
    df = spark.createDataFrame([(1, 10 * i, 10 * i + 4, t) for i, t in enumerate(pieces)], "l int, x0 int, x1 int, token string")
    assert [r["amount"] for r in T.joined_amounts(df, ["l"], 8).orderBy("x0").collect()] == amounts


def test_pieces_too_far_apart(spark):
    df = spark.createDataFrame([(1, 0, 1, "-"), (1, 10, 14, "5.00"), (2, 0, 4, "-"), (1, 30, 34, "6.00")], "l int, x0 int, x1 int, token string")
    assert [r["amount"] for r in T.joined_amounts(df, ["l"], 8).orderBy("x0").collect()] == ["5.00", "6.00"]


def test_answer_issue(spark):
    cases = {
        '{"opinion": "fine", "refs": [1, 2]}': "ok",
        '{"refs": [], "opinion": ""}': "ok",
        '{"opinion": "fine"': "invalid_json",
        "[1]": "invalid_json",
        "": "invalid_json",
        None: "invalid_json",
        '{"opinion": "fine"}': "wrong_keys",
        '{"opinion": "fine", "refs": [1], "more": 1}': "wrong_keys",
        '{"opinion": null, "refs": [1]}': "wrong_types",
        '{"opinion": "fine", "refs": [null]}': "wrong_types",
        '{"opinion": "longer than ten 7", "refs": [9]}': "too_long",
        '{"opinion": "up 5", "refs": [9]}': "digits",
        '{"opinion": "fine", "refs": [1, 1, 2, 9]}': "too_many",
        '{"opinion": "fine", "refs": [9, 9]}': "duplicate_id",
        '{"opinion": "fine", "refs": [9]}': "unknown_id",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, a string")
    issue = T.answer_issue(F.col("a"), F.array(F.lit(1).cast("long"), F.lit(2).cast("long")), 10, 3)
    assert [r[0] for r in df.orderBy("i").select(issue).collect()] == list(cases.values())


def test_cited_analyses(spark):
    confirmed = spark.createDataFrame([(1, 5, True), (2, 6, True), (3, 7, False), (4, None, True)], "id int, value int, verified boolean")
    rows = [("ok", 1, 1, 5), ("ok", 2, 2, 6), ("back", 1, 2, 6), ("back", 2, 1, 5), ("twice", 1, 1, 5), ("twice", 2, 1, 5), ("none", 1, 9, 5), ("not", 1, 3, 7), ("off", 1, 2, 7), ("null", 1, 4, None)]
    got = {r[0]: r[1] for r in T.cited_analyses(spark.createDataFrame(rows, "k string, ordinal int, id int, value int"), confirmed, "k").collect()}
    assert got == {"ok": "ok", "back": "unordered", "twice": "unordered", "none": "missing", "not": "unverified", "off": "value_mismatch", "null": "ok"}


def test_visual_lines_shuffle_words_once(spark):
    words = spark.createDataFrame([(d, 1, x, y, x + 5, y + 9, f"w{d}") for d in range(3) for x, y in ((10.0, 1.0), (2.0, 3.0), (1.0, 3.6), (1.0, 6.5), (7.0, 6.5))], "doc int, page int, x0 double, y0 double, x1 double, y1 double, word string")
    lines = page_words.visual_lines(words)
    assert lines._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = sorted((r["doc"], r["line"], r["y"], [w["x0"] for w in r["words"]]) for r in lines.collect())
    assert got == [(d, *x) for d in range(3) for x in ((0, 1.0, [2.0, 10.0]), (1, 3.6, [1.0]), (2, 6.5, [1.0, 7.0]))]
