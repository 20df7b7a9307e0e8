"""Evidence operators on small cases: nulls, ties, overlaps, repeated rows, empty tables."""

import hashlib

from pyspark.sql import functions as F

from tallyframe.operators import evidence as E


def found(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_choice(spark):
    df = spark.createDataFrame([("√适用 □不适用",), ("□ 适用\t√不适用",), ("√适用√不适用",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(E.choice(F.col("t"))).collect()] == [True, False, None, None, None]


def test_in_sections(spark):
    sections = spark.createDataFrame([(1, 2, 5, "a"), (1, 4, None, "b"), (2, 0, 3, "c"), (None, 0, None, "n"), (3, None, None, "x")], "d int, start int, stop int, section string")
    blocks = spark.createDataFrame([(1, 1), (1, 2), (1, 4), (1, 9), (2, 2), (2, 2), (2, 3), (None, 1), (3, 1), (2, None)], "d int, o int")
    want = {(1, 1, None), (1, 2, "a"), (1, 4, "b"), (1, 9, "b"), (2, 2, "c"), (2, 3, None), (None, 1, None), (3, 1, None), (2, None, None)}
    got = found(E.in_sections(blocks, sections, "d", "o"), "d", "o", "section")
    assert set(got) == want and len(got) == 10
    assert E.in_sections(blocks.limit(0), sections, "d", "o").count() == 0
    assert {r[2] for r in found(E.in_sections(blocks, sections.limit(0), "d", "o"), "d", "o", "section")} == {None}


def test_merged_baselines(spark):
    df = spark.createDataFrame([(1, 0.5, 3, "b"), (1, -0.5, 1, "a"), (1, 1.5, 1, "c"), (1, 2.5, 2, None), (2, 0.0, 1, "d")], "p int, y double, x int, t string")
    assert found(E.merged_baselines(df, "p", "y", "x", "t"), "p", "baseline", "line", "x0", "x1", "y0", "y1") == [
        (1, 0, "a b", 1, 3, -0.5, 0.5), (1, 2, "c", 1, 2, 1.5, 2.5), (2, 0, "d", 1, 1, 0.0, 0.0),
    ]


def test_header_consensus(spark):
    rows = [(1, "s", 1, "l1"), (1, "s", 2, "l2"), (2, "s", 1, "x"), (2, "t", 2, "y"), (3, "s", 1, "x"), (3, None, 2, "y"), (4, None, 1, "z")]
    df = spark.createDataFrame(rows, "k int, s string, o int, l string")
    got = {r["k"]: (r["agreed"], r["l"]) for r in E.header_consensus(df, ["k"], "s", "o", "l").collect()}
    assert got == {1: (True, "l2"), 2: (False, None), 3: (False, None), 4: (False, None)}


def test_lookups(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k int")
    titles = spark.createDataFrame([(1, 7), (2, 8), (2, 8)], "k int, v int")
    assert set(found(E.unique_first(docs, "k", titles, "v"), "k", "status", "v")) == {(1, "ok", 7), (2, "ambiguous", None), (3, "not_found", None), (None, "not_found", None)}
    verdicts = spark.createDataFrame([(1, "a", "verified"), (1, "b", None), (2, "a", "x"), (2, "a", "x")], "k int, m string, v string")
    asked = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "a")], "k int, m string")
    none = "missing_or_ambiguous"
    assert found(E.keyed_verdict(asked, verdicts, ["k", "m"], "v"), "k", "m", "v") == [(1, "a", "verified"), (1, "b", none), (2, "a", none), (3, "a", none)]


def test_reconciled(spark):
    left = spark.createDataFrame([(1, 5), (2, 5), (3, 5), (4, 1), (4, 1), (6, None)], "k int, v int")
    right = spark.createDataFrame([(1, 5), (2, 6), (4, 1), (5, 1), (6, 1)], "k int, v int")
    assert found(E.reconciled(left, right, ["k"], "v"), "k", "status") == [(1, "equal"), (2, "conflict"), (3, "missing_right"), (4, "ambiguous"), (5, "missing_left"), (6, "conflict")]
    assert E.reconciled(left.limit(0), right.limit(0), ["k"], "v").count() == 0


def test_run_status(spark):
    df = spark.createDataFrame([(1, "ok"), (1, "ok"), (2, "ok"), (2, "x"), (3, "bad"), (3, "ok"), (4, None)], "k int, s string")
    assert found(df.groupBy("k").agg(E.run_status("s", "ok", "bad").alias("r")), "k", "r") == [(1, "completed"), (2, "completed_with_issues"), (3, "verification_failed"), (4, "completed_with_issues")]


def test_signal_issues(spark):
    df = spark.createDataFrame([("a", "1"), ("b", "1.0"), ("b", "2"), (None, "1"), ("", "1e5"), ("c", None)], "id string, v string")
    assert found(E.signal_issues(df, "id", "v"), "id", "n", "issues") == [("", 2, "missing_id,float_value"), ("a", 1, ""), ("b", 2, "duplicate_id,float_value"), ("c", 1, "")]


def test_claim_places(spark):
    facts = spark.createDataFrame([(1, 10, True), (1, 11, True), (1, 11, True), (2, 10, False), (4, 10, True)], "t int, evidence int, verified boolean")
    rows = [(1, "fact", [11, 10, 10]), (1, "fact", [10]), (2, "fact", [10]), (3, "fact", []), (4, "interpretation", [10]), (4, "fact", None), (None, "fact", [10])]
    claims = spark.createDataFrame(rows, "t int, kind string, cited array<int>")
    places = [(r["t"], r["cited"], r["place"]) for r in E.claim_places(claims, facts, "t").collect()]
    assert sorted(p[2] for p in places) == ["interpretations", *["pending"] * 5, "verified_claims"]
    assert len(places) == 7 and (1, [11, 10, 10], "verified_claims") in places and (4, [10], "interpretations") in places


def test_manifest(spark):
    df = spark.createDataFrame([(1, 2, None), (1, 1, "x")], "k int, n int, s string")
    body = '[{"n":1,"s":"x"},{"n":2,"s":null}]'
    assert found(E.manifest(df, "k", "n", "s"), "k", "body", "sha256") == [(1, body, hashlib.sha256(body.encode()).hexdigest())]
