import datetime as dt

from tallyframe.operators import relations as R

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string"


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def test_next_within(spark):
    rows = [(1, at(0), 1, "a"), (2, at(5), 1, "x"), (3, at(10), 1, "b"), (4, at(10), 1, "a"), (5, at(25), 1, "b"), (6, at(25), 1, "b"), (7, at(0), 2, "a"), (8, at(1), 3, "b"), (9, at(0), None, "a"), (10, at(3), None, "b"), (11, None, 4, "a"), (12, at(1), 4, "b"), (13, at(9), 4, None)]
    df = spark.createDataFrame([(*r, "z") for r in rows], SCHEMA + ", stop_id string")
    got = {r["event_id"]: r["stop_id"] for r in R.next_within(df, "a", "b", 10).collect()}
    assert got == {1: 3, 4: None, 7: None, 9: 10, 11: None}
    named = df.withColumnsRenamed({"user_id": "u", "ts": "t", "event_id": "e", "event_type": "k"})
    assert {r["e"]: r["stop_id"] for r in R.next_within(named, "a", "b", 20, "u", "t", "e", "k").collect()}[4] == 5
    assert R.next_within(df.limit(0), "a", "b", 10).count() == 0


def test_states_and_roll_up(spark):
    df = spark.createDataFrame([(1, at(1), 1, "a"), (2, at(1), 1, "b"), (3, None, 1, "c"), (4, at(0), 2, "f"), (5, at(1), 2, "f"), (6, at(2), 2, "w"), (7, at(2), None, "w")], SCHEMA)
    assert {r["user_id"]: (r["state"], r["n"]) for r in R.latest_state(df).collect()} == {1: ("b", 3), 2: ("w", 3), None: ("w", 1)}
    assert {r["user_id"]: r["status"] for r in R.rolled_up(df, "user_id", "event_type", "f", 1, "w").collect()} == {1: "abstained", 2: "failed", None: "passed"}
    assert R.rolled_up(df, "user_id", "event_type", "f", 2, "w").filter("user_id = 2").first()["status"] == "passed"


def test_integrity(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (None, "x"), (None, "z")], "k int, v string")
    pool = spark.createDataFrame([(1,), (1,), (3,)], "id int")
    assert sorted((r["k"] or 0, r["n"]) for r in R.duplicated(df, "k").collect()) == [(0, 2), (1, 2)]
    assert sorted((r["k"] or 0) for r in R.dangling(df, "k", pool, "id").collect()) == [0, 0, 2]
    assert R.cited(df, "k", pool.withColumnRenamed("id", "k")).count() == 2
    got = R.nearest_centre(spark.createDataFrame([(1.0,), (2.0,), (3.0,), (9.0,), (None,)], "v double"), "v", [1.0, 3.0], 2.0).collect()
    assert [r["centre"] for r in got] == [0, 0, 1, None, None]
