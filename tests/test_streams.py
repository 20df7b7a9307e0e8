import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.streaming import jobs, status
from tallyframe.streaming.tables import keeper, kept, newest

HOUR = 3600
SCHEMA = "owner long, ts timestamp, event_id long, step string"


def at(hours):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)


def brute(rows, limit, seen):
    """Every job's last transition by a plain loop over each owner's events."""
    done = {}
    for owner in {r[0] for r in rows if r[0] is not None}:
        state, job, since, n = "", None, None, 0
        for _, ts, _, step in sorted((r for r in rows if r[0] == owner and r[1] is not None and any(s == r[3] for _, s in jobs.NEXT)), key=lambda r: (r[1], r[2])):
            if state and ts - since > limit:
                done[owner, job] = ("interrupted", since + limit, n + 1)
                state = ""
            to = jobs.NEXT.get((state, step))
            if to:
                job, n = (ts, 1) if to == "queued" else (job, n + 1)
                done[owner, job] = (to, ts, n)
                state, since = to if to in jobs.OPEN else "", ts
        if state and since + limit <= seen:
            done[owner, job] = ("interrupted", since + limit, n + 1)
    return done


def events():
    rng = random.Random(2)
    steps = ["queue", "start", "finish", "finish_with_issues", "fail", "other", None]
    rows = [(rng.choice((1, 2, 3, 4, None)), at(rng.randrange(800)), i, rng.choice(steps)) for i in range(400)]
    return rows + [(7, None, 900, "queue"), (8, at(1), 901, "queue"), (9, at(799), 902, "queue"), (9, at(799), 903, "start")]


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def states(spark, path):
    return {(r["owner"], r["queued_at"]): (r["status"], r["since"], r["n"]) for r in jobs.latest(spark, path).collect()}


def test_states_survive_a_restart_in_the_middle(spark, tmp_path, monkeypatch):
    rows = events()
    limit, folder = dt.timedelta(hours=60), str(tmp_path / "in")
    seen = max(r[1] for r in rows if r[1] is not None and r[0] is not None and any(s == r[3] for _, s in jobs.NEXT)) - dt.timedelta(hours=24)
    want = brute(rows, limit, seen)
    assert {s for s, *_ in want.values()} > {"running", "completed", "completed_with_issues", "failed", "interrupted"}
    # files in order of time, so that no event is late
    parts = [[r for r in rows if r[1] is None], *([r for r in rows if r[1] is not None and at(h) <= r[1] < at(h + 200)] for h in (0, 200, 400, 600))]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        # a batch for each file, and the stream stopped and started again after each
        jobs.run(stream(spark, folder), str(tmp_path / "steps"), str(tmp_path / "steps-c"), 60 * HOUR)
        assert k < 4 or states(spark, str(tmp_path / "steps")) == want
    jobs.run(stream(spark, folder), str(tmp_path / "whole"), str(tmp_path / "whole-c"), 60 * HOUR)
    assert states(spark, str(tmp_path / "whole")) == want

    calls = []

    def failing(path):
        keep = keeper(path)

        def once(batch, i):
            keep(batch, i)
            calls.append(i)
            if calls == [0, 1, 2]:
                raise RuntimeError("lost after writing")

        return once

    monkeypatch.setattr(jobs, "keeper", failing)
    broken = (str(tmp_path / "broken"), str(tmp_path / "broken-c"))
    with pytest.raises(Exception, match="lost after writing"):
        jobs.run(stream(spark, folder), *broken, 60 * HOUR)
    jobs.run(stream(spark, folder), *broken, 60 * HOUR)
    assert calls[:4] == [0, 1, 2, 2] and states(spark, broken[0]) == want
    n = kept(spark, broken[0], jobs.TRANSITIONS).count()
    assert n == kept(spark, str(tmp_path / "whole"), jobs.TRANSITIONS).count() == sum(x[2] for x in want.values())


def test_counts_by_window_over_batches(spark, tmp_path):
    rows = [(i, at(i % 90), "a" if i % 3 else None) for i in range(300)] + [(999, None, "a")]
    df = spark.createDataFrame(rows, "event_id int, ts timestamp, event_type string")
    folder = str(tmp_path / "in.parquet")
    df.coalesce(1).write.parquet(folder)
    got = status.drained(spark, folder, str(tmp_path / "t"), str(tmp_path / "c"))
    plain = status.window_counts(df)
    assert sorted(map(str, got.select("start", "event_type", "n").collect())) == sorted(map(str, plain.collect()))
    late = df.filter("event_id < 50").withColumn("ts", F.lit(at(91)))
    late.coalesce(1).write.mode("append").parquet(folder)
    again = status.drained(spark, folder, str(tmp_path / "t"), str(tmp_path / "c"))
    assert sorted(map(str, again.select("start", "event_type", "n").collect())) == sorted(map(str, status.window_counts(df.unionByName(late)).collect()))


def test_newest(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 5, 2), ("a", 3, 1), (None, 2, 0)], "k string, n int, batch long")
    assert {r["k"]: r["n"] for r in newest(df, ["k"], "n").collect()} == {"a": 5, None: 2}
