"""States of jobs over a stream of events: queued, running, completed, completed_with_issues, failed, interrupted.

A job is its owner and the time it was queued. The stream keeps one small state for each owner with an open job and forgets
it when the job ends; a job without a transition for longer than the limit is interrupted, either by the owner's next event
or by the watermark. Transitions are only ever added: each micro-batch keeps its own in a folder by its id, replaced if the
batch runs again after a failure, so a restart never doubles or loses a row.

Defined cases: events without owner, time or a known step are no transitions, nor are steps that a state does not allow (a
start without a queued job, an end without a running one, a second job beside an open one); events of one time are taken in
the order of their ids; events older than the watermark count no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.streaming.tables import keeper, kept

#: From which states a step leads where. Steps from no state open a job.
NEXT = {("", "queue"): "queued", ("queued", "start"): "running", ("running", "finish"): "completed", ("running", "finish_with_issues"): "completed_with_issues", ("running", "fail"): "failed"}
OPEN = ("queued", "running")
TRANSITIONS = "owner long, queued_at timestamp, status string, since timestamp, n int"
STATE = "status string, queued_at timestamp, since timestamp, n int"


def transitions(events: DataFrame, limit_seconds: int, delay: str = "1 day") -> DataFrame:
    """owner, queued_at, status, since, n (number of the transition within its job) of every transition. Events have owner, ts,
    event_id, step."""
    limit = pd.Timedelta(seconds=limit_seconds)

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        owner, out = key[0], []
        status, queued_at, at, n = state.get if state.exists else ("", pd.NaT, pd.NaT, 0)
        queued_at, at = pd.Timestamp(queued_at), pd.Timestamp(at)

        def move(to, when):
            nonlocal status, queued_at, at, n
            queued_at, n = (when, 1) if to == "queued" else (queued_at, n + 1)
            status, at = to if to in OPEN else "", when
            out.append((owner, queued_at, to, when, n))

        if state.hasTimedOut:
            move("interrupted", at + limit)
        else:
            rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
            for ts, step in zip(rows["ts"], rows["step"], strict=True):
                if status and ts - at > limit:
                    move("interrupted", at + limit)
                if (status, step) in NEXT and not (status and ts < at):
                    move(NEXT[status, step], ts)
            # an open job that the watermark has passed already is not waited for
            if status and (at + limit).timestamp() * 1000 <= state.getCurrentWatermarkMs():
                move("interrupted", at + limit)
        if status:
            state.update((status, queued_at.to_pydatetime(), at.to_pydatetime(), n))
            state.setTimeoutTimestamp(int((at + limit).timestamp() * 1000))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["owner", "queued_at", "status", "since", "n"])

    known = events.filter("owner IS NOT NULL AND ts IS NOT NULL").filter(F.col("step").isin(*(s for _, s in NEXT))).withWatermark("ts", delay)
    return known.groupBy("owner").applyInPandasWithState(advance, TRANSITIONS, STATE, "append", "EventTimeTimeout")


def run(events: DataFrame, path: str, checkpoint: str, limit_seconds: int, delay: str = "1 day") -> None:
    """Takes the stream as far as its source goes now; started again with the same folders it goes on from there."""
    query = transitions(events, limit_seconds, delay).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query.foreachBatch(keeper(path)).start().awaitTermination()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """owner, queued_at, status, since, n of every job: its last transition."""
    last = F.max_by(F.struct("status", "since", "n"), "n")
    return kept(spark, path, TRANSITIONS).groupBy("owner", "queued_at").agg(last.alias("last")).select("owner", "queued_at", "last.*")


def step_of(kind: Column, steps: dict[str, str]) -> Column:
    return F.coalesce(*(F.when(kind == k, s) for k, s in steps.items()))
