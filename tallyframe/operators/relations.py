"""Integrity, positional and state operators on keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def duplicated(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def dangling(df: DataFrame, column: str, pool: DataFrame, key: str) -> DataFrame:
    """Rows whose reference has no target; the anti-join shuffles keys only."""
    return df.join(pool.select(F.col(key).alias(column)), column, "left_anti")


def cited(df: DataFrame, key: str, references: DataFrame) -> DataFrame:
    return df.join(references.select(key).distinct(), key, "left_semi")


def next_within(events: DataFrame, start: str, stop: str, seconds: int, who: str = "user_id", ts: str = "ts", event: str = "event_id", kind: str = "event_type") -> DataFrame:
    """For every start event the first stop event of the same owner that follows it within the tolerance: one sort by owner
    and time, and a look ahead over the frame, instead of a range join. Events of one time follow in the order of their ids;
    owners that are null are one owner."""
    order = Window.partitionBy(who).orderBy(ts, event).rowsBetween(1, Window.unboundedFollowing)
    stops = F.first(F.when(F.col(kind) == stop, F.struct(F.col(ts).alias("ts"), F.col(event).alias("stop_id"))), ignorenulls=True).over(order)
    found = events.filter(F.col(kind).isin(start, stop)).withColumn("found", stops).filter(F.col(kind) == start)
    near = F.unix_seconds(F.col("found.ts").cast("timestamp")) - F.unix_seconds(F.col(ts).cast("timestamp")) <= seconds
    return found.select(event, who, F.when(near, F.col("found.stop_id")).alias("stop_id"))


def nearest_centre(df: DataFrame, value: str, centres: list[float], farthest: float) -> DataFrame:
    """The closest of a few fixed centres, or none beyond the distance; ties go to the first."""
    ranked = F.array_min(F.array(*(F.struct(F.abs(F.col(value) - c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres))))
    return df.withColumn("best", ranked).withColumn("centre", F.when(F.col("best.d") <= farthest, F.col("best.i"))).drop("best")


def latest_state(events: DataFrame, who: str = "user_id", kind: str = "event_type", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Each owner's last kind of event in order, and its number of events."""
    return events.groupBy(who).agg(F.max_by(kind, F.struct(*order)).alias("state"), F.count("*").alias("n"))


def rolled_up(events: DataFrame, who: str, kind: str, failure: str, most: int, wanted: str) -> DataFrame:
    """One status for each owner: failed with more than `most` failures, else abstained without a wanted event, else passed.
    Null kinds are neither."""
    state = F.when(F.count_if(F.col(kind) == failure) > most, "failed").when(F.count_if(F.col(kind) == wanted) == 0, "abstained").otherwise("passed")
    return events.groupBy(who).agg(state.alias("status"))
