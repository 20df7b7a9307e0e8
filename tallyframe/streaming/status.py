"""Counts of states by time window over a stream of events, kept up to date as files arrive.

The stream's state is one row for each open window and kind: the watermark frees windows that late events can no longer
reach. A micro-batch writes only the windows that it changed, and a window's count is that of its last batch.

Defined cases: events without time are dropped, as no watermark would ever free them; null kinds are a kind; events later
than the delay count no more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.streaming.tables import keeper, kept, newest, stream_of


def window_counts(events: DataFrame, kind: str = "event_type", ts: str = "ts", width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """start, kind, n of every window; works on streams and on tables alike."""
    timed = events.filter(F.col(ts).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    counted = timed.groupBy(F.window(ts, width).alias("w"), kind).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), kind, "n")


def drained(spark: SparkSession, source: str, path: str, checkpoint: str, kind: str = "event_type") -> DataFrame:
    """Runs the stream over all files that are there, and returns the table that it keeps at `path`."""
    counts = window_counts(stream_of(spark, source), kind)
    query = counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keeper(path)).start()
    query.awaitTermination()
    schema = f"start timestamp, {kind} {counts.schema[kind].dataType.simpleString()}, n long"
    return newest(kept(spark, path, schema), ["start", kind], "n")
