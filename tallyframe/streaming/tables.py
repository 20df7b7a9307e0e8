"""Tables that micro-batches write: a folder for each batch, replaced if the batch is run again after a failure."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def keeper(path: str) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that keeps each batch at its id."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id:012d}")

    return keep


def kept(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All batches' rows, with the id of their batch."""
    return spark.read.schema(schema + ", batch long").option("basePath", path).parquet(f"{path}/batch=*")


def stream_of(spark: SparkSession, source: str) -> DataFrame:
    """A table's files as a stream. A pattern, as a stream takes a single file only by one."""
    return spark.readStream.schema(spark.read.parquet(source).schema).parquet(f"{source}*")


def shared_place(spark: SparkSession, name: str) -> str:
    """A new folder where all executors write: in spark.checkpoint.dir, or a temporary one in a local session without it."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="tallyframe-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def newest(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Each key's value of the last batch that has one."""
    return rows.groupBy(*key).agg(F.max_by(value, "batch").alias(value))
