"""Token ids in ORC files: stripes with run-length encoded integers, row indexes and Bloom filters on document ids.

Documents are dealt by ranges of their id and sorted, so file names, stripes and rows all ascend in the id; row indexes
then prune by range and the Bloom filters by single ids. Stripes are read in parallel. The number of files follows
spark.sql.shuffle.partitions. The start of a document among all ids comes from file totals and a running sum within
each file, so no task sees the whole corpus.

Defined cases: null text is empty and holds the end id alone; rows with equal ids keep one place each, in the order of
their text; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import Flat, shared_dir, shuffle_partitions, text_bytes
from tallyframe.llm.encoding import encoder


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", stripe_mb: int = 16) -> None:
    """Writes doc_id, file (ascending with the ids), place (row within the file), n_tokens, ids."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("bytes"))
    ordered = source.repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "bytes").withColumn("file", F.spark_partition_id())

    def run(batches):
        encode, place, end = encoder(tokenizer_path).encode, 0, np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            texts = Flat(batch.column("bytes"))
            for lo, hi in texts.runs(1 << 20):
                ids = [x + end for x in encode([texts[i].tobytes().decode("utf-8", "replace") for i in range(lo, hi)])]
                sizes = np.fromiter((len(x) // 4 for x in ids), np.int32, hi - lo)
                values = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
                yield pa.record_batch(
                    {
                        "doc_id": batch.column("doc_id").slice(lo, hi - lo),
                        "file": batch.column("file").slice(lo, hi - lo),
                        "place": pa.array(np.arange(place, place + hi - lo)),
                        "n_tokens": pa.array(sizes.astype(np.int64)),
                        "ids": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), values),
                    }
                )
                place += hi - lo

    encoded = ordered.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, file int, place long, n_tokens long, ids array<int>")
    (
        encoded.write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "1000")
        .option("orc.stripe.size", str(stripe_mb << 20))
        .option("compression", "zstd")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Returns doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    files = spark.read.orc(path)

    def sums(batches):
        for batch in batches:
            ids = batch.column("ids")
            values, edges = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.record_batch({**{k: batch.column(k) for k in ("doc_id", "file", "place")}, "n_tokens": pa.array(np.diff(edges).astype(np.int64)), "ids_crc32": pa.array(crc, pa.int64())})

    rows = files.select("doc_id", "file", "place", "ids").mapInArrow(sums, f"doc_id {files.schema['doc_id'].dataType.simpleString()}, file int, place long, n_tokens long, ids_crc32 long")
    # one row a file: their number is the number of partitions, so one task may order them
    totals = files.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("file", (F.sum("total").over(Window.orderBy("file")) - F.col("total")).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("place")) - F.col("n_tokens")
    return rows.withColumn("within", within).join(before, "file").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def tokens_through_orc(docs: DataFrame, tokenizer_path: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Writes the files, under the shared folder where no path is given, and reads them back."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer_path, end_id)
    return read_tokens(spark, path)
