"""Packing of token pieces into sequences: shortest-pack-first over the length histogram.

A document's ids are cut at multiples of the sequence length; the rest of it is one shorter piece. The histogram of piece
lengths (as many rows as a sequence has tokens, at most) goes to the driver, where patterns are made from the longest
length to the shortest: pieces of a length go onto the patterns with the most room, and patterns are split by their counts.
Documents join back by rank: the k-th piece of a length takes the k-th place that the patterns hold for it. Ranks come from
counts of salted groups, so a length that a third of all documents have is ranked by many tasks.

Defined cases: null text is empty and packs its end id alone; rows with equal ids are packed one by one; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import Flat, materialize, shuffle_partitions, text_bytes
from tallyframe.llm.encoding import encoder


def make_patterns(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in order of placing, how many sequences look so) that hold exactly the histogram's pieces."""
    by_room: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(size + 1)]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        placed = []
        for room in range(size, length - 1, -1):
            while left and by_room[room]:
                lengths, count = by_room[room].pop()
                used = min(count, left)
                if count > used:
                    by_room[room].append((lengths, count - used))
                placed.append((room - length, ((*lengths, length), used)))
                left -= used
            if not left:
                break
        if left:
            each = size // length if left > 1 else 1
            whole, rest = divmod(left, each)
            for n, count in ((each, whole), (rest, 1)):
                if n and count:
                    placed.append((size - n * length, ((length,) * n, count)))
        for room, pattern in placed:
            by_room[room].append(pattern)
    return [p for patterns in by_room for p in patterns]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, offset): which ranks of a length a pattern takes."""
    out, ranks, sequence = [], {}, 0
    for lengths, count in patterns:
        offset = 0
        for length in lengths:
            rank = ranks.get(length, 0)
            out.append((length, rank, rank + count, sequence, offset))
            ranks[length] = rank + count
            offset += length
        sequence += count
    return out


def cut(docs: DataFrame, tokenizer_path: str, size: int, end_id: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """Pieces of every document: id, start, length, ids_crc32, doc_tokens and, if asked for, ids."""

    def run(batches):
        encode, end = encoder(tokenizer_path).encode, np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            texts = Flat(batch.column("bytes"))
            for lo, hi in texts.runs(3 << 20):
                ids = [x + end for x in encode([texts[i].tobytes().decode("utf-8", "replace") for i in range(lo, hi)])]
                rows, starts, parts, totals = [], [], [], []
                for i, x in enumerate(ids):
                    for a in range(0, len(x), 4 * size):
                        rows.append(i)
                        starts.append(a // 4)
                        parts.append(x[a : a + 4 * size])
                        totals.append(len(x) // 4)
                out = {
                    "id": batch.column("id").slice(lo, hi - lo).take(pa.array(rows, pa.int64())),
                    "start": pa.array(starts, pa.int64()),
                    "length": pa.array([len(p) // 4 for p in parts], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                    "doc_tokens": pa.array(totals, pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in parts], pa.list_(pa.int32()))
                yield pa.record_batch(out)

    source = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("bytes"))
    schema = f"id {source.schema['id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long"
    return source.mapInArrow(run, schema + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Returns id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for) of every piece."""
    spark = docs.sparkSession
    pieces = materialize(cut(docs, tokenizer_path, size, end_id, id_col, text_col, with_ids), "pieces")
    salts = shuffle_partitions(spark)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "start"), F.lit(salts)))
    # at most `size` lengths times `salts` rows
    counts = salted.groupBy("length", "salt").count()
    before = counts.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    histogram = {r["length"]: r["count"] for r in counts.groupBy("length").agg(F.sum("count").alias("count")).collect()}
    held = spark.createDataFrame(places(make_patterns(histogram, size)), "length long, from_rank long, to_rank long, first_sequence long, offset long")
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "start", "ids_crc32")) - 1
    ranked = salted.withColumn("within", within).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("within"))
    # patterns are bounded by the histogram: each length is placed once and splits at most one pattern of each room
    placed = ranked.join(F.broadcast(held), "length").filter("rank >= from_rank AND rank < to_rank")
    return placed.select("id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first_sequence") + F.col("rank") - F.col("from_rank")).alias("sequence_id"), "offset", *["ids"] * with_ids)
