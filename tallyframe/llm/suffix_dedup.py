"""Exact removal of long repeated byte strings, by difference-cover blockwise suffix construction.

Question: which suffixes of the corpus agree with another suffix on their first `min_len` bytes? Sorting every suffix
is too much to hold or to move, so, as in blockwise construction with a difference cover:

1. *Cover sample.* With a difference cover D modulo v, any two positions i, j have one shift d < v at which both i+d and
   j+d fall into the sample (position mod v in D). Two equal strings of `min_len` bytes therefore hold two sampled
   suffixes that agree on `min_len - v + 1` bytes, of which the name takes 160 at most. Sample suffixes are dealt to suffix buckets by their name (a
   fingerprint of those bytes), each bucket is sorted on its own, and names that occur once are dropped.
2. *Long ties.* Each tied sample suffix gets the rank of a longer string, of `min_len + v - 1` bytes, that starts v - 1
   bytes before it. If that string occurs again, every suffix starting in those v positions is repeated without being
   sorted; where the ties of a sample differ in it, one chunk speaks for all copies of the longer string.
3. *Suffix buckets.* Only suffixes next to a tie that the long ranks left open are sorted, bucket by bucket. A 64-bit
   fingerprint of the `min_len` bytes names a suffix; its bucket comes from a second, independent fingerprint, so that
   names that agree by chance must do so in both.

Ranks are fingerprints: suffixes are grouped by equality, which is all that removal needs, not put in alphabetical order.
The sample is named by 160 bytes even where more would do: its ties then tell of repeats too short to be removed, too.
A bucket holds each distinct name once per chunk of documents, so a string in a third of all documents costs one entry
per chunk. Chunks hold a few MB of text; documents are shuffled once, and the exchange is used again by later steps.

Defined cases: null text is empty; texts shorter than `min_len` keep everything; equal documents of `min_len` bytes or
more lose all of those bytes; repeated ids are separate documents; an empty table gives an empty result; only the two
named columns are read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import Flat, shuffle_partitions, text_bytes, tidy_group
from tallyframe.llm.rolling import Rolling

#: Perfect difference sets: every residue modulo v is a difference of two members.
COVERS = {
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    31: (1, 5, 11, 24, 25, 27),
    91: (0, 1, 3, 9, 27, 49, 56, 61, 77, 81),
    133: (1, 2, 4, 13, 21, 35, 39, 82, 89, 95, 105, 110),
}

KEYS = "bucket long, chunk long, tag int, once binary, more binary"
FOUND = "chunk long, tag int, names binary"
#: Sample suffixes are named by so many bytes at most. Shorter names tie more often, but also show repeats below min_len.
NAMED = 160
#: Tags: repeated names of the cover sample; repeated long strings that other chunks, or none, need to hear of; repeated
#: long strings whose suffixes this chunk has to sort for all; repeated names of suffixes; names that a chunk tells others
#: and needs no answer for, as it knows them to be repeated.
SAMPLE, SILENT, SPEAKS, SUFFIX, TOLD = 1, 2, 3, 4, 5
NO_LONG, LOW, LOW7 = np.uint64(0), np.uint64(2**40 - 1), np.uint64(2**56 - 1)


class Cover:
    def __init__(self, min_len: int):
        if min_len < 14:
            raise ValueError("min_len must be 14 at least")
        self.min_len = min_len
        self.v = max(v for v in COVERS if 2 * v <= min_len)
        self.short, self.long = min(min_len - self.v + 1, NAMED), min_len + self.v - 1
        self.member = np.zeros(self.v, bool)
        self.member[list(COVERS[self.v])] = True
        self.one, self.two = Rolling(11), Rolling(12)

    def samples(self, n: int) -> np.ndarray:
        """Sampled positions of a text of n bytes whose short string fits."""
        last = n - self.short
        if last < 0:
            return np.zeros(0, np.int64)
        return np.flatnonzero(np.resize(self.member, last + 1))

    def marks(self, at: np.ndarray, back: int, ahead: int, n: int) -> np.ndarray:
        """Which of the n first positions lie in [p - back, p + ahead] of some p."""
        step = np.zeros(n + 1, np.int32)
        np.add.at(step, np.clip(at - back, 0, n), 1)
        np.add.at(step, np.clip(at + ahead + 1, 0, n), -1)
        return np.cumsum(step)[:n] > 0


@functools.lru_cache(4)
def _cover(min_len: int) -> Cover:
    return Cover(min_len)


def _among(names: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Which names are among the kept ones, which are sorted."""
    if not len(kept) or not len(names):
        return np.zeros(len(names), bool)
    return kept[np.minimum(np.searchsorted(kept, names), len(kept) - 1)] == names


def _packed(tag: int, names: np.ndarray) -> bytes:
    """Names of the sample only rule suffixes out, so five bytes of them will do; of others, seven beside the bucket's
    number, which comes from independent bits. Byte by byte, as the upper bytes of sorted names compress."""
    width = 5 if tag == SAMPLE else 7
    return np.ascontiguousarray(np.ascontiguousarray(names).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unpacked(tag: int, packed: bytes) -> np.ndarray:
    width = 5 if tag == SAMPLE else 7
    wide = np.zeros((len(packed) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(packed, np.uint8).reshape(width, -1).T
    return wide.view(np.uint64).ravel()


def _bucket(names: np.ndarray, buckets: int) -> np.ndarray:
    return ((names >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _dealt(chunk: int, tag: int, names: np.ndarray, by: np.ndarray, buckets: int, long: np.ndarray | None = None) -> dict[str, list]:
    """One row for each bucket. Without `long`: the chunk's distinct names in it, those met once apart from those met
    more often. With it: the distinct pairs; the last bit of the long name tells whether the pair was met more often."""
    out: dict[str, list] = {k: [] for k in ("bucket", "chunk", "tag", "once", "more")}
    if not len(names):
        return out
    bucket = _bucket(by, buckets)
    order = np.lexsort((names, bucket) if long is None else (long, names, bucket))
    names, bucket = names[order], bucket[order]
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (bucket[1:] != bucket[:-1])
    if long is not None:
        long = long[order]
        new[1:] |= long[1:] != long[:-1]
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(names))) > 1
    names, bucket = names[first], bucket[first]
    if long is not None:
        long = long[first] | many
    edges = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
    for b in np.flatnonzero(np.diff(edges)):
        part = slice(edges[b], edges[b + 1])
        pair = (names[part][~many[part]], names[part][many[part]]) if long is None else (names[part], long[part])
        kind = SAMPLE if long is not None else tag
        for k, x in zip(out, (int(b), chunk, tag, _packed(kind, pair[0]), _packed(tag, pair[1])), strict=True):
            out[k].append(x)
    return out


def _table(rows: dict[str, list]) -> pa.Table:
    kinds = {"bucket": pa.int64(), "chunk": pa.int64(), "tag": pa.int32(), "once": pa.binary(), "more": pa.binary(), "names": pa.binary()}
    return pa.table({k: pa.array(v, kinds[k]) for k, v in rows.items()})


def _owned(chunks: list[int], tag: int, names: np.ndarray, owner: np.ndarray) -> dict[str, list]:
    back = np.argsort(owner, kind="stable")
    names, owner = names[back], owner[back]
    edges = np.searchsorted(owner, np.arange(len(chunks) + 1))
    mine = np.flatnonzero(np.diff(edges))
    return {"chunk": [chunks[i] for i in mine], "tag": [tag] * len(mine), "names": [_packed(tag, names[edges[i] : edges[i + 1]]) for i in mine]}


def _sort_bucket(rows: pa.Table) -> pa.Table:
    """Sorts one bucket and tells each chunk which of its names are repeated in the corpus. Names on their way to a
    later step pass in buckets below 0."""
    bucket, chunks, tags = (rows[k].to_pylist() for k in ("bucket", "chunk", "tag"))
    once, more = rows["once"].to_pylist(), rows["more"].to_pylist()
    if not bucket or bucket[0] < 0:
        return _table({"chunk": chunks, "tag": tags, "names": once})
    tag = tags[0] if tags[0] != TOLD else SUFFIX
    parts = [_unpacked(SAMPLE, x) for x in once] if tag == SILENT else [_unpacked(tag, x) for x in once + more]
    names, owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    if tag != SILENT:
        order = np.argsort(names, kind="stable")
        names, owner = names[order], owner[order]
        same = names[1:] == names[:-1]
        kept = owner >= len(once)
        kept[1:] |= same
        kept[:-1] |= same
        kept &= np.array(tags)[owner % len(once)] != TOLD
        return _table(_owned(chunks, tag, names[kept], owner[kept] % len(once)))
    flagged = np.concatenate([_unpacked(tag, x) for x in more])
    twice, long = (flagged & np.uint64(1)).astype(bool), flagged & ~np.uint64(1)
    order = np.lexsort((owner, long, names))
    names, owner, long, twice = names[order], owner[order], long[order], twice[order]
    new_name = np.concatenate(([True], names[1:] != names[:-1]))
    new_pair = new_name | np.concatenate(([True], long[1:] != long[:-1]))
    pair = np.cumsum(new_pair) - 1
    repeated = (np.bincount(pair, 1 + twice)[pair] > 1) & (long != NO_LONG)
    alone = np.bincount(np.cumsum(new_name) - 1, new_pair)[np.cumsum(new_name) - 1] == 1
    speaks = repeated & new_pair & ~alone
    quiet = repeated & ~speaks
    a, b = (_owned(chunks, t, long[x], owner[x]) for t, x in ((SILENT, quiet), (SPEAKS, speaks)))
    return _table({k: a[k] + b[k] for k in a})


def _known(found: pa.Table) -> dict[int, np.ndarray]:
    """What is known of a chunk's names, by tag, sorted."""
    tags, names = found["tag"].to_pylist(), found["names"].to_pylist()
    return {tag: np.unique(np.concatenate([_unpacked(t, x) for x, t in zip(names, tags, strict=True) if t == tag] or [np.zeros(0, np.uint64)])) for tag in (SAMPLE, SILENT, SPEAKS, SUFFIX)}


def _tied(c: Cover, data: np.ndarray, known: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix sums, the sampled positions whose short string is repeated, and their names."""
    prefix = c.one.prefix(data)
    at = c.samples(len(data))
    names = c.one.at(prefix, at, length=c.short)
    tied = _among(names & LOW, known[SAMPLE])
    return prefix, at[tied], names[tied] & LOW


def _long(c: Cover, prefix: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Names of the long strings around sampled positions, even numbers; NO_LONG where they don't fit."""
    out = np.full(len(at), NO_LONG)
    fits = (at >= c.v - 1) & (at + c.min_len < len(prefix))
    out[fits] = np.maximum(c.two.at(prefix, at[fits] - (c.v - 1), length=c.long) & LOW7 & ~np.uint64(1), np.uint64(2))
    return out


def _open(c: Cover, data: np.ndarray, known: dict) -> tuple[np.ndarray, ...]:
    """Suffixes that are repeated by their long rank (a mask); positions, names and second names of those to be sorted; tied
    positions of the sample."""
    n = len(data) - c.min_len + 1
    prefix, at, names = _tied(c, data, known)
    if not len(at):
        return np.zeros(n, bool), at, names, names, at
    second = c.two.prefix(data)
    long = _long(c, second, at)
    silent = _among(long, known[SILENT])
    speaks = _among(long, known[SPEAKS])
    left = np.flatnonzero(c.marks(at[~silent | speaks], c.v - 1, 0, n))
    return c.marks(at[silent | speaks], c.v - 1, 0, n), left, c.one.at(prefix, left, length=c.min_len) & LOW7, c.two.at(second, left, length=c.min_len), at


def _emit_samples(min_len: int, buckets: int):
    def run(docs: pa.Table) -> pa.Table:
        c, texts = _cover(min_len), Flat(docs["bytes"])
        names = [np.zeros(0, np.uint64)]
        for i in range(len(texts)):
            data = texts[i]
            if len(data) >= c.short:
                names.append(c.one.at(c.one.prefix(data), c.samples(len(data)), length=c.short))
        names = np.concatenate(names)
        return _table(_dealt(docs["chunk"][0].as_py(), SAMPLE, names, names, buckets))

    return run


def _emit_next(min_len: int, buckets: int, tag: int):
    """Pairs with the long ranks, or the open suffixes of a chunk; what is known travels on in a bucket below 0."""

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        none = np.zeros(0, np.uint64)
        if not docs.num_rows or not found.num_rows:
            return _table(_dealt(0, tag, none, none, buckets))
        c, texts, known = _cover(min_len), Flat(docs["bytes"]), _known(found)
        names, seconds, told = [none], [none], [np.zeros(0, bool)]
        for i in range(len(texts)):
            data = texts[i]
            if len(data) < min_len:
                continue
            if tag == SILENT:
                _, at, name = _tied(c, data, known)
                if len(at):
                    names.append(name)
                    seconds.append(_long(c, c.two.prefix(data), at))
            else:
                sure, left, name, second, _ = _open(c, data, known)
                names.append(name)
                seconds.append(second)
                told.append(sure[left])
        chunk, names, seconds = docs["chunk"][0].as_py(), np.concatenate(names), np.concatenate(seconds)
        if tag == SILENT:
            rows = _dealt(chunk, tag, names, names << np.uint64(24), buckets, seconds)
        else:
            told = np.concatenate(told)
            a, b = (_dealt(chunk, t, names[x], seconds[x], buckets) for t, x in ((SUFFIX, ~told), (TOLD, told)))
            rows = {k: a[k] + b[k] for k in a}
        for t, x in known.items():
            if len(x):
                for k, y in zip(rows, (-1 - chunk, chunk, t, _packed(t, x), b""), strict=True):
                    rows[k].append(y)
        return _table(rows)

    return run


def _repeated(c: Cover, data: np.ndarray, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """Positions of repeated suffixes, and tied positions of the sample."""
    if len(data) < c.min_len:
        return np.zeros(0, np.int64), _tied(c, data, known)[1] if len(data) >= c.short else np.zeros(0, np.int64)
    hit, left, names, _, at = _open(c, data, known)
    hit[left[_among(names, known[SUFFIX])]] = True
    return np.flatnonzero(hit), at


def _worth(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_len: int, min_words: int) -> np.ndarray:
    """Which spans are long enough: twice min_len bytes, or so many words (runs of bytes above the space)."""
    inside = data > 32
    begins = np.concatenate(([0], np.cumsum(inside & ~np.concatenate(([False], inside[:-1])))))
    words = begins[ends] - begins[starts] + (inside[starts] & (begins[starts + 1] == begins[starts]))
    return (ends - starts >= 2 * min_len) | (words >= min_words)


def _cut(min_len: int, min_words: int):
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        c, texts, known = _cover(min_len), Flat(docs["bytes"]), _known(found)
        sizes, starts, ends, kept, shared = [], [], [], [], []
        for i in range(len(texts)):
            data = texts[i]
            hit, tied = _repeated(c, data, known)
            gone = c.marks(hit, 0, min_len - 1, len(data))
            shared.append(int(c.marks(tied, 0, c.short - 1, len(data)).sum()) if len(tied) else 0)
            edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False]))))
            if min_words and len(edge):
                edge = edge.reshape(-1, 2)[_worth(data, edge[::2], edge[1::2], min_len, min_words)].ravel()
                step = np.zeros(len(data) + 1, np.int8)
                step[edge[::2]], step[edge[1::2]] = 1, -1
                gone = np.cumsum(step)[:-1] > 0
            sizes.append(len(data))
            starts.append(edge[::2])
            ends.append(edge[1::2])
            kept.append(data[~gone].tobytes() if len(edge) else data.tobytes())
        spans = pa.list_(pa.int64())
        return pa.table({"id": docs["id"], "n_bytes": pa.array(sizes, pa.int64()), "starts": pa.array(starts, spans), "ends": pa.array(ends, spans), "kept": pa.array(kept, pa.binary()), "n_shared": pa.array(shared, pa.int64())})

    return run


def even_labels(spark: SparkSession, parts: int, each: int) -> DataFrame:
    """k (0 up to parts * each) and chunk: numbers of which a shuffle into `parts` partitions by hash deals `each` to every
    one. Numbers taken as they come leave some partitions several times as full as others."""
    tried = spark.range(12 * parts * each).select(F.col("id").alias("chunk"), F.pmod(F.hash("id"), F.lit(parts)).alias("at"))
    nth = F.row_number().over(Window.partitionBy("at").orderBy("chunk"))
    return tried.withColumn("nth", nth).filter(F.col("nth") <= each).select((F.col("at") * each + F.col("nth") - 1).alias("k"), "chunk")


def remove_repeats(docs: DataFrame, min_len: int = 400, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None, min_words: int = 0) -> DataFrame:
    """Returns id (or `key` in its place, such as a struct of columns to pass through), n_bytes, starts and ends (arrays: the maximal byte spans removed), kept (the remaining bytes), n_shared (bytes of
    sampled strings, NAMED long at most, that occur elsewhere: shows repeats too short to be removed, from NAMED + 132
    bytes on for sure; a sampled string ties by chance once in some hundred thousand).
    With `min_words`, a span of fewer words stays, unless it has twice `min_len` bytes or more.

    The number of chunks and suffix buckets follows spark.sql.shuffle.partitions, which the cluster sizes to its input.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    buckets, chunks = max(1, 2 * parts // 3), 2 * parts
    source = docs.select((F.col(id_col) if key is None else key).alias("id"), text_bytes(text_col).alias("bytes"))
    dealt = source.withColumn("k", F.pmod(F.xxhash64("id", "bytes"), F.lit(chunks)).cast("int"))
    # a number that no label was found for gets one of its own, beyond all tried
    labelled = dealt.join(F.broadcast(even_labels(spark, parts, 2)), "k", "left").withColumn("chunk", F.coalesce("chunk", 12 * chunks + F.col("k")))
    chunked = labelled.select("id", "bytes", "chunk").repartition(parts, "chunk")
    by_chunk = lambda df: df.groupBy("chunk")
    found = by_chunk(chunked).applyInArrow(tidy_group(_emit_samples(min_len, buckets)), KEYS).groupBy("bucket").applyInArrow(tidy_group(_sort_bucket), FOUND)
    for tag in (SILENT, SUFFIX):
        found = by_chunk(chunked).cogroup(by_chunk(found)).applyInArrow(tidy_group(_emit_next(min_len, buckets, tag)), KEYS).groupBy("bucket").applyInArrow(tidy_group(_sort_bucket), FOUND)
    id_type = source.schema["id"].dataType.simpleString()
    return by_chunk(chunked).cogroup(by_chunk(found)).applyInArrow(tidy_group(_cut(min_len, min_words)), f"id {id_type}, n_bytes long, starts array<long>, ends array<long>, kept binary, n_shared long")
