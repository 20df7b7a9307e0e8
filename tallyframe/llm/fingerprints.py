"""I-Match fingerprints with randomised lexicons.

Document frequencies of all terms (runs of word characters, lower case) are counted over all documents. Terms whose
frequency lies in a band, `least` to `most` as shares of the documents, form the lexicon; the lower bound also bounds its
size, since a document has so many terms only. A document's distinct terms of the lexicon are sorted; each of `subsets`
random sub-lexicons keeps some of them and hashes what it keeps. Sub-lexicons are drawn at two densities that follow the
number of kept terms, so short and long documents alike keep a few terms in each.

The fingerprint is a string: for both densities their level and one hash a sub-lexicon (`----` where nothing is kept).
Two fingerprints are as alike as the share of equal hashes, among those where either kept something, at common levels.

For the edited texts documents are dealt by ranges of their id, one shuffle; each task looks one document ahead, and only
the documents at the ends of ranges are joined afterwards.

Defined cases: null text is empty; a text without terms in the band has a fingerprint of its whole text, alike to equal
texts only; the document after the last is the first, so a single one follows itself; equal ids follow each other in the
order of their text; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import Flat, materialize, shuffle_partitions, text_bytes
from tallyframe.llm.rolling import mix

TERMS = re.compile(r"\w+")
NONE = "----"


def document_frequencies(source: DataFrame) -> DataFrame:
    """term, df over all rows of a frame with a column bytes."""

    def run(batches):
        for batch in batches:
            texts = Flat(batch.column("bytes"))
            for lo, hi in texts.runs(8 << 20):
                found: Counter = Counter()
                for i in range(lo, hi):
                    found.update(set(TERMS.findall(texts[i].tobytes().decode("utf-8", "replace").lower())))
                yield pa.record_batch({"term": pa.array(list(found), pa.string()), "df": pa.array(list(found.values()), pa.int64())})

    return source.mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(source: DataFrame, least: float, most: float) -> list[str]:
    n = source.count()
    band = document_frequencies(source).filter(F.col("df").between(max(least * n, 1), max(most * n, 1)))
    return sorted(r["term"] for r in band.select("term").toLocalIterator())


class Printer:
    def __init__(self, terms: list[str], subsets: int):
        self.number = {t: i for i, t in enumerate(terms)}
        self.seeds = mix(np.arange(1, subsets + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def hashes(self, text: str) -> dict[int, list[str]] | str:
        kept = {self.number.get(t, -1) for t in set(TERMS.findall(text.lower()))}
        kept.discard(-1)
        if not kept:
            return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()[:16]
        ids = np.array(sorted(kept), np.uint64)
        drawn = mix((ids[:, None] + np.uint64(1)) ^ self.seeds[None, :])
        level = int(len(ids)).bit_length() - 1
        out = {}
        for at in (level, level + 1):
            inside = (drawn & np.uint64(0xFFFFFFFF)) < np.uint64((1 << 32) >> at) if at else np.ones(drawn.shape, bool)
            sums = np.where(inside, mix(drawn), np.uint64(0)).sum(axis=0, dtype=np.uint64)
            some = inside.any(axis=0)
            out[at] = [f"{h:04x}" if s else NONE for h, s in zip((mix(sums) >> np.uint64(48)).tolist(), some.tolist(), strict=True)]
        return out

    @staticmethod
    def text(hashes: dict[int, list[str]] | str) -> str:
        return "=" + hashes if isinstance(hashes, str) else "/".join(f"{at}:" + "".join(h) for at, h in hashes.items())


def likeness(a: dict[int, list[str]] | str, b: dict[int, list[str]] | str) -> float:
    if isinstance(a, str) or isinstance(b, str):
        return float(a == b)
    both = [(x, y) for at in a.keys() & b.keys() for x, y in zip(a[at], b[at], strict=True) if x != NONE or y != NONE]
    return sum(x == y for x, y in both) / len(both) if both else float(a == b)


def edit(text: str, following: str) -> str:
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
EDGE = "file int, first boolean, bytes binary"


def _row(printer: Printer, text: str, own, following: str, after) -> tuple:
    changed = edit(text, following)
    other = printer.hashes(changed)
    return len(text), hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest(), Printer.text(own), Printer.text(other), likeness(own, other), likeness(own, after)


def _batch(ids: list, rows: list[tuple], kind: pa.DataType, edges: list[tuple] = ()) -> pa.RecordBatch:
    """Rows with results, then documents at the ends of a range: (id, file, first, bytes)."""
    n, m = len(rows), len(edges)
    out = {"id": pa.array([*ids, *(e[0] for e in edges)], kind)}
    for k, (name, arrow) in enumerate((("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()))):
        out[name] = pa.array([*(r[k] for r in rows), *[None] * m], arrow)
    for k, (name, arrow) in enumerate((("file", pa.int32()), ("first", pa.bool_()), ("bytes", pa.binary()))):
        out[name] = pa.array([*[None] * n, *(e[k + 1] for e in edges)], arrow)
    return pa.record_batch(out)


def fingerprints(docs: DataFrame, least: float = 0.001, most: float = 0.2, subsets: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: the edited text of a
    document ends with the beginning of the next one in its last quarter."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("bytes"))
    kind = source.schema["id"].dataType.simpleString()
    terms = spark.sparkContext.broadcast(lexicon(source.select("bytes"), least, most))

    def ahead(batches):
        printer, last, first = Printer(terms.value, subsets), None, None
        for batch in batches:
            texts, ids, file = Flat(batch.column("bytes")), batch.column("id").to_pylist(), batch.column("file")[0].as_py() if batch.num_rows else 0
            for lo, hi in texts.runs(2 << 20):
                at, rows = [], []
                for i in range(lo, hi):
                    raw = texts[i].tobytes()
                    text = raw.decode("utf-8", "replace")
                    own = printer.hashes(text)
                    if last:
                        at.append(last[0])
                        rows.append(_row(printer, last[1], last[2], text, own))
                    else:
                        first = (ids[i], file, True, raw)
                    last = (ids[i], text, own, raw)
                yield _batch(at, rows, batch.column("id").type)
        if last:
            yield _batch([], [], batch.column("id").type, [first, (last[0], file, False, last[3])])

    dealt = source.repartitionByRange(shuffle_partitions(spark), "id").sortWithinPartitions("id", "bytes").withColumn("file", F.spark_partition_id())
    rows = materialize(dealt.mapInArrow(ahead, f"id {kind}, {RESULT}, {EDGE}"), "fingerprints")
    # two rows a range: their number is the number of partitions, so one task may order them
    ends = rows.filter("file is not null").select("id", "file", "first", "bytes")
    order = Window.orderBy("file")
    starts = ends.filter("first").select("file", F.col("bytes").alias("head"))
    follow = starts.select("file", F.coalesce(F.lead("head").over(order), F.first("head").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("following"))
    joined = ends.filter("not first").join(follow, "file").select("id", "bytes", "following")

    def across(batches):
        printer = Printer(terms.value, subsets)
        for batch in batches:
            found = []
            for a, b in zip(batch.column("bytes").to_pylist(), batch.column("following").to_pylist(), strict=True):
                text, following = a.decode("utf-8", "replace"), b.decode("utf-8", "replace")
                found.append(_row(printer, text, printer.hashes(text), following, printer.hashes(following)))
            yield _batch(batch.column("id").to_pylist(), found, batch.column("id").type).select(["id", *(c.split()[0] for c in RESULT.split(", "))])

    inner = rows.filter("file is null").select("id", *(c.split()[0] for c in RESULT.split(", ")))
    return inner.unionByName(joined.mapInArrow(across, f"id {kind}, {RESULT}"))
