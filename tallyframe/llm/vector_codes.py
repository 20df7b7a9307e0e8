"""Codes of vectors: product quantisation whose codebooks are learned by the filtering form of Lloyd's rounds.

Components become integers, floor(256 * x), and each vector is cut into equal consecutive parts. The parts of a chunk of
vectors make one kd-tree for each part position; a node keeps its bounding box, its number of parts and their sum. The
trees are built once and written. In a round every task walks the trees of its chunks from the root down, all nodes of a
level together, with the codebook entries that can still be nearest to something in a node's box: an entry goes when
another is nearer to the whole box. A node with one entry left hands its count and sum over as a whole; only parts of the
small nodes at the bottom are compared one by one. Tasks send one row for each used entry, so a round shuffles no vectors.
All distances are of integers, so codes do not depend on the trees or on how vectors are dealt out.

Defined cases: rows with a null vector, or with null, NaN or infinite components, are left out; vectors shorter than the
longest count as filled up with zeros, and so does a length that the number of parts does not divide; fewer vectors than
entries make a smaller codebook; equal ids are ordered by their vectors, null ids come last; null labels are one label;
components of a magnitude of 2^17 or more are refused, as sums of their squares leave 63 bits; an empty table gives an empty
result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import materialize

#: Parts in a node at the bottom of a tree: at least this many, fewer than twice as many.
LEAF = 8
#: Labels up to this number of rows are broadcast; beyond it both sides are shuffled by the label.
FEW_LABELS = 500_000
LIMIT = 1 << 25


def build_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the points along the tree, and of every node, level by level, the box's low and high corner and the sum.
    Node k of level v holds the points from (n * k) >> v on, in that order; each node is halved along its longest side."""
    n, d = points.shape
    order, lows, highs, sums = np.arange(n), [], [], []
    for level in range(depth(n) + 1):
        starts = (n * np.arange(1 << level)) >> level
        at = points[order]
        lows.append(np.minimum.reduceat(at, starts))
        highs.append(np.maximum.reduceat(at, starts))
        sums.append(np.add.reduceat(at, starts))
        if level < depth(n):
            node = np.repeat(np.arange(1 << level), np.diff(starts, append=n))
            side = np.argmax(highs[-1] - lows[-1], axis=1)
            order = order[np.lexsort((at[np.arange(n), side[node]], node))]
    return order, np.concatenate(lows), np.concatenate(highs), np.concatenate(sums)


def depth(n: int) -> int:
    return max(0, (n // LEAF).bit_length() - 1)


def filter_nearest(points: np.ndarray, lows: np.ndarray, highs: np.ndarray, sums: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry of every point (points in the tree's order), and of every entry the number and sum of its points.
    Of entries at the same distance the first is the nearest."""
    (n, d), k = points.shape, len(entries)
    codes, counts, totals = np.empty(n, np.uint8), np.zeros(k, np.int64), np.zeros((k, d), np.int64)
    nodes, alive, first = np.zeros(1, np.int64), np.ones((1, k), bool), 0
    ids, bottom = np.arange(k), depth(n)
    for level in range(bottom + 1):
        low, high = lows[first + nodes], highs[first + nodes]
        far = ((2 * entries - (low + high)[:, None]) ** 2).sum(2)
        best = np.where(alive, far, np.iinfo(np.int64).max).argmin(1)
        other = entries[best][:, None]
        # the corner of the box that favours each entry most against the best one
        corner = np.where(entries > other, high[:, None], low[:, None])
        behind = ((entries - other) * (entries + other - 2 * corner)).sum(2)
        alive &= (behind < 0) | ((behind == 0) & (ids <= best[:, None]))
        one = alive.sum(1) == 1
        begin, end = (n * nodes) >> level, (n * (nodes + 1)) >> level
        np.add.at(counts, best[one], (end - begin)[one])
        np.add.at(totals, best[one], sums[first + nodes[one]])
        for b, e, c in zip(begin[one].tolist(), end[one].tolist(), best[one].tolist(), strict=True):
            codes[b:e] = c
        nodes, alive, begin, end = nodes[~one], alive[~one], begin[~one], end[~one]
        first += 1 << level
        if level < bottom:
            nodes, alive = np.repeat(2 * nodes, 2), np.repeat(alive, 2, axis=0)
            nodes[1::2] += 1
    for a in range(0, len(nodes), 256):
        size = (end - begin)[a : a + 256]
        at = np.repeat(begin[a : a + 256] - np.cumsum(size) + size, size) + np.arange(size.sum())
        far = ((points[at][:, None] - entries) ** 2).sum(2)
        far[~np.repeat(alive[a : a + 256], size, axis=0)] = np.iinfo(np.int64).max
        codes[at] = nearest = far.argmin(1)
        np.add.at(counts, nearest, 1)
        np.add.at(totals, nearest, points[at])
    return codes, counts, totals


def plant(vectors: DataFrame, dim: int, parts: int, chunk: int) -> DataFrame:
    """Chunks of vectors with their trees: ids, labels, all integers in a row, the orders of all trees, and their nodes."""
    kind = {f.name: f.dataType.simpleString() for f in vectors.schema}

    def trees(ids: list, labels: list, values: list[np.ndarray], types: list[pa.DataType]) -> pa.RecordBatch:
        scaled = np.zeros((len(values), dim))
        for i, x in enumerate(values):
            scaled[i, : len(x)] = np.floor(256 * x.astype(np.float64))
        if np.abs(scaled).max(initial=0) >= LIMIT:
            raise ValueError("components of vectors are too large for sums of squares in 63 bits")
        ints = scaled.astype(np.int64)
        orders, lows, highs, sums = (np.stack(x).ravel() for x in zip(*(build_tree(p) for p in np.split(ints, parts, axis=1)), strict=True))
        small = {"ints": ints.ravel(), "orders": orders, "lows": lows, "highs": highs}
        columns = {c: pa.array([x], pa.list_(t)) for c, x, t in zip(("ids", "labels"), (ids, labels), types, strict=True)}
        columns |= {c: pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for c, x in small.items()}
        return pa.record_batch(columns | {"sums": pa.array([sums], pa.list_(pa.int64()))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, values, types = [], [], [], []
        for batch in batches:
            types = [batch.schema.field(c).type for c in ("id", "label")]
            ids += batch.column("id").to_pylist()
            labels += batch.column("label").to_pylist()
            rows = batch.column("vector")
            offsets, flat = np.asarray(rows.offsets), np.asarray(rows.values)
            values += [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            while len(values) >= chunk:
                yield trees(ids[:chunk], labels[:chunk], values[:chunk], types)
                del ids[:chunk], labels[:chunk], values[:chunk]
        if values:
            yield trees(ids, labels, values, types)

    return vectors.mapInArrow(run, f"ids array<{kind['id']}>, labels array<{kind['label']}>, ints array<int>, orders array<int>, lows array<int>, highs array<int>, sums array<long>")


def walked(batches: Iterator[pa.RecordBatch], codebooks: list[np.ndarray]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, list]]:
    """(batch, row in it, its vectors, [(order, codes in that order, counts, sums) of each part]) of every chunk."""
    parts = len(codebooks)
    for batch in batches:
        for i in range(batch.num_rows):
            get = lambda c: np.asarray(batch.column(c)[i].values).astype(np.int64)  # noqa: B023, E731
            orders = get("orders").reshape(parts, -1)
            n, d = orders.shape[1], codebooks[0].shape[1]
            ints = get("ints").reshape(n, parts * d)
            lows, highs, sums = (get(c).reshape(parts, -1, d) for c in ("lows", "highs", "sums"))
            yield batch, i, ints, [(o, *filter_nearest(ints[o, p * d : p * d + d], lows[p], highs[p], sums[p], codebooks[p])) for p, o in enumerate(orders)]


def lloyd_round(chunks: DataFrame, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round; only counts and sums of entries, `parts` times `entries` rows at most, reach the driver."""
    parts, (k, d) = len(codebooks), codebooks[0].shape

    def run(batches):
        counts, totals = np.zeros((parts, k), np.int64), np.zeros((parts, k, d), np.int64)
        for *_, found in walked(batches, codebooks):
            for p, (_, _, c, t) in enumerate(found):
                counts[p] += c
                totals[p] += t
        part, entry = counts.nonzero()
        yield pa.record_batch({"part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "n": pa.array(counts[part, entry], pa.int64())} | {f"s{j}": pa.array(totals[part, entry, j], pa.int64()) for j in range(d)})

    sums = chunks.mapInArrow(run, "part int, entry int, n long" + "".join(f", s{j} long" for j in range(d)))
    new = [c.copy() for c in codebooks]
    for r in sums.groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in ("n", *(f"s{j}" for j in range(d))))).collect():
        new[r["part"]][r["entry"]] = [r[f"s{j}"] // r["n"] for j in range(d)]
    return new


def encode(chunks: DataFrame, codebooks: list[np.ndarray], id_type: str, label_type: str) -> DataFrame:
    parts, d = len(codebooks), codebooks[0].shape[1]

    def run(batches):
        for batch, i, ints, found in walked(batches, codebooks):
            codes = np.empty((len(ints), parts), np.uint8)
            for p, (order, c, _, _) in enumerate(found):
                codes[order, p] = c
            near = np.stack([codebooks[p][codes[:, p]] for p in range(parts)], axis=1).reshape(len(ints), parts * d)
            yield pa.record_batch({
                "id": batch.column("ids")[i].values,
                "label": batch.column("labels")[i].values,
                "code": pa.array([c.tobytes().hex() for c in codes], pa.string()),
                "error": pa.array(((ints - near) ** 2).sum(1), pa.int64()),
            })

    return chunks.mapInArrow(run, f"id {id_type}, label {label_type}, code string, error long")


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", chunk: int | None = None) -> tuple[DataFrame, list[np.ndarray]]:
    """Returns id, label, code, error, label_error of every kept vector, and the codebooks: for each part an array of its
    entries. Entries are at most 256, so that an index has two hex digits. A chunk has 2^19 components if not told."""
    whole = F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = vectors.filter(whole).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    kind = {f.name: f.dataType.simpleString() for f in kept.schema}
    longest = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    d = max(1, -(-longest // parts))
    first = [np.floor(256 * np.asarray(r["vector"], np.float64)).astype(np.int64) for r in kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()]
    start = np.zeros((len(first), parts * d), np.int64)
    for i, x in enumerate(first):
        start[i, : len(x)] = x
    codebooks = [c.copy() for c in np.split(start, parts, axis=1)]
    chunks = materialize(plant(kept, parts * d, parts, chunk or max(64, (1 << 19) // (parts * d))), "trees")
    for _ in range(rounds if first else 0):
        codebooks = lloyd_round(chunks, codebooks)
    coded = materialize(encode(chunks, codebooks, kind["id"], kind["label"]), "codes")
    of_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    of_label = materialize(of_label, "labels")
    few = of_label.count() <= FEW_LABELS
    out = coded.join(F.broadcast(of_label) if few else of_label, F.col("label").eqNullSafe(F.col("of")))
    return out.select("id", "label", "code", "error", "label_error"), codebooks


def digest(codebooks: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for c in codebooks for x in c.ravel().tolist()).encode()).hexdigest()
