"""Exact Jaccard join of word-shingle sets by PartEnum signatures, and the groups that its links form.

Sets with a Jaccard likeness of t or more and sizes a, b differ in at most (a + b)(1 - t)/(1 + t) elements. Sizes are cut
into bands whose ends lie a factor 1/t apart, so linked sets are in one band or in neighbours; each set signs in its own
band and in the next one. For a band whose sets can differ in k elements, the feature domain (64-bit shingle hashes) is cut
into n1 > k/2 first-level partitions, so that linked sets differ by one element at most in some of them. Each is cut into
three second-level partitions, and each subset of two of the three is a signature: one element can spoil one of the three
only, so linked sets have an equal signature.

Equal empty subsets say nothing, and are rarely needed: n1 is a fifth larger than k/2 + 1, and a set with fewer empty
subsets than that leaves shares a filled signature with each partner. A set that has more (a few very small ones) signs its
empty subsets too, so no link is lost.

Work on candidates, that is sets in one signature group:
* Equal sets (copies, also with other case or spacing) share one class from the start; classes, not rows, are joined.
* Most linked sets share more signatures than one, as n1 is larger than needed. A class that shares fewer, with all others
  together, than it must with each partner, leaves; what it leaves behind is counted once more.
* A class is first compared with the partner it shares most signatures with, among the first classes of its groups.
  In a large group of near copies this settles most of them, without pairs among them.
* Only classes of groups that still hold several components are looked at again. Their pairs must share a signature and
  pass a prefix filter with positions: shingles are ordered by how few of these classes hold them, and two linked sets
  share one that is early enough in both for the shingles from there on to reach the overlap they need.
* What is left is decided by counting common shingles.

Signatures travel as blocks of binary names per bucket, with each block listing a class once; a bucket is sorted by one
task. The number of buckets follows spark.sql.shuffle.partitions.

Defined cases: null, empty and blank texts have no set, link with nothing and are their own component; fewer than five
words make one shingle; rows with equal ids are one vertex; a row without id joins the class of its text, and has the
component of that class (null if no row of the class has an id); an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import functools
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import Flat, give_back, materialize, shuffle_partitions, text_bytes, tidy
from tallyframe.llm.components import components
from tallyframe.llm.rolling import Rolling, mix

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True


@functools.lru_cache(1)
def _roll() -> Rolling:
    return Rolling(71)


def shingle_sets(texts: Flat, lo: int, hi: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (row, hash) pairs: the distinct shingles of rows lo to hi, rows counted from 0."""
    base = int(texts.offsets[lo])
    data = LOWER[texts.data[base : int(texts.offsets[hi])]]
    edge = texts.offsets[lo : hi + 1].astype(np.int64) - base
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = ~BLANK[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[edge] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = _roll().at(_roll().prefix(data), starts, ends)
    row = np.searchsorted(edge, starts, "right") - 1
    n = np.bincount(row, minlength=hi - lo)
    factor = [np.uint64(pow(0x9E3779B97F4A7C15, j + 1, 2**64)) for j in range(words)]
    whole = len(word) - words + 1
    shingles, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    if whole > 0:
        sums = np.zeros(whole, np.uint64)
        for j in range(words):
            sums += word[j : j + whole] * factor[j]
        ok = row[:whole] == row[words - 1 :]
        shingles.append(mix(sums[ok]))
        of.append(row[:whole][ok])
    first = np.concatenate(([0], np.cumsum(n)))
    for r in np.flatnonzero((n > 0) & (n < words)):
        part = word[first[r] : first[r + 1]]
        shingles.append(mix(np.sum(part * np.array(factor[: len(part)]), dtype=np.uint64, keepdims=True) + np.uint64(len(part))))
        of.append(np.array([r]))
    shingles, of = np.concatenate(shingles), np.concatenate(of)
    order = np.lexsort((shingles, of))
    shingles, of = shingles[order], of[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (shingles[1:] != shingles[:-1])
    return of[new], shingles[new]


def _sums(of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2^64 of the values of each row; `of` is sorted."""
    run = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=run[1:])
    edge = np.searchsorted(of, np.arange(n + 1))
    return run[edge[1:]] - run[edge[:-1]]


class Bands:
    def __init__(self, numerator: int, denominator: int):
        self.t = Fraction(numerator, denominator)
        self.lo, self.hi = [1], [self.top(1)]

    def top(self, size: int) -> int:
        """The largest size that a set of this size can link with."""
        return math.floor(size / self.t)

    def differ(self, a: int, b: int) -> int:
        return math.floor((a + b) * (1 - self.t) / (1 + self.t))

    def of(self, sizes: np.ndarray) -> np.ndarray:
        most = int(sizes.max(initial=1))
        while self.hi[-1] < most:
            self.lo.append(self.hi[-1] + 1)
            self.hi.append(self.top(self.lo[-1]))
        return np.searchsorted(np.array(self.hi), sizes)

    def end(self, band: int) -> int:
        self.of(np.array([self.hi[-1]]))
        while len(self.hi) <= band:
            self.of(np.array([self.hi[-1] + 1]))
        return self.hi[band]

    @functools.cache  # noqa: B019  one instance lives as long as its process
    def partitions(self, band: int) -> int:
        """First-level partitions: more than half of what sets up to the band's end can differ in, and a fifth to spare."""
        least = self.differ(self.end(band), self.end(band)) // 2 + 1
        return least + 1 + least // 5

    @functools.cache  # noqa: B019
    def most(self, size: int, band: int) -> int:
        """How many elements a set of this size and a partner of at most the band's end can differ in."""
        return self.differ(size, min(self.end(band), self.top(size)))


@functools.lru_cache(4)
def _bands(numerator: int, denominator: int) -> Bands:
    return Bands(numerator, denominator)


def signatures(of: np.ndarray, shingles: np.ndarray, sizes: np.ndarray, bands: Bands) -> tuple[np.ndarray, ...]:
    """(row, 64-bit signature, step: 0 for the own band, 1 for the next), and how many signatures a partner must share at
    least, by row and step. A signature tells its band, partition and subset."""
    own = bands.of(sizes)
    rows, names, steps, needs = [], [], [], []
    for step in (0, 1):
        band = own + step
        kinds, inverse = np.unique(band, return_inverse=True)
        n1 = np.array([bands.partitions(int(b)) for b in kinds])[inverse]
        salt = mix(kinds.astype(np.uint64) + np.uint64(977))[inverse]
        most = np.array([bands.most(int(s), int(b)) for s, b in zip(sizes, band, strict=True)])
        base = np.concatenate(([0], np.cumsum(n1)))
        spread = mix(shingles ^ salt[of])
        high, low = spread >> np.uint64(32), spread & np.uint64(0xFFFFFFFF)
        first = base[of] + ((high * n1[of].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        cell = 3 * first + ((low * np.uint64(3)) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        total = int(base[-1])
        sums = _sums(cell[order], spread[order] * np.uint64(0xD6E8FEB86659FD93), 3 * total).reshape(total, 3)
        held = np.bincount(cell, minlength=3 * total).reshape(total, 3)
        # the subset of two partitions that leaves out each one
        sums, held = sums.sum(axis=1, dtype=np.uint64, keepdims=True) - sums, held.sum(axis=1, keepdims=True) - held
        owner = np.repeat(np.arange(len(sizes)), n1)
        hollow = np.bincount(owner, (held == 0).any(axis=1), minlength=len(sizes))
        need = n1 - most // 2 - hollow
        few = need < 1
        needs.append(np.maximum(need, 1))
        keep = (held > 0) | few[owner][:, None]
        keep &= ((sizes > 0) & (most > 0))[owner][:, None]
        part = (np.arange(total) - base[owner]).astype(np.uint64)[:, None] * np.uint64(3) + np.arange(3, dtype=np.uint64)
        at = np.nonzero(keep)[0]
        rows.append(owner[at])
        names.append(mix(sums + part * np.uint64(0xA24BAED4963EE407) + salt[owner][:, None])[keep])
        steps.append(np.full(len(at), step))
    return np.concatenate(rows), np.concatenate(names), np.concatenate(steps), np.stack(needs, axis=1)


DEALT = "bucket long, {id}, sid long, sid2 long, size long, names binary, members binary, sids binary, needs binary"
SORTED = "{id}, sid long, sid2 long, size long, gid long, step long, n long, need long"


def _emit(words: int, bands_of: tuple[int, int], buckets: int):
    """A row for each document, in buckets below 0, and blocks of signatures for the other buckets."""
    binary = ("names", "members", "sids", "needs")

    def run(batches):
        bands = _bands(*bands_of)
        for batch in batches:
            texts, ids = Flat(batch.column("bytes")), batch.column("id")
            for lo, hi in texts.runs(3 << 19):
                of, shingles = shingle_sets(texts, lo, hi, words)
                n = hi - lo
                sizes = np.bincount(of, minlength=n)
                sid, sid2 = (mix(_sums(of, mix(shingles ^ np.uint64(k)), n) + sizes.astype(np.uint64)) for k in (5, 6))
                none = pa.nulls(n, pa.binary())
                yield pa.record_batch(
                    {
                        "bucket": pa.array(-1 - (mix(np.arange(n, dtype=np.uint64)) % np.uint64(buckets)).astype(np.int64)),
                        "id": ids.slice(lo, n),
                        "sid": pa.array(sid.view(np.int64), mask=sizes == 0),
                        "sid2": pa.array(sid2.view(np.int64), mask=sizes == 0),
                        "size": pa.array(sizes.astype(np.int64)),
                    }
                    | dict.fromkeys(binary, none)
                )
                # a block lists equal sets once
                _, first = np.unique(sid, return_index=True)
                first = np.sort(first[sizes[first] > 0])
                if not len(first):
                    continue
                place = np.full(n, -1)
                place[first] = np.arange(len(first))
                keep = place[of] >= 0
                owner, name, step, need = signatures(place[of[keep]], shingles[keep], sizes[first], bands)
                bucket = (((name >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
                order = np.lexsort((owner, bucket))
                owner, name, step, bucket = owner[order], name[order], step[order], bucket[order]
                edges = np.append(np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))), len(bucket))
                out: dict[str, list] = {k: [] for k in ("bucket", *binary)}
                for a, b in zip(edges[:-1], edges[1:], strict=True) if len(bucket) else ():
                    who, member = np.unique(owner[a:b], return_inverse=True)
                    out["bucket"].append(int(bucket[a]))
                    out["names"].append(np.ascontiguousarray(name[a:b]).view(np.uint8).reshape(-1, 8)[:, :5].tobytes())
                    out["members"].append((2 * member + step[a:b]).astype(np.uint16 if len(who) < 32768 else np.uint32).tobytes())
                    out["sids"].append(sid[first][who].tobytes())
                    out["needs"].append(need[who].astype(np.uint32).tobytes())
                n = len(out["bucket"])
                empty = {"id": pa.nulls(n, ids.type)} | {k: pa.nulls(n, pa.int64()) for k in ("sid", "sid2", "size")}
                full = {k: pa.array(v, pa.binary() if k in binary else pa.int64()) for k, v in out.items()}
                yield pa.record_batch({k: (full | empty)[k] for k in ("bucket", "id", "sid", "sid2", "size", *binary)})

    return run


def _groups(rows: pa.Table) -> pa.Table:
    """The classes that share a signature, of one bucket; groups with the same members come once, with their number.
    Documents pass."""
    ids = rows["id"].type

    def table(rows_out: int, **columns) -> pa.Table:
        whole = {k: columns.get(k, pa.nulls(rows_out, ids if k == "id" else pa.int64())) for k in ("id", "sid", "sid2", "size", "gid", "step", "n", "need")}
        return pa.table(whole)

    if rows["bucket"][0].as_py() < 0:
        return table(rows.num_rows, **{k: rows[k] for k in ("id", "sid", "sid2", "size")})
    # names alone first: most stand alone, and of these nothing else is unpacked
    packed = rows["names"].to_pylist()
    wide = np.zeros((sum(map(len, packed)) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, 5)
    names = wide.view(np.uint64).ravel()
    edges = np.concatenate(([0], np.cumsum([len(p) // 5 for p in packed])))
    twice = np.sort(names)
    twice = np.unique(twice[1:][twice[1:] == twice[:-1]])
    if not len(twice):
        return table(0)
    shared = twice[np.minimum(np.searchsorted(twice, names), len(twice) - 1)] == names
    sids, steps, needs = [], [], []
    for members, listed, least, a, b in zip(*(rows[k].to_pylist() for k in ("members", "sids", "needs")), edges[:-1], edges[1:], strict=True):
        member = np.frombuffer(members, np.uint16 if len(members) == 2 * (b - a) else np.uint32)[shared[a:b]]
        sids.append(np.frombuffer(listed, np.uint64)[member >> 1])
        steps.append((member & 1).astype(np.int8))
        needs.append(np.frombuffer(least, np.uint32)[member])
    names = names[shared]
    del packed, wide, twice, shared
    sids, steps, needs = map(np.concatenate, (sids, steps, needs))
    # a class counts once in its group, and groups of one class are none
    order = np.lexsort((sids, names))
    names, sids, steps, needs = (x[order] for x in (names, sids, steps, needs))
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (sids[1:] != sids[:-1])
    names, sids, steps, needs = (x[new] for x in (names, sids, steps, needs))
    if not len(names):
        return table(0)
    first = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
    held = np.diff(np.append(first, len(names)))
    group = np.repeat(np.arange(len(first)), held)
    gid = mix(np.add.reduceat(mix(sids ^ steps.astype(np.uint64)), first))
    _, index, count = np.unique(gid, return_index=True, return_counts=True)
    take = np.zeros(len(first), np.int64)
    take[index] = count
    take[held < 2] = 0
    keep = take[group] > 0
    at = group[keep]
    del names, group, first, new, order
    columns = {"sid": sids[keep].view(np.int64), "gid": gid[at].view(np.int64), "step": steps[keep].astype(np.int64), "n": take[at], "need": needs[keep].astype(np.int64)}
    found = table(int(keep.sum()), **{k: pa.array(v) for k, v in columns.items()})
    del columns, sids, steps, needs, keep, at
    give_back(collect=False)
    return found


def _enough(groups: DataFrame) -> DataFrame:
    """Without the classes that share too few signatures, with all others together, and the groups left with one class."""
    kept = groups.groupBy("sid", "step").agg(F.sum("n").alias("shared"), F.max("need").alias("need")).filter("shared >= need").select("sid", "step")
    left = groups.join(kept, ["sid", "step"], "left_semi")
    alive = left.groupBy("gid").agg(F.min("sid").alias("x"), F.max("sid").alias("y")).filter("x <> y").select("gid")
    return left.join(alive, "gid", "left_semi")


def _sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node, shingles (sorted array) of the wanted nodes, which are ids of documents."""

    def run(batches):
        for batch in batches:
            texts = Flat(batch.column("bytes"))
            for lo, hi in texts.runs(2 << 20):
                of, shingles = shingle_sets(texts, lo, hi, words)
                edge = np.searchsorted(of, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.record_batch({"node": batch.column("node").slice(lo, hi - lo), "shingles": pa.ListArray.from_arrays(pa.array(edge), pa.array(shingles.view(np.int64)))})

    kind = docs.schema["node"].dataType.simpleString()
    return docs.join(wanted.hint("shuffle_hash"), "node", "left_semi").mapInArrow(tidy(run), f"node {kind}, shingles array<long>")


def _decided(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with the sizes of both sets and of their intersection."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", F.size("of_a").cast("long").alias("n_a"), F.size("of_b").cast("long").alias("n_b"), F.size(F.array_intersect("of_a", "of_b")).cast("long").alias("both"))


def _pairs(nodes: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Pairs (a, b) of different roots whose sets can link, by a prefix filter with positions.

    nodes: node, root, size, gids (their signature groups). Linked sets of sizes x, y share (x + y) t / (1 + t) elements
    at least. In one order of all shingles, rare ones first, the first shingle they share has in both sets so many
    elements from it on. Shingles that one class holds come first in it, and are counted only.
    """
    rows = sets.join(nodes.select("node", "root", "size"), "node").select("node", "root", "size", F.explode("shingles").alias("shingle"))
    often = rows.groupBy("shingle").agg(F.count("*").alias("often"), F.min("root").alias("x"), F.max("root").alias("y")).filter("often > 1")
    mine = Window.partitionBy("node")
    place = F.col("size") - F.count("*").over(mine) + F.row_number().over(mine.orderBy("often", "shingle")) - 1
    ranked = rows.join(often, "shingle").withColumn("rest", F.col("size") - place)
    # how many elements a set must share with the smallest partner, and with partners of its size or more
    prefix = materialize(ranked.filter(f"x <> y AND rest * {denominator} >= size * {numerator}").select("shingle", "node", "root", "size", "rest"), "prefix")
    small = prefix.filter(f"rest * {numerator + denominator} >= 2 * {numerator} * size").select("shingle", *(F.col(c).alias(f"{c}_a") for c in ("node", "root", "size", "rest")))
    large = prefix.select("shingle", *(F.col(c).alias(f"{c}_b") for c in ("node", "root", "size", "rest")))
    fit = f"root_a <> root_b AND (size_a < size_b OR size_a = size_b AND node_a < node_b) AND size_b * {numerator} <= size_a * {denominator}"
    reach = f"least(rest_a, rest_b) * {numerator + denominator} >= (size_a + size_b) * {numerator}"
    met = small.join(large, "shingle").filter(f"{fit} AND {reach}").select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    of = lambda c: nodes.select(F.col("node").alias(c), F.col("gids").alias(f"gids_{c}"))
    return met.join(of("a"), "a").join(of("b"), "b").filter(F.arrays_overlap("gids_a", "gids_b")).select("a", "b")


def near_duplicates(docs: DataFrame, words: int = 5, numerator: int = 3, denominator: int = 4, id_col: str = "doc_id", text_col: str = "text", links_too: bool = False) -> DataFrame:
    """Returns id, n_shingles, class_id (smallest id with an equal set), component_id (smallest id reachable by links);
    with `links_too` also n_links (how many other classes its class links with), for which all pairs that pass the filters
    are decided. The components alone need far fewer comparisons."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("bytes"))
    kind = source.schema["id"].dataType.simpleString()
    id_of = f"id {kind}"
    dealt = source.mapInArrow(tidy(_emit(words, (numerator, denominator), shuffle_partitions(spark))), DEALT.format(id=id_of))
    both = materialize(dealt.groupBy("bucket").applyInArrow(_groups, SORTED.format(id=id_of)), "signatures")
    rows = both.filter("gid is null").select("id", "sid", "sid2", "size")
    classes = materialize(rows.filter("sid is not null").groupBy("sid", "sid2", "size").agg(F.min("id").alias("node")).filter("node is not null"), "classes")
    found = both.filter("gid is not null").groupBy("gid", "sid", "step").agg(F.sum("n").alias("n"), F.max("need").alias("need"))
    groups = materialize(_enough(_enough(found)).join(classes.select("sid", "node", "size"), "sid"), "groups")

    # first comparison: each class with the partner it shares most signatures with
    linked = f"{denominator} * both >= {numerator} * (n_a + n_b - both)"
    hubs = groups.groupBy("gid").agg(F.min("node").alias("hub"))
    best = groups.join(hubs, "gid").filter("hub <> node").groupBy("node", "hub").agg(F.sum("n").alias("n")).groupBy("node").agg(F.max_by("hub", F.struct("n", "hub")).alias("hub"))
    sets = materialize(_sets_of(source.withColumnRenamed("id", "node"), groups.select("node").distinct(), words), "shingles")
    first = materialize(_decided(best.select(F.col("hub").alias("a"), F.col("node").alias("b")), sets).filter(linked), "first")
    links = first.select(F.col("a").alias("u"), F.col("b").alias("v"))
    root = components(links)

    # classes of groups that still hold several components
    placed = groups.join(root.withColumnRenamed("u", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = placed.groupBy("gid").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("gid")
    still = placed.join(several, "gid", "left_semi").groupBy("node", "root", "size").agg(F.collect_set("gid").alias("gids"))
    pairs = _pairs(materialize(still, "open"), sets, numerator, denominator)
    more = materialize(_decided(pairs, sets).filter(linked).select(F.col("a").alias("u"), F.col("b").alias("v")), "second")
    if more.limit(1).count():
        root = components(links.unionByName(more))

    per_class = classes.join(root.withColumnRenamed("u", "node"), "node", "left")
    columns = ["sid", "sid2", "size", F.col("node").alias("class_id"), F.coalesce("root", "node").alias("component_id")]
    out = [F.coalesce("class_id", "id").alias("class_id"), F.coalesce("component_id", "id").alias("component_id")]
    if links_too:
        every = groups.groupBy("node", F.col("node").alias("root"), "size").agg(F.collect_set("gid").alias("gids"))
        decided = _decided(_pairs(materialize(every, "every"), sets, numerator, denominator), sets).filter(linked)
        n_links = decided.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
        per_class = per_class.join(n_links, "node", "left")
        columns.append("n_links")
        out.insert(1, F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return rows.join(per_class.select(*columns), ["sid", "sid2", "size"], "left").select("id", F.col("size").alias("n_shingles"), *out)
