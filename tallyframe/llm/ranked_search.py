"""Ranked lexical search: an inverted index in shards, postings in blocks of variable size, and exact block-max WAND.

Shards are runs of documents as the tasks read them, so the text is not shuffled. A first pass counts terms and writes
postings (documents and term counts) of each shard; counts of all documents and of each term's documents come from these.
A second pass turns postings into impacts, the exact integer scores of a term in a document, and cuts each list into
blocks. Dynamic programming places the cuts: a block costs OPEN impacts, or as much of the list's best impact, plus what
its bound, the highest impact in it, is above the impacts it stands for; the cheapest cutting of the list is kept. Search
goes over all shards: the block bounds of an item's terms are summed over the runs of documents between cuts, runs are
taken from the highest bound down, and a run whose bound is below the k-th best score so far ends the search of the shard.
In a run the pivot test of WAND comes first: documents whose terms' best impacts in the whole shard do not reach that
score are passed over, then those whose blocks' bounds do not; the rest are scored in full. Equality is never pruned, since
a lower id wins a tie. Each shard gives an item's k best; these are merged in two steps, by groups of shards first.

Only the items' terms are indexed where these are few enough to broadcast (`few_terms`, counted); beyond that all terms are.
Items are taken in blocks of at most `item_block`, each block against all shards.

Defined cases: null texts and texts without terms are in no posting list and count nowhere; items without a known term have
no rows; rows with equal ids are documents of their own; null ids come last among equal scores; items with equal ids are
joined to one, their terms added up; an empty table on either side gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import Flat, materialize

#: Bytes that belong to terms: digits, letters and all bytes of characters beyond ASCII. Others separate; A-Z become a-z.
TERM_BYTES = bytes(b if chr(b).isalnum() or b > 0x7F else 0x20 for b in range(256)).lower()
#: A block's own cost in the cutting of a list, as a share of the list's best impact.
OPEN = 2.0
#: Postings in a block at most.
WIDEST = 128
#: Postings in a shard, and terms in a block of items, after which the next one begins.
MOST = 4_000_000
POSTINGS = "shard long, ids array<{id}>, sizes array<long>, terms array<struct<term: binary, docs: array<int>, counts: array<int>>>"
INDEX = "ids array<{id}>, terms array<struct<term: binary, docs: array<int>, impacts: array<long>, ends: array<int>, bounds: array<long>>>"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split(b" ") if text else []


def counted(text: bytes) -> Counter:
    counts = Counter(terms_of(text))
    counts.pop(b"", None)
    return counts


def nested(parts: list[list[np.ndarray]], names: list[str], types: list[pa.DataType], terms: list[bytes]) -> pa.Array:
    """One row: the list of structs of term and, for each name, the term's array."""
    fields = [pa.array(terms, pa.binary())]
    for arrays, kind in zip(parts, types, strict=True):
        offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
        flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
        fields.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind)))
    rows = pa.StructArray.from_arrays(fields, ["term", *names])
    return pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), rows)


def postings(docs: DataFrame, wanted: set[bytes] | None, shard_bytes: int, id_col: str, text_col: str) -> DataFrame:
    """One row a shard: its documents with a term (ids and numbers of terms) and every term's documents and counts."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("bytes"), F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, lists, held, n_postings, number, kind = [], [], {}, 0, 0, 0, None

        def shard(part: int) -> pa.RecordBatch:
            terms = sorted(lists)
            flat = [np.asarray(lists[t], np.int64) for t in terms]
            rows = nested([[x[0::2] for x in flat], [x[1::2] for x in flat]], ["docs", "counts"], [pa.int32(), pa.int32()], terms)
            return pa.record_batch({"shard": pa.array([part * (1 << 24) + number], pa.int64()), "ids": pa.array([ids], pa.list_(kind)), "sizes": pa.array([sizes], pa.list_(pa.int64())), "terms": rows})

        part = 0
        for batch in batches:
            texts, names, kind = Flat(batch.column("bytes")), batch.column("id").to_pylist(), batch.schema.field("id").type
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            for i, name in enumerate(names):
                text = texts[i].tobytes()
                counts = counted(text)
                n = sum(counts.values())
                if n:
                    at = len(ids)
                    ids.append(name)
                    sizes.append(n)
                    kept = counts if wanted is None else wanted.intersection(counts)
                    n_postings += len(kept)
                    for t in kept:
                        lists.setdefault(t, []).extend((at, counts[t]))
                    held += len(text)
                    if held >= shard_bytes or n_postings >= MOST:
                        yield shard(part)
                        ids, sizes, lists, held, n_postings, number = [], [], {}, 0, 0, number + 1
        if ids:
            yield shard(part)

    return source.mapInArrow(run, POSTINGS.format(id=source.schema["id"].dataType.simpleString()))


def cut_blocks(lists: list[np.ndarray], opening: float = OPEN, widest: int = WIDEST) -> list[np.ndarray]:
    """Ends of the blocks (places after the last posting) of every list of impacts, by dynamic programming over all lists
    together: step i decides where a block that ends after posting i is best begun, among the last `widest` places."""
    order = sorted(range(len(lists)), key=lambda i: -len(lists[i]))
    sizes = np.array([len(lists[i]) for i in order])
    if not len(sizes):
        return []
    steps, w = int(sizes[0]), min(widest, int(sizes[0]))
    flat = np.concatenate([lists[i] for i in order]).astype(np.float64)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    cost = opening * np.maximum.reduceat(flat, starts[:-1])
    begun = np.empty(len(flat), np.int32)
    # of each of the last w places: the highest impact since, the best cost up to there less the impacts before it
    top, before = np.zeros((len(order), w)), np.full((len(order), w), np.inf)
    best, total = np.zeros(len(order)), np.zeros(len(order))
    wide = np.zeros(w)
    for i in range(steps):
        n = int(np.searchsorted(-sizes, -i, "left"))
        x = flat[starts[:n] + i]
        slot = i % w
        top[:n, slot] = x
        before[:n, slot] = best[:n] + total[:n]
        wide += 1
        wide[slot] = 1
        np.maximum(top[:n], x[:, None], out=top[:n])
        total[:n] += x
        paid = top[:n] * wide
        paid += before[:n]
        at = paid.argmin(1)
        best[:n] = paid[np.arange(n), at] - total[:n] + cost[:n]
        begun[starts[:n] + i] = i + 1 - wide[at]
    ends: list[np.ndarray] = [np.zeros(0, np.int32)] * len(lists)
    for k, i in enumerate(order):
        back, out, mine = len(lists[i]), [], begun[starts[k] : starts[k + 1]].tolist()
        while back:
            out.append(back)
            back = mine[back - 1]
        ends[i] = np.asarray(out[::-1], np.int32)
    return ends


def impact_index(shards: DataFrame, n_docs: int, n_terms: int, found_in: DataFrame, few_terms: int) -> DataFrame:
    """Turns postings into impacts in blocks. found_in has term and df: broadcast if few, or joined to the postings."""
    id_type = shards.schema["ids"].dataType.elementType.simpleString()
    if found_in.count() <= few_terms:
        known = {bytes(r["term"]): r["df"] for r in found_in.collect()}
        source = shards.select("ids", "sizes", F.col("terms"), F.lit(None).cast("array<long>").alias("dfs"))
    else:
        known = None
        each = shards.select("shard", F.explode("terms").alias("t")).join(found_in.select(F.col("term").alias("of"), "df"), F.col("t.term") == F.col("of"))
        again = each.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct(F.col("t.term").alias("term"), "df", "t"))).alias("all"))
        source = again.join(shards.select("shard", "ids", "sizes"), "shard").select("ids", "sizes", F.col("all.t").alias("terms"), F.col("all.df").alias("dfs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sizes = np.asarray(batch.column("sizes")[i].values)
                m = 25 + (75 * sizes * n_docs) // max(n_terms, 1)
                rows = batch.column("terms")[i].values
                names = rows.field("term").to_pylist()
                dfs = [known[t] for t in names] if known is not None else batch.column("dfs")[i].values.to_pylist()
                docs, counts = (split(rows.field(c)) for c in ("docs", "counts"))
                impacts = []
                for d, c, df in zip(docs, counts, dfs, strict=True):
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                    c = c.astype(np.int64)
                    impacts.append(weight * ((1_000_000_000 * c) // (1000 * c + 8 * m[d])))
                ends = cut_blocks(impacts)
                bounds = [np.maximum.reduceat(x, np.concatenate(([0], e[:-1]))) for x, e in zip(impacts, ends, strict=True)]
                terms = nested([docs, impacts, ends, bounds], ["docs", "impacts", "ends", "bounds"], [pa.int32(), pa.int64(), pa.int32(), pa.int64()], names)
                yield pa.record_batch({"ids": batch.column("ids").slice(i, 1), "terms": terms})

    return source.mapInArrow(run, INDEX.format(id=id_type))


def split(lists: pa.ListArray) -> list[np.ndarray]:
    offsets, flat = np.asarray(lists.offsets), np.asarray(lists.values)
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


class Lists:
    """The posting lists of a shard by term."""

    def __init__(self, rows: pa.StructArray):
        self.at = {t: i for i, t in enumerate(rows.field("term").to_pylist())}
        self.docs, self.impacts, self.ends, self.bounds = (split(rows.field(c)) for c in ("docs", "impacts", "ends", "bounds"))
        self.starts = [np.concatenate(([0], e[:-1])) for e in self.ends]
        self.firsts = [d[s] for d, s in zip(self.docs, self.starts, strict=True)]
        self.lasts = [d[e - 1] for d, e in zip(self.docs, self.ends, strict=True)]
        self.best = [int(b.max()) for b in self.bounds]

    def opened(self, t: int, base: int, runs: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in list t of the documents in open runs, and their blocks. Blocks without an open document are skipped:
        before has the number of open documents before each."""
        blocks = np.nonzero(before[self.lasts[t] + 1 - base] > before[self.firsts[t] - base])[0]
        sizes = self.ends[t][blocks] - self.starts[t][blocks]
        at = np.repeat(self.starts[t][blocks] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        inside = runs[self.docs[t][at] - base]
        return at[inside], np.repeat(blocks, sizes)[inside]


def search_shard(lists: Lists, n_docs: int, item: Counter, rank: np.ndarray, k: int, take: int = 256) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents (places in the shard) and scores of the k best of one item, and how many documents were scored in full.
    rank orders documents of equal score."""
    terms = [(lists.at[t], times) for t, times in item.items() if t in lists.at and lists.best[lists.at[t]] > 0]
    best_docs, best_scores, scored = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    if not terms:
        return best_docs, best_scores, scored
    # bounds of all blocks as steps: up where a block begins, down after its last document
    places, steps = [], []
    for t, times in terms:
        places += [lists.firsts[t], lists.lasts[t] + 1]
        steps += [lists.bounds[t] * times, lists.bounds[t] * -times]
    cuts, inverse = np.unique(np.concatenate(places), return_inverse=True)
    jumps = np.zeros(len(cuts), np.int64)
    np.add.at(jumps, inverse, np.concatenate(steps))
    bound = np.cumsum(jumps)[:-1]
    runs = np.argsort(-bound, kind="stable")
    longest, least, at = np.diff(cuts), 0, 0
    while at < len(runs):
        if bound[runs[at]] < max(least, 1):
            break
        # as many runs as come to about `take` documents, twice as many each time
        some = runs[at : at + 1 + int(np.searchsorted(np.cumsum(longest[runs[at:]]), take))]
        some = some[bound[some] >= max(least, 1)]
        at, take = at + len(some), 2 * take
        live = np.zeros(len(cuts), np.int64)
        live[some] += 1
        live[some + 1] -= 1
        opened = np.repeat(np.cumsum(live)[:-1] > 0, longest)
        before = np.concatenate(([0], np.cumsum(opened)))
        whole, blocks, score = (np.zeros(len(opened), np.int64) for _ in range(3))
        inside = []
        for t, times in terms:
            here, block = lists.opened(t, cuts[0], opened, before)
            spots = lists.docs[t][here] - cuts[0]
            inside.append((t, times, here, block, spots))
            whole[spots] += lists.best[t] * times
        may = whole >= max(least, 1)
        for t, times, _, block, spots in inside:
            blocks[spots] += lists.bounds[t][block] * times
        may &= blocks >= max(least, 1)
        for t, times, here, _, spots in inside:
            keep = may[spots]
            score[spots[keep]] += lists.impacts[t][here[keep]] * times
        new = np.nonzero(may)[0]
        scored += len(new)
        docs, scores = np.concatenate((best_docs, new + cuts[0])), np.concatenate((best_scores, score[new]))
        docs, scores = docs[scores > 0], scores[scores > 0]
        first = np.lexsort((rank[docs], -scores))[:k]
        best_docs, best_scores = docs[first], scores[first]
        if len(first) == k:
            least = int(best_scores[-1])
    return best_docs, best_scores, scored


def search(index: DataFrame, items: list[tuple], item_type: str, k: int) -> DataFrame:
    """The k best documents of each item in each shard: item, id, score, and the shard's part of the merge."""
    id_type = index.schema["ids"].dataType.elementType.simpleString()
    queries = [(name, Counter(terms)) for name, terms in items]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column("ids")[i].values
                order = np.asarray(pc.sort_indices(ids, null_placement="at_end"))
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                lists = Lists(batch.column("terms")[i].values)
                rows, docs, scores = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for q, (_, item) in enumerate(queries):
                    found, score, _ = search_shard(lists, len(ids), item, rank, k)
                    rows += [q] * len(found)
                    docs.append(found)
                    scores.append(score)
                docs = np.concatenate(docs)
                yield pa.record_batch({"q": pa.array(rows, pa.int32()), "id": ids.take(pa.array(docs)), "score": pa.array(np.concatenate(scores), pa.int64())})

    spark = index.sparkSession
    names = spark.createDataFrame([(q, name) for q, (name, _) in enumerate(queries)], f"q int, item {item_type}")
    return index.mapInArrow(run, f"q int, id {id_type}, score long").join(F.broadcast(names), "q").drop("q")


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    shard_bytes: int = 64 << 20,
    few_terms: int = 200_000,
    item_block: int = 2000,
) -> DataFrame:
    """Returns item, rank, id, score of the k best documents of each item, of those with a score above 0."""
    spark = docs.sparkSession

    def split_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = Flat(batch.column("bytes"))
            yield pa.record_batch({"item": batch.column("item"), "terms": pa.array([list(counted(texts[i].tobytes()).elements()) for i in range(len(texts))], pa.list_(pa.binary()))})

    asked = items.select(F.col(item_col).alias("item"), F.col(text_col).cast("binary").alias("bytes"))
    item_type = asked.schema["item"].dataType.simpleString()
    asked = asked.mapInArrow(split_items, f"item {item_type}, terms array<binary>").groupBy("item").agg(F.flatten(F.collect_list("terms")).alias("terms"))
    asked = materialize(asked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(1 << 20))), "items")
    of_items = asked.select(F.explode("terms").alias("term")).distinct()
    wanted = {bytes(r["term"]) for r in of_items.collect()} if of_items.count() <= few_terms else None
    shards = materialize(postings(docs, wanted, shard_bytes, id_col, text_col), "postings")
    n_docs, n_terms = shards.agg(F.coalesce(F.sum(F.size("sizes")), F.lit(0)), F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()
    found_in = shards.select(F.explode("terms").alias("t")).groupBy(F.col("t.term").alias("term")).agg(F.sum(F.size("t.docs")).alias("df"))
    index = materialize(impact_index(shards, n_docs, n_terms, materialize(found_in, "found"), few_terms), "index")
    n_items, n_asked = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = max(1, -(-n_items // item_block), -(-n_asked // MOST))
    best = None
    for b in range(blocks):
        some = [(r["item"], [bytes(t) for t in r["terms"]]) for r in asked.filter(F.col("block") % blocks == b).select("item", "terms").collect()]
        part = search(index, some, item_type, k)
        best = part if best is None else best.unionByName(part)
    order = (F.col("score").desc(), F.col("id").asc_nulls_last())
    group = F.pmod(F.xxhash64("id", "score"), F.lit(64))
    first = best.withColumn("group", group).withColumn("n", F.row_number().over(Window.partitionBy("item", "group").orderBy(*order))).filter(F.col("n") <= k)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    return first.withColumn("rank", rank).filter(F.col("rank") <= k).select("item", "rank", "id", "score")
