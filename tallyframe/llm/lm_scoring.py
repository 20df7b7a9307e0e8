"""Masked pseudo-likelihood: every token of a document is predicted from the words on both sides of it.

Two parts give a token's probability, both made from the whole corpus:

1. *A window network.* It sees two words to the left and two to the right (the masked word itself is hidden), each with an
   embedding and a scale for its place, and gives a softmax over classes of words; a word's probability is its class's times
   its share of the class. Classes go by shape (initial capital, final punctuation) and frequency, about equal in mass. The
   `vocabulary` most frequent words have embeddings and shares of their own; of the others, words of one shape are one class,
   in which each kind that the corpus has is as likely as any. The network is trained in numpy by stochastic gradient descent
   on every position of every document: each task trains a copy on its own documents, and the copies are averaged by the
   number of windows they saw, first in groups of tasks and then over the groups.
2. *Counts of two-sided contexts*, which grow with the corpus. How often does the pair of words around a token occur
   elsewhere, and how often with this token? With counts M and m, both without the token itself, its probability is
   (m + P) / (M + 1): the network's P is the prior that the corpus updates.

A document's score is the sum of the log-probabilities of its tokens.

For the counts, documents are dealt to chunks. A chunk sends each distinct (context, token) once with its count, by ranges
of a 48-bit context hash; a bucket sums them and answers each chunk in the order of its names. So a context of a third of
all documents costs one entry per chunk and token.

Defined cases: tokens are runs without ASCII white space; null, empty and blank texts have 0 tokens and log-probability 0;
repeated rows count each; rows with equal or null ids are scored one by one; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import Flat, materialize, shuffle_partitions, text_bytes
from tallyframe.llm.jaccard_join import BLANK
from tallyframe.llm.rolling import Rolling, mix

OFFSETS = (-2, -1, 1, 2)
SHAPES = 4
#: Counts up to this are told exactly, larger ones by their logarithm.
EXACT = 128
_ROLL = Rolling(81)
COUNTS = np.concatenate((np.arange(EXACT), EXACT * 2 ** (np.arange(256 - EXACT) / 4)))


def shape_of(word: bytes) -> int:
    text = word.decode("utf-8", "replace")
    return text[0].isupper() + 2 * (not text[-1].isalnum())


_UPPER, _ALNUM = (np.array([told(chr(i)) for i in range(256)]) for told in (str.isupper, str.isalnum))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of an array on, as one number (zeros follow the last)."""
    return np.ndarray(len(data) + 1, "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))


def shapes_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """shape_of for the words data[start:end]. Words that begin or end beyond ASCII are decoded, one for all of the same four
    bytes at either end, which hold the first and the last character."""
    first, last = data[starts], data[ends - 1]
    out = _UPPER[first] + 2 * ~_ALNUM[last]
    odd = np.flatnonzero((first | last) > 127)
    if len(odd):
        starts, ends = starts[odd], ends[odd]
        here, size = eights(data), np.minimum(ends - starts, 4).astype(np.uint64)
        tails = np.where(size < 4, size, here[np.maximum(ends - 4, 0)] & np.uint64(0xFFFFFFFF))
        _, some, which = np.unique(here[starts] << (np.uint64(64) - np.uint64(8) * size) | tails, return_index=True, return_inverse=True)
        out[odd] = np.array([shape_of(data[starts[i] : ends[i]].tobytes()) for i in some])[which]
    return out


class Tokens:
    """The words of rows lo to hi of a column: data[start:end], by row from edge to edge, each with its fingerprint."""

    def __init__(self, texts: Flat, lo: int, hi: int):
        base = int(texts.offsets[lo])
        self.data = texts.data[base : int(texts.offsets[hi])]
        bounds = texts.offsets[lo : hi + 1].astype(np.int64) - base
        cut = np.zeros(len(self.data) + 1, bool)
        cut[bounds] = True
        inside = ~BLANK[self.data]
        self.starts = np.flatnonzero(inside & (~np.concatenate(([False], inside[:-1])) | cut[:-1]))
        self.ends = np.flatnonzero(inside & (~np.concatenate((inside[1:], [False])) | cut[1:])) + 1
        self.edge = np.searchsorted(self.starts, bounds)
        self.prints = _ROLL.at(_ROLL.prefix(self.data), self.starts, self.ends)


class Ids(dict):
    """Word numbers; unknown words have the number of their shape after the last. Words are looked up many at a time by their
    fingerprints, in order, and then compared byte by byte."""

    def __init__(self, pairs):
        super().__init__(pairs)
        known = Flat(pa.array(list(self), pa.binary()))
        starts, ends = known.offsets[:-1].astype(np.int64), known.offsets[1:].astype(np.int64)
        prints = _ROLL.at(_ROLL.prefix(known.data), starts, ends)
        order = np.argsort(prints)
        self.bits = np.uint64(max(len(self) * 8, 2).bit_length())
        # a last entry that no search passes
        self.prints = np.append(prints[order], np.uint64(2**64 - 1))
        self.number, self.starts, self.size = (np.append(x[order], 0) for x in (np.array(list(self.values()), np.int64), starts, ends - starts))
        self.first = np.searchsorted(self.prints[:-1] >> (np.uint64(64) - self.bits), np.arange(1 << int(self.bits), dtype=np.uint64))
        self.eights = eights(known.data)

    def __missing__(self, word: bytes) -> int:
        return len(self) + shape_of(word)

    def numbers(self, told: Tokens) -> np.ndarray:
        at = self.first[told.prints >> (np.uint64(64) - self.bits)]
        behind = np.flatnonzero(self.prints[at] < told.prints)
        while len(behind):
            at[behind] += 1
            behind = behind[self.prints[at[behind]] < told.prints[behind]]
        met = np.flatnonzero(self.prints[at] == told.prints)
        there, at, size = told.starts[met], at[met], (told.ends - told.starts)[met]
        same, here = self.size[at] == size, eights(told.data)
        left = np.flatnonzero(same)
        for k in range(0, int(size.max(initial=0)), 8):
            left = left[size[left] > k]
            beyond = np.maximum(8 - (size[left] - k), 0).astype(np.uint64) * np.uint64(8)
            same[left] &= (here[there[left] + k] ^ self.eights[self.starts[at[left]] + k]) << beyond == 0
        out = np.empty(len(told.starts), np.int64)
        known = np.zeros(len(out), bool)
        known[met] = True
        other = np.flatnonzero(~known)
        out[other] = len(self) + shapes_of(told.data, told.starts[other], told.ends[other])
        out[met] = self.number[at]
        for i in met[~same]:  # another word of the same fingerprint
            out[i] = self[told.data[told.starts[i] : told.ends[i]].tobytes()]
        return out


def word_counts(source: DataFrame) -> DataFrame:
    """word, shape, n over all rows of a frame with a column bytes."""

    def run(batches):
        found: Counter = Counter()

        def flush():
            words = pa.array(list(found), pa.binary())
            flat = Flat(words)
            return pa.record_batch({"word": words, "shape": pa.array(shapes_of(flat.data, flat.offsets[:-1], flat.offsets[1:]), pa.int32()), "n": pa.array(list(found.values()), pa.int64())})

        for batch in batches:
            texts = Flat(batch.column("bytes"))
            for i in range(len(texts)):
                found.update(texts[i].tobytes().split())
                if len(found) > 400_000:
                    yield flush()
                    found.clear()
        yield flush()

    return source.mapInArrow(run, "word binary, shape int, n long").groupBy("word", "shape").agg(F.sum("n").alias("n"))


def classes_of(counts: np.ndarray, shapes: np.ndarray, n_classes: int) -> np.ndarray:
    """Class of each word: by shape, then by descending frequency, so that classes have about equal mass."""
    order = np.lexsort((-counts, shapes))
    mass = np.cumsum(counts[order]) - counts[order] / 2
    out = np.zeros(len(counts), np.int64)
    out[order] = np.minimum((mass / max(counts.sum(), 1) * n_classes).astype(np.int64), n_classes - 1)
    return out


class Model:
    """vectors: vocabulary, rare ones by shape, and padding; scales: one a place; layer: to the classes and those of rare words."""

    def __init__(self, words: int, n_classes: int, dim: int):
        rng = np.random.default_rng(8)
        self.vectors = rng.normal(0, 0.1, (words + SHAPES + 1, dim)).astype(np.float32)
        self.scales = np.ones((len(OFFSETS), dim), np.float32)
        self.layer = rng.normal(0, 0.1, (dim + 1, n_classes + SHAPES)).astype(np.float32)
        # one-dimensional indices of each vector, which numpy adds at much faster, and two numbers at a time where their count is even
        self.kind = np.complex64 if dim % 2 == 0 else np.float32
        self.cells = np.arange(self.vectors.view(self.kind).size).reshape(len(self.vectors), -1)

    def parts(self) -> list[np.ndarray]:
        return [self.vectors, self.scales, self.layer]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for x in self.parts():
            x[...] = flat[at : at + x.size].reshape(x.shape)
            at += x.size

    def spread(self, n: int) -> np.ndarray:
        """The scales once for each of n positions: numpy multiplies arrays of one shape much faster."""
        return np.repeat(self.scales[:, None], n, axis=1)

    def hidden(self, near: np.ndarray, scales: np.ndarray | None = None) -> np.ndarray:
        """near: (place, position, dim); (position, dim)."""
        total = (near * (self.spread(near.shape[1]) if scales is None else scales)).sum(axis=0)
        # the hyperbolic tangent, as 1 - 2 / (exp(2x) + 1): numpy is several times as fast at that
        total *= 2
        with np.errstate(over="ignore"):
            np.exp(total, out=total)
        total += 1
        return np.subtract(1, np.divide(2, total, out=total), out=total)

    def logits(self, hidden: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, position), so that sums over classes run along whole rows; and hidden with a column of ones."""
        more = np.ones((len(hidden), hidden.shape[1] + 1), np.float32)
        more[:, :-1] = hidden
        return self.layer.T @ more.T, more

    def step(self, context: np.ndarray, target: np.ndarray, rate: float) -> None:
        n = len(context)
        places, scales = np.ascontiguousarray(context.T), self.spread(n)
        near = self.vectors.take(places, axis=0)
        hidden = self.hidden(near, scales)
        z, more = self.logits(hidden)
        p, total, _ = exponentials(z)
        # errors of the softmax times each position's sum, by which the smaller arrays are divided
        p[target, np.arange(n)] -= total
        over = (1 / total)[:, None]
        back = p.T @ self.layer[:-1].T
        hidden *= hidden
        back *= np.subtract(1, hidden, out=hidden) * over
        more *= over * np.float32(rate / n)
        self.layer -= (p @ more).T
        near *= back
        self.scales -= np.matmul(np.ones(n, np.float32), near) * np.float32(rate / n)
        scales *= back * np.float32(-rate / 16)
        np.add.at(self.vectors.view(self.kind).reshape(-1), self.cells.take(places, axis=0).reshape(-1), scales.view(self.kind).reshape(-1))


def exponentials(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """exp(z - top), its sums by column, and top: 0, or the columns' greatest values where sums leave the range of the numbers."""
    with np.errstate(over="ignore"):
        p = np.exp(z)
    total = np.ones(len(p), np.float32) @ p
    if 1e-25 < total.min(initial=1) and total.max(initial=1) < 1e30:
        return p, total, 0.0
    top = z.max(axis=0)
    p = np.exp(z - top)
    return p, p.sum(axis=0), top


def contexts(ids: np.ndarray, edge: np.ndarray, pad: int) -> np.ndarray:
    """Words around each position, from the same document; (position, place), place by place in memory."""
    far = max(map(abs, OFFSETS))
    at = np.arange(far, far + len(ids)) + far * np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    spaced = np.full(len(ids) + far * len(edge), pad)
    spaced[at] = ids
    return np.stack([spaced[at + o] for o in OFFSETS]).T


def numbered(texts: list[bytes], ids: Ids) -> tuple[np.ndarray, np.ndarray]:
    words = Tokens(Flat(pa.array(texts, pa.binary())), 0, len(texts))
    return ids.numbers(words), words.edge


def least_count(counts: DataFrame, words: int) -> int:
    """A count that at least so many words reach (or all words), and not many more but where small counts are alike: counts are
    told to five binary digits, so that some hundred steps are collected, however many words and partitions there are."""
    step = F.expr("shiftleft(shiftright(n, greatest(length(bin(n)) - 5, 0)), greatest(length(bin(n)) - 5, 0))")
    least = 0
    for least, kinds in sorted(counts.groupBy(step).agg(F.count("*")).collect(), reverse=True):
        words -= kinds
        if words <= 0:
            break
    return least


def gather(source: DataFrame, vocabulary: int, n_classes: int) -> dict:
    """What the corpus tells: the vocabulary with classes and shares, and the numbers of rare words by shape."""
    counts = materialize(word_counts(source), "words")
    top = counts.where(F.col("n") >= least_count(counts, vocabulary)).orderBy(F.desc("n"), "word").limit(vocabulary).toArrow()
    words, n, shapes = top["word"].to_pylist(), np.array(top["n"].to_pylist(), np.float64), np.array(top["shape"].to_pylist(), np.int64)
    kinds = np.zeros(SHAPES)
    for shape, count in counts.groupBy("shape").agg(F.count("*")).collect():
        kinds[shape] = count
    rare = np.maximum(kinds - np.bincount(shapes, minlength=SHAPES), 1)
    of = np.concatenate((classes_of(n, shapes, n_classes), n_classes + np.arange(SHAPES)))
    mass = np.bincount(of[: len(n)], n, n_classes)
    share = np.concatenate((np.log(n / np.maximum(mass[of[: len(n)]], 1)), -np.log(rare)))
    return {"words": words, "class": of, "share": share}


def train(source: DataFrame, corpus: dict, n_classes: int, dim: int, rate: float = 0.5, batch_size: int = 256, blocks: int = 32) -> np.ndarray:
    start = Model(len(corpus["words"]), n_classes, dim).flat()
    told = source.sparkSession.sparkContext.broadcast(corpus)  # bounded by the vocabulary

    def run(batches):
        know, ids = told.value, Ids((w, i) for i, w in enumerate(told.value["words"]))
        model, seen, pad = Model(len(ids), n_classes, dim), 0, len(ids) + SHAPES
        for batch in batches:
            texts = Flat(batch.column("bytes"))
            for lo, hi in texts.runs(1 << 20):
                words, edge = numbered([texts[i].tobytes() for i in range(lo, hi)], ids)
                mixed = np.random.default_rng(len(words)).permutation(len(words))
                around, target = contexts(words, edge, pad).T.take(mixed, axis=1).T, know["class"][words[mixed]]
                for k in range(0, len(words), batch_size):
                    some = target[k : k + batch_size]
                    model.step(around[k : k + batch_size], some, rate / (1 + seen / 200_000))
                    seen += len(some)
        if seen:
            parts, team = np.array_split(model.flat(), blocks), TaskContext.get().partitionId() // 256
            yield pa.record_batch({"block": pa.array(range(blocks), pa.int32()), "team": pa.array([team] * blocks, pa.int32()), "seen": pa.array([seen] * blocks, pa.int64()), "part": pa.array([p.tobytes() for p in parts], pa.binary())})

    def mean(rows: pa.Table) -> pa.Table:
        total, n = 0.0, 0
        for seen, part in zip(rows["seen"].to_pylist(), rows["part"].to_pylist(), strict=True):
            total, n = total + seen * np.frombuffer(part, np.float32).astype(np.float64), n + seen
        return pa.table({"block": rows["block"].slice(0, 1), "seen": pa.array([n], pa.int64()), "part": pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())})

    copies = source.mapInArrow(run, "block int, team int, seen long, part binary")
    teams = copies.groupBy("block", "team").applyInArrow(mean, "block int, seen long, part binary")
    parts = teams.groupBy("block").applyInArrow(mean, "block int, seen long, part binary").collect()
    return np.concatenate([np.frombuffer(r["part"], np.float32) for r in sorted(parts, key=lambda r: r["block"])]) if parts else start


def token_scores(model: Model, corpus: dict, words: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """The network's log-probability of every token given its neighbours."""
    around, out = contexts(words, edge, len(corpus["words"]) + SHAPES), np.zeros(len(words))
    for lo in range(0, len(words), 1024):
        some = words[lo : lo + 1024]
        z, _ = model.logits(model.hidden(model.vectors.take(around[lo : lo + 1024].T, axis=0)))
        picked = z[corpus["class"][some], np.arange(len(some))]
        _, total, top = exponentials(z)
        out[lo : lo + 1024] = picked.astype(np.float64) - top - np.log(total) + corpus["share"][some]
    return out


def pair_names(told: Tokens) -> np.ndarray:
    """One 64-bit name for each token: 48 bits of the words on both sides, 16 of the token."""
    word, row = told.prints, np.repeat(np.arange(len(told.edge) - 1), np.diff(told.edge))
    same = row[1:] == row[:-1]
    left, right = np.zeros(len(word), np.uint64), np.zeros(len(word), np.uint64)
    left[1:][same] = word[:-1][same]
    right[:-1][same] = word[1:][same]
    around = mix(left * np.uint64(0x9E3779B97F4A7C15) + right + np.uint64(1))
    return (around & ~np.uint64(0xFFFF)) | (word >> np.uint64(48))


def chunk_names(texts: Flat) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The names of a chunk's tokens by run of rows, and the distinct ones in order with their counts."""
    runs = [pair_names(Tokens(texts, lo, hi)) for lo, hi in texts.runs(2 << 20)]
    return runs, *np.unique(np.concatenate(runs or [np.zeros(0, np.uint64)]), return_counts=True)


def chunk_places(texts: Flat, see: Callable[[Tokens], None] = lambda words: None) -> tuple[list[np.ndarray], int]:
    """Where each token of a chunk is among its distinct names in order, by run of rows; and how many names there are. The runs'
    words are shown to `see` on the way."""
    runs = []
    for lo, hi in texts.runs(2 << 20):
        words = Tokens(texts, lo, hi)
        see(words)
        runs.append(pair_names(words))
    names, places = np.unique(np.concatenate(runs or [np.zeros(0, np.uint64)]), return_inverse=True)
    return np.split(places, np.cumsum([len(r) for r in runs])[:-1]), len(names)


def _edges(names: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins: buckets are equal ranges of the upper half of the names."""
    return np.searchsorted(((names >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))


def _planes(names: np.ndarray) -> bytes:
    """Sorted names byte by byte, which compresses: the upper bytes hardly change."""
    return np.ascontiguousarray(names.view(np.uint8).reshape(-1, 8).T).tobytes()


def _tell(buckets: int):
    def run(docs: pa.Table) -> pa.Table:
        _, names, counts = chunk_names(Flat(docs["bytes"]))
        edge, out = _edges(names, buckets), []
        for b in np.flatnonzero(np.diff(edge)):
            part, n = names[edge[b] : edge[b + 1]], counts[edge[b] : edge[b + 1]]
            many = np.flatnonzero(n > 1)
            out.append((int(b), docs["chunk"][0].as_py(), _planes(part), many.astype(np.uint32).tobytes(), n[many].astype(np.int64).tobytes()))
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = (("bucket", pa.int64()), ("chunk", pa.int64()), ("names", pa.binary()), ("many", pa.binary()), ("counts", pa.binary()))
        return pa.table({k: pa.array(c, t) for (k, t), c in zip(kinds, columns, strict=True)})

    return run


def quantized(counts: np.ndarray) -> np.ndarray:
    big = EXACT + np.round(4 * np.log2(np.maximum(counts, EXACT) / EXACT))
    return np.where(counts < EXACT, counts, np.minimum(big, 255)).astype(np.uint8)


def _count(rows: pa.Table) -> pa.Table:
    """For each chunk, how often its names and their contexts occur in the corpus, in the chunk's order."""
    names, counts = [], []
    for planes, many, n in zip(*(rows[k].to_pylist() for k in ("names", "many", "counts")), strict=True):
        own = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
        count = np.ones(len(own), np.int64)
        count[np.frombuffer(many, np.uint32)] = np.frombuffer(n, np.int64)
        names.append(own)
        counts.append(count)
    sizes = [len(x) for x in names]
    every = np.concatenate(names)
    order = np.argsort(every, kind="stable")
    ordered, count = every[order], np.concatenate(counts)[order]
    out = []
    for key in (ordered, ordered >> np.uint64(16)):
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        totals = np.empty(len(key), np.uint8)
        totals[order] = quantized(np.repeat(np.add.reduceat(count, first), np.diff(np.append(first, len(key)))))
        out.append(np.split(totals, np.cumsum(sizes)[:-1]))
    told = [pa.array([x.tobytes() for x in part], pa.binary()) for part in out]
    return pa.table({"chunk": rows["chunk"], "bucket": rows["bucket"], "here": told[0], "context": told[1]})


def elsewhere(found: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of each distinct name of a chunk, and of its context, besides the token itself."""
    at = np.argsort(found["bucket"].to_numpy(), kind="stable")
    whole = (np.frombuffer(b"".join(found[k].to_pylist()[i] for i in at), np.uint8) for k in ("here", "context"))
    here, context = (COUNTS[x] - 1 for x in whole)
    if len(here) != n:
        raise ValueError("a chunk got answers for other names than it sent")
    return here, context


def pseudo_likelihood(docs: DataFrame, vocabulary: int = 20_000, n_classes: int = 64, dim: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id, n_tokens, log_prob and mean_log_prob (0 without tokens) by the network alone; corpus_log_prob and
    corpus_mean_log_prob, the same updated by how often each token's context occurs elsewhere, with it and in all; and seen
    (share of tokens whose context occurs elsewhere with the same token)."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    source = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("bytes"))
    corpus = gather(source.select("bytes"), vocabulary, n_classes)
    weights = train(source.select("bytes"), corpus, n_classes, dim)
    told = spark.sparkContext.broadcast((corpus, weights))  # bounded by the vocabulary

    def score(own: pa.Table, found: pa.Table) -> pa.Table:
        know, flat = told.value
        ids, model = Ids((w, i) for i, w in enumerate(know["words"])), Model(len(know["words"]), n_classes, dim)
        model.load(flat)
        numbers = []
        runs, n_names = chunk_places(Flat(own["bytes"]), lambda words: numbers.append((ids.numbers(words), words.edge)))
        here, context = elsewhere(found, n_names)
        sizes, alone, sums, again = [], [], [], []
        for (words, edge), at in zip(numbers, runs, strict=True):
            told_by_network = token_scores(model, know, words, edge)
            prior = np.exp(told_by_network)
            q = np.concatenate(([0.0], np.cumsum(told_by_network)))
            p = np.concatenate(([0.0], np.cumsum(np.log((here[at] + prior) / (context[at] + 1)))))
            met = np.concatenate(([0], np.cumsum(here[at] > 0)))
            sizes.append(np.diff(edge))
            alone.append(q[edge[1:]] - q[edge[:-1]])
            sums.append(p[edge[1:]] - p[edge[:-1]])
            again.append(met[edge[1:]] - met[edge[:-1]])
        n, own_sum, total, met = (np.concatenate(x) if x else np.zeros(0) for x in (sizes, alone, sums, again))
        least = np.maximum(n, 1)
        scores = {"log_prob": own_sum, "mean_log_prob": own_sum / least, "corpus_log_prob": total, "corpus_mean_log_prob": total / least, "seen": met / least}
        return pa.table({"id": own["id"], "n_tokens": pa.array(n.astype(np.int64))} | {k: pa.array(x) for k, x in scores.items()})

    chunked = source.withColumn("chunk", F.pmod(F.xxhash64("id", "bytes"), F.lit(2 * parts))).repartition(parts, "chunk")
    sent = chunked.groupBy("chunk").applyInArrow(_tell(parts), "bucket long, chunk long, names binary, many binary, counts binary")
    found = sent.groupBy("bucket").applyInArrow(_count, "chunk long, bucket long, here binary, context binary")
    id_type = source.schema["id"].dataType.simpleString()
    return chunked.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(score, f"id {id_type}, n_tokens long, log_prob double, mean_log_prob double, corpus_log_prob double, corpus_mean_log_prob double, seen double")
