"""Quality scores by supervised subword embeddings.

Every word (a run without white space, as written) has a hashed vector of its own and one for each of its character n-grams
with its edges marked. A document is the average of all these vectors over its words, and a softmax layer gives the chance
of label 1. Vectors and layer are trained together by stochastic gradient descent in numpy, on a bounded sample of
`sample` labelled documents chosen by hash.

After training, each hashed feature contributes one number to a document's score, so words are scored once per task and
kept in a bounded cache.

Defined cases: null and empty texts have no features and get the softmax of the bias; documents without a label are scored
and not learned from; several labels of one document count each; without any label to learn from every score is 0.5; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import Flat, PieceCache, held_out, text_bytes, tidy

BUCKETS = 1 << 18
SHORT, LONG = 2, 4


def features(word: str) -> list[int]:
    """Hashed ids of a word and its character n-grams. Long words have as many as their length gives."""
    b = f"<{word}>".encode()
    grams = {b[i : i + n] for n in range(SHORT, LONG + 1) for i in range(len(b) - n + 1)}
    return [zlib.crc32(b, 7) % BUCKETS, *sorted(zlib.crc32(g) % BUCKETS for g in grams)]


def train(texts: list[str], labels: list[int], dim: int = 8, epochs: int = 6, rate: float = 0.5, batch: int = 32) -> tuple[np.ndarray, float]:
    """What each feature adds to the log-odds of label 1 in a text's average, and the bias."""
    rng = np.random.default_rng(3)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    layer, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    words: dict[str, int] = {}
    docs = []
    for t in texts:
        found, counts = np.unique([words.setdefault(w, len(words)) for w in t.split()], return_counts=True)
        docs.append((found.astype(np.int32), counts.astype(np.float32)))
    grams = array("i")
    n_ids = np.zeros(len(words), np.int64)
    for i, w in enumerate(words):
        own = features(w)
        n_ids[i] = len(own)
        grams.extend(own)
    words.clear()
    flat = np.frombuffer(grams, np.int32) if grams else np.zeros(0, np.int32)
    begin = np.concatenate(([0], np.cumsum(n_ids)))
    y = np.array(labels)
    some = [i for i, (found, _) in enumerate(docs) if len(found)]
    steps, step = max(1, epochs * -(-len(some) // batch)), 0
    for _ in range(epochs):
        rng.shuffle(some)
        for at in range(0, len(some), batch):
            group = some[at : at + batch]
            eta = rate * (1 - step / steps)
            step += 1
            own = np.concatenate([docs[i][0] for i in group])
            doc = np.repeat(np.arange(len(group)), [len(docs[i][0]) for i in group])
            count = np.concatenate([docs[i][1] for i in group])
            total = np.bincount(doc, count * n_ids[own])
            each = np.repeat(np.arange(len(own)), n_ids[own])
            feature = flat[np.arange(len(each)) - np.repeat(np.cumsum(n_ids[own]) - n_ids[own], n_ids[own]) + begin[own][each]]
            weight = (count / total[doc]).astype(np.float32)[each]
            owner = doc[each]
            mean = np.stack([np.bincount(owner, weight * vectors[feature, k], len(group)) for k in range(dim)], axis=1).astype(np.float32)
            z = mean @ layer + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(group)), y[group]] -= 1
            back = p @ layer.T
            layer -= eta * mean.T @ p / len(group) * 20
            bias -= eta * p.mean(axis=0)
            # the features of a document are many; each gets the gradient of the average in full, as its share is small
            order = np.argsort(feature, kind="stable")
            cut = np.flatnonzero(np.concatenate(([True], feature[order][1:] != feature[order][:-1])))
            pull = weight[order, None] * back[owner[order]]
            vectors[feature[order][cut]] -= eta * 20 * np.add.reduceat(pull, cut, axis=0)
    return (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float64), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str, label_col: str) -> tuple[np.ndarray, float]:
    """Labelled rows that are not held out; at most about `sample` of them, by hash of the id."""
    marked = labels.filter(F.col(label_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    n = marked.count()
    chosen = marked.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < int(1_000_003 * min(1.0, sample / max(n, 1))))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").filter("text is not null").toArrow().sort_by([("id", "ascending"), ("label", "ascending"), ("text", "ascending")])
    if not rows.num_rows:
        return np.zeros(BUCKETS), 0.0
    return train(rows["text"].to_pylist(), [int(x > 0) for x in rows["label"].to_pylist()])


class Scorer:
    def __init__(self, adds: np.ndarray, bias: float):
        self.adds, self.bias = adds, bias
        self.cache = PieceCache(self._fill, 150_000)

    def _fill(self, words: list[str]) -> list[complex]:
        """A word's sum and number of features as one complex number."""
        ids = [features(w) for w in words]
        sizes = np.array([len(x) for x in ids])
        sums = np.add.reduceat(self.adds[np.fromiter(itertools.chain.from_iterable(ids), np.int64)], np.cumsum(sizes) - sizes)
        return (sums + 1j * sizes).tolist()

    def score(self, texts: list[str]) -> list[float]:
        words = [t.split() for t in texts]
        self.cache.know(itertools.chain.from_iterable(words))
        of = self.cache.__getitem__
        totals = [sum(map(of, w)) for w in words]
        return [float(1 / (1 + np.exp(-(self.bias + (x.real / x.imag if x else 0.0))))) for x in totals]


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = 5000, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", key: Column | None = None) -> DataFrame:
    """Returns id (or `key` in its place, such as a struct of columns to pass through, while labels go by id_col), held_out,
    score (chance of label 1), predicted."""
    adds, bias = fit(docs, labels, sample, id_col, text_col, label_col)
    model = docs.sparkSession.sparkContext.broadcast((adds, bias))  # a number for each hash bucket

    def run(batches):
        scorer = Scorer(*model.value)
        for batch in batches:
            texts = Flat(batch.column("bytes"))
            for lo, hi in texts.runs(1 << 20):
                score = scorer.score([texts[i].tobytes().decode("utf-8", "replace") for i in range(lo, hi)])
                yield pa.record_batch({"id": batch.column("id").slice(lo, hi - lo), "held_out": batch.column("held_out").slice(lo, hi - lo), "score": pa.array(score, pa.float64()), "predicted": pa.array([int(s >= threshold) for s in score], pa.int32())})

    source = docs.select((F.col(id_col) if key is None else key).alias("id"), held_out(id_col).alias("held_out"), text_bytes(text_col).alias("bytes"))
    return source.mapInArrow(tidy(run), f"id {source.schema['id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
