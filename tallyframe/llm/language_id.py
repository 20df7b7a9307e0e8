"""Language identification by segmentation-marginalised unigrams.

A language's model gives every string of a fixed public vocabulary a probability. The probability of a word is the sum over
all its segmentations into vocabulary strings, by the forward algorithm; that of a text is the product over its words
(runs of letters, in lower case, each with the vocabulary's word-start sign). Piece probabilities are learned by expectation
maximisation with forward and backward sums over the word counts of a bounded sample, `per_language` documents of each
language, chosen by hash. A character outside the vocabulary is a piece of its own, the same for all.

Texts are scored inside their partition: each distinct word is summed once per task and kept in a bounded cache.

Defined cases: null texts and texts without a letter get `und` and score 0; ties go to the language first in order; an empty
table gives an empty result; if no row may be learned from, every text is `und` with score 0; other columns are not read.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import Flat, PieceCache, held_out, text_bytes
from tallyframe.llm.rolling import mix

LETTERS = re.compile(r"[^\W\d_]+")


def letter_runs(text: str) -> list[str]:
    """Runs of letters. The pattern also takes numbers that are no decimal digits, such as fractions and Roman numerals, for
    letters; where it has met one, its run is cut there."""
    runs = LETTERS.findall(text)
    if all(map(str.isalpha, runs)):
        return runs
    return [part for run in runs for part in "".join(c if c.isalpha() else " " for c in run).split()]
START = "▁"
#: Probabilities are multiplied by this for each character, so that those of usual words stay near 1.
LIFT = 16.0
#: Below this a sum may have lost parts that were too small for a number.
TINY = 1e-200
#: Longer words, with their start sign, are summed one by one, rescaled as they go.
WIDE = 60
#: From this many letters on, words are learned from by logarithms.
LONG = 40


@functools.lru_cache(2)
def vocabulary(path: str) -> tuple[dict[str, int], int]:
    """Strings of a sentencepiece vocabulary that letters can form, by number, and the length of the longest."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))]
    fit = sorted({p for p in pieces if p == START or LETTERS.fullmatch(p.removeprefix(START)) and p == p.lower()})
    return {p: i for i, p in enumerate(fit)}, max(map(len, fit))


def lattice(words: list[str], vocab: dict[str, int], longest: int) -> tuple[np.ndarray, ...]:
    """Edges (word, start, end, piece) of all segmentations, in order of their end."""
    unknown = len(vocab)
    edges = []
    for w, word in enumerate(words):
        for i in range(len(word)):
            for j in range(i + 1, min(len(word), i + longest) + 1):
                piece = vocab.get(word[i:j])
                if piece is not None:
                    edges.append((j, w, i, piece))
                elif j == i + 1:
                    edges.append((j, w, i, unknown))
    edges.sort()
    end, word, start, piece = np.array(edges, np.int64).reshape(-1, 4).T
    return word, start, end, piece


def forward(n: int, width: int, edges: tuple[np.ndarray, ...], weight: np.ndarray) -> np.ndarray:
    """Sums over segmentations of the first k characters: (word, k, language); weight: (edge, language)."""
    word, start, end, _ = edges
    alpha = np.zeros((n, width + 1, weight.shape[1]))
    alpha[:, 0] = 1
    cut = np.searchsorted(end, np.arange(1, width + 2))
    for k in range(1, width + 1):
        part = slice(cut[k - 1], cut[k])
        np.add.at(alpha[:, k], word[part], alpha[word[part], start[part]] * weight[part])
    return alpha


class Pieces:
    """Numbers of vocabulary strings by a 64-bit hash of their characters, for many strings at once."""

    def __init__(self, vocab: dict[str, int]):
        self.base = np.uint64(0x9E3779B97F4A7C15)
        inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
        self.powers, self.inverses = (np.cumprod(np.concatenate(([np.uint64(1)], np.full(WIDE, x))), dtype=np.uint64) for x in (self.base, inverse))
        of_length: dict[int, list[str]] = {}
        for piece in vocab:
            of_length.setdefault(len(piece), []).append(piece)
        pieces = [x for k, x in of_length.items() if k <= WIDE]
        names = np.concatenate([self.sums(x)[:, -1] for x in pieces])
        numbers = np.array([vocab[x] for x in itertools.chain.from_iterable(pieces)])
        order = np.argsort(names)
        self.names, self.numbers = names[order], numbers[order]

    def sums(self, words: list[str]) -> np.ndarray:
        """Sums over the first k characters, for words of one length: (word, k)."""
        width = len(words[0])
        codes = np.array(words, f"U{width}").view(np.uint32).reshape(len(words), width)
        out = np.zeros((len(words), width + 1), np.uint64)
        np.cumsum(mix(codes.astype(np.uint64)) * self.powers[:width], axis=1, out=out[:, 1:])
        return out

    def find(self, sums: np.ndarray, start: int, end: int) -> np.ndarray:
        """Numbers of the strings from start to end, -1 where they are none of the vocabulary."""
        names = (sums[:, end] - sums[:, start]) * self.inverses[start]
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        return np.where(self.names[at] == names, self.numbers[at], -1)


_PIECES: dict[int, tuple[dict, Pieces]] = {}


def pieces_of(vocab: dict[str, int]) -> Pieces:
    if id(vocab) not in _PIECES:
        _PIECES[id(vocab)] = (vocab, Pieces(vocab))
    return _PIECES[id(vocab)][1]


def log_words(words: list[str], vocab: dict[str, int], longest: int, table: np.ndarray) -> np.ndarray:
    """Log-probability of each word in each language; table: (piece, language), the last row for unknown characters.

    Words of one length are summed together: each end of a segmentation from all starts that a piece leads back to.
    """
    out = np.zeros((len(words), table.shape[1]))
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    pieces, at = pieces_of(vocab), 0
    while at < len(order):
        width = len(words[order[at]]) + 1
        if width > WIDE:
            out[order[at]] = _log_long(START + words[order[at]], vocab, longest, table)
            at += 1
            continue
        group = list(itertools.takewhile(lambda i: len(words[i]) + 1 == width, itertools.islice(order, at, at + 20_000)))
        some = [START + words[i] for i in group]
        sums = pieces.sums(some)
        alpha = np.zeros((width + 1, len(some), table.shape[1]))
        alpha[0] = 1
        for end in range(1, width + 1):
            for start in range(max(0, end - longest), end):
                piece = pieces.find(sums, start, end)
                if start == end - 1:
                    alpha[end] += alpha[start] * (table[piece] * LIFT)  # piece -1 is the last row
                else:
                    hit = np.flatnonzero(piece >= 0)
                    alpha[end, hit] += alpha[start, hit] * (table[piece[hit]] * LIFT ** (end - start))
        last = alpha[width]
        # sums near the smallest number have lost digits or are 0: these words are summed again, rescaled as they go
        tiny = (last < TINY).any(axis=1)
        out[group] = np.log(np.maximum(last, TINY)) - width * math.log(LIFT)
        for i in np.flatnonzero(tiny):
            out[group[i]] = _log_long(some[i], vocab, longest, table)
        at += len(group)
    return out


def _log_long(word: str, vocab: dict[str, int], longest: int, table: np.ndarray) -> np.ndarray:
    """The same for one word of any length: the last sums only, rescaled as they go."""
    last, scale = [np.ones(table.shape[1])], np.zeros(table.shape[1])
    for j in range(1, len(word) + 1):
        total = np.zeros(table.shape[1])
        for i in range(max(0, j - longest), j):
            piece = vocab.get(word[i:j], len(vocab) if i == j - 1 else None)
            if piece is not None:
                total += last[i - j] * table[piece]
        last.append(total)
        del last[:-longest]
        scale += np.log(total)
        last = [x / total for x in last]
    return scale


def _log_shares(size: int, edges: tuple[np.ndarray, ...], log_weight: np.ndarray) -> np.ndarray:
    """The chance of each edge among the segmentations of one word of any length."""
    _, start, end, _ = edges
    ahead, behind = np.zeros(size + 1), np.zeros(size + 1)
    cut = np.searchsorted(end, np.arange(1, size + 2))
    for k in range(1, size + 1):
        part = slice(cut[k - 1], cut[k])
        ahead[k] = np.logaddexp.reduce(ahead[start[part]] + log_weight[part])
    by_start = np.argsort(start, kind="stable")
    cut = np.searchsorted(start[by_start], np.arange(size + 1))
    for k in range(size - 1, -1, -1):
        part = by_start[cut[k] : cut[k + 1]]
        behind[k] = np.logaddexp.reduce(behind[end[part]] + log_weight[part])
    return np.exp(ahead[start] + log_weight + behind[end] - ahead[size])


def learn_one(counts: dict[str, int], path: str, rounds: int = 4, floor: float = 1e-7) -> np.ndarray:
    """Piece probabilities of one language from its word counts; the last one is for unknown characters."""
    vocab, longest = vocabulary(path)
    words = sorted(w for w in counts if len(w) < LONG)
    long = [(counts[w], len(w) + 1, lattice([START + w], vocab, longest)) for w in sorted(counts) if len(w) >= LONG]
    n = np.array([counts[w] for w in words], float)
    groups = []
    for size, some in itertools.groupby(sorted(range(len(words)), key=lambda i: (len(words[i]), i)), key=lambda i: len(words[i])):
        some = list(some)
        groups.append((some, size + 1, lattice([START + words[i] for i in some], vocab, longest)))
    p = np.full(len(vocab) + 1, 1 / len(vocab))
    for _ in range(rounds):
        expected = np.zeros(len(vocab) + 1)
        for some, width, edges in groups:
            word, start, end, piece = edges
            weight = (p[piece] * 64.0 ** (end - start))[:, None]
            ahead = forward(len(some), width, edges, weight)[:, :, 0]
            back_order = np.argsort(width - start, kind="stable")
            mirrored = tuple(x[back_order] for x in (word, width - end, width - start, piece))
            behind = forward(len(some), width, mirrored, weight[back_order])[:, :, 0]
            share = ahead[word, start] * weight[:, 0] * behind[word, width - end] / ahead[word, width]
            expected += np.bincount(piece, share * n[some][word], minlength=len(vocab) + 1)
        for times, size, edges in long:
            expected += np.bincount(edges[3], _log_shares(size, edges, np.log(p[edges[3]])) * times, minlength=len(vocab) + 1)
        p = expected / max(expected.sum(), 1) + floor
    return p / p.sum()


def table_of(fitted: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    """Languages in order and the (piece, language) table; an unknown character says nothing about the language."""
    names = sorted(fitted)
    table = np.stack([fitted[k] for k in names], axis=1) if names else np.zeros((0, 0))
    if names:
        table[-1] = table[-1].mean()
    return names, table


def learn(counts: dict[str, dict[str, int]], path: str) -> tuple[list[str], np.ndarray]:
    return table_of({k: learn_one(v, path) for k, v in counts.items()})


class Scorer:
    def __init__(self, names: list[str], table: np.ndarray, prior: np.ndarray, path: str):
        self.names, self.table, self.prior = names, table, prior
        self.vocab, self.longest = vocabulary(path)
        self.cache = PieceCache(self._fill, 200_000)
        self.rows = np.zeros((0, len(names)))

    def _fill(self, words: list[str]) -> list[int]:
        # rows of words that the cache dropped are dropped with it
        kept = len(self.cache)
        self.rows = np.concatenate((self.rows[:kept], log_words(words, self.vocab, self.longest, self.table)))
        return range(kept, kept + len(words))

    def score(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.names:
            return ["und"] * len(texts), [0.0] * len(texts)
        words = [letter_runs(t.lower()) for t in texts]
        self.cache.know(itertools.chain.from_iterable(words))
        flat = np.fromiter(map(self.cache.__getitem__, itertools.chain.from_iterable(words)), np.int64)
        edge = np.concatenate(([0], np.cumsum([len(w) for w in words])))
        # each text is summed by itself, so that no text touches another's score
        total = np.tile(self.prior, (len(texts), 1))
        some = np.flatnonzero(np.diff(edge))
        if len(some):
            total[some] += np.add.reduceat(self.rows[flat], edge[some], axis=0)
        best = total.argmax(axis=1)
        with np.errstate(over="ignore"):
            score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        some = np.diff(edge) > 0
        return [self.names[b] if s else "und" for b, s in zip(best, some, strict=True)], [float(x) if s else 0.0 for x, s in zip(score, some, strict=True)]


def train(docs: DataFrame, path: str, per_language: int, id_col: str, text_col: str, lang_col: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Learns from rows that are not held out: all of them for the languages and their shares, a sample for the words."""
    rows = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    shares = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not shares:
        return [], np.zeros((0, 0)), np.zeros(0)
    cut = F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(min(1.0, per_language / n))) for k, n in shares.items()))
    sample = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < 1_000_003 * cut[F.col("lang")]).select("lang", "text")

    def count(batches):
        for batch in batches:
            found: Counter = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found.update((lang, w) for w in letter_runs(text.lower()))
            yield pa.record_batch({"lang": pa.array([k[0] for k in found], pa.string()), "word": pa.array([k[1] for k in found], pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    def fit(rows: pa.Table) -> pa.Table:
        counts = dict(zip(rows["word"].to_pylist(), rows["n"].to_pylist(), strict=True))
        return pa.table({"lang": rows["lang"].slice(0, 1), "p": pa.array([learn_one(counts, path).tobytes()], pa.binary())})

    # one task a language, on the words of its bounded sample
    words = sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    fitted = {r["lang"]: np.frombuffer(r["p"]).copy() for r in words.groupBy("lang").applyInArrow(fit, "lang string, p binary").collect()}
    names, table = table_of({k: fitted[k] if k in fitted else learn_one({}, path) for k in shares})
    all_rows = sum(shares.values())
    return names, table, np.log(np.array([shares[k] / all_rows for k in names]))


def identify(docs: DataFrame, path: str, per_language: int = 800, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Returns id, held_out, lang_pred, score."""
    names, table, prior = train(docs, path, per_language, id_col, text_col, lang_col)
    model = docs.sparkSession.sparkContext.broadcast((names, table, prior))  # vocabulary times languages

    def run(batches):
        scorer = Scorer(*model.value, path)
        for batch in batches:
            texts = Flat(batch.column("bytes"))
            for lo, hi in texts.runs(2 << 20):
                lang, score = scorer.score([texts[i].tobytes().decode("utf-8", "replace") for i in range(lo, hi)])
                yield pa.record_batch({"id": batch.column("id").slice(lo, hi - lo), "held_out": batch.column("held_out").slice(lo, hi - lo), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())})

    source = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), text_bytes(text_col).alias("bytes"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
