import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tallyframe.llm.ranked_search import Lists, counted, cut_blocks, nested, ranked_search, search_shard

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    docs = [(d, Counter(words(t))) for d, t in docs]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    N, L = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    asked, out = {}, []
    for i, t in items:
        asked.setdefault(i, Counter()).update(words(t))
    for i, q in asked.items():
        scores = []
        for d, c, n in docs:
            m = 25 + (75 * n * N) // L
            s = sum(times * math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in q.items() if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(i, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k])]
    return out


def compared(spark, docs, items, **kw):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, score int, shard string").repartition(3)
    asked = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, rank int")
    found = ranked_search(df, asked, **kw)
    assert found.columns == ["item", "rank", "id", "score"]
    key = lambda r: tuple((x is None, x) for x in r)
    want = brute(docs, items, kw.get("k", 10))
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)
    return want


@pytest.mark.parametrize(("shard_bytes", "few_terms", "item_block"), [(1 << 20, 1000, 100), (700, 0, 7), (5000, 1000, 3)])
def test_search_equals_scoring_every_document(spark, shard_bytes, few_terms, item_block):
    rng = random.Random(5)
    kinds = [f"w{i}" for i in range(40)] + ["é", "É", "Ab", "aB", "1²", "日本"]
    text = lambda n: rng.choice((" ", "-", ". ")).join(rng.choices(kinds, [1 / (i + 1) for i in range(len(kinds))], k=n))
    docs = [(i, text(rng.choice((3, 10, 40)))) for i in range(150)]
    docs += [(500 + i, docs[3][1]) for i in range(30)] + [(7, "w1 w2"), (7, "w1 w2"), (None, "w1 w2"), (None, "w3"), (900, None), (901, ""), (902, " -.\t\x7f"), (903, "w5 " * 20000)]
    items = [(i, text(rng.choice((1, 4, 20)))) for i in range(12)] + [(20, None), (21, ""), (22, "nowhere"), (23, "w1 w1 w1"), (23, "w2"), (24, docs[3][1]), (None, "w7 w8")]
    compared(spark, docs, items, shard_bytes=shard_bytes, few_terms=few_terms, item_block=item_block)
    if few_terms:
        compared(spark, docs, items, k=3)


def test_empty_sides(spark):
    assert compared(spark, [], [(1, "a")]) == []
    assert compared(spark, [(1, "a")], []) == []
    assert compared(spark, [(1, None)], [(1, "a")]) == []
    assert compared(spark, [(1, "a")], [(1, "a")]) != []


def test_blocks_are_the_cheapest_cutting():
    rng = random.Random(2)
    lists = [np.array([rng.choice((1, 5, 5, 80, 100)) for _ in range(n)]) for n in (1, 2, 9, 14, 14, 30)]
    for widest in (4, 128):
        for x, ends in zip(lists, cut_blocks(lists, 0.7, widest), strict=True):
            cost = lambda a, b: (b - a) * max(x[a:b]) - sum(x[a:b]) + 0.7 * max(x)  # noqa: B023, E731
            best = [0.0]
            for b in range(1, len(x) + 1):
                best.append(min(best[a] + cost(a, b) for a in range(max(0, b - widest), b)))
            got = sum(cost(a, b) for a, b in zip([0, *ends[:-1]], ends, strict=True))
            assert ends[-1] == len(x) and np.diff(ends, prepend=0).max() <= widest and got == pytest.approx(best[-1])


def test_search_skips_blocks():
    """Of 20,000 documents few are scored in full, and of the lists only blocks that can still matter are opened."""
    rng = np.random.default_rng(1)
    n, terms = 20_000, [f"t{i}".encode() for i in range(12)]
    docs = [np.sort(rng.choice(n, size, False)) for size in rng.integers(200, 9000, 12)]
    impacts = [(rng.pareto(3, len(d)) * 1000 + 1).astype(np.int64) for d in docs]
    ends = cut_blocks(impacts)
    bounds = [np.maximum.reduceat(x, np.concatenate(([0], e[:-1]))) for x, e in zip(impacts, ends, strict=True)]
    lists = Lists(nested([docs, impacts, ends, bounds], ["docs", "impacts", "ends", "bounds"], [None] * 4, terms).values)
    found, scores, scored = search_shard(lists, n, counted(b"T1 t2 t2 t3 t5 t9"), np.arange(n), 10)
    total = np.zeros(n, np.int64)
    for t, times in ((1, 1), (2, 2), (3, 1), (5, 1), (9, 1)):
        total[docs[t]] += times * impacts[t]
    want = np.lexsort((np.arange(n), -total))[:10]
    assert found.tolist() == want.tolist() and scores.tolist() == total[want].tolist()
    assert scored < n / 10
