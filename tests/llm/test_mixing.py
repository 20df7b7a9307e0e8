import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyframe.llm.mixing import mix


def targets(sizes, shares=(3, 1, 2), budget=1.5, most=2):
    """By raising the level until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    share = {s: shares[i % len(shares)] for i, s in enumerate(names)}
    full, total = set(), budget * sum(sizes.values())
    while True:
        left = [s for s in names if s not in full]
        level = (total - sum(most * sizes[s] for s in full)) / sum(share[s] for s in left) if left else 0
        over = {s for s in left if share[s] * level >= most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else share[s] * level for s in names}
        full |= over


def brute(rows, weight):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    of = {}
    for d, t, s in rows:
        name = str(d) if d is not None else t or ""
        u = (int(hashlib.md5(f"mix:{name}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        w = weight(t)
        of.setdefault(s, []).append((-math.log(u) / w if w and w > 0 else math.inf, d if d is not None else -1, size(t)))
    sizes = {s: sum(x[2] for x in v) for s, v in of.items()}
    target, out = targets(sizes), []
    for s, v in of.items():
        words, before = math.floor(target[s]), 0
        for _, d, n in sorted(v):
            epochs, rest = divmod(words, max(sizes[s], 1))
            out.append((d, s, n, sizes[s], epochs * n + max(0, min(n, rest - before))))
            before += n
    return out, target


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    text = lambda: rng.choice((None, "", "\x0b \t", "ab " * 3000, *(" ".join(rng.choice(("a", "1", "é", "🙂")) for _ in range(rng.randrange(60))) for _ in range(9))))
    rows = [(rng.choice((None, i, 7)) if i % 9 == 0 else i, text(), rng.choice(("b", "b", "b", "b", "a", "é", "\U0001f642", "￮", None, ""))) for i in range(400)]
    rows += [(900, "x y z", "b")] * 5 + [(901, "p q", "only"), (902, None, "empty")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, source string, size int, key string").repartition(3)
    share = lambda t: 0.05 + (len(re.sub(r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", "", t)) / max(len(t), 1) if t is not None else 0)
    got = mix(df).collect()
    want, target = brute(rows, share)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((-1 if r["id"] is None else r["id"], r["source"], r["size"], r["source_size"], r["taken"]) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
    for s in target:
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - target[s]) < 1
    again = mix(df.repartition(5)).select("id", "source", "size", "taken")
    assert sorted(map(tuple, again.collect()), key=key) == sorted(((r["id"], r["source"], r["size"], r["taken"]) for r in got), key=key)


def test_weights_and_empty_tables(spark):
    df = spark.createDataFrame([(i, "w " * 10, "s", w) for i, w in enumerate([1e9] * 5 + [1e-9] * 5 + [0.0, None, float("nan"), -1.0, float("inf")])] + [(99, "w " * 1000, "t", 1.0)], "doc_id long, text string, source string, q double")
    got = {r["id"]: r["taken"] for r in mix(df, F.col("q"), shares=(1, 10), budget=1.0).collect()}
    # s gets an eleventh of 1,150 words: 104 of 150, so the ten with a proper weight and no other
    assert [got[i] for i in (*range(10), 14)].count(10) == 10 and sum(got[i] for i in (10, 11, 12, 13)) == 0
    assert sum(got[i] for i in range(15)) == 104
    empty = mix(df.limit(0))
    assert empty.count() == 0 and "taken" in empty.columns
    none = mix(spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")).collect()
    assert [(r["target"], r["taken"]) for r in none] == [(0.0, 0)] * 2


def test_heavier_documents_are_drawn_more(spark):
    df = spark.createDataFrame([(i, "w " * 10, "s", 4.0 if i % 2 else 1.0) for i in range(4000)], "doc_id long, text string, source string, q double")
    got = mix(df, F.col("q"), budget=0.25).collect()
    heavy = sum(r["taken"] for r in got if r["id"] % 2)
    assert sum(r["taken"] for r in got) == 10_000 and 0.70 < heavy / 10_000 < 0.85
