import math
import random

import numpy as np
import pytest

from tallyframe.llm.vector_codes import build_tree, compress, digest, filter_nearest


def brute(rows, parts=16, entries=64, rounds=2):
    kept = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    d = max(1, -(-max((len(v) for *_, v in kept), default=0) // parts))
    kept = [(i, lab, v + [0] * (parts * d - len(v))) for i, lab, v in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    cut = lambda v, p: v[p * d : p * d + d]
    books = [[cut(v, p) for *_, v in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: [min(range(len(b)), key=lambda e: (far(cut(v, p), b[e]), e)) for p, b in enumerate(books)]  # noqa: B023, E731
    for _ in range(rounds):
        near = [nearest(v) for *_, v in kept]
        new = [[list(c) for c in b] for b in books]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(v, p) for (*_, v), c in zip(kept, near, strict=True) if c[p] == e]
                if mine:
                    new[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
        books = new
    out, total = [], {}
    for i, lab, v in kept:
        c = nearest(v)
        error = sum(far(cut(v, p), books[p][e]) for p, e in enumerate(c))
        total[lab] = total.get(lab, 0) + error
        out.append((i, lab, "".join(f"{e:02x}" for e in c), error))
    return [(*r, total[r[1]]) for r in out], [np.array(b).reshape(len(first), d) for b in books]


SCHEMA = "vec_id long, embedding array<float>, label int, code string, error int"


def compared(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], SCHEMA).repartition(3)
    coded, books = compress(df, **kw)
    want, want_books = brute(rows, **{k: v for k, v in kw.items() if k != "chunk"})
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, coded.collect()), key=key) == sorted(want, key=key)
    assert digest(books) == digest(want_books)
    return want


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    f = lambda n: np.round(rng.normal(size=n) * rng.choice([0.01, 0.1, 3]), 2).astype(np.float32).tolist()
    rows = [(int(i), f(32), int(rng.integers(4)) if i % 5 else None) for i in rng.permutation(400)]
    hot = f(32)
    rows += [(1000 + i, hot, 9) for i in range(300)] + [(5, f(32), 1), (5, hot, 1), (None, f(32), 2), (None, None, 1)]
    rows += [(2000, [*f(31), None], 1), (2001, [*f(31), math.nan], 1), (2002, [*f(31), math.inf], 1), (2003, f(17), 1), (2004, [], 1), (7, hot, 9), (7, hot, 9)]
    assert len(compared(spark, rows, entries=64, chunk=150)) == len(rows) - 4
    compared(spark, rows[:400], entries=5, rounds=3, chunk=64)


def test_small_and_empty_tables(spark):
    compared(spark, [(3, [0.5] * 20, 1), (2, [-0.001] * 20, None), (2, [-0.001] * 20, None)])
    df = spark.createDataFrame([(1, [math.nan], 1, "", 1), (2, None, 1, "", 1)], SCHEMA)
    for empty in (df, df.limit(0)):
        coded, books = compress(empty)
        assert coded.count() == 0 and coded.columns == ["id", "label", "code", "error", "label_error"] and sum(map(len, books)) == 0
    for large in (1e6, 1e30):
        with pytest.raises(Exception, match="too large"):
            compress(spark.createDataFrame([(1, [large], 1, "", 1)], SCHEMA))[0].count()


@pytest.mark.parametrize("seed", range(4))
def test_trees_assign_as_comparing_all(seed):
    rng = np.random.default_rng(seed)
    for n in (1, 7, 8, 16, 100, 3000):
        points = rng.integers(-4, 5, (n, 3)) * rng.integers(1, 40)
        entries = points[rng.integers(0, n, 20)] if seed % 2 else rng.integers(-60, 60, (20, 3))
        order, *tree = build_tree(points)
        codes, counts, totals = filter_nearest(points[order], *tree, entries)
        want = ((points[order][:, None] - entries) ** 2).sum(2).argmin(1)
        assert codes.tolist() == want.tolist() and sorted(order) == list(range(n))
        assert counts.tolist() == np.bincount(want, minlength=20).tolist()
        assert all(totals[e].tolist() == points[order][want == e].sum(0).tolist() for e in range(20))


def test_most_parts_are_assigned_as_whole_subtrees():
    """On clustered points the boxes leave few points to be compared one by one."""
    rng = random.Random(1)
    centres = [[rng.randrange(-5000, 5000) for _ in range(4)] for _ in range(64)]
    points = np.array([[x + rng.randrange(-5, 6) for x in rng.choice(centres)] for _ in range(4096)])
    order, lows, highs, sums = build_tree(points)
    seen = []

    class Counting(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, np.ndarray) and at.ndim == 1 and len(at) and self.ndim == 2:
                seen.append(len(at))
            return np.asarray(super().__getitem__(at))

    filter_nearest(points[order].view(Counting), lows, highs, sums, np.array(centres))
    assert sum(seen) < 2 * 1500
