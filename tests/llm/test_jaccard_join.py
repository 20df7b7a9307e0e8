import random
import re

from tallyframe.llm.jaccard_join import near_duplicates


def shingles(t, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def run(spark, rows):
    df = spark.createDataFrame([(d, t, 1, "s") for d, t in rows], "doc_id long, text string, size int, sid string")
    return {r["id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(df).collect()}


def corpus(seed, n, lengths, edits):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 5)))
    rows, bases = [], []
    common = [word() for _ in range(40)]
    for i in range(n):
        if bases and rng.random() < 0.6:
            w = list(rng.choice(bases))
            for _ in range(rng.randrange(edits)):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = [word()] * rng.randrange(2) if len(w) > 1 else [word()]
            if rng.random() < 0.2:
                w = w[: max(1, int(len(w) * rng.uniform(0.7, 1)))]
        else:
            w = [word() for _ in range(rng.choice(lengths))] + (common if rng.random() < 0.3 else [])
        bases.append(w)
        rows.append((i * 3 % 1009, (" " if rng.random() < 0.8 else " \n").join(w).replace("a", "A" if rng.random() < 0.1 else "a")))
    return rows


def test_against_brute_force(spark):
    for seed, lengths, edits in ((1, (1, 3, 4, 5, 6, 8, 9, 12, 33), 3), (2, (20, 60, 200), 9)):
        rows = corpus(seed, 260, lengths, edits) + [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "a b"), (2004, "A  b"), (2005, "x y" * 3)]
        assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == {}
    assert run(spark, [(5, None), (4, "")]) == {5: (0, 5), 4: (0, 4)}


def test_links_of_each_class(spark):
    base = [f"w{i}" for i in range(60)]
    near = [(i, " ".join([*base[:-1], f"x{i}"] if i else base)) for i in range(12)] + [(50, " ".join(base)), (51, None), (52, "alone")]
    for rows in (near, corpus(2, 260, (20, 60, 200), 9)):
        sets = {d: frozenset(shingles(t)) for d, t in rows}
        kinds = set(sets.values()) - {frozenset()}
        want = {d: sum(4 * len(s & o) >= 3 * len(s | o) for o in kinds if o != s) if s else 0 for d, s in sets.items()}
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert {r["id"]: r["n_links"] for r in near_duplicates(df, links_too=True).collect()} == want
    assert "n_links" not in near_duplicates(df).columns


def test_group_of_many_likenesses(spark):
    """Copies of one text with one to forty changed words: a hub joins the close ones, the others are told apart."""
    rng = random.Random(5)
    base, rows = [f"w{i}" for i in range(150)], []
    for i in range(220):
        w = list(base)
        for at in rng.sample(range(150), rng.choice((1, 2, 3, 4, 6, 8, 12, 40))):
            w[at] = f"x{rng.randrange(30)}"
        rows.append((i, " ".join(w)))
    assert run(spark, rows) == brute(rows)


def test_ids(spark):
    """Rows without id, and rows that share one."""
    t = [" ".join(f"{c}{i}" for i in range(20)) for c in "abc"]
    rows = [(None, t[0]), (7, t[0]), (None, t[1]), (8, t[2]), (8, t[2] + " z"), (9, t[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in near_duplicates(df).collect())
    assert got == [(0, 16, 0), (0, 16, 7), (7, 16, 7), (8, 16, 8), (8, 17, 8), (9, 16, 8)]


def test_linked_sets_share_a_signature():
    """Pairs at and above the threshold, of all small sizes and some large ones, have an equal signature."""
    import numpy as np

    from tallyframe.llm.jaccard_join import _bands, signatures

    rng = np.random.default_rng(4)
    for size in [*range(1, 40), 77, 200, 991]:
        for _ in range(30):
            both = rng.integers(0, 2**63, size, dtype=np.uint64)
            spare = len(both) // 3
            a = int(rng.integers(0, spare + 1))
            x = np.concatenate((both, rng.integers(0, 2**63, a, dtype=np.uint64)))
            y = np.concatenate((both, rng.integers(0, 2**63, spare - a, dtype=np.uint64)))
            if not spare:
                continue
            of = np.repeat([0, 1], [len(x), len(y)])
            row, name, step, need = signatures(of, np.concatenate((np.sort(x), np.sort(y))), np.array([len(x), len(y)]), _bands(3, 4))
            shared = set(name[row == 0].tolist()) & set(name[row == 1].tolist())
            for i in (0, 1):
                mine = [need[i, k] for n, k in zip(name[row == i].tolist(), step[row == i], strict=True) if n in shared]
                assert mine and any(mine.count(k) >= k for k in set(mine))
