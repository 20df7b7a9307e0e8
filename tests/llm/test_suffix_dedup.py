import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from tallyframe.llm.suffix_dedup import COVERS, even_labels, remove_repeats


def brute(texts, k):
    seen = Counter(t[i : i + k] for t in texts.values() for i in range(len(t) - k + 1))
    out = {}
    for d, t in texts.items():
        gone = [False] * len(t)
        for i in range(len(t) - k + 1):
            if seen[t[i : i + k]] > 1:
                gone[i : i + k] = [True] * k
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out[d] = (len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone) if not g))
    return out


def test_covers():
    for v, d in COVERS.items():
        assert {(a - b) % v for a in d for b in d} == set(range(v))


def run(spark, rows, k):
    df = spark.createDataFrame(rows, "doc_id long, text string, chunk string, bytes int")
    got = remove_repeats(df, k).collect()
    return {r["id"]: (r["n_bytes"], sum(e - s for s, e in zip(r["starts"], r["ends"])), len(r["starts"]), bytes(r["kept"])) for r in got}


def test_against_brute_force(spark):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdé ") for _ in range(90))
    short = "".join(rng.choice("abcdé ") for _ in range(29))
    rows = []
    for i in range(60):
        t = "".join(rng.choice("abcdefgé ") for _ in range(rng.choice((0, 10, 40, 300, 2000))))
        if i % 3 == 0:
            at = rng.randrange(len(t) + 1)
            t = t[:at] + passage[rng.randrange(40) : 90 - rng.randrange(20)] + t[at:]
        if i % 5 == 0:
            t += short
        rows.append((i, t, "x", 1))
    rows += [(100, rows[6][1], None, None), (101, None, None, None), (102, "", None, None), (103, "ab" * 200, None, None)]
    for k in (30, 65, 200):
        want = brute({r[0]: (r[1] or "").encode() for r in rows}, k)
        got = run(spark, rows, k)
        assert got == want


def test_empty_table_and_all_equal(spark):
    assert run(spark, [], 30) == {}
    got = run(spark, [(i, "x y" * 50, None, None) for i in range(7)], 30)
    assert set(got.values()) == {(150, 150, 1, b"")}
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_passages_by_length(spark):
    """Passages of two documents each: from 400 bytes on they are removed; shorter ones show in n_shared."""
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    sizes, rows = (60, 190, 300, 340, 399, 400, 700), []
    for k, n in enumerate(sizes):
        p = text(n)
        rows += [(2 * k, text(rng.randrange(500)) + p + text(40), "x", 1), (2 * k + 1, text(7) + p, "x", 1)]
    rows += [(90, text(3000), "x", 1), (91, text(90), "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, chunk string, bytes int")
    got = {r["id"]: (sum(e - s for s, e in zip(r["starts"], r["ends"])), r["n_shared"]) for r in remove_repeats(df, 400).collect()}
    for k, n in enumerate(sizes):
        for d in (2 * k, 2 * k + 1):
            removed, shared = got[d]
            assert removed >= n if n >= 400 else removed == 0
            assert shared >= 160 if n >= 292 else shared <= n
    assert got[90] == got[91] == (0, 0)


def test_labels_are_dealt_evenly(spark):
    for parts, each in ((1, 2), (7, 2), (51, 3)):
        labels = even_labels(spark, parts, each)
        rows = labels.collect()
        assert sorted(r["k"] for r in rows) == list(range(parts * each)) and len({r["chunk"] for r in rows}) == parts * each
        dealt = labels.repartition(parts, "chunk").groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert [r["count"] for r in dealt] == [each] * parts
