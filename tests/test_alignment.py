import itertools
import random
import re

from pyspark.sql import functions as F

from tallyframe.operators import alignment as A

ROW = "i int, headings array<struct<x:double,year:int>>, amounts array<struct<x:double,raw:string>>, l double, r double"


def brute(headings, amounts, left, right):
    headings = sorted(h for h in headings or [] if h[0] is not None)
    if headings is None or not headings:
        return "no_headings", None
    near = lambda x: min(headings, key=lambda h: (abs(h[0] - x), h[0]))
    claims = {h: [] for h in headings}
    for x, raw in amounts or []:
        if x is None or (left is not None and left - 3 <= x <= right + 3):
            continue
        if abs(near(x)[0] - x) > 58:
            return "no_heading", None
        claims[near(x)].append(raw)
    if any(len(c) > 1 for c in claims.values()):
        return "claimed_twice", None
    if amounts is None or any(not c for c in claims.values()):
        return "unclaimed", None
    return None, [claims[h][0] for h in sorted(headings, key=lambda h: (h[1], h[0]))]


def test_one_to_one_equals_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        xs = rng.sample(range(0, 400, 10), rng.randrange(4))
        headings = [(float(x), rng.choice((2022, 2023, 2024))) for x in xs] + [(None, 2024)] * (i % 7 == 0)
        amounts = [(rng.choice((float(rng.randrange(0, 400, 5)), *([None] if i % 5 == 0 else []), *((x + rng.randrange(-9, 9)) * 1.0 for x in xs))), f"{k}.5") for k in range(rng.randrange(5))]
        rows.append((i, headings if i % 50 else None, amounts if i % 41 else None, 300.0 if i % 3 else None, 320.0))
    got = {r["i"]: (r["f"]["fault"], r["f"]["amounts"], r["y"]) for r in spark.createDataFrame(rows, ROW).select("i", A.one_each(F.col("headings"), F.col("amounts"), F.col("l"), F.col("r")).alias("f"), A.amount_of_year(F.col("headings"), F.col("amounts"), F.lit(2023)).alias("y")).collect()}
    seen = set()
    for i, headings, amounts, left, right in rows:
        fault, chosen = brute(headings, amounts, left, right)
        seen.add(fault)
        assert got[i][:2] == (fault, chosen), (i, headings, amounts)
        kept = sorted(h for h in headings or [] if h[0] is not None)
        of_year = [h for h in kept if h[1] == 2023]
        mine = [raw for x, raw in amounts or [] if x is not None and kept and min(kept, key=lambda h: (abs(h[0] - x), h[0])) == (of_year or [None])[0]]
        assert got[i][2] == (mine[0] if len(of_year) == 1 and len(mine) == 1 else None)
    assert seen == {None, "no_headings", "no_heading", "claimed_twice", "unclaimed"}


def test_subsets_equal_trying_all(spark):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        label = "".join(rng.choices("ab", k=rng.randrange(1, 7)))
        cut = rng.randrange(len(label) + 1)
        fragments = [rng.choice((label[:cut], label[cut:], "a", "b", "ab", "", None, "x")) for _ in range(rng.randrange(7))]
        rows.append((i, fragments, label))
    got = {r["i"]: r["p"] for r in spark.createDataFrame(rows, "i int, f array<string>, label string").select("i", A.subset_making(F.col("f"), F.col("label")).alias("p")).collect()}
    for i, fragments, label in rows:
        tries = [s for n in range(1, len(fragments) + 1) for s in itertools.combinations(range(len(fragments)), n) if all(fragments[k] for k in s) and "".join(fragments[k] for k in s) == label]
        assert got[i] == (list(min(tries, key=lambda s: sum(1 << k for k in s))) if tries else None)
    none = spark.createDataFrame([(None, "a"), (["a"], None), ([], "a"), (["a"] * 100, "b"), (["a", ""], "")], "f array<string>, label string").select(A.subset_making(F.col("f"), F.col("label"))).collect()
    assert [r[0] for r in none] == [None] * 5


def fragment(raw, target):
    text = re.sub(r"\s+", "", raw)
    number = re.match(r"\d+[.．、]|[一二三四五六七八九十]+[、．.]|[（(][一二三四五六七八九十]+[）)]", text)
    text = text[number.end() :] if number else text
    if text and text in target:
        return text
    if text.startswith(target) and (text == target or text[len(target) :].startswith(("（净", "(净", "（亏损", "(亏损"))):
        return target
    return None


def test_longest_run_equals_trying_all(spark):
    rng = random.Random(3)
    words = ["一、", "营业", "收入", "营业收入", "（净额）", "(亏损以负号填列)", "1.", "其他", "（二）", "净", " "]
    rows = [(i, [rng.choice(words) for _ in range(rng.randrange(6))], rng.choice(("营业收入", "净收入", "营业"))) for i in range(300)] + [(999, None, "a")]
    got = {r["i"]: r["t"] for r in spark.createDataFrame(rows, "i int, w array<string>, label string").select("i", A.longest_run(F.col("w"), F.col("label")).alias("t")).collect()}
    for i, w, label in rows:
        tries = [(len(t), b - a, t) for a in range(len(w or [])) for b in range(a + 1, len(w) + 1) if (t := fragment("".join(w[a:b]), label)) is not None]
        assert (got[i] or "") == (max(tries)[2] if tries else "")
