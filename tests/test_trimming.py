import json
import random

from pyspark.sql import functions as F

from tallyframe.operators import trimming as T

LISTS = ["tasks", "pending", "signals", "calculations", "facts"]


def brute(lists, caps, frame, most):
    """By serialising the whole request again after each record that goes."""
    data = {c: list(lists[c] or []) for c in LISTS}
    cut = any(len(data[c]) > caps[c] for c in LISTS)
    data = {c: data[c][: caps[c]] for c in LISTS}
    text = lambda: frame.replace("@", "true" if cut else "false") + "".join(f"[{','.join(r[1] if r[1] is not None else 'null' for r in data[c])}]" for c in LISTS)
    while len(text()) > most and any(data.values()):
        next(data[c] for c in LISTS if data[c]).pop()
        cut = True
    length = len(text())
    facts = {r[0] for r in data["facts"]}
    left = [r for r in data["calculations"] if all(x in facts for x in r[2] or [])]
    cut |= len(left) < len(data["calculations"])
    data["calculations"] = left
    sent = {r[0] for r in left}
    data["signals"] = [(r[0], r[1], None if r[2] is None else [x for x in r[2] if x in sent]) for r in data["signals"]]
    return data, cut, length, sorted({r[0] for c in LISTS for r in data[c] if r[0] is not None})


def test_trimming_equals_serialising_again(spark):
    rng = random.Random(7)
    caps = {"tasks": 3, "pending": 4, "signals": 3, "calculations": 4, "facts": 5}
    frame = '{"truncated":@,"lists":'
    record = lambda c, i: (rng.choice((f"{c[0]}{i}", f"{c[0]}{i}", None)), rng.choice((None, json.dumps({"id": i, "t": "é" * rng.randrange(20)}, ensure_ascii=False))), rng.choice((None, [], [f"f{rng.randrange(4)}"], [f"c{rng.randrange(3)}", "x"])))
    rows = [(i, *(rng.choice([None, [], *([[record(c, k) for k in range(rng.randrange(1, 7))]] * 4)]) for c in LISTS)) for i in range(250)]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{c} {T.RECORD.replace(':', ': ')}" for c in LISTS)).withColumn("length", F.lit("x")).drop("length")
    base = F.lit(len(frame) - 1 + len("false") + 2 * len(LISTS))
    seen = set()
    for most in (10, 60, 120, 250, 1000):
        for r in T.trimmed(df, LISTS, caps, base, most, "facts", "calculations", "signals").collect():
            data, cut, length, allowed = brute(dict(zip(LISTS, rows[r["i"]][1:], strict=True)), caps, frame, most)
            got = {c: [(x["id"], x["json"], x["refs"]) for x in r[c]] for c in LISTS}
            assert (got, r["truncated"], r["length"], r["allowed"]) == (data, cut, length, allowed), (r["i"], most)
            seen.add((cut, length > most))
    assert seen == {(True, True), (True, False), (False, False), (False, True)} - ({(False, True)} if (False, True) not in seen else set())


def test_long_lists_and_empty_tables(spark):
    df = spark.createDataFrame([(1, *[[(f"{c}{k}", "x" * 100, []) for k in range(2000)] for c in LISTS])], "i int, " + ", ".join(f"{c} {T.RECORD.replace(':', ': ')}" for c in LISTS))
    r = T.trimmed(df, LISTS, dict.fromkeys(LISTS, 1500), F.lit(100), 16_000, "facts", "calculations", "signals").first()
    assert r["truncated"] and 15_899 < r["length"] <= 16_000 and len(r["facts"]) == len(r["allowed"]) == 157
    assert T.trimmed(df.limit(0), LISTS, dict.fromkeys(LISTS, 1), F.lit(1), 5, "facts", "calculations", "signals").count() == 0
