import random
import re

import pytest

from tallyframe.llm.decontamination import contamination


def words(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, k=10):
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, s in items:
            v = words(s)
            for win in ([v[j : j + k] for j in range(len(v) - k + 1)] if len(v) >= k else [v] * bool(v)):
                for a in range(len(w) - len(win) + 1):
                    if w[a : a + len(win)] == win:
                        hit |= set(range(a, a + len(win)))
                        found.add(str(i))
        out[d] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_against_brute_force(spark, limit):
    rng = random.Random(9)
    vocab = ["the", "Of", "é", "日本", "x1", "a", "b", "c9", "dd", "e"]
    say = lambda n: " ".join(rng.choice(vocab) + rng.choice(("", ",", "\n", "-")) for _ in range(n))
    items = [(i, say(rng.choice((0, 1, 2, 9, 10, 11, 25)))) for i in range(30)] + [(90, None), (91, "  !"), (3, say(14))]
    docs = [(i, say(rng.choice((0, 1, 5, 9, 10, 40))) + " " + (rng.choice(items)[1] or "").upper() + " " + say(4)) for i in range(80)] + [(900, None), (901, "")]
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, words int")
    b = spark.createDataFrame([(i, t, "q") for i, t in items], "item_id long, text string, key string")
    got = {r["id"]: (r["n_words"], r["n_hit"], r["items"]) for r in contamination(d, b, broadcast_bytes=limit).collect()}
    assert got == brute(docs, items)
    if limit:
        assert contamination(d.limit(0), b).count() == 0
        assert {r["n_hit"] for r in contamination(d, b.limit(0)).collect()} == {0}
        twice = contamination(d.union(d), b).collect()
        assert len(twice) == 2 * len(docs) and {r["id"]: (r["n_words"], r["n_hit"], r["items"]) for r in twice} == got
