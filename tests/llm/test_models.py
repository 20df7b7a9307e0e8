import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P

from tallyframe.llm import language_id, lm_scoring
from tallyframe.llm.fingerprints import Printer, edit, fingerprints, likeness
from tallyframe.llm.language_id import identify
from tallyframe.llm.lm_scoring import pseudo_likelihood
from tallyframe.llm.quality import score_quality

PATH = P.path("piece_bpe_32k.model")


def test_forward_sums_all_segmentations():
    vocab = {"▁": 0, "▁a": 1, "a": 2, "ab": 3, "b": 4, "▁ab": 5}
    table = np.array([[0.1, 0.2], [0.05, 0.1], [0.2, 0.1], [0.1, 0.3], [0.15, 0.1], [0.02, 0.05], [0.01, 0.01]])

    def brute(word):
        total = np.zeros(2)
        for cuts in itertools.product((0, 1), repeat=len(word) - 1):
            parts, last = [], 0
            for i, c in enumerate((*cuts, 1), 1):
                if c:
                    parts.append(word[last:i])
                    last = i
            p = np.ones(2)
            for part in parts:
                p = p * (table[vocab[part]] if part in vocab else table[6] if len(part) == 1 else 0)
            total += p
        return np.log(total)

    words = ["a", "ab", "abba", "xab", "aaaabb"]
    got = language_id.log_words(words, vocab, 3, table)
    for w, row in zip(words, got):
        assert np.allclose(row, brute("▁" + w)) and np.allclose(row, language_id._log_long("▁" + w, vocab, 3, table))


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "s", 0, "x"), (9002, "", "en", "s", 0, "x"), (9003, "12 !", None, "s", 3, "x"), (9004, "é" * 400, None, "s", 3, "x")], "doc_id long, text string, lang string, source string, n_chars long, score string")
    got = {r["id"]: r for r in identify(d.unionByName(odd, allowMissingColumns=True), PATH).collect()}
    truth = {r["doc_id"]: r["lang"] for r in d.filter("lang is not null").collect()}
    out = [x for x in truth if zlib.crc32(str(x).encode()) % 5 == 0]
    assert all(got[x]["held_out"] for x in out) and sum(r["held_out"] for k, r in got.items() if k < 9000) == len(out)
    assert sum(got[x]["lang_pred"] == truth[x] for x in out) >= 0.95 * len(out)
    assert [got[k]["lang_pred"] for k in (9001, 9002, 9003)] == ["und"] * 3 and got[9004]["lang_pred"] in set(truth.values())
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert identify(d.limit(0), PATH).count() == 0


def test_quality(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    odd = spark.createDataFrame([(90001, None), (90002, ""), (90003, " ")], "doc_id long, text string")
    got = {r["id"]: r for r in score_quality(d.unionByName(odd, allowMissingColumns=True), labels).collect()}
    assert len(got) == 1003 and got[90001]["score"] == got[90002]["score"]
    rows = [(got[r["doc_id"]]["score"], r["quality"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    good, bad = [s for s, q in rows if q], [s for s, q in rows if not q]
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) > 0.7 * len(good) * len(bad)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert {r["score"] for r in score_quality(odd, labels.limit(0)).collect()} == {0.5}
    assert score_quality(d.limit(0), labels).count() == 0


def test_fingerprints(spark):
    rng = random.Random(2)
    vocab = ["w" + str(i) for i in range(300)]
    rows = [(i * 5 % 211, " ".join(rng.choice(vocab) for _ in range(rng.choice((2, 30, 200))))) for i in range(200)]
    rows += [(1000, None), (1001, ""), (1002, rows[3][1]), (1003, "日本語 é")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, file string")
    got = {r["id"]: r for r in fingerprints(df).collect()}
    order = sorted(rows)
    text = {d: t or "" for d, t in rows}
    assert got[1002]["fingerprint"] == got[rows[3][0]]["fingerprint"]
    assert len(got) == len(rows)
    for (d, _), (after, _) in zip(order, [*order[1:], order[0]]):
        changed = edit(text[d], text[after])
        assert got[d]["n_chars"] == len(text[d]) and got[d]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert 0 <= got[d]["near_edited"] <= 1 and 0 <= got[d]["near_next"] <= 1
        if text[d] == text[after]:
            assert got[d]["near_next"] == 1
    long = [d for d in text if len(text[d]) > 400]
    assert np.mean([got[d]["near_edited"] for d in long]) > np.mean([got[d]["near_next"] for d in long]) + 0.2
    assert fingerprints(df.limit(0)).count() == 0
    one = fingerprints(df.filter("doc_id = 1003")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1 and one[0]["edited_sha256"] == hashlib.sha256(edit("日本語 é", "日本語 é").encode()).hexdigest()
    p = Printer(["a", "b"], 8)
    assert likeness(p.hashes("a b"), p.hashes("b  a")) == 1 and likeness(p.hashes("zz"), p.hashes("a")) == 0


def test_pseudo_likelihood(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(9001, None, 1, 2), (9002, " \n", 1, 2), (9003, "the", 1, 2), (None, "a b", 1, 2), (None, "a b", 1, 2)], "doc_id long, text string, chunk int, bytes int")
    rows = d.unionByName(odd, allowMissingColumns=True)
    texts = {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    # production parameters; the shuffled texts are part of the corpus too
    rng = random.Random(1)
    some = {k: t for k, t in texts.items() if k is not None and 200 < len(t) < 3000}
    mixed = {100_000 + k: " ".join(rng.sample(t.split(), len(t.split()))) for k, t in some.items()}
    both = rows.select("doc_id", "text").unionByName(spark.createDataFrame(list(mixed.items()), "doc_id long, text string"))
    out = pseudo_likelihood(both).collect()
    got = {r["id"]: r for r in out}
    assert len(out) == both.count() and all(got[k]["n_tokens"] == len(t.encode().split()) for k, t in texts.items())
    assert got[9001]["n_tokens"] == got[9002]["n_tokens"] == 0 and got[9001]["log_prob"] == 0
    assert all(r["log_prob"] <= 1e-6 for r in out)
    # the network alone, and updated by the counts
    assert sum(got[k]["log_prob"] > got[100_000 + k]["log_prob"] for k in some) >= 0.95 * len(some)
    assert sum(got[k]["corpus_log_prob"] > got[100_000 + k]["corpus_log_prob"] for k in some) >= 0.9 * len(some)
    assert pseudo_likelihood(both.limit(0)).count() == 0


def test_contexts_elsewhere_by_brute_force(spark, monkeypatch):
    """Untrained network, so that its part is known; counts of contexts and tokens by hand."""
    rng = random.Random(3)
    rows = [(i % 50, " ".join(rng.choice("ab cd éf. G h".split()) for _ in range(rng.randrange(9)))) for i in range(80)] + [(7, None), (None, "ab  cd\tab"), (None, "ab cd ab")]
    monkeypatch.setattr(lm_scoring, "train", lambda source, corpus, n_classes, dim: lm_scoring.Model(len(corpus["words"]), n_classes, dim).flat())
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    corpus = lm_scoring.gather(df.selectExpr("coalesce(cast(text as binary), X'') as bytes"), 3, 4)
    ids = lm_scoring.Ids((w, i) for i, w in enumerate(corpus["words"]))
    model = lm_scoring.Model(3, 4, 8)
    lists = [(t or "").encode().split() for _, t in rows]
    triples = [(w, i, (w[i - 1] if i else None, w[i + 1] if i + 1 < len(w) else None)) for w in lists for i in range(len(w))]
    pairs, around = Counter((c, w[i]) for w, i, c in triples), Counter(c for _, _, c in triples)
    want = []
    for (d, _), w in zip(rows, lists, strict=True):
        numbers, edge = lm_scoring.numbered([b" ".join(w)], ids)
        prior = np.exp(lm_scoring.token_scores(model, corpus, numbers, edge))
        keys = [(w[i - 1] if i else None, w[i + 1] if i + 1 < len(w) else None) for i in range(len(w))]
        want.append((d or -1, len(w), round(sum(math.log((pairs[k, x] - 1 + p) / around[k]) for k, x, p in zip(keys, w, prior)), 4)))
    got = [(r["id"] or -1, r["n_tokens"], round(r["corpus_log_prob"], 4)) for r in pseudo_likelihood(df, 3, 4, 8).collect()]
    assert sorted((d, n) for d, n, _ in got) == sorted((d, n) for d, n, _ in want)
    assert np.allclose([x for *_, x in sorted(got)], [x for *_, x in sorted(want)], atol=1e-2)
    assert (lm_scoring.COUNTS[lm_scoring.quantized(np.arange(128))] == np.arange(128)).all()
    big = np.array([128, 1000, 10**9])
    assert (abs(lm_scoring.COUNTS[lm_scoring.quantized(big)] / big - 1) < 0.1).all()


def test_a_text_that_occurs_twice_scores_higher(spark):
    rng = random.Random(4)
    text = lambda: " ".join(f"w{rng.randrange(400)}" for _ in range(60))
    twice, once = [text() for _ in range(20)], [text() for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(twice + twice + once)), "doc_id long, text string")
    got = {r["id"]: r["corpus_mean_log_prob"] for r in pseudo_likelihood(df).collect()}
    assert min(got[i] for i in range(40)) > max(got[i] for i in range(40, 80))


def test_token_scores_by_hand():
    corpus = {"words": ["a", "b"], "class": np.array([0, 0, 1, 2, 3, 4]), "share": np.log(np.array([0.75, 0.25, 0.5, 0.5, 0.5, 0.5]))}
    model = lm_scoring.Model(2, 1, 4)
    words, edge = np.array([0, 1, 2, 0]), np.array([0, 3, 4])
    got = lm_scoring.token_scores(model, corpus, words, edge)
    for i, (lo, hi) in enumerate(((0, 3), (0, 3), (0, 3), (3, 4))):
        around = [int(words[i + o]) if lo <= i + o < hi else 6 for o in lm_scoring.OFFSETS]
        h = np.tanh(sum(model.vectors[w] * s for w, s in zip(around, model.scales)))
        z = h @ model.layer[:-1] + model.layer[-1]
        p = np.exp(z) / np.exp(z).sum()
        assert math.isclose(got[i], math.log(p[corpus["class"][words[i]]]) + corpus["share"][words[i]], rel_tol=1e-4)
    # one step of training raises the likelihood of what was seen
    around = lm_scoring.contexts(words, edge, 6)
    before = lm_scoring.token_scores(model, corpus, words, edge).sum()
    for _ in range(50):
        model.step(around, corpus["class"][words], 0.5)
    assert lm_scoring.token_scores(model, corpus, words, edge).sum() > before


def test_every_position_is_trained_on(spark, monkeypatch):
    # documents of three words each are learned from; one task, so the steps of all positions are seen here
    df = spark.createDataFrame([("the cat sat",), ("a dog ran",)], "text string").selectExpr("cast(text as binary) as bytes")
    corpus = lm_scoring.gather(df, 10, 2)
    learned = lm_scoring.train(df, corpus, 2, 4)
    assert not np.array_equal(learned, lm_scoring.Model(6, 2, 4).flat())
    changed = (learned != lm_scoring.Model(6, 2, 4).flat())[: 6 * 4].reshape(6, 4).any(axis=1)
    assert changed.all()  # each of the six words is a neighbour of a trained position


def test_what_is_no_letter():
    """Numbers of any kind are none, also inside of words; letters and signs of all scripts are."""
    assert language_id.letter_runs("½ ² Ⅷ ⅷ ① 一 x²y a_b 10 é̂") == ["一", "x", "y", "a", "b", "é"]
    names, table = language_id.learn({"a": {"the": 9}, "b": {"le": 9}}, PATH)
    scorer = language_id.Scorer(names, table, np.log(np.full(2, 0.5)), PATH)
    lang, score = scorer.score(["½ ²", "Ⅷ", "① ٣", "the ²", "the"])
    assert lang == ["und", "und", "und", "a", "a"] and score[:3] == [0.0] * 3 and score[3] == score[4]


def test_words_of_an_unseen_script_touch_no_other_text():
    names, table = language_id.learn({"a": {"the": 9, "cat": 3}, "b": {"le": 9, "chat": 3}}, PATH)
    one = lambda texts: language_id.Scorer(names, table, np.log(np.full(2, 0.5)), PATH).score(texts)
    texts = ["the cat", *("\u10d0" * n for n in range(52, 64)), "\u12a0" * 57 + " le chat", "le chat", "", "the cat the"]
    lang, score = one(texts)
    assert np.isfinite(score).all()
    for i, t in enumerate(texts):
        assert lang[i] == one([t])[0][0] and math.isclose(score[i], one([t])[1][0])
    assert (lang[0], lang[-4], lang[-3], lang[-2], lang[-1]) == ("a", "b", "b", "und", "a")
    vocab, longest = language_id.vocabulary(PATH)
    for n in range(50, 62):
        word = "\u10d0" * n + "the"
        assert np.allclose(language_id.log_words([word], vocab, longest, table)[0], language_id._log_long("▁" + word, vocab, longest, table))


def test_long_words_are_learned_from(monkeypatch):
    counts = {"a": {"the": 9, "cat": 3, "abba" * 9: 2}, "b": {"chat" * 25: 5}}
    names, table = language_id.learn(counts, PATH)
    vocab, _ = language_id.vocabulary(PATH)
    assert table[vocab["chat"] if "chat" in vocab else vocab["c"], 1] > 0.01
    monkeypatch.setattr(language_id, "LONG", 1)
    assert np.allclose(language_id.learn(counts, PATH)[1], table)


def test_places_of_names_and_a_step(spark):
    import pyarrow as pa

    texts = lm_scoring.Flat(pa.array([b"a b c a b", b"", b" a b c", "ä b c".encode()], pa.binary()))
    runs, names, _ = lm_scoring.chunk_names(texts)
    places, n = lm_scoring.chunk_places(texts)
    assert n == len(names) and [p.tolist() for p in places] == [np.searchsorted(names, r).tolist() for r in runs]
    assert lm_scoring.chunk_places(lm_scoring.Flat(pa.array([], pa.binary())))[1] == 0
    for dim in (4, 5):
        model, plain = lm_scoring.Model(6, 3, dim), lm_scoring.Model(6, 3, dim)
        context, target = np.array([[0, 1, 1, 5], [2, 10, 0, 0], [1, 1, 1, 1]]), np.array([0, 6, 2])
        near = plain.vectors[context]
        hidden = np.tanh((near * plain.scales).sum(axis=1))
        p = np.exp(hidden @ plain.layer[:-1] + plain.layer[-1])
        p = p / p.sum(axis=1, keepdims=True) - np.eye(p.shape[1])[target]
        back = (p @ plain.layer[:-1].T) * (1 - hidden**2)
        np.add.at(plain.vectors, context, -0.5 / 16 * back[:, None] * plain.scales)
        plain.scales -= 0.5 / 3 * (near * back[:, None]).sum(axis=0)
        plain.layer -= 0.5 / 3 * np.concatenate((hidden.T @ p, p.sum(axis=0)[None]))
        model.step(context, target, 0.5)
        assert np.allclose(model.flat(), plain.flat(), atol=1e-6)
        assert np.isfinite(model.hidden(np.full((4, 2, dim), 1e9, np.float32))).all()


def test_words_are_numbered_many_at_a_time(monkeypatch):
    """Numbers are those of a search word by word; unknown words are decoded once for all of the same ends, not at every occurrence."""
    rng = random.Random(5)
    letters = ["a", "B", "z.", "É", "é", "ß", "字", "。", "𝒜", "²", "7", "-", " ", "\x00", "longer word".replace(" ", "_"), "Ünlängst"]
    words = sorted({"".join(rng.choices(letters, k=rng.randrange(1, 5))).encode() for _ in range(3000)})
    known = rng.sample(words, 700)
    texts = [rng.choice([b" ", b"\t\n", b"  "]).join(rng.choices(words, k=rng.randrange(40))) for _ in range(900)] + [b"", b" \n", b"a\xff \xffa \xe5\xad", *known]
    plain = {w: i for i, w in enumerate(known)}
    want = [plain.get(w, len(known) + lm_scoring.shape_of(w)) for t in texts for w in t.split()]
    ids, calls, shape_of = lm_scoring.Ids((w, i) for i, w in enumerate(known)), [], lm_scoring.shape_of
    monkeypatch.setattr(lm_scoring, "shape_of", lambda word: calls.append(word) or shape_of(word))
    got, edge = lm_scoring.numbered(texts, ids)
    assert got.tolist() == want and np.diff(edge).tolist() == [len(t.split()) for t in texts]
    assert len(calls) <= len({(w[:4], w[-4:]) for w in words}) + 3 < sum(n >= len(known) for n in want) / 3
    # words of equal fingerprints are still told apart
    monkeypatch.setattr(lm_scoring._ROLL, "at", lambda prefix, starts, ends: (ends - starts).astype(np.uint64) << np.uint64(59))
    assert lm_scoring.numbered(texts, lm_scoring.Ids((w, i) for i, w in enumerate(known)))[0].tolist() == want
    assert lm_scoring.numbered([b"a B"], lm_scoring.Ids([]))[0].tolist() == [0, 1] and len(lm_scoring.numbered([], ids)[0]) == 0


def test_exponentials_stay_in_range():
    for shift in (0, 200, -200):
        z = np.array([[1, -3], [2, 90], [0.5, 0]], np.float32) + np.float32(shift)
        p, total, top = lm_scoring.exponentials(z)
        wide = z.astype(np.float64)
        assert np.allclose(np.log(total) + top, np.log(np.exp(wide - wide.max()).sum(axis=0)) + wide.max(), rtol=1e-5)
        assert np.allclose(p / total, np.exp(wide - wide.max(axis=0)) / np.exp(wide - wide.max(axis=0)).sum(axis=0), rtol=1e-4, atol=1e-30)


def test_most_frequent_words_meet_only_their_like(spark):
    """The words sorted in one task are about as many as are asked for, however many parts the counts have."""
    rng = random.Random(6)
    rows = [(f"w{i}".encode(), 0, 1 + int(40_000 / (1 + i)) + rng.randrange(3)) for i in range(6000)]
    counts = spark.createDataFrame(rows, "word binary, shape int, n long").repartition(16)
    for words in (1, 50, 200, 700):
        least = lm_scoring.least_count(counts, words)
        assert words <= sum(n >= least for *_, n in rows) <= 1.15 * words + 40
    assert lm_scoring.least_count(counts, 6000) == lm_scoring.least_count(counts, 10**6) == min(n for *_, n in rows)
    assert lm_scoring.least_count(counts.limit(0), 5) == 0
    texts = [" ".join(f"w{i}" for i in range(300) if rng.random() < 20 / (i + 1)) for _ in range(200)]
    source = spark.createDataFrame([(t.encode(),) for t in texts], "bytes binary").repartition(8)
    want = sorted(Counter(w.encode() for t in texts for w in t.split()).items(), key=lambda x: (-x[1], x[0]))[:40]
    assert lm_scoring.gather(source, 40, 4)["words"] == [w for w, _ in want]
