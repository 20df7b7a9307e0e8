import re
from collections import Counter

import corpus_pipeline
from test_decontamination import brute as contaminated
from test_jaccard_join import brute as grouped

from tallyframe.llm.quality import score_quality


def cut(texts, k=200, words=51):
    """Runs of repeated strings of k bytes go if they have so many words, or twice the bytes."""
    seen = Counter(t[i : i + k] for t in texts.values() for i in range(len(t) - k + 1))
    out = {}
    for d, t in texts.items():
        gone = bytearray(len(t))
        for i in range(len(t) - k + 1):
            if seen[t[i : i + k]] > 1:
                gone[i : i + k] = b"\1" * k
        for run in re.finditer(b"\x01+", bytes(gone)):
            if run.end() - run.start() < 2 * k and len(re.findall(rb"[^\x00-\x20]+", t[run.start() : run.end()])) < words:
                gone[run.start() : run.end()] = bytes(run.end() - run.start())
        out[d] = bytes(b for b, g in zip(t, gone) if not g).decode("utf-8", "ignore")
    return out


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, at = {r["doc_id"]: r["text"] for r in docs.collect()}, docs
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(k))
        stage(spark, at, sf).write.parquet(path)
        at = spark.read.parquet(path)
        if k < 4:
            assert at.columns == docs.columns
            now = {r["doc_id"]: r["text"] for r in at.collect()}
            assert all(r["n_chars"] == len(r["text"]) for r in at.collect())
        if k == 0:
            labels = spark.read.parquet(f"{sf}/labels.parquet")
            assert set(now) == {r["id"] for r in score_quality(docs, labels).collect() if r["predicted"]} and len(now) > 0.5 * len(before)
        elif k == 1:
            assert set(now) == {d for d, (_, c) in grouped(sorted(before.items())).items() if c == d}
        elif k == 2:
            assert now == cut({d: t.encode() for d, t in before.items()})
        elif k == 3:
            assert set(now) == {d for d, (_, n, _) in contaminated(sorted(before.items()), items).items() if not n}
        else:
            assert {r["doc_id"] for r in at.collect()} == set(now)
        before = now
    assert len(corpus_pipeline.STAGES) == 5


def test_repeated_rows_equal_ids_and_null_ids(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    word = lambda seed, n: " ".join(f"w{(seed * 7919 + i * 104729) % 99991}" for i in range(n))

    def through(stage, rows):
        path = f"{tmp_path}/{stage.__name__}"
        spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
        out = stage(spark, spark.read.parquet(path), sf).collect()
        assert all(r["n_chars"] == len(r["text"]) for r in out)
        return Counter((r["doc_id"], r["text"]) for r in out)

    a, b, c, d = (word(k, 60) for k in range(4))
    assert through(corpus_pipeline.near_duplicate, [(1, a), (1, a), (1, b), (None, b), (None, c), (None, c), (None, d)]) == Counter([(1, a), (1, b), (None, c), (None, d)])
    p, (w, x, y, z) = word(9, 90), (f" {k} " + word(20 + i, 5) for i, k in enumerate("WXYZ"))
    assert through(corpus_pipeline.repeats, [(1, p + w), (1, p + x), (None, p + y), (None, "_" + z)]) == Counter([(1, w[1:]), (1, x[1:]), (None, y[1:]), (None, "_" + z)])
    item = max((r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()), key=len)
    assert through(corpus_pipeline.decontaminate, [(1, item), (1, a), (None, item), (None, b), (None, b)]) == Counter({(1, a): 1, (None, b): 2})
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    marked = {r["doc_id"] for r in labels.collect()}
    good = next(texts[r["id"]] for r in score_quality(docs, labels).orderBy("score", ascending=False).collect() if texts[r["id"]])
    free = next(k for k in texts if k not in marked)
    odd = spark.createDataFrame([(free, good), (free, good), (None, good), (None, good)], "doc_id long, text string")
    docs.select(*corpus_pipeline.COLUMNS).unionByName(odd, allowMissingColumns=True).write.parquet(f"{tmp_path}/quality")
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.quality(spark, spark.read.parquet(f"{tmp_path}/quality"), sf).collect())
    assert got[(None, good)] == 2 and got[(free, good)] >= 2 and got.total() > 0.5 * len(texts)
    accepted = {r["id"] for r in score_quality(docs, labels).collect() if r["predicted"]}
    assert got - Counter({(None, good): 2, (free, good): 2}) == Counter((k, t) for k, t in texts.items() if k in accepted)


def test_quality_rejects_some(spark, tmp_path):
    from inspect import signature

    good, bad = "careful notes on rivers and their history", "click now win cash buy cheap pills"
    rows = [(i, f"{good if i % 2 else bad} {i % 7}", "en", "s", 1) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = {r["doc_id"] for r in corpus_pipeline.quality(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()}
    assert now == set(range(1, 120, 2))
    assert signature(score_quality).parameters["sample"].default == 5000


def test_edge_tables(spark, tmp_path):
    """Empty tables, null and empty texts, a very long text, and columns with clashing names, through every stage."""
    sf = "/root/testdata/sf0.001"
    long = " ".join(f"w{i * 7919 % 99991}" for i in range(25_000))
    rows = [(1, None), (2, ""), (None, None), (None, None), (3, long), (4, long), (5, " \n ")]
    wide = "doc_id long, text string, lang string, source string, n_chars long, id int, row int, bytes int, bucket int, chunk int, size int, node int, words int, key int, start int, length int"
    for name, some in (("none", []), ("some", rows)):
        at = f"{tmp_path}/{name}"
        spark.createDataFrame([(d, t, None, None, None if t is None else len(t), *[7] * 11) for d, t in some], wide).write.parquet(at)
        for stage in (corpus_pipeline.near_duplicate, corpus_pipeline.repeats, corpus_pipeline.decontaminate):
            out = stage(spark, spark.read.parquet(at), sf)
            got = Counter((r["doc_id"], r["text"]) for r in out.collect())
            assert out.columns == list(corpus_pipeline.COLUMNS)
            want = Counter(some)
            if stage is corpus_pipeline.near_duplicate:
                want -= Counter([(4, long)])
            if stage is corpus_pipeline.repeats:
                want = Counter((d, "" if t == long else t) for d, t in some)
            assert got == want, stage
        scored = corpus_pipeline.quality(spark, spark.read.parquet(at), sf)
        assert scored.columns == list(corpus_pipeline.COLUMNS) and Counter((r["doc_id"], r["text"]) for r in scored.collect()) <= Counter(some)
        packed = corpus_pipeline.packing(spark, spark.read.parquet(at), sf).collect()
        assert sum(r["start"] == 0 for r in packed) == len(some)


def test_passage_of_51_short_words(spark, tmp_path):
    word = lambda k, n: [f"{'abcdefghijk'[i % 11]}{(k * 31 + i * 17) % 997}" for i in range(n)]
    shared, short = word(1, 51), word(2, 40)
    texts = {1: word(3, 30) + shared + word(4, 9), 2: shared + word(5, 30), 3: word(6, 9) + short, 4: short + word(7, 11)}
    rows = [(d, " ".join(w), "en", "s", 0) for d, w in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/p")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeats(spark, spark.read.parquet(f"{tmp_path}/p"), "").collect()}
    assert len(" ".join(shared)) < 260
    assert not any(" ".join(shared[5:-5]) in got[d] for d in (1, 2)) and got[3] == rows[2][1] and got[4] == rows[3][1]
