import random

from tallyframe.operators import page_words as P
from tallyframe.plans import words_catalog

SCHEMA = "doc string, page int, x0 double, y0 double, x1 double, y1 double, word string"


def words(*lines):
    """(doc, page, x0, y0, x1, y1, word) of lines as (y, [(x0, x1, word)...])."""
    return [(1, float(x0), float(y), float(x1), y + 9.0, w) for y, row in lines for x0, x1, w in row]


HEAD = [(60, 130, "主要会计数据"), (200, 240, "2024年"), (300, 340, "2023年"), (460, 500, "2022年")]
GOOD = [
    (100, [(50, 120, "（一）主要会计数据")]), (115, [(400, 440, "单位：元"), (445, 500, "币种：人民币")]), (134, [(350, 440, "本期比上年同期")]), (140, HEAD), (146, [(360, 400, "增减(%)")]),
    (200, [(60, 150, "归属于上市公司股东的")]), (212, [(60, 150, "扣除非经常性损益的"), (205, 245, "1,000.00"), (305, 340, "(900.00)"), (380, 400, "5.25"), (460, 500, "800.00")]), (224, [(60, 150, "净利润")]),
    (400, [(50, 120, "(二)主要财务指标")]), (420, [(60, 160, P.ROW)]),
]


def figures(spark, docs):
    rows = [(d, *w, "ok") for d, lines in docs.items() for w in words(*lines)]
    return {r["doc"]: r for r in P.key_figures(spark.createDataFrame([r[:7] for r in rows], SCHEMA).repartition(3), 2024).collect()}


def changed(at, *row):
    return [*GOOD[:at], *row, *GOOD[at + 1 :]]


def test_gates_in_order(spark):
    values = GOOD[6][1]
    docs = {
        "good": GOOD,
        "section_not_found": changed(0),
        "ambiguous_section": [*GOOD, (430, [(50, 120, "(一)主要会计数据")])],
        "year_header_not_found": changed(3, (140, [*HEAD[:3], (460, 500, "2021年")])),
        "ambiguous_year_header": changed(3, (140, HEAD), (160, HEAD)),
        "percentage_column_not_found": changed(2),
        "percentage_column_alignment": changed(4, (146, [(330, 400, "增减(%)")])),
        "unit_not_found": changed(1, (115, [(400, 440, "单位：")])),
        "unit_conflict": changed(1, (115, GOOD[1][1]), (125, [(400, 440, "单位：万元"), (445, 500, "币种：人民币")])),
        "row_not_found": changed(7, (253, [(60, 150, "净利润")])),
        "ambiguous_row": changed(7, GOOD[7], (300, [(60, 160, P.ROW)])),
        "amount_alignment": changed(6, (212, [v for v in values if v[2] != "(900.00)"])),
        "amount_unreadable": changed(6, (212, [*values[:1], (205, 245, "(-1,000.00)"), *values[2:]])),
    }
    got = figures(spark, docs)
    assert {d: r["code"] for d, r in got.items()} == {d: "ok" if d == "good" else d for d in docs}
    r = got["good"]
    assert (str(r["now"]), str(r["before"]), r["unit"], r["currency"], r["top"], r["bottom"]) == ("1000.00", "-900.00", "元", "人民币", 200.0, 233.0)
    assert all(r["now"] is None and r["top"] is None for d, r in got.items() if d != "good")


def test_rows_that_stay_readable(spark):
    docs = {
        "no_currency": changed(1, (115, [(400, 440, "单位:万元")])),
        "one_line": [*GOOD[:5], (212, [(60, 170, P.ROW), *GOOD[6][1][1:]]), *GOOD[8:]],
        "empty_line_between": changed(5, GOOD[5], (206, [(380, 400, "x")])),
        "far_amount": changed(6, (212, [*GOOD[6][1], (620, 640, "7.00")])),
        "percentage_alone": changed(6, (212, [v for v in GOOD[6][1] if v[2] != "5.25"])),
        "no_words_at_all": [(10, [(1, 2, "x")])],
    }
    got = figures(spark, docs)
    assert {d: r["code"] for d, r in got.items()} == {"no_currency": "ok", "one_line": "ok", "empty_line_between": "ok", "far_amount": "amount_alignment", "percentage_alone": "ok", "no_words_at_all": "section_not_found"}
    assert str(got["no_currency"]["now"]) == "10000000.00" and got["no_currency"]["currency"] is None
    assert P.key_figures(spark.createDataFrame([], SCHEMA), 2024).count() == 0


def test_visual_lines_equal_plain_loop(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice((1, 2)), float(rng.randrange(20)), rng.choice((rng.randrange(40) / 2, 7.0)), 30.0, 9.0, rng.choice(("x", "y", "一"))) for _ in range(300)]
    rows += [("a", None, 1.0, 1.0, 1.0, 1.0, "n"), ("a", 1, 1.0, None, 1.0, 1.0, "n"), ("a", 1, 1.0, 1.0, 1.0, 1.0, None), rows[0], rows[0]]
    want = {}
    for doc, page in {r[:2] for r in rows}:
        lines = []
        for r in sorted((r for r in rows if r[:2] == (doc, page) and all(v is not None for v in r)), key=lambda r: (r[3], r[2], r[4], r[5], r[6])):
            if not lines or r[3] - lines[-1][0][3] > 2.5:
                lines.append([])
            lines[-1].append(r)
        for k, line in enumerate(lines):
            want[doc, page, k] = (line[0][3], [r[6] for r in sorted(line, key=lambda r: (r[2], r[3], r[4], r[5], r[6]))])
    got = P.visual_lines(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert {(r["doc"], r["page"], r["line"]): (r["y"], [w["word"] for w in r["words"]]) for r in got} == want


def test_documents_that_hold_their_words(spark):
    import __spark_entry__ as e
    from pyspark.sql import functions as F

    held = e.queries()["key_figures"](spark, e.FLAGSHIP_DIR)._jdf.queryExecution().executedPlan().toString()
    assert held.count("Exchange hashpartitioning") == 1 and held.count("Exchange") == 1
    docs = words_catalog._documents(spark, e.FLAGSHIP_DIR)
    apart = docs.select("doc", F.explode("words").alias("w")).select("doc", "w.*").repartition(3)
    key = lambda r: r["doc"]
    found = sorted(P.key_figures_of(docs, 2024).collect(), key=key)
    assert found == sorted(P.key_figures(apart, 2024).collect(), key=key) and {r["code"] for r in found} >= {"ok", "row_not_found", "amount_alignment"}


def test_lines_of_pages_and_heights(spark):
    from pyspark.sql import functions as F

    words = [(2, 5.0, 10.0, 6.0, 19.0, "c"), (1, 9.0, 10.4, 9.5, 20.0, "b"), (1, 1.0, 10.5, 2.0, 18.0, "a"), (1, 0.0, 11.0, 1.0, 21.0, "d")]
    df = spark.createDataFrame([(words,), ([],), (None,)], "words array<struct<page: int, x0: double, y0: double, x1: double, y1: double, word: string>>")
    got = [r["l"] for r in df.select(P.baseline_lines(F.col("words")).alias("l")).collect()]
    assert [(x["page"], x["y"], x["text"], x["bottom"]) for x in got[0]] == [(1, 10.0, "a b", 20.0), (1, 11.0, "d", 21.0), (2, 10.0, "c", 19.0)]
    assert got[1] == [] and got[2] is None
