"""Expressions and operators on report lines, on small cases: printed forms, boundaries, nulls, empty tables, ties."""

import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import report as R
from tallyframe.operators import extraction, lookups, positions
from tallyframe.plans import catalog, report_catalog  # noqa: F401


def over(spark, cases, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


def test_titles_and_headings(spark):
    titles = {"合并利润表": True, "三、 合并利润表": True, "12．合并利润表": True, "合并利润表（续）": False, "母公司利润表": False, None: None, "": False}
    assert over(spark, titles, lambda t: R.is_title(t, "合并利润表")) == list(titles.values())
    assert over(spark, ["非经常性损益项目及金额", "五、非经常性损益项目和金额"], lambda t: R.is_title(t, "非经常性损益项目和金额")) == [True, True]
    assert over(spark, ["七、5", "七、合并范围", "(一)x", ""], R.is_section) == [False, True, False, False]
    assert over(spark, ["3 / 143", "3 / x", "某公司2024年年度报告全文"], R.is_furniture) == [True, False, True]
    assert over(spark, ["单位：元", "2024年度", "□适用√不适用", "单位：元 1,000.00", ""], R.is_meta) == [True, True, True, False, False]
    assert over(spark, ["母公司资产负债表", "一、合并所有者权益变动表", "资产负债表"], R.is_statement_title) == [True, True, False]


def test_amounts_as_printed(spark):
    cases = {"a 1,234.50 (2.00)": ["1,234.50", "(2.00)"], "−3.5 （4，000）": ["−3.5", "（4，000）"], "1.2.3": [], "500 12": [], "( -7.0 )": ["( -7.0 )"], "": []}
    assert over(spark, cases, R.signed_amounts) == list(cases.values())
    assert over(spark, ["(-5.00)", "(5.00)", "－6.125", "＋1.0", "x", None], R.verifier_amount) == [Decimal("-5"), Decimal("-5"), Decimal("-6.125"), Decimal("1"), None, None]
    assert over(spark, ["应收账款 七、5 1.00 2.00", "存货 12 — 3.00", "合计"], R.row_label) == ["应收账款", "存货", "合计"]
    prefixes = {"应收账款": True, "应收账款附注7 1.0": True, "应收账款（净额）": True, "应收账款融资": False, "其他应收账款": False}
    assert over(spark, prefixes, lambda t: R.has_exact_prefix(t, "应收账款")) == list(prefixes.values())


@pytest.mark.parametrize(
    ("text", "raw", "found"),
    [("x 12.50 y", "12.50", True), ("112.50", "12.50", False), ("12.505", "12.50", False), ("( 12.50 )", "12.50", False), ("- 12.50", "12.50", False),
     ("1,\n12.50", "12.50", True), ("12 .5 0", "12.50", True), ("(12.50)", "(12.50)", True), ("12.50", "", False), ("12.50 ,5", "12.50", False)],
)
def test_complete_token(spark, text, raw, found):
    df = spark.createDataFrame([(text, raw)], "t string, r string")
    assert df.select(R.has_complete_token(F.col("t"), F.col("r"))).first()[0] is found


def test_units_and_years(spark):
    assert [u and tuple(u) for u in over(spark, ["单位：万元 币种：人民币", "单位: 元", "单位：元 币种：美元 币种：欧元", "币种：美元", None], R.unit_of)] == [("万元", "人民币", 10_000), ("元", None, 1), None, None, None]
    assert over(spark, ["2024年12月31日 2023 年12月31日", "2024年12月31日", "2024年6月30日 2023年12月31日", ""], R.year_ends) == [[2024, 2023], None, None, None]
    shown = spark.createDataFrame([("1.50000000",), ("0.12345650",), ("100.00000000",), (None,)], "t string").select(R.shown_decimal(F.col("t").cast("decimal(20,8)")))
    assert [r[0] for r in shown.collect()] == ["1.5", "0.123457", "100", None]


SHEET = ["合并资产负债表", "单位：万元 币种：人民币", "项目 2024年12月31日 2023年12月31日", "应收账款 七、5 1.50 (2.00)", "母公司资产负债表", "应收账款 9.00 9.00"]


def sheet(spark, *docs):
    rows = [(d, i, t) for d, lines in enumerate(docs) for i, t in enumerate(lines)]
    return {r["doc"]: r for r in extraction.balance_sheet(spark.createDataFrame(rows, "doc int, ord int, text string"), 2024, {"ar": "应收账款"}).collect()}


def test_balance_sheet(spark):
    change = lambda k, t: [*SHEET[:k], t, *SHEET[k + 1 :]]
    got = sheet(
        spark, SHEET, SHEET[1:4], [*SHEET[:4], *SHEET], change(2, "x"), change(2, SHEET[2].replace("2023", "2022")), change(1, "币种：人民币"), change(3, "应收账款融资 1.00 2.00"),
        change(3, "应收账款 1.00"), change(3, "应收账款 七、5 (-1.00) 2.00"), change(1, "单位：元"), change(2, "2023年12月31日 2024年12月31日"), [None, ""],
    )
    codes = ["ok", "table_not_found", "ambiguous_table", "missing_or_conflicting_year_header", "missing_year_header", "missing_unit", "row_not_found", "amount_alignment", "amount_unreadable", "ok", "ok", "table_not_found"]
    assert [got[k]["code"] for k in range(12)] == codes
    assert (got[0]["now"], got[0]["before"], got[0]["currency"]) == (15_000, -20_000, "人民币")
    assert (got[9]["now"], got[9]["currency"]) == (Decimal("1.50"), None)
    assert (got[10]["now"], got[10]["before"]) == (-20_000, 15_000)
    assert sheet(spark) == {}


def test_checked(spark):
    kind = "doc int, code string, unit string, currency string, now decimal(38,2), before decimal(38,2)"
    own = spark.createDataFrame([(1, "ok", "元", "人民币", Decimal(5), Decimal(4)), (2, "row_not_found", None, None, None, None), (3, "ok", "元", None, Decimal(5), Decimal(4))], kind)
    told = spark.createDataFrame([(d, "ok", u, "人民币", Decimal(v), Decimal(4)) for d, u, v in ((1, "元", 5), (1, "元", 4), (1, "元", 9), (1, "万元", 5), (2, "元", 5), (3, "元", 5), (4, "元", 5))], kind)
    got = sorted((r["doc"], r["unit"], int(r["now"]), r["status"]) for r in extraction.checked(told, own, ["doc"]).collect())
    assert got == [(1, "万元", 5, "unit_conflict"), (1, "元", 4, "value_in_other_year"), (1, "元", 5, "verified"), (1, "元", 9, "value_conflict"), (2, "元", 5, "insufficient"), (3, "元", 5, "insufficient"), (4, "元", 5, "insufficient")]


def test_positions(spark):
    left = spark.createDataFrame([(1, 0.0), (2, 1.5), (3, -0.4), (4, None), (5, 9.0)], "k int, x double")
    right = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (-1.0,), (None,)], "y double")
    assert {r["k"]: r["y"] for r in positions.nearest(left, "k", "x", right, "y", 1.0).collect()} == {1: -1.0, 2: 1.0, 3: -1.0, 4: None, 5: None}
    assert positions.within(left, "x", right, "y", 0.5).count() == 3
    assert positions.within(left, "x", right.limit(0), "y", 0.5).count() == 0
    values = [([3.0, 0.0, 2.5, 2.6, 5.2], 3), ([], 0), ([1.0, 1.0], 1)]
    df = spark.createDataFrame(values, "v array<double>, n int")
    assert [r[0] for r in df.select(positions.clusters(F.col("v"), 2.5)).collect()] == [3, 0, 1]
    words = spark.createDataFrame([(["a", "b", "c"],), ([],), (["z"],)], "w array<string>")
    assert [r[0] for r in words.select(positions.longest_fragment(F.col("w"), "xbcy")).collect()] == ["bc", "", ""]
    lengths = spark.createDataFrame([([5, 9, 3, 1, 1],), ([],)], "v array<int>")
    assert [r[0] for r in lengths.select(positions.take_with_budget(F.col("v"), 10, 3)).collect()] == [[0, 2, 3], []]


def test_lookups(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k int")
    of = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "t int, v string")
    assert {(r["k"], r["found"], r["v"]) for r in lookups.unique_lookup(df, "k", of, "t", "v").collect()} == {(1, "one", "a"), (2, "duplicate", None), (3, "missing", None), (None, "missing", None)}
    refs = spark.createDataFrame([("x", 1), ("x", 9), ("y", 1), (None, 1), ("x", None)], "kind string, target long")
    assert lookups.dangling_targets(refs, {"x": (of, "t")}).count() == 4
    calc = spark.createDataFrame([(["a", "b"],), (["b"],), ([],)], "ids array<string>")
    pool = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    assert sorted(map(str, ((r["first"], r["second"]) for r in lookups.with_inputs(calc, "ids", pool, "id", "v").collect()))) == ["(1, 2)", "(2, None)", "(None, None)"]


def test_tokens_equal_a_pattern_of_their_own(spark):
    rng = random.Random(7)
    rows = [("a [b 1", "[b"), ("5.00 5.00", "5.00"), ("1.1.1 1.1", "1.1"), ("1 .5", "1.5")]
    rows += [("".join(rng.choice("12., \t\n(-）") for _ in range(rng.randrange(12))), "".join(rng.choice("12.,(") for _ in range(rng.randrange(4)))) for _ in range(400)]
    got = spark.createDataFrame(rows, "t string, r string").select("t", "r", R.has_complete_token(F.col("t"), F.col("r")).alias("x")).collect()
    assert len(got) == len(rows)
    for t, r, x in got:
        body = r"\s*".join(map(re.escape, r))
        pattern = rf"(?<![{R.NUMBER_GOES_ON_BEFORE}])(?<![{R.NUMBER_GOES_ON_BEFORE_SPACE}] ){body}(?![{R.NUMBER_GOES_ON_AFTER}])(?! [{R.NUMBER_GOES_ON_AFTER_SPACE}])"
        assert x == (r != "" and re.search(pattern, re.sub("[ \t]+", " ", t)) is not None), (t, r)


def test_ablation_gathers_lines_once(spark):
    df = catalog.QUERIES["verification_ablation"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("collect_list") == 1
