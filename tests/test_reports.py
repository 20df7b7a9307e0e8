import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tallyframe.operators import reports as P

FACT = "fact_id string, report string, metric string, raw_value string, value decimal(20,2), currency string, multiplier string, unit string, period_start date, period_end date, period_type string, scope string"
CELL = "evidence_id string, value_raw string, value decimal(20,2), currency string, unit string, period_start date, period_end date, period_type string, table_title string, value_text string, row_text string, column_text string, title_text string, unit_text string"
DAY = (dt.date(2024, 1, 1), dt.date(2024, 12, 31), "duration")


def row(schema, base, **other):
    return tuple((base | other)[c.split()[0]] for c in schema.replace("(20,2)", "").split(", "))


def fact(**other):
    return row(FACT, dict(fact_id="f", report="r", metric="revenue", raw_value="1,000.00", value=Decimal(1000), currency="CNY", multiplier="1", unit="元", period_start=DAY[0], period_end=DAY[1], period_type=DAY[2], scope="consolidated"), **other)


def cell(**other):
    return row(CELL, dict(evidence_id="e", value_raw="1,000.00", value=Decimal(1000), currency="人民币", unit="元", period_start=DAY[0], period_end=DAY[1], period_type=DAY[2], table_title="合并利润表", value_text="1,000.00 900.00", row_text="一、营业 收入", column_text="2024年度", title_text="二、合并利润表", unit_text="单位：元"), **other)


def placed(spark, facts, cells, checks):
    return P.placed_facts(spark.createDataFrame(facts, FACT), spark.createDataFrame(checks, "verification_id string, target_id string, status string, evidence_ids array<string>"), spark.createDataFrame(cells, CELL))


def test_what_proves_a_fact(spark):
    total = dict(metric="non_recurring_total", scope="unknown")
    titles = dict(title_text="三、非经常性损益项目及金额", table_title="非经常性损益项目和金额", row_text="合 计")
    cases = [
        ({}, {}, True),
        ({"currency": "人民币"}, {"currency": "CNY"}, True),
        ({"currency": "USD"}, {}, False),
        ({"currency": None}, {}, False),
        ({"raw_value": "1,000.0"}, {}, False),
        ({"value": Decimal(1)}, {}, False),
        ({"unit": None}, {}, True),
        ({"unit": "万元"}, {}, False),
        ({"multiplier": "1.00"}, {}, True),
        ({"multiplier": "x"}, {}, False),
        ({}, {"unit_text": "单位：万元"}, False),
        ({"multiplier": "10000", "unit": None}, {"unit_text": "单位：万 元", "unit": "万元"}, True),
        ({"period_start": None}, {"period_start": None}, True),
        ({}, {"period_start": None}, False),
        ({}, {"period_type": "instant"}, False),
        ({}, {"value_text": "91,000.00"}, False),
        ({}, {"value_text": "- 1,000.00"}, False),
        ({}, {"row_text": "扣除后营业收入"}, False),
        ({"metric": "other"}, {}, False),
        ({}, {"column_text": "2023年度"}, False),
        ({}, {"title_text": None}, False),
        ({}, {"unit_text": None}, False),
        ({}, {"table_title": "合并及母公司利润表"}, False),
        ({"scope": "parent"}, {}, False),
        ({"scope": "parent"}, {"title_text": "母公司利润表", "table_title": "母公司利润表"}, True),
        (total, titles, True),
        (total, titles | {"row_text": "其他合计"}, False),
        ({"scope": "unknown"}, titles, False),
    ]
    facts = [fact(fact_id=f"f{i}", **f) for i, (f, _, _) in enumerate(cases)]
    cells = [cell(evidence_id=f"e{i}", **c) for i, (_, c, _) in enumerate(cases)]
    got = {r["fact_id"]: r for r in placed(spark, facts, cells, [(f"v{i}", f"f{i}", "verified", [f"e{i}", f"e{i}"]) for i in range(len(cases))]).collect()}
    for i, (f, c, want) in enumerate(cases):
        r = got[f"f{i}"]
        assert (r["confirmed"], r["proof"], r["reasons"]) == (want, [f"e{i}"] if want else [], [] if want else ["unproved"]), (f, c)


def test_places_and_text(spark):
    facts = [fact(fact_id=f) for f in "abcdef"] + [fact(fact_id="z", report="s")]
    checks = [
        ("1", "a", "verified", ["e", "e2"]), ("2", "b", "conflict", ["e"]), ("3", "c", "verified", ["e"]), ("4", "c", "insufficient_evidence", []), ("5", "d", "verified", ["nowhere"]), ("6", "e", "verified", None), ("7", "unknown", "verified", ["e"]), ("8", "z", None, ["e"]),
    ]
    out = placed(spark, facts, [cell(), cell(evidence_id="e2")], checks)
    got = {r["fact_id"]: (r["confirmed"], r["reasons"], r["proof"]) for r in out.collect()}
    assert got == {
        "a": (True, [], ["e", "e2"]), "b": (False, ["blocked"], []), "c": (False, ["blocked"], ["e"]), "d": (False, ["unproved"], []), "e": (False, ["unproved"], []), "f": (False, ["none"], []), "z": (False, ["blocked"], []),
    }
    reports = spark.createDataFrame([("r", "R"), ("s", "S"), ("t", "T")], "report string, title string")
    rows = {r["report"]: r for r in P.report_rows(out.filter(F.col("fact_id").isin("a", "f", "z")), reports).collect()}
    assert [x["fact_id"] for x in rows["r"]["confirmed"]] == ["a"] and [x["fact_id"] for x in rows["r"]["pending"]] == ["f"]
    assert rows["r"]["text"] == "# R\n\n## 已确认指标与分析\n\n- revenue：1,000.00（e、e2）\n\n## 待核查\n\n- revenue：1,000.00；" + P.REASONS["none"]
    assert "没有同时具备" in rows["s"]["text"] and rows["t"]["text"].endswith("没有待核查对象。")
    assert placed(spark, [], [], []).count() == 0
