import glob
import os
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tallyframe.functions.text import lines, parse_amount
from tallyframe.operators import changes, rules
from tallyframe.operators.ordered import assembled, section
from tallyframe.plans import alignment_catalog, catalog, change_catalog, comparability_catalog, evidence_catalog, narrative_catalog, placement_catalog, report_catalog, request_catalog, screening_catalog, statement_catalog, stream_catalog, token_catalog, words_catalog  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def shown(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.SQL[name])
    columns = [x[0] for x in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted(tuple(map(shown, r)) for r in want.fetchall())
    assert sorted(tuple(map(shown, r)) for r in got.select(*columns).collect()) == rows


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


FACT = "entity int, metric string, y int, value decimal(20,2), currency string, restatement string, verified boolean"


def pairs(spark, *rows):
    data = [(1, m, y, Decimal(v), *(rest or ("CNY", "not_restated", True))) for m, y, v, *rest in rows]
    return changes.pairs(spark.createDataFrame(data, FACT), 2024, 2024)


@pytest.mark.parametrize(
    ("now", "before", "status", "difference", "rate"),
    [
        ("150.00", "100.00", "ok", "50.00", "0.50000000"),
        ("-50.00", "-100.00", "ok", "50.00", "-0.50000000"),
        ("5.00", "0.00", "zero_prior", None, None),
    ],
)
def test_legacy_change(spark, now, before, status, difference, rate):
    r = changes.legacy_changes(pairs(spark, ("m", 2024, now), ("m", 2023, before))).first()
    assert (r["status"], r["difference"] and str(r["difference"]), r["rate"] and str(r["rate"])) == (status, difference, rate)


def test_ladders(spark):
    later = lambda *rows: changes.annual_changes(pairs(spark, *rows)).first()
    r = later(("m", 2024, "5"), ("m", 2023, "0"))
    assert (r["pair_status"], r["rate_status"], r["difference"], r["rate"]) == ("succeeded", "nonpositive_base", Decimal("5.00"), None)
    assert later(("m", 2024, "5"))["pair_status"] == "missing_fact"
    assert later(("m", 2024, "5"), ("m", 2024, "5"), ("m", 2023, "5"))["pair_status"] == "duplicate_fact"
    assert later(("m", 2024, "5", "USD", "not_restated", True), ("m", 2023, "5"))["pair_status"] == "incompatible_facts"
    assert later(("m", 2024, "5", "CNY", "restated", True), ("m", 2023, "5"))["pair_status"] == "restated_fact"
    assert later(("m", 2024, "5", "CNY", "not_restated", False), ("m", 2023, "5"))["pair_status"] == "unverified_fact"


@pytest.mark.parametrize(("revenue", "third", "total"), [("150", False, 75), ("120", True, 100)])
def test_rules_at_their_boundaries(spark, revenue, third, total):
    now = {"net_profit_parent": "200", "net_profit_ex": "140", "operating_cash_flow": "-5", "accounts_receivable_net": "140", "revenue": revenue, "inventory_net": "140", "cost_of_goods_sold": "120"}
    before = {"net_profit_parent": "100", "net_profit_ex": "70", "operating_cash_flow": "3", "accounts_receivable_net": "100", "revenue": "100", "inventory_net": "100", "cost_of_goods_sold": "100"}
    rows = [(m, 2024, v) for m, v in now.items()] + [(m, 2023, v) for m, v in before.items()]
    r = rules.scored(rules.wide(pairs(spark, *rows))).first()
    assert (r["rule_1"], r["rule_2"], r["rule_3"], r["rule_4"], r["total"]) == (True, True, third, True, total)
    assert rules.scored(rules.wide(pairs(spark, *rows[1:]))).first()["total"] is None


def test_amounts(spark):
    df = spark.createDataFrame([(t,) for t in ("1,234.50", "(5.00)", "(-5.00)", "−7", "（3，000）", "x", "1.005", "( 2.50 )", None)], "t string")
    got = [r[0] for r in df.select(parse_amount(df["t"])).collect()]
    assert got == [Decimal("1234.50"), Decimal("-5.00"), None, Decimal("-7.00"), Decimal("-3000.00"), None, Decimal("1.005"), Decimal("-2.50"), None]


def test_rows_assembled_with_state(spark):
    cases = {
        "a\nb 1.50\nc": (2, 2),
        "a (\n1.50\n)\nx 2.00": (2, 3),
        "2.00\n3.00\n4.00": (3, 1),
        "none\nat\nall": (1, 3),
        "": (1, 1),
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").select(assembled(lines(F.col("t"))).alias("r"), "t")
    assert {r["t"]: (r["r"]["rows"], r["r"]["longest"]) for r in df.collect()} == cases


def test_section(spark):
    df = spark.createDataFrame([("x\nHead\nlong line\nNext\ny",), ("x\ny",), ("Head\nlong line",)], "t string")
    start, stop = section(lines(F.col("t")), F.lit("Head"), lambda x: x.isin("Head", "Next"))
    assert [tuple(r) for r in df.select(start, stop).collect()] == [(1, 3), (None, None), (0, 2)]


def test_band_join_covers_all_events_and_sizes(spark):
    got = {r["event_id"]: r["n_parts"] for r in catalog.QUERIES["band_join_all"](spark, SF).collect()}
    sizes = [r["p_size"] for r in spark.read.parquet(f"{SF}/part.parquet").select("p_size").collect()]
    events = [(r["event_id"], float(r["value"])) for r in spark.read.parquet(f"{SF}/events.parquet").select("event_id", "value").collect()]
    want = {e: sum(abs(v - s) <= 0.25 for s in sizes) for e, v in events}
    assert got == {e: n for e, n in want.items() if n} and len(got) > 0
