import datetime as dt
from decimal import Decimal

import pytest
from test_identity_changes import NAMES, SCHEMA, fact

from tallyframe.operators import screening as S

STOCKS = ("accounts_receivable_net", "inventory_net")
METRICS = {m: scope for wants in S.NEEDS.values() for m, _, scope, _ in wants}


def report(**values):
    """All facts of a report; values: metric=(current, comparative)."""
    rows = []
    for m, scope in METRICS.items():
        for role, v in zip(("current", "comparative"), values.get(m, (100, 100)), strict=True):
            start = {"period_start": None, "period_type": "instant"} if m in STOCKS else {}
            rows.append(fact(role, metric=m, fact_id=f"{m}-{role}", scope=scope, value=Decimal(v), **start))
    return rows


def evaluated(spark, facts, checks=None, verdicts=None, mapped=("r",)):
    checks = [(f[NAMES.index("fact_id")], "financial_fact", "verified") for f in facts] if checks is None else checks
    verdicts = [("d", 2024, "verified", "not_restated")] if verdicts is None else verdicts
    rules = S.four_rules(
        spark.createDataFrame(facts, SCHEMA), spark.createDataFrame(checks, "target_id string, target_type string, status string"), spark.createDataFrame(verdicts, "document string, report_year int, status string, restatement string"),
        spark.createDataFrame([("r", 2024)], "report string, report_year int"), spark.createDataFrame([(m,) for m in mapped], "report string"),
    )
    return {r["rule"]: r for r in rules.collect()}, S.total_score(rules).first()["total"]


@pytest.mark.parametrize(
    ("values", "hits", "total"),
    [
        ({}, "0000", 0),
        ({"operating_cash_flow": (-1, 5), "net_profit_consolidated": (1, -5)}, "1000", 25),
        ({"net_profit_parent_ex_nonrecurring": (70, 0), "accounts_receivable_net": (130, 100), "revenue": (110, 100)}, "0110", 50),
        ({"net_profit_parent_ex_nonrecurring": (71, 0), "accounts_receivable_net": (129, 100), "revenue": (110, 100)}, "0000", 0),
        ({"net_profit_parent_ex_nonrecurring": (130, 0), "inventory_net": (120, 100), "net_profit_parent": (100, -5)}, "0101", 50),
    ],
)
def test_rules_at_their_boundaries(spark, values, hits, total):
    rules, points = evaluated(spark, report(**values))
    assert "".join(str(int(rules[r]["triggered"])) for r in S.NEEDS) == hits and points == total
    assert all(r["issues"] == [] and r["status"] == "calculable" and r["points"] == 25 * r["triggered"] for r in rules.values())


def test_reasons_to_abstain(spark):
    def changed(metric, role="current", drop=False, **other):
        at = lambda f: (f[NAMES.index("metric")], f[NAMES.index("role")]) == (metric, role)
        return [tuple(other.get(n, v) for n, v in zip(NAMES, f, strict=True)) if at(f) else f for f in report() if not (drop and at(f))]

    day = dt.date(2024, 6, 30)
    cases = [
        (changed("revenue", drop=True), ["missing_fact"]),
        ([*report(), fact(metric="revenue", fact_id="again")], ["duplicate_fact"]),
        ([*report(), fact(metric="revenue", fact_id="revenue-current")], ["duplicate_fact", "duplicate_fact_id"]),
        ([*report(), fact("other", metric="revenue")], ["unknown_comparison_role"]),
        (changed("revenue", report_year=2023), ["report_year_mismatch"]),
        (changed("revenue", period_end=day), ["period_role_mismatch"]),
        (changed("revenue", frequency=None), ["period_type_mismatch"]),
        (changed("revenue", period_start=day), ["period_start_mismatch"]),
        (changed("accounts_receivable_net", period_start=day), ["period_start_mismatch"]),
        (changed("revenue", scope=None), ["scope_mismatch"]),
        (changed("revenue", restatement="restated"), ["restatement_conflict"]),
        (changed("revenue", unit=" "), ["basis_mismatch", "unit_missing"]),
        (changed("revenue", currency="Unknown"), ["basis_mismatch", "currency_missing"]),
        (changed("revenue", multiplier="1.00"), []),
        (changed("revenue", company=None), ["basis_mismatch"]),
    ]
    for facts, issues in cases:
        rules, points = evaluated(spark, facts)
        assert rules["receivables_ahead"]["issues"] == issues, issues
        assert (points is None) == bool(issues) and rules["inventory_ahead"]["issues"] == []


def test_proofs_and_bases(spark):
    facts = report()
    ids = [f[NAMES.index("fact_id")] for f in facts]
    fine = [(i, "financial_fact", "verified") for i in ids]
    for checks, issue in ((fine[1:], "verification_missing"), ([*fine, fine[0]], "verification_duplicate"), ([(ids[0], "financial_fact", "conflict"), *fine[1:]], "verification_unconfirmed"), ([(ids[0], "calculation", "verified"), *fine[1:]], "verification_unconfirmed")):
        assert evaluated(spark, facts, checks)[0]["profit_without_cash"]["issues"] == [issue]
    assert evaluated(spark, facts, verdicts=[])[0]["inventory_ahead"]["issues"] == ["comparability_unverified"]
    rules, points = evaluated(spark, facts, mapped=())
    assert rules["share_of_one_off_profit"]["issues"] == ["semantic_mapping"] and points is None
    assert evaluated(spark, report(net_profit_parent=(0, 5)))[0]["share_of_one_off_profit"]["issues"] == ["nonpositive_denominator"]
    assert evaluated(spark, report(revenue=(5, 0)))[0]["receivables_ahead"]["issues"] == ["nonpositive_base"]
    rules, points = evaluated(spark, [])
    assert all(r["issues"] == ["comparability_unbound", "missing_fact"] for r in rules.values()) and points is None


def test_candidates(spark):
    rows = [("a", "p", "succeeded", 1, "x"), ("a", "c", "succeeded", -1, "x"), ("b", "p", "succeeded", 0, "x"), ("b", "c", "succeeded", -1, "x"), ("c", "p", "succeeded", 1, "x"), ("c", "c", "succeeded", -1, "y"), ("d", "p", "succeeded", 1, "x"), ("e", "p", "succeeded", 1, "x"), ("e", "p", "succeeded", 1, "x"), ("e", "c", "succeeded", -1, "x"), ("f", "p", "missing_fact", None, None), ("f", "c", "succeeded", -1, "x")]
    df = spark.createDataFrame([(r, m, s, v if v is None else Decimal(v), b) for r, m, s, v, b in rows], "report string, metric string, status string, difference decimal(20,2), basis string")
    got = {r["report"]: r["status"] for r in S.candidates(df, {"s": ("p", "c")}).collect()}
    assert got == {"a": "candidate", "b": "not_triggered"} | dict.fromkeys("cdef", "abstained")
