import datetime as dt
from decimal import Decimal

import pytest

from tallyframe.operators import identity_changes as I

SCHEMA = "report string, metric string, fact_id string, report_year int, role string, period_start date, period_end date, period_type string, frequency string, company string, document string, sha256 string, currency string, unit string, multiplier string, scope string, value decimal(20,2), restatement string"
NAMES = [c.split()[0] for c in SCHEMA.replace("decimal(20,2)", "d").split(", ")]


def fact(role="current", **other):
    year = 2024 if role == "current" else 2023
    base = dict(
        report="r", metric="revenue", fact_id=role, report_year=2024, role=role, period_start=dt.date(year, 1, 1), period_end=dt.date(year, 12, 31), period_type="duration", frequency="annual", company="c", document="d", sha256="s",
        currency="CNY", unit="yuan", multiplier="1", scope="consolidated", value=Decimal(150 if role == "current" else 100), restatement="unknown",
    )
    return tuple((base | other)[n] for n in NAMES)


def later(spark, facts, checks=None, verdicts=None):
    checks = [(r, "financial_fact", "verified") for r in ("current", "comparative")] if checks is None else checks
    verdicts = [("d", 2024, "verified", "not_restated")] if verdicts is None else verdicts
    out = I.later_changes(
        spark.createDataFrame([(*f, 1, "x") for f in facts], SCHEMA + ", n_cur int, status string").drop("status"),
        spark.createDataFrame(checks, "target_id string, target_type string, status string"),
        spark.createDataFrame(verdicts, "document string, report_year int, status string, restatement string"),
    )
    return {r["metric"]: r for r in out.collect()}


def test_later_path_succeeds(spark):
    r = later(spark, [fact(), fact("comparative")])["revenue"]
    assert (r["status"], r["reason"], r["difference"], r["rate_status"], r["rate"]) == ("succeeded", None, Decimal("50.00"), "succeeded", Decimal("0.50000000"))
    for base in (0, -4):
        r = later(spark, [fact(), fact("comparative", value=Decimal(base))])["revenue"]
        assert (r["status"], r["rate_status"], r["rate"], r["difference"]) == ("succeeded", "nonpositive_base", None, Decimal(150 - base))


PERIOD = dict(period_start=dt.date(2024, 2, 1))


@pytest.mark.parametrize(
    ("facts", "status", "reason"),
    [
        ([fact(), fact("comparative"), fact("comparative")], "duplicate_fact_id", None),
        ([fact(), fact("comparative"), fact("comparative", fact_id="second")], "duplicate_fact", None),
        ([fact()], "missing_fact", None),
        ([fact(), fact("comparative", period_end=None)], "missing_fact", None),
        ([fact(), fact("comparative", period_end=dt.date(2022, 12, 31))], "missing_fact", None),
        ([fact(), fact("current", fact_id="b", period_end=dt.date(2023, 12, 31))], "missing_fact", None),
        ([fact(period_type="instant"), fact("comparative", period_type="instant")], "incompatible_facts", "period_type"),
        ([fact(**PERIOD), fact("comparative")], "incompatible_facts", "natural_year"),
        ([fact(frequency=None), fact("comparative")], "incompatible_facts", "frequency"),
        ([fact(company="x", currency="USD"), fact("comparative")], "incompatible_facts", "company_id,currency"),
        ([fact(sha256=None), fact("comparative", sha256=None)], "incompatible_facts", "source_sha256"),
        ([fact(multiplier="1.0"), fact("comparative")], "succeeded", None),
        ([fact(multiplier="10"), fact("comparative", unit="x")], "incompatible_facts", "unit,unit_multiplier"),
        ([fact(scope="unknown"), fact("comparative", scope="unknown")], "incompatible_facts", "scope_unknown"),
        ([fact(restatement="restated"), fact("comparative")], "restatement_mismatch", None),
    ],
)
def test_later_path_gates(spark, facts, status, reason):
    r = later(spark, facts)["revenue"]
    assert (r["status"], r["reason"]) == (status, reason) and (r["difference"] is None) == (status != "succeeded")


def test_later_path_proofs(spark):
    pair = [fact(), fact("comparative")]
    one = [("current", "financial_fact", "verified")]
    both = [*one, ("comparative", "financial_fact", "verified")]
    for checks in ([], one, [*one, ("comparative", "financial_fact", "conflict")], [*both, one[0]], [*one, ("comparative", "calculation", "verified")]):
        assert later(spark, pair, checks)["revenue"]["status"] == "verification"
    for verdicts in ([], [("d", 2023, "verified", "not_restated")], [("d", 2024, "conflict", "unknown")], [("d", 2024, "verified", "not_restated")] * 2, [("x", 2024, "verified", "not_restated")]):
        assert later(spark, pair, both, verdicts)["revenue"]["status"] == "comparability"
    # a table without a scope of its own, beside a metric that has one
    got = later(spark, [fact(metric=I.WITHOUT_SCOPE, scope="unknown"), fact("comparative", metric=I.WITHOUT_SCOPE, scope="unknown"), fact(fact_id="z")], both)
    assert (got[I.WITHOUT_SCOPE]["status"], got["revenue"]["status"]) == ("succeeded", "missing_fact")
    assert later(spark, []) == {}


@pytest.mark.parametrize(
    ("change", "prior", "status", "mismatched"),
    [
        ({}, {}, "ok", None),
        ({"scope": "unknown"}, {"scope": "unknown"}, "ok", None),
        ({"document": "x", "period_type": "instant"}, {}, "incompatible_facts", "document_id,period_type"),
        ({"company": None}, {"company": None}, "incompatible_facts", "company_id"),
        ({"multiplier": "1.00"}, {}, "ok", None),
        ({"period_type": "instant"}, {"period_type": "instant"}, "period_type_not_annual", None),
        ({}, {"value": Decimal(0)}, "zero_prior", None),
        ({"period_end": None}, {}, "missing_current", None),
        ({}, {"period_end": dt.date(2020, 1, 1)}, "missing_prior", None),
        ({}, {"period_end": dt.date(2024, 12, 31)}, "duplicate_fact", None),
    ],
)
def test_earlier_path(spark, change, prior, status, mismatched):
    r = I.earlier_changes(spark.createDataFrame([fact(**change), fact("comparative", **prior)], SCHEMA)).first()
    assert (r["status"], r["mismatched"]) == (status, mismatched) and (r["rate"] is None) == (status != "ok")
