"""Registered queries on screening rules with their reasons, with the SQL each must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import screening as S
from tallyframe.plans.catalog import registered
from tallyframe.plans.change_catalog import _CLAIMS, _claims
from tallyframe.plans.facts import FACTS_SQL

# Stocks are of one day, profits without one-off items of no scope; some facts keep faults of their own.
_STOCK = "metric IN ('accounts_receivable_net', 'inventory_net')"
_FIXED = {
    "metric": "CASE WHEN metric IN ('net_profit_ex', 'non_recurring_total') THEN 'net_profit_parent_ex_nonrecurring' ELSE metric END",
    "period_type": f"CASE WHEN {_STOCK} AND e % 6 <> 4 THEN 'instant' WHEN {_STOCK} THEN 'duration' ELSE period_type END",
    "period_start": f"CASE WHEN {_STOCK} AND e % 6 <> 4 THEN NULL ELSE period_start END",
    "scope": "CASE WHEN metric IN ('net_profit_ex', 'non_recurring_total') THEN 'unknown' ELSE scope END",
    "role": "CASE WHEN e % 14 = 9 AND metric = 'cost_of_goods_sold' AND NOT k THEN 'other' ELSE role END",
    "currency": "CASE WHEN e % 14 = 10 AND metric = 'operating_cash_flow' THEN '未披露' ELSE currency END",
}
_PLAIN = ("report", "e", "r", "k", "fact_id", "report_year", "period_end", "frequency", "company", "document", "sha256", "unit", "multiplier", "value", "restatement", "verified")
_NEEDS = [(rule, i, m, p, s, role) for rule, wants in S.NEEDS.items() for i, (m, p, s, roles) in enumerate(wants) for role in roles]


def _facts(spark, sf_dir):
    one = _claims(spark, sf_dir)
    rows = one.select(*_PLAIN, *(F.expr(x).alias(c) for c, x in _FIXED.items()))
    whole = rows.filter("metric = 'net_profit_parent'").withColumn("metric", F.lit("net_profit_consolidated")).withColumn("fact_id", F.concat(F.lit("n"), "fact_id"))
    return rows.unionByName(whole)


_VALUE = "max(value) FILTER (place = {i} AND role = '{r}')"
_SQL = f"""WITH {FACTS_SQL}, {_CLAIMS},
one AS (SELECT {", ".join(_PLAIN)}, {", ".join(f"{x} AS {c}" for c, x in _FIXED.items())} FROM claims),
f AS (SELECT * FROM one UNION ALL SELECT * REPLACE ('n' || fact_id AS fact_id, 'net_profit_consolidated' AS metric) FROM one WHERE metric = 'net_profit_parent'),
g AS (SELECT *, count(*) OVER (PARTITION BY report, fact_id) > 1 AS again, count(*) OVER (PARTITION BY report, metric, role) AS n, bool_and(verified) OVER (PARTITION BY fact_id) AS fine, bool_or(role = 'other') OVER (PARTITION BY report, metric) AS odd FROM f),
h AS (SELECT *, bool_or(again) OVER (PARTITION BY report, metric) AS repeated FROM g),
w AS (SELECT * FROM (SELECT DISTINCT report, r AS year, e AS of_e FROM claims) CROSS JOIN (VALUES {", ".join(str(x) for x in _NEEDS)}) t(rule, place, metric, need_period, need_scope, role)),
j AS (SELECT w.*, m.odd AS m_odd, m.repeated AS m_repeated, h.n, h.fact_id, h.report_year, h.period_start, h.period_end, h.period_type, h.frequency, h.scope, h.restatement, h.currency, h.unit, h.company, h.document, h.sha256, h.multiplier, h.value, h.fine FROM w LEFT JOIN (SELECT DISTINCT report, metric, odd, repeated FROM h) m USING (report, metric)
  LEFT JOIN (SELECT DISTINCT ON (report, metric, role) * FROM h) h ON h.report = w.report AND h.metric = w.metric AND h.role = w.role),
i AS (SELECT report, rule, unnest([CASE WHEN n IS NULL THEN 'missing_fact' WHEN n > 1 THEN 'duplicate_fact' END, CASE WHEN m_odd THEN 'unknown_comparison_role' END, CASE WHEN m_repeated THEN 'duplicate_fact_id' END, CASE WHEN n = 1 AND report_year <> year THEN 'report_year_mismatch' END,
  CASE WHEN n = 1 AND (period_type <> need_period OR frequency <> 'annual') THEN 'period_type_mismatch' END, CASE WHEN n = 1 AND CASE need_period WHEN 'duration' THEN coalesce(month(period_start) <> 1, true) ELSE period_start IS NOT NULL END THEN 'period_start_mismatch' END, CASE WHEN n = 1 AND scope <> need_scope THEN 'scope_mismatch' END,
  CASE WHEN n = 1 AND restatement = 'restated' THEN 'restatement_conflict' END, CASE WHEN n = 1 AND currency = '未披露' THEN 'currency_missing' END, CASE WHEN n = 1 AND NOT fine THEN 'verification_unconfirmed' END]) AS issue FROM j),
b AS (SELECT report, rule, any_value(year) AS year, any_value(of_e) AS e, count(*) FILTER (n = 1) AS n, min(document) FILTER (n = 1) AS document, {", ".join(_VALUE.format(i=i, r=r) + f" FILTER (n = 1) AS {t}{i}".replace(" FILTER (n = 1)", "") for i in (0, 1) for r, t in (("current", "c"), ("comparative", "p")))},
  count(*) FILTER (n = 1) > 1 AND ({" OR ".join(f"count(DISTINCT {c}) FILTER (n = 1) <> 1 OR count({c}) FILTER (n = 1) < count(*) FILTER (n = 1)" for c in ("company", "document", "sha256", "currency", "unit", "CAST(multiplier AS DOUBLE)"))}) AS mixed FROM (SELECT * REPLACE (CASE WHEN n = 1 THEN value END AS value) FROM j) GROUP BY 1, 2),
x AS (SELECT report, rule, issue FROM i WHERE issue IS NOT NULL UNION SELECT report, rule, 'basis_mismatch' FROM b WHERE mixed UNION SELECT report, rule, 'comparability_unbound' FROM b WHERE n = 0 UNION SELECT report, rule, 'comparability_unverified' FROM b WHERE n > 0 AND (document IS NULL OR (e % 4 = 2 AND year % 2 = 0)) UNION SELECT report, rule, 'semantic_mapping' FROM b WHERE rule = 'share_of_one_off_profit' AND e % 9 = 0),
y AS (SELECT report, rule, string_agg(issue, ',' ORDER BY issue) AS issues FROM x GROUP BY 1, 2),
z AS (SELECT b.*, coalesce(issues, CASE WHEN rule = 'share_of_one_off_profit' THEN CASE WHEN c0 <= 0 THEN 'nonpositive_denominator' END WHEN rule <> 'profit_without_cash' THEN CASE WHEN p0 <= 0 OR p1 <= 0 THEN 'nonpositive_base' END END, '') AS issues FROM b LEFT JOIN y USING (report, rule)),
t AS (SELECT report, rule, issues, CASE WHEN issues = '' THEN CASE rule WHEN 'profit_without_cash' THEN c0 > 0 AND c1 < 0 WHEN 'share_of_one_off_profit' THEN 10 * abs(c0 - c1) >= 3 * c0 ELSE CAST(5 * (c0 - p0) AS DECIMAL(19,2)) * CAST(p1 AS DECIMAL(19,2)) - CAST(5 * (c1 - p1) AS DECIMAL(19,2)) * CAST(p0 AS DECIMAL(19,2)) >= CAST(p0 AS DECIMAL(19,2)) * CAST(p1 AS DECIMAL(19,2)) END END AS triggered FROM z)
"""


def _rules(spark, sf_dir):
    rows = _facts(spark, sf_dir)
    checks = rows.groupBy(F.col("fact_id").alias("target_id")).agg(F.bool_and("verified").alias("v")).select("target_id", F.lit("financial_fact").alias("target_type"), F.when(F.col("v"), "verified").otherwise("conflict").alias("status"))
    reports = rows.select("report", F.col("r").cast("int").alias("report_year"), "e").distinct()
    verdicts = rows.filter("document IS NOT NULL").select("document", F.col("r").cast("int").alias("report_year"), "e").distinct()
    verdicts = verdicts.select("document", "report_year", F.expr("CASE WHEN e % 4 = 2 AND report_year % 2 = 0 THEN 'conflict' ELSE 'verified' END").alias("status"), F.lit("not_restated").alias("restatement"))
    return S.four_rules(rows, checks, verdicts, reports.drop("e"), reports.filter("e % 9 <> 0").select("report"))


@registered(_SQL + "SELECT report, rule, CASE WHEN issues = '' THEN 'calculable' ELSE 'abstained' END AS status, triggered, CASE WHEN triggered THEN 25 WHEN NOT triggered THEN 0 END AS points, issues FROM t")
def screening_rules(spark, sf_dir):
    """Every rule of every report, with all reasons where it abstains; the first rule reads the current year alone."""
    return _rules(spark, sf_dir).withColumn("issues", F.array_join("issues", ","))


@registered(_SQL + "SELECT report, CASE WHEN count(triggered) = 4 THEN CAST(sum(CASE WHEN triggered THEN 25 ELSE 0 END) AS INTEGER) END AS total FROM t GROUP BY 1")
def screening_total(spark, sf_dir):
    return S.total_score(_rules(spark, sf_dir))
