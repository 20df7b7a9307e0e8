"""Registered queries on annual changes with all gates, with the SQL each must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import identity_changes as I
from tallyframe.operators import screening
from tallyframe.plans.catalog import registered
from tallyframe.plans.facts import FACTS_SQL, facts

# What a fact of a report says of itself, by its entity e, metric m, report's year r, and whether it is the current one (k).
# Every entity has faults in some metrics, so that each gate is met.
COLUMNS = {
    "fact_id": "concat(e, '-', CASE WHEN e % 7 = 1 AND m = 'revenue' AND r = 1998 THEN 'x' ELSE m END, '-', r, '-', CASE WHEN k OR (e % 9 = 2 AND m = 'inventory_net') THEN 'c' ELSE 'p' END)",
    "report_year": "CASE WHEN e % 5 = 3 AND m = 'net_profit_ex' AND NOT k THEN r - 1 ELSE r END",
    "role": "CASE WHEN k THEN 'current' ELSE 'comparative' END",
    "period_start": "make_date(CASE WHEN k THEN r ELSE r - 1 END, CASE WHEN e % 8 = 1 AND m = 'cost_of_goods_sold' AND k THEN 4 ELSE 1 END, 1)",
    "period_end": "make_date(CASE WHEN k THEN r ELSE r - 1 END, 12, 31)",
    "period_type": "CASE WHEN e % 6 = 2 AND m = 'accounts_receivable_net' THEN 'instant' WHEN e % 6 = 3 AND m = 'accounts_receivable_net' AND k THEN 'instant' ELSE 'duration' END",
    "frequency": "CASE WHEN e % 10 = 7 AND m = 'operating_cash_flow' AND NOT k THEN 'quarterly' ELSE 'annual' END",
    "company": "CASE WHEN e % 11 = 4 AND m = 'revenue' AND k THEN 'other' ELSE concat('c', e) END",
    "document": "CASE WHEN e % 11 = 4 AND m = 'revenue' AND NOT k THEN NULL ELSE concat('d', e, '-', r) END",
    "sha256": "CASE WHEN e % 12 = 5 AND m = 'net_profit_parent' AND k THEN 'a' ELSE 'b' END",
    "unit": "CASE WHEN e % 12 = 6 AND m = 'net_profit_parent' AND k THEN 'thousand' ELSE 'yuan' END",
    "multiplier": "CASE WHEN e % 12 = 8 AND k THEN '1.0' WHEN e % 12 = 9 AND m = 'revenue' AND k THEN '10000' ELSE '1' END",
    "scope": "CASE WHEN e % 13 = 3 AND m IN ('revenue', 'non_recurring_total') THEN 'unknown' WHEN e % 13 = 4 AND m = 'revenue' AND k THEN 'parent' ELSE 'consolidated' END",
}
_CLAIMS = f"""claims AS (SELECT concat(e, '/', r) AS report, CASE WHEN m = 'net_profit_ex' AND e % 13 = 3 THEN 'non_recurring_total' ELSE m END AS metric, e, r, k, currency, restatement, verified, CASE WHEN e % 15 = 11 AND NOT k AND m = 'revenue' THEN 0 ELSE value END AS value, {", ".join(f"{x} AS {c}" for c, x in COLUMNS.items())}
  FROM (SELECT entity AS e, metric AS m, y AS r, true AS k, value, currency, restatement, verified FROM facts UNION ALL SELECT entity, metric, y + 1, false, value, currency, restatement, verified FROM facts))"""


def _claims(spark, sf_dir):
    """Every fact as the current one of its year's report and as the prior one of the next year's."""
    sides = F.explode(F.array(F.struct(F.col("y").alias("r"), F.lit(True).alias("k")), F.struct((F.col("y") + 1).alias("r"), F.lit(False).alias("k"))))
    rows = facts(spark, sf_dir).select(F.col("entity").alias("e"), F.col("metric").alias("m"), "value", "currency", "restatement", "verified", sides.alias("s")).select("*", "s.r", "s.k").drop("s")
    rows = rows.withColumns({c: F.expr(x) for c, x in COLUMNS.items()}).withColumn("value", F.expr("CASE WHEN e % 15 = 11 AND NOT k AND m = 'revenue' THEN 0 ELSE value END").cast("decimal(20,2)"))
    metric = F.expr("CASE WHEN m = 'net_profit_ex' AND e % 13 = 3 THEN 'non_recurring_total' ELSE m END")
    return rows.withColumn("report", F.concat_ws("/", "e", "r")).withColumn("metric", metric)


_TWO = "max({c}) FILTER (k) AS {c}_c, max({c}) FILTER (NOT k) AS {c}_p"
_SAME = {"document_id": "document", "source_sha256": "sha256", "company_id": "company", "currency": "currency", "unit_multiplier": "CAST(multiplier{s} AS DOUBLE)", "statement_scope": "scope", "period_type": "period_type"}


def _differ(names: dict[str, str]) -> str:
    side = lambda x, s: x.replace("{s}", s) if "{s}" in x else f"{x}{s}"
    return "array_to_string([x FOR x IN [" + ", ".join(f"CASE WHEN coalesce({side(x, '_c')} <> {side(x, '_p')}, true) THEN '{n}' END" for n, x in names.items()) + "] IF x IS NOT NULL], ',')"


_PAIRED = f"""p AS (SELECT report, metric, count(*) FILTER (k) AS n_c, count(*) FILTER (NOT k) AS n_p, {", ".join(_TWO.format(c=c) for c in ("document", "sha256", "company", "currency", "multiplier", "scope", "unit", "period_type", "frequency", "period_start", "value", "restatement"))}
  FROM claims WHERE year(period_end) = CASE WHEN k THEN report_year ELSE report_year - 1 END GROUP BY 1, 2)"""


@registered(f"""WITH {FACTS_SQL}, {_CLAIMS},
q AS (SELECT * REPLACE (CASE WHEN year(period_end) = report_year THEN true ELSE false END AS k) FROM claims WHERE year(period_end) IN (report_year, report_year - 1)),
{_PAIRED.replace("FROM claims WHERE year(period_end) = CASE WHEN k THEN report_year ELSE report_year - 1 END", "FROM q")},
s AS (SELECT *, {_differ(_SAME)} AS differ FROM p), t AS (SELECT *, CASE WHEN n_c > 1 OR n_p > 1 THEN 'duplicate_fact' WHEN n_c = 0 THEN 'missing_current' WHEN n_p = 0 THEN 'missing_prior' WHEN differ <> '' THEN 'incompatible_facts' WHEN period_type_c <> 'duration' THEN 'period_type_not_annual' WHEN value_p = 0 THEN 'zero_prior' ELSE 'ok' END AS status FROM s)
SELECT report, metric, status, CASE WHEN status = 'incompatible_facts' THEN differ END AS mismatched, CASE WHEN status = 'ok' THEN CAST(value_c - value_p AS DECIMAL(20,2)) END AS difference, CAST(round(CASE WHEN status = 'ok' THEN CAST(value_c - value_p AS DOUBLE) / CAST(value_p AS DOUBLE) END, 8) AS DECIMAL(20,8)) AS rate FROM t""")
def earlier_changes(spark, sf_dir):
    """Changes of the earlier path with seven shared columns and annual periods."""
    return I.earlier_changes(_claims(spark, sf_dir))


_LATER = {"company_id": "company", "source_document_id": "document", "source_sha256": "sha256", "currency": "currency", "scope": "scope", "unit": "unit", "unit_multiplier": "CAST(multiplier{s} AS DOUBLE)"}


_LATER_SQL = f"""WITH {FACTS_SQL}, {_CLAIMS},
n AS (SELECT report AS of_report, fact_id AS of_id, count(*) AS same FROM claims GROUP BY 1, 2),
w AS (SELECT claims.*, same > 1 AS again FROM claims JOIN n ON of_report = report AND of_id = fact_id),
{_PAIRED.replace("FROM claims WHERE", "FROM w WHERE NOT again AND")},
v AS (SELECT report, metric, bool_or(again) AS blocked, bool_and(CASE WHEN e % 16 = 12 AND metric = 'revenue' THEN false ELSE verified END) FILTER (NOT again AND year(period_end) = CASE WHEN k THEN report_year ELSE report_year - 1 END) AS verified, any_value(e) AS e, any_value(r) AS r FROM w GROUP BY 1, 2),
s AS (SELECT v.*, p.* EXCLUDE (report, metric), {_differ(_LATER)} AS differ FROM v LEFT JOIN p ON p.report = v.report AND p.metric = v.metric),
t AS (SELECT *, CASE WHEN period_type_c <> 'duration' OR period_type_p <> 'duration' THEN 'period_type' WHEN month(period_start_c) <> 1 THEN 'natural_year' WHEN frequency_p <> 'annual' THEN 'frequency' WHEN differ <> '' THEN differ WHEN scope_c = 'unknown' AND metric <> 'non_recurring_total' THEN 'scope_unknown' END AS reason FROM s),
u AS (SELECT *, CASE WHEN blocked THEN 'duplicate_fact_id' WHEN coalesce(n_c, 0) = 0 OR coalesce(n_p, 0) = 0 THEN 'missing_fact' WHEN n_c > 1 OR n_p > 1 THEN 'duplicate_fact' WHEN reason IS NOT NULL THEN 'incompatible_facts' WHEN NOT verified THEN 'verification' WHEN e % 4 = 2 AND r % 2 = 0 THEN 'comparability' WHEN restatement_c = 'restated' OR restatement_p = 'restated' THEN 'restatement_mismatch' ELSE 'succeeded' END AS status FROM t)"""


@registered(_LATER_SQL + """ SELECT report, metric, status, CASE WHEN status = 'incompatible_facts' THEN reason END AS reason, CASE WHEN status = 'succeeded' THEN CAST(value_c - value_p AS DECIMAL(20,2)) END AS difference, CASE WHEN status = 'succeeded' AND value_p <= 0 THEN 'nonpositive_base' ELSE status END AS rate_status,
  CAST(round(CASE WHEN status = 'succeeded' AND value_p > 0 THEN CAST(value_c - value_p AS DOUBLE) / CAST(value_p AS DOUBLE) END, 8) AS DECIMAL(20,8)) AS rate FROM u""")
def later_changes(spark, sf_dir):
    """Changes of the later path: ids, roles, periods, identity, verification, comparability and restatement."""
    return _later(spark, sf_dir).drop("basis")


def _later(spark, sf_dir):
    claims = _claims(spark, sf_dir)
    checked = claims.select(F.col("fact_id").alias("target_id"), F.lit("financial_fact").alias("target_type"), F.when(F.col("verified"), "verified").otherwise("conflict").alias("status"), "e", "metric")
    # facts of some entities have no verification, or a second one; claims are verified once for each fact id
    checked = checked.groupBy("target_id", "target_type").agg(F.min("status").alias("status"), F.min("e").alias("e"), F.min("metric").alias("metric"))
    second = checked.filter("e % 16 = 12 AND metric = 'revenue'").withColumn("status", F.lit("verified"))
    other = checked.withColumn("target_type", F.lit("calculation")).withColumn("status", F.lit("conflict"))
    verdicts = claims.select("document", F.col("r").alias("report_year"), "e").filter("document IS NOT NULL").distinct()
    verdicts = verdicts.select("document", "report_year", F.expr("CASE WHEN e % 4 = 2 AND report_year % 2 = 0 THEN 'conflict' ELSE 'verified' END").alias("status"), F.lit("not_restated").alias("restatement"))
    return I.later_changes(claims, checked.unionByName(second).unionByName(other), verdicts)


PAIRS = {"profit_up_cash_down": ("net_profit_parent", "operating_cash_flow"), "revenue_up_cash_down": ("revenue", "operating_cash_flow")}


@registered(_LATER_SQL + """,
k AS (SELECT *, concat_ws('|', company_c, document_c, sha256_c, currency_c, unit_c, scope_c, CAST(CAST(multiplier_c AS DOUBLE) AS VARCHAR)) AS basis, value_c - value_p AS d FROM u WHERE metric IN ('net_profit_parent', 'revenue', 'operating_cash_flow')),
sg AS (SELECT DISTINCT report, signal, up FROM u, (VALUES ('profit_up_cash_down', 'net_profit_parent'), ('revenue_up_cash_down', 'revenue')) t(signal, up))
SELECT sg.report, signal, CASE WHEN a.status = 'succeeded' AND b.status = 'succeeded' AND a.basis = b.basis THEN CASE WHEN a.d > 0 AND b.d < 0 THEN 'candidate' ELSE 'not_triggered' END ELSE 'abstained' END AS status
FROM sg LEFT JOIN k a ON a.report = sg.report AND a.metric = up LEFT JOIN k b ON b.report = sg.report AND b.metric = 'operating_cash_flow'""")
def signal_candidates(spark, sf_dir):
    """Profit or revenue up while cash is down, of confirmed differences on one basis."""
    return screening.candidates(_later(spark, sf_dir), PAIRS)
