"""Annual changes with every gate: identity of both facts, periods, verification, comparability, restatement.

Facts meet by report and metric in one grouping with a side for each year; verifications are counted by fact before they
join, and comparability joins by document and year. No fact is joined with another.

Facts have report (the key of a report), metric, fact_id, report_year, role (current or comparative), period_start,
period_end, period_type, frequency, company, document, sha256, currency, unit, multiplier (text), scope, value, restatement.

Defined cases: null identities differ from each other and from everything, as nothing is known of them; a null period end is
in no year; equal fact ids within a report block each other; a metric with facts of one side only stays one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns that both years' facts must share, on the earlier and on the later path, by the name they are told.
EARLIER = {"document_id": "document", "source_sha256": "sha256", "company_id": "company", "currency": "currency", "unit_multiplier": "multiplier", "statement_scope": "scope", "period_type": "period_type"}
LATER = {"company_id": "company", "source_document_id": "document", "source_sha256": "sha256", "currency": "currency", "scope": "scope", "unit": "unit", "unit_multiplier": "multiplier"}
#: A metric whose table names no scope, so that an unknown one is no fault.
WITHOUT_SCOPE = "non_recurring_total"
FIELDS = ("fact_id", "report_year", "role", "period_start", "period_end", "period_type", "frequency", "company", "document", "sha256", "currency", "unit", "multiplier", "scope", "value", "restatement")


def sides(facts: DataFrame, is_current: Column, is_prior: Column) -> DataFrame:
    """One row a report and metric: n_cur and n_pri, and cur and pri, one fact of each side (the only one, where it is)."""
    rows = facts.withColumn("_side", F.when(is_current, "cur").when(is_prior, "pri")).filter("_side IS NOT NULL")
    fact = F.struct(*FIELDS)
    one = [x for s in ("cur", "pri") for x in (F.count_if(F.col("_side") == s).alias(f"n_{s}"), F.max(F.when(F.col("_side") == s, fact)).alias(s))]
    return rows.groupBy("report", "metric").agg(*one)


def mismatches(names: dict[str, str]) -> Column:
    """The names of columns in which both sides differ, in order; multipliers are compared as numbers."""
    number = lambda c: c.try_cast("decimal(38,10)")

    def differs(column: str) -> Column:
        a, b = F.col(f"cur.{column}"), F.col(f"pri.{column}")
        a, b = (number(a), number(b)) if column == "multiplier" else (a, b)
        return ~F.coalesce(a == b, F.lit(False))

    return F.array_compact(F.array(*(F.when(differs(c), n) for n, c in names.items())))


def earlier_changes(facts: DataFrame) -> DataFrame:
    """report, metric, status, mismatched, difference and rate by the earlier path: facts of the report's year against those
    of the year before, seven shared columns, annual periods, and no rate or difference on a prior value of zero."""
    year = F.year("period_end")
    rows = sides(facts, year == F.col("report_year"), year == F.col("report_year") - 1)
    rows = rows.withColumn("mismatched", F.array_join(mismatches(EARLIER), ","))
    status = (
        F.when((F.col("n_cur") > 1) | (F.col("n_pri") > 1), "duplicate_fact")
        .when(F.col("n_cur") == 0, "missing_current")
        .when(F.col("n_pri") == 0, "missing_prior")
        .when(F.col("mismatched") != "", "incompatible_facts")
        .when(~F.col("cur.period_type").eqNullSafe("duration"), "period_type_not_annual")
        .when(F.col("pri.value") == 0, "zero_prior")
        .otherwise("ok")
    )
    rows = rows.withColumn("status", status)
    difference = (F.col("cur.value") - F.col("pri.value")).cast("decimal(20,2)")
    ok = F.col("status") == "ok"
    rate = F.try_divide(difference, F.col("pri.value")).cast("decimal(20,8)")
    told = F.when(F.col("status") == "incompatible_facts", F.col("mismatched"))
    return rows.select("report", "metric", "status", told.alias("mismatched"), F.when(ok, difference).alias("difference"), F.when(ok, rate).alias("rate"))


def _natural(side: str) -> Column:
    start, end = F.col(f"{side}.period_start"), F.col(f"{side}.period_end")
    return F.coalesce((start == F.make_date(F.year(end), F.lit(1), F.lit(1))) & (end == F.make_date(F.year(end), F.lit(12), F.lit(31))), F.lit(False))


def incompatible(names: dict[str, str] = LATER) -> Column:
    """The first reason why the only fact of each side cannot be compared, or null: kind of period, report's year, a whole
    natural year, frequency, shared columns (told by name), and a known scope."""
    both = lambda column, value: F.coalesce((F.col(f"cur.{column}") == value) & (F.col(f"pri.{column}") == value), F.lit(False))
    differ = mismatches(names)
    scope = F.coalesce(F.col("cur.scope"), F.lit("unknown"))
    return F.coalesce(
        F.when(~both("period_type", "duration"), "period_type"),
        F.when(~F.coalesce(F.col("cur.report_year") == F.col("pri.report_year"), F.lit(False)), "report_year"),
        F.when(~(_natural("cur") & _natural("pri")), "natural_year"),
        F.when(~both("frequency", "annual"), "frequency"),
        F.when(F.size(differ) > 0, F.array_join(differ, ",")),
        F.when((scope == "unknown") & (F.col("metric") != WITHOUT_SCOPE), "scope_unknown"),
    )


def later_changes(facts: DataFrame, verifications: DataFrame, comparability: DataFrame) -> DataFrame:
    """report, metric, status, reason (of incompatible facts), difference, rate_status, rate and basis (what another metric's
    pair must share for both to be compared) by the later path.

    verifications: target_id, target_type, status; a fact needs exactly one of type financial_fact, and it verified.
    comparability: document, report_year, status, restatement; the pair needs one verified as not restated."""
    counted = facts.groupBy("report", "fact_id").agg(F.count("*").alias("_n"))
    repeated = counted.filter("_n > 1").select("report", "fact_id", F.lit(True).alias("_repeated"))
    checks = verifications.filter("target_type = 'financial_fact'").groupBy(F.col("target_id").alias("fact_id")).agg(F.count("*").alias("_checks"), F.max("status").alias("_check"))
    marked = facts.join(repeated, ["report", "fact_id"], "left").join(checks, "fact_id", "left")
    marked = marked.withColumn("_verified", F.coalesce((F.col("_checks") == 1) & (F.col("_check") == "verified"), F.lit(False)))
    year = F.year("period_end")
    current = (F.col("role") == "current") & (year == F.col("report_year"))
    prior = (F.col("role") == "comparative") & (year == F.col("report_year") - 1)
    free = F.col("_repeated").isNull()
    blocked = marked.groupBy("report", "metric").agg(F.bool_or(~free).alias("blocked"), F.bool_and(F.when(free & (current | prior), F.col("_verified"))).alias("verified"))
    rows = blocked.join(sides(marked.filter(free), current, prior), ["report", "metric"], "left")
    verdicts = comparability.groupBy(F.col("document").alias("_document"), F.col("report_year").alias("_year")).agg(F.count("*").alias("_verdicts"), F.bool_and(F.expr("status = 'verified' AND restatement = 'not_restated'")).alias("_fine"))
    rows = rows.join(verdicts, (F.col("cur.document") == F.col("_document")) & (F.col("cur.report_year") == F.col("_year")), "left")
    none = lambda n: F.coalesce(F.col(n), F.lit(0)) == 0
    rows = rows.withColumn("reason", incompatible())
    restated = F.lit(False)
    for s in ("cur", "pri"):
        restated = restated | F.coalesce(F.col(f"{s}.restatement") == "restated", F.lit(False))
    status = (
        F.when(F.col("blocked"), "duplicate_fact_id")
        .when(none("n_cur") | none("n_pri"), "missing_fact")
        .when((F.col("n_cur") > 1) | (F.col("n_pri") > 1), "duplicate_fact")
        .when(F.col("reason").isNotNull(), "incompatible_facts")
        .when(~F.coalesce(F.col("verified"), F.lit(False)), "verification")
        .when(~F.coalesce((F.col("_verdicts") == 1) & F.col("_fine"), F.lit(False)), "comparability")
        .when(restated, "restatement_mismatch")
        .otherwise("succeeded")
    )
    rows = rows.withColumn("status", status)
    done = F.col("status") == "succeeded"
    difference = (F.col("cur.value") - F.col("pri.value")).cast("decimal(20,2)")
    base = F.col("pri.value") > 0
    basis = F.concat_ws("|", *(F.col(f"cur.{c}") for c in ("company", "document", "sha256", "currency", "unit", "scope")), F.col("cur.multiplier").try_cast("decimal(38,10)").cast("string"))
    return rows.select(
        "report", "metric", "status", F.when(F.col("status") == "incompatible_facts", F.col("reason")).alias("reason"), F.when(done, difference).alias("difference"),
        F.when(done & ~base, "nonpositive_base").otherwise(F.col("status")).alias("rate_status"), F.when(done & base, F.try_divide(difference, F.col("pri.value")).cast("decimal(20,8)")).alias("rate"),
        F.when(done, basis).alias("basis"),
    )
