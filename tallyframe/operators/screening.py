"""Four screening rules with the reasons why one abstains, and candidates from differences.

What a rule needs is a small table of facts by metric and role. Facts are counted by report, metric and role first; the
needs of all reports then meet these counts in one join, and a rule's facts come together in one grouping. Thresholds are
compared by cross-multiplication, so boundary cases are exact.

Defined cases: a report without a needed fact lists it as missing and abstains; several reasons are all told, once each and
in order of their names; nulls in identity columns differ from everything; a null currency or unit is missing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.identity_changes import FIELDS

# Facts that each rule needs, with the kind of period and the scope they must have; thresholds; points.
NEEDS = {
    "profit_without_cash": (("net_profit_consolidated", "duration", "consolidated", ("current",)), ("operating_cash_flow", "duration", "consolidated", ("current",))),
    "share_of_one_off_profit": (("net_profit_parent", "duration", "consolidated", ("current", "comparative")), ("net_profit_parent_ex_nonrecurring", "duration", "unknown", ("current", "comparative"))),
    "receivables_ahead": (("accounts_receivable_net", "instant", "consolidated", ("current", "comparative")), ("revenue", "duration", "consolidated", ("current", "comparative"))),
    "inventory_ahead": (("inventory_net", "instant", "consolidated", ("current", "comparative")), ("cost_of_goods_sold", "duration", "consolidated", ("current", "comparative"))),
}
SHARE_AT_LEAST, GAP_AT_LEAST, POINTS = "0.30", "0.20", 25
UNDISCLOSED = ("未披露", "未知", "unknown", "undisclosed")
BASIS = ("company", "document", "sha256", "currency", "unit", "multiplier")


def _fact_issues(fact: Column, role: Column, period_type: Column, scope: Column, year: Column) -> list[Column]:
    at = lambda c: fact[c]
    own = year - (role == "comparative").cast("int")
    wrong = lambda c: ~F.coalesce(c, F.lit(False))
    start = F.when(period_type == "duration", at("period_start") == F.make_date(own, F.lit(1), F.lit(1))).otherwise(at("period_start").isNull())
    told = lambda c: F.coalesce(F.trim(at(c)), F.lit(""))
    return [
        F.when(wrong(at("report_year") == year), "report_year_mismatch"),
        F.when(wrong(at("period_end") == F.make_date(own, F.lit(12), F.lit(31))), "period_role_mismatch"),
        F.when(wrong((at("period_type") == period_type) & (at("frequency") == "annual")), "period_type_mismatch"),
        F.when(wrong(start), "period_start_mismatch"),
        F.when(wrong(at("scope") == scope), "scope_mismatch"),
        F.when(F.coalesce(at("restatement") == "restated", F.lit(False)), "restatement_conflict"),
        F.when(told("unit") == "", "unit_missing"),
        F.when((told("currency") == "") | F.lower(told("currency")).isin(*UNDISCLOSED), "currency_missing"),
    ]


def needed(facts: DataFrame, verifications: DataFrame, reports: DataFrame) -> DataFrame:
    """A row for every fact that a rule of a report needs: report, report_year, rule, place (0 or 1), role, fact and issues.
    reports: report, report_year. verifications: target_id, target_type, status."""
    counted = facts.groupBy("report", "fact_id").agg((F.count("*") > 1).alias("_again"))
    checks = verifications.groupBy(F.col("target_id").alias("fact_id")).agg(F.count("*").alias("_checks"), F.bool_and(F.expr("target_type = 'financial_fact' AND status = 'verified'")).alias("_fine"))
    marked = facts.join(counted, ["report", "fact_id"]).join(checks, "fact_id", "left")
    check = F.when(F.col("_checks").isNull(), "verification_missing").when(F.col("_checks") > 1, "verification_duplicate").when(~F.coalesce("_fine", F.lit(False)), "verification_unconfirmed")
    held = marked.groupBy("report", "metric", "role").agg(F.count("*").alias("n"), F.max(F.struct(*FIELDS)).alias("fact"), F.max(check).alias("check"), F.bool_or("_again").alias("again"))
    # roles that no rule knows, and repeated ids, are told wherever the metric is needed
    odd = marked.groupBy("report", "metric").agg(F.bool_or(~F.coalesce(F.col("role").isin("current", "comparative"), F.lit(False))).alias("odd"), F.bool_or("_again").alias("repeated"))
    rows = [(rule, i, m, p, s, role) for rule, wants in NEEDS.items() for i, (m, p, s, roles) in enumerate(wants) for role in roles]
    names = ("rule", "place", "metric", "period_type", "scope", "role")
    table = F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, r, strict=True))) for r in rows)))
    wanted = reports.select("report", "report_year", table.alias("w")).select("report", "report_year", "w.*")
    df = wanted.join(held, ["report", "metric", "role"], "left").join(odd, ["report", "metric"], "left")
    one = F.col("n") == 1
    issues = [F.when(F.col("n").isNull(), "missing_fact").when(F.col("n") > 1, "duplicate_fact"), F.when(F.col("odd"), "unknown_comparison_role"), F.when(F.col("repeated"), "duplicate_fact_id")]
    issues += [F.when(one, c) for c in (*_fact_issues(F.col("fact"), F.col("role"), F.col("period_type"), F.col("scope"), F.col("report_year")), F.col("check"))]
    return df.select("report", "report_year", "rule", "place", "role", F.when(one, F.col("fact")).alias("fact"), F.array_compact(F.array(*issues)).alias("issues"))


def four_rules(facts: DataFrame, verifications: DataFrame, comparability: DataFrame, reports: DataFrame, mapped: DataFrame) -> DataFrame:
    """report, rule, status (calculable or abstained), triggered, points and issues of every rule of every report.
    comparability: document, report_year, status, restatement. mapped: reports whose two profits are shown to be of one
    source, which the second rule asks for."""
    df = needed(facts, verifications, reports)
    value = lambda place, role: F.max(F.when((F.col("place") == place) & (F.col("role") == role), F.col("fact.value")))
    number = lambda c: F.col(f"fact.{c}").try_cast("decimal(38,10)") if c == "multiplier" else F.col(f"fact.{c}")
    present = F.col("fact").isNotNull()
    mixed = reduce(Column.__or__, ((F.min(number(c)) != F.max(number(c))) | (F.count(number(c)) < F.count_if(present)) for c in BASIS))
    rules = df.groupBy("report", "report_year", "rule").agg(
        F.array_distinct(F.flatten(F.collect_list("issues"))).alias("issues"),
        F.count_if(present).alias("n"),
        F.when(F.count_if(present) > 1, F.coalesce(mixed, F.lit(True))).otherwise(False).alias("mixed"),
        F.min("fact.document").alias("document"),
        *(value(i, r).alias(f"{t}{i}") for i in (0, 1) for r, t in (("current", "c"), ("comparative", "p"))),
    )
    verdicts = comparability.groupBy("document", "report_year").agg((F.count("*") == 1).alias("_one"), F.bool_and(F.expr("status = 'verified' AND restatement = 'not_restated'")).alias("_fine"))
    rules = rules.join(verdicts, ["document", "report_year"], "left").join(mapped.select("report", F.lit(True).alias("_mapped")).distinct(), "report", "left")
    further = [
        F.when(F.col("mixed"), "basis_mismatch"),
        F.when(F.col("n") == 0, "comparability_unbound").when(~F.coalesce(F.col("_one") & F.col("_fine"), F.lit(False)), "comparability_unverified"),
        F.when((F.col("rule") == "share_of_one_off_profit") & F.col("_mapped").isNull(), "semantic_mapping"),
    ]
    rules = rules.withColumn("issues", F.concat("issues", F.array_compact(F.array(*further))))
    a, b, a0, b0 = (F.col(c).cast("decimal(17,2)") for c in ("c0", "c1", "p0", "p1"))
    share = F.abs(a - b) >= F.lit(SHARE_AT_LEAST).cast("decimal(3,2)") * a
    gap = ((a - a0).cast("decimal(18,2)") * b0 - (b - b0).cast("decimal(18,2)") * a0) >= F.lit(GAP_AT_LEAST).cast("decimal(3,2)") * (a0 * b0).cast("decimal(34,4)")
    first, second = F.col("rule") == "profit_without_cash", F.col("rule") == "share_of_one_off_profit"
    base = F.when(second & (a <= 0), "nonpositive_denominator").when(~first & ~second & ((a0 <= 0) | (b0 <= 0)), "nonpositive_base")
    clean = F.size("issues") == 0
    rules = rules.withColumn("issues", F.when(clean & base.isNotNull(), F.array(base)).otherwise(F.array_sort(F.array_distinct("issues"))))
    hit = F.when(first, (a > 0) & (b < 0)).when(second, share).otherwise(gap)
    done = F.size("issues") == 0
    rules = rules.withColumn("triggered", F.when(done, hit))
    return rules.select("report", "rule", F.when(done, "calculable").otherwise("abstained").alias("status"), "triggered", F.when(F.col("triggered"), POINTS).when(~F.col("triggered"), 0).alias("points"), "issues")


def total_score(rules: DataFrame) -> DataFrame:
    """report and total: the points of all four rules, or null where one of them abstains."""
    whole = (F.count("*") == len(NEEDS)) & (F.count("points") == len(NEEDS))
    return rules.groupBy("report").agg(F.when(whole, F.sum("points")).cast("int").alias("total"))


def candidates(differences: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """report, signal, status (candidate, not_triggered, abstained) of each pair of metrics: the first one's difference is
    above 0 and the second one's below. differences: report, metric, status, difference, basis (what both metrics must
    share); a metric must have exactly one difference in a report, and it succeeded."""
    sides = F.explode(F.array(*(F.struct(F.lit(s).alias("signal"), F.lit(i).alias("i"), F.lit(m).alias("of")) for s, two in pairs.items() for i, m in enumerate(two))))
    rows = differences.select("report", "metric", "status", "difference", "basis", sides.alias("w")).select("report", "metric", "status", "difference", "basis", "w.*").withColumn("mine", F.col("metric") == F.col("of"))
    good = F.col("mine") & (F.col("status") == "succeeded")
    side = lambda i: F.max(F.when(good & (F.col("i") == i), F.col("difference")))
    grouped = rows.groupBy("report", "signal").agg(
        *(F.count_if(F.col("mine") & (F.col("i") == i)).alias(f"n{i}") for i in (0, 1)), F.count_if(good).alias("good"),
        F.coalesce(F.min(F.when(good, F.col("basis"))) == F.max(F.when(good, F.col("basis"))), F.lit(False)).alias("same"), side(0).alias("up"), side(1).alias("down"),
    )
    sure = (F.col("n0") == 1) & (F.col("n1") == 1) & (F.col("good") == 2) & F.col("same")
    status = F.when(~sure, "abstained").when((F.col("up") > 0) & (F.col("down") < 0), "candidate").otherwise("not_triggered")
    return grouped.select("report", "signal", status.alias("status"))
