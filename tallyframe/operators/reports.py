"""Reports of facts: whether evidence proves a fact, which section a fact belongs to, and the report as nested rows and text.

Evidence meets verifications by its id and facts by theirs, so each join is on one key, and a report's facts come together
once, at the end.

Defined cases: a null on either side of a compared value proves nothing, except that a null period start equals a null one;
verifications that cite unknown evidence support nothing; a fact without verifications is pending; a report without facts
has its headings and says so.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import report as R
from tallyframe.functions.text import compact

# Words of a row that name a metric, and that must not occur beside them; words of units and scopes.
ROW_WORDS = {"revenue": ("营业收入", "扣除"), "net_profit_parent": ("归属于母公司股东的净利润", "扣除"), "operating_cash_flow": ("经营活动产生的现金流量净额", "小计")}
TOTAL_METRIC, TOTAL_ROW, TOTAL_TITLE = "non_recurring_total", "合计", "非经常性损益项目和金额"
UNIT_WORDS = (("亿元", 100_000_000), ("万元", 10_000), ("元", 1))
CONSOLIDATED, PARENT = "合并", "母公司"
REASONS = {"none": "没有核验对象。", "blocked": "存在 conflict 或 insufficient_evidence 核验，不能进入已确认区。", "unproved": "verified 状态单独不够；核验证据须对齐值、行、列、表题、单位、期间和口径，只引用旧文字块不能进入已确认区。"}
FACT = ("metric", "raw_value", "value", "currency", "multiplier", "unit", "period_start", "period_end", "period_type", "scope")
EVIDENCE = ("value_raw", "value", "currency", "unit", "period_start", "period_end", "period_type", "table_title", "value_text", "row_text", "column_text", "title_text", "unit_text")


def unit_multiplier(text: Column) -> Column:
    short = compact(text)
    return F.coalesce(*(F.when(short.contains(w), F.lit(m)) for w, m in UNIT_WORDS))


def row_names(metric: Column, text: Column) -> Column:
    short = compact(text)
    named = [F.when(metric == m, short.contains(words) & ~short.contains(lacks)) for m, (words, lacks) in ROW_WORDS.items()]
    return F.coalesce(*named, F.when(metric == TOTAL_METRIC, short == TOTAL_ROW), F.lit(False))


def scope_shown(scope: Column, metric: Column, title: Column, table: Column) -> Column:
    both = lambda yes, no: reduce(Column.__and__, (x for t in (compact(title), compact(table)) for x in (t.contains(yes), ~t.contains(no))))
    of_total = R.is_title(title, TOTAL_TITLE) & R.is_title(table, TOTAL_TITLE)
    return F.when(scope == "consolidated", both(CONSOLIDATED, PARENT)).when(scope == "parent", both(PARENT, CONSOLIDATED)).when((scope == "unknown") & (metric == TOTAL_METRIC), of_total).otherwise(False)


def proves(fact: Column, evidence: Column) -> Column:
    """Whether a cell of a table shows the fact: its value as printed and as a number, currency, unit, period, row, column of
    the year, title and scope. Evidence without all its places is a text block only and proves nothing."""
    f, e = (lambda c: fact[c]), (lambda c: evidence[c])
    places = reduce(Column.__and__, (e(c).isNotNull() for c in EVIDENCE if c.endswith("_text")))
    yuan = F.array(F.lit("人民币"), F.lit("CNY"))
    same_currency = (f("currency") == e("currency")) | (F.array_contains(yuan, f("currency")) & F.array_contains(yuan, e("currency")))
    shown = unit_multiplier(e("unit_text"))
    same_unit = (shown == unit_multiplier(e("unit"))) & (shown == f("multiplier").try_cast("decimal(38,10)")) & (f("unit").isNull() | (f("unit") == e("unit")))
    period = f("period_start").eqNullSafe(e("period_start")) & (f("period_end") == e("period_end")) & (f("period_type") == e("period_type"))
    in_column = e("column_text").contains(F.year(f("period_end")).cast("string"))
    all_of = (
        places, f("raw_value") == e("value_raw"), f("value") == e("value"), same_currency, same_unit, period,
        R.has_complete_token(e("value_text"), f("raw_value")), row_names(f("metric"), e("row_text")), in_column, scope_shown(f("scope"), f("metric"), e("title_text"), e("table_title")),
    )
    return F.coalesce(reduce(Column.__and__, all_of), F.lit(False))


def placed_facts(facts: DataFrame, verifications: DataFrame, evidences: DataFrame) -> DataFrame:
    """Adds confirmed, reasons and proof (sorted ids of the verified evidence that proves the fact) to facts.

    facts: fact_id and FACT. verifications: verification_id, target_id, status, evidence_ids. evidences: evidence_id and
    EVIDENCE. A fact is confirmed if it has verifications, all verified, and evidence of one of them proves it."""
    cited = verifications.select(F.col("target_id").alias("fact_id"), "verification_id", "status", F.explode_outer(F.array_distinct("evidence_ids")).alias("evidence_id"))
    cells = evidences.select("evidence_id", F.struct(*EVIDENCE).alias("cell"))
    one = facts.select("fact_id", F.struct(*FACT).alias("fact"))
    met = cited.join(cells, "evidence_id", "left").join(one, "fact_id").withColumn("proof", F.when((F.col("status") == "verified") & F.coalesce(proves(F.col("fact"), F.col("cell")), F.lit(False)), F.col("evidence_id")))
    told = met.groupBy("fact_id").agg(
        F.array_sort(F.collect_set("proof")).alias("proof"), F.bool_or(~F.coalesce(F.col("status") == "verified", F.lit(False))).alias("_blocked"), F.bool_or(F.coalesce(F.col("status") == "verified", F.lit(False))).alias("_verified")
    )
    rows = facts.join(told, "fact_id", "left").withColumn("proof", F.coalesce("proof", F.array().cast("array<string>")))
    reasons = F.array(F.when(F.col("_verified").isNull(), "none"), F.when(F.col("_blocked"), "blocked"), F.when(F.col("_verified") & (F.size("proof") == 0), "unproved"))
    rows = rows.withColumn("reasons", F.array_compact(reasons))
    return rows.withColumn("confirmed", F.size("reasons") == 0).drop("_blocked", "_verified")


def report_rows(placed: DataFrame, reports: DataFrame) -> DataFrame:
    """report, confirmed and pending (arrays of fact_id, metric, raw_value, reasons, proof, in order of fact ids) and text, the
    report in Markdown. placed: of placed_facts, with report; reports: report, title."""
    record = F.struct("fact_id", "metric", "raw_value", "reasons", "proof")
    of = lambda c: F.array_sort(F.collect_list(F.when(c, record)))
    grouped = placed.groupBy("report").agg(of(F.col("confirmed")).alias("confirmed"), of(~F.col("confirmed")).alias("pending"))
    rows = reports.select("report", "title").join(grouped, "report", "left")
    lines = lambda c, line: F.transform(F.coalesce(c, F.array()), line)
    why = F.create_map(*(F.lit(x) for kv in REASONS.items() for x in kv))
    sure = lines("confirmed", lambda f: F.concat(F.lit("- "), f["metric"], F.lit("："), f["raw_value"], F.lit("（"), F.array_join(f["proof"], "、"), F.lit("）")))
    open_ = lines("pending", lambda f: F.concat(F.lit("- "), f["metric"], F.lit("："), f["raw_value"], F.lit("；"), F.array_join(F.transform(f["reasons"], lambda r: why[r]), "")))
    none = lambda a, text: F.when(F.size(a) > 0, a).otherwise(F.array(F.lit(text)))
    text = F.concat(
        F.array(F.concat(F.lit("# "), F.col("title")), F.lit(""), F.lit("## 已确认指标与分析"), F.lit("")), none(sure, "没有同时具备核验、引用和交叉对应的指标或计算。这里不补写结论。"),
        F.array(F.lit(""), F.lit("## 待核查"), F.lit("")), none(open_, "没有待核查对象。"),
    )
    return rows.withColumn("text", F.array_join(text, "\n"))
