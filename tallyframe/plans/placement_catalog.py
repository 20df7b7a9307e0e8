"""Registered queries on reports of facts and their proofs, with the SQL each must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import reports as P
from tallyframe.plans.catalog import registered
from tallyframe.plans.facts import read

# Two facts an order, k its key and y the year, with the cell that is to prove each; some cells show something else.
_RAW = "concat(CAST(100 + k * 7 % 900 AS STRING), ',', CAST(100 + k * 11 % 900 AS STRING), '.', CAST(y - 2000 AS STRING))"
_METRIC = "CASE k % 4 WHEN 0 THEN 'revenue' WHEN 1 THEN 'net_profit_parent' WHEN 2 THEN 'operating_cash_flow' ELSE 'non_recurring_total' END"
_ROW = "CASE k % 4 WHEN 0 THEN '一、营业收入' WHEN 1 THEN '归属于母公司股东的净利润（净亏损以“－”号填列）' WHEN 2 THEN '经营活动产生的 现金流量净额' ELSE '合 计' END"
_TITLE = "CASE WHEN k % 4 = 3 THEN '三、非经常性损益项目及金额' WHEN k % 11 = 2 THEN '母公司利润表' ELSE '合并利润表' END"
FACTS = {
    "fact_id": "concat(CAST(k AS STRING), '-', CAST(y AS STRING))", "metric": _METRIC, "raw_value": _RAW, "value": f"CAST(replace({_RAW}, ',', '') AS DECIMAL(20,2))", "currency": "CASE WHEN k % 5 = 1 THEN '人民币' WHEN k % 47 = 2 THEN 'USD' ELSE 'CNY' END",
    "multiplier": "CASE WHEN k % 7 = 1 THEN '10000.0' ELSE '1' END", "unit": "CASE WHEN k % 3 = 0 THEN NULL WHEN k % 7 = 1 THEN '万元' ELSE '元' END", "period_start": "make_date(y, 1, 1)", "period_end": "make_date(y, 12, 31)", "period_type": "'duration'",
    "scope": "CASE WHEN k % 4 = 3 THEN 'unknown' WHEN k % 11 = 2 THEN 'parent' ELSE 'consolidated' END",
}
CELLS = {
    "evidence_id": "concat('e', CAST(k AS STRING), '-', CAST(y AS STRING))", "value_raw": f"CASE WHEN k % 13 = 1 AND y = 2024 THEN '1.00' ELSE {_RAW} END", "value": FACTS["value"], "currency": "'人民币'", "unit": "CASE WHEN k % 7 = 1 THEN '万元' ELSE '元' END",
    "period_start": "CASE WHEN k % 53 = 3 THEN NULL ELSE make_date(y, 1, 1) END", "period_end": "make_date(y, 12, 31)", "period_type": "'duration'", "table_title": f"CASE WHEN k % 59 = 4 THEN '合并及母公司利润表' ELSE {_TITLE} END",
    "value_text": f"CASE WHEN k % 17 = 3 THEN concat('9', {_RAW}) WHEN k % 17 = 4 THEN concat('- ', {_RAW}) ELSE concat({_RAW}, ' 5.00') END", "row_text": f"CASE WHEN k % 19 = 4 THEN concat('扣除后', {_ROW}) ELSE {_ROW} END",
    "column_text": "CASE WHEN k % 23 = 5 THEN '2020年度' ELSE concat(CAST(y AS STRING), '年度') END", "title_text": f"CASE WHEN k % 29 = 6 THEN NULL ELSE {_TITLE} END", "unit_text": "CASE WHEN k % 31 = 5 THEN '单位：亿元' WHEN k % 7 = 1 THEN '单位：万 元' ELSE '单位：元 币种：人民币' END",
}
_EVENTS = "SELECT o_orderkey AS k, unnest([2024, 2023]) AS y FROM orders"
_AS_SQL = lambda columns: ", ".join(f"{x} AS {c}" for c, x in columns.items()).replace("AS STRING", "AS VARCHAR")
_SQL = f"""WITH b AS ({_EVENTS}), f AS (SELECT k, {_AS_SQL(FACTS)} FROM b), c AS (SELECT {_AS_SQL(CELLS)} FROM b),
v AS (SELECT k, k || '-' || y AS fact_id, CASE WHEN k % 31 = 7 THEN 'conflict' ELSE 'verified' END AS status, [CASE WHEN k % 43 = 10 THEN 'unknown' ELSE 'e' || k || '-' || y END] AS ids FROM b WHERE k % 37 <> 8 UNION ALL SELECT k, k || '-' || y, 'insufficient_evidence', CAST([] AS VARCHAR[]) FROM b WHERE k % 41 = 9),
m AS (SELECT f.fact_id, v.status, c.evidence_id, f.raw_value = c.value_raw AND f.value = c.value AND f.currency <> 'USD' AND (f.unit IS NULL OR f.unit = c.unit) AND CASE WHEN contains(unit_text, '亿') THEN 1e8 WHEN contains(unit_text, '万') THEN 1e4 ELSE 1 END = CAST(f.multiplier AS DOUBLE)
  AND f.period_start IS NOT DISTINCT FROM c.period_start AND contains(column_text, CAST(year(f.period_end) AS VARCHAR)) AND starts_with(value_text, f.raw_value) AND title_text IS NOT NULL AND (f.metric = 'operating_cash_flow' OR NOT contains(row_text, '扣除')) AND (f.scope = 'unknown' OR NOT (contains(table_title, '合并') AND contains(table_title, '母公司'))) AND (f.scope <> 'unknown' OR table_title LIKE '三、%') AS fits
  FROM f JOIN (SELECT k, fact_id, status, unnest(CASE WHEN len(ids) = 0 THEN [NULL] ELSE ids END) AS id FROM v) v ON v.fact_id = f.fact_id LEFT JOIN c ON c.evidence_id = v.id),
t AS (SELECT fact_id, bool_or(status <> 'verified') AS blocked, bool_or(status = 'verified') AS verified, coalesce(string_agg(evidence_id, ',' ORDER BY evidence_id) FILTER (status = 'verified' AND fits), '') AS proof FROM m GROUP BY 1),
p AS (SELECT f.k, f.fact_id, f.metric, f.raw_value, coalesce(proof, '') AS proof, concat_ws(',', CASE WHEN t.fact_id IS NULL THEN 'none' END, CASE WHEN blocked THEN 'blocked' END, CASE WHEN verified AND proof = '' THEN 'unproved' END) AS reasons FROM f LEFT JOIN t USING (fact_id))
"""


def _placed(spark, sf_dir):
    base = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.explode(F.array(F.lit(2024), F.lit(2023))).alias("y"))
    facts = base.select(F.col("k").alias("report"), *(F.expr(x).alias(c) for c, x in FACTS.items()))
    cells = base.select(*(F.expr(x).alias(c) for c, x in CELLS.items()))
    target = F.expr(FACTS["fact_id"])
    first = base.filter("k % 37 <> 8").select(F.concat(F.lit("v"), target).alias("verification_id"), target.alias("target_id"), F.expr("CASE WHEN k % 31 = 7 THEN 'conflict' ELSE 'verified' END").alias("status"), F.array(F.expr(f"CASE WHEN k % 43 = 10 THEN 'unknown' ELSE {CELLS['evidence_id']} END")).alias("evidence_ids"))
    second = base.filter("k % 41 = 9").select(F.concat(F.lit("w"), target).alias("verification_id"), target.alias("target_id"), F.lit("insufficient_evidence").alias("status"), F.array().cast("array<string>").alias("evidence_ids"))
    return P.placed_facts(facts, first.unionByName(second), cells)


@registered(_SQL + "SELECT fact_id, reasons = '' AS confirmed, reasons, proof FROM p")
def proved_facts(spark, sf_dir):
    """Which facts are confirmed, by what evidence, and why the others are not."""
    return _placed(spark, sf_dir).select("fact_id", "confirmed", F.array_join("reasons", ",").alias("reasons"), F.array_join("proof", ",").alias("proof"))


_WHY = "replace(replace(replace(replace(reasons, ',', ''), 'none', '没有核验对象。'), 'blocked', '存在 conflict 或 insufficient_evidence 核验，不能进入已确认区。'), 'unproved', 'verified 状态单独不够；核验证据须对齐值、行、列、表题、单位、期间和口径，只引用旧文字块不能进入已确认区。')"


@registered(_SQL + f"""SELECT o_orderkey AS report, '# 报告 ' || o_orderkey || chr(10) || chr(10) || '## 已确认指标与分析' || chr(10) || chr(10) || coalesce(string_agg('- ' || metric || '：' || raw_value || '（' || proof || '）', chr(10) ORDER BY fact_id) FILTER (reasons = ''), '没有同时具备核验、引用和交叉对应的指标或计算。这里不补写结论。')
  || chr(10) || chr(10) || '## 待核查' || chr(10) || chr(10) || coalesce(string_agg('- ' || metric || '：' || raw_value || '；' || {_WHY}, chr(10) ORDER BY fact_id) FILTER (reasons <> ''), '没有待核查对象。') AS text FROM orders LEFT JOIN p ON k = o_orderkey GROUP BY 1""")
def report_text(spark, sf_dir):
    """Reports of all orders as Markdown."""
    titles = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("report"), F.concat(F.lit("报告 "), F.col("o_orderkey").cast("string")).alias("title"))
    return P.report_rows(_placed(spark, sf_dir), titles).select("report", "text")
