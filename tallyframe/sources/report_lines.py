"""Report lines as a table: one balance sheet an order, with title, unit, header, rows, page marks and what follows it.

The lines are made from `orders` and `lineitem`, all rows of both: labels, notes, signs and brackets vary with the keys, so
the text operators meet every printed form. Columns: doc, ord (place in the report), text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TITLES = ("合并资产负债表", "二、合并资产负债表", "2．合并资产负债表", "母公司资产负债表", "合并 资产负债表")
UNIT_LINES = ("单位：元 币种：人民币", "单位: 万元 币种: 人民币", "单位：元", "单位：元 币种：人民币 币种：美元", "单位：亿元 币种：美元", "币种：人民币", "单位：元 币种:人民币")
HEADERS = ("项目 附注 2024年12月31日 2023年12月31日", "项目 2023年12月31日 2024年12月31日", "项目 2024年6月30日 2023年12月31日", "项目 附注 2024年12月31日 2023年12月31日", "项目 2022年12月31日 2021年12月31日", "项目 附注 2024 年 12 月 31 日 2023 年 12 月 31 日")
LABELS = ("应收账款", "存货", "应收账款（净额）", "其他应收款", "货币资金", "存货跌价准备", "合计")
NOTES = ("七、5", "附注12", "")
AFTER = ("12 / 143", "某某股份有限公司2024年年度报告", "合并利润表", "应收账款 9.99 8.88")


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda of, key: F.element_at(F.array(*map(F.lit, of)), (key % len(of) + 1).cast("int"))
    doc = F.col("o_orderkey")
    fixed = F.array(*(F.struct(F.lit(k).alias("ord"), c.alias("text")) for k, c in ((0, pick(TITLES, doc)), (1, pick(UNIT_LINES, doc)), (2, pick(HEADERS, doc)), *((90 + i, F.lit(t)) for i, t in enumerate(AFTER)))))
    heads = spark.read.parquet(f"{sf_dir}/orders.parquet").select(doc.alias("doc"), F.explode(fixed).alias("l")).select("doc", "l.ord", "l.text")
    return heads.unionByName(row_lines(spark, sf_dir).select("doc", "ord", "text"))


def row_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows alone, with the raw tokens that they print: doc, ord, text, now, before."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    form = (F.col("l_partkey") + F.col("l_linenumber")) % 5
    whole = F.col("l_quantity").cast("int")
    label = F.element_at(F.array(*map(F.lit, LABELS)), F.col("l_linenumber"))
    note = F.element_at(F.array(*map(F.lit, NOTES)), whole % 3 + 1)

    def token(x, form):
        s = F.format_number(x, 2)
        return F.when(form == 1, F.concat(F.lit("("), s, F.lit(")"))).when(form == 2, F.concat(F.lit("-"), s)).when(form == 3, F.concat(F.lit("（"), F.translate(s, ",", "，"), F.lit("）"))).when(form == 4, F.concat(F.lit("(-"), s, F.lit(")"))).otherwise(s)

    now = token(F.col("l_extendedprice").cast("decimal(18,2)"), form)
    before = token((whole * 731 + F.lit("0.25").cast("decimal(18,2)")).cast("decimal(18,2)"), F.when(form == 4, 0).otherwise(form))
    rows = items.select(F.col("l_orderkey").alias("doc"), (10 * F.col("l_linenumber")).alias("ord"), label.alias("label"), note.alias("note"), now.alias("now"), before.alias("before"))
    return rows.select("doc", "ord", F.concat_ws(" ", "label", F.nullif("note", F.lit("")), "now", "before").alias("text"), "now", "before")


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


TOKEN_SQL = "CASE {f} WHEN 1 THEN '(' || {s} || ')' WHEN 2 THEN '-' || {s} WHEN 3 THEN '（' || replace({s}, ',', '，') || '）' WHEN 4 THEN '(-' || {s} || ')' ELSE {s} END"
ROWS_SQL = f"""
printed AS (SELECT l_orderkey AS doc, 10 * l_linenumber AS ord, rtrim(({_list(LABELS)})[l_linenumber] || ' ' || ({_list(NOTES)})[CAST(l_quantity AS INTEGER) % 3 + 1]) AS head, (l_partkey + l_linenumber) % 5 AS f,
  format('{{:,.2f}}', l_extendedprice) AS a, format('{{:,.2f}}', CAST(l_quantity AS INTEGER) * 731 + 0.25::DOUBLE) AS b FROM lineitem),
tokens AS (SELECT doc, ord, head, {TOKEN_SQL.format(f="f", s="a")} AS now, {TOKEN_SQL.format(f="(CASE f WHEN 4 THEN 0 ELSE f END)", s="b")} AS before FROM printed),
row_lines AS (SELECT doc, ord, head || ' ' || now || ' ' || before AS text, now, before FROM tokens)"""
LINES_SQL = (
    ROWS_SQL
    + f""",
heads AS (SELECT o_orderkey AS doc, unnest([0, 1, 2, 90, 91, 92, 93]) AS ord,
  unnest([({_list(TITLES)})[o_orderkey % {len(TITLES)} + 1], ({_list(UNIT_LINES)})[o_orderkey % {len(UNIT_LINES)} + 1], ({_list(HEADERS)})[o_orderkey % {len(HEADERS)} + 1], {_list(AFTER)[1:-1]}]) AS text FROM orders),
lines AS (SELECT doc, ord, text FROM heads UNION ALL SELECT doc, ord, text FROM row_lines)"""
)
