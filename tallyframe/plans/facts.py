"""Fact views: annual metrics of nations, with the gaps that abstention rules need, as one long table.

Columns: entity, metric, y (year of the amount), value decimal(20,2), currency, restatement, verified.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = ("revenue", "cost_of_goods_sold", "net_profit_parent", "operating_cash_flow", "accounts_receivable_net", "inventory_net", "net_profit_ex")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an entity and year. Both dimensions are small next to the line items; the optimizer picks their joins."""
    items = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", F.year("l_shipdate").alias("y"))
    items = items.filter(F.col("y").between(1995, 2000))
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("entity"))
    part = read(spark, sf_dir, "part").select("p_partkey", "p_type", F.col("p_retailprice").cast("decimal(9,2)").alias("retail"))
    rows = items.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    cost = F.col("l_quantity").cast("decimal(9,0)") * F.col("retail")
    zero = F.lit(0).cast("decimal(18,2)")
    total = lambda c: F.sum(c).cast("decimal(20,2)")
    return rows.groupBy("entity", "y").agg(
        total(price).alias("revenue"),
        total(cost).alias("cost_of_goods_sold"),
        total(F.when(F.col("l_returnflag") == "R", -price).when(F.col("l_returnflag") == "A", price).otherwise(zero)).alias("operating_cash_flow"),
        total(F.when(F.col("l_linestatus") == "O", price).otherwise(zero)).alias("accounts_receivable_net"),
        total(F.when(F.col("l_linestatus") == "O", cost).otherwise(zero)).alias("inventory_net"),
        total(F.when(F.col("p_type") == "PROMO", price).otherwise(zero)).alias("promo"),
    ).withColumn("net_profit_parent", (F.col("revenue") - F.col("cost_of_goods_sold")).cast("decimal(20,2)")).withColumn("net_profit_ex", (F.col("revenue") - F.col("cost_of_goods_sold") - F.col("promo")).cast("decimal(20,2)"))


YEARLY_SQL = """
yearly AS (
  SELECT *, CAST(revenue - cost_of_goods_sold AS DECIMAL(20,2)) AS net_profit_parent, CAST(revenue - cost_of_goods_sold - promo AS DECIMAL(20,2)) AS net_profit_ex
  FROM (SELECT s_nationkey AS entity, CAST(year(l_shipdate) AS INTEGER) AS y,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(20,2)) AS revenue,
    CAST(sum(CAST(l_quantity AS DECIMAL(9,0)) * CAST(p_retailprice AS DECIMAL(9,2))) AS DECIMAL(20,2)) AS cost_of_goods_sold,
    CAST(sum(CASE l_returnflag WHEN 'R' THEN -CAST(l_extendedprice AS DECIMAL(18,2)) WHEN 'A' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS DECIMAL(20,2)) AS operating_cash_flow,
    CAST(sum(CASE WHEN l_linestatus = 'O' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS DECIMAL(20,2)) AS accounts_receivable_net,
    CAST(sum(CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS DECIMAL(9,0)) * CAST(p_retailprice AS DECIMAL(9,2)) ELSE 0 END) AS DECIMAL(20,2)) AS inventory_net,
    CAST(sum(CASE WHEN p_type = 'PROMO' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS DECIMAL(20,2)) AS promo
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
  WHERE year(l_shipdate) BETWEEN 1995 AND 2000 GROUP BY 1, 2))"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = yearly(spark, sf_dir).unpivot(["entity", "y"], list(METRICS), "metric", "value")
    long = long.filter("NOT (entity % 7 = 3 AND metric = 'revenue' AND y = 1997)")
    copies = F.when(F.expr("entity % 5 = 2 AND metric = 'cost_of_goods_sold' AND y = 1998"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return long.withColumn("copy", F.explode(copies)).select(
        "entity",
        "metric",
        "y",
        "value",
        F.expr("CASE WHEN entity % 6 = 1 AND y = 1999 THEN 'USD' ELSE 'CNY' END").alias("currency"),
        F.expr("CASE WHEN entity % 8 = 5 AND y = 1998 THEN 'restated' ELSE 'not_restated' END").alias("restatement"),
        F.expr("NOT (entity % 9 = 4 AND metric = 'operating_cash_flow')").alias("verified"),
    )


FACTS_SQL = (
    YEARLY_SQL
    + """,
facts AS (
  SELECT entity, metric, y, value, CASE WHEN entity % 6 = 1 AND y = 1999 THEN 'USD' ELSE 'CNY' END AS currency,
    CASE WHEN entity % 8 = 5 AND y = 1998 THEN 'restated' ELSE 'not_restated' END AS restatement, NOT (entity % 9 = 4 AND metric = 'operating_cash_flow') AS verified
  FROM (SELECT entity, metric, y, value, unnest(CASE WHEN entity % 5 = 2 AND metric = 'cost_of_goods_sold' AND y = 1998 THEN [1, 2] ELSE [1] END) AS copy
    FROM (UNPIVOT yearly ON """
    + ", ".join(METRICS)
    + """ INTO NAME metric VALUE value)
    WHERE NOT (entity % 7 = 3 AND metric = 'revenue' AND y = 1997)))"""
)
