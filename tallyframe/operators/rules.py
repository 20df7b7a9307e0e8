"""Screening rules over paired facts. Thresholds are compared by cross-multiplication, so boundary cases stay exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARE, GAP, POINTS = "0.30", "0.20", 25


def wide(paired: DataFrame) -> DataFrame:
    """One row an entity and year; a metric's amounts are null unless its pair is whole and unquestioned."""
    usable = (F.col("n_cur") == 1) & (F.col("n_pri") == 1) & ~F.col("mixed") & F.col("verified") & ~F.col("restated")
    metrics = ("revenue", "cost_of_goods_sold", "net_profit_parent", "operating_cash_flow", "accounts_receivable_net", "inventory_net", "net_profit_ex")
    amounts = [F.max(F.when((F.col("metric") == m) & usable, F.col(side))).alias(f"{m}_{tag}") for m in metrics for side, tag in (("cur_value", "c"), ("pri_value", "p"))]
    return paired.groupBy("entity", "year").agg(*amounts)


def divergence(rows: DataFrame, left: str) -> DataFrame:
    """One amount up while operating cash flow is down."""
    up = F.col(f"{left}_c") - F.col(f"{left}_p")
    cash = F.col("operating_cash_flow_c") - F.col("operating_cash_flow_p")
    state = F.when(up.isNull() | cash.isNull(), "abstained").when((up > 0) & (cash < 0), "candidate").otherwise("not_triggered")
    return rows.select("entity", "year", state.alias("state"), up.cast("decimal(20,2)").alias("left_difference"), cash.cast("decimal(20,2)").alias("right_difference"))


def cash_to_profit(rows: DataFrame) -> DataFrame:
    profit, cash = F.col("net_profit_parent_c"), F.col("operating_cash_flow_c")
    state = F.when(profit.isNull() | cash.isNull(), "missing").when(profit <= 0, "nonpositive_denominator").otherwise("ok")
    return rows.select("entity", "year", state.alias("state"), F.when(state == "ok", F.try_divide(cash, profit).cast("decimal(20,8)")).alias("ratio"))


def profit_cash_rule() -> Column:
    return (F.col("net_profit_parent_c") > 0) & (F.col("operating_cash_flow_c") < 0)


def share_rule() -> Column:
    """Non-recurring part of the profit reaches its share; abstains on profits of 0 or less in either year."""
    parent, ex = F.col("net_profit_parent_c"), F.col("net_profit_ex_c")
    hit = F.abs(parent - ex) >= F.lit(SHARE).cast("decimal(3,2)") * parent
    return F.when((parent > 0) & (F.col("net_profit_parent_p") > 0), hit)


def gap_rule(stock: str, flow: str) -> Column:
    """Growth of a stock exceeds growth of a flow by the gap: dA*B0 - dB*A0 >= gap*A0*B0; abstains on bases of 0 or less."""
    a0, b0 = F.col(f"{stock}_p").cast("decimal(17,2)"), F.col(f"{flow}_p").cast("decimal(17,2)")
    da, db = (F.col(f"{stock}_c") - F.col(f"{stock}_p")).cast("decimal(17,2)"), (F.col(f"{flow}_c") - F.col(f"{flow}_p")).cast("decimal(17,2)")
    return F.when((a0 > 0) & (b0 > 0), (da * b0 - db * a0) * F.lit(5) >= a0 * b0)


def scored(rows: DataFrame) -> DataFrame:
    """Four rules of equal points; the total is null unless all four could be decided."""
    rules = {"rule_1": profit_cash_rule(), "rule_2": share_rule(), "rule_3": gap_rule("accounts_receivable_net", "revenue"), "rule_4": gap_rule("inventory_net", "cost_of_goods_sold")}
    out = rows.select("entity", "year", *(c.alias(k) for k, c in rules.items()))
    points = sum((F.when(F.col(k), POINTS).when(~F.col(k), 0) for k in rules), F.lit(0))
    return out.withColumn("total", points.cast("int"))
