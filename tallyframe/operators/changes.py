"""Annual changes: a metric's year against the year before, abstaining with the first reason that applies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pairs(facts: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """One row an entity, metric and year with both years' amounts, by conditional grouping: each fact counts as the
    current year's and as the next year's prior, so one shuffle pairs them and no self-join is needed."""
    sides = facts.select("*", F.explode(F.array(F.struct(F.col("y").alias("year"), F.lit(True).alias("cur")), F.struct((F.col("y") + 1).alias("year"), F.lit(False).alias("cur")))).alias("s")).select("entity", "metric", "s.year", "s.cur", "value", "currency", "restatement", "verified")
    cur, pri = F.col("cur"), ~F.col("cur")
    return (
        sides.filter(F.col("year").between(first_year, last_year))
        .groupBy("entity", "metric", "year")
        .agg(
            F.count_if(cur).alias("n_cur"),
            F.count_if(pri).alias("n_pri"),
            F.max(F.when(cur, F.col("value"))).alias("cur_value"),
            F.max(F.when(pri, F.col("value"))).alias("pri_value"),
            (F.min("currency") != F.max("currency")).alias("mixed"),
            F.bool_or(F.col("restatement") == "restated").alias("restated"),
            F.bool_and("verified").alias("verified"),
        )
    )


def legacy_changes(paired: DataFrame) -> DataFrame:
    """Issue ladder of the earlier path: a zero prior drops the difference as well; negative priors divide as they are."""
    status = (
        F.when((F.col("n_cur") > 1) | (F.col("n_pri") > 1), "duplicate_fact")
        .when(F.col("n_cur") == 0, "missing_current")
        .when(F.col("n_pri") == 0, "missing_prior")
        .when(F.col("mixed"), "incompatible_facts")
        .when(F.col("pri_value") == 0, "zero_prior")
        .otherwise("ok")
    )
    ok = F.col("status") == "ok"
    difference = (F.col("cur_value") - F.col("pri_value")).cast("decimal(20,2)")
    return paired.withColumn("status", status).select("entity", "metric", "year", "status", F.when(ok, difference).alias("difference"), F.when(ok, F.try_divide(difference, F.col("pri_value")).cast("decimal(20,8)")).alias("rate"))


def annual_changes(paired: DataFrame) -> DataFrame:
    """Issue ladder of the later path: facts must be verified and not restated; a base of 0 or less fails the rate only."""
    status = (
        F.when((F.col("n_cur") == 0) | (F.col("n_pri") == 0), "missing_fact")
        .when((F.col("n_cur") > 1) | (F.col("n_pri") > 1), "duplicate_fact")
        .when(F.col("mixed"), "incompatible_facts")
        .when(~F.col("verified"), "unverified_fact")
        .when(F.col("restated"), "restated_fact")
        .otherwise("succeeded")
    )
    done = F.col("pair_status") == "succeeded"
    difference = (F.col("cur_value") - F.col("pri_value")).cast("decimal(20,2)")
    rate_status = F.when(done & (F.col("pri_value") <= 0), "nonpositive_base").otherwise(F.col("pair_status"))
    return paired.withColumn("pair_status", status).select(
        "entity", "metric", "year", "pair_status", F.when(done, difference).alias("difference"), rate_status.alias("rate_status"),
        F.when(done & (F.col("pri_value") > 0), F.try_divide(difference, F.col("pri_value")).cast("decimal(20,8)")).alias("rate"),
    )
