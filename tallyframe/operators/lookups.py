"""Lookups that must be unique, references of several kinds, ordinal inputs, first errors, coverage gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique_lookup(df: DataFrame, key: str, of: DataFrame, target: str, value: str) -> DataFrame:
    """Adds found (`one`, `missing` or `duplicate`) and the value where there is exactly one. Null keys find nothing."""
    once = of.groupBy(F.col(target).alias(key)).agg(F.count("*").alias("_n"), F.min(value).alias("_v"))
    found = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "duplicate").otherwise("one")
    return df.join(once, key, "left").withColumn("found", found).withColumn(value, F.when(F.col("_n") == 1, F.col("_v"))).drop("_n", "_v")


def dangling_targets(refs: DataFrame, pools: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """References (kind, target) without a row in the pool of their kind; unknown kinds and null targets dangle."""
    every = None
    for kind, (pool, key) in pools.items():
        part = pool.select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("target"))
        every = part if every is None else every.unionByName(part)
    return refs.join(every, ["kind", "target"], "left_anti")


def with_inputs(calculations: DataFrame, ids: str, facts: DataFrame, id_col: str, value: str) -> DataFrame:
    """Adds first and second: the values of the facts that a calculation names first and second. Missing ones are null."""
    pool = facts.select(F.col(id_col).alias("_id"), F.col(value).alias("_v"))
    out = calculations
    for k, name in enumerate(("first", "second")):
        out = out.withColumn("_id", F.get(ids, k)).join(pool, "_id", "left").withColumnRenamed("_v", name).drop("_id")
    return out


def first_error(checks: list[tuple[str, Column]]) -> Column:
    """The code of the first check that holds; null where none does. A check on null does not hold."""
    return F.coalesce(*(F.when(bad, code) for code, bad in checks))


def violations(checks: list[tuple[str, Column]]) -> Column:
    """The codes of all checks that hold, in order."""
    return F.array_compact(F.array(*(F.when(bad, code) for code, bad in checks)))


def is_natural_year(start: Column, end: Column) -> Column:
    return (F.year(start) == F.year(end)) & (F.dayofyear(start) == 1) & (F.month(end) == 12) & (F.dayofmonth(end) == 31)
