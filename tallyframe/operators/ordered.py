"""Operators on ordered lines and rows: sections, first matches, preferred rows, row bands, rows assembled with state.

What needs only one text's lines is a column expression on its line array, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.text import AMOUNT


def section(lines: Column, title: Column, heading) -> tuple[Column, Column]:
    """First and last-but-one index (from 0) of the section that the first line equal to the title opens: it ends at the
    next heading, or with the lines. Both null where no line is the title."""
    start = F.nullif(F.array_position(lines, title), F.lit(0)) - 1
    place = F.filter(F.transform(lines, lambda x, i: F.when(heading(x) & (i > start), i)), lambda i: i.isNotNull())
    return start, F.when(start.isNotNull(), F.coalesce(F.array_min(place).cast("long"), F.size(lines).cast("long")))


def first_match(lines: Column, test) -> Column:
    return F.get(F.filter(lines, test), 0)


def preferred(df: DataFrame, key: str, rank: Column, order: Column, value: str) -> DataFrame:
    """The row of the lowest rank for each key, the first in order among equals, and whether it is a substitute."""
    best = F.min(F.struct(rank.alias("rank"), order.alias("order"), F.col(value).alias("value")))
    return df.groupBy(key).agg(best.alias("b")).select(key, F.col("b.value").alias(value), (F.col("b.rank") > 0).alias("substitute"))


def bands(df: DataFrame, page: str, y: str, order: tuple[str, ...], word: str) -> DataFrame:
    """Words of the same page and the same rounded height (half to even) as one text in order."""
    words = F.array_sort(F.collect_list(F.struct(*order, word)))
    return df.groupBy(page, F.bround(y, 0).cast("long").alias("band")).agg(F.array_join(F.transform(words, lambda w: w[word]), " ").alias("words"))


def assembled(lines: Column) -> Column:
    """Rows put together from lines: a row ends with the line after which it holds an amount and its brackets balance, or
    with the last line. Gives rows (their number) and longest (most lines in one)."""
    opened = lambda x: F.length(F.regexp_replace(x, "[^(（]", "")) - F.length(F.regexp_replace(x, "[^)）]", ""))
    start = F.struct(F.lit(0).alias("rows"), F.lit(0).alias("longest"), F.lit(0).alias("held"), F.lit(False).alias("amount"), F.lit(0).alias("depth"))

    def step(s, line):
        held, amount, depth = s["held"] + 1, s["amount"] | line.rlike(AMOUNT), s["depth"] + opened(line)
        ends = amount & (depth == 0)
        return F.struct(
            (s["rows"] + ends.cast("int")).alias("rows"),
            F.greatest(s["longest"], held).alias("longest"),
            F.when(ends, 0).otherwise(held).alias("held"),
            (amount & ~ends).alias("amount"),
            F.when(ends, 0).otherwise(depth).alias("depth"),
        )

    return F.aggregate(lines, start, step, lambda s: F.struct((s["rows"] + (s["held"] > 0).cast("int")).alias("rows"), s["longest"].alias("longest")))
