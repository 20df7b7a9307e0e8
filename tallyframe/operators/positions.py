"""Joins by position on a line and folds over ordered values: nearest, band, as-of with context, clusters, fragments.

Range joins are equi-joins on buckets as wide as the tolerance: each right row is put in its own bucket and both neighbours,
so a pair within the tolerance meets exactly once, and no side is broadcast or crossed. Null positions meet nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within(left: DataFrame, x: str, right: DataFrame, y: str, tolerance: float) -> DataFrame:
    """All pairs with |x - y| <= tolerance, with the columns of both sides."""
    cell = lambda c: F.floor(F.col(c) / tolerance).cast("long")
    near = right.withColumn("_cell", F.explode(F.array(*(cell(y) + k for k in (-1, 0, 1)))))
    return left.withColumn("_cell", cell(x)).join(near, "_cell").filter(F.abs(F.col(x) - F.col(y)) <= tolerance).drop("_cell")


def nearest(left: DataFrame, key: str, x: str, right: DataFrame, y: str, farthest: float) -> DataFrame:
    """For each left row the closest right position, or null beyond the distance; ties go to the smaller one."""
    best = within(left.select(key, x), x, right.select(y).distinct(), y, farthest).groupBy(key).agg(F.min_by(y, F.struct(F.abs(F.col(x) - F.col(y)), F.col(y))).alias(y))
    return left.join(best, key, "left")


def next_after_context(events: DataFrame, who: str, order: tuple[str, ...], is_start: Column, is_context: Column, is_stop: Column, value: str, back: int = 3) -> DataFrame:
    """Start rows of which one of the `back` rows before is a context row, with the value of the first stop row after."""
    line = Window.partitionBy(who).orderBy(*order)
    seen = F.max(is_context.cast("int")).over(line.rowsBetween(-back, -1)) == 1
    stop = F.first(F.when(is_stop, F.col(value)), ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing))
    return events.withColumn("_start", is_start & seen).withColumn("stop", stop).filter("_start").drop("_start")


def clusters(values: Column, gap: float) -> Column:
    """How many lines sorted positions make, if a new one begins where a position lies beyond `gap` of the line's first."""
    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("double").alias("anchor"))

    def step(s, v):
        new = s["anchor"].isNull() | (v - s["anchor"] > gap)
        return F.struct((s["n"] + new.cast("int")).alias("n"), F.when(new, v).otherwise(s["anchor"]).alias("anchor"))

    return F.aggregate(F.array_sort(values), start, step, lambda s: s["n"])


def neighbour_label(text: Column, before: Column, after: Column, label: str) -> Column:
    """Whether the row's text with any of its neighbours, in order, is exactly the label."""
    empty = F.lit("")
    tries = [(b, text, a) for b in (empty, F.coalesce(before, empty)) for a in (empty, F.coalesce(after, empty))]
    return F.exists(F.array(*(F.concat(*t) for t in tries)), lambda x: x == label)


def assembled_label(fragments: Column, label: str) -> Column:
    """How many of the fragments, from the first on, make up the label exactly; null if none do. Fragments come in order."""
    joined = F.transform(F.sequence(F.lit(1), F.size(fragments)), lambda k: F.array_join(F.slice(fragments, 1, k), ""))
    return F.nullif(F.array_position(joined, label), F.lit(0))


def longest_fragment(words: Column, label: str) -> Column:
    """The longest run of words, joined, that the label contains; the first of equal ones, empty if there is none."""
    n = F.size(words)
    starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    runs = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.array_join(F.slice(words, i, k), ""))))
    kept = F.filter(runs, lambda r: F.contains(F.lit(label), r))
    size = F.array_max(F.transform(kept, lambda r: F.length(r)))
    return F.coalesce(F.get(F.filter(kept, lambda r: F.length(r) == size), 0), F.lit(""))


def take_with_budget(lengths: Column, budget: int, most: int) -> Column:
    """Positions (from 0) taken in order while they fit: what does not fit is passed over and the scan goes on."""
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("taken"), F.lit(0).alias("i"))

    def step(s, x):
        fits = (s["used"] + x <= budget) & (F.size(s["taken"]) < most)
        return F.struct(F.when(fits, s["used"] + x).otherwise(s["used"]).alias("used"), F.when(fits, F.concat(s["taken"], F.array(s["i"]))).otherwise(s["taken"]).alias("taken"), (s["i"] + 1).alias("i"))

    return F.aggregate(lengths, start, step, lambda s: s["taken"])
