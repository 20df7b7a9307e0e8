"""Requests kept below a length: records go from the tails of lists in a fixed order until what is left fits.

A request is one row with its lists as arrays, so that trimming is a fold over that row's records; nothing is shuffled.

Defined cases: null lists are empty; null JSON counts as `null`; records without an id are sent but not cited; without any
record a request may stay longer than the limit; ids may repeat, and each record is kept or dropped for itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECORD = "array<struct<id:string,json:string,refs:array<string>>>"


def _cost(record: Column, i: Column) -> Column:
    """What a record adds to the text: itself, and a comma unless it is the first of its list."""
    return F.length(F.coalesce(record["json"], F.lit("null"))) + (i > 0).cast("int")


def dropped(costs: Column, over: Column) -> Column:
    """How many of the costs, from the first on, must go for their sum to reach `over`; all if they never do."""
    start = F.struct(F.lit(0).cast("long").alias("gone"), F.lit(0).alias("n"))

    def step(s, cost):
        more = s["gone"] < over
        return F.struct((s["gone"] + F.when(more, cost).otherwise(0)).alias("gone"), (s["n"] + more.cast("int")).alias("n"))

    return F.aggregate(costs, start, step, lambda s: s["n"])


def trimmed(requests: DataFrame, lists: Sequence[str], caps: dict[str, int], base: Column, most: int, facts: str, calculations: str, signals: str) -> DataFrame:
    """Replaces the lists by what is sent and adds truncated, length (of the request before calculations are filtered) and
    allowed (sorted ids of all records sent).

    lists: names of array columns in the order in which their tails go. Each is cut to its cap first. base: length of the
    request with empty lists and `"truncated":false`. A calculation whose refs are not all facts sent goes as well, and a
    signal keeps only the refs that are calculations sent. Whatever goes makes the request truncated, which by itself
    shortens the text by one character."""
    rows = requests.withColumns({c: F.coalesce(c, F.from_json(F.lit("[]"), RECORD)) for c in lists})
    capped = F.lit(False)
    for c in lists:
        capped = capped | (F.size(c) > caps[c])
    rows = rows.withColumn("_capped", capped).withColumns({c: F.slice(c, 1, caps[c]) for c in lists})
    costs = F.concat(*(F.reverse(F.transform(c, _cost)) for c in lists))
    rows = rows.withColumn("_costs", costs)
    total = base + F.aggregate("_costs", F.lit(0).cast("long"), lambda a, x: a + x) - F.col("_capped").cast("int")
    rows = rows.withColumn("_total", total)
    # the first record to go also turns false into true
    over = F.when(F.col("_total") > most, F.col("_total") - most - (~F.col("_capped")).cast("int")).otherwise(0)
    first_only = (F.col("_total") > most) & (F.size("_costs") > 0)
    rows = rows.withColumn("_gone", F.when(first_only, F.greatest(dropped(F.col("_costs"), over), F.lit(1))).otherwise(0))
    gone_before = F.lit(0)
    kept = {}
    for c in lists:
        mine = F.least(F.greatest(F.col("_gone") - gone_before, F.lit(0)), F.size(c))
        kept[c] = F.slice(c, 1, F.size(c) - mine)
        gone_before = gone_before + F.size(c)
    left = F.aggregate(F.slice("_costs", F.col("_gone") + 1, F.size("_costs")), F.lit(0).cast("long"), lambda a, x: a + x)
    rows = rows.withColumn("_cut", F.col("_capped") | (F.col("_gone") > 0))
    rows = rows.withColumn("length", base + left - F.col("_cut").cast("int")).withColumns(kept)
    ids = lambda c: F.array_distinct(F.array_compact(F.transform(c, lambda r: r["id"])))
    within = lambda refs, known: F.size(F.array_except(F.coalesce(refs, F.array().cast("array<string>")), known)) == 0
    rows = rows.withColumn("_facts", ids(facts)).withColumn("_kept", F.filter(calculations, lambda r: within(r["refs"], F.col("_facts"))))
    rows = rows.withColumn("truncated", F.col("_cut") | (F.size("_kept") < F.size(calculations))).withColumn(calculations, F.col("_kept"))
    rows = rows.withColumn("_sent", ids(calculations))
    rows = rows.withColumn(signals, F.transform(signals, lambda r: r.withField("refs", F.filter(r["refs"], lambda x: F.array_contains("_sent", x)))))
    allowed = F.array_sort(F.array_distinct(F.concat(*(ids(c) for c in lists))))
    return rows.withColumn("allowed", allowed).select(*requests.columns, "truncated", "length", "allowed")
