"""Registered queries on amounts under headings and labels made of fragments, with the SQL each must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import alignment
from tallyframe.plans.catalog import registered
from tallyframe.plans.facts import read

_ROWS = """WITH h AS (SELECT o_orderkey, unnest([1, 2, 3]) AS k, unnest([100 + o_custkey % 9, 220 + o_custkey % 7, 340 - o_custkey % 5]) AS hx, unnest([2024, 2023 - CAST(o_custkey % 11 = 0 AS INTEGER), 2022]) AS year, 440 + o_custkey % 30 AS l, 500 AS r FROM orders),
a AS (SELECT l_orderkey AS o_orderkey, 80 + l_partkey * 37 % 410 AS ax, format('{:.2f}', l_extendedprice) || '-' || l_linenumber || '-' || l_suppkey AS raw FROM lineitem)"""


def _rows(spark, sf_dir):
    """One row an order: three year headings by its customer, its lines as amounts along the row, and a percentage band."""
    key = F.col("o_custkey")
    struct = lambda x, year: F.struct(x.alias("x"), year.cast("int").alias("year"))
    headings = F.array(struct(100 + key % 9, F.lit(2024)), struct(220 + key % 7, 2023 - (key % 11 == 0).cast("int")), struct(340 - key % 5, F.lit(2022)))
    raw = F.concat_ws("-", F.format_string("%.2f", "l_extendedprice"), "l_linenumber", "l_suppkey")
    amounts = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct((80 + F.col("l_partkey") * 37 % 410).alias("x"), raw.alias("raw"))).alias("amounts"))
    return read(spark, sf_dir, "orders").select("o_orderkey", headings.alias("headings"), (440 + key % 30).alias("left")).join(amounts, "o_orderkey", "left")


@registered(_ROWS + """, near AS (SELECT o_orderkey, raw, arg_min(k, abs(hx - ax) * 1000 + hx) AS k, min(abs(hx - ax)) AS far FROM a JOIN h USING (o_orderkey) WHERE NOT ax BETWEEN l - 3 AND r + 3 GROUP BY o_orderkey, raw, ax),
c AS (SELECT h.o_orderkey, h.k, hx, year, count(raw) AS n, max(raw) AS raw FROM h LEFT JOIN near USING (o_orderkey, k) GROUP BY ALL),
f AS (SELECT o_orderkey, max(far) AS far FROM near GROUP BY 1)
SELECT c.o_orderkey, CASE WHEN any_value(far) > 58 THEN 'no_heading' WHEN max(n) > 1 THEN 'claimed_twice' WHEN min(n) < 1 THEN 'unclaimed' END AS fault, CASE WHEN coalesce(any_value(far), 0) <= 58 AND max(n) = 1 AND min(n) = 1 THEN string_agg(raw, ' ' ORDER BY year, hx) END AS amounts
FROM c LEFT JOIN f USING (o_orderkey) GROUP BY 1""")
def amounts_one_each(spark, sf_dir):
    rows = _rows(spark, sf_dir).withColumn("amounts", F.coalesce("amounts", F.from_json(F.lit("[]"), "array<struct<x:bigint,raw:string>>")))
    out = alignment.one_each(F.col("headings"), F.col("amounts"), F.col("left"), F.lit(500)).alias("r")
    return rows.select("o_orderkey", out).select("o_orderkey", "r.fault", F.array_join("r.amounts", " ").alias("amounts"))


@registered(_ROWS + """, near AS (SELECT o_orderkey, raw, ax, arg_min(k, abs(hx - ax) * 1000 + hx) AS k FROM a JOIN h USING (o_orderkey) GROUP BY o_orderkey, raw, ax),
y AS (SELECT o_orderkey, any_value(k) AS k FROM h WHERE year = 2023 GROUP BY 1 HAVING count(*) = 1),
n AS (SELECT o_orderkey, max(raw) AS amount FROM near JOIN y USING (o_orderkey, k) GROUP BY 1 HAVING count(*) = 1)
SELECT o_orderkey, amount FROM orders LEFT JOIN n USING (o_orderkey)""")
def amount_of_year(spark, sf_dir):
    return _rows(spark, sf_dir).select("o_orderkey", alignment.amount_of_year(F.col("headings"), F.col("amounts"), F.lit(2023)).alias("amount"))


@registered("""WITH RECURSIVE l AS (SELECT c_custkey, c_name || c_mktsegment AS label, c_custkey % 5 + 1 AS cut, c_custkey % 13 AS s FROM customer),
f AS (SELECT c_custkey, label, unnest([CASE WHEN s = 6 THEN 'q' ELSE substr(label, 1, cut) END, CASE WHEN s = 0 THEN 'x' ELSE substr(label, 1, cut + 3) END, substr(label, cut + 1, 3), substr(label, cut + 4, 9), CASE WHEN s = 1 THEN '' WHEN s = 2 THEN NULL ELSE substr(label, cut + 4, 9) END, CASE WHEN s IN (5, 9) THEN 'y' ELSE substr(label, cut + 13) END, CASE WHEN s = 9 THEN 'z' WHEN s > 9 THEN substr(label, 1, 2) ELSE substr(label, cut + 4) END]) AS f, generate_subscripts([1, 2, 3, 4, 5, 6, 7], 1) - 1 AS i FROM l),
tries(c_custkey, label, made, i, mask) AS (SELECT c_custkey, label, '', -1, 0 FROM l UNION ALL SELECT f.c_custkey, f.label, made || f, f.i, mask + (1 << f.i) FROM tries JOIN f ON f.c_custkey = tries.c_custkey AND f.i > tries.i WHERE f <> ''),
best AS (SELECT c_custkey, min(mask) AS mask FROM tries WHERE made = label GROUP BY 1)
SELECT c_custkey, CASE WHEN mask IS NOT NULL THEN array_to_string(list_filter(range(7), lambda i: (mask >> i) & 1 = 1), ',') END AS places FROM l LEFT JOIN best USING (c_custkey)""")
def label_from_fragments(spark, sf_dir):
    """Names of customers, cut up into seven fragments of which some repeat, overlap or do not belong."""
    label, cut, s = F.concat("c_name", "c_mktsegment"), (F.col("c_custkey") % 5 + 1).cast("int"), F.col("c_custkey") % 13
    part = lambda a, n: F.substring(F.col("label"), a, F.lit(n) if isinstance(n, int) else n)
    rows = read(spark, sf_dir, "customer").select("c_custkey", label.alias("label"), cut.alias("cut"), s.alias("s"))
    c = F.col("cut")
    fragments = F.array(
        F.when(F.col("s") == 6, "q").otherwise(part(F.lit(1), c)), F.when(F.col("s") == 0, "x").otherwise(part(F.lit(1), c + 3)), part(c + 1, 3), part(c + 4, 9),
        F.when(F.col("s") == 1, "").when(F.col("s") == 2, None).otherwise(part(c + 4, 9)), F.when(F.col("s").isin(5, 9), "y").otherwise(part(c + 13, 99)), F.when(F.col("s") == 9, "z").when(F.col("s") > 9, part(F.lit(1), 2)).otherwise(part(c + 4, 99)),
    )
    return rows.select("c_custkey", F.array_join(alignment.subset_making(fragments, F.col("label")), ",").alias("places"))
