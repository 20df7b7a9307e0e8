"""Registered queries on words of pages and answers of models, with the SQL each must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import tokens
from tallyframe.plans.catalog import registered
from tallyframe.plans.facts import read


@registered("SELECT l_orderkey, string_agg(l_returnflag, ' ' ORDER BY l_linenumber, l_returnflag) AS page_text FROM lineitem WHERE l_quantity % 3 = 1 GROUP BY 1")
def page_text(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").withColumn("page", F.col("l_quantity") % 3)
    return tokens.page_text(lines, "l_orderkey", "page", 1, "l_linenumber", "l_returnflag")


@registered("""SELECT o_orderkey AS box, coalesce(string_agg(l_returnflag, ' ' ORDER BY l_quantity, l_linenumber, l_returnflag), '') AS clip
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber BETWEEN 2 AND 5 AND l_quantity BETWEEN 10 AND 10 + o_custkey % 30 GROUP BY 1""")
def clip_text(spark, sf_dir):
    words = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS page", "l_linenumber AS x", "l_quantity AS y", "l_returnflag AS word")
    boxes = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS box", "o_orderkey AS page", "2 AS x0", "5 AS x1", "10D AS y0", "10D + o_custkey % 30 AS y1")
    return tokens.clip_text(boxes, words, "page").select("box", "clip")


_TOKEN = "CASE WHEN l_returnflag = 'R' AND l_suppkey % 2 = 0 THEN '-' WHEN l_returnflag = 'R' THEN ')' WHEN l_returnflag = 'A' THEN '(' ELSE concat(l_partkey, '.00') END"


@registered(f"""WITH t AS (SELECT l_orderkey, l_linenumber * 20 AS x0, l_linenumber * 20 + l_quantity % 20 AS x1, {_TOKEN} AS token FROM lineitem),
n AS (SELECT *, CASE WHEN x0 - lag(x1) OVER w <= 8 THEN lag(token) OVER w END AS b, CASE WHEN lead(x0) OVER w - x1 <= 8 THEN lead(token) OVER w END AS a FROM t WINDOW w AS (PARTITION BY l_orderkey ORDER BY x0, x1, token))
SELECT l_orderkey, x0, CASE WHEN coalesce(b, '') = '(' THEN CASE WHEN a = ')' THEN '(' || token || ')' END WHEN coalesce(a, '') = ')' THEN NULL WHEN b = '-' THEN '-' || token ELSE token END AS amount
FROM n WHERE token LIKE '%.00'""")
def joined_amounts(spark, sf_dir):
    words = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber * 20 AS x0", "l_linenumber * 20 + l_quantity % 20 AS x1", f"{_TOKEN} AS token")
    return tokens.joined_amounts(words, ["l_orderkey"], 8)


_ANSWER = """CASE WHEN o_orderkey % 11 = 0 THEN concat('{"opinion": "', o_orderkey) WHEN o_orderkey % 11 = 1 THEN '{"opinion": "high", "refs": [1], "score": 2}'
  ELSE concat('{"opinion": "', CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE substr(o_orderpriority, 3) END, '", "refs": [', o_custkey % 7, ', ', o_orderkey % 5, CASE WHEN o_custkey % 5 = 0 THEN ', 8, 9' ELSE '' END, ']}') END"""


@registered(f"""WITH t AS (SELECT o_orderkey, {_ANSWER} AS a FROM orders),
p AS (SELECT o_orderkey, json_valid(a) AS valid, CASE WHEN json_valid(a) THEN list_sort(json_keys(a)) END AS k, CASE WHEN json_valid(a) THEN a ->> '$.opinion' END AS o, CASE WHEN json_valid(a) THEN CAST(json_extract(a, '$.refs') AS BIGINT[]) END AS r FROM t)
SELECT o_orderkey, CASE WHEN NOT valid THEN 'invalid_json' WHEN k <> ['opinion', 'refs'] THEN 'wrong_keys' WHEN length(o) > 10 THEN 'too_long' WHEN regexp_matches(o, '[0-9]') THEN 'digits' WHEN len(r) > 3 THEN 'too_many'
  WHEN len(list_distinct(r)) < len(r) THEN 'duplicate_id' WHEN len(list_filter(r, lambda x: NOT list_contains([0, 1, 2, 3, 4], x))) > 0 THEN 'unknown_id' ELSE 'ok' END AS issue FROM p""")
def answer_issues(spark, sf_dir):
    allowed = F.array(*(F.lit(i).cast("long") for i in range(5)))
    return read(spark, sf_dir, "orders").select("o_orderkey", tokens.answer_issue(F.expr(_ANSWER), allowed, 10, 3).alias("issue"))


@registered("""WITH c AS (SELECT l_orderkey, l_linenumber AS n, l_partkey AS id, l_partkey % 3 + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS v FROM lineitem WHERE l_quantity > 25),
j AS (SELECT c.*, p_partkey, p_size > 10 AS ok, p_partkey % 3 AS w, lag(id) OVER (PARTITION BY l_orderkey ORDER BY n, id) AS before FROM c LEFT JOIN part ON p_partkey = id AND p_size > 5)
SELECT l_orderkey, CASE WHEN bool_or(p_partkey IS NULL) THEN 'missing' WHEN bool_or(coalesce(before >= id, false)) THEN 'unordered' WHEN NOT bool_and(ok) THEN 'unverified' WHEN bool_or(v <> w) THEN 'value_mismatch' ELSE 'ok' END AS fault FROM j GROUP BY 1""")
def cited_analyses(spark, sf_dir):
    """Orders cite the parts of their lines of more than 25 pieces; analyses of small parts are not confirmed."""
    value = F.col("id") % 3 + F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    cited = read(spark, sf_dir, "lineitem").filter("l_quantity > 25").select("l_orderkey", F.col("l_linenumber").alias("ordinal"), F.col("l_partkey").alias("id"), "l_returnflag").withColumn("value", value)
    confirmed = read(spark, sf_dir, "part").filter("p_size > 5").selectExpr("p_partkey AS id", "p_partkey % 3 AS value", "p_size > 10 AS verified")
    return tokens.cited_analyses(cited, confirmed, "l_orderkey")
