"""Registered queries on evidence: sections, baselines, headers, verdicts, placements, manifests, with the SQL each must equal."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyframe.operators import changes, evidence
from tallyframe.plans.catalog import PAIRS, _pairs, registered
from tallyframe.plans.facts import FACTS_SQL, facts, read

# Lines as printed, by the priority of an order.
BOX = "CASE o_orderpriority WHEN '1-URGENT' THEN '√适用 □不适用' WHEN '5-LOW' THEN '□ 适用 √ 不适用' WHEN '2-HIGH' THEN '√适用 □不适用（续）' ELSE o_orderpriority END"


@registered(f"""WITH t AS (SELECT o_orderkey, regexp_replace({BOX}, '\\s+', '', 'g') AS t FROM orders)
SELECT o_orderkey, CASE WHEN t = '√适用□不适用' THEN true WHEN t = '□适用√不适用' THEN false END AS applies FROM t""")
def checkbox_choice(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", evidence.choice(F.expr(BOX)).alias("applies"))


@registered("""WITH marks AS (SELECT user_id, event_id, event_type, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS stop FROM events WHERE event_type IN ('purchase', 'error'))
SELECT e.event_id, s.event_id AS section FROM events e LEFT JOIN marks s ON s.event_type = 'purchase' AND e.user_id = s.user_id AND e.event_id >= s.event_id AND (s.stop IS NULL OR e.event_id < s.stop)""")
def section_range_join(spark, sf_dir):
    """Sections open with a purchase and end before the user's next purchase or error."""
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    stop = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    marks = events.filter("event_type IN ('purchase', 'error')").withColumn("stop", stop).filter("event_type = 'purchase'")
    sections = marks.select("user_id", F.col("event_id").alias("start"), "stop", F.col("event_id").alias("section"))
    return evidence.in_sections(events, sections, "user_id", "event_id").select("event_id", "section")


@registered("""SELECT l_orderkey, CAST(round_even(l_quantity / 4, 0) AS BIGINT) AS baseline, string_agg(l_returnflag, ' ' ORDER BY l_linenumber, l_returnflag) AS line,
  min(l_linenumber) AS x0, max(l_linenumber) AS x1, min(l_quantity / 4) AS y0, max(l_quantity / 4) AS y1 FROM lineitem GROUP BY 1, 2""")
def baseline_merge(spark, sf_dir):
    blocks = read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_quantity") / 4).alias("y"), "l_linenumber", "l_returnflag")
    return evidence.merged_baselines(blocks, "l_orderkey", "y", "l_linenumber", "l_returnflag")


@registered("""SELECT o_custkey, o_orderpriority, count(DISTINCT o_orderstatus) = 1 AS agreed, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN max(o_orderkey) END AS line FROM orders GROUP BY 1, 2""")
def header_consensus(spark, sf_dir):
    headers = read(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus", "o_orderkey", F.col("o_orderkey").alias("at"))
    return evidence.header_consensus(headers, ["o_custkey", "o_orderpriority"], "o_orderstatus", "at", "o_orderkey").withColumnRenamed("o_orderkey", "line")


@registered("""SELECT c_custkey, CASE WHEN count(o_orderkey) = 0 THEN 'not_found' WHEN count(o_orderkey) = 1 THEN 'ok' ELSE 'ambiguous' END AS status, CASE WHEN count(o_orderkey) = 1 THEN max(o_orderkey) END AS o_orderkey
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' GROUP BY 1""")
def unique_first(spark, sf_dir):
    urgent = read(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'")
    return evidence.unique_first(read(spark, sf_dir, "customer"), "c_custkey", urgent.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"), "o_orderkey")


@registered(f"""WITH {FACTS_SQL}, asked AS (SELECT entity, metric, y FROM facts UNION SELECT entity, metric, y - 1 FROM facts)
SELECT a.entity, a.metric, CAST(a.y AS INTEGER) AS y, CASE WHEN count(f.y) <> 1 THEN 'missing_or_ambiguous' WHEN bool_and(f.verified) THEN 'verified' ELSE 'conflict' END AS verdict
FROM asked a LEFT JOIN facts f ON a.entity = f.entity AND a.metric = f.metric AND a.y = f.y GROUP BY 1, 2, 3""")
def keyed_verdicts(spark, sf_dir):
    """Verdicts of both years of every fact."""
    known = facts(spark, sf_dir).select("entity", "metric", "y", F.when(F.col("verified"), "verified").otherwise("conflict").alias("verdict"))
    asked = known.select("entity", "metric", F.explode(F.array("y", F.col("y") - 1)).alias("y")).distinct()
    return evidence.keyed_verdict(asked, known, ["entity", "metric", "y"], "verdict")


@registered(f"""WITH {FACTS_SQL}, l AS (SELECT entity, y, count(*) AS n, max(value) AS v FROM facts WHERE metric IN ('revenue') GROUP BY 1, 2),
b AS (SELECT s_nationkey AS entity, year(l_shipdate) AS y, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS v FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_linestatus = 'O' OR s_nationkey % 2 = 0 GROUP BY 1, 2)
SELECT coalesce(l.entity, b.entity) AS entity, CAST(coalesce(l.y, b.y) AS INTEGER) AS y, CASE WHEN l.n IS NULL THEN 'missing_left' WHEN b.v IS NULL THEN 'missing_right' WHEN l.n > 1 THEN 'ambiguous' WHEN l.v = b.v THEN 'equal' ELSE 'conflict' END AS status
FROM l FULL JOIN b ON l.entity = b.entity AND l.y = b.y""")
def value_reconciliation(spark, sf_dir):
    """Stated revenue against the sum of the lines; odd nations sum their open lines only."""
    stated = facts(spark, sf_dir).filter("metric = 'revenue'").select("entity", "y", "value")
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "supplier"), F.expr("l_suppkey = s_suppkey")).filter("l_linestatus = 'O' OR s_nationkey % 2 = 0")
    summed = lines.groupBy(F.col("s_nationkey").alias("entity"), F.year("l_shipdate").alias("y")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(20,2)").alias("value"))
    return evidence.reconciled(stated, summed, ["entity", "y"], "value")


@registered(PAIRS + """SELECT entity, year, CASE WHEN count(*) FILTER (pair_status = 'unverified_fact') > 0 THEN 'verification_failed' WHEN count(*) FILTER (pair_status = 'succeeded') = count(*) THEN 'completed' ELSE 'completed_with_issues' END AS status
FROM ladder GROUP BY 1, 2""")
def run_status_rollup(spark, sf_dir):
    ladder = changes.annual_changes(_pairs(spark, sf_dir))
    return ladder.groupBy("entity", "year").agg(evidence.run_status("pair_status", "succeeded", "unverified_fact").alias("status"))


_ID = "CASE WHEN k > 0 THEN concat(user_id, '-', event_type) END AS id"
_VALUE = "CASE WHEN k % 10 = 3 THEN concat(k, '.5') ELSE concat(k, '') END AS value"


@registered(f"""WITH s AS (SELECT {_ID}, {_VALUE} FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)),
g AS (SELECT coalesce(id, '') AS id, count(*) AS n, bool_or(contains(value, '.')) AS f FROM s GROUP BY 1)
SELECT id, n, concat_ws(',', CASE WHEN id = '' THEN 'missing_id' END, CASE WHEN id <> '' AND n > 1 THEN 'duplicate_id' END, CASE WHEN f THEN 'float_value' END) AS issues FROM g""")
def signal_issues(spark, sf_dir):
    events = read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return evidence.signal_issues(events.selectExpr(_ID, _VALUE), "id", "value")


@registered("""WITH f AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_suppkey)) AS e, bool_and(l_returnflag <> 'R') AS v FROM lineitem GROUP BY 1),
c AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_suppkey)) AS e FROM lineitem WHERE l_quantity > 5 GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'interpretations' WHEN f.v AND f.e = coalesce(c.e, []) THEN 'verified_claims' ELSE 'pending' END AS place FROM orders LEFT JOIN f ON f.k = o_orderkey LEFT JOIN c ON c.k = o_orderkey""")
def claim_placement(spark, sf_dir):
    """An order claims the suppliers of its lines of more than five pieces; its facts are all its lines."""
    items = read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    lines = items.select("o_orderkey", F.col("l_suppkey").alias("evidence"), (F.col("l_returnflag") != "R").alias("verified"))
    cited = items.filter("l_quantity > 5").groupBy("o_orderkey").agg(F.collect_set("l_suppkey").alias("cited"))
    kind = F.when(F.col("o_orderpriority") == "5-LOW", "interpretation").otherwise("fact").alias("kind")
    claims = read(spark, sf_dir, "orders").select("o_orderkey", kind).join(cited, "o_orderkey", "left").withColumn("cited", F.coalesce("cited", F.array().cast("array<long>")))
    return evidence.claim_places(claims, lines, "o_orderkey").select("o_orderkey", "place")


@registered("""SELECT l_orderkey, body, sha256(body) AS sha256 FROM (SELECT l_orderkey, CAST(to_json(list({'l_linenumber': l_linenumber, 'l_partkey': l_partkey, 'l_suppkey': l_suppkey, 'flag': nullif(l_returnflag, 'N')}
  ORDER BY l_linenumber, l_partkey, l_suppkey)) AS VARCHAR) AS body FROM lineitem GROUP BY 1)""")
def order_manifest(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem").withColumn("flag", F.nullif("l_returnflag", F.lit("N")))
    return evidence.manifest(items, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "flag")
