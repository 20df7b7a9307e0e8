"""Registered queries on requests and answers in JSON, with the SQL each must equal."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyframe.functions import json_walk
from tallyframe.operators import trimming
from tallyframe.plans.catalog import registered
from tallyframe.plans.facts import read

LISTS = ("tasks", "pending", "signals", "calculations", "facts")
CAPS = {"tasks": 4, "pending": 3, "signals": 5, "calculations": 9, "facts": 10}
MOST = 900
# Records of a customer's request, made of its orders: id, text and which orders have one.
_ID = {"tasks": "t", "pending": "p", "signals": "s", "calculations": "c", "facts": "f"}
_TEXT = {
    "tasks": "concat('{\"review_id\":\"t', o_orderkey, '\",\"why\":\"', o_orderpriority, '\"}')",
    "pending": "concat('{\"review_id\":\"p', o_orderkey, '\"}')",
    "signals": "concat('{\"signal_id\":\"s', o_orderkey, '\",\"status\":\"候选', o_orderstatus, '\"}')",
    "calculations": "concat('{\"calculation_id\":\"c', o_orderkey, '\",\"input\":\"f', o_orderkey, '\"}')",
    "facts": "concat('{\"fact_id\":\"f', o_orderkey, '\",\"value\":\"', o_orderkey * 7919 % 100003, '\"}')",
}
_HAS = {"tasks": "o_orderpriority = '5-LOW'", "pending": "o_orderpriority = '1-URGENT'", "signals": "o_orderstatus = 'F'", "calculations": "o_orderkey % 4 <> 0", "facts": "o_orderkey % 3 <> 0"}
_BASE = len('{"truncated":false,"lists":}') + 2 * len(LISTS)

_RECORDS = " UNION ALL ".join(
    f"SELECT c, {k} AS l, '{name}' AS list, o_orderkey AS o, '{_ID[name]}' || o_orderkey AS id, {_TEXT[name]} AS json, " + {"calculations": "['f' || o_orderkey, 'f' || nx]", "signals": "['c' || o_orderkey, 'c' || nx]"}.get(name, "CAST([] AS VARCHAR[])") + f" AS refs, row_number() OVER (PARTITION BY c ORDER BY o_orderkey) AS i FROM o WHERE {_HAS[name]}"
    for k, name in enumerate(LISTS)
)


@registered(f"""WITH RECURSIVE o AS (SELECT *, o_custkey AS c, coalesce(lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 0) AS nx FROM orders),
every AS ({_RECORDS}),
kept AS (SELECT *, length(json) + CAST(i > 1 AS INTEGER) AS cost, row_number() OVER (PARTITION BY c ORDER BY l, i DESC) AS k FROM every WHERE i <= CASE list {" ".join(f"WHEN '{c}' THEN {n}" for c, n in CAPS.items())} END),
sums AS (SELECT c_custkey AS c, coalesce((SELECT sum(cost) FROM kept WHERE kept.c = c_custkey), 0) + {_BASE} AS len, (SELECT count(*) FROM every WHERE every.c = c_custkey) > (SELECT count(*) FROM kept WHERE kept.c = c_custkey) AS cut FROM customer),
pop(c, k, len, cut) AS (SELECT c, CAST(0 AS BIGINT), CAST(len - CAST(cut AS INTEGER) AS BIGINT), cut FROM sums UNION ALL SELECT pop.c, kept.k, CAST(len - cost - CAST(NOT cut AS INTEGER) AS BIGINT), true FROM pop JOIN kept ON kept.c = pop.c AND kept.k = pop.k + 1 WHERE len > {MOST}),
last AS (SELECT c, max(k) AS k, min_by(len, -k) AS len, bool_or(cut) AS cut FROM pop GROUP BY c),
sent AS (SELECT kept.* FROM kept JOIN last USING (c) WHERE kept.k > last.k),
f AS (SELECT c, list(id) AS ids FROM sent WHERE list = 'facts' GROUP BY c),
good AS (SELECT sent.*, list <> 'calculations' OR list_has_all(coalesce(ids, []), refs) AS ok FROM sent LEFT JOIN f USING (c)),
cs AS (SELECT c, list(id) AS cids FROM good WHERE list = 'calculations' AND ok GROUP BY c),
agg AS (SELECT c, bool_or(NOT ok) AS lost, string_agg(id, ',' ORDER BY id) FILTER (ok) AS allowed, string_agg(id || '<' || array_to_string(list_filter(refs, lambda x: list_contains(coalesce(cids, []), x)), '+'), ',' ORDER BY i) FILTER (list = 'signals') AS signals FROM good LEFT JOIN cs USING (c) GROUP BY c)
SELECT last.c AS c_custkey, cut OR coalesce(lost, false) AS truncated, len AS length, coalesce(allowed, '') AS allowed, coalesce(signals, '') AS signals FROM last LEFT JOIN agg USING (c)""")
def request_trimming(spark, sf_dir):
    """Requests of customers made of their orders, kept to 900 characters."""
    after = F.coalesce(F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")), F.lit(0))
    orders = read(spark, sf_dir, "orders").withColumn("nx", after)
    of = lambda p: F.array(*(F.concat(F.lit(p), F.col(c).cast("string")) for c in ("o_orderkey", "nx")))
    refs = {"calculations": of("f"), "signals": of("c")}
    record = lambda c: F.struct(F.col("o_orderkey").alias("o"), F.concat(F.lit(_ID[c]), F.col("o_orderkey").cast("string")).alias("id"), F.expr(_TEXT[c]).alias("json"), refs.get(c, F.array().cast("array<string>")).alias("refs"))
    plain = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.expr(_HAS[c]), record(c)))), lambda r: F.struct(r["id"].alias("id"), r["json"].alias("json"), r["refs"].alias("refs")))
    of_customer = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(*(plain(c).alias(c) for c in LISTS))
    requests = read(spark, sf_dir, "customer").select("c_custkey").join(of_customer, "c_custkey", "left")
    out = trimming.trimmed(requests, LISTS, CAPS, F.lit(_BASE), MOST, "facts", "calculations", "signals")
    signals = F.array_join(F.transform("signals", lambda r: F.concat(r["id"], F.lit("<"), F.array_join(r["refs"], "+"))), ",")
    return out.select("c_custkey", "truncated", "length", F.array_join("allowed", ",").alias("allowed"), signals.alias("signals"))


# The same content with its keys in an order that depends on the order's key, and spaces between some.
_PARTS = ("'\"z\": {\"b\": [', o_custkey, ', {\"y\": null, \"x\": \"', o_orderstatus, '\"}], \"a\":true}'", "'\"key\" :', o_orderkey", "'\"é\": \"', o_orderpriority, '\\\\u4e2d\"'")
_ORDERS = ((0, 1, 2), (2, 1, 0), (1, 2, 0), (2, 0, 1))
_MIXED = "CASE o_orderkey % 4 " + " ".join(f"WHEN {k} THEN concat('{{ ', {', '.join(x for i, p in enumerate(o) for x in ((chr(39) + ', ' + chr(39),) if i else ()) + (_PARTS[p],))}, '}}')" for k, o in enumerate(_ORDERS)) + " END"


@registered("""WITH c AS (SELECT o_orderkey, '{"key":' || o_orderkey || ',"z":{"a":true,"b":[' || o_custkey || ',{"x":"' || o_orderstatus || '","y":null}]},"é":"' || o_orderpriority || '中"}' AS c FROM orders)
SELECT o_orderkey, c AS canonical, sha256(c) AS hash FROM c""")
def canonical_json(spark, sf_dir):
    """Objects whose keys come in four orders, as one text each."""
    text = F.expr(_MIXED)
    return read(spark, sf_dir, "orders").select("o_orderkey", json_walk.canonical(text).alias("canonical"), json_walk.content_hash(text).alias("hash"))


# A parsed report an order, with a block a line; faults by keys.
_BLOCK = """concat('{"block_index":', CASE WHEN l_partkey % 97 = 3 THEN '"1"' WHEN l_partkey % 97 = 4 THEN '-1' ELSE '1' END, ',"text":"', CASE WHEN l_partkey % 89 = 5 THEN '' ELSE l_returnflag END, '"', CASE WHEN l_suppkey % 83 = 6 THEN '' ELSE concat(',"bbox":{"x0":1,"y0":2.5,"x1":', CASE WHEN l_suppkey % 79 = 7 THEN 'null' ELSE '3' END, ',"y1":4}') END, '}')"""
_PAGE_A = """concat('{"page_number":', CASE WHEN k % 31 = 4 THEN 0 ELSE 1 END, ',"width":595.2,"height":', CASE WHEN k % 37 = 5 THEN 'true' ELSE '842' END, ',"rotation":0,"status":"', CASE WHEN k % 41 = 6 THEN 'lost' ELSE 'extracted' END, '","image_block_count":0,"limitation":', CASE WHEN k % 43 = 7 THEN '1' ELSE 'null' END, CASE WHEN k % 47 = 8 THEN '' ELSE concat(',"blocks":[', blocks, ']') END, '}')"""
_REPORT = """concat('{"pages":[', page, CASE WHEN k % 2 = 0 THEN ',{"page_number":2,"width":1,"height":1,"rotation":90,"status":"no_extractable_text","image_block_count":1,"limitation":"","blocks":[]}' ELSE '' END, '],"page_count":', CASE WHEN k % 13 = 9 THEN 3 ELSE 2 - k % 2 END, ',"ocr_applied":', CASE WHEN k % 17 = 3 THEN '0' ELSE 'false' END, ',"document_id":"d","source_sha256":"', repeat('ab', CASE WHEN k % 19 = 4 THEN 31 ELSE 32 END), '","source_filename":"f","coordinate_system":"c","coordinate_unit":"u"', CASE WHEN k % 23 = 5 THEN '' ELSE ',"coordinate_note":"n"' END, ',"extractor":"e","extractor_version":"1"', CASE WHEN k % 29 = 6 THEN ',"document_id":' WHEN k % 29 = 7 THEN ',"more":[1]' ELSE '' END, '}')"""


@registered(f"""WITH b AS (SELECT l_orderkey AS k, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i, {_BLOCK} AS block FROM lineitem),
t AS (SELECT o_orderkey AS k, coalesce(string_agg(block, ',' ORDER BY i), '') AS blocks FROM orders LEFT JOIN b ON b.k = o_orderkey GROUP BY 1),
r AS (SELECT k, {_REPORT} AS j FROM (SELECT *, {_PAGE_A} AS page FROM t)),
bf AS (SELECT k, i, 'pages[0].blocks[' || i || ']' || CASE WHEN json_extract(block, '$.bbox') IS NULL THEN '.bbox: missing' WHEN json_type(block, '$.block_index') = 'VARCHAR' THEN '.block_index: type' WHEN CAST(json_extract_string(block, '$.block_index') AS INTEGER) < 0 THEN '.block_index: value' WHEN json_extract_string(block, '$.text') = '' THEN '.text: value' WHEN json_type(block, '$.bbox.x1') = 'NULL' THEN '.bbox.x1: type' END AS fault FROM b),
first AS (SELECT k, arg_min(fault, i) AS fault FROM bf WHERE fault IS NOT NULL GROUP BY k)
SELECT r.k AS o_orderkey, CASE WHEN NOT json_valid(j) THEN 'invalid' WHEN NOT json_exists(j, '$.coordinate_note') THEN 'coordinate_note: missing' WHEN j ->> '$.pages[0].status' = 'lost' THEN 'pages[0].status: value' WHEN NOT json_exists(j, '$.pages[0].blocks') THEN 'pages[0].blocks: missing'
  WHEN json_type(j, '$.pages[0].limitation') <> 'NULL' THEN 'pages[0].limitation: type' WHEN CAST(j ->> '$.pages[0].page_number' AS INTEGER) < 1 THEN 'pages[0].page_number: value' WHEN json_type(j, '$.pages[0].height') = 'BOOLEAN' THEN 'pages[0].height: type' WHEN first.fault IS NOT NULL THEN first.fault
  WHEN CAST(j ->> '$.page_count' AS INTEGER) <> json_array_length(j, '$.pages') THEN 'page_count: value' WHEN json_type(j, '$.ocr_applied') <> 'BOOLEAN' THEN 'ocr_applied: type' WHEN length(j ->> '$.source_sha256') <> 64 THEN 'source_sha256: value' END AS fault FROM r LEFT JOIN first USING (k)""")
def parsed_report_faults(spark, sf_dir):
    """The first fault of every order's parsed report, with its path."""
    block = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.expr(_BLOCK).alias("block"))
    blocks = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda b: b["block"]), ",").alias("blocks"))
    docs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).join(blocks, "k", "left").withColumn("blocks", F.coalesce("blocks", F.lit("")))
    docs = docs.withColumn("page", F.expr(_PAGE_A)).withColumn("json", F.expr(_REPORT))
    return docs.select(F.col("k").alias("o_orderkey"), json_walk.first_fault(F.col("json"), json_walk.PARSED_REPORT).alias("fault"))
