"""Registered queries of the reference's operators with the SQL each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions import text as T
from tallyframe.operators import changes, ordered, relations, rules
from tallyframe.plans.facts import FACTS_SQL, facts, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def registered(sql: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are named {f.__name__}")
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.pairs(facts(spark, sf_dir), 1996, 2000)


PAIRS = (
    "WITH "
    + FACTS_SQL
    + """,
sides AS (SELECT *, y AS year, true AS cur FROM facts UNION ALL SELECT *, y + 1, false FROM facts),
paired AS (SELECT entity, metric, CAST(year AS INTEGER) AS year, count(*) FILTER (cur) AS n_cur, count(*) FILTER (NOT cur) AS n_pri, max(value) FILTER (cur) AS c, max(value) FILTER (NOT cur) AS p,
  min(currency) <> max(currency) AS mixed, bool_or(restatement = 'restated') AS restated, bool_and(verified) AS verified FROM sides WHERE year BETWEEN 1996 AND 2000 GROUP BY 1, 2, 3),
usable AS (SELECT * FROM paired WHERE n_cur = 1 AND n_pri = 1 AND NOT mixed AND verified AND NOT restated),
ladder AS (SELECT *, CASE WHEN n_cur = 0 OR n_pri = 0 THEN 'missing_fact' WHEN n_cur > 1 OR n_pri > 1 THEN 'duplicate_fact' WHEN mixed THEN 'incompatible_facts' WHEN NOT verified THEN 'unverified_fact' WHEN restated THEN 'restated_fact' ELSE 'succeeded' END AS pair_status FROM paired)
"""
)
WIDE = PAIRS + """, wide AS (SELECT entity, year, """ + ", ".join(f"max({s}) FILTER (metric = '{m}' AND ok) AS {m}_{s}" for m in ("revenue", "cost_of_goods_sold", "net_profit_parent", "operating_cash_flow", "accounts_receivable_net", "inventory_net", "net_profit_ex") for s in "cp") + """
  FROM (SELECT *, n_cur = 1 AND n_pri = 1 AND NOT mixed AND verified AND NOT restated AS ok FROM paired) GROUP BY 1, 2)
"""
GAP = "CASE WHEN {a}_p > 0 AND {b}_p > 0 THEN CAST(5 * ({a}_c - {a}_p) AS DECIMAL(19,2)) * CAST({b}_p AS DECIMAL(19,2)) - CAST(5 * ({b}_c - {b}_p) AS DECIMAL(19,2)) * CAST({a}_p AS DECIMAL(19,2)) >= CAST({a}_p AS DECIMAL(19,2)) * CAST({b}_p AS DECIMAL(19,2)) END"
RECEIVABLE, INVENTORY = GAP.format(a="accounts_receivable_net", b="revenue"), GAP.format(a="inventory_net", b="cost_of_goods_sold")
PROFIT_CASH = "net_profit_parent_c > 0 AND operating_cash_flow_c < 0"
SHARE = "CASE WHEN net_profit_parent_c > 0 AND net_profit_parent_p > 0 THEN abs(net_profit_parent_c - net_profit_ex_c) >= 0.30 * net_profit_parent_c END"


@registered(PAIRS + "SELECT entity, metric, year, pair_status, CASE WHEN pair_status = 'succeeded' THEN CAST(c - p AS DECIMAL(20,2)) END AS difference FROM ladder")
def annual_difference(spark, sf_dir):
    return changes.annual_changes(_pairs(spark, sf_dir)).select("entity", "metric", "year", "pair_status", "difference")


@registered(PAIRS + "SELECT entity, metric, year, CASE WHEN pair_status = 'succeeded' AND p <= 0 THEN 'nonpositive_base' ELSE pair_status END AS rate_status, CAST(round(CASE WHEN pair_status = 'succeeded' AND p > 0 THEN CAST(c - p AS DOUBLE) / CAST(p AS DOUBLE) END, 8) AS DECIMAL(20,8)) AS rate FROM ladder")
def annual_yoy_rate(spark, sf_dir):
    return changes.annual_changes(_pairs(spark, sf_dir)).select("entity", "metric", "year", "rate_status", "rate")


@registered(PAIRS + ", s AS (SELECT *, CASE WHEN n_cur > 1 OR n_pri > 1 THEN 'duplicate_fact' WHEN n_cur = 0 THEN 'missing_current' WHEN n_pri = 0 THEN 'missing_prior' WHEN mixed THEN 'incompatible_facts' WHEN p = 0 THEN 'zero_prior' ELSE 'ok' END AS status FROM paired) SELECT entity, metric, year, status, CASE WHEN status = 'ok' THEN CAST(c - p AS DECIMAL(20,2)) END AS difference, CAST(round(CASE WHEN status = 'ok' THEN CAST(c - p AS DOUBLE) / CAST(p AS DOUBLE) END, 8) AS DECIMAL(20,8)) AS rate FROM s")
def legacy_annual_change(spark, sf_dir):
    return changes.legacy_changes(_pairs(spark, sf_dir))


@registered(PAIRS + "SELECT metric, pair_status, count(*) AS n FROM ladder WHERE pair_status <> 'succeeded' GROUP BY 1, 2")
def pairing_issues(spark, sf_dir):
    return changes.annual_changes(_pairs(spark, sf_dir)).filter("pair_status <> 'succeeded'").groupBy("metric", "pair_status").agg(F.count("*").alias("n"))


DIVERGE = "SELECT entity, year, CASE WHEN {m}_c - {m}_p IS NULL OR operating_cash_flow_c IS NULL THEN 'abstained' WHEN {m}_c > {m}_p AND operating_cash_flow_c < operating_cash_flow_p THEN 'candidate' ELSE 'not_triggered' END AS state, CAST({m}_c - {m}_p AS DECIMAL(20,2)) AS left_difference, CAST(operating_cash_flow_c - operating_cash_flow_p AS DECIMAL(20,2)) AS right_difference FROM wide"


@registered(WIDE + DIVERGE.format(m="net_profit_parent"))
def divergence_profit_cash(spark, sf_dir):
    return rules.divergence(rules.wide(_pairs(spark, sf_dir)), "net_profit_parent")


@registered(WIDE + DIVERGE.format(m="revenue"))
def divergence_revenue_cash(spark, sf_dir):
    return rules.divergence(rules.wide(_pairs(spark, sf_dir)), "revenue")


@registered(WIDE + ", r AS (SELECT *, CASE WHEN net_profit_parent_c IS NULL OR operating_cash_flow_c IS NULL THEN 'missing' WHEN net_profit_parent_c <= 0 THEN 'nonpositive_denominator' ELSE 'ok' END AS state FROM wide) SELECT entity, year, state, CAST(round(CASE WHEN state = 'ok' THEN CAST(operating_cash_flow_c AS DOUBLE) / CAST(net_profit_parent_c AS DOUBLE) END, 8) AS DECIMAL(20,8)) AS ratio FROM r")
def cash_to_profit_ratio(spark, sf_dir):
    return rules.cash_to_profit(rules.wide(_pairs(spark, sf_dir)))


def _rule(sql: str, column: Callable) -> tuple[str, Query]:
    return WIDE + f"SELECT entity, year, {sql} AS triggered FROM wide", lambda spark, sf_dir: rules.wide(_pairs(spark, sf_dir)).select("entity", "year", column().alias("triggered"))


for _name, _sql, _column in (
    ("rule_profit_cash", PROFIT_CASH, rules.profit_cash_rule),
    ("rule_ex_nonrecurring", SHARE, rules.share_rule),
    ("rule_receivable_gap", RECEIVABLE, lambda: rules.gap_rule("accounts_receivable_net", "revenue")),
    ("rule_inventory_gap", INVENTORY, lambda: rules.gap_rule("inventory_net", "cost_of_goods_sold")),
):
    SQL[_name], QUERIES[_name] = _rule(_sql, _column)


@registered(WIDE + f", r AS (SELECT entity, year, {PROFIT_CASH} AS rule_1, {SHARE} AS rule_2, {RECEIVABLE} AS rule_3, {INVENTORY} AS rule_4 FROM wide) SELECT *, CAST(25 * (CAST(rule_1 AS INTEGER) + CAST(rule_2 AS INTEGER) + CAST(rule_3 AS INTEGER) + CAST(rule_4 AS INTEGER)) AS INTEGER) AS total FROM r")
def rule_total_score(spark, sf_dir):
    return rules.scored(rules.wide(_pairs(spark, sf_dir)))


@registered("SELECT o_custkey, count(*) AS n_orders, min(o_orderstatus) = max(o_orderstatus) AS one_status FROM orders GROUP BY 1")
def basis_agreement(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"), (F.min("o_orderstatus") == F.max("o_orderstatus")).alias("one_status"))


@registered("SELECT text, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return relations.duplicated(read(spark, sf_dir, "documents").select("text"), "text")


@registered("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 20)")
def dangling_refs(spark, sf_dir):
    known = read(spark, sf_dir, "supplier").filter("s_nationkey < 20")
    return relations.dangling(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), "l_suppkey", known, "s_suppkey").select("l_orderkey", "l_linenumber")


@registered("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def uncited_documents(spark, sf_dir):
    return relations.dangling(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", read(spark, sf_dir, "labels"), "doc_id")


@registered("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def cited_documents(spark, sf_dir):
    return relations.cited(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", read(spark, sf_dir, "labels").filter("quality = 1"))


@registered("WITH e AS (SELECT event_id, value, abs(value - 10) AS a, abs(value - 50) AS b, abs(value - 100) AS c FROM events) SELECT event_id, CASE WHEN least(a, b, c) > 30 THEN NULL WHEN a <= b AND a <= c THEN 0 WHEN b <= c THEN 1 ELSE 2 END AS centre FROM e")
def nearest_column(spark, sf_dir):
    return relations.nearest_centre(read(spark, sf_dir, "events").select("event_id", "value"), "value", [10.0, 50.0, 100.0], 30.0).select("event_id", "centre")


@registered("SELECT a.event_id, (SELECT b.event_id FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND (b.ts, b.event_id) > (a.ts, a.event_id) AND epoch(b.ts)::BIGINT - epoch(a.ts)::BIGINT <= 86400 ORDER BY b.ts, b.event_id LIMIT 1) AS stop_id, a.user_id FROM events a WHERE a.event_type = 'signup'")
def forward_asof(spark, sf_dir):
    return relations.next_within(read(spark, sf_dir, "events"), "signup", "purchase", 86400)


@registered("SELECT p.p_partkey, count(e.event_id) AS n_events, min(e.event_id) AS first_event, count(*) FILTER (e.event_type = 'error') AS n_errors FROM part p LEFT JOIN events e ON e.value BETWEEN p.p_size - 0.25 AND p.p_size + 0.25 GROUP BY p.p_partkey")
def band_join(spark, sf_dir):
    """All parts with all events of their band. The band becomes an equi-join on the nearest whole size, and events are
    gathered by size before they meet parts, so neither side's pairs are made."""
    size = F.round("value").cast("int")
    near = read(spark, sf_dir, "events").select("event_id", "event_type", "value", size.alias("p_size")).filter("value BETWEEN p_size - 0.25 AND p_size + 0.25")
    of_size = near.groupBy("p_size").agg(F.count("*").alias("n_events"), F.min("event_id").alias("first_event"), F.count_if(F.col("event_type") == "error").alias("n_errors"))
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_size").join(of_size, "p_size", "left")
    return parts.select("p_partkey", F.coalesce("n_events", F.lit(0)).alias("n_events"), "first_event", F.coalesce("n_errors", F.lit(0)).alias("n_errors"))


@registered("SELECT e.event_id, count(*) AS n_parts, min(p.p_partkey) AS first_part FROM events e JOIN part p ON e.value BETWEEN p.p_size - 0.25 AND p.p_size + 0.25 GROUP BY e.event_id")
def band_join_all(spark, sf_dir):
    """All events with all parts of the band: parts are gathered by size first, of which an event's band holds one at most."""
    events = read(spark, sf_dir, "events").select("event_id", "value", F.round("value").cast("int").alias("p_size"))
    sizes = read(spark, sf_dir, "part").groupBy("p_size").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))
    met = events.join(sizes, "p_size").filter("value BETWEEN p_size - 0.25 AND p_size + 0.25")
    return met.groupBy("event_id").agg(F.sum("n").alias("n_parts"), F.min("first").alias("first_part"))


@registered("SELECT CAST(round_even(value, 0) AS BIGINT) AS band, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1")
def row_band_clusters(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.bround("value").cast("bigint").alias("band")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@registered("SELECT doc_id, CAST(i - 1 AS INTEGER) AS line, parts[i] AS text FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))")
def lines_explode(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("line", "text"))


@registered("WITH l AS (SELECT doc_id, i, parts[i] AS text FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))), s AS (SELECT doc_id, i, length(text) < 40 AS stop FROM l) SELECT doc_id, count(*) AS n_lines FROM (SELECT doc_id, i, max(stop::INT) OVER (PARTITION BY doc_id ORDER BY i) AS stopped FROM s) WHERE stopped = 0 GROUP BY 1")
def table_body_takewhile(spark, sf_dir):
    """Lines before the first short one: a position in each document's own array, no shuffle."""
    d = read(spark, sf_dir, "documents").select("doc_id", T.lines(F.col("text")).alias("lines"))
    stop = F.array_position(F.transform("lines", lambda x: F.length(x) < 40), True)
    return d.select("doc_id", F.when(stop > 0, stop - 1).otherwise(F.size("lines")).cast("bigint").alias("n_lines")).filter("n_lines > 0")


@registered("SELECT doc_id, regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', '', 'g') AS compacted FROM documents")
def compact_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.compact(F.col("text")).alias("compacted"))


@registered(f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{T.AMOUNT}')) AS INTEGER) AS n_amounts FROM documents")
def amount_tokens(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.size(T.amounts(F.col("text"))).alias("n_amounts"))


@registered("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL WHEN o_orderkey % 3 = 1 THEN -CAST(o_totalprice AS DECIMAL(20,2)) ELSE CAST(o_totalprice AS DECIMAL(20,2)) END AS amount FROM orders")
def amount_parse(spark, sf_dir):
    token = F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    shown = F.expr("o_orderkey % 3")
    written = F.when(shown == 1, F.concat(F.lit("("), token, F.lit(")"))).when(shown == 2, F.concat(F.lit("(-"), token, F.lit(")"))).otherwise(token)
    return read(spark, sf_dir, "orders").select("o_orderkey", T.parse_amount(written).cast("decimal(20,2)").alias("amount"))


SCORE = "4 * contains(lower(text), 'cash')::INT + 3 * contains(text, 'the')::INT + 2 * (contains(text, 'of') AND contains(text, 'is'))::INT + contains(text, 'and')::INT"


@registered(f"SELECT lang, doc_id, score FROM (SELECT lang, doc_id, {SCORE} AS score, row_number() OVER (PARTITION BY lang ORDER BY {SCORE} DESC, doc_id) AS r FROM documents) WHERE r <= 5")
def keyword_score_topk(spark, sf_dir):
    """Top five a language: the limit is the feature. Rank limits are pushed before the shuffle."""
    text = F.col("text")
    has = lambda w: text.contains(w).cast("int")
    score = 4 * F.lower(text).contains("cash").cast("int") + 3 * has("the") + 2 * (text.contains("of") & text.contains("is")).cast("int") + has("and")
    rows = read(spark, sf_dir, "documents").select("lang", "doc_id", score.alias("score"))
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), "doc_id"))).filter("r <= 5").drop("r")


@registered("SELECT doc_id, 'nctx-' || substr(sha256(source || chr(10) || doc_id || chr(10) || text), 1, 20) AS evidence_id FROM documents")
def evidence_id_hash(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.evidence_id("nctx-", F.col("source"), F.col("doc_id").cast("string"), F.col("text")).alias("evidence_id"))


@registered("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint", {"mode": "FAILFAST"})["k"].alias("k"))


@registered("SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS n FROM events GROUP BY 1")
def job_latest_state(spark, sf_dir):
    return relations.latest_state(read(spark, sf_dir, "events"))


@registered("SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'error') > 20 THEN 'failed' WHEN count(*) FILTER (event_type = 'purchase') = 0 THEN 'abstained' ELSE 'passed' END AS status FROM events GROUP BY 1")
def job_status_rollup(spark, sf_dir):
    return relations.rolled_up(read(spark, sf_dir, "events"), "user_id", "event_type", "error", 20, "purchase")


@registered("SELECT lang, count(*) FILTER (quality = 1 AND toxic = 0) AS accepted, count(*) FILTER (quality = 0) AS rejected, count(*) FILTER (quality = 1 AND toxic = 1) AS abstained, CAST(round(count(*) FILTER (quality = 0) / count(*), 6) AS DECIMAL(20,6)) AS rejected_rate FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def confusion_metrics(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang").agg(
        F.count_if(F.expr("quality = 1 AND toxic = 0")).alias("accepted"),
        F.count_if(F.expr("quality = 0")).alias("rejected"),
        F.count_if(F.expr("quality = 1 AND toxic = 1")).alias("abstained"),
        F.round(F.try_divide(F.count_if(F.expr("quality = 0")), F.count("*")), 6).cast("decimal(20,6)").alias("rejected_rate"),
    )


@registered("SELECT event_type, count(*) AS n, CAST(round(median(value), 6) AS DECIMAL(20,6)) AS median_value FROM events GROUP BY 1")
def median_timing(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.median("value"), 6).cast("decimal(20,6)").alias("median_value"))


@registered(PAIRS + "SELECT entity, metric, year, metric || ' of ' || entity || ' in ' || year || ' is ' || CAST(c AS VARCHAR) || ' ' || 'CNY' AS claim FROM usable")
def claim_text_render(spark, sf_dir):
    usable = _pairs(spark, sf_dir).filter("n_cur = 1 AND n_pri = 1 AND NOT mixed AND verified AND NOT restated")
    return usable.select("entity", "metric", "year", F.concat("metric", F.lit(" of "), F.col("entity").cast("string"), F.lit(" in "), F.col("year").cast("string"), F.lit(" is "), F.col("cur_value").cast("string"), F.lit(" CNY")).alias("claim"))


@registered(
    PAIRS
    + """SELECT l.entity, l.metric, l.year, (CASE WHEN l.entity % 4 = 1 THEN l.c - l.p + 1 ELSE l.c - l.p END) = now.value - before.value AS agrees
 FROM ladder l JOIN facts now ON now.entity = l.entity AND now.metric = l.metric AND now.y = l.year JOIN facts before ON before.entity = l.entity AND before.metric = l.metric AND before.y = l.year - 1 WHERE pair_status = 'succeeded'"""
)
def independent_recompute(spark, sf_dir):
    """Differences, some with an injected error, against amounts read again from the facts and not from the producer."""
    told = changes.annual_changes(_pairs(spark, sf_dir)).filter("pair_status = 'succeeded'").withColumn("told", F.expr("CASE WHEN entity % 4 = 1 THEN difference + 1 ELSE difference END"))
    own = facts(spark, sf_dir).select("entity", "metric", "y", "value")
    now, before = own.select("entity", "metric", F.col("y").alias("year"), F.col("value").alias("now")), own.select("entity", "metric", (F.col("y") + 1).alias("year"), F.col("value").alias("before"))
    return told.join(now, ["entity", "metric", "year"]).join(before, ["entity", "metric", "year"]).select("entity", "metric", "year", (F.col("told") == F.col("now") - F.col("before")).alias("agrees"))


@registered(PAIRS + "SELECT CASE WHEN pair_status = 'succeeded' THEN 'confirmed' WHEN pair_status IN ('incompatible_facts', 'restated_fact', 'duplicate_fact') THEN 'pending_review' ELSE 'gap' END AS section, count(*) AS n, count(DISTINCT entity) AS entities FROM ladder GROUP BY 1")
def placement_partition(spark, sf_dir):
    section = F.when(F.col("pair_status") == "succeeded", "confirmed").when(F.col("pair_status").isin("incompatible_facts", "restated_fact", "duplicate_fact"), "pending_review").otherwise("gap")
    return changes.annual_changes(_pairs(spark, sf_dir)).groupBy(section.alias("section")).agg(F.count("*").alias("n"), F.count_distinct("entity").alias("entities"))


@registered("WITH o AS (SELECT l_orderkey, list(DISTINCT l_suppkey) AS s, list(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1) SELECT l_orderkey, CAST(len(s) AS INTEGER) AS suppliers, list_has_any(s, [1, 2, 3]) AS touches, list_max(n) <= 4 AND list_min(n) >= 1 AS within FROM o")
def array_set_checks(spark, sf_dir):
    o = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("s"), F.collect_set("l_linenumber").alias("n"))
    some = F.array(*(F.lit(x).cast("bigint") for x in (1, 2, 3)))
    return o.select("l_orderkey", F.size("s").alias("suppliers"), F.arrays_overlap("s", some).alias("touches"), (F.size(F.array_except("n", F.array(*(F.lit(x) for x in (1, 2, 3, 4))))) == 0).alias("within"))


@registered("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def dedupe_first_seen(spark, sf_dir):
    """Groups by a digest, so texts are not shuffled."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return d.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


_LINES_OF = "t AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)"
_FITS = "used + length(lines[i + 1]) <= 900 AND n < 4"


@registered(f"""WITH RECURSIVE {_LINES_OF}, f(doc_id, lines, i, used, n) AS (SELECT doc_id, lines, 0, 0, 0 FROM t
  UNION ALL SELECT doc_id, lines, i + 1, CAST(CASE WHEN {_FITS} THEN used + length(lines[i + 1]) ELSE used END AS INTEGER), CASE WHEN {_FITS} THEN n + 1 ELSE n END FROM f WHERE i < len(lines))
SELECT doc_id, CASE WHEN lines IS NOT NULL THEN used END AS used, CASE WHEN lines IS NOT NULL THEN n END AS n FROM f WHERE lines IS NULL OR i = len(lines)""")
def greedy_snippets(spark, sf_dir):
    """Lines in order while they fit a budget of characters; a line that does not fit is skipped and the scan goes on."""
    d = read(spark, sf_dir, "documents").select("doc_id", T.lines(F.col("text")).alias("lines"))
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"))
    step = lambda a, x: F.when((a["used"] + F.length(x) <= 900) & (a["n"] < 4), F.struct((a["used"] + F.length(x)).alias("used"), (a["n"] + 1).alias("n"))).otherwise(a)
    return d.select("doc_id", F.aggregate("lines", start, step).alias("r")).select("doc_id", "r.used", "r.n")


LINES = "WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), "


@registered(LINES + """o AS (SELECT doc_id, lines, len(lines) AS n, CAST(list_position(lines, lines[2]) AS BIGINT) - 1 AS s FROM t WHERE len(lines) >= 2)
SELECT doc_id, s AS start, coalesce(list_min([i FOR i IN range(0, n) IF i > s AND length(lines[i + 1]) <= 40]), n) AS stop FROM o""")
def section_interval(spark, sf_dir):
    """From the line that equals a text's second line to the next short line."""
    d = read(spark, sf_dir, "documents").select("doc_id", T.lines(F.col("text")).alias("lines")).filter(F.size("lines") >= 2)
    start, stop = ordered.section(F.col("lines"), F.get("lines", 1), lambda x: F.length(x) <= 40)
    return d.select("doc_id", start.alias("start"), stop.alias("stop"))


@registered(LINES + "o AS (SELECT doc_id, ([x FOR x IN lines IF regexp_matches(x, '[0-9]')])[1] AS line FROM t) SELECT * FROM o")
def first_match_in_order(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", ordered.first_match(T.lines(F.col("text")), lambda x: x.rlike("[0-9]")).alias("line"))


@registered("SELECT o_custkey, arg_min(o_orderkey, (CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderdate, o_orderkey)) AS o_orderkey, bool_and(o_orderstatus <> 'F') AS substitute FROM orders GROUP BY 1")
def row_preference(spark, sf_dir):
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return ordered.preferred(read(spark, sf_dir, "orders"), "o_custkey", rank, F.col("o_orderdate"), "o_orderkey")


@registered("SELECT user_id, CAST(round_even(value, 0) AS BIGINT) AS band, string_agg(event_type, ' ' ORDER BY ts, event_id) AS words FROM events GROUP BY 1, 2")
def same_band_words(spark, sf_dir):
    return ordered.bands(read(spark, sf_dir, "events"), "user_id", "value", ("ts", "event_id"), "event_type")


@registered(
    PAIRS
    + """, claims AS (SELECT *, concat_ws(' ', metric, entity, year, c) AS exact, [metric || '-' || year, metric || '-' || (year - 1)] AS evidence, year % 2 = 0 AS others FROM usable),
told AS (SELECT *, CASE WHEN entity % 5 = 0 THEN exact || '0' ELSE exact END AS told, CASE WHEN entity % 7 = 0 THEN evidence[1:1] ELSE list_reverse(evidence) END AS cited, CASE WHEN entity % 3 = 2 THEN 'inference' ELSE 'fact' END AS kind FROM claims)
SELECT entity, metric, year, CASE WHEN kind = 'inference' THEN CASE WHEN others THEN 'interpretation' ELSE 'rejected' END WHEN told <> exact THEN 'text_mismatch' WHEN list_sort(cited) <> list_sort(evidence) THEN 'evidence_mismatch' ELSE 'verified' END AS status FROM told"""
)
def claim_check(spark, sf_dir):
    """Claims, some with an injected error. A claim of fact must have the exact text and the exact set of evidence; an
    inference is at most an interpretation, and that only with alternatives."""
    usable = _pairs(spark, sf_dir).filter("n_cur = 1 AND n_pri = 1 AND NOT mixed AND verified AND NOT restated")
    exact, evidence = F.concat_ws(" ", "metric", "entity", "year", "cur_value"), F.array(F.concat_ws("-", "metric", "year"), F.concat_ws("-", "metric", F.col("year") - 1))
    claims = usable.select(
        "entity", "metric", "year", exact.alias("exact"), evidence.alias("evidence"),
        F.when(F.expr("entity % 5 = 0"), F.concat(exact, F.lit("0"))).otherwise(exact).alias("told"),
        F.when(F.expr("entity % 7 = 0"), F.slice(evidence, 1, 1)).otherwise(F.reverse(evidence)).alias("cited"),
        F.when(F.expr("entity % 3 = 2"), "inference").otherwise("fact").alias("kind"),
        F.when(F.expr("year % 2 = 0"), F.array(F.lit("other cause"))).otherwise(F.array().cast("array<string>")).alias("alternatives"),
    )
    as_fact = F.when(F.col("told") != F.col("exact"), "text_mismatch").when(F.array_sort("cited") != F.array_sort("evidence"), "evidence_mismatch").otherwise("verified")
    as_inference = F.when(F.size("alternatives") > 0, "interpretation").otherwise("rejected")
    return claims.select("entity", "metric", "year", F.when(F.col("kind") == "inference", as_inference).otherwise(as_fact).alias("status"))


_OPENED = "(length(regexp_replace(lines[i + 1], '[^(（]', '', 'g')) - length(regexp_replace(lines[i + 1], '[^)）]', '', 'g')))"
_ENDS = f"(amount OR regexp_matches(lines[i + 1], '{T.AMOUNT}')) AND depth + {_OPENED} = 0"


@registered(f"""WITH RECURSIVE {_LINES_OF}, f(doc_id, lines, i, n, longest, held, amount, depth) AS (SELECT doc_id, lines, 0, 0, 0, 0, false, 0::BIGINT FROM t
  UNION ALL SELECT doc_id, lines, i + 1, n + ({_ENDS})::INT, greatest(longest, held + 1), CASE WHEN {_ENDS} THEN 0 ELSE held + 1 END,
    (amount OR regexp_matches(lines[i + 1], '{T.AMOUNT}')) AND NOT ({_ENDS}), CASE WHEN {_ENDS} THEN 0 ELSE depth + {_OPENED} END FROM f WHERE i < len(lines))
SELECT doc_id, CASE WHEN lines IS NOT NULL THEN n + (held > 0)::INT END AS rows, CASE WHEN lines IS NOT NULL THEN longest END AS longest FROM f WHERE lines IS NULL OR i = len(lines)""")
def row_assembly_fold(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", ordered.assembled(T.lines(F.col("text"))).alias("r"))
    return d.select("doc_id", "r.rows", "r.longest")
