"""Registered queries on report lines: extraction, verification, positions, lookups and gates, with the SQL each must equal."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyframe.functions import report as R
from tallyframe.functions import text as T
from tallyframe.operators import extraction, lookups, positions
from tallyframe.plans.catalog import registered
from tallyframe.plans.facts import FACTS_SQL, facts, read
from tallyframe.sources.report_lines import LINES_SQL, ROWS_SQL, report_lines, row_lines
from tallyframe.streaming.status import drained
from tallyframe.streaming.tables import shared_place

METRICS = {"accounts_receivable_net": "应收账款", "inventory_net": "存货"}
YEAR = 2024


def _tight(x: str) -> str:
    return f"regexp_replace({x}, '\\s+', '', 'g')"


_NUMBER = r"[-－−]?(?:\d{1,3}(?:[,，]\d{3})+(?:\.\d+)?|\d+\.\d+)"


def _tokens(x: str) -> str:
    """Amounts of a line; RE2 has no look-around, so spaces are doubled and the characters around an amount are consumed."""
    return f"regexp_extract_all(' ' || replace({x}, ' ', '  ') || ' ', '(?:^|[^0-9.])([（(]\\s*{_NUMBER}\\s*[）)]|{_NUMBER})(?:[^0-9.]|$)', 1)"


def _amount(t: str, signed: str = "NULL") -> str:
    bare = f"CAST(regexp_replace({t}, '[(),，（）]', '', 'g') AS DECIMAL(22,2))"
    return f"CASE WHEN regexp_matches({t}, '^[(（]-') THEN {signed.format(bare=bare)} WHEN regexp_matches({t}, '^[(（]') THEN -{bare} ELSE {bare} END"


_NUMBERED = "[一二三四五六七八九十百千万]+"


def _title(x: str) -> str:
    return f"regexp_full_match({_tight(x)}, '(?:(?:{_NUMBERED}|\\d+)[、．.])?合并资产负债表')"


def _statement(x: str) -> str:
    return f"regexp_full_match({_tight(x)}, '{R.STATEMENT[1:-1]}')"


@registered(
    f"WITH {ROWS_SQL}, t AS (SELECT *, {_tokens('text')} AS tokens FROM row_lines) SELECT doc, ord, array_to_string([w FOR w IN string_split(text, ' ') IF NOT regexp_full_match(w, '[-0-9.,，()（）]+|[一二三四五六七八九十]+、\\d+')], '') AS label, CAST(len(tokens) AS INTEGER) AS n_tokens, tokens[1] AS first_token, {_amount('tokens[1]')} AS amount, {_amount('tokens[1]', '{bare}')} AS verified_amount, CAST(10000 * ({_amount('tokens[2]')}) AS DECIMAL(32,2)) AS normalized, regexp_matches({_tight('text')}, '^应收账款(?:$|[一二三四五六七八九十]+、\\d|(?:附注)?\\d|（净额）)') AS receivable FROM t"
)
def row_fields(spark, sf_dir):
    """Label, amounts as printed and as read by extraction and by the second reader, and the exact row prefix, of every row."""
    rows = row_lines(spark, sf_dir).select("doc", "ord", "text", R.signed_amounts(F.col("text")).alias("tokens"))
    first = F.get("tokens", 0)
    return rows.select(
        "doc", "ord", R.row_label(F.col("text")).alias("label"), F.size("tokens").alias("n_tokens"), first.alias("first_token"),
        T.parse_amount(first).cast("decimal(22,2)").alias("amount"), R.verifier_amount(first).cast("decimal(22,2)").alias("verified_amount"),
        (T.parse_amount(F.get("tokens", 1)).cast("decimal(22,2)") * F.lit(10000)).cast("decimal(32,2)").alias("normalized"), R.has_exact_prefix(F.col("text"), "应收账款").alias("receivable"),
    )


@registered(
    f"WITH {LINES_SQL} SELECT doc, ord, {_title('text')} AS title, {_statement('text')} AS statement, regexp_matches(text, '^\\s*[一二三四五六七八九十百千]+、\\s*\\S') AND NOT regexp_matches(text, '^\\s*[一二三四五六七八九十]+、\\s*\\d') AS section, regexp_full_match(trim(text), '\\d+\\s*/\\s*\\d+') OR (regexp_matches(text, '年度报告(全文)?$') AND contains(text, '公司')) AS furniture, (contains({_tight('text')}, '单位：') OR contains({_tight('text')}, '单位:') OR contains({_tight('text')}, '币种：') OR contains({_tight('text')}, '币种:') OR regexp_matches({_tight('text')}, '\\d{{4}}年(度|金额)')) AND len({_tokens('text')}) = 0 AS meta FROM lines"
)
def line_kinds(spark, sf_dir):
    """Titles, statement titles, section headings, page furniture and meta lines, of every report line."""
    x = F.col("text")
    return report_lines(spark, sf_dir).select("doc", "ord", R.is_title(x, "合并资产负债表").alias("title"), R.is_statement_title(x).alias("statement"), R.is_section(x).alias("section"), R.is_furniture(x).alias("furniture"), R.is_meta(x).alias("meta"))


_UNIT = "CASE WHEN {x} LIKE '%单位%' AND len(list_distinct(regexp_extract_all({x}, '币种[:：](人民币|美元)', 1))) <= 1 THEN {v} END"


def _unit_sql(x: str) -> dict[str, str]:
    unit = f"regexp_extract({x}, '单位[:：](亿元|万元|元)', 1)"
    return {"unit": _UNIT.format(x=x, v=unit), "currency": _UNIT.format(x=x, v=f"nullif(regexp_extract({x}, '币种[:：](人民币|美元)', 1), '')"), "multiplier": _UNIT.format(x=x, v=f"CASE {unit} WHEN '元' THEN 1 WHEN '万元' THEN 10000 ELSE 100000000 END")}


@registered(f"WITH {LINES_SQL} SELECT doc, " + ", ".join(f"CAST({v} AS {'DECIMAL(9,0)' if k == 'multiplier' else 'VARCHAR'}) AS {k}" for k, v in _unit_sql(_tight("text")).items()) + " FROM lines WHERE regexp_matches(text, '单位|币种')")
def unit_lines(spark, sf_dir):
    """Unit, currency and multiplier of every line that tells one."""
    told = report_lines(spark, sf_dir).filter(F.col("text").rlike("单位|币种"))
    return told.select("doc", R.unit_of(F.col("text")).alias("u")).select("doc", "u.unit", "u.currency", "u.multiplier")


_BODY = "regexp_replace({raw}, '(.)', '[\\1]\\\\s*', 'g')"
_BEFORE = "(?:^|[\\n\\r]|[^0-9,，.．\\-－−(（ \\t]|(?:^|[\\n\\r]|[^,，.．\\-－−(（ \\t])[ \\t]+)"
_AFTER = "(?:$|[\\n\\r]|[^0-9,，.．)） \\t]|[ \\t]+(?:$|[\\n\\r]|[^,，.．)） \\t]))"
_COMPLETE = f"regexp_matches({{text}}, '{_BEFORE}' || {_BODY} || '{_AFTER}')"
_BARE = "regexp_replace(now, '[-()（）]', '', 'g')"


@registered(f"WITH {ROWS_SQL} SELECT doc, ord, {_COMPLETE.format(text='text', raw='now')} AS whole, {_COMPLETE.format(text='text', raw=_BARE)} AS bare, {_COMPLETE.format(text='text', raw=f'{_BARE}[2:]')} AS part FROM row_lines")
def complete_tokens(spark, sf_dir):
    """Whether the printed amount, the amount without its sign, and a part of it stand in the row as complete amounts."""
    bare = F.regexp_replace("now", "[-()（）]", "")
    text = F.col("text")
    return row_lines(spark, sf_dir).select("doc", "ord", R.has_complete_token(text, F.col("now")).alias("whole"), R.has_complete_token(text, bare).alias("bare"), R.has_complete_token(text, F.substr(bare, F.lit(2))).alias("part"))


_U = _unit_sql(_tight("units[1]"))


def _sheet_sql(name: str, signed: str) -> str:
    """The balance sheet's facts, reading amounts with a sign in brackets as told."""
    a, b = (_amount(f"tokens[{k}]", signed) for k in (1, 2))
    return f"""
{name}_docs AS (SELECT doc, list(text ORDER BY ord, text) AS t FROM lines GROUP BY 1),
{name}_at AS (SELECT doc, t, [i FOR i IN range(1, len(t) + 1) IF {_title('t[i]')}] AS titles FROM {name}_docs),
{name}_stop AS (SELECT *, [i FOR i IN range(1, len(t) + 1) IF {_statement('t[i]')} AND i > titles[1]] AS stops FROM {name}_at),
{name}_body AS (SELECT doc, len(titles) AS n_titles, CASE WHEN len(titles) > 0 THEN t[titles[1] + 1 : coalesce(stops[1], len(t) + 1) - 1] END AS body FROM {name}_stop),
{name}_head AS (SELECT *, list_distinct([regexp_extract_all({_tight('x')}, '(\\d{{4}})年12月31日', 1) FOR x IN body IF len(regexp_extract_all({_tight('x')}, '\\d{{4}}年\\d{{1,2}}月\\d{{1,2}}日')) = 2 AND len(list_distinct(regexp_extract_all({_tight('x')}, '(\\d{{4}})年12月31日', 1))) = 2]) AS years,
  [x FOR x IN body IF regexp_matches(x, '^\\s*单位\\s*[:：]')] AS units FROM {name}_body),
{name}_rows AS (SELECT *, [x FOR x IN body IF len({_tokens('x')}) > 0 AND regexp_matches({_tight('x')}, '^' || name || '(?:$|[一二三四五六七八九十]+、\\d|(?:附注)?\\d|（净额）)')] AS found
  FROM {name}_head, (VALUES ('accounts_receivable_net', '应收账款'), ('inventory_net', '存货')) m(metric, name)),
{name}_read AS (SELECT *, {_tokens('found[1]')} AS tokens, CASE WHEN years[1][1] = '2023' THEN 1 ELSE 0 END AS flip FROM {name}_rows),
{name}_value AS (SELECT *, {a} AS a, {b} AS b, CASE WHEN n_titles = 0 THEN 'table_not_found' WHEN n_titles > 1 THEN 'ambiguous_table' WHEN len(years) <> 1 THEN 'missing_or_conflicting_year_header' WHEN list_sort(years[1]) <> ['2023', '2024'] THEN 'missing_year_header'
  WHEN len(units) = 0 OR ({_U['unit']}) IS NULL THEN 'missing_unit' WHEN len(found) = 0 THEN 'row_not_found' WHEN len(found) > 1 THEN 'ambiguous_row' WHEN len(tokens) <> 2 THEN 'amount_alignment' WHEN ({a}) IS NULL OR ({b}) IS NULL THEN 'amount_unreadable' ELSE 'ok' END AS code FROM {name}_read),
{name} AS (SELECT doc, metric, code, CASE WHEN code = 'ok' THEN {_U['unit']} END AS unit, CASE WHEN code = 'ok' THEN {_U['currency']} END AS currency,
  CASE WHEN code = 'ok' THEN CAST((CASE flip WHEN 1 THEN b ELSE a END) * ({_U['multiplier']}) AS DECIMAL(38,2)) END AS now, CASE WHEN code = 'ok' THEN CAST((CASE flip WHEN 1 THEN a ELSE b END) * ({_U['multiplier']}) AS DECIMAL(38,2)) END AS before FROM {name}_value)"""


@registered(f"WITH {LINES_SQL}, {_sheet_sql('sheet', 'NULL')} SELECT doc, metric, code, unit, currency, now, before FROM sheet")
def balance_sheet_facts(spark, sf_dir):
    """Receivables and inventory of both years from every balance sheet, or the first gate that failed."""
    return extraction.balance_sheet(report_lines(spark, sf_dir), YEAR, METRICS)


@registered(f"WITH {LINES_SQL}, {_sheet_sql('sheet', 'NULL')} SELECT metric, code, count(*) AS n, count(*) FILTER (code = 'ok' AND currency IS NULL) AS undisclosed FROM sheet GROUP BY 1, 2")
def extraction_issues(spark, sf_dir):
    sheet = extraction.balance_sheet(report_lines(spark, sf_dir), YEAR, METRICS)
    return sheet.groupBy("metric", "code").agg(F.count("*").alias("n"), F.count_if(F.expr("code = 'ok' AND currency IS NULL")).alias("undisclosed"))


def _arms() -> dict:
    """What each arm of the ablation changes in a fact."""
    return {"clean": {}, "amount": {"now": F.expr("now + 1")}, "year": {"now": F.col("before")}, "unit": {"unit": F.lit("千元")}, "currency": {"currency": F.lit("欧元")}, "sign": {"now": F.expr("-now")}}


_OWN = f"WITH {LINES_SQL}, {_sheet_sql('sheet', 'NULL')}, {_sheet_sql('own', '{bare}')}"
_TOLD = """told AS (SELECT doc, metric, arm, CASE arm WHEN 'unit' THEN '千元' ELSE unit END AS unit, CASE arm WHEN 'currency' THEN '欧元' ELSE currency END AS currency,
  CASE arm WHEN 'amount' THEN now + 1 WHEN 'year' THEN before WHEN 'sign' THEN -now ELSE now END AS now FROM (SELECT *, unnest(['clean', 'amount', 'year', 'unit', 'currency', 'sign']) AS arm FROM sheet WHERE code = 'ok')),
judged AS (SELECT t.*, CASE WHEN o.code IS NULL OR o.code <> 'ok' OR o.currency IS NULL THEN 'insufficient' WHEN t.unit IS DISTINCT FROM o.unit THEN 'unit_conflict' WHEN t.currency IS DISTINCT FROM o.currency THEN 'currency_conflict'
  WHEN t.now = o.now THEN 'verified' WHEN t.now = o.before THEN 'value_in_other_year' ELSE 'value_conflict' END AS status FROM told t LEFT JOIN own o ON o.doc = t.doc AND o.metric = t.metric)"""


@registered(f"{_OWN}, {_TOLD} SELECT arm, count(*) AS n, count(*) FILTER (status = 'verified') AS accepted, count(*) FILTER (status NOT IN ('verified', 'insufficient')) AS rejected, count(*) FILTER (status = 'insufficient') AS abstained, count(*) FILTER (status = 'value_in_other_year') AS other_year FROM judged GROUP BY 1")
def verification_ablation(spark, sf_dir):
    """Every fact clean and with five kinds of injected error, against a second reading of the same lines."""
    both = extraction.balance_sheets(report_lines(spark, sf_dir), YEAR, METRICS, "合并资产负债表", {"": T.parse_amount, "own_": R.verifier_amount})
    both = both.withColumn("own_code", F.when(F.col("doc").isNotNull(), F.col("own_code")))
    # a filter before the arms would be pushed into the steps that make the code, which makes them again
    judged = extraction.judged(extraction.mutated(both, _arms()).filter("code = 'ok'"))
    n = lambda e: F.count_if(F.expr(e))
    return judged.groupBy("arm").agg(F.count("*").alias("n"), n("status = 'verified'").alias("accepted"), n("status NOT IN ('verified', 'insufficient')").alias("rejected"), n("status = 'insufficient'").alias("abstained"), n("status = 'value_in_other_year'").alias("other_year"))


@registered(f"WITH {ROWS_SQL}, s AS (SELECT doc, CASE WHEN a IS NULL THEN 1 WHEN whole AND a = a + (doc % 4 = 1)::INT THEN 0 ELSE 2 END AS rank FROM (SELECT doc, {_amount('now')} AS a, {_COMPLETE.format(text='text', raw='now')} AS whole FROM row_lines)) SELECT doc, CASE max(rank) WHEN 2 THEN 'failed' WHEN 1 THEN 'abstained' ELSE 'passed' END AS status, count(*) AS n FROM s GROUP BY 1")
def source_amount_status(spark, sf_dir):
    """Amounts, some told wrongly, found again in their rows and recomputed; a failure outranks an abstention in a report."""
    read_amount = T.parse_amount(F.col("now")).cast("decimal(22,2)")
    told = read_amount + F.expr("CAST(doc % 4 = 1 AS INT)")
    rank = F.when(read_amount.isNull(), 1).when(R.has_complete_token(F.col("text"), F.col("now")) & (read_amount == told), 0).otherwise(2)
    ranked = row_lines(spark, sf_dir).select("doc", rank.alias("rank")).groupBy("doc").agg(F.max("rank").alias("rank"), F.count("*").alias("n"))
    return ranked.select("doc", F.when(F.col("rank") == 2, "failed").when(F.col("rank") == 1, "abstained").otherwise("passed").alias("status"), "n")


@registered("SELECT e.event_id, (SELECT arg_min(p_size, (abs(e.value - p_size), p_size)) FROM (SELECT DISTINCT CAST(p_size AS DOUBLE) AS p_size FROM part) p WHERE abs(e.value - p_size) <= 3.4) AS p_size FROM events e")
def nearest_join(spark, sf_dir):
    sizes = read(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("p_size"))
    return positions.nearest(read(spark, sf_dir, "events").select("event_id", "value"), "event_id", "value", sizes, "p_size", 3.4).select("event_id", "p_size")


@registered("SELECT event_id, count(*) AS n, min(s_suppkey) AS first_supplier FROM events JOIN supplier ON abs(value - s_acctbal / 20) <= 0.75 GROUP BY 1")
def band_join_by_bucket(spark, sf_dir):
    suppliers = read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") / 20).alias("at"))
    met = positions.within(read(spark, sf_dir, "events").select("event_id", "value"), "value", suppliers, "at", 0.75)
    return met.groupBy("event_id").agg(F.count("*").alias("n"), F.min("s_suppkey").alias("first_supplier"))


@registered("WITH s AS (SELECT *, max((event_type = 'click')::INT) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS seen, first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, stop FROM s WHERE event_type = 'signup' AND seen = 1")
def asof_with_context(spark, sf_dir):
    kind = F.col("event_type")
    return positions.next_after_context(read(spark, sf_dir, "events"), "user_id", ("ts", "event_id"), kind == "signup", kind == "click", kind == "purchase", "event_id").select("event_id", "stop")


@registered("SELECT o_orderkey, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' ELSE 'one' END AS found, CASE WHEN n = 1 THEN v END AS l_partkey FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, min(l_partkey) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey")
def unique_verification(spark, sf_dir):
    """The one returned item of an order, where it is one. The filter is the lookup's meaning, not a slice."""
    returned = read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", "l_partkey")
    return lookups.unique_lookup(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", returned, "l_orderkey", "l_partkey")


@registered("WITH r AS (SELECT event_id, ['customer', 'supplier', 'part'][event_id % 3 + 1] AS kind, user_id * 7 AS target FROM events), p AS (SELECT 'customer' AS kind, c_custkey AS target FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier UNION ALL SELECT 'part', p_partkey FROM part) SELECT event_id, kind, target FROM r WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.kind = r.kind AND p.target = r.target)")
def dangling_targets(spark, sf_dir):
    refs = read(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*map(F.lit, ("customer", "supplier", "part"))), (F.col("event_id") % 3 + 1).cast("int")).alias("kind"), (F.col("user_id") * 7).alias("target"))
    pools = {"customer": (read(spark, sf_dir, "customer"), "c_custkey"), "supplier": (read(spark, sf_dir, "supplier"), "s_suppkey"), "part": (read(spark, sf_dir, "part"), "p_partkey")}
    return lookups.dangling_targets(refs, pools).select("event_id", "kind", "target")


@registered("SELECT o_orderkey, CAST(CAST(a.c_acctbal AS DECIMAL(12,2)) - CAST(b.c_acctbal AS DECIMAL(12,2)) AS DECIMAL(13,2)) AS difference FROM orders LEFT JOIN customer a ON a.c_custkey = o_custkey LEFT JOIN customer b ON b.c_custkey = o_custkey + 1")
def ordinal_inputs(spark, sf_dir):
    calculations = read(spark, sf_dir, "orders").select("o_orderkey", F.array("o_custkey", F.col("o_custkey") + 1).alias("ids"))
    customers = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("decimal(12,2)").alias("balance"))
    return lookups.with_inputs(calculations, "ids", customers, "c_custkey", "balance").select("o_orderkey", (F.col("first") - F.col("second")).cast("decimal(13,2)").alias("difference"))


@registered("SELECT s_suppkey, CASE WHEN n_name IS NULL THEN 'missing_record' WHEN s_nationkey <> n_nationkey THEN 'identity_mismatch' WHEN n_regionkey = 2 THEN 'wrong_scope' WHEN s_acctbal < 1000 THEN 'value_mismatch' END AS error FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def identity_first_error(spark, sf_dir):
    joined = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"), "left")
    checks = [("missing_record", F.col("n_name").isNull()), ("identity_mismatch", F.col("s_nationkey") != F.col("n_nationkey")), ("wrong_scope", F.col("n_regionkey") == 2), ("value_mismatch", F.col("s_acctbal") < 1000)]
    return joined.select("s_suppkey", lookups.first_error(checks).alias("error"))


@registered("SELECT o_orderkey, array_to_string([x FOR x IN [CASE WHEN o_totalprice < 50000 THEN 'amount' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status' END, CASE WHEN o_orderpriority LIKE '4%' THEN 'priority' END, CASE WHEN year(o_orderdate) NOT BETWEEN 1993 AND 1999 THEN 'year' END] IF x IS NOT NULL], ',') AS violations FROM orders")
def constraint_violations(spark, sf_dir):
    checks = [("amount", F.expr("o_totalprice < 50000")), ("status", F.expr("o_orderstatus NOT IN ('F', 'O')")), ("priority", F.col("o_orderpriority").startswith("4")), ("year", F.expr("year(o_orderdate) NOT BETWEEN 1993 AND 1999"))]
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(lookups.violations(checks), ",").alias("violations"))


@registered("SELECT o_orderkey, o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AS natural FROM orders")
def natural_years(spark, sf_dir):
    """Periods of a year, some a day late and some a day short."""
    y = F.year("o_orderdate")
    start, end = F.make_date(y, F.lit(1), F.expr("IF(o_orderkey % 3 = 0, 2, 1)")), F.make_date(y, F.lit(12), F.expr("IF(o_orderkey % 5 = 0, 30, 31)"))
    return read(spark, sf_dir, "orders").select("o_orderkey", lookups.is_natural_year(start, end).alias("natural"))


@registered("WITH RECURSIVE a(user_id, anchor) AS (SELECT user_id, min(value) FROM events GROUP BY 1 UNION ALL SELECT a.user_id, (SELECT min(e.value) FROM events e WHERE e.user_id = a.user_id AND e.value - a.anchor > 2.5) FROM a WHERE a.anchor IS NOT NULL) SELECT user_id, CAST(count(anchor) AS INTEGER) AS n_lines FROM a GROUP BY 1")
def anchored_lines(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list("value").alias("v")).select("user_id", positions.clusters(F.col("v"), 2.5).alias("n_lines"))


_NEAR = "SELECT event_id, event_type AS t, coalesce(lag(event_type) OVER w, '') AS p, coalesce(lead(event_type) OVER w, '') AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


@registered(f"SELECT event_id, t || n = 'clickview' OR p || t = 'clickview' OR p || t || n = 'clickview' OR t = 'clickview' AS matched FROM ({_NEAR})")
def neighbour_fragments(spark, sf_dir):
    line = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events").select("event_id", "event_type", F.lag("event_type").over(line).alias("p"), F.lead("event_type").over(line).alias("n"))
    return e.select("event_id", positions.neighbour_label(F.col("event_type"), F.col("p"), F.col("n"), "clickview").alias("matched"))


@registered("WITH f AS (SELECT event_id, list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS f FROM events) SELECT event_id, CAST(list_min([k FOR k IN range(1, len(f) + 1) IF array_to_string(f[1:k], '') = 'viewclickerror']) AS BIGINT) AS n_lines FROM f")
def label_over_lines(spark, sf_dir):
    line = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(0, 3)
    e = read(spark, sf_dir, "events").select("event_id", F.collect_list("event_type").over(line).alias("f"))
    return e.select("event_id", positions.assembled_label(F.col("f"), "viewclickerror").alias("n_lines"))


_WORDS = "string_split(p_name || ' ' || lower(p_type), ' ')"


@registered(f"WITH w AS (SELECT p_partkey, {_WORDS} AS w FROM part), r AS (SELECT p_partkey, i, j, array_to_string(w[i:j], '') AS run FROM (SELECT *, unnest(range(i, len(w) + 1)) AS j FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM w))) SELECT p_partkey, coalesce(arg_min(run, (-length(run), i, j)) FILTER (contains('smallredringeconomybluewidgetpromo', run)), '') AS fragment FROM r GROUP BY 1")
def longest_label_fragment(spark, sf_dir):
    words = F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " ")
    return read(spark, sf_dir, "part").select("p_partkey", positions.longest_fragment(words, "smallredringeconomybluewidgetpromo").alias("fragment"))


@registered("SELECT user_id, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') AS purchases, bool_or(event_type = 'error') AS issues, CASE WHEN count(*) FILTER (event_type = 'error' AND value > 40) > 0 THEN 'verification_failed' WHEN bool_or(event_type = 'error') THEN 'completed_with_issues' ELSE 'completed' END AS status, count(*) FILTER (event_type = 'error') = 0 OR (count(*) FILTER (event_type = 'purchase') >= 10 AND max(value) < 200 AND count(DISTINCT event_type) = 5) AS eligible FROM events GROUP BY 1")
def coverage_gate(spark, sf_dir):
    """Counters of a run, its status by precedence, and a gate that needs several of them."""
    n = lambda e: F.count_if(F.expr(e))
    c = read(spark, sf_dir, "events").groupBy("user_id").agg(n("event_type = 'error'").alias("errors"), n("event_type = 'purchase'").alias("purchases"), n("event_type = 'error' AND value > 40").alias("grave"), F.max("value").alias("top"), F.count_distinct("event_type").alias("kinds"))
    status = F.when(F.col("grave") > 0, "verification_failed").when(F.col("errors") > 0, "completed_with_issues").otherwise("completed")
    return c.select("user_id", "errors", "purchases", (F.col("errors") > 0).alias("issues"), status.alias("status"), F.expr("errors = 0 OR (purchases >= 10 AND top < 200 AND kinds = 5)").alias("eligible"))


@registered("SELECT event_id, json_keys(props) = ['k'] AS exact FROM events")
def exact_json_keys(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", (F.array_sort(F.json_object_keys("props")) == F.array(F.lit("k"))).alias("exact"))


@registered("SELECT kind, count(*) AS n, sum(CAST(v AS DECIMAL(14,2))) AS total FROM (SELECT 'customer' AS kind, c_acctbal AS v FROM customer UNION ALL SELECT 'supplier', s_acctbal FROM supplier UNION ALL SELECT 'part', p_retailprice FROM part) GROUP BY 1")
def joined_lists(spark, sf_dir):
    part = lambda kind, t, c: read(spark, sf_dir, t).select(F.lit(kind).alias("kind"), F.col(c).cast("decimal(14,2)").alias("v"))
    every = part("customer", "customer", "c_acctbal").unionByName(part("supplier", "supplier", "s_acctbal")).unionByName(part("part", "part", "p_retailprice"))
    return every.groupBy("kind").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@registered("SELECT user_id, event_type, min(value) AS x0, max(value) AS x1, min(ts) AS y0, max(ts) AS y1 FROM events GROUP BY 1, 2")
def box_union(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("value").alias("x0"), F.max("value").alias("x1"), F.min("ts").alias("y0"), F.max("ts").alias("y1"))


@registered("SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS hits FROM (SELECT user_id, event_type, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2) GROUP BY 1")
def distinct_hits(spark, sf_dir):
    """Distinct kinds of a user in the order in which each occurs first: two partial aggregations, no list of all rows."""
    first = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    hits = F.array_sort(F.collect_list(F.struct("at", "event_type")))
    return first.groupBy("user_id").agg(F.array_join(F.transform(hits, lambda h: h["event_type"]), ",").alias("hits"))


@registered("SELECT event_id, regexp_replace(regexp_replace(CAST(CAST(round(CAST(value AS DECIMAL(20,8)) * CAST(0.1234567 AS DECIMAL(8,7)), 6) AS DECIMAL(28,6)) AS VARCHAR), '0+$', ''), '\\.$', '') AS shown FROM events")
def display_decimals(spark, sf_dir):
    exact = F.col("value").cast("decimal(20,8)") * F.lit("0.1234567").cast("decimal(8,7)")
    return read(spark, sf_dir, "events").select("event_id", R.shown_decimal(exact).alias("shown"))


@registered("SELECT event_type, {'purchase': 'accepted', 'error': 'rejected', 'view': 'abstained', 'click': 'abstained'}[event_type] AS arm, count(*) AS n FROM events GROUP BY 1, 2".replace("{'purchase': 'accepted', 'error': 'rejected', 'view': 'abstained', 'click': 'abstained'}[event_type]", "CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'rejected' WHEN 'view' THEN 'abstained' WHEN 'click' THEN 'abstained' END"))
def status_vocabulary(spark, sf_dir):
    arm = F.create_map(*map(F.lit, ("purchase", "accepted", "error", "rejected", "view", "abstained", "click", "abstained")))
    return read(spark, sf_dir, "events").groupBy("event_type", arm[F.col("event_type")].alias("arm")).agg(F.count("*").alias("n"))


@registered("SELECT o_orderkey, array_to_string([x FOR x IN [CASE WHEN o_orderstatus = 'P' THEN 'pending' END, CASE WHEN o_totalprice > 300000 THEN 'large' END, CASE WHEN month(o_orderdate) = 12 THEN 'year end' END] IF x IS NOT NULL], '; ') AS notes FROM orders")
def limitation_notes(spark, sf_dir):
    notes = lookups.violations([("pending", F.col("o_orderstatus") == "P"), ("large", F.col("o_totalprice") > 300000), ("year end", F.month("o_orderdate") == 12)])
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(notes, "; ").alias("notes"))


@registered("SELECT conv_id, turn, regexp_matches(text, '[0-9]') OR regexp_matches(text, '(fraud|guilty|certainly)') AS refused FROM conversations WHERE role = 'assistant'")
def refused_opinions(spark, sf_dir):
    """Opinions with digits or forbidden conclusions. Only assistants give opinions."""
    return read(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", F.col("text").rlike("[0-9]|(fraud|guilty|certainly)").alias("refused"))


@registered("WITH r AS (SELECT l_orderkey, list(l_suppkey) AS ids FROM lineitem GROUP BY 1) SELECT l_orderkey, len(ids) <= 8 AND len(list_distinct(ids)) = len(ids) AND len([x FOR x IN ids IF x % 10 = 9]) = 0 AS allowed FROM r")
def id_whitelist(spark, sf_dir):
    """At most eight references, all different, none outside the allowed ones."""
    r = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("d"), F.count_if(F.expr("l_suppkey % 10 = 9")).alias("outside"))
    return r.select("l_orderkey", F.expr("n <= 8 AND d = n AND outside = 0").alias("allowed"))


@registered("SELECT o_orderkey, CASE WHEN n IS NULL THEN 'pending_review' WHEN blocked THEN 'pending_review' WHEN good THEN 'confirmed' ELSE 'interpretations' END AS section FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, bool_or(l_returnflag = 'R') AS blocked, bool_or(l_returnflag = 'A' AND l_discount <= 0.05) AS good FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def fact_placement(spark, sf_dir):
    """Confirmed only with no blocking verification and one whose evidence matches."""
    v = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("blocked"), F.bool_or(F.expr("l_returnflag = 'A' AND l_discount <= 0.05")).alias("good"))
    section = F.when(F.col("blocked").isNull() | F.col("blocked"), "pending_review").when(F.col("good"), "confirmed").otherwise("interpretations")
    return read(spark, sf_dir, "orders").select("o_orderkey").join(v, "o_orderkey", "left").select("o_orderkey", section.alias("section"))


@registered(f"WITH {LINES_SQL} SELECT doc, ord // 30 AS page, count(*) AS n, string_agg(DISTINCT text[1:2], ',' ORDER BY text[1:2]) AS starts FROM lines GROUP BY 1, 2")
def page_groups(spark, sf_dir):
    pages = report_lines(spark, sf_dir).groupBy("doc", F.floor(F.col("ord") / 30).cast("int").alias("page"))
    return pages.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.substring("text", 1, 2))), ",").alias("starts"))


_SECTIONS = "WITH l AS (SELECT doc_id, unnest(range(1, len(t) + 1)) AS i, t FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents)), s AS (SELECT doc_id, i, t[i] AS x, sum((length(t[i]) <= 60)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM l)"
_LINE_SCORE = "4 * contains(x, 'th')::INT + 2 * (contains(x, 'an') AND contains(x, 'er'))::INT + contains(x, ',')::INT"


@registered(f"{_SECTIONS} SELECT doc_id, CAST(section AS BIGINT) AS section, count(*) AS n, CAST(arg_min(i, (-({_LINE_SCORE}), i)) AS BIGINT) AS best, max({_LINE_SCORE}) AS score FROM s GROUP BY 1, 2")
def section_best_line(spark, sf_dir):
    """Lines of each section (a short line opens one) and the best scored one: a running count in place of a range join."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("at", "x"))
    has = lambda w: F.col("x").contains(w).cast("int")
    i = F.col("at").cast("long") + 1
    section = F.sum((F.length("x") <= 60).cast("long")).over(Window.partitionBy("doc_id").orderBy("at"))
    scored = lines.select("doc_id", i.alias("i"), section.alias("section"), (4 * has("th") + 2 * has("an") * has("er") + has(",")).alias("score"))
    return scored.groupBy("doc_id", "section").agg(F.count("*").alias("n"), F.min_by("i", F.struct(-F.col("score"), "i")).alias("best"), F.max("score").alias("score"))


@registered(
    "WITH "
    + FACTS_SQL
    + """, c AS (SELECT entity, y AS year, metric, count(*) AS n, max(value) AS v, bool_and(verified) AS ok, bool_or(restatement = 'restated') AS restated FROM facts WHERE metric IN ('net_profit_parent', 'operating_cash_flow') GROUP BY 1, 2, 3),
keys AS (SELECT DISTINCT entity, y AS year FROM facts),
w AS (SELECT entity, year, max(v) FILTER (metric = 'net_profit_parent') AS profit, max(v) FILTER (metric = 'operating_cash_flow') AS cash, count(*) AS kinds, max(n) AS n, bool_and(ok) AS ok, bool_or(restated) AS restated FROM keys LEFT JOIN c USING (entity, year) GROUP BY 1, 2),
i AS (SELECT *, array_to_string([x FOR x IN [CASE WHEN profit IS NULL OR cash IS NULL THEN 'missing_fact' END, CASE WHEN n > 1 THEN 'duplicate_fact' END, CASE WHEN restated THEN 'restatement_conflict' END, CASE WHEN NOT ok THEN 'verification_unconfirmed' END] IF x IS NOT NULL], ',') AS issues FROM w)
SELECT entity, year, issues, CASE WHEN issues = '' THEN profit > 0 AND cash < 0 END AS triggered FROM i"""
)
def rule_profit_cash_current(spark, sf_dir):
    """Profit up and cash down in the current year alone, with the reasons where it abstains."""
    f = facts(spark, sf_dir).withColumn("year", F.col("y"))
    of = lambda m: F.max(F.when(F.col("metric") == m, F.col("value")))
    mine = F.col("metric").isin("net_profit_parent", "operating_cash_flow")
    n = F.greatest(*(F.count_if(F.col("metric") == m) for m in ("net_profit_parent", "operating_cash_flow")))
    w = f.groupBy("entity", "year").agg(of("net_profit_parent").alias("profit"), of("operating_cash_flow").alias("cash"), n.alias("n"), F.bool_and(F.when(mine, F.col("verified"))).alias("ok"), F.bool_or(F.when(mine, F.col("restatement") == "restated")).alias("restated"))
    checks = [("missing_fact", F.expr("profit IS NULL OR cash IS NULL")), ("duplicate_fact", F.col("n") > 1), ("restatement_conflict", F.col("restated")), ("verification_unconfirmed", ~F.col("ok"))]
    return w.withColumn("issues", F.array_join(lookups.violations(checks), ",")).select("entity", "year", "issues", F.when(F.col("issues") == "", F.expr("profit > 0 AND cash < 0")).alias("triggered"))


@registered("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def streamed_status_counts(spark, sf_dir):
    """The event table read as a stream. Its table and checkpoint lie in the shared folder; without one (tests) in a new one."""
    at = shared_place(spark, "status")
    return drained(spark, f"{sf_dir}/events.parquet", f"{at}/table", f"{at}/checkpoint")
