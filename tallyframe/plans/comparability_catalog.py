"""Registered queries on the comparability of a report's years, with the SQL each must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import comparability as C
from tallyframe.plans.catalog import registered
from tallyframe.plans.facts import read

# Lines of the notes on policies, errors and opening profits: page, height, text by the key k of an order and its year y.
NO, YES = "□适用 √不适用", "√适用 □不适用"
LINES = (
    (1, 10, "CASE WHEN k % 11 = 3 THEN '年度报告' ELSE concat(y, ' 年年度报告') END"),
    (1, 30, "CASE WHEN k % 13 = 1 THEN '1、其他事项' ELSE '1、重要会计政策变更' END"),
    (1, 44, f"CASE WHEN k % 17 = 2 THEN '{YES}' WHEN k % 19 = 4 THEN '适用' ELSE '{NO}' END"),
    (1, 90, "'2、重要会计估计变更'"),
    (1, 99, "CASE WHEN k % 7 = 5 THEN '重要会计估计变更' ELSE '本节另有说明' END"),
    (1, 104, f"'{NO}'"),
    (1, 160, "concat(y, '年起首次执行新会计准则或准则解释等涉及调整首次执行当年年初的财务报表')"),
    (1, 174, f"CASE WHEN k % 29 = 1 THEN '说明' ELSE '{NO}' END"),
    (1, 230, f"'{YES}'"),
    (2, 10, "CASE WHEN k % 23 = 5 THEN concat(y - 1, '年年度报告') ELSE concat(y, '年年度报告') END"),
    (2, 20, "CASE WHEN k % 19 = 6 THEN '其他' ELSE '前期会计差错更正' END"),
    (2, 30, "'(1). 追溯重述法'"),
    (2, 44, f"CASE WHEN k % 31 = 7 THEN '{YES}' ELSE '{NO}' END"),
    (2, 60, "'由于《企业会计准则》及其相关新规定进行追溯调整，影响期初未分配利润0元。'"),
    (2, 70, "concat('由于会计政策变更，影响期初未分配利润', CASE WHEN k % 29 = 8 THEN '-5.00' WHEN k % 2 = 0 THEN '0.00' ELSE '-0' END, '元。')"),
    (2, 80, "CASE WHEN k % 31 = 9 THEN '由于重大会计差错更正，影响不大。' ELSE '由于重大会计差错更正，影响期初未分配利润0元。' END"),
    (2, 90, "'由于同一控制导致的合并范围变更，影响期初未分配利润 0 元。'"),
    (3, 10, "CASE WHEN k % 37 = 11 THEN '附注' ELSE concat(y, '年年度报告全文') END"),
    (3, 20, "'其他调整合计影响期初未分配利润0元。'"),
    (3, 30, "CASE WHEN k % 37 = 10 THEN '本公司对上期比较数据进行追溯调整' WHEN k % 37 = 12 THEN '本公司追溯调整影响期初未分配利润0元，涉及前期' ELSE '对于同一控制合并，应调整比较报表' END"),
)


_L = "l AS (SELECT k AS doc, y, unnest([" + ", ".join(str(p) for p, _, _ in LINES) + "]) AS page, unnest([" + ", ".join(str(h) for _, h, _ in LINES) + "]) AS h, replace(unnest([" + ", ".join(t for *_, t in LINES) + "]), ' ', '') AS t FROM (SELECT o_orderkey AS k, 2023 + o_orderkey % 2 AS y FROM orders))"
_FIRST = "(SELECT doc, '{name}' AS name, min_by(page, page * 1000 + h) AS page, min(page * 1000 + h) AS at FROM f WHERE {test} GROUP BY doc)"
_BOX = " UNION ALL ".join(
    _FIRST.format(name=n, test=t)
    for n, t in {"policy_change": "t LIKE '%重要会计政策变更%'", "estimate_change": "t LIKE '%重要会计估计变更%'", "first_adoption": "contains(t, y || '年起首次执行')", "prior_error": "t LIKE '%追溯重述法%' AND above LIKE '%前期会计差错更正%'"}.items()
)


@registered(f"""WITH {_L},
f AS (SELECT *, bool_or(contains(t, y || '年年度报告')) OVER (PARTITION BY doc, page) AS headed, string_agg(t, '|') OVER (PARTITION BY doc, page ORDER BY h ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS above, page * 1000 + h AS p FROM l),
b AS ({_BOX}),
c AS (SELECT b.doc, b.name, b.page, any_value(f.headed) AS headed, arg_min(f.t, f.p) FILTER (f.t IN ('□适用√不适用', '√适用□不适用') AND f.p > b.at AND f.p - b.at <= 46) AS choice FROM b JOIN f ON f.doc = b.doc AND f.page = b.page GROUP BY ALL),
e AS (SELECT *, regexp_extract(t, '影响期初未分配利润(-?[0-9.]+)元', 1) AS amount, CASE WHEN t LIKE '%准则%追溯调整%' THEN 'standards' WHEN t LIKE '%会计政策变更%' THEN 'policy' WHEN t LIKE '%差错更正%' THEN 'error' WHEN t LIKE '%同一控制%范围变更%' THEN 'scope' WHEN t LIKE '%其他调整合计%' THEN 'other' END AS cause FROM f),
o AS (SELECT doc, cause, max(page) AS page, max_by(headed, p) AS headed, bool_or(CAST(amount AS DOUBLE) <> 0) AS nonzero FROM e WHERE amount <> '' AND cause IS NOT NULL GROUP BY ALL),
r AS (SELECT doc, page, headed FROM f WHERE t LIKE '%本公司%追溯调整%' AND t NOT LIKE '%利润0元%'),
names AS (SELECT doc, unnest(['policy_change', 'estimate_change', 'first_adoption', 'prior_error']) AS name, unnest([1, 2, 3, 4]) AS i FROM (SELECT DISTINCT doc FROM l)),
causes AS (SELECT doc, unnest(['standards', 'policy', 'error', 'scope', 'other']) AS cause, unnest([5, 6, 7, 8, 9]) AS i FROM (SELECT DISTINCT doc FROM l)),
told AS (SELECT doc, i, CASE WHEN headed AND choice LIKE '√%' THEN 'applies:' || name END AS conflict, CASE WHEN page IS NULL THEN 'no_heading:' || name WHEN choice IS NULL THEN 'no_choice:' || name WHEN NOT headed THEN 'no_year_on_page:' || name END AS missing FROM names LEFT JOIN c USING (doc, name)
  UNION ALL SELECT doc, i, CASE WHEN nonzero THEN 'not_zero:' || cause END, CASE WHEN page IS NULL THEN 'no_cause:' || cause WHEN NOT headed THEN 'no_year_on_page:p' || page END FROM causes LEFT JOIN o USING (doc, cause) UNION ALL SELECT DISTINCT doc, 10, 'restated', NULL FROM r
  UNION ALL SELECT DISTINCT doc, 11, NULL, 'no_evidence' FROM l WHERE doc NOT IN (SELECT doc FROM c WHERE headed AND choice IS NOT NULL UNION SELECT doc FROM o WHERE headed UNION SELECT doc FROM r WHERE headed)),
m AS (SELECT doc, missing, min(i) AS i FROM told WHERE missing IS NOT NULL GROUP BY ALL),
g AS (SELECT doc, coalesce(string_agg(conflict, ',' ORDER BY i), '') AS conflicts FROM told GROUP BY doc),
h AS (SELECT doc, string_agg(missing, ',' ORDER BY i) AS missing FROM m GROUP BY doc)
SELECT doc, CASE WHEN conflicts <> '' THEN 'conflict' WHEN missing IS NOT NULL THEN 'insufficient_evidence' ELSE 'verified' END AS status, conflicts, coalesce(missing, '') AS missing FROM g LEFT JOIN h USING (doc)""")
def comparability_verdicts(spark, sf_dir):
    """A verdict for every order's notes, with what conflicts and what is missing."""
    # equal keys make one report, which holds their lines together; only keys are shuffled
    orders = read(spark, sf_dir, "orders").filter("o_orderkey IS NOT NULL").groupBy(F.col("o_orderkey").alias("k")).agg(F.count("*").alias("copies")).withColumn("y", F.expr("CAST(2023 + k % 2 AS INT)"))
    printed = {}
    for i, (p, h, t) in enumerate(LINES):
        printed.setdefault(p, []).append(F.struct(F.lit(i).alias("n"), F.lit(float(h)).alias("y0"), F.lit(h + 10.0).alias("y1"), F.expr(t).alias("text")))
    pages = F.array(*(F.struct(F.lit(p).alias("page"), F.flatten(F.array_repeat(F.array(*lines), F.col("copies").cast("int"))).alias("lines")) for p, lines in printed.items()))
    out = C.comparability_of_reports(orders.select(F.col("k").alias("doc"), F.col("y").alias("report_year"), pages.alias("pages")))
    return out.select("doc", "status", F.array_join("conflicts", ",").alias("conflicts"), F.array_join("missing", ",").alias("missing"))
