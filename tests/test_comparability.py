import random
import re

from pyspark.sql import functions as F

from tallyframe.operators import comparability as C

NO, YES = "□适用√不适用", "√适用□不适用"


def brute(lines, year):
    """The verdict by plain loops over the pages of one report; lines are (page, n, y0, y1, text)."""
    pages = {}
    for p, n, y0, y1, t in sorted(lines, key=lambda x: (x[0], x[1])):
        pages.setdefault(p, []).append((y0, y1, re.sub(r"\s+", "", t or "")))
    headed = {p: any(f"{year}年年度报告" in t for *_, t in x) for p, x in pages.items()}
    conflicts, missing, evidence = [], [], set()
    for name, heading in C.BOXES.items():
        heading = f"{year}{heading}" if name == "first_adoption" else heading
        hit = None
        for p, x in pages.items():
            for i, (_, y1, t) in enumerate(x):
                if hit is None and heading in t and (name != "prior_error" or any(C.PRIOR_ERROR_ABOVE in a for *_, a in x[max(0, i - 3) : i])):
                    hit = (p, None)
                    for y0, _, c in x[i + 1 :]:
                        if not (y0 is not None and y1 is not None and y0 - y1 <= 36):
                            break
                        if c in (NO, YES):
                            hit = (p, c)
                            break
        if hit is None:
            missing.append(f"no_heading:{name}")
        elif hit[1] is None:
            missing.append(f"no_choice:{name}")
        elif not headed[hit[0]]:
            missing.append(f"no_year_on_page:{name}")
        else:
            evidence.add(f"{name}-p{hit[0]}")
            if hit[1] == YES:
                conflicts.append(f"applies:{name}")
    effects = {}
    for p, x in pages.items():
        for *_, t in x:
            amount = re.search(r"影响期初未分配利润(-?\d+(?:\.\d+)?)元", t)
            cause = next((n for n, words in C.CAUSES.items() if all(w in t for w in words)), None)
            if amount and cause:
                effects.setdefault(cause, []).append((p, float(amount[1])))
            zero = amount and float(amount[1]) == 0
            if all(any(w in t for w in words) for words in (C.SUBJECTS, C.PERIODS, C.ACTIONS)) and not zero:
                effects.setdefault("restated", []).append((p, 1))
    for cause in C.CAUSES:
        if any(v for _, v in effects.get(cause, [])):
            conflicts.append(f"not_zero:{cause}")
        if cause not in effects:
            missing.append(f"no_cause:{cause}")
        elif not headed[effects[cause][-1][0]]:
            missing.append(f"no_year_on_page:p{effects[cause][-1][0]}")
        else:
            evidence.add(f"opening-p{effects[cause][-1][0]}")
    if "restated" in effects:
        conflicts.append("restated")
        evidence |= {f"restated-p{p}" for p, _ in effects["restated"] if headed[p]}
    missing = list(dict.fromkeys(missing)) + ["no_evidence"] * (not evidence)
    status = "conflict" if conflicts else "insufficient_evidence" if missing else "verified"
    return status, conflicts, missing, evidence


def test_verdicts_equal_plain_loops(spark):
    rng = random.Random(12)
    parts = [
        "2024年年度报告", "2024年 年度报告全文", "重要会计政策变更", "1、重要会计政策 变更", "重要会计估计变更", "2024年起首次执行新会计准则或准则解释等涉及调整首次执行当年年初的财务报表", "前期会计差错更正", "追溯重述法",
        NO, NO, "□适用 √不适用", YES, "不适用", "由于准则进行追溯调整，影响期初未分配利润0元", "会计政策变更影响期初未分配利润-0.00元", "会计政策变更影响期初未分配利润3元", "重大会计差错更正影响期初未分配利润0.0元",
        "同一控制导致的合并范围变更影响期初未分配利润0元", "其他调整合计影响期初未分配利润 0 元", "本公司对上期数据追溯调整", "本集团前期追溯重述影响期初未分配利润0元", None, "",
    ]
    whole = [(1, "2024年年度报告"), (1, "重要会计政策变更"), (1, NO), (1, "重要会计估计变更"), (1, NO), (1, parts[5]), (1, NO), (2, "2024年年度报告"), (2, "前期会计差错更正"), (2, "追溯重述法"), (2, NO), *((2, parts[i]) for i in (13, 14, 16, 17, 18))]
    rows, reports = [], []
    for d in range(300):
        reports.append((d, 2024))
        base = [(p, t) for p, t in whole if rng.random() > (0.03 if d % 2 else 0)] if d % 5 else []
        extra = [(rng.choice((1, 2, 3)), rng.choice(parts)) for _ in range(rng.randrange(6))] if d % 4 else []
        for p, t in extra:
            base.insert(rng.randrange(len(base) + 1), (p, t))
        for n, (p, t) in enumerate(base):
            y = None if rng.random() < 0.02 else n * rng.choice((10.0, 14.0, 20.0))
            rows.append((d, p, n, y, None if y is None else y + 8, t))
    reports.append((3, 2024))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc int, page int, n int, y0 double, y1 double, text string, status string").drop("status").repartition(3)
    got = C.comparability(df, spark.createDataFrame(reports, "doc int, report_year int")).collect()
    assert len(got) == 300
    seen = set()
    for r in got:
        status, conflicts, missing, evidence = brute([x[1:] for x in rows if x[0] == r["doc"]], 2024)
        seen.add(status)
        assert (r["status"], r["conflicts"], r["missing"], set(r["evidence"])) == (status, conflicts, missing, evidence), r
        assert r["restatement"] == ("not_restated" if status == "verified" else "unknown")
    assert seen == {"verified", "conflict", "insufficient_evidence"}


def test_without_lines(spark):
    lines = spark.createDataFrame([], "doc int, page int, n int, y0 double, y1 double, text string")
    r = C.comparability(lines, spark.createDataFrame([(1, 2024)], "doc int, report_year int")).first()
    assert r["status"] == "insufficient_evidence" and r["missing"][-1] == "no_evidence" and len(r["missing"]) == 10
    assert C.comparability(lines, spark.createDataFrame([], "doc int, report_year int")).count() == 0


def test_reports_are_never_broadcast(spark):
    schema = "doc int, page int, n int, y0 double, y1 double, text string"
    rows = [(d, p, n, n * 14.0, n * 14.0 + 8, t) for d in range(4) for p in (1, 2) for n, t in enumerate(("2024年年度报告", "重要会计政策变更", YES if d == p else NO, "前期会计差错更正", "追溯重述法", NO))]
    lines, reports = spark.createDataFrame(rows, schema), spark.createDataFrame([(d, 2024) for d in range(5)], "doc int, report_year int")
    flat = C.comparability(lines, reports)
    assert "Broadcast" not in flat._jdf.queryExecution().executedPlan().toString()
    nested = lines.groupBy("doc", "page").agg(F.collect_list(F.struct("n", "y0", "y1", "text")).alias("lines")).groupBy("doc").agg(F.collect_list(F.struct("page", "lines")).alias("pages"))
    own = C.comparability_of_reports(reports.join(nested, "doc", "left"))
    assert sorted(flat.collect()) == sorted(own.collect()) and flat.count() == 5
