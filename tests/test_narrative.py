import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import retrieval as R

BLOCKS = "array<struct<page:int,x0:double,y0:double,text:string>>"


def brute(blocks, signals, year, parts, most, longest, total):
    """The same by plain loops: status, reason, ids and what each signal got."""
    has = lambda t, words: any(w in t for w in words)
    known = list(dict.fromkeys(s for s in signals or [] if s in R.SIGNAL_WORDS))
    blocks = [b for b in blocks or [] if b[3]]
    short = [re.sub(r"\s+", "", b[3]) for b in blocks]
    if not known:
        return "no_candidate_signal", [], {}
    if not blocks:
        return "source_has_no_text_blocks", [], dict.fromkeys(known)
    where, missing = {}, []
    for name, heading in (("mda", R.MDA_HEADING), ("financial_notes", R.NOTES_HEADING)):
        at = [i for i, t in enumerate(short) if re.search(heading, t)]
        if not at:
            missing.append(name)
            continue
        stops = [i for i in range(at[0] + 1, len(blocks)) if re.search(R.TOP_LEVEL_HEADING, short[i])]
        where[name] = range(at[0] + 1, stops[0] if stops else len(blocks))
    if missing:
        return "required_section_heading_missing:" + ",".join(missing), [], dict.fromkeys(known)
    found = []
    for name, places in where.items():
        for i in places:
            t = short[i]
            if len(blocks[i][3]) > longest:
                continue
            cash = has(t, R.CASH_WORDS) and (has(t, R.OPERATING_WORDS) or not has(t, R.OTHER_CASH_WORDS))
            context = has(t, R.CONTEXT_WORDS) or (year is not None and (str(year) in t or str(year - 1) in t))
            told = [s for s in known if cash or (has(t, R.SIGNAL_WORDS[s]) and (context or has(t, R.REASON_WORDS)))]
            if told:
                score = max(4 * cash + 3 * has(t, R.SIGNAL_WORDS[s]) for s in told) + 2 * (cash and has(t, R.OPERATING_WORDS))
                score += context + has(t, R.REASON_WORDS) + has(t, R.DETAIL_WORDS) + (name == "mda")
                p, x, y, raw = blocks[i]
                eid = "nctx-" + hashlib.sha256("\n".join([*parts, name, str(p), str(x), str(y), raw]).encode()).hexdigest()[:20]
                found.append((-score, p, y, x, eid, name, raw, told))
    if not found:
        return "no_relevant_snippets_within_per_snippet_limit", [], dict.fromkeys(known)
    found.sort()
    chosen, chars = [], 0
    for c in [next((c for c in found if c[5] == n), None) for n in where] + found:
        if c and c not in chosen and len(chosen) < most and chars + len(c[6]) <= total:
            chosen.append(c)
            chars += len(c[6])
    if not chosen:
        return "no_relevant_snippets_within_total_budget", [], dict.fromkeys(known)
    got = {}
    for s in known:
        ids = [c[4] for c in chosen if s in c[7]]
        got[s] = ids or ("snippet_budget_exhausted" if any(s in c[7] for c in found) else "no_relevant_snippet_for_signal")
    return None, [c[4] for c in chosen], got


def test_retrieval_equals_plain_loops(spark):
    rng = random.Random(8)
    words = [*R.CASH_WORDS, *R.OPERATING_WORDS, *R.OTHER_CASH_WORDS, *(w for x in R.SIGNAL_WORDS.values() for w in x), *R.CONTEXT_WORDS, *R.REASON_WORDS, *R.DETAIL_WORDS, "2024 年", "2023", "公司", "其他"]
    heads = ["第三节 管理层讨论与分析", "管理层讨论与分析", "财务报表附注", "七、合并财务报表项目注释", "第四节 公司治理", "第10节 其他", "附注"]
    sentence = lambda: rng.choice(("", " ")).join(rng.choices(words, k=rng.randrange(1, 5))) + "。" * rng.choice((0, 0, 3, 40))
    rows = []
    for i in range(150):
        blocks = [(1 + k // 5, float(rng.randrange(3)), float(rng.randrange(4)), rng.choice([sentence(), sentence(), sentence(), rng.choice(heads), "", None])) for k in range(rng.choice((0, 3, 12, 25)))]
        if i % 3:
            blocks = [(1, 0.0, 0.0, heads[1]), *blocks[: len(blocks) // 2], (2, 0.0, 0.0, heads[2]), *blocks[len(blocks) // 2 :]]
        rows.append((str(i), blocks, rng.choice([["profit_up_cash_down"], list(R.SIGNAL_WORDS), ["revenue_up_cash_down", "other", None, "revenue_up_cash_down"], [], None]), rng.choice((2024, None))))
    rows.append(("none", None, ["profit_up_cash_down"], 2024))
    rows.append(("two", [(1, 0.0, 0.0, heads[1]), (1, 0.0, 1.0, "净利润同比增加"), (1, 0.0, 2.0, "营业收入同比"), (2, 0.0, 0.0, heads[2])], list(R.SIGNAL_WORDS), 2024))
    df = spark.createDataFrame(rows, f"id string, blocks {BLOCKS}, signals array<string>, report_year int").repartition(3)
    seen = set()
    for most, longest, total in ((4, 60, 90), (2, 900, 2600), (1, 20, 5), (1, 900, 4000)):
        got = R.retrieve(df, [F.col("id")], max_snippets=most, max_chars=longest, max_total=total)
        for r in got.collect():
            row = next(x for x in rows if x[0] == r["id"])
            reason, ids, signals = brute(*row[1:4], [row[0]], most, longest, total)
            seen.add((reason or "").split(":")[0])
            seen |= {x for x in signals.values() if isinstance(x, str)}
            assert (r["reason"], [s["evidence_id"] for s in r["snippets"]], r["status"]) == (reason, ids, "abstained" if reason else "retrieved")
            told = {x["signal"]: x["reason"] or x["evidence_ids"] for x in r["signal_results"]}
            assert told == {s: reason or v for s, v in signals.items()}
    assert seen == {"", "no_candidate_signal", "source_has_no_text_blocks", "required_section_heading_missing", "no_relevant_snippets_within_per_snippet_limit", "no_relevant_snippets_within_total_budget", "snippet_budget_exhausted", "no_relevant_snippet_for_signal"}


def test_retrieval_faults_and_limits(spark):
    df = spark.createDataFrame([("a", [(1, 0.0, 0.0, "x")], ["profit_up_cash_down"], 2024, "bad_source"), ("b", None, None, None, "bad_source")], f"id string, blocks {BLOCKS}, signals array<string>, report_year int, fault string")
    got = {r["id"]: (r["reason"], r["sections_found"]) for r in R.retrieve(df, [F.col("id")], fault=F.col("fault")).collect()}
    assert got == {"a": ("bad_source", []), "b": ("no_candidate_signal", [])}
    assert R.retrieve(df.limit(0), [F.col("id")]).count() == 0
    for limits in ({"max_snippets": 9}, {"max_chars": 0}, {"max_total": 4001}):
        with pytest.raises(ValueError, match="limits"):
            R.retrieve(df, [F.col("id")], **limits)


def test_source_faults_in_order(spark):
    sha = "ab" * 32
    good = ("c", 2024, "d", sha, "d", sha.upper(), " c ", "2024-12-31")
    cases = [
        (good, None),
        ((None, *good[1:]), "report_company_id_missing_or_invalid"),
        ((" ", 1, *good[2:]), "report_company_id_missing_or_invalid"),
        ((*good[:1], 1899, *good[2:]), "report_year_missing_or_invalid"),
        ((*good[:1], None, *good[2:]), "report_year_missing_or_invalid"),
        ((*good[:3], "xyz", *good[4:]), "report_source_identity_missing_or_invalid"),
        ((*good[:4], "e", *good[5:]), "source_document_id_mismatch"),
        ((*good[:4], None, *good[5:]), "source_document_id_mismatch"),
        ((*good[:5], "cd" * 32, *good[6:]), "source_record_hash_mismatch"),
        ((*good[:6], "", good[7]), "source_record_company_id_missing_or_invalid"),
        ((*good[:6], "z", good[7]), "source_company_id_mismatch"),
        ((*good[:7], "2024-13-31"), "source_record_report_period_missing_or_invalid"),
        ((*good[:7], "2024"), "source_record_report_period_missing_or_invalid"),
        ((*good[:7], "2023-12-31"), "source_report_period_mismatch"),
    ]
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, company string, year int, document string, sha256 string, of_document string, of_sha string, of_company string, period string")
    fault = R.source_fault({c: F.col(c) for c in ("company", "year", "document", "sha256")}, {"document": F.col("of_document"), "sha256": F.col("of_sha"), "company": F.col("of_company"), "period": F.col("period")})
    assert [r[0] for r in df.orderBy("i").select(fault).collect()] == [want for _, want in cases]
