"""Bounded retrieval of narrative blocks for the signals of a report.

A report is one row with its blocks as an array, so sections, scores, the selection and the reasons for abstaining are column
expressions on that row: nothing is shuffled, and a report never meets another one's blocks.

Defined cases: null and empty blocks text match nothing; a null array has no blocks; null signals are no signals; blocks of
equal score are ordered by page, height, left edge and evidence id; a report without rows stays one row with its reason.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.text import compact, evidence_id

# Signals with the words that speak of them, and the words and headings of annual reports.
CASH_WORDS = ("经营活动产生的现金流量净额", "经营活动现金流", "现金流量表", "现金流量", "现金流")
OPERATING_WORDS = ("经营活动", "经营性应收", "经营性应付", "经营现金流")
OTHER_CASH_WORDS = ("投资活动", "筹资活动")
SIGNAL_WORDS = {
    "profit_up_cash_down": ("净利润", "净利率", "归属于上市公司股东的净利润"),
    "revenue_up_cash_down": ("营业收入", "销售收入", "收入确认", "收入合同", "合同負債", "合同负债"),
}
CONTEXT_WORDS = ("本期", "本年", "上年同期", "报告期", "同比", "较上期")
REASON_WORDS = ("原因", "主要是", "由于", "变动说明", "增加", "减少", "上升", "下降")
DETAIL_WORDS = ("现金流入", "现金流出", "经营活动产生的现金流量净额", "收到", "支付", "将净利润调节为经营活动现金流量", "经营性应收", "经营性应付")
SECTIONS = ("mda", "financial_notes")
MDA_HEADING = r"^(?:第[一二三四五六七八九十百\d]+节)?管理层讨论与分析$"
NOTES_HEADING = r"^(?:(?:第[一二三四五六七八九十百\d]+节)?(?:合并)?财务报表(?:项目)?附注|(?:[一二三四五六七八九十百\d]+[、.．])?(?:合并)?财务报表项目注释)$"
TOP_LEVEL_HEADING = r"^第(?:[一二三四五六七八九十百]+|\d+)节"


@dataclass(frozen=True)
class Vocabulary:
    """Words by what they tell of a block, and patterns of headings on text without white space."""

    signals: dict[str, Sequence[str]]
    cash: Sequence[str]
    operating: Sequence[str]
    other_cash: Sequence[str]
    context: Sequence[str]
    reasons: Sequence[str]
    detail: Sequence[str]
    mda: str
    notes: str
    top_level: str


ANNUAL = Vocabulary(SIGNAL_WORDS, CASH_WORDS, OPERATING_WORDS, OTHER_CASH_WORDS, CONTEXT_WORDS, REASON_WORDS, DETAIL_WORDS, MDA_HEADING, NOTES_HEADING, TOP_LEVEL_HEADING)


def any_of(text: Column, words: Sequence[str]) -> Column:
    return text.rlike("|".join(re.escape(w) for w in words)) if words else F.lit(False)


def bounds(blocks: Column, heading: str, top_level: str) -> Column:
    """First and last-but-one place of the section that the first block with this heading opens: it ends before the next
    top-level heading. Null without such a block."""
    at = lambda test: F.transform(blocks, lambda b, i: F.when(F.coalesce(compact(b["text"]).rlike(test), F.lit(False)), i))
    first = F.array_min(F.filter(at(heading), lambda i: i.isNotNull()))
    later = F.array_min(F.filter(at(top_level), lambda i: i > first))
    return F.when(first.isNotNull(), F.struct((first + 1).alias("start"), F.coalesce(later, F.size(blocks)).alias("stop")))


def scored(block: Column, section: str, signals: Column, year: Column, words: Vocabulary, id_parts: Sequence[Column]) -> Column:
    """The block as a candidate: rank keys, text, section and the signals that it speaks of (none: no candidate)."""
    text = F.coalesce(compact(block["text"]), F.lit(""))
    operating, cash = any_of(text, words.operating), any_of(text, words.cash)
    cash = cash & (operating | ~any_of(text, words.other_cash))
    years = F.coalesce(text.contains(year.cast("string")) | text.contains((year - 1).cast("string")), F.lit(False))
    context, reasons = any_of(text, words.context) | years, any_of(text, words.reasons)
    told = F.lit(False)
    spoken_of = lambda s: F.coalesce(F.when(s.isNull(), told), *(F.when(s == name, any_of(text, terms)) for name, terms in words.signals.items()), told)
    matched = F.filter(signals, lambda s: cash | (spoken_of(s) & (context | reasons)))
    best = F.array_max(F.transform(matched, lambda s: 4 * cash.cast("int") + 3 * spoken_of(s).cast("int")))
    score = best + 2 * (cash & operating).cast("int") + context.cast("int") + reasons.cast("int") + any_of(text, words.detail).cast("int") + int(section == SECTIONS[0])
    name = evidence_id("nctx-", *id_parts, F.lit(section), block["page"].cast("string"), block["x0"].cast("string"), block["y0"].cast("string"), block["text"])
    return F.struct((-score).alias("rank"), block["page"].alias("page"), block["y0"].alias("y0"), block["x0"].alias("x0"), name.alias("evidence_id"), F.lit(section).alias("section"), block["text"].alias("text"), matched.alias("signals"))


def selected(candidates: Column, max_snippets: int, max_total: int) -> Column:
    """Places of the chosen candidates, in order of choice: the best of each section first, then all in order; one that
    would go beyond max_total characters is passed over and the next is tried, until max_snippets are chosen."""
    places = F.transform(candidates, lambda c, i: F.struct(i.alias("i"), c["section"].alias("section")))
    of = lambda name: lambda p: p["section"] == name
    firsts = [F.slice(F.filter(places, of(name)), 1, 1)["i"] for name in SECTIONS]
    order = F.concat(*firsts, places["i"])
    start = F.struct(F.array().cast("array<int>").alias("chosen"), F.lit(0).alias("chars"))

    def step(s, i):
        size = F.length(F.get(candidates, i)["text"])
        fits = ~F.array_contains(s["chosen"], i) & (F.size(s["chosen"]) < max_snippets) & (s["chars"] + size <= max_total)
        return F.struct(F.when(fits, F.array_append(s["chosen"], i)).otherwise(s["chosen"]).alias("chosen"), F.when(fits, s["chars"] + size).otherwise(s["chars"]).alias("chars"))

    return F.aggregate(order, start, step, lambda s: s["chosen"])


def retrieve(reports: DataFrame, id_parts: Sequence[Column], fault: Column | None = None, words: Vocabulary = ANNUAL, max_snippets: int = 4, max_chars: int = 900, max_total: int = 2600) -> DataFrame:
    """Adds status, reason, sections_found, snippets and signal_results to reports, which have blocks (an array of page,
    x0, y0, text in reading order), signals (names of candidate signals) and report_year. The first reason to abstain
    counts: no signal, the report's own fault, no blocks, a section missing, no candidate, none within the budget."""
    if not 0 < max_snippets <= 8 or not 0 < max_chars <= 1200 or not 0 < max_total <= 4000:
        raise ValueError("limits of retrieval must be positive and not above 8 snippets, 1200 and 4000 characters")
    known = F.coalesce(F.array_distinct(F.filter("signals", lambda s: s.isin(list(words.signals)))), F.array().cast("array<string>"))
    blocks = F.filter("blocks", lambda b: F.coalesce(b["text"], F.lit("")) != "")
    rows = reports.withColumn("_signals", known).withColumn("_blocks", F.coalesce(blocks, F.filter("blocks", lambda b: F.lit(False)), F.from_json(F.lit("[]"), reports.schema["blocks"].dataType)))
    heads = {SECTIONS[0]: words.mda, SECTIONS[1]: words.notes}
    for name, heading in heads.items():
        rows = rows.withColumn(f"_{name}", bounds(F.col("_blocks"), heading, words.top_level))
    inside = lambda name: F.coalesce(F.slice("_blocks", F.col(f"_{name}.start") + 1, F.greatest(F.col(f"_{name}.stop") - F.col(f"_{name}.start"), F.lit(0))), F.filter("_blocks", lambda b: F.lit(False)))
    short = lambda name: F.filter(inside(name), lambda b: F.length(b["text"]) <= max_chars)
    score_in = lambda name: lambda b: scored(b, name, F.col("_signals"), F.col("report_year"), words, id_parts)
    found = F.concat(*(F.transform(short(name), score_in(name)) for name in SECTIONS))
    rows = rows.withColumn("_found", F.array_sort(F.filter(found, lambda c: F.size(c["signals"]) > 0)))
    rows = rows.withColumn("_chosen", selected(F.col("_found"), max_snippets, max_total))
    missing = F.array_compact(F.array(*(F.when(F.col(f"_{name}").isNull(), name) for name in SECTIONS)))
    reason = F.coalesce(
        F.when(F.size("_signals") == 0, "no_candidate_signal"),
        *([] if fault is None else [fault]),
        F.when(F.size("_blocks") == 0, "source_has_no_text_blocks"),
        F.when(F.size(missing) > 0, F.concat(F.lit("required_section_heading_missing:"), F.array_join(missing, ","))),
        F.when(F.size("_found") == 0, "no_relevant_snippets_within_per_snippet_limit"),
        F.when(F.size("_chosen") == 0, "no_relevant_snippets_within_total_budget"),
    )
    rows = rows.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "retrieved").otherwise("abstained"))
    picked = F.transform("_chosen", lambda i: F.get("_found", i).dropFields("rank"))
    rows = rows.withColumn("snippets", F.when(F.col("reason").isNull(), picked).otherwise(F.filter(picked, lambda c: F.lit(False))))

    def outcome(s):
        ids = F.transform(F.filter("snippets", lambda c: F.array_contains(c["signals"], s)), lambda c: c["evidence_id"])
        why = F.when(F.exists("_found", lambda c: F.array_contains(c["signals"], s)), "snippet_budget_exhausted").otherwise("no_relevant_snippet_for_signal")
        got = F.size(ids) > 0
        return F.struct(s.alias("signal"), F.when(got, "retrieved").otherwise("abstained").alias("status"), ids.alias("evidence_ids"), F.when(~got, F.coalesce(F.col("reason"), why)).alias("reason"))

    names = F.array_compact(F.array(*(F.when(F.col(f"_{name}").isNotNull(), name) for name in SECTIONS)))
    reached = F.when(F.col("reason").isNull() | F.col("reason").rlike("^(required|no_relevant)"), names).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("signal_results", F.transform("_signals", outcome)).withColumn("sections_found", reached).select(*reports.columns, "status", "reason", "sections_found", "snippets", "signal_results")


def source_fault(report: dict[str, Column], source: dict[str, Column]) -> Column:
    """The first fault of a report's identity against its source's record, or null. Both have document, sha256, company;
    the report has year, the source period (yyyy-mm-dd)."""
    told = lambda c: F.nullif(F.trim(c), F.lit(""))
    sha = lambda c: F.when(F.lower(F.trim(c)).rlike("^[0-9a-f]{64}$"), F.lower(F.trim(c)))
    differs = lambda a, b: ~a.eqNullSafe(b)
    period = told(source["period"])
    day = F.when(period.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(period, "yyyy-MM-dd"))
    steps = (
        (told(report["company"]).isNull(), "report_company_id_missing_or_invalid"),
        (F.coalesce(~report["year"].between(1900, 2200), F.lit(True)), "report_year_missing_or_invalid"),
        (told(report["document"]).isNull() | sha(report["sha256"]).isNull(), "report_source_identity_missing_or_invalid"),
        (differs(told(source["document"]), told(report["document"])), "source_document_id_mismatch"),
        (differs(sha(source["sha256"]), sha(report["sha256"])), "source_record_hash_mismatch"),
        (told(source["company"]).isNull(), "source_record_company_id_missing_or_invalid"),
        (differs(told(source["company"]), told(report["company"])), "source_company_id_mismatch"),
        (day.isNull(), "source_record_report_period_missing_or_invalid"),
        (F.year(day) != report["year"], "source_report_period_mismatch"),
    )
    return F.coalesce(*(F.when(test, name) for test, name in steps))
