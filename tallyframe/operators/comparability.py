"""Whether a report's years can be compared: boxes, zero effects, disclosures, and page headings, into one verdict a report.

Lines are gathered by page, where headings meet the choice printed below them; what a page finds is a few rows, and these
come together by report. The verdict is the highest of three grades: a conflict outweighs what is missing, and only without
either is a report verified.

Defined cases: null texts are empty lines; lines without a height meet no choice; a report without lines is insufficient,
with all that it lacks; reports are told apart by doc, and equal docs are one report.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.text import compact
from tallyframe.operators.evidence import choice

# Headings over the boxes, the heading that must stand close above the last of them, causes of adjustments
# and the words that tell them, and the words of a disclosed restatement.
BOXES = {"policy_change": "重要会计政策变更", "estimate_change": "重要会计估计变更", "first_adoption": "年起首次执行新会计准则或准则解释等涉及调整首次执行当年年初的财务报表", "prior_error": "追溯重述法"}
PRIOR_ERROR_ABOVE = "前期会计差错更正"
CAUSES = {"standards": ("准则", "追溯调整"), "policy": ("会计政策变更",), "error": ("重大会计差错更正",), "scope": ("同一控制", "合并范围变更"), "other": ("其他调整合计",)}
OPENING_EFFECT = "影响期初未分配利润"
SUBJECTS = ("本集团", "本公司", "公司已", "集团已")
PERIODS = ("上期", "前期", "比较数据", "比较报表", "2023年", "以前年度")
ACTIONS = ("追溯调整", "追溯重述", "重新列报", "比较数据调整")
#: How far below its heading a choice may stand.
REACH = 36.0


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, (text.contains(w) for w in words))


def opening_effect(text: Column) -> Column:
    """The amount by which a line says that opening profits are affected, as printed; empty if it says nothing."""
    return F.regexp_extract(text, OPENING_EFFECT + r"(-?\d+(?:\.\d+)?)元", 1)


def cause_of(text: Column) -> Column:
    return F.coalesce(*(F.when(reduce(Column.__and__, (text.contains(w) for w in words)), name) for name, words in CAUSES.items()))


def restates(text: Column) -> Column:
    """A disclosed restatement: who, which period, and that it was restated, unless the effect is told to be zero."""
    amount = opening_effect(text)
    zero = text.contains(OPENING_EFFECT) & (amount != "") & (amount.try_cast("decimal(38,10)") == 0)
    return any_of(text, SUBJECTS) & any_of(text, PERIODS) & any_of(text, ACTIONS) & ~F.coalesce(zero, F.lit(False))


def choice_below(lines: Column, i: Column) -> Column:
    """The first choice printed after line i, on lines that follow it without one too far below in between."""
    own = F.get(lines, i)
    after = F.slice(lines, i + 2, F.size(lines))
    far = F.transform(after, lambda x: ~F.coalesce(x["y0"] - own["y1"] <= REACH, F.lit(False)))
    near = F.slice(after, 1, F.coalesce(F.nullif(F.array_position(far, F.lit(True)), F.lit(0)) - 1, F.size(lines)).cast("int"))
    return F.get(F.filter(F.transform(near, lambda x: choice(x["text"])), lambda c: c.isNotNull()), 0)


def page_findings(lines: Column, year: Column) -> Column:
    """Of a page's lines in order: headed (the page has the report's year) and found, an array of kind, name, at (place on
    the page) and applies (of a box: true, false, or null without a choice; of a cause: whether its amount is not zero)."""
    year = year.cast("string")

    def boxes(i, x, name, heading):
        told = x["text"].contains(heading)
        if name == "first_adoption":
            told = told & x["text"].contains(F.concat(year, F.lit(heading)))
        if name == "prior_error":
            above = F.slice(lines, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3)))
            told = told & (i > 0) & F.exists(above, lambda a: a["text"].contains(PRIOR_ERROR_ABOVE))
        return told, F.struct(F.lit("box").alias("kind"), F.lit(name).alias("name"), i.alias("at"), choice_below(lines, i).alias("applies"))

    def cause(i, x):
        amount, name = opening_effect(x["text"]), cause_of(x["text"])
        nonzero = ~F.coalesce(amount.try_cast("decimal(38,10)") == 0, F.lit(False))
        return x["text"].contains(OPENING_EFFECT) & (amount != "") & name.isNotNull(), F.struct(F.lit("cause").alias("kind"), name.alias("name"), i.alias("at"), nonzero.alias("applies"))

    def restated(i, x):
        return restates(x["text"]), F.struct(F.lit("restated").alias("kind"), F.lit("restated").alias("name"), i.alias("at"), F.lit(True).alias("applies"))

    # one pass for each kind of finding: a line that is none of a kind costs one look for a word
    def hits(test, *given):
        return F.filter(F.transform(lines, lambda x, i: F.when(*test(i, x, *given))), lambda f: f.isNotNull())

    found = F.concat(*(hits(boxes, n, h) for n, h in BOXES.items()), hits(cause), hits(restated))
    headed = F.exists(lines, lambda x: x["text"].contains(F.concat(year, F.lit("年年度报告"))))
    return F.struct(headed.alias("headed"), found.alias("found"))


def findings(lines: DataFrame, reports: DataFrame) -> DataFrame:
    """doc, page, headed, kind, name, at and applies (as page_findings has them) of all lines. Reports are never broadcast:
    there may be as many as there are pages."""
    text = compact(F.coalesce("text", F.lit("")))
    pages = lines.withColumn("text", text).groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("n", "y0", "y1", "text"))).alias("lines")).join(reports.select("doc", "report_year").distinct().hint("merge"), "doc")
    pages = pages.select("doc", "page", page_findings(F.col("lines"), F.col("report_year")).alias("p")).select("doc", "page", "p.headed", F.explode_outer("p.found").alias("f"))
    return pages.filter("f IS NOT NULL").select("doc", "page", "headed", "f.*")


def comparability(lines: DataFrame, reports: DataFrame) -> DataFrame:
    """doc, status (conflict, insufficient_evidence, verified), restatement (not_restated or unknown), conflicts, missing
    and evidence (topic and page of all that was found under the report's heading). Lines have doc, page, n (place on the
    page), y0, y1, text; reports have doc and report_year. Of a box its first heading counts, of a cause its last line."""
    found = findings(lines, reports).groupBy("doc").agg(F.collect_list(F.struct("page", "headed", "kind", "name", "at", "applies")).alias("found"))
    return verdicts(reports.select("doc", "report_year").distinct().join(found.hint("merge"), "doc", "left"))


def comparability_of_reports(reports: DataFrame) -> DataFrame:
    """The same for reports that hold their pages: doc (once each), report_year and pages, an array of page and lines (an
    array of n, y0, y1, text). All of it is an expression on the report's own row, and nothing is shuffled."""
    shown = lambda ls: F.sort_array(F.transform(ls, lambda x: F.struct(x["n"].alias("n"), x["y0"].alias("y0"), x["y1"].alias("y1"), compact(F.coalesce(x["text"], F.lit(""))).alias("text"))))
    pages = F.transform("pages", lambda p: F.struct(p["page"].alias("page"), shown(p["lines"]).alias("lines")))
    pages = F.transform(pages, lambda p: F.struct(p["page"].alias("page"), page_findings(p["lines"], F.col("report_year")).alias("p")))
    found = F.flatten(F.transform(pages, lambda p: F.transform(p["p"]["found"], lambda f: F.struct(p["page"].alias("page"), p["p"]["headed"].alias("headed"), *(f[c].alias(c) for c in ("kind", "name", "at", "applies"))))))
    return verdicts(reports.select("doc", found.alias("found")))


def verdicts(docs: DataFrame) -> DataFrame:
    """The verdict of each doc from found, an array of page, headed, kind, name, at, applies; null if nothing is found."""
    docs = docs.select("doc", F.coalesce("found", F.array()).alias("found"))
    mine = lambda kind, name: F.filter("found", lambda f: (f["kind"] == kind) & (f["name"] == name))
    of = lambda found, *fields: F.transform(found, lambda f: F.struct(*(f[c].alias(c) for c in fields)))
    aggregates = {f"box_{n}": F.array_min(of(mine("box", n), "page", "at", "applies", "headed")) for n in BOXES}
    for n in CAUSES:
        aggregates[f"cause_{n}"] = F.array_max(of(mine("cause", n), "page", "at", "headed"))
        aggregates[f"nonzero_{n}"] = F.exists(mine("cause", n), lambda f: f["applies"])
    restated = lambda f: f["kind"] == "restated"
    aggregates["restated"] = F.exists("found", restated)
    aggregates["restated_pages"] = F.array_sort(F.array_distinct(F.transform(F.filter("found", lambda f: restated(f) & f["headed"]), lambda f: f["page"])))
    docs = docs.select("doc", *(c.alias(n) for n, c in aggregates.items()))
    conflicts, missing, evidence = [], [], []
    for n in BOXES:
        box = F.col(f"box_{n}")
        usable = box["headed"] & box["applies"].isNotNull()
        conflicts.append(F.when(usable & box["applies"], f"applies:{n}"))
        missing.append(F.when(box.isNull(), f"no_heading:{n}").when(box["applies"].isNull(), f"no_choice:{n}").when(~box["headed"], f"no_year_on_page:{n}"))
        evidence.append(F.when(usable, F.concat(F.lit(f"{n}-p"), box["page"].cast("string"))))
    for n in CAUSES:
        last = F.col(f"cause_{n}")
        conflicts.append(F.when(F.col(f"nonzero_{n}"), f"not_zero:{n}"))
        missing.append(F.when(last.isNull(), f"no_cause:{n}").when(~last["headed"], F.concat(F.lit("no_year_on_page:p"), last["page"].cast("string"))))
        evidence.append(F.when(last["headed"], F.concat(F.lit("opening-p"), last["page"].cast("string"))))
    conflicts.append(F.when(F.col("restated"), "restated"))
    listed = lambda items: F.array_distinct(F.array_compact(F.array(*items)))
    pages = F.coalesce(F.transform("restated_pages", lambda p: F.concat(F.lit("restated-p"), p.cast("string"))), F.array().cast("array<string>"))
    docs = docs.select("doc", listed(conflicts).alias("conflicts"), listed(missing).alias("missing"), F.concat(listed(evidence), pages).alias("evidence"))
    docs = docs.withColumn("missing", F.when(F.size("evidence") == 0, F.array_append("missing", "no_evidence")).otherwise(F.col("missing")))
    status = F.when(F.size("conflicts") > 0, "conflict").when(F.size("missing") > 0, "insufficient_evidence").otherwise("verified")
    docs = docs.withColumn("status", status)
    return docs.select("doc", "status", F.when(F.col("status") == "verified", "not_restated").otherwise("unknown").alias("restatement"), "conflicts", "missing", "evidence")
