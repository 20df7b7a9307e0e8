"""Words with positions: visual lines with their members, and a fact read from a table by where its words stand.

Words come as doc, page, x0, y0, x1, y1, word. They meet by page for visual lines, by document for the table, in one shuffle;
everything after it is an expression on the page's or document's own row, and those that hold their words need none.

Defined cases: words without text or position are left out; words of equal place are ordered by their text; a document
without words does not occur; the first failed gate is the document's code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.text import compact, let, parse_amount
from tallyframe.operators.alignment import one_each

# Titles of the table's section and of the next one, its first heading, the words over the column of changes,
# the row, and how units, currencies and amounts of this table are printed.
SECTION, NEXT_SECTION = ("(一)主要会计数据", "（一）主要会计数据"), ("(二)主要财务指标", "（二）主要财务指标")
FIRST_HEADING = "主要会计数据"
CHANGE, CHANGE_WORDS = "本期比上年同期", ("增减", "%")
ROW = "归属于上市公司股东的扣除非经常性损益的净利润"
AMOUNT = r"^[（(]?\s*[-＋+－−–]?\s*(?:\d{1,3}(?:[,，]\d{3})+(?:\.\d+)?|\d+\.\d+)\s*[）)]?$"
CURRENCIES = "人民币|美元|港币|港元|欧元|日元|英镑|新加坡元"
MULTIPLIERS = {"元": 1, "万元": 10_000, "亿元": 100_000_000}
LABEL_LINES, LABEL_GAP, BAND_MARGIN, HEADING_REACH = 4, 28.0, 3.0, 24.0

PLACE = ("x0", "y0", "x1", "y1")


def placed(words: DataFrame) -> DataFrame:
    return words.filter(reduce(Column.__and__, (F.col(c).isNotNull() for c in ("page", *PLACE, "word"))))


def visual_lines(words: DataFrame, tolerance: float = 2.5) -> DataFrame:
    """doc, page, line (from 0), y (of its first word) and words of each visual line: words from top to bottom, where one
    farther below the line's first word than the tolerance begins the next. Words of a line are from left to right."""
    at = F.collect_list(F.struct(*PLACE, "word")).alias("words")
    return visual_lines_of(placed(words).groupBy("doc", "page").agg(at), tolerance)


def visual_lines_of(pages: DataFrame, tolerance: float = 2.5) -> DataFrame:
    """The same for pages that hold their words, an array of x0, y0, x1, y1, word with none of them null; nothing is
    shuffled. As words are in order from top to bottom, a line is a slice of them."""
    by = lambda words, *names: F.array_sort(F.transform(words, lambda w: F.struct(*(w[n].alias(n) for n in names))))
    pages = pages.select("doc", "page", by("words", "y0", "x0", "x1", "y1", "word").alias("words"))
    start = F.struct(F.lit(None).cast("double").alias("y"), F.lit(1).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(s, w):
        new = s["y"].isNull() | (w["y0"] - s["y"] > tolerance)
        return F.struct(F.when(new, w["y0"].cast("double")).otherwise(s["y"]).alias("y"), (s["at"] + 1).alias("at"), F.when(new, F.array_append(s["starts"], s["at"])).otherwise(s["starts"]).alias("starts"))

    pages = pages.withColumn("starts", F.aggregate("words", start, step, lambda s: s["starts"]))
    members = lambda at, i: F.slice("words", at, F.coalesce(F.get("starts", i + 1), F.size("words") + 1) - at)
    lines = F.transform("starts", lambda at, i: F.struct(F.element_at("words", at)["y0"].alias("y"), by(members(at, i), "x0", "y0", "x1", "y1", "word").alias("words")))
    rows = pages.select("doc", "page", F.posexplode(lines).alias("line", "l"))
    return rows.select("doc", "page", "line", "l.y", "l.words")


def baseline_lines(words: Column) -> Column:
    """Lines of a document's words, those of one page and height: page, y (rounded height, half to even), words from left to
    right, bottom and text, in order from top to bottom. As words are put in that order, a line is a slice of them."""
    ordered = F.sort_array(F.transform(words, lambda w: F.struct(w["page"].alias("page"), F.bround(w["y0"]).cast("double").alias("y"), *(w[c].alias(c) for c in (*PLACE, "word")))))
    starts = lambda ws: F.filter(F.transform(ws, lambda w, i: F.when((i == 0) | ~w["page"].eqNullSafe(F.get(ws, i - 1)["page"]) | ~w["y"].eqNullSafe(F.get(ws, i - 1)["y"]), i + 1)), lambda at: at.isNotNull())

    def line(mine):
        first = F.get(mine, 0)
        members = F.transform(mine, lambda w: F.struct(*(w[c].alias(c) for c in (*PLACE, "word"))))
        return F.struct(first["page"].alias("page"), first["y"].alias("y"), members.alias("words"), F.array_max(F.transform(mine, lambda w: w["y1"])).alias("bottom"), F.array_join(F.transform(mine, lambda w: w["word"]), " ").alias("text"))

    cut = lambda ws, starts: F.transform(starts, lambda at, i: let(F.slice(ws, at, F.coalesce(F.get(starts, i + 1), F.size(ws) + 1) - at), line))
    return let(ordered, lambda ws: let(starts(ws), lambda starts: cut(ws, starts)))


def _flagged(line: Column) -> Column:
    centre = lambda w: (w["x0"] + w["x1"]) / 2

    def flags(short):
        is_year = F.filter(line["words"], lambda w: w["word"].startswith("20") & w["word"].rlike("^20[0-9]{2}年$"))
        years = F.array_sort(F.transform(is_year, lambda w: F.struct(centre(w).alias("x"), F.substring(w["word"], 1, 4).cast("int").alias("year"), w["x0"].alias("x0"), w["x1"].alias("x1"))))
        told = F.array_distinct(F.regexp_extract_all(short, F.lit(f"币种[:：]({CURRENCIES})"), F.lit(1)))
        unit = F.nullif(F.regexp_extract(short, "单位[:：](亿元|万元|元)", 1), F.lit(""))
        unit_line = short.startswith("单位：") | short.startswith("单位:")
        return F.struct(
            *(line[c].alias(c) for c in ("page", "y", "words", "bottom", "text")),
            F.when(short.isin(*SECTION), 1).when(short.isin(*NEXT_SECTION), 2).alias("section"),
            F.when(short.startswith(FIRST_HEADING), years).alias("years"),
            (short.contains(CHANGE) | reduce(Column.__and__, (short.contains(w) for w in CHANGE_WORDS))).alias("change"),
            unit_line.alias("unit_line"),
            F.when(unit_line & unit.isNotNull() & (F.size(told) <= 1), F.struct(unit.alias("unit"), F.get(told, 0).alias("currency"))).alias("unit"),
            F.startswith(line["text"], F.lit(FIRST_HEADING)).alias("heads"),
        )

    return let(compact(line["text"]), flags)


def left_parts(body: Column, limit: Column) -> Column:
    """Of each line, what its words of the left column make: page, y, heads, part, and top and bottom of these words."""

    def part(x):
        made = lambda words: F.struct(x["page"].alias("page"), x["y"].alias("y"), x["heads"].alias("heads"), compact(F.array_join(F.transform(words, lambda w: w["word"]), "")).alias("part"), F.array_min(F.transform(words, lambda w: w["y0"])).cast("double").alias("top"), F.array_max(F.transform(words, lambda w: w["y1"])).cast("double").alias("bottom"))
        return let(F.filter(x["words"], lambda w: w["x1"] <= limit), made)

    return F.transform(body, part)


def label_at(parts: Column, i: Column, label: str) -> Column:
    """The place of a label that begins on line i of left_parts: page, top and bottom of its words, or null. The left column's
    words of at most LABEL_LINES lines, none more than LABEL_GAP below the one before, must join to it; lines without such
    words are passed over."""

    def follow(first):
        start = F.struct(F.lit("").alias("made"), first["y"].alias("y"), F.lit(None).cast("double").alias("top"), F.lit(None).cast("double").alias("bottom"), F.lit(False).alias("over"), F.lit(False).alias("done"))

        def step(s, x):
            stops = s["over"] | s["done"] | (x["page"] != first["page"]) | (x["y"] - s["y"] > LABEL_GAP)
            adds = x["part"] != ""
            made = F.concat(s["made"], x["part"])
            over = F.struct(s["made"].alias("made"), s["y"].alias("y"), s["top"].alias("top"), s["bottom"].alias("bottom"), F.lit(True).alias("over"), s["done"].alias("done"))
            passed = F.struct(s["made"].alias("made"), x["y"].alias("y"), s["top"].alias("top"), s["bottom"].alias("bottom"), F.lit(False).alias("over"), s["done"].alias("done"))
            taken = F.struct(made.alias("made"), x["y"].alias("y"), F.least(s["top"], x["top"]).alias("top"), F.greatest(s["bottom"], x["bottom"]).alias("bottom"), F.lit(False).alias("over"), (made == label).alias("done"))
            return F.when(stops, over).when(~adds, passed).when(F.startswith(F.lit(label), made), taken).otherwise(over)

        end = F.aggregate(F.slice(parts, i + 1, LABEL_LINES), start, step)
        place = let(end, lambda end: F.when(end["done"], F.struct(first["page"].alias("page"), end["top"].alias("top"), end["bottom"].alias("bottom"))))
        return F.when(~first["heads"] & (first["part"] != "") & F.startswith(F.lit(label), first["part"]), place)

    return let(F.get(parts, i), follow)


def key_figures(words: DataFrame, year: int, label: str = ROW) -> DataFrame:
    """The figures of key_figures_of for documents whose words are rows."""
    held = F.collect_list(F.struct("page", *PLACE, "word")).alias("words")
    return key_figures_of(placed(words).groupBy("doc").agg(held), year, label)


def key_figures_of(docs: DataFrame, year: int, label: str = ROW) -> DataFrame:
    """doc, code and, where it is ok, raw_now, raw_before, now, before, unit, currency (null: not told), top and bottom of
    the row's label. Documents hold their words, an array of page, x0, y0, x1, y1, word with none of them null; nothing is
    shuffled."""
    df = docs.select("doc", baseline_lines(F.col("words")).alias("lines"))
    df = df.select("doc", F.transform("lines", _flagged).alias("lines"))
    at = lambda c, test: F.filter(F.transform(c, lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull())
    df = df.withColumn("titles", at("lines", lambda x: x["section"] == 1)).withColumn("tail", F.when(F.size("titles") == 1, F.slice("lines", F.get("titles", 0) + 2, F.size("lines"))))
    end = F.coalesce(F.get(at("tail", lambda x: x["section"] == 2), 0), F.size("tail"))
    df = df.withColumn("body", F.slice("tail", 1, end))
    wanted = F.array(*(F.lit(year - k) for k in range(3)))
    df = df.withColumn("headers", F.filter("body", lambda x: F.coalesce(F.transform(x["years"], lambda y: y["year"]) == wanted, F.lit(False)))).withColumn("header", F.get("headers", 0))
    df = df.withColumn("changes", F.filter("body", lambda x: x["change"] & (F.abs(x["y"] - F.col("header.y")) <= HEADING_REACH)))
    df = df.withColumn("change_words", F.flatten(F.transform("changes", lambda x: x["words"]))).withColumn("change_text", compact(F.array_join(F.transform("changes", lambda x: x["text"]), "")))
    df = df.withColumn("left", F.get("header.years", 1)["x1"]).withColumn("right", F.get("header.years", 2)["x0"])
    df = df.withColumn("outside", F.exists("change_words", lambda w: (w["x0"] < F.col("left")) | (w["x1"] > F.col("right"))))
    df = df.withColumn("units", F.transform(F.filter("body", lambda x: x["unit_line"]), lambda x: x["unit"]))
    cell = F.get(F.filter("header.words", lambda w: compact(w["word"]) == FIRST_HEADING), 0)
    df = df.withColumn("limit", (cell["x1"] + F.get("header.years", 0)["x"]) / 2)
    df = df.withColumn("parts", left_parts(F.col("body"), F.col("limit")))
    df = df.withColumn("labels", F.array_compact(F.transform(F.coalesce("parts", F.array()), lambda _, i: label_at(F.col("parts"), i, label))))
    # labels of one top on one page are one
    df = df.withColumn("labels", F.filter("labels", lambda r, i: ~F.exists(F.slice("labels", 1, i), lambda q: (q["page"] == r["page"]) & (q["top"] == r["top"])))).withColumn("row", F.get("labels", 0))
    near = F.filter("body", lambda x: (x["page"] == F.col("row.page")) & (x["bottom"] >= F.col("row.top") - 2) & (x["y"] <= F.col("row.bottom") + 2))
    middle = lambda w: (w["y0"] + w["y1"]) / 2
    centre = lambda w: (w["x0"] + w["x1"]) / 2
    in_row = lambda w: middle(w).between(F.col("row.top") - 2, F.col("row.bottom") + 2) & (centre(w) > F.col("limit")) & F.trim(w["word"]).rlike(AMOUNT)
    tokens = F.transform(F.filter(F.flatten(F.transform(near, lambda x: x["words"])), in_row), lambda w: F.struct(centre(w).alias("x"), F.trim(w["word"]).alias("raw")))
    df = df.withColumn("tokens", tokens).withColumn("aligned", one_each(F.col("header.years"), F.col("tokens"), F.col("left"), F.col("right"), BAND_MARGIN))
    df = df.withColumn("raw_now", F.get("aligned.amounts", 2)).withColumn("raw_before", F.get("aligned.amounts", 1)).withColumn("unit", F.get("units", 0))
    df = df.withColumns({c: parse_amount(F.translate(F.col(f"raw_{c}"), "–", "-")).cast("decimal(22,2)") for c in ("now", "before")})
    code = (
        F.when(F.size("titles") == 0, "section_not_found")
        .when(F.size("titles") > 1, "ambiguous_section")
        .when(F.size("headers") == 0, "year_header_not_found")
        .when(F.size("headers") > 1, "ambiguous_year_header")
        .when(~reduce(Column.__and__, (F.col("change_text").contains(w) for w in (CHANGE, *CHANGE_WORDS))), "percentage_column_not_found")
        .when(F.col("outside"), "percentage_column_alignment")
        .when((F.size("units") == 0) | F.exists("units", lambda u: u.isNull()), "unit_not_found")
        .when(F.size(F.array_distinct("units")) > 1, "unit_conflict")
        .when(F.size("labels") == 0, "row_not_found")
        .when(F.size("labels") > 1, "ambiguous_row")
        .when(F.col("aligned.fault").isNotNull(), "amount_alignment")
        .when(F.col("now").isNull() | F.col("before").isNull(), "amount_unreadable")
        .otherwise("ok")
    )
    scale = F.coalesce(*(F.when(F.col("unit.unit") == u, F.lit(m)) for u, m in MULTIPLIERS.items())).cast("decimal(9,0)")
    given = {
        "raw_now": F.col("raw_now"), "raw_before": F.col("raw_before"), "now": (F.col("now") * scale).cast("decimal(38,2)"), "before": (F.col("before") * scale).cast("decimal(38,2)"),
        "unit": F.col("unit.unit"), "currency": F.col("unit.currency"), "top": F.col("row.top"), "bottom": F.col("row.bottom"),
    }
    df = df.withColumn("code", code)
    return df.select("doc", "code", *(F.when(F.col("code") == "ok", c).alias(n) for n, c in given.items()))
