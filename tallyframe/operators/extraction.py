"""Facts out of report lines, and readings that check them: all documents at once, one shuffle by document.

Lines are told apart before they are shuffled, each by itself, and only those that a gate asks for go along: titles,
headings of years, units and the rows with a wanted label.

Every failed gate gives its code and no amounts; gates are asked in the order of the code list. Documents without lines do
not occur; null lines match nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import report as R
from tallyframe.functions.text import compact, parse_amount


def told_apart(lines: DataFrame, labels: dict[str, str], title: str) -> DataFrame:
    """doc and line (null if no gate asks for it): ord, text, whether it is the title or any statement's, years, whether it
    tells a unit and which, and the metrics whose row it is."""
    text, short = F.col("text"), F.col("short")
    lines = lines.select("doc", "ord", "text", compact(text).alias("short"))
    told = text.contains("单位") & text.rlike(r"^\s*单位\s*[:：]")
    flags = {"is_title": R.is_title(short, title), "stops": R.is_statement_title(short), "years": R.year_ends(short), "told": told, "unit": F.when(told, R.unit_of(short))}
    rows = {f"row_{m}": R.has_exact_prefix(short, label) & text.rlike(R.SIGNED_AMOUNT) for m, label in labels.items()}
    lines = lines.withColumns(flags | rows)
    wanted = F.col("is_title") | F.col("stops") | F.col("years").isNotNull() | F.col("told")
    for m in rows:
        wanted = wanted | F.col(m)
    return lines.select("doc", F.when(wanted, F.struct("ord", "text", *flags, *rows)).alias("line"))


def body(lines: Column) -> tuple[Column, Column]:
    """How many lines are the title, and the lines between the first of them and the next statement's title."""
    at = F.filter(F.transform(lines, lambda x, i: F.when(x["is_title"], i)), lambda i: i.isNotNull())
    start = F.get(at, 0)
    stops = F.filter(F.transform(lines, lambda x, i: F.when(x["stops"] & (i > start), i)), lambda i: i.isNotNull())
    stop = F.coalesce(F.get(stops, 0), F.size(lines))
    return F.size(at), F.when(start.isNotNull(), F.slice(lines, start + 2, F.greatest(stop - start - 1, F.lit(0))))


def balance_sheet(lines: DataFrame, report_year: int, labels: dict[str, str], title: str = "合并资产负债表", reader: Callable[[Column], Column] = parse_amount) -> DataFrame:
    """doc, metric, code (`ok` or the first failed gate), unit, currency, now, before (normalized amounts of both years).

    Where the currency is not told the amounts stay and the currency is null.
    """
    return balance_sheets(lines, report_year, labels, title, {"": reader})


def balance_sheets(lines: DataFrame, report_year: int, labels: dict[str, str], title: str, readers: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """The same by several readers, from lines that are gathered once; a reader's columns begin with its name."""
    docs = told_apart(lines, labels, title).groupBy("doc").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    titles, inside = body(F.col("lines"))
    docs = docs.select("doc", titles.alias("titles"), inside.alias("body"))
    years = F.filter(F.transform("body", lambda x: x["years"]), lambda y: y.isNotNull())
    told = F.filter("body", lambda x: x["told"])
    docs = docs.select("doc", "titles", "body", F.array_distinct(years).alias("years"), F.transform(told, lambda x: x["unit"]).alias("told"))
    docs = docs.select("doc", "titles", "body", "years", F.size("told").alias("told"), F.exists("told", lambda u: u.isNull()).alias("unread"), F.array_distinct("told").alias("units"))
    wanted = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.transform(F.filter("body", lambda x: x[f"row_{m}"]), lambda x: x["text"]).alias("rows")) for m in labels)))
    rows = docs.select("doc", "titles", "years", "told", "unread", "units", wanted.alias("w")).select("*", "w.metric", "w.rows").drop("w")
    rows = rows.withColumn("tokens", R.signed_amounts(F.get("rows", 0))).withColumn("year", F.get("years", 0)).withColumn("unit", F.get("units", 0))
    flip = (F.get("year", 0) == report_year - 1).cast("int")
    out = ["doc", "metric"]
    for name, reader in readers.items():
        rows = _read_by(rows, reader, report_year, flip, name)
        ok = F.col(f"{name}code") == "ok"
        out += [f"{name}code", *(F.when(ok, F.col(c)).alias(f"{name}{n}") for c, n in (("unit.unit", "unit"), ("unit.currency", "currency"), (f"{name}now", "now"), (f"{name}before", "before")))]
    return rows.select(*out)


def _read_by(rows: DataFrame, reader: Callable[[Column], Column], report_year: int, flip: Column, name: str) -> DataFrame:
    rows = rows.withColumns({f"_{k}": reader(F.get("tokens", k)).cast("decimal(22,2)") for k in (0, 1)})
    amount = lambda k: F.when(k == 0, F.col("_0")).otherwise(F.col("_1")) * F.col("unit.multiplier")
    code = (
        F.when(F.col("titles") == 0, "table_not_found")
        .when(F.col("titles") > 1, "ambiguous_table")
        .when(F.size("years") != 1, "missing_or_conflicting_year_header")
        .when(F.array_sort("year") != F.array(F.lit(report_year - 1), F.lit(report_year)), "missing_year_header")
        .when((F.col("told") == 0) | F.col("unread"), "missing_unit")
        .when(F.size("units") > 1, "conflicting_unit")
        .when(F.size("rows") == 0, "row_not_found")
        .when(F.size("rows") > 1, "ambiguous_row")
        .when(F.size("tokens") != 2, "amount_alignment")
        .when(F.col("_0").isNull() | F.col("_1").isNull(), "amount_unreadable")
        .otherwise("ok")
    )
    return rows.withColumns({f"{name}code": code, f"{name}now": amount(flip).cast("decimal(38,2)"), f"{name}before": amount(1 - flip).cast("decimal(38,2)")})


def mutated(facts: DataFrame, mutations: dict[str, dict[str, Column]]) -> DataFrame:
    """Each fact once for every arm, with that arm's columns replaced."""
    columns = [c for c in facts.columns]
    arms = F.array(*(F.struct(F.lit(arm).alias("arm"), *(change.get(c, F.col(c)).cast(facts.schema[c].dataType).alias(c) for c in columns)) for arm, change in mutations.items()))
    return facts.select(F.explode(arms).alias("a")).select("a.*")


def checked(told: DataFrame, own: DataFrame, key: list[str]) -> DataFrame:
    """Facts as told against an independent reading of the same source: the first difference decides.

    No reading, or one without a currency, is `insufficient`; a value found under the other year is told apart.
    """
    mine = own.select(*key, *(F.col(c).alias(f"own_{c}") for c in OWN))
    return judged(told.join(mine, key, "left"))


OWN = ("code", "unit", "currency", "now", "before")


def judged(df: DataFrame) -> DataFrame:
    """The same where both readings stand in one row, the independent one's columns beginning with own_."""
    status = (
        F.when(F.col("own_code").isNull() | (F.col("own_code") != "ok"), "insufficient")
        .when(F.col("own_currency").isNull(), "insufficient")
        .when(~F.col("unit").eqNullSafe(F.col("own_unit")), "unit_conflict")
        .when(~F.col("currency").eqNullSafe(F.col("own_currency")), "currency_conflict")
        .when(F.col("now") == F.col("own_now"), "verified")
        .when(F.col("now") == F.col("own_before"), "value_in_other_year")
        .otherwise("value_conflict")
    )
    return df.withColumn("status", status).drop(*(f"own_{c}" for c in OWN))
