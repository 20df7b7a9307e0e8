"""Amounts under the headings of a row, and labels put together from fragments of neighbouring lines.

Everything is an expression on the arrays of one row: a row's headings, amounts and fragments are few, and no rows meet.

Defined cases: an amount as near to two headings belongs to the one further left; null or empty arrays align with nothing and
give null; amounts and headings without a position are left out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.text import let


def nearest_heading(headings: Column, x: Column) -> Column:
    """The heading (a struct with x and year) closest to a position; headings must have positions."""
    return F.get(F.array_sort(F.transform(headings, lambda h: F.struct(F.abs(h["x"] - x).alias("far"), h["x"].alias("x"), h["year"].alias("year")))), 0)


def placed(items: Column) -> Column:
    return F.filter(items, lambda i: i["x"].isNotNull())


def amount_of_year(headings: Column, amounts: Column, year: Column) -> Column:
    """The one amount (structs with x and raw) whose nearest heading is the only one of that year, or null."""
    headings = F.array_sort(F.transform(placed(headings), lambda h: F.struct(h["x"].alias("x"), h["year"].alias("year"))))
    named = F.filter(headings, lambda h: h["year"].eqNullSafe(year))
    mine = F.filter(placed(amounts), lambda a: nearest_heading(headings, a["x"])["x"] == F.get(named, 0)["x"])
    return F.when((F.size(named) == 1) & (F.size(mine) == 1), F.get(mine, 0)["raw"])


def one_each(headings: Column, amounts: Column, left: Column, right: Column, margin: float = 3.0, farthest: float = 58.0) -> Column:
    """Fault (null if none) and amounts, one raw for each heading in order of years and places. Amounts within `margin` of the band
    from left to right are no amounts of a year; of the others each must lie within `farthest` of its nearest heading
    ('no_heading'), and each heading must be claimed by exactly one ('claimed_twice', 'unclaimed')."""
    ordered = F.array_sort(F.transform(placed(headings), lambda h: F.struct(h["x"].alias("x"), h["year"].alias("year"))))
    outside = F.filter(placed(amounts), lambda a: ~F.coalesce(a["x"].between(left - margin, right + margin), F.lit(False)))

    def claimed(headings):
        claims = F.transform(outside, lambda a: F.struct(nearest_heading(headings, a["x"]).alias("to"), a["raw"].alias("raw")))
        return let(claims, lambda claims: _each(headings, claims, farthest))

    # without let, headings would be put in order again for every amount, and amounts be placed again for every heading
    return let(ordered, claimed)


def _each(headings: Column, claims: Column, farthest: float) -> Column:
    of = lambda h: F.filter(claims, lambda c: c["to"]["x"] == h["x"])
    fault = (
        F.when(F.coalesce(F.size(headings), F.lit(0)) <= 0, "no_headings")
        .when(F.exists(claims, lambda c: c["to"].isNull() | (c["to"]["far"] > farthest)), "no_heading")
        .when(F.exists(headings, lambda h: F.size(of(h)) > 1), "claimed_twice")
        .when(F.coalesce(F.exists(headings, lambda h: F.size(of(h)) != 1), F.lit(True)), "unclaimed")
    )
    chosen = F.transform(F.array_sort(F.transform(headings, lambda h: F.struct(h["year"].alias("year"), h["x"].alias("x"), F.get(of(h), 0)["raw"].alias("raw")))), lambda y: y["raw"])
    return let(fault, lambda fault: F.struct(fault.alias("fault"), F.when(fault.isNull(), chosen).alias("amounts")))


def subset_making(fragments: Column, label: Column) -> Column:
    """Places (from 0) of the fragments that, joined in order, are exactly the label; null where no choice of them is. Of
    several choices the one whose last place is lowest counts, then the next to last, and so on. The fold goes over the
    fragments once and keeps, for each length of the label's beginning, the best choice that makes it, last place first.
    Empty and null fragments are never chosen."""
    none = F.array().cast("array<int>")
    start = F.struct(F.transform(F.sequence(F.lit(0), F.length(label)), lambda p: F.when(p == 0, none)).alias("best"), F.lit(0).alias("place"))

    def step(s, f):
        size = F.length(f)

        def reach(held, p):
            before = F.get(s["best"], p - size)
            fits = (size > 0) & (p >= size) & before.isNotNull() & (F.substring(label, p - size + 1, size) == f)
            made = F.array_prepend(before, s["place"])
            return F.when(fits, F.least(made, F.coalesce(held, made))).otherwise(held)

        return F.struct(F.transform(s["best"], reach).alias("best"), (s["place"] + 1).alias("place"))

    made = F.aggregate(fragments, start, step, lambda s: F.reverse(F.get(s["best"], F.length(label))))
    return F.when(F.size(made) > 0, made)


def label_fragment(raw: Column, label: Column) -> Column:
    """What a piece of text adds to a label: without its number in front, if that is part of the label; the whole label if
    it is followed by nothing but a mark for a net or negative value. Null if neither."""
    text = F.regexp_replace(raw, r"\s+", "")
    text = F.regexp_replace(text, r"^(?:[0-9]+[.．、]|[一二三四五六七八九十]+[、．.]|[（(][一二三四五六七八九十]+[）)])", "")
    rest = F.substring(text, F.length(label) + 1, F.length(text))
    marked = F.startswith(text, label) & rest.rlike(r"^(?:[（(](?:净|亏损).*)?$")
    return F.when((text != "") & F.contains(label, text), text).when(marked, label)


def longest_run(words: Column, label: Column) -> Column:
    """Of all runs of words the one that adds most to the label (most characters, then most words), or null."""
    n = F.size(words)
    starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    run = lambda i, k: F.struct(label_fragment(F.array_join(F.slice(words, i, k), ""), label).alias("text"), k.alias("k"))
    runs = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: run(i, k))))
    ranked = F.transform(F.filter(runs, lambda r: r["text"].isNotNull()), lambda r: F.struct(F.length(r["text"]).alias("size"), r["k"].alias("k"), r["text"].alias("text")))
    return F.array_max(ranked)["text"]
