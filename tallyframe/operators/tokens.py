"""Words on pages and answers of models: text of a page or a box, amounts printed in pieces, parsed answers, cited analyses.

Null texts are left out of joined texts; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Signs that may stand apart from their amount, and what an amount looks like without them.
SIGNS, AMOUNT = ("-", "－", "−"), r"^\d[\d,，]*(\.\d+)?$"


def _ordered(*order: str, text: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda b: b[text]), " ")


def page_text(lines: DataFrame, key: str, page: str, number: int, ordinal: str, text: str) -> DataFrame:
    """The whole text of one page of each document that has it, in the order of the lines."""
    return lines.filter(F.col(page) == number).groupBy(key).agg(_ordered(ordinal, text=text).alias("page_text"))


def clip_text(boxes: DataFrame, words: DataFrame, page: str) -> DataFrame:
    """Adds clip: the words (page, x, y, word) within each box (x0, x1, y0, y1, edges included) from top to bottom and left to
    right, an empty text if there are none. The box's id is `box`. Words meet the boxes of their own page only."""
    area = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    found = boxes.select(page, "box", "x0", "x1", "y0", "y1").join(words, page).filter(area).groupBy("box").agg(_ordered("y", "x", text="word").alias("clip"))
    return boxes.join(found, "box", "left").withColumn("clip", F.coalesce("clip", F.lit("")))


def joined_amounts(tokens: DataFrame, line: list[str], gap: float) -> DataFrame:
    """Amounts among tokens (x0, x1, token) of a line, with the sign or the brackets that stand apart from them by `gap` at
    most. An amount with one bracket only has no reading: null. Other tokens go."""
    order = Window.partitionBy(*line).orderBy("x0", "x1", "token")
    before = F.when(F.col("x0") - F.lag("x1").over(order) <= gap, F.lag("token").over(order))
    after = F.when(F.lead("x0").over(order) - F.col("x1") <= gap, F.lead("token").over(order))
    opened, closed = F.coalesce(F.col("_b").isin("(", "（"), F.lit(False)), F.coalesce(F.col("_a").isin(")", "）"), F.lit(False))
    amount = (
        F.when(opened & closed, F.concat(F.lit("("), "token", F.lit(")")))
        .when(~opened & ~closed, F.when(F.col("_b").isin(*SIGNS), F.concat(F.lit("-"), "token")).otherwise(F.col("token")))
    )
    return tokens.withColumn("_b", before).withColumn("_a", after).filter(F.col("token").rlike(AMOUNT)).select(*line, "x0", amount.alias("amount"))


def answer_issue(answer: Column, allowed: Column, longest: int, most: int) -> Column:
    """The first fault of an answer {"opinion": text, "refs": [ids]}, or ok: invalid_json (or no object), wrong_keys,
    wrong_types, too_long, digits (in the opinion), too_many, duplicate_id, unknown_id."""
    keys, body = F.json_object_keys(answer), F.from_json(answer, "opinion string, refs array<long>")
    opinion, refs = body["opinion"], body["refs"]
    return (
        F.when(keys.isNull(), "invalid_json")
        .when(F.array_sort(keys) != F.array(F.lit("opinion"), F.lit("refs")), "wrong_keys")
        .when(opinion.isNull() | refs.isNull() | F.exists(refs, lambda r: r.isNull()), "wrong_types")
        .when(F.length(opinion) > longest, "too_long")
        .when(opinion.rlike("[0-9]"), "digits")
        .when(F.size(refs) > most, "too_many")
        .when(F.size(F.array_distinct(refs)) < F.size(refs), "duplicate_id")
        .when(F.size(F.array_except(refs, allowed)) > 0, "unknown_id")
        .otherwise("ok")
    )


def cited_analyses(citations: DataFrame, confirmed: DataFrame, key: str) -> DataFrame:
    """One row a candidate with the first fault of its citations (key, ordinal, id, value): missing (an id without a confirmed
    analysis), unordered (ids do not rise with the ordinal), unverified, value_mismatch, or ok. confirmed: id (unique), value,
    verified."""
    known = confirmed.select("id", F.col("value").alias("_v"), F.col("verified").alias("_ok"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "id"))), lambda b: b["id"])
    rows = citations.join(known, "id", "left").groupBy(key).agg(
        (F.count_if(F.col("_ok").isNull()) > 0).alias("missing"), ids.alias("ids"), (F.count_if(~F.col("_ok")) > 0).alias("unverified"), (F.count_if(~F.col("value").eqNullSafe(F.col("_v"))) > 0).alias("other")
    )
    rises = F.array_sort(F.array_distinct("ids")) == F.col("ids")
    fault = F.when(F.col("missing"), "missing").when(~rises, "unordered").when(F.col("unverified"), "unverified").when(F.col("other"), "value_mismatch").otherwise("ok")
    return rows.select(key, fault.alias("fault"))
