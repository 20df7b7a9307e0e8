"""Evidence of reports: sections, baselines, repeated headers, verdicts by key, reconciliation, placement of claims, manifests.

Every operator groups or windows once by its key. Null keys form a group of their own; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.text import compact

# The two boxes of a printed choice, as they read without white space.
CHOSEN, NOT_CHOSEN = "√适用□不适用", "□适用√不适用"


def choice(text: Column) -> Column:
    """True, false, or null where a line is no complete choice."""
    return F.when(compact(text) == CHOSEN, True).when(compact(text) == NOT_CHOSEN, False)


def in_sections(blocks: DataFrame, sections: DataFrame, doc: str, ordinal: str) -> DataFrame:
    """Adds section: the label of the section with start <= ordinal < stop; null outside and for a null document or ordinal.
    A null stop is open, a null start opens nothing. Where sections overlap, the one that starts last speaks. Sections come
    as (doc, start, stop, section). One sort by document carries the last start along, where a range join would meet every
    block with every section."""
    none = F.lit(None)
    marks = sections.filter("start IS NOT NULL").select(doc, F.col("start").alias(ordinal), F.struct("stop", "section").alias("_s"), none.alias("_row"))
    rows = blocks.select(doc, ordinal, none.alias("_s"), F.struct(*blocks.columns).alias("_row"))
    order = Window.partitionBy(doc).orderBy(ordinal, F.col("_row").isNotNull(), "_s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last("_s", ignorenulls=True).over(order)
    inside = F.col(doc).isNotNull() & F.col(ordinal).isNotNull() & (F.col("_last.stop").isNull() | (F.col(ordinal) < F.col("_last.stop")))
    return marks.unionByName(rows).withColumn("_last", last).filter("_row IS NOT NULL").select("_row.*", F.when(inside, F.col("_last.section")).alias("section"))


def merged_baselines(blocks: DataFrame, page: str, y: str, x: str, text: str) -> DataFrame:
    """Blocks of one page and one rounded height (half to even) as one line, from left to right, with the box around them.
    Null texts are left out of the line."""
    line = F.transform(F.array_sort(F.collect_list(F.struct(x, text))), lambda b: b[text])
    box = [f(c).alias(n) for f, c, n in ((F.min, x, "x0"), (F.max, x, "x1"), (F.min, y, "y0"), (F.max, y, "y1"))]
    return blocks.groupBy(page, F.bround(y).cast("long").alias("baseline")).agg(F.array_join(line, " ").alias("line"), *box)


def header_consensus(headers: DataFrame, key: list[str], signature: str, ordinal: str, line: str) -> DataFrame:
    """The last line of a repeated header if all its signatures are equal. A null signature agrees with none."""
    same = (F.min(signature) == F.max(signature)) & (F.count(signature) == F.count("*"))
    grouped = headers.groupBy(*key).agg(F.coalesce(same, F.lit(False)).alias("agreed"), F.max_by(line, F.struct(ordinal, line)).alias(line))
    return grouped.withColumn(line, F.when(F.col("agreed"), F.col(line)))


def unique_first(docs: DataFrame, key: str, candidates: DataFrame, value: str) -> DataFrame:
    """not_found, ok or ambiguous for each document, and the value of the only candidate. Candidates name the document by key."""
    found = candidates.groupBy(key).agg(F.count("*").alias("_n"), F.min(value).alias("_v"))
    status = F.when(F.col("_n").isNull(), "not_found").when(F.col("_n") > 1, "ambiguous").otherwise("ok")
    return docs.select(key).join(found, key, "left").select(key, status.alias("status"), F.when(F.col("_n") == 1, F.col("_v")).alias(value))


def keyed_verdict(requests: DataFrame, verdicts: DataFrame, key: list[str], verdict: str) -> DataFrame:
    """The verdict under a composite key, or missing_or_ambiguous where there is none, more than one, or one of null."""
    once = verdicts.groupBy(*key).agg(F.count("*").alias("_n"), F.min(verdict).alias("_v"))
    only = F.when(F.col("_n") == 1, F.col("_v"))
    return requests.select(*key).join(once, key, "left").select(*key, F.coalesce(only, F.lit("missing_or_ambiguous")).alias(verdict))


def reconciled(left: DataFrame, right: DataFrame, key: list[str], value: str) -> DataFrame:
    """Compares two tables' value under each key: missing_left, missing_right, ambiguous, equal or conflict. Null values
    conflict. Both sides are grouped in one shuffle instead of joined."""
    both = left.select(*key, value, F.lit(True).alias("_l")).unionByName(right.select(*key, value, F.lit(False).alias("_l")))
    counts = both.groupBy(*key).agg(
        F.count_if("_l").alias("_a"), F.count_if(~F.col("_l")).alias("_b"), F.max(F.when(F.col("_l"), F.col(value))).alias("left"), F.max(F.when(~F.col("_l"), F.col(value))).alias("right")
    )
    status = (
        F.when(F.col("_a") == 0, "missing_left")
        .when(F.col("_b") == 0, "missing_right")
        .when((F.col("_a") > 1) | (F.col("_b") > 1), "ambiguous")
        .when(F.col("left") == F.col("right"), "equal")
        .otherwise("conflict")
    )
    return counts.select(*key, status.alias("status"))


def run_status(status: str, done: str, failed: str) -> Column:
    """Aggregate: verification_failed if any status is `failed`, completed if all are `done`, else completed_with_issues. A
    null status is an issue."""
    any_failed = F.count_if(F.col(status) == failed) > 0
    return F.when(any_failed, "verification_failed").when(F.count_if(F.col(status) == done) == F.count("*"), "completed").otherwise("completed_with_issues")


def signal_issues(signals: DataFrame, id_col: str, value: str) -> DataFrame:
    """One row a signal id with its number and its issues: missing_id (null or empty), duplicate_id, float_value (a value
    printed with a point or an exponent)."""
    key = F.coalesce(F.col(id_col), F.lit("")).alias(id_col)
    grouped = signals.groupBy(key).agg(F.count("*").alias("n"), (F.count_if(F.col(value).rlike("[.eE]")) > 0).alias("_float"))
    missing = F.col(id_col) == ""
    codes = [F.when(missing, "missing_id"), F.when(~missing & (F.col("n") > 1), "duplicate_id"), F.when(F.col("_float"), "float_value")]
    return grouped.select(id_col, "n", F.array_join(F.array(*codes), ",").alias("issues"))


def claim_places(claims: DataFrame, facts: DataFrame, target: str) -> DataFrame:
    """Adds place. Interpretations have their own; a claim is among verified_claims if its target has facts, all of them
    verified, whose distinct evidence is just what the claim cites; else it is pending. claims: target, kind, cited (array);
    facts: target, evidence, verified."""
    of = facts.groupBy(target).agg(F.array_sort(F.collect_set("evidence")).alias("_e"), F.bool_and("verified").alias("_v"))
    proved = F.col("_v") & (F.array_sort(F.array_distinct(F.array_compact("cited"))) == F.col("_e"))
    place = F.when(F.col("kind") == "interpretation", "interpretations").when(proved, "verified_claims").otherwise("pending")
    return claims.join(of, target, "left").withColumn("place", place).drop("_e", "_v")


def manifest(rows: DataFrame, key: str, *fields: str) -> DataFrame:
    """Each key's rows as one JSON array in the order of the fields, nulls written out, with its SHA-256."""
    body = F.to_json(F.array_sort(F.collect_list(F.struct(*fields))), {"ignoreNullFields": "false"})
    return rows.groupBy(key).agg(body.alias("body")).withColumn("sha256", F.sha2("body", 256))

