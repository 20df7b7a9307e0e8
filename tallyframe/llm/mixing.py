"""Mixing sources to target weights: Efraimidis-Spirakis sampling of documents down to a budget of words a source.

Sources share a budget by weight; a source takes `most` times its words at most, and what it cannot take goes to the others
by weight. A source whose target is above its size first takes all its documents as often as they fit (complete epochs);
the rest of its target is drawn: every document gets the key -ln(u) / weight with a u from a hash of its id, documents of
a source are ordered by key, and the sum of their words before them tells which still fit. The document at the edge is cut.

The order is that of a range shuffle on (source, key): a source that holds a third of all rows is spread over as many
ranges as it needs. Sums of the ranges, one row each, give every range its start within its source; nothing else than
sizes, ids and keys is shuffled, and no task sees more than its range.

Defined cases: null and empty texts have no words and nothing of them is taken; null sources are one source, last in the
order of sources; null ids draw by their text; rows with equal ids are told apart by size only, and those of the same size
and weight may stand for each other; a weight that is null, not a number or not above 0 is drawn last; an empty table, or
one without words, has targets of 0; other columns of docs are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import materialize, shuffle_partitions

WORD = r"[^\x20\x09-\x0D]+"
#: Everything in ASCII that is no letter.
NO_LETTER = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"


def letter_share(text: Column) -> Column:
    """A quality weight from the text alone: 0.05 for text without letters to 1.05 for nothing else."""
    return 0.05 + F.coalesce(F.char_length(F.regexp_replace(text, NO_LETTER, "")) / F.greatest(F.char_length(text), F.lit(1)), F.lit(0.0))


def targets(sizes: DataFrame, shares: tuple[int, ...], budget: float, most: int) -> DataFrame:
    """Adds target to one row a source (source, source_size): budget times all sizes, shared by the shares, which repeat over
    the sources in order of their code points, null last. A source stands at `most` times its size if that is reached at a
    level no higher than the rest can be raised to; such sources come first in order of most * size / share."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    at = F.row_number().over(order)
    share = F.element_at(F.array(*(F.lit(float(s)) for s in shares)), F.pmod(at - 1, F.lit(len(shares))) + 1)
    every = Window.partitionBy()
    rows = sizes.select("source", "source_size", at.alias("at"), share.alias("share")).withColumn("cap", (F.col("source_size") * most).cast("double"))
    rows = rows.withColumn("budget", F.sum("source_size").over(every) * budget).withColumn("full_at", F.col("cap") / F.col("share"))
    rising = Window.orderBy("full_at", "at")
    caps_before = F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cap")
    shares_left = F.sum("share").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("full", F.col("full_at") <= (F.col("budget") - caps_before) / shares_left)
    caps, open_shares = (F.sum(F.when(c, F.col(x)).otherwise(0.0)).over(every) for c, x in ((F.col("full"), "cap"), (~F.col("full"), "share")))
    level = F.try_divide(F.col("budget") - caps, open_shares)
    return rows.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("share") * level).alias("target"))


def draws(docs: DataFrame, weight: Column, seed: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """id, source, size and the key of every document."""
    name = F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit(""))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary")), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    key = F.when((weight > 0) & ~F.isnan(weight), -F.ln(u) / weight).otherwise(F.lit(float("inf")))
    return docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        key.alias("key"),
    )


def mix(
    docs: DataFrame,
    weight: Column | None = None,
    shares: tuple[int, ...] = (3, 1, 2),
    budget: float = 1.5,
    most: int = 2,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Returns id, source, size, source_size, target, taken (words that the mix takes of the document, repeats counted) and
    key of every document. Without a weight, documents are drawn by the share of letters in their text."""
    weight = letter_share(F.col(text_col)) if weight is None else weight
    drawn = materialize(draws(docs, weight, seed, id_col, text_col, source_col), "draws")
    wanted = targets(drawn.groupBy("source").agg(F.sum("size").alias("source_size")), shares, budget, most)
    order = ("key", "id", "size")
    ranges = drawn.repartitionByRange(shuffle_partitions(docs.sparkSession), "source", *order).withColumn("part", F.spark_partition_id())
    ranges = materialize(ranges, "ranges")
    # one row a range and source in it: how many words of the source stand in earlier ranges
    of_source = Window.partitionBy("source").orderBy("part")
    starts = ranges.groupBy("source", "part").agg(F.sum("size").alias("words"))
    starts = starts.select("source", "part", (F.sum("words").over(of_source) - F.col("words")).alias("before"))
    starts = starts.join(wanted.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    head = starts.select("part", "source", F.lit(True).alias("head"), F.col("before").alias("words"), "source_size", "target")
    body = ranges.select("part", "source", F.lit(False).alias("head"), F.col("size").alias("words"), *("id", "size", "key"))
    within = Window.partitionBy("part", "source").orderBy(F.col("head").desc(), *order)
    through = F.sum("words").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    whole = Window.partitionBy("part", "source")
    rows = head.unionByName(body, allowMissingColumns=True).select(
        "id", "source", "size", "key", "head", (through - F.col("words")).alias("before"), F.max("source_size").over(whole).alias("source_size"), F.max("target").over(whole).alias("target")
    )
    words = F.floor("target").cast("long")
    full = F.greatest("source_size", F.lit(1).cast("long"))
    epochs, rest = F.floor(words / full).cast("long"), words % full
    taken = epochs * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("before")))
    return rows.filter("NOT head").select("id", "source", "size", "source_size", "target", taken.alias("taken"), "key")
