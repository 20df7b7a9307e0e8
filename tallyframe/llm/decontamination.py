"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

An item's windows are its runs of `window` words (a shorter item is one window). A document holds a window only if it holds
all of the window's shingles, so one necessary shingle, the rarest in the documents, is enough to look for: the prefix of
the shingles in order of rarity. Each document position whose shingle is such a prefix fixes where the window would begin;
it must begin inside the document and end inside it (positional and length bounds), and its words are then compared in
full.

The windows' prefixes are broadcast only while their counted number keeps them under `broadcast_bytes`; beyond that,
document positions are shuffled by shingle instead, and candidates join their document's words by id.

Defined cases: null text has no words; items without words are ignored; repeated items are counted by id; rows with equal
id and text get the same answer each; empty tables on either side give rows without hits, or none; only the named columns
are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything that is no word: ASCII other than digits and lower-case letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def _windows(items: DataFrame, window: int) -> DataFrame:
    """Distinct windows with the items that hold them: win (words), n, items."""
    listed = items.select("item", words_of(F.col("text")).alias("words")).withColumn("n", F.size("words")).filter("n > 0")
    starts = listed.withColumn("at", F.explode(F.sequence(F.lit(1), F.greatest(F.col("n") - window + 1, F.lit(1)))))
    cut = starts.select("item", F.slice("words", F.col("at"), F.lit(window)).alias("win"))
    return cut.groupBy("win").agg(F.collect_set("item").alias("items")).withColumn("n", F.size("win"))


def _shingles(words: str, size: str) -> Column:
    """(offset, key) of every two-word shingle of a window; of one word, that word."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.col(size) - 1, F.lit(1))), lambda i: F.struct((i - 1).alias("shift"), F.xxhash64(F.get(F.col(words), i - 1), F.get(F.col(words), i)).alias("key")))
    single = F.array(F.struct(F.lit(0).alias("shift"), F.xxhash64(F.get(F.col(words), F.lit(0)), F.lit(None).cast("string")).alias("key")))
    return F.when(F.col(size) > 1, pairs).otherwise(single)


def _positions(docs: DataFrame, single: bool, *keep: str) -> DataFrame:
    """A row for each word position of a document, with the key of the shingle that starts there."""
    at = docs.select(*keep, "words", F.posexplode("words").alias("pos", "word"))
    following = F.lit(None).cast("string") if single else F.get(F.col("words"), F.col("pos") + 1)
    return at.select(*keep, "words", "pos", F.xxhash64("word", following).alias("key")).filter(F.lit(single) | (F.col("pos") + 1 < F.size("words")))


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = 32 << 20) -> DataFrame:
    """Returns id, n_words, n_hit, items (ids of the items with occurring windows, as strings in order)."""
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), words_of(F.col(text_col)).alias("words"))
    windows = _windows(items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")), window)
    keyed = windows.select("win", "n", "items", F.explode(_shingles("win", "n")).alias("s")).select("win", "n", "items", "s.shift", "s.key")
    size = windows.agg(F.sum(F.length(F.array_join("win", " ")) + F.length(F.array_join("items", " ")) + 200).alias("bytes"), F.coalesce(F.max((F.col("n") == 1).cast("int")), F.lit(0)).alias("short")).first()
    small = (size["bytes"] or 0) <= broadcast_bytes
    fits = F.broadcast if small else (lambda df: df)
    kinds = [False, True] if size["short"] else [False]

    def narrow(single: bool, *keep: str) -> DataFrame:
        at = _positions(source, single, *keep)
        return at if small else at.drop("words")

    # how often each shingle of the windows starts in the documents, all of them
    wanted = keyed.select("key").distinct()
    counts = None
    for single in kinds:
        found = narrow(single).join(fits(wanted), "key").groupBy("key").agg(F.count("*").alias("often"))
        counts = found if counts is None else counts.unionByName(found)
    prefix = keyed.join(counts, "key", "left").groupBy("win", "n", "items").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "shift", "key")).alias("first")).filter("first.often > 0").select("win", "n", "items", "first.shift", "first.key")

    hits = None
    for single in kinds:
        mine = prefix.filter(F.col("n") == 1) if single else prefix.filter(F.col("n") > 1)
        near = narrow(single, "id", "h").join(fits(mine), "key").withColumn("begin", F.col("pos") - F.col("shift")).filter("begin >= 0")
        if not small:
            again = source.select(F.col("id").alias("of_id"), F.col("h").alias("of_h"), "words").dropDuplicates(["of_id", "of_h"])
            near = near.join(again, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("h") == F.col("of_h")))
        found = near.filter(F.col("begin") + F.col("n") <= F.size("words")).filter(F.slice("words", F.greatest(F.col("begin") + 1, F.lit(1)), F.col("n")) == F.col("win")).select("id", "h", "begin", "n", "items")
        hits = found if hits is None else hits.unionByName(found)
    covered = F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("begin"), F.col("begin") + F.col("n") - 1))))).cast("long")
    per_doc = hits.groupBy(F.col("id").alias("hit_id"), F.col("h").alias("hit_h")).agg(covered.alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return (
        source.select("id", "h", F.size("words").cast("long").alias("n_words"))
        .join(per_doc, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("h") == F.col("hit_h")), "left")
        .select("id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    )
