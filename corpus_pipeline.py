"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet and read as the next one's docs.
All but the last return the columns of documents. Null texts are empty texts to every stage; empty tables pass through.
Null ids and ids that several rows share lose nothing: columns pass through the operators, or rows are told apart by their
place in the files, so each row is decided by its own text, and repeated rows are near duplicates of which one stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import materialize, shared_dir, table
from tallyframe.llm.decontamination import contamination
from tallyframe.llm.jaccard_join import near_duplicates
from tallyframe.llm.packing import pack
from tallyframe.llm.quality import score_quality
from tallyframe.llm.queries import tokenizer
from tallyframe.llm.suffix_dedup import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Passages of over 50 words have about 280 bytes or more; a run of shorter repeats that comes to as many words counts too.
REPEAT_BYTES = 200
#: Rows to be dropped are broadcast up to this number of keys, 8 bytes each; beyond it both sides are shuffled by the key.
FEW = 500_000


def keyed(docs: DataFrame) -> DataFrame:
    """Adds row, a key no other row has: the number of the row's file and its place there, both fixed once the file is
    written. A frame that is not just read from files is written first."""
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        docs = materialize(docs, "rows")
    path = F.col("_metadata.file_path").alias("_file")
    names = sorted(r[0] for r in docs.select(path).distinct().collect())
    files = docs.sparkSession.createDataFrame(list(enumerate(names)), "_n long, _file string")
    at = docs.select("*", path, F.col("_metadata.row_index").alias("_at")).join(F.broadcast(files), "_file")
    return at.withColumn("row", F.col("_n") * (1 << 40) + F.col("_at")).drop("_file", "_n", "_at")


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The documents whose row is not among the dropped ones. Their text is not sorted, and shuffled only if these are many."""
    dropped = materialize(dropped.distinct(), "dropped")
    few = dropped.count() <= FEW
    return docs.join(F.broadcast(dropped) if few else dropped.hint("shuffle_hash"), "row", "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    scored = score_quality(docs, table(spark, sf_dir, "labels"), threshold=0.3, key=F.struct(*COLUMNS))
    return scored.filter("predicted = 1").select("id.*")


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: that with the smallest id, null ids last, and of these the first."""
    docs = keyed(docs)
    of = near_duplicates(docs, id_col="row").select(F.col("id").alias("row"), "component_id").join(docs.select("row", "doc_id"), "row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    firsts = of.groupBy("component_id").agg(first.alias("first")).select("first.row")
    return without(docs, of.join(firsts, "row", "left_anti").select("row")).select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur twice are cut out: runs covered by repeated strings of REPEAT_BYTES, of more than 50 words or of
    twice those bytes. A character cut through goes with them. Null texts stay null."""
    rest = [c for c in COLUMNS if c != "text"]
    cut = remove_repeats(docs, REPEAT_BYTES, min_words=51, key=F.struct(*rest, F.when(F.col("text").isNull(), True).alias("none")))
    whole = F.size("starts") == 0
    text = F.when(whole, F.col("kept").cast("string")).otherwise(F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "\ufffd", ""))
    left = cut.select("id.*", F.when(F.col("id.none").isNull(), text).alias("text"), whole.alias("whole"))
    n_chars = F.when(F.col("whole"), F.col("n_chars")).otherwise(F.char_length("text")).cast("long")
    return left.withColumn("n_chars", n_chars).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    docs = keyed(docs)
    hit = contamination(docs, table(spark, sf_dir, "benchmark"), id_col="row").filter("n_hit > 0").select(F.col("id").alias("row"))
    return without(docs, hit).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer("word_bpe_49k.json"), 2048, 1).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicate),
    ("suffix-array dedup", repeats),
    ("benchmark decontamination", decontaminate),
    ("packing", packing),
]

#: A trained model and a tokenizer are no SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
