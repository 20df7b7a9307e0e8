"""The registered queries opN_<name>: each applies its operator to its whole table and derives the columns asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import table
from tallyframe.llm.decontamination import contamination
from tallyframe.llm.fingerprints import fingerprints
from tallyframe.llm.jaccard_join import near_duplicates
from tallyframe.llm.language_id import identify
from tallyframe.llm.lm_scoring import pseudo_likelihood
from tallyframe.llm.mixing import mix
from tallyframe.llm.orc_tokens import tokens_through_orc
from tallyframe.llm.packing import pack
from tallyframe.llm.quality import score_quality
from tallyframe.llm.ranked_search import ranked_search
from tallyframe.llm.suffix_dedup import remove_repeats
from tallyframe.llm.token_counts import count_tokens
from tallyframe.llm.vector_codes import compress, digest


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"), 400)
    gone = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return cut.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        gone.alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        "n_shared",
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), 4096).withColumnRenamed("id", "doc_id")


def op4_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_through_orc(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=2)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)
    return hits.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3).withColumnRenamed("id", "doc_id")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 5, 3, 4).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), 2048, 1).withColumnRenamed("id", "doc_id")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, codebooks = compress(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)
    return coded.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_language_id": op2_language_id,
    "op3_token_counts": op3_token_counts,
    "op4_orc_tokens": op4_orc_tokens,
    "op5_decontamination": op5_decontamination,
    "op6_quality": op6_quality,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_fingerprints": op9_fingerprints,
    "op10_packing": op10_packing,
    "op11_vector_codes": op11_vector_codes,
    "op12_mixing": op12_mixing,
    "op13_ranked_search": op13_ranked_search,
}

#: Windows of ten item words, found again among all runs of as many document words.
DECONTAMINATION_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[k:k + 9] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM win),
runs AS (SELECT doc_id, n, k, w[k:k + n - 1] AS run FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, n, k, item_id FROM runs JOIN win ON run = win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: Shingle sets joined shingle by shingle, and the groups by repeated reaching.
JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
step AS (SELECT a AS u, b AS v FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, r) AS (SELECT u, u FROM step UNION SELECT reach.doc_id, step.v FROM reach JOIN step ON step.u = reach.r),
root AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(root.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN root USING (doc_id)
"""

#: Every part against every entry, three times.
_FAR = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"
_ASSIGNED = "SELECT r, p, any_value(x) AS x, arg_min(e, far * 64 + e) AS e, min(far) AS far FROM (SELECT r, p, x, e, {far} AS far FROM part JOIN {book} USING (p)) GROUP BY r, p"
_LEARNED = """SELECT p, b.e, coalesce(n.c, b.c) AS c FROM {book} b LEFT JOIN (SELECT p, e, list(s ORDER BY i) AS c FROM
  (SELECT p, e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS s FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i FROM {assigned}) GROUP BY p, e, i) GROUP BY p, e) n USING (p, e)"""
VECTOR_SQL = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (SELECT r, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM kept, (SELECT unnest(range(16)) AS p)),
b0 AS MATERIALIZED (SELECT p, e, x AS c FROM (SELECT r, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM kept) JOIN part USING (r) WHERE e < 64),
a0 AS MATERIALIZED ({_ASSIGNED.format(far=_FAR, book="b0")}), b1 AS MATERIALIZED ({_LEARNED.format(book="b0", assigned="a0")}),
a1 AS MATERIALIZED ({_ASSIGNED.format(far=_FAR, book="b1")}), b2 AS MATERIALIZED ({_LEARNED.format(book="b1", assigned="a1")}),
a2 AS MATERIALIZED ({_ASSIGNED.format(far=_FAR, book="b2")}),
coded AS (SELECT r, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM a2 GROUP BY r),
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (r), book
"""

#: Targets by trying each number of full sources in order of the level at which they are full; draws by a running sum.
MIXING_SQL = r"""
WITH d AS (SELECT doc_id, text, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
  0.05 + coalesce(length(regexp_replace(text, '[\x00-\x40\x5B-\x60\x7B-\x7F]+', '', 'g')) / greatest(length(text), 1), 0) AS weight,
  (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496 AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS share FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / share, source NULLS LAST) AS k FROM s),
full_first AS (SELECT a.k, 2.0 * a.source_size / a.share AS need, ((SELECT sum(source_size) FROM s) * 1.5 - sum(CASE WHEN b.k < a.k THEN 2.0 * b.source_size ELSE 0 END)) / sum(CASE WHEN b.k >= a.k THEN b.share END) AS level FROM o a, o b GROUP BY 1, 2),
cut AS (SELECT coalesce(min(k) FILTER (need > level), 1e9) AS k, min_by(level, k) FILTER (need > level) AS level FROM full_first),
t AS (SELECT source, source_size, CASE WHEN o.k < cut.k THEN 2.0 * source_size ELSE share * level END AS target FROM o, cut),
r AS (SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS words, greatest(source_size, 1) AS every, sum(size) OVER (PARTITION BY d.source ORDER BY -ln(u) / weight, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, CAST(target AS DOUBLE) AS target, CAST(words // every * size + greatest(0, least(size, words % every - before)) AS BIGINT) AS taken FROM r
"""

#: Every document scored for every item.
_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SEARCH_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY 1, 2),
s AS (SELECT CAST(count(*) AS BIGINT) AS n_all, CAST(sum(len(w)) AS BIGINT) AS l_all FROM d WHERE len(w) > 0),
p AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY ALL),
f AS (SELECT t, CAST(floor(1000 * ln((2 * n_all + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, s GROUP BY t, n_all),
x AS (SELECT item_id, r, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_all) // l_all)))) AS BIGINT) AS score FROM q JOIN f USING (t) JOIN p USING (t), s GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0 QUALIFY rank <= 10
"""

ORACLE_SQL: dict[str, str] = {
    "op5_decontamination": DECONTAMINATION_SQL,
    "op7_jaccard_join": JACCARD_SQL,
    "op11_vector_codes": VECTOR_SQL,
    "op12_mixing": MIXING_SQL,
    "op13_ranked_search": SEARCH_SQL,
}
