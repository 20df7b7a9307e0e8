"""Registered queries on narrative text of reports, with the SQL each must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import retrieval
from tallyframe.plans.catalog import registered
from tallyframe.plans.facts import read

# Words of the documents' made-up languages in the roles of the words of annual reports; headings are short lines.
WORDS = retrieval.Vocabulary(
    signals={"up": ["the", "sch", "que"], "down": ["reou", "ung", "ción"]},
    cash=["thin", "auf", "ment"],
    operating=["tion", "lich"],
    other_cash=["shon", "ver"],
    context=["onth", "erac"],
    reasons=["nter", "ein", "eau"],
    detail=["whou", "keit"],
    mda=r"^[A-Z][^,]{20,60}\.$",
    notes=r"^[A-Z][^.]{0,24}\.$",
    top_level=r"^[A-Z][a-z]{0,3}(?:\.|ng)",
)


def _has(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(c, '{w}')" for w in words) + ")"


_BOUNDS = """(SELECT doc_id, '{name}' AS section, min(i) + 1 AS start FROM b WHERE regexp_matches(c, '{heading}') GROUP BY doc_id)"""


@registered(rf"""WITH RECURSIVE d AS (SELECT doc_id, text, sha256(coalesce(text, '')) AS sha, list_filter(['up', 'down'], lambda s: CASE s WHEN 'up' THEN doc_id % 4 IN (1, 3) ELSE doc_id % 4 IN (2, 3) END) AS signals, 1990 + doc_id % 30 AS y FROM documents),
n AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS o FROM d),
b AS (SELECT doc_id, t, o, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS i, regexp_replace(t, '\s+', '', 'g') AS c FROM n WHERE t <> ''),
h AS ({_BOUNDS.format(name="mda", heading=WORDS.mda)} UNION ALL {_BOUNDS.format(name="financial_notes", heading=WORDS.notes)}),
r AS (SELECT h.*, (SELECT coalesce(min(b.i), 1000000000) FROM b WHERE b.doc_id = h.doc_id AND b.i >= h.start AND regexp_matches(b.c, '{WORDS.top_level}')) AS stop FROM h),
f AS (SELECT b.*, section, signals, sha, {_has(WORDS.cash)} AND ({_has(WORDS.operating)} OR NOT {_has(WORDS.other_cash)}) AS cash, {_has(WORDS.operating)} AS op, {_has(WORDS.reasons)} AS why, {_has(WORDS.detail)} AS detail,
  {_has(WORDS.context)} OR contains(c, CAST(y AS VARCHAR)) OR contains(c, CAST(y - 1 AS VARCHAR)) AS ctx, {_has(WORDS.signals["up"])} AS up, {_has(WORDS.signals["down"])} AS down FROM b JOIN r USING (doc_id) JOIN d USING (doc_id) WHERE i >= start AND i < stop AND length(t) <= 300),
m AS (SELECT *, list_filter(signals, lambda s: cash OR ((CASE s WHEN 'up' THEN up ELSE down END) AND (ctx OR why))) AS told FROM f),
s AS (SELECT *, list_max(list_transform(told, lambda s: 4 * CAST(cash AS INTEGER) + 3 * CAST(CASE s WHEN 'up' THEN up ELSE down END AS INTEGER))) + 2 * CAST(cash AND op AS INTEGER) + CAST(ctx AS INTEGER) + CAST(why AS INTEGER) + CAST(detail AS INTEGER) + CAST(section = 'mda' AS INTEGER) AS score,
  'nctx-' || substr(sha256(doc_id || chr(10) || sha || chr(10) || section || chr(10) || (o // 20 + 1) || chr(10) || '0' || chr(10) || (o % 20) || chr(10) || t), 1, 20) AS id FROM m WHERE len(told) > 0),
k AS (SELECT doc_id, id, section, told, length(t) AS size, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, o, id) AS k, row_number() OVER (PARTITION BY doc_id, section ORDER BY score DESC, o, id) AS of_section FROM s),
steps AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p, k) AS step FROM (SELECT *, CASE section WHEN 'mda' THEN 1 ELSE 2 END AS p FROM k WHERE of_section = 1 UNION ALL SELECT *, 3 FROM k)),
fold(doc_id, step, chosen, chars) AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST(0 AS BIGINT) FROM k UNION ALL
  SELECT doc_id, step, CASE WHEN fits THEN list_append(chosen, id) ELSE chosen END, CASE WHEN fits THEN chars + size ELSE chars END FROM (SELECT fold.doc_id, b.step, chosen, chars, b.id, b.size, NOT list_contains(chosen, b.id) AND len(chosen) < 3 AND chars + b.size <= 500 AS fits FROM fold JOIN steps b ON b.doc_id = fold.doc_id AND b.step = fold.step + 1)),
done AS (SELECT doc_id, arg_max(chosen, step) AS chosen FROM fold GROUP BY doc_id),
heads AS (SELECT doc_id, list(section) AS heads FROM h GROUP BY 1), spoken AS (SELECT doc_id, s, list(id) AS of_signal FROM (SELECT doc_id, id, unnest(told) AS s FROM k) GROUP BY 1, 2),
q AS (SELECT d.doc_id, signals, coalesce(chosen, []) AS chosen, CASE WHEN len(signals) = 0 THEN 'no_candidate_signal' WHEN NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = d.doc_id) THEN 'source_has_no_text_blocks'
  WHEN coalesce(len(heads), 0) < 2 THEN 'required_section_heading_missing:' || array_to_string(list_filter(['mda', 'financial_notes'], lambda x: NOT list_contains(coalesce(heads, []), x)), ',')
  WHEN chosen IS NULL THEN 'no_relevant_snippets_within_per_snippet_limit' WHEN len(chosen) = 0 THEN 'no_relevant_snippets_within_total_budget' END AS reason FROM d LEFT JOIN done USING (doc_id) LEFT JOIN heads USING (doc_id)),
each AS (SELECT doc_id, s, reason, of_signal, list_filter(CASE WHEN reason IS NULL THEN chosen ELSE [] END, lambda x: list_contains(coalesce(of_signal, []), x)) AS ids FROM (SELECT *, unnest(signals) AS s FROM q) q LEFT JOIN spoken USING (doc_id, s)),
told AS (SELECT doc_id, string_agg(s || '=' || CASE WHEN len(ids) > 0 THEN array_to_string(ids, '+') ELSE coalesce(reason, CASE WHEN of_signal IS NOT NULL THEN 'snippet_budget_exhausted' ELSE 'no_relevant_snippet_for_signal' END) END, ';' ORDER BY s DESC) AS outcome FROM each GROUP BY doc_id)
SELECT doc_id, CASE WHEN reason IS NULL THEN 'retrieved' ELSE 'abstained' END AS status, reason, CASE WHEN reason IS NULL THEN array_to_string(chosen, ',') ELSE '' END AS evidence, coalesce(outcome, '') AS outcome FROM q LEFT JOIN told USING (doc_id)""")
def context_retrieval(spark, sf_dir):
    """Lines of documents as blocks of 20 to a page, at most three of up to 300 characters and 500 together."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda t, o: F.struct(o.alias("o"), t.alias("t"))), lambda b: b["t"] != "")
    blocks = F.transform(lines, lambda b: F.struct((F.floor(b["o"] / 20) + 1).alias("page"), F.lit(0).alias("x0"), (b["o"] % 20).alias("y0"), b["t"].alias("text")))
    signals = F.array_compact(F.array(F.when((F.col("doc_id") % 4).isin(1, 3), "up"), F.when((F.col("doc_id") % 4).isin(2, 3), "down")))
    docs = read(spark, sf_dir, "documents").select("doc_id", blocks.alias("blocks"), signals.alias("signals"), (1990 + F.col("doc_id") % 30).alias("report_year"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    got = retrieval.retrieve(docs, [F.col("doc_id").cast("string"), F.col("sha")], words=WORDS, max_snippets=3, max_chars=300, max_total=500)
    outcome = F.transform("signal_results", lambda r: F.concat(r["signal"], F.lit("="), F.when(F.size(r["evidence_ids"]) > 0, F.array_join(r["evidence_ids"], "+")).otherwise(r["reason"])))
    evidence = F.array_join(F.transform("snippets", lambda c: c["evidence_id"]), ",")
    return got.select("doc_id", "status", "reason", evidence.alias("evidence"), F.array_join(outcome, ";").alias("outcome"))
