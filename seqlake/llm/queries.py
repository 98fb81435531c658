"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact_dedup, html_text, langid, packing, pii, quality, simhash, toxicity
from .common import table


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation 2k is the chosen one of pair k, 2k + 1 the rejected one."""
    return chat.preference(chat.neighbours(table(spark, sf_dir, "conversations")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(table(spark, sf_dir, "documents"))


def pieces(docs: DataFrame) -> DataFrame:
    return packing.pack(docs, tokenizer(), with_ids=False).drop("source", "window")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_chat_formatting, op2_toxicity, op3_html_extraction, op4_quality, op5_language_id,
    op6_packing, op7_simhash, op8_decontamination, op9_pii, op10_exact_dedup,
)}

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op1_chat_formatting": """
WITH t AS (SELECT CAST(floor(conv_id / 2.0) AS BIGINT) AS pair_id, conv_id - 2 * CAST(floor(conv_id / 2.0) AS BIGINT) AS side, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
           FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT *, concat('<|', role, '|>', chr(10), text, chr(10), '<|end|>', chr(10)) AS s FROM t),
n AS (SELECT pair_id, count(*) FILTER (side = 0) AS n0, count(*) FILTER (side = 1) AS n1 FROM r GROUP BY pair_id),
d AS (SELECT a.pair_id, min(a.i) AS i FROM r a JOIN r b ON a.pair_id = b.pair_id AND a.i = b.i AND a.side = 0 AND b.side = 1
      WHERE a.role <> b.role OR a.text <> b.text GROUP BY a.pair_id),
p AS (SELECT n.pair_id, n0, n1, CASE WHEN n0 = 0 OR n1 = 0 THEN 0 ELSE coalesce(d.i - 1, least(n0, n1)) END AS k FROM n LEFT JOIN d USING (pair_id)),
c AS (SELECT r.*, k, sum(length(s)) OVER (PARTITION BY r.pair_id, side, i > k ORDER BY i) - length(s) + length(role) + 5 AS b FROM r JOIN p USING (pair_id)),
o AS (SELECT pair_id,
        coalesce(string_agg(s, '' ORDER BY i) FILTER (i <= k AND side = 0), '') AS prompt,
        coalesce(string_agg(s, '' ORDER BY i) FILTER (i > k AND side = 0), '') AS chosen,
        coalesce(string_agg(s, '' ORDER BY i) FILTER (i > k AND side = 1), '') AS rejected,
        coalesce(string_agg(concat(CAST(b AS BIGINT), ':', CAST(b + length(text) AS BIGINT)), ',' ORDER BY i) FILTER (i > k AND side = 0 AND role = 'assistant'), '') AS chosen_mask,
        coalesce(string_agg(concat(CAST(b AS BIGINT), ':', CAST(b + length(text) AS BIGINT)), ',' ORDER BY i) FILTER (i > k AND side = 1 AND role = 'assistant'), '') AS rejected_mask
      FROM c GROUP BY pair_id)
SELECT pair_id, CAST(k AS BIGINT) AS prompt_turns, prompt, CASE WHEN n0 > 0 THEN chosen END AS chosen, CASE WHEN n1 > 0 THEN rejected END AS rejected,
       CASE WHEN n0 > 0 THEN chosen_mask END AS chosen_mask, CASE WHEN n1 > 0 THEN rejected_mask END AS rejected_mask
FROM o JOIN p USING (pair_id)""",
    "op10_exact_dedup": f"""
WITH d AS (SELECT doc_id, {_FOLDED} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d""",
    "op8_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS s
      FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
      FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM p))),
h AS (SELECT g.doc_id, g.k, g.i, p.item FROM g JOIN p ON g.k = p.k AND g.s = p.s),
c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n, 0) AS BIGINT) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256,
       coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
}
