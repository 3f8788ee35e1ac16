"""The registered queries of this subpackage: each runs its operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigie.llm import (
    archives, chat, decontaminate, divergence, hard_negatives, html_text, id_files, mixing, neighbours, repeats, simhash,
    tokens, toxicity,
)
from vigie.llm.tables import given


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.length_histogram(given(spark, sf_dir, "documents", "text"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = given(spark, sf_dir, "documents", "doc_id", "text")
    found = decontaminate.scan(docs, given(spark, sf_dir, "benchmark", "item_id", "text"))
    n_hit = decontaminate.hit_words()
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(given(spark, sf_dir, "pages", "page_id", "url", "html"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.roundtrip(given(spark, sf_dir, "pages", "page_id", "url", "html"), payloads=False).drop("url", "payload")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from two thirds of the conversations; roles of all come back from their raw lines."""
    raw = chat.transcribe(given(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    held_out = F.crc32(F.col("conv_id").cast("string")) % 3 == 1
    model = chat.learn(raw.filter(~held_out))
    return chat.parse(raw.drop("role"), model).withColumn("held_out", F.coalesce(held_out, F.lit(False)))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.cut_repeats(given(spark, sf_dir, "documents", "doc_id", "text")).drop("text")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(
        given(spark, sf_dir, "documents", "doc_id", "text"), given(spark, sf_dir, "labels", "doc_id", "toxic"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_copies(given(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = given(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return neighbours.nearest(rows, rows.filter("vec_id % 20 = 0"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(given(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(given(spark, sf_dir, "documents", "text", "lang", "source"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_files.roundtrip(given(spark, sf_dir, "documents", "doc_id", "text"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = given(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % hard_negatives.CLASSES).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), anchors=F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_token_counts, op2_decontamination, op3_html_extraction, op4_warc, op5_chat_formatting, op6_suffix_array_dedup,
        op7_toxicity, op8_simhash, op9_nearest_neighbours, op10_mixing, op11_source_divergence, op12_token_files,
        op13_hard_negatives,
    )
}

# --- SQL of the queries it can express: plain counts and comparisons of everything -------------
_OP11 = r"""WITH docs AS (
  SELECT row_number() OVER () AS d, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
occurrences AS (
  SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM occurrences GROUP BY lang, term HAVING count(DISTINCT d) >= 30),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups_ AS (SELECT DISTINCT lang, source FROM docs),
counts AS (
  SELECT lang, source, term, count(*) AS c FROM occurrences SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
    1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (coalesce(sum(c.c) OVER (PARTITION BY g.lang, g.source), 0) + 5 * s.v) AS p
  FROM groups_ g JOIN kept k ON g.lang = k.lang JOIN sizes s ON g.lang = s.lang
    LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term),
whole AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c) + 5)) // (sum(sum(c)) OVER (PARTITION BY lang) + 5 * any_value(v)) AS q
  FROM counts JOIN sizes USING (lang) GROUP BY lang, term),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(any_value(value), 0) AS value
  FROM groups_ a JOIN groups_ b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source AS one, y.source AS two, sum(abs(x.p - y.p)) AS value
    FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term GROUP BY x.lang, x.source, y.source) f
  ON f.lang = a.lang AND f.one = a.source AND f.two = b.source GROUP BY a.lang, a.source, b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, p - q AS value
  FROM shares JOIN whole USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 50"""
_OP13 = """WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.other AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY n.score DESC, n.other) AS INTEGER) AS rank,
  n.other AS negative_id, p.score AS positive_score, n.score AS negative_score,
  CAST(p.place AS INTEGER) AS positive_rank
FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS place FROM positives) p
JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY n.score DESC, n.other) <= 5"""

ORACLE_SQL: dict[str, str] = {"op11_source_divergence": _OP11, "op13_hard_negatives": _OP13}
