"""One query for each operator, over its whole table, and the pipeline."""

from __future__ import annotations

import re
import uuid

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from inquest.llm import (alignment, bytepairs, hardnegatives, licences, lines, mixing, pii,
                         secretscan, simhash, sketches, tokencounts, topk, toxicity)
from inquest.llm.common import ORACLES, QUERIES, broadcast_within, query, shared_folder, table

__all__ = ["ORACLES", "QUERIES"]


@query("""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
""")
def op1_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@query()
def op2_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return sketches.fingerprints(table(spark, folder, "documents"))


@query()
def op3_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target",
                        (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


@query()
def op4_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return licences.scan(docs, licences.train(docs))


@query()
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.train(docs, table(spark, folder, "labels"))
    return toxicity.scores(docs, model).select(
        "doc_id", toxicity.fold(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query()
def op6_simhash_classes(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.classes(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


@query()
def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bytepairs.round_trip(table(spark, folder, "documents"),
                                public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                public_tokenizers.PATTERN)


@query(r"""
WITH d AS (SELECT *, row_number() OVER () AS r FROM documents),
l AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id),
t AS (
  SELECT d.source, d.lang, coalesce(CASE WHEN l.toxic = 1
           THEN regexp_replace(d.text, '[0-9]+', '', 'g') ELSE d.text END, '') AS text
  FROM d LEFT JOIN l USING (doc_id) WHERE coalesce(l.quality, 1) <> 0),
c AS (
  SELECT source, lang, 'words-1' AS version,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n FROM t
  UNION ALL
  SELECT source, lang, 'pieces-1',
         len(regexp_extract_all(text, '[A-Za-z0-9]+|[^\x00-\x20A-Za-z0-9]')) FROM t)
SELECT source, lang, version, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens
FROM c GROUP BY ALL
""")
def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """All documents come in; toxic ones are revised, poor ones deleted; both are sent twice."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    rollup = tokencounts.Rollup(spark, f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}")
    rollup.apply("load", inserts=tokencounts.counted(docs, F.col("text")))
    toxic = broadcast_within(labels.filter("toxic = 1").select("doc_id").distinct(), 16)
    poor = labels.filter("quality = 0").select("doc_id")
    for _ in range(2):
        rollup.apply("revise", revisions=tokencounts.counted(
            docs.join(toxic, "doc_id", "left_semi"), F.regexp_replace("text", "[0-9]+", "")))
        rollup.apply("delete", deletes=poor)
    return rollup.totals()


@query()
def op10_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(pii.spans(table(spark, folder, "documents")))


@query()
def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = lines.without_repeats(table(spark, folder, "documents"))
    return kept.select("doc_id", F.size(F.split(F.coalesce("__before", F.lit("")), "\n"))
                       .alias("n_lines"), F.size("__gone").alias("n_removed"),
                       F.array_join("__gone", ",").alias("removed_lines"),
                       F.sha2("text", 256).alias("kept_sha256"))


@query()
def op11_align_tokenizers(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(table(spark, folder, "documents"),
                           public_tokenizers.path("byte_bpe_50k.json"),
                           public_tokenizers.path("piece_bpe_32k.model"))


@query("""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike,
         CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id
  WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (
           PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT alike
   AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score,
       negative_score FROM n WHERE rank <= 5
""")
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardnegatives.hard_negatives(table(spark, folder, "embeddings"),
                                        F.col("vec_id") % 100 == 0, label=moved)


def secret_sql() -> str:
    """Matches and the gaps between them give the places; the rules' patterns as they stand."""
    def quoted(pattern: str, fold: bool) -> str:
        if fold:                          # letters outside classes, in either case
            parts = re.split(r"(\\x..|\[.*?\])", pattern)
            parts[::2] = [re.sub("[A-Za-z]", lambda m: f"[{m[0].upper()}{m[0].lower()}]", p)
                          for p in parts[::2]]
            pattern = "".join(parts)
        return "'" + pattern.replace("'", "''") + "'"
    found = " UNION ALL ".join(
        f"SELECT r, {i} AS n, '{rule.kind}' AS kind, v, gap, v IS NOT NULL AND regexp_full_match("
        f"v, {quoted(rule.keep or rule.pattern, rule.fold)}) AS kept, i FROM (SELECT r, "
        f"unnest(regexp_extract_all(text, {quoted(rule.pattern, rule.fold)})) AS v, unnest("
        f"string_split_regex(text, {quoted(rule.pattern, rule.fold)})) AS gap, generate_subscripts("
        f"string_split_regex(text, {quoted(rule.pattern, rule.fold)}), 1) AS i FROM d)"
        for i, rule in enumerate(secretscan.RULES))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({found}),
t AS (
  SELECT r, n, kind, kept, v, CAST(sum(length(gap)) OVER w + coalesce(sum(length(v)) OVER (
    PARTITION BY r, n ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a
  FROM m WINDOW w AS (PARTITION BY r, n ORDER BY i ROWS UNBOUNDED PRECEDING)),
s AS (SELECT r, n, kind, a, kind || ':' || a || ':' || (a + length(v)) AS span FROM t WHERE kept)
SELECT doc_id, count(*) FILTER (n = 0) AS n_assign, count(*) FILTER (n = 1) AS n_access,
       count(*) FILTER (n = 2) AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY a, n) FILTER (n < 3), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY a, n), '') AS spans
FROM d LEFT JOIN s USING (r) GROUP BY r, doc_id
"""


@query(secret_sql())
def op13_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secretscan.report(secretscan.secrets(table(spark, folder, "documents")))


@query(corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)
