"""Registered queries of the training-data operators: one ``opN_<name>`` each.

A query reads its whole tables, calls its operator with production parameters
and derives the result columns. None has an ``oracle_sql`` entry unless it is
listed in :data:`SQL`: learning, alignment and hashing of this kind cannot be
said in DuckDB SQL, so ``tests/llm`` holds them against brute-force versions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledger_spark.llm.common import table
from ledger_spark.session import ship_package


def shipped(call: Callable) -> Callable:
    """``call`` (whose first argument is the session), once the workers have this package."""

    @wraps(call)
    def run(spark: SparkSession, *rest):
        ship_package(spark)
        return call(spark, *rest)

    return run


def op1_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, hits per document."""
    from ledger_spark.llm import toxicity

    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted per document."""
    from ledger_spark.llm import quality

    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, mix_position, mix_slot, mix_release, mix_deadline per document."""
    from ledger_spark.llm import mixing

    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op8_language_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score per document."""
    from ledger_spark.llm import language

    return language.identify(table(spark, sf_dir, "documents"))


def op3_brown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity per document."""
    from ledger_spark.llm import brown

    return brown.score_held_out(table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars per page."""
    from ledger_spark.llm import htmltext

    found = htmltext.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text (without its repeated blocks), units_cut per document."""
    from ledger_spark.llm import linededup

    return linededup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"), count="units_cut")


def op6_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id per document."""
    from ledger_spark.llm import simhash

    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: ten best for each query."""
    from ledger_spark.llm import topk

    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_benchmark_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, start, end, edits: each benchmark item found in each document."""
    from ledger_spark.llm import decontaminate

    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score, rank per document."""
    from ledger_spark.llm import importance

    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    from ledger_spark.llm import hardneg

    return hardneg.mine(table(spark, sf_dir, "embeddings"),
                        label=hardneg.relabelled(F.col("vec_id"), F.col("label")))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per document."""
    from ledger_spark.llm import tokencount

    return tokencount.token_counts(table(spark, sf_dir, "documents"))


SPARK = {name: shipped(query) for name, query in {
    "op1_toxicity_lexicon": op1_toxicity_lexicon,
    "op2_quality_neighbours": op2_quality_neighbours,
    "op3_brown_scores": op3_brown_scores,
    "op8_language_hierarchy": op8_language_hierarchy,
    "op4_html_text": op4_html_text,
    "op5_line_dedup": op5_line_dedup,
    "op6_simhash_near_duplicates": op6_simhash_near_duplicates,
    "op7_pfair_mix": op7_pfair_mix,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_benchmark_matches": op10_benchmark_matches,
    "op11_importance_resample": op11_importance_resample,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_token_counts": op13_token_counts,
}.items()}

#: DuckDB SQL for those queries that SQL can express.
SQL: dict[str, str] = {
    "op9_exact_top_k": """
        WITH t AS (
            SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * 1024) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM t AS q JOIN t AS c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
            WHERE q.vec_id % 100 = 0
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
                   vec_id, score
            FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op11_importance_resample": r"""
        WITH crc AS (
            SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                                    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
            FROM range(256) AS r(i)
        ), w AS (
            SELECT row_number() OVER () AS r, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words, TRUE AS is_document FROM documents
            UNION ALL
            SELECT row_number() OVER () AS r, NULL,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), FALSE FROM benchmark
        ), f AS (
            SELECT r, is_document, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS feature
            FROM w
        ), hashed AS (
            SELECT feature, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, len(h), 2),
                       lambda i: (strpos('0123456789ABCDEF', h[i]) - 1) * 16 + strpos('0123456789ABCDEF', h[i + 1]) - 1)),
                       lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 10000 AS bucket
            FROM (SELECT DISTINCT feature, hex(feature) AS h FROM f), crc
        ), totals AS (
            SELECT bucket, count(*) FILTER (WHERE is_document) AS s, count(*) FILTER (WHERE NOT is_document) AS t
            FROM f JOIN hashed USING (feature) GROUP BY bucket
        ), gains AS (
            SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM totals) + 10000)::DOUBLE)
                                           / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM totals) + 10000)::DOUBLE)))::BIGINT AS gain
            FROM totals
        ), sums AS (
            SELECT r, count(*) AS n, sum(gain)::BIGINT AS total
            FROM f JOIN hashed USING (feature) JOIN gains USING (bucket) WHERE is_document GROUP BY r
        ), scored AS (
            SELECT w.r, doc_id, coalesce(n, 0)::BIGINT AS n_features, len(words) AS n_words,
                   coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight,
                   floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise
            FROM w LEFT JOIN sums USING (r) WHERE is_document
        ), ranked AS (
            SELECT *, weight + noise AS score,
                   row_number() OVER (PARTITION BY n_words >= 20 AND noise IS NOT NULL ORDER BY weight + noise DESC, doc_id) AS place,
                   count(*) OVER (PARTITION BY n_words >= 20 AND noise IS NOT NULL) AS able
            FROM scored
        )
        SELECT doc_id, n_features, weight, score,
               CASE WHEN n_words >= 20 AND noise IS NOT NULL AND place <= 25 * able // 100 THEN place END AS rank
        FROM ranked
    """,
    "op12_hard_negatives": """
        WITH t AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * 256) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
        ), s AS (
            SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same,
                   CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM t AS a JOIN t AS c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v)
            WHERE a.vec_id % 50 = 0
        ), p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT anchor_id, positive_id,
               CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
               s.vec_id AS negative_id, positive_score, s.score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
        QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) <= 3
    """,
}
