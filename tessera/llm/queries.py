"""The registered query of each operator of this subpackage, and SQL for those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, caps, exact, lm, packing, page_text, secret_scan, simhash, sstable, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.annotate(_table(spark, sf_dir, "documents"))


def op2_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.annotate(_table(spark, sf_dir, "documents"))


def op4_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.annotate(_table(spark, sf_dir, "documents"))


def op5_sorted_table_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.round_trip(_table(spark, sf_dir, "documents"))


def op6_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.annotate(_table(spark, sf_dir, "embeddings"))


def op7_inferred_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.annotate(_table(spark, sf_dir, "documents"))


def op8_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(_table(spark, sf_dir, "pages"))


def op9_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.annotate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_simhash_near_dedup, op2_tree_bpe, op3_exact_dedup, op4_attention_scores, op5_sorted_table_output, op6_cap_filters, op7_inferred_secrets, op8_page_differencing, op9_kneser_ney_toxicity, op10_mixture_packing)}

SQL = {
    "op3_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)
    """,
    # exact, by all pairs; the filters find nearly all of them (tests/llm/test_caps.py measures how many)
    "op6_cap_filters": """
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        usable AS (
            SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v
            WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
        link AS (
            SELECT a.vec_id AS u, b.vec_id AS w FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
        reach AS (SELECT vec_id AS u, vec_id AS w FROM v UNION SELECT reach.u, link.w FROM reach JOIN link ON reach.w = link.u)
        SELECT vec_id, (SELECT count(*) FROM link WHERE u = vec_id) AS n_links, min(w) AS component_id, vec_id = min(w) AS kept
        FROM v JOIN reach ON reach.u = vec_id GROUP BY vec_id
    """,
}
