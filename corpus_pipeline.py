"""A corpus pipeline of five stages; each works on all that the one before kept.

1. toxicity: documents that the class-conditional models reject go;
2. exact: one document of each normalised text stays;
3. near copies: one document of each component of texts with Jaccard >= 0.8 of five-word shingles stays;
4. secrets: spans with secrets are replaced by ``[secret]``, all documents stay;
5. packing: the documents become pieces of sequences of at most 4096 tokens.

Every stage takes null and empty texts, null and repeated ids, repeated rows, texts of any length,
extra columns of any name and tables without rows; all but the last return the columns they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact, packing, secret_scan, simhash, toxicity
from tessera.llm.scratch import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts have no evidence against them; without labels nothing is rejected."""
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of equal texts stays, nulls last; a null text equals an empty one; of repeated rows one stays."""
    return exact.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of a component stays, nulls last; texts without words are alike; of repeated rows one stays."""
    return simhash.deduplicate(docs, similarity=0.8)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; ``n_chars``, if there is such a column, is that of the new text.  Null texts stay null."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A piece or more for each document: null and empty texts are their end id alone."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]

#: Tokenisers, hashes of shingles and fitted models aren't expressible in SQL; tests/llm/test_pipeline.py has a slow version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder and read again."""
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
