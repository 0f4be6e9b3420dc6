"""From raw documents to encoded training data.

Quality rules drop documents, near duplicates lose all but one of each group,
secrets are redacted, sources are mixed to their weights, and the mix is encoded.
Stages with Python steps bound the bytes of the session's Arrow batches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm import bpe, mixing, near_duplicates, quality, secrets
from skeinwork.session import bound_batches, delete, ensure_checkpoint_dir, scratch_ends


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are at least as likely good as not. Null,
    empty and very short texts go; rows that repeat stay or go together."""
    bound_batches(spark)
    return quality.keep_good(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity of 0.8 or more: of each group the document with the
    least id stays, of rows that repeat id and text one; wordless rows all stay."""
    bound_batches(spark)
    return near_duplicates.drop_near_duplicates(docs, limit=80, words=5)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret becomes its kind in brackets, and ``n_chars`` the new length (null for
    a null text); no row goes."""
    bound_batches(spark)
    return secrets.redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that the mix takes twice is there twice, one that it does not take is
    not there; a null source is a source of its own."""
    return mixing.serve(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``source``, ``n_tokens`` and ``ids`` of each row; a null or empty text
    has no tokens. Columns that documents has besides are not read."""
    bound_batches(spark)
    coded = bpe.encode(docs.select("doc_id", "source", "text"))
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", minhash_near_dedup),
    ("secret_scans", secret_scans),
    ("mix_sources", mix_sources),
    ("byte_bpe", byte_bpe),
]

#: Expectation-maximisation and byte-pair merges are not for SQL; the tests compare
#: each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage's result is written to the shared folder
    and read again, so that a stage that is lost starts from its predecessor's files;
    these go once the next stage is written. In the end only the result's are left. An
    empty table gives an empty result; further columns pass up to the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with scratch_ends(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            delete(spark, f"{folder}/{k - 1}")
    return docs
