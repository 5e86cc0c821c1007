"""From raw documents to token ids: rules, near copies, benchmarks, secrets, tokens.

Each stage takes all that the one before kept, as written to Parquet.

Results for odd input: rows that share a doc_id are one document, and what drops one
of them drops all; a row with a null id is a document of its own, after all others; a
null or empty text fails the quality rules; of equal documents the smallest id stays;
texts of any length are taken whole; an empty table passes every stage as an empty one;
columns beside those of documents stay until the last stage, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import bpe_encode
from tessera.llm.decontaminate import decontaminate
from tessera.llm.jaccard_join import jaccard_join
from tessera.llm.quality_rules import quality_rules
from tessera.llm.secret_scan import mask_secrets
from tessera.llm.storage import apart, given_id, removed, shared_folder


def _without(docs: DataFrame, gone: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """docs but for the ids that ``gone`` gives of them."""
    own, least = apart(docs)
    out = own.join(gone(own).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
    return out if own is docs else out.withColumn("doc_id", given_id(least).cast(docs.schema["doc_id"].dataType))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the outlier rule reject go."""
    return _without(docs, lambda own: quality_rules(own).where(~F.col("kept")))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id stays."""
    return _without(docs, lambda own: jaccard_join(own).where(~F.col("component_id").eqNullSafe(F.col("doc_id"))))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return _without(docs, lambda own: decontaminate(own, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; all documents stay."""
    return mask_secrets(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and decoded of each document."""
    return bpe_encode(docs, with_decoded=True)


STAGES = [
    ("quality rules", quality_stage),
    ("near copies", near_copy_stage),
    ("benchmark decontamination", benchmark_stage),
    ("secrets", secret_stage),
    ("tokens", token_stage),
]

#: The stages' joins by similarity, edit distance and token merges are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of a folder; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            removed(spark, f"{folder}/{i - 1}")  # the stage after it is written
    return STAGES[-1][1](spark, docs, sf_dir)
