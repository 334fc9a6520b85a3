"""From raw documents to token ids: quality rules, near duplicates, secrets, mixing, encoding.

Every stage takes the Parquet that the one before it wrote, with the columns of documents, and works on all
of it. Rejected documents are gone, one of each group of near duplicates stays, secrets are masked, documents
come as often as the mix takes them, and the last stage returns the ids.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelake.llm import bpe, mixing, near_sets, quality_rules, secret_scan
from wirelake.llm.queries import MULTI, documents
from wirelake.llm.shared import begin_stage, shared_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the weakly supervised verdict keep. Null and empty texts have too few words and go; other columns may be null."""
    return quality_rules.keep_good(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near duplicates: five-word shingles, Jaccard similarity of 0.8 or more. Rows without a doc_id stay; rows that repeat one stay or go together."""
    return near_sets.keep_first(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with secrets masked. A null text stays null; repeated rows stay."""
    return secret_scan.mask_secrets(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it. A null source is a source; rows that repeat a doc_id within a source are taken alike."""
    return mixing.mixed(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, tokens): the ids of every document, which decode to its text; none for a null or empty one."""
    kept = bpe.encode(docs.select("doc_id", "source", "text"), public_tokenizers.path(MULTI))
    return kept.select("doc_id", "source", F.size("tokens").cast("long").alias("n_tokens"), "tokens")


def _stage(function):
    """A stage that first deletes the intermediate tables of the one before, whose result is written by then."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        begin_stage(spark)
        return function(spark, docs, sf_dir)

    run_stage.__name__, run_stage.__doc__ = function.__name__, function.__doc__
    return run_stage


STAGES = [
    ("quality rules", _stage(quality_stage)),
    ("near-dedup", _stage(near_dedup_stage)),
    ("secret scan", _stage(secret_stage)),
    ("mixing", _stage(mixing_stage)),
    ("encoding", _stage(encoding_stage)),
]

#: SQL can express neither expectation-maximisation nor merges; tests/llm hold rules, near-dedup, secrets and ids of each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written in the shared folder and read again. No documents, no rows."""
    docs, folder = documents(spark, sf_dir), f"{shared_folder(spark)}/wirelake/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name.replace(' ', '-')}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
