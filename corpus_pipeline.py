"""The corpus pipeline: quality rules, near-duplicate removal, secrets, mixing, tokens.

``run`` writes what each stage keeps as Parquet in the shared folder and reads it again for the next.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from storyloom.llm import bpe, mixing, near_copies, quality_rules, secret_scan
from storyloom.llm.common import read_table
from storyloom.session import apply_session_conf, shared_dir


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep_good(docs)


def first_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies: five-word similarity of 0.8 or more.

    Found by SimHash and multi-index hashing first, the rest by the exact join.
    """
    return near_copies.keep_first(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every stretch of secret text replaced by a mark."""
    return secret_scan.redacted(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by the rates that bring the domains to their shares; none is repeated."""
    return mixing.drawn(docs, read_table(spark, sf_dir, "labels"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens and packed token ids of every document."""
    return bpe.packed(docs, ["doc_id"], bpe.default_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", good_documents),
    ("near-dedup", first_of_near_copies),
    ("secret scans", without_secrets),
    ("mixing", mixed),
    ("bpe", tokens),
]

#: Fingerprints, fitted rates and merges have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(apply_session_conf(spark), sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
