"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from storyloom.llm import bpe, importance, jaccard_join, line_crf, mixing, neighbours, prefix_trie, quality_rules, secret_scan, simhash, substrings, surrogates, toxicity
from storyloom.llm.common import read_table
from storyloom.llm.oracles import ORACLES
from storyloom.session import apply_session_conf


def _over(table: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(read_table(apply_session_conf(spark), sf_dir, table))


def _labelled(operator: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query over documents that learns from labels."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        apply_session_conf(spark)
        return operator(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))

    return run


def _towards_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_session_conf(spark)
    return importance.op11(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": _over("documents", secret_scan.op1),
    "op2_nearest_neighbours": _over("embeddings", neighbours.op2),
    "op3_mixing": _labelled(mixing.op3),
    "op4_toxicity": _labelled(toxicity.op4),
    "op5_substring_dedup": _over("documents", substrings.op5),
    "op6_bpe": _over("documents", bpe.op6),
    "op7_simhash_near_dedup": _over("documents", simhash.op7),
    "op8_quality_rules": _over("documents", quality_rules.op8),
    "op9_pii_surrogates": _over("documents", surrogates.op9),
    "op10_quality_classifier": _labelled(line_crf.op10),
    "op11_importance_resampling": _towards_benchmark,
    "op12_jaccard_join": _over("documents", jaccard_join.op12),
    "op13_prefix_trie": _over("conversations", prefix_trie.op13),
}
