"""The registered queries of this subpackage and their DuckDB SQL where there is one."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from thermocline.session import ship

#: Query name: module whose query(spark, sf_dir) it is.
MODULES = {
    "op1_token_counts": "token_counts",
    "op2_media_columns": "media",
    "op3_prob_minhash_dedup": "dedup",
    "op4_license_scan": "licenses",
    "op5_personal_data": "pii",
    "op6_benchmark_decontamination": "decontaminate",
    "op7_toxicity": "toxicity",
    "op8_training_order": "training_order",
    "op9_source_mixture": "mixture",
    "op10_language_id": "language",
    "op11_lexical_search": "search",
    "op12_conversation_trie": "trie",
    "op13_warc_transactions": "warc",
}


def _query(module: str) -> Callable[[SparkSession, str], DataFrame]:
    found = importlib.import_module(f"thermocline.llm.{module}").query

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return found(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(module) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"thermocline.llm.{module}"), "ORACLE", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
