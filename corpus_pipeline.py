"""The corpus pipeline: five stages, each a thermocline.llm operator over the rows its predecessor kept.

Every stage but the last keeps all columns of its documents, whatever their names, and takes null
ids, null and empty texts, texts of any length, rows repeated in full and empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from thermocline.llm import decontaminate, dedup, mixture, toxicity, training_order
from thermocline.session import finished, forget, ship


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose toxicity score is 0.5 or more. Null and empty texts match nothing and stay; repeated rows are judged alike."""
    ship(spark)
    return toxicity.accepted(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies; texts that are equal, null ones too, are copies."""
    ship(spark)
    return dedup.deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that are contaminated by benchmark passages. Null and empty texts stay; repeated rows are judged alike."""
    ship(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources meet their target weights. Texts without a word leave; a null source is a source."""
    ship(spark)
    return mixture.mixed(docs)


def training_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of token ids in training order, with the ids of their documents. Each row is a document; an empty table gives no shard."""
    ship(spark)
    return training_order.shards(docs, public_tokenizers.path(training_order.VOCABULARY))


STAGES = [
    ("toxicity", toxicity_filter),
    ("near-duplicates", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("source mixture", source_mixture),
    ("token-ID output", training_shards),
]

#: The score of the first stage is learned, so no SQL gives run()'s rows; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents.

    Each gives a table in the shared folder; that of its predecessor, and all that a stage writes on
    its way, are deleted once it stands, so that two stages' tables are there at most.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = finished(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            forget(before)
        before = docs
    return docs
