"""Corpus pipeline: stages that filter, deduplicate, decontaminate and mix ``documents``, each written and read again.

Every stage takes all rows of the one before and returns rows with the columns of ``documents``, others among them unchanged.
Null and empty texts fail the base rules and go in the second stage; null languages and sources are ones of their own; a row
with a null id takes part like any other and is kept or dropped by its text. Repeated rows are judged alike; of rows that
repeat an id in a near-duplicate class one stays. Very long texts are read whole. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktape.lineage import saved
from sparktape.llm import decontaminate, factorisation, mixing, perplexity, simhash


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores below its cut go."""
    machine = factorisation.quality_machine(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = factorisation.scored(docs, machine, metadata=["n_chars"])
    return rows.where(F.col("score") >= factorisation.CUT).select("doc.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or whose perplexity lies outside their language's bands, go."""
    return perplexity.passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class stays: the one with the smallest id. Near copies beyond the class's few bits stay."""
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once per copy that the mix takes."""
    return mixing.mix(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mix_sources", mix_sources),
]

#: The stages hold trained models and near-duplicate classes, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = saved(docs)
    return docs
