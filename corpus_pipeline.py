"""Corpus pipeline: five stages, each written as Parquet and read again.

Each stage works on every row its predecessor kept. Null ids and texts, empty
texts, repeated rows and empty tables are handled as the operators state; a
null or short text fails the quality rules and leaves in the first stage. Extra
columns travel along until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import materialize
from tessera.llm.decontamination import clean_documents
from tessera.llm.packing import pack
from tessera.llm.quality_rules import keep_good, language_references
from tessera.llm.secret_scan import redact_documents
from tessera.llm.simhash import keep_one_similar
from tessera.llm.tokens import default_tokenizer

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs, language_references(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 0.8 of the five-word shingles
    alike, as SimHash estimates it."""
    return keep_one_similar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced in their texts; ``n_chars`` follows."""
    return redact_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed training sequences."""
    return pack(docs, default_tokenizer())


STAGES = [("quality rules", quality), ("near dedup", near_dedup), ("decontamination", decontaminate), ("secret scans", secrets), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
