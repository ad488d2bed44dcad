"""A corpus pipeline: clean, deduplicate, protect, mix and pack the documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from faultweave.llm import mixing, packing, quality, simhash, surrogates
from faultweave.llm.catalog import VOCABULARY, surrogate_key
from faultweave.session import materialise

#: Options of ``mixing.mix``: the mixture that orders the documents and their sequences.
MIXTURE: dict = {}


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove failing lines, then documents that fail or lost too much."""
    return quality.keep_good(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group within four bits."""
    return simhash.keep_one(docs)


def protect(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts, keyed by the session's setting."""
    replaced, count = surrogates.replace_personal_data(docs, surrogate_key(spark))
    return replaced.drop(count)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the documents in the order of the mixture of their sources."""
    return mixing.in_mixed_order(docs, **MIXTURE)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the documents into token pieces and pack those into sequences, in the order of the mixture.

    The order of rows and files is lost when they are read again, so it is found anew.
    """
    return packing.pack_documents(
        docs, public_tokenizers.path(VOCABULARY), places=mixing.places(docs, **MIXTURE)
    )


STAGES = [("quality rules", clean), ("simhash", deduplicate), ("pii", protect), ("mixing", mix), ("packing", pack)]

#: Fingerprints, keyed surrogates and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage reading what the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
