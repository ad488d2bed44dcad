"""The queries of these operators, each over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultweave.llm import (
    credentials,
    fim,
    licences,
    mixing,
    oracle,
    packing,
    quality,
    repair,
    sharding,
    simhash,
    substring,
    surrogates,
    vectors,
)
from faultweave.llm.common import table
from faultweave.llm.html import page_text

Query = Callable[[SparkSession, str], DataFrame]

VOCABULARY = "word_bpe_49k.json"
SHARDS = 8
#: The session setting that holds the key of surrogates (Spark hides settings named "secret").
SURROGATE_SETTING = "spark.faultweave.surrogates.secret"
#: For the made-up tables only: anyone can read it here. Set the setting for real texts.
PUBLIC_KEY = "made-up tables only"


def surrogate_key(spark: SparkSession) -> str:
    return spark.conf.get(SURROGATE_SETTING, PUBLIC_KEY)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.scan_documents(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged, verdict = quality.line_first(docs)
    fields = [n for n in quality.FIELDS.names if n != "clean_text"]
    return judged.select("doc_id", *[F.col(f"{verdict}.{n}") for n in fields])


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.best_fit_shards(table(spark, sf_dir, "documents"), n_shards=SHARDS)
    return shards.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("key")


def op5_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(table(spark, sf_dir, "documents")).drop("text_key")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_documents(table(spark, sf_dir, "documents"))


def op8_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", page_text(F.col("html")).alias("text"))
    return pages


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    replaced, count = surrogates.replace_personal_data(docs, surrogate_key(spark))
    return replaced.select("doc_id", "text", F.col(count).alias("n_replaced"))


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    found = repair.digest(repair.repair_conversations(repair.damage(conversations)))
    found = found.withColumnRenamed("conv_id", "_conv")
    ids = conversations.select("conv_id").distinct()
    none = {**dict.fromkeys(repair.COUNTS, F.lit(0).cast("long")), "audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(
        "conv_id", *[F.coalesce(F.col(c), value).alias(c) for c, value in none.items()]
    )


def op12_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned, found = licences.scan_licences(table(spark, sf_dir, "documents"), carry=["doc_id"])
    places = F.col(f"{found}.places")
    return scanned.select(
        "doc_id",
        f"{found}.n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.array_join(f"{found}.base_labels", ",").alias("base_labels"),
        F.array_join(f"{found}.labels", ",").alias("labels"),
        f"{found}.score",
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, parts = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    made = made.select("doc_id", f"{parts}.*")
    restored, text = fim.restore(made, "output", "form")
    return restored.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(text, 256).alias("restored_sha256"),
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_quality_rules,
        op3_shards,
        op4_mix_sources,
        op5_pack_documents,
        op6_repeated_passages,
        op7_simhash,
        op8_visible_text,
        op9_surrogates,
        op10_near_vectors,
        op11_conversation_repair,
        op12_licence_scan,
        op13_fill_in_middle,
    )
}

ORACLE = dict(oracle.ORACLE)
