"""Vectors kept by the content of their texts, so that a text is embedded once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultweave.functions.vectors import Embedder
from faultweave.session import materialise, path_exists

_KEPT = "text_key string, embedding array<double>"


def embed_kept(
    df: DataFrame, text: str, embed: Embedder, path: str, owner: str | None = None, out: str = "embedding"
) -> DataFrame:
    """:func:`embed_column` through the vectors kept at ``path``, which are added to.

    Each different text that no other owner has kept is embedded, once however many rows
    share it. An owner, such as a micro-batch, rewrites its own folder, so it may be
    repeated; without a name each call is an owner of its own. Texts are told apart by
    their MD5; give another path for another embedder.
    """
    spark = df.sparkSession
    owner = owner or uuid.uuid4().hex
    keyed = materialise(df.withColumn("_text_key", F.coalesce(F.md5(F.col(text)), F.lit("null"))), "keyed-texts")
    keys = materialise(keyed.select(F.col("_text_key").alias("text_key")).distinct(), "text-keys")

    def kept() -> DataFrame:
        if not path_exists(spark, path):
            return spark.createDataFrame([], f"{_KEPT}, owner string")
        return spark.read.schema(f"{_KEPT}, owner string").parquet(path)

    known = kept().where(F.col("owner") != owner).select("text_key").join(keys, "text_key", "left_semi")
    new = materialise(keys.join(known, "text_key", "left_anti"), "new-keys")
    if not new.isEmpty():
        unseen = keyed.select(F.col("_text_key").alias("text_key"), text).join(new, "text_key", "left_semi")
        unseen = materialise(unseen.dropDuplicates(["text_key"]), "new-texts")
        vectors = unseen.select("text_key", embed(F.col(text)).cast("array<double>").alias("embedding"))
        vectors.write.mode("overwrite").parquet(f"{path}/owner={owner}")
    # owners that met the same new text at the same time have kept the same vector
    found = kept().join(keys, "text_key", "left_semi").dropDuplicates(["text_key"])
    found = found.select(F.col("text_key").alias("_text_key"), F.col("embedding").alias("_vector"))
    columns = [F.col(f"`{c}`") for c in df.columns if c != out]
    return keyed.join(found, "_text_key", "left").select(*columns, F.col("_vector").alias(out))
