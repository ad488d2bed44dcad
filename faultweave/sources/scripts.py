"""Job scripts as records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultweave.functions.text import file_label


def read_scripts(
    spark: SparkSession, path: str, manifest: DataFrame | None = None, by_folder: bool = False
) -> DataFrame:
    """name, path, content, size, modified (epoch seconds), permissions.

    Spark's readers do not see mode bits, so permissions come from ``manifest``
    (name, permissions) and are null without one. Line ends come out as LF. With
    ``by_folder`` a script is named after the folder it lies in.
    """
    file = F.col("_metadata.file_path")
    name = F.element_at(F.split(file, "/"), -2 if by_folder else -1)
    scripts = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        file_label(name).alias("name"),
        file.alias("path"),
        F.regexp_replace("value", "\r\n?", "\n").alias("content"),
        F.col("_metadata.file_size").alias("size"),
        (F.unix_micros("_metadata.file_modification_time") / 1e6).alias("modified"),
    )
    if manifest is None:
        return scripts.withColumn("permissions", F.lit(None).cast("string"))
    return scripts.join(manifest.select("name", "permissions"), "name", "left")
