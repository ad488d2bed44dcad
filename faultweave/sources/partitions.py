"""Date partitions: reading, replacing and archiving them."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_with_text_partitions(spark: SparkSession, root: str) -> DataFrame:
    """Parquet folders whose partition values are text as written: ``001`` stays ``001``."""
    rows = spark.read.parquet(root)
    file = rows.select("_metadata.file_path").head()
    if file is None:
        return rows
    names = set(re.findall(r"/([^/=]+)=[^/]*(?=/)", file.file_path))
    text = [T.StructField(f.name, T.StringType()) if f.name in names else f for f in rows.schema]
    return spark.read.schema(T.StructType(text)).parquet(root)


def _is(name: str, value: str) -> Column:
    return F.col(name) == F.lit(value)


def read_partition(
    spark: SparkSession, root: str, date: str, currency: str | None = None, schema: T.StructType | None = None
) -> DataFrame:
    """The rows of one ``date=`` (and ``currency=``) folder; other folders are not listed for reading.

    A root without files gives no rows: of ``schema`` (with the partition columns), or of the
    partition columns alone.
    """
    try:
        rows = read_with_text_partitions(spark, root)
    except AnalysisException as e:
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        keys = [T.StructField(c, T.StringType()) for c in ("date", "currency")[: 1 if currency is None else 2]]
        return spark.createDataFrame([], schema or T.StructType(keys))
    rows = rows.where(_is("date", date))
    return rows if currency is None else rows.where(_is("currency", currency))


def write_result(df: DataFrame, root: str) -> None:
    """Replace the ``date=`` folders that ``df`` has rows for, and leave the others."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date")
        .parquet(root)
    )


def archive_partition(spark: SparkSession, source: str, archive: str, date: str) -> DataFrame:
    """Copy one date folder, gzip-compressed, to the archive; report date, status, files and rows.

    A date without a folder is reported as ``missing`` and is no error.
    """
    day = read_with_text_partitions(spark, source).where(_is("date", date))
    files, rows = day.agg(F.countDistinct("_metadata.file_path"), F.count("*")).first()
    if files:
        (
            day.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .option("compression", "gzip")
            .partitionBy("date")
            .parquet(archive)
        )
    status = "archived" if files else "missing"
    return spark.createDataFrame([(date, status, files, rows)], "date string, status string, files long, rows long")
