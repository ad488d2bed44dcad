"""Daily customer scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultweave.functions.scoring import risk_band
from faultweave.session import path_exists
from faultweave.sources.partitions import read_with_text_partitions


def due_for_scoring(customers: DataFrame, date: str) -> DataFrame:
    """Customers last scored before ``date``, or never."""
    last = F.col("last_score_date")
    return customers.where((last < F.lit(date).cast("date")) | last.isNull())


def score_table(customers: DataFrame, score: Column | str, date: str) -> DataFrame:
    """customer_id, score, risk_band, calc_date."""
    value = F.col(score) if isinstance(score, str) else score
    return customers.select(
        "customer_id", value.alias("score"), risk_band(value).alias("risk_band"), F.lit(date).alias("calc_date")
    )


SCORE_KEY = ("customer_id", "calc_date")


def upsert_scores(target: DataFrame, updates: DataFrame) -> DataFrame:
    """``target`` with score and band taken from ``updates`` where it has the key.

    Both sides meet in one aggregation on the key, which merges rows before the shuffle.
    Updates that repeat a key are an error unless they carry ``seq``; then the last one counts.
    """
    turn = F.col("seq") if "seq" in updates.columns else F.lit(0)
    old = target.select(*SCORE_KEY, "score", "risk_band", F.lit(-1).cast("long").alias("_turn"))
    new = updates.select(*SCORE_KEY, "score", "risk_band", turn.cast("long").alias("_turn"))
    latest = F.max_by(F.struct("score", "risk_band"), F.col("_turn")).alias("_latest")
    merged = old.unionByName(new).groupBy(*SCORE_KEY).agg(latest, F.count_if(F.col("_turn") >= 0).alias("_n"))
    if "seq" not in updates.columns:
        repeated = F.raise_error(F.lit("updates repeat a key and have no seq"))
        merged = merged.withColumn("_latest", F.when(F.col("_n") > 1, repeated).otherwise(F.col("_latest")))
    return merged.select(*SCORE_KEY, "_latest.*")


def write_scores(spark: SparkSession, root: str, updates: DataFrame, date: str) -> None:
    """Upsert one day's scores into Parquet at ``root``, which is made when absent.

    Only that day's folder is read and rewritten.
    """
    new = updates.where(F.col("calc_date") == F.lit(date))
    if path_exists(spark, root):
        stored = read_with_text_partitions(spark, root).where(F.col("calc_date") == F.lit(date))
    else:
        stored = new.limit(0)
    merged = upsert_scores(stored, new)
    (
        merged.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("calc_date")
        .parquet(root)
    )
