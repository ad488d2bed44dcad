"""Finding skewed keys, and totals and joins that do not suffer from them."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultweave.session import materialise

SALTS = 10


def key_counts(df: DataFrame, key: str) -> DataFrame:
    """Rows per key and the key's share of all rows.

    The total is a scalar subquery over the counts, so the keys stay spread over the cluster
    and the rows are read once.
    """
    counts = materialise(df.groupBy(key).agg(F.count("*").alias("n")), "key-counts")
    return counts.withColumn("share", F.col("n").cast("double") / counts.agg(F.sum("n")).scalar())


def largest_share(df: DataFrame, key: str) -> DataFrame:
    """One row: keys, rows, and the share of the largest key."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return counts.agg(
        F.count("*").alias("keys"),
        F.sum("n").alias("rows"),
        (F.max("n").cast("double") / F.sum("n")).alias("max_share"),
    )


def salted_totals(
    df: DataFrame, keys: Sequence[str], value: str, row_key: Sequence[str], salts: int = SALTS
) -> DataFrame:
    """Sum and count per key in two steps, each key split over ``salts`` groups first.

    The salt is a hash of the row key, so a retried task gives the same rows.
    """
    salt: Column = F.pmod(F.xxhash64(*row_key), F.lit(salts)).alias("_salt")
    partial = df.groupBy(*keys, salt).agg(F.sum(value).alias("_sum"), F.count("*").alias("_n"))
    return partial.groupBy(*keys).agg(F.sum("_sum").alias("total"), F.sum("_n").alias("n"))


#: Counters of the sketch; a key's count is off by at most 3.5 of that many parts of the rows.
COUNTERS = 8192
#: A key of more rows than this share is heavy.
HEAVY_SHARE = 0.01
#: Salts of a heavy key for each partition that its rows would fill.
SALTS_PER_PARTITION = 16


def heavy_keys(df: DataFrame, keys: Sequence[str], share: float = HEAVY_SHARE) -> DataFrame:
    """The keys that hold at least ``share`` of the rows, with their exact ``n`` and ``share``.

    A sketch of bounded counters per task finds the candidates in one pass without a shuffle
    of keys; its error is bounded, so no heavy key is missed. Then only the candidates' rows
    are counted. The result has at most ``1 / share`` rows; null keys count as keys.
    """
    error = 3.5 / COUNTERS
    if not 2 * error < share <= 1:
        raise ValueError(f"share must be over {2 * error:.4f} and at most 1")
    most = math.ceil(1 / (share - error)) + 1
    hashed = df.select(*keys, F.xxhash64(*keys).alias("_hash"))
    sketch = hashed.agg(F.expr(f"approx_top_k(_hash, {most}, {COUNTERS})").alias("top"), F.count(F.lit(1)).alias("rows"))
    top, rows = sketch.select(F.col("top.item"), "rows").first()
    counted = hashed.where(F.col("_hash").isin(list(top or []))).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    heavy = counted.withColumn("share", F.col("n").cast("double") / F.lit(float(rows or 1)))
    return heavy.where(F.col("share") >= share)


def skewed_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    spread: Sequence[str] | None = None,
    share: float | None = None,
) -> DataFrame:
    """``left.join(right, keys, how)`` with the left rows of heavy keys dealt over many tasks.

    The heavy keys of the left side are found first. Their left rows are salted by a hash of
    the columns ``spread`` (all by default, which must tell the rows of a key apart), so a
    repeated task gives the same rows, and their right rows go to every salt. ``how`` is one
    in which only left rows decide what is returned: inner, left, left_semi or left_anti.
    A key is heavy from ``share`` of the rows, by default a quarter of an even partition.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"{how} joins cannot be salted on the left")
    partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = share or max(HEAVY_SHARE, 1 / (4 * partitions))
    salts = F.ceil(F.col("share") * F.lit(partitions * SALTS_PER_PARTITION)).cast("int")
    # at most 1 / share rows, so they may go everywhere
    heavy = materialise(heavy_keys(left, keys, share).select(*keys, salts.alias("_salts")), "heavy-keys")
    row = F.xxhash64(*(spread or left.columns))
    one = F.coalesce(F.col("_salts"), F.lit(1))
    # rows with a null key find nothing, so they may lie anywhere
    nameless = reduce(or_, [F.col(f"`{k}`").isNull() for k in keys])
    salt = F.pmod(row, F.when(nameless, F.lit(partitions * SALTS_PER_PARTITION)).otherwise(one)).cast("int")
    salted = left.join(F.broadcast(heavy), list(keys), "left").withColumn("_salt", salt).drop("_salts")
    copies = F.explode(F.sequence(F.lit(0), one - 1)).alias("_salt")
    spread_right = right.join(F.broadcast(heavy), list(keys), "left").select(*right.columns, copies)
    return salted.join(spread_right, [*keys, "_salt"], how).drop("_salt")
