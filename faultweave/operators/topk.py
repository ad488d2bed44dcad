"""First-k per key without putting a hot key into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SALTS = 32


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    spread: Sequence[str],
    rank: str = "rank",
    salts: int = SALTS,
) -> DataFrame:
    """The first ``k`` rows per key, numbered from 1 in ``rank``.

    Each key is first cut to ``k`` rows per salt (the salt is a hash of the ``spread``
    columns, so a retried task gives the same rows), then to ``k`` rows overall. Spark
    turns both filters into a group limit that also runs before the shuffle, so a task
    hands on at most ``k`` rows of a key. With ``salts=1`` there is one step only: enough
    where ``k`` rows from every task still fit one task.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if salts == 1:
        numbered = df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
        return numbered.where(F.col(rank) <= k)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    per_salt = W.partitionBy(*keys, "_salt").orderBy(*order)
    per_key = W.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("_rank", F.row_number().over(per_salt))
        .where(F.col("_rank") <= k)
        .drop("_rank", "_salt")
        .withColumn(rank, F.row_number().over(per_key))
        .where(F.col(rank) <= k)
    )


def ranked_array(rank: str, *columns: str) -> Column:
    """Aggregate a bounded number of ranked rows to an array of structs in rank order."""
    return F.array_sort(F.collect_list(F.struct(rank, *columns)))


def top_k_nearest(candidates: DataFrame, k: int = 5, request: str = "request_id", digits: int = 9) -> DataFrame:
    """The ``k`` nearest rows per request; distances equal to ``digits`` places tie by id."""
    near = F.round("distance", digits)
    return top_k(candidates, [request], [near, F.col("id")], k, spread=["id"])
