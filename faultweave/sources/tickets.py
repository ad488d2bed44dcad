"""Tracker tickets from JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultweave.schemas import TICKET
from faultweave.session import materialise
from faultweave.sources.arrays import read_array

_STRICT = {"mode": "FAILFAST"}


def read_tickets(spark: SparkSession, path: str, fmt: str = "lines") -> DataFrame:
    """Tickets with ``seq``, their order. Text that is not such JSON is an error.

    ``lines`` reads one ticket per line in parallel; each must carry its own ``seq``.
    ``array`` reads files that each hold one JSON array of objects, a large one by many
    tasks, and numbers the elements from 0 by file name and place.
    """
    if fmt == "lines":
        schema = T.StructType([T.StructField("seq", T.LongType()), *TICKET.fields])
        rows = spark.read.schema(schema).options(**_STRICT).json(path)
        seq = F.when(F.col("seq").isNull(), F.raise_error(F.lit("a ticket has no seq"))).otherwise(F.col("seq"))
        return rows.withColumn("seq", seq)
    if fmt == "array":
        objects = read_array(spark, path)
        sizes = objects.groupBy("file").agg(F.count(F.lit(1)).alias("_n"))
        # one row per file
        earlier = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
        before = F.coalesce(F.sum("_n").over(earlier), F.lit(0)).cast("long")
        starts = materialise(sizes.select("file", before.alias("_before")), "array-files")
        ticket = F.from_json("text", TICKET, _STRICT).alias("t")
        placed = objects.join(starts, "file").select((F.col("_before") + F.col("element")).alias("seq"), ticket)
        return placed.select("seq", "t.*")
    raise ValueError(f"unknown ticket format {fmt!r}")
