"""Helpers of several operators: gapless numbers, grouped batches, connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultweave.session import materialise

#: Rows that one numbering bucket holds on average.
BUCKET_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_key(text: str | Column) -> Column:
    """A 128-bit key of a text as hex; null has a key of its own."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.md5(column.cast("binary")), F.lit("null"))


def numbered(rows: DataFrame, groups: Sequence[str], name: str, place: str | None = None) -> DataFrame:
    """Number the rows of each group from 0 without gaps.

    A group is cut by a hash of its rows into buckets of bounded size, whose counts give
    the first number of each; no window spans a group. Equal rows travel as one with a
    count. ``rows`` is read several times, so it should be a written table; ``groups`` must
    not be null. The order is a function of the rows alone; with ``place``, a column of
    numbers from 0 on, it is that of the places, whose ranges are the buckets then.
    """
    columns = rows.columns
    top = F.lit(0) if place is None else F.max(place)
    n_rows, top = rows.agg(F.count(F.lit(1)), top).first()
    n_buckets = max(64, -(-n_rows // BUCKET_ROWS))
    bucket = F.pmod(F.xxhash64(*columns), F.lit(n_buckets))
    if place is not None:
        columns = [place, *[c for c in columns if c != place]]
        bucket = F.floor(F.col(place) * n_buckets / ((top or 0) + 1))
    packed = (
        rows.groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_bucket", bucket.cast("int"))
    )
    keys = [*groups, "_bucket"]
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        packed.groupBy(*keys)
        .agg(F.sum("_n").alias("_sum"))
        .withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .drop("_sum")
    )
    inside = Window.partitionBy(*keys).orderBy(*[F.col(c) for c in columns if c not in groups])
    first = F.col("_start") + F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    return (
        packed.join(starts, keys)
        .withColumn("_first", first)
        .withColumn(name, F.explode(F.sequence("_first", F.col("_first") + F.col("_n") - 1)))
        .select(*columns, name)
    )


def grouped(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The runs of equal integer keys in sorted batches."""
    held: list[pa.RecordBatch] = []
    last: tuple = ()
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype("i8") for k in keys], axis=1)
        cuts = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
        bounds = [0, *cuts.tolist(), len(values)]
        for start, end in zip(bounds, bounds[1:]):
            key = tuple(values[start].tolist())
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = key
    if held:
        yield last, pa.Table.from_batches(held)


def smallest_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1 the smallest node that links ``a[i]`` - ``b[i]`` lead to."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b): the smallest node it can reach.

    Alternates the large-star and small-star steps of Kiveris et al., "Connected Components
    in MapReduce and Beyond", each a grouped minimum and a join; every step is a written
    table, also the minima, so that Spark can split the join at a node of many links. Ends
    when the links are stars.
    """
    high, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = materialise(links.select(high, low).where("a <> b").distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.where("a <> b").distinct(), "links")
        least = materialise(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.withColumnRenamed("m", "b"))
        edges = materialise(small.where("a <> b").distinct(), "links")
        was, state = state, _state(edges)
        if was == state:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _state(edges: DataFrame) -> tuple:
    digest = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(digest), F.bit_xor(F.xxhash64("b", "a"))).first())
