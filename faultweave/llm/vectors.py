"""Near-duplicate vectors by randomly rotated binary codes with correction factors.

Each vector is turned by seeded random rotations and reduced to the signs of its
coordinates. The signs of the first rotation are its code; stored with it is the factor by
which the code's inner products fall short (Gao and Long, "RaBitQ"). For two vectors that
meet, code and factor of one and the coordinates of the other give an unbiased estimate of
their cosine and a confidence bound; only pairs whose bounds, from both sides, reach the
threshold are computed anew in double precision. No link rests on an estimate.

Vectors of a label meet in the buckets of several tables, keyed by runs of sign bits. The
number of tables follows from the chance of a common key at the threshold, so that a pair
there is missed with at most ``MISS``. Large buckets are cut into chunks, and tasks compare
pairs of chunks: nothing is capped. Pairs are never rows; tasks return counts of links, a
pair counting in its first common table only, and a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultweave.llm.common import components, grouped, smallest_reachable
from faultweave.session import materialise

COSINE = 0.93
#: Chance to miss a pair at the threshold, width of the confidence bound, rows of a chunk.
MISS = 0.001
WIDTH = 5.0
CHUNK = 1024
#: Vectors of the largest label for each bucket of a table.
PER_BUCKET = 16
SEED = 20
PAIRS_AT_A_TIME = 1 << 16


def rotation(dim: int, number: int) -> np.ndarray:
    """A random orthogonal matrix; equal arguments give equal matrices."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim, number]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def tables_for(largest: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """(bits of a key, tables) for a label of ``largest`` vectors."""
    bits = min(24, max(4, math.ceil(math.log2(max(2, largest) / PER_BUCKET))))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-same))


def _unit(lists: pa.Array, dim: int) -> np.ndarray:
    x = lists.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _codes(batches: Iterable[pa.RecordBatch], bits: int, tables: int) -> Iterator[pa.RecordBatch]:
    turns: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            part = batch.filter(pa.array(dims == dim))
            x = _unit(part.column("embedding"), dim)
            signs, code, factor = [], None, None
            for number in range(-(-bits * tables // dim)):
                if (dim, number) not in turns:
                    turns[dim, number] = rotation(dim, number)
                y = x @ turns[dim, number].T
                signs.append(y > 0)
                if not number:
                    code = np.packbits(y > 0, axis=1)
                    factor = np.abs(y).sum(axis=1) / math.sqrt(dim)
            run = np.concatenate(signs, axis=1)[:, : bits * tables].reshape(-1, tables, bits)
            keys = (run * (1 << np.arange(bits))).sum(axis=2).astype("<i4")
            added = {
                "code": pa.array([c.tobytes() for c in code], pa.binary()),
                "factor": pa.array(factor),
                "keys": pa.array(list(keys), pa.list_(pa.int32())),
            }
            yield pa.RecordBatch.from_arrays([*part.columns, *added.values()], [*part.schema.names, *added])


def _near(x: np.ndarray, y: np.ndarray, code: np.ndarray, factor: np.ndarray, cosine: float) -> np.ndarray:
    """The matrix of pairs whose upper bounds from both sides reach the threshold."""
    dim = x.shape[1]
    estimate = (code @ y.T) / math.sqrt(dim) / factor[:, None]
    bound = WIDTH * np.sqrt(np.maximum(0, 1 - factor**2) / factor**2 / max(1, dim - 1))
    upper = estimate + bound[:, None] >= cosine - 1e-9
    return upper & upper.T


def _compare(batches: Iterable[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    names = ["label_key", "dim", "table_no", "bucket", "low", "high"]
    turns: dict[int, np.ndarray] = {}
    for (_, dim, number, _, low, high), group in grouped(batches, names):
        m = group.num_rows
        if m < 2:
            continue
        group = group.combine_chunks()
        if dim not in turns:
            turns[dim] = rotation(dim, 0)
        x = _unit(group.column("embedding").chunk(0), dim)
        bits = np.frombuffer(b"".join(group.column("code").to_pylist()), "u1").reshape(m, -1)
        code = np.unpackbits(bits, axis=1)[:, :dim] * 2.0 - 1
        near = _near(x, x @ turns[dim].T, code, group.column("factor").to_numpy(), cosine)
        near &= np.triu(np.ones((m, m), bool), 1)
        labels = group.column("label").to_numpy(zero_copy_only=False)
        near &= labels[:, None] == labels[None, :]  # two labels may share a key
        if low != high:
            chunk = group.column("chunk").to_numpy()
            near &= chunk[:, None] != chunk[None, :]
        a, b = np.nonzero(near)
        cos = [
            np.einsum("ij,ij->i", x[a[s : s + PAIRS_AT_A_TIME]], x[b[s : s + PAIRS_AT_A_TIME]])
            for s in range(0, len(a), PAIRS_AT_A_TIME)
        ]
        linked = np.concatenate(cos) >= cosine if cos else np.zeros(0, bool)
        a, b = a[linked], b[linked]
        if not len(a):
            continue
        root = smallest_reachable(m, a, b)
        keys = group.column("keys").chunk(0).flatten().to_numpy().reshape(m, -1)
        new = np.concatenate(
            [
                ~(keys[a[s : s + PAIRS_AT_A_TIME], :number] == keys[b[s : s + PAIRS_AT_A_TIME], :number]).any(axis=1)
                for s in range(0, len(a), PAIRS_AT_A_TIME)
            ]
        )
        copies = group.column("copies").to_numpy()
        links = np.bincount(a[new], copies[b[new]], m) + np.bincount(b[new], copies[a[new]], m)
        told = np.unique(np.concatenate([a, b]))
        cls = group.column("cls")
        yield pa.RecordBatch.from_arrays(
            [
                cls.take(pa.array(told)).combine_chunks(),
                cls.take(pa.array(root[told])).combine_chunks(),
                pa.array(links[told].astype("i8")),
            ],
            ["a", "b", "links"],
        )


def _valid(embedding: Column) -> Column:
    finite = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(embedding, lambda v: v != 0), F.lit(False))


def near_duplicate_vectors(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = COSINE,
) -> DataFrame:
    """(id, ``n_links``, ``component_id``, ``kept``) of every row.

    Rows link if their labels are equal, their vectors equally long and their cosine is at
    least ``cosine``. Rows without a label, and vectors that are null, empty, zero or hold
    null or non-finite components, link with nothing and are their own component. Equal
    vectors of a label travel as one with a count. Repeated rows count as different vectors.
    Null ids never name a component, unless all its ids are null; such rows are not kept.
    """
    ok = F.col(label_col).isNotNull() & _valid(F.col(vector_col))
    key = F.md5(F.concat_ws("|", F.col(label_col).cast("string"), F.col(vector_col).cast("string")))
    chosen = rows.select(
        F.col(id_col).alias("id"),
        F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).alias("embedding"),
        F.when(ok, key).alias("cls"),
    )
    members = chosen.where("cls IS NOT NULL")
    classes = members.groupBy("cls").agg(
        F.first("label").alias("label"),
        F.first("embedding").alias("embedding"),
        F.count(F.lit(1)).alias("copies"),
        F.min("id").alias("least"),
    )
    classes = classes.withColumn("dim", F.size("embedding")).withColumn("label_key", F.xxhash64("label"))
    classes = materialise(classes, "classes")
    largest = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    bits, n_tables = tables_for(largest, cosine)
    schema = classes.drop("least").schema
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    coded = classes.drop("least").mapInArrow(
        lambda b: _codes(b, bits, n_tables), f"{fields}, code binary, factor double, keys array<int>"
    )
    coded = materialise(coded, "codes")
    bucket = ["label_key", "dim", "table_no", "bucket"]
    sizes = coded.select("label_key", "dim", F.posexplode("keys").alias("table_no", "bucket")).groupBy(*bucket).count()
    large = sizes.where(F.col("count") > CHUNK).select(*bucket, F.ceil(F.col("count") / CHUNK).cast("int").alias("parts"))
    large = materialise(large, "buckets")
    spread = coded.select("*", F.posexplode("keys").alias("table_no", "bucket"))
    spread = spread.join(large, bucket, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    chunk = F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")
    spread = spread.withColumn("chunk", chunk).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    )
    spread = spread.withColumn("low", F.least("chunk", "other")).withColumn("high", F.greatest("chunk", "other"))
    order = [*bucket, "low", "high"]
    found = (
        spread.drop("parts", "other")
        .repartition(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(lambda b: _compare(b, cosine), "a string, b string, links long")
    )
    found = materialise(found, "found")
    counts = found.groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    roots = components(found.select("a", "b"))
    named = (
        classes.select("cls", "copies", "least")
        .join(counts, "cls", "left")
        .join(roots, F.col("cls") == roots["node"], "left")
        .select(
            "cls",
            "least",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("root", "cls").alias("root"),
        )
    )
    named = materialise(named, "named")
    # written, so that Spark can split the join at a root of many vectors
    least = materialise(named.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    named = named.join(least, "root").select("cls", "n_links", "component_id")
    both = chosen.select("id", "cls").join(named, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return both.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
