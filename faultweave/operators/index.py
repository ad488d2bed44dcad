"""A kept index for nearest past incidents: rows by job and by script, pruned by pivots.

Every stored row lies under its job and under its script, its blocks. A block has at most
``PIVOTS`` pivots, rows picked by hash; a row belongs to its nearest pivot and there to a ring of
distances, and a ring is cut into cells of bounded rows. A question knows its distance to
the pivots, so the triangle inequality tells how near a cell's rows can be at best. The
nearest ring is searched first; of the others only those cells are compared whose rows could
still be among the first ``k``. Results equal those of a search through all rows.

Neighbouring cells of a block form groups of bounded rows. What is asked of a block is a
vector, and it travels to a group once, however many questions have it and however many of
the cells it visits, and comes back with at most ``k`` rows. A block of one group, which most
are, is searched at once; of a larger one first the group around the nearest pivot, then
those groups that have a cell within the bound found so far. Rows of the question's own job
are found in the block of that job, and are taken out of what its script gives in the end:
whatever of the script's other rows is among the first ``k`` is among the first ``k`` of all its rows.

The tables are partitioned by a hash of the block, so a batch of questions reads only the
folders of its jobs and scripts. Rows added later form a generation of their own.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultweave.functions.text import or_empty
from faultweave.functions.vectors import Embedder, single_dimension
from faultweave.operators.history import (
    CELL_BYTES,
    CELLS_PER_TASK,
    MAX_PAIRS,
    MAX_TASKS,
    TOP_K,
    _blocks,
    _cells,
    _floating,
    _has_neither,
    _nearest,
    _usable,
    _vectors,
    distinct_queries,
    distinct_vectors,
    nearest_by_query,
    vector_key,
)
from faultweave.operators.topk import top_k
from faultweave.schemas import STORE_ATTRIBUTES
from faultweave.session import materialise, path_exists

PIVOTS = 32
#: Folders of each table; a store of many terabytes wants more, so that a folder stays worth a few tasks.
BUCKETS = 32
CELL_ROWS = 8192
#: Cells' worth of rows in a group, which a task holds at a time.
GROUP_CELLS = 16
#: Comparisons of a group and a part of its questions at most, if no cell were skipped.
GROUP_PAIRS = 1 << 34
#: Rings per cell that a pivot's rows fill; rows crowd at some distances, and crowded rings are cut again.
RINGS_PER_CELL = 4
#: Groups that a question is sent to at first, at most: one of its job and one of its script, in each generation.
PROBES = 2
#: What rounding can take from a difference of distances, in parts of the distances.
SLACK = 1e-9

_GROUP = ["block", "hist_cell"]
_HITS = "query_id string, block string, ids array<string>, jobs array<string>, distances array<double>"
_FOUND = pa.schema(
    [
        ("query_id", pa.string()),
        ("block", pa.string()),
        ("ids", pa.list_(pa.string())),
        ("jobs", pa.list_(pa.string())),
        ("distances", pa.list_(pa.float64())),
    ]
)


def _bucket(block: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(block), F.lit(buckets)).cast("int")


def _finite(vector: Column, dim: int) -> Column:
    """Whether a vector has ``dim`` values, all of them finite."""
    low, high = F.array_min(vector), F.array_max(vector)
    return (F.size(F.array_compact(vector)) == dim) & (high < float("inf")) & (low > -float("inf"))


def _distances(rows: pa.Table, pivots: pa.Table, dim: int) -> np.ndarray:
    points, centers = _vectors(rows, dim), _vectors(pivots, dim)
    away = np.empty((len(points), len(centers)))
    with np.errstate(over="ignore"):
        for p, center in enumerate(centers):
            difference = points - center
            away[:, p] = np.sqrt((difference * difference).sum(axis=1))
    return away


def _per_cell(work: Callable[[pa.Table, pa.Table], pa.Table], empty: pa.Schema) -> Callable:
    def run(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        held = _cells(pivots)
        found = [work(part, held[cell]) for cell, part in _cells(rows).items() if cell in held]
        return pa.concat_tables(found) if found else empty.empty_table()

    return run


def _meet(rows: DataFrame, pivots: DataFrame, key: str, chunk_rows: int) -> tuple[DataFrame, DataFrame]:
    """Chunks of each block's rows, and a copy of its pivots for each, both dealt to the same tasks."""
    sizes = materialise(rows.groupBy("block").agg(F.count(F.lit(1)).alias("_n")), "index-blocks")
    chunks = F.ceil(F.col("_n") / F.lit(chunk_rows)).cast("int")
    n_rows, n_chunks = sizes.agg(F.sum("_n"), F.sum(chunks)).first()
    work = max((n_rows or 0) / (8 * chunk_rows), (n_chunks or 0) / CELLS_PER_TASK)
    tasks = max(1, min(2 * math.ceil(work), n_chunks or 0, MAX_TASKS))
    task = F.pmod(F.xxhash64("block", "hist_cell"), F.lit(tasks)).cast("int")
    cut = sizes.select("block", chunks.alias("_chunks"))
    chunk = F.pmod(F.xxhash64(key), F.col("_chunks")).cast("int")
    left = rows.join(cut, "block").withColumn("hist_cell", chunk).drop("_chunks")
    right = pivots.join(cut, "block").withColumn("hist_cell", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    spread = lambda df: df.withColumn("query_cell", F.lit(0)).withColumn("task", task).repartition(tasks, "task")
    return spread(left), spread(right.drop("_chunks"))


def _cell_number(pivot: Column, ring: Column, part: Column) -> Column:
    return (pivot.cast("long") * F.lit(1 << 48) + ring.cast("long") * F.lit(1 << 16) + part).cast("long")


def write_index(
    store: DataFrame,
    path: str,
    dim: int | None = None,
    generation: int = 0,
    k: int = TOP_K,
    cell_rows: int = CELL_ROWS,
    pivots: int = PIVOTS,
    buckets: int = BUCKETS,
) -> None:
    """Write the index of the store's rows as a generation at ``path``; a repeated run overwrites it.

    The index answers searches for up to ``k`` rows: of rows with the same job, script and
    vector the ``k`` with the smallest ids are kept. Vectors without ``dim`` finite values
    are never found and left out. All generations must be written with the same ``buckets``.
    """
    dim = dim or single_dimension(store)
    if not dim:
        return
    attributes = [c for c in ("document", *STORE_ATTRIBUTES) if c in store.columns and c not in ("job_name", "script_name")]
    plain = store.select("id", "job_name", "script_name", _floating(store, "embedding").alias("embedding"))
    chosen = distinct_vectors(plain.where(_finite(F.col("embedding"), dim)), k)
    rows = materialise(_blocks(chosen, F.lit(False)), "index-rows")
    sizes = rows.groupBy("block").agg(F.count(F.lit(1)).alias("_n"))
    wanted = F.least(F.lit(pivots), F.ceil(F.col("_n") / F.lit(cell_rows)))
    picked = top_k(rows.select("block", "id", "embedding"), ["block"], [F.xxhash64("id"), F.col("id")], pivots, spread=["id"])
    picked = picked.join(sizes, "block").where(F.col("rank") <= wanted)
    picked = picked.select("block", (F.col("rank") - 1).cast("int").alias("pivot"), "embedding")
    picked = materialise(picked, "index-pivots")

    names = rows.columns

    def nearest(part: pa.Table, centers: pa.Table) -> pa.Table:
        away = _distances(part, centers, dim)
        best = np.nan_to_num(away, nan=np.inf).argmin(axis=1)
        numbers = centers.column("pivot").to_numpy()
        kept = part.select(names)
        kept = kept.append_column("pivot", pa.array(numbers[best], pa.int32()))
        return kept.append_column("away", pa.array(away[np.arange(len(best)), best], pa.float64()))

    left, right = _meet(rows, picked, "id", cell_rows)
    away = [T.StructField("pivot", T.IntegerType()), T.StructField("away", T.DoubleType())]
    schema = T.StructType([*rows.schema.fields, *away])
    kinds = {"block": pa.string(), "id": pa.string(), "job_name": pa.string(), "script_name": pa.string()}
    vector = pa.list_(pa.float32() if "float" in dict(rows.dtypes)["embedding"] else pa.float64())
    empty = pa.schema([(c, kinds.get(c, vector)) for c in names] + [("pivot", pa.int32()), ("away", pa.float64())])
    assigned = left.groupBy("task").cogroup(right.groupBy("task")).applyInArrow(_per_cell(nearest, empty), schema)
    assigned = materialise(assigned, "index-assigned")

    by_pivot = assigned.groupBy("block", "pivot").agg(
        F.min("away").alias("_low"), F.max("away").alias("_high"), F.count(F.lit(1)).alias("_rows")
    )
    rings = F.ceil(F.lit(RINGS_PER_CELL) * F.col("_rows") / F.lit(cell_rows))
    share = F.try_divide(F.col("away") - F.col("_low"), F.col("_high") - F.col("_low"))
    ring = F.least(rings - 1, F.floor(F.coalesce(F.nanvl(share, F.lit(0.0)), F.lit(0.0)) * rings)).cast("long")
    ringed = assigned.join(by_pivot, ["block", "pivot"]).withColumn("ring", ring).drop("_low", "_high", "_rows")
    parts = ringed.groupBy("block", "pivot", "ring").agg(F.ceil(F.count(F.lit(1)) / F.lit(cell_rows)).alias("_parts"))
    part = F.pmod(F.xxhash64("id"), F.col("_parts"))
    placed = (
        ringed.join(parts, ["block", "pivot", "ring"])
        .withColumn("cell", _cell_number(F.col("pivot"), F.col("ring"), part))
        .drop("ring", "_parts")
        .join(store.select("id", *attributes), "id")
        .withColumn("bucket", _bucket(F.col("block"), buckets))
    )

    def write(df: DataFrame, name: str, *order: str) -> None:
        dealt = df.repartitionByRange("bucket", *order).sortWithinPartitions("bucket", *order)
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}/generation={generation}")

    write(placed, "rows", "block", "cell")
    written = store.sparkSession.read.parquet(f"{path}/rows/generation={generation}")
    cells = written.groupBy("bucket", "block", "pivot", "cell").agg(
        F.min("away").alias("low"), F.max("away").alias("high"), F.count(F.lit(1)).alias("n")
    )
    write(cells, "cells", "block", "pivot")
    write(picked.withColumn("bucket", _bucket(F.col("block"), buckets)), "pivots", "block", "pivot")


def add_to_index(store: DataFrame, path: str, generation: int, buckets: int = BUCKETS, **options) -> None:
    """Index the stored rows whose id no other generation has, as a generation of their own."""
    if path_exists(store.sparkSession, f"{path}/rows"):
        known = store.sparkSession.read.parquet(f"{path}/rows").where(F.col("generation") != generation)
        store = store.join(known.select("id").distinct(), "id", "left_anti")
    write_index(store, path, generation=generation, buckets=buckets, **options)


def _read(spark: SparkSession, path: str, name: str, asked: list[int]) -> DataFrame:
    """A table of the index from the folders of these buckets, its blocks told apart by generation."""
    rows = spark.read.parquet(f"{path}/{name}").where(F.col("bucket").isin(asked)).withColumn("bare", F.col("block"))
    return rows.withColumn("block", F.concat("block", F.lit("#"), F.col("generation").cast("string")))


def asked_buckets(asked: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The buckets that hold the jobs and scripts of these questions: at most ``buckets`` numbers."""
    blocks = _blocks(asked.select("job_name", "script_name"), F.lit(False))
    return sorted(r[0] for r in blocks.select(_bucket(F.col("block"), buckets)).distinct().collect())


def _gaps(away: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How near each cell's rows can be at best, given the distances to the cell's pivot."""
    with np.errstate(invalid="ignore", over="ignore"):
        gap = np.maximum(np.maximum(away - high, low - away), 0.0) - SLACK * (away + high)
    return np.where(np.isnan(gap), 0.0, np.maximum(gap, 0.0))


def _group_search(k: int, dim: int, digits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Function for one group: the nearest rows of each question, at most ``k``.

    ``held`` has the group's rows and, without an id, the pivots of its block. Questions
    around the same pivot are compared together, cell by cell with the nearest first, and
    only with those cells that the bound, which may come with a question as ``limit``, does
    not rule out.
    """

    def search(queries: pa.Table, held: pa.Table) -> pa.Table:
        # Places follow id order, so they break ties the way ids do.
        stored = held.filter(held.column("id").is_valid()).sort_by("id")
        centers = held.filter(held.column("id").is_null())
        (queries, asked), (stored, points) = _usable(queries, dim), _usable(stored, dim)
        if queries.num_rows == 0 or stored.num_rows == 0:
            return _FOUND.empty_table()
        places = np.argsort(stored.column("cell").to_numpy(), kind="stable")
        stored, points = stored.take(pa.array(places)), points[places]
        away = np.nan_to_num(_distances(queries.append_column("embedding", _lists(asked)), centers, dim), nan=np.inf)
        around = np.argsort(away.argmin(axis=1), kind="stable")
        queries, asked, away = queries.take(pa.array(around)), asked[around], away[around]

        cell_of, from_pivot = stored.column("cell").to_numpy(), stored.column("away").to_numpy()
        starts = np.flatnonzero(np.append(True, cell_of[1:] != cell_of[:-1]))
        low, high = np.minimum.reduceat(from_pivot, starts), np.maximum.reduceat(from_pivot, starts)
        column = {int(n): i for i, n in enumerate(centers.column("pivot").to_numpy())}
        pivot = np.array([column[int(n)] for n in stored.column("pivot").to_numpy()[starts]])
        bound = np.nan_to_num(queries.column("limit").to_numpy().astype(np.float64), nan=np.inf)
        rows, cols, exact = _nearest(
            asked,
            points,
            k,
            digits,
            known=bound,
            chunks=list(zip(starts.tolist(), [*starts[1:].tolist(), len(points)])),
            gaps=lambda tile: _gaps(away[tile][:, pivot], low, high),
            places=places,
        )
        order = np.argsort(rows, kind="stable")
        rows, cols, exact = rows[order], cols[order], exact[order]
        hit, first = np.unique(rows, return_index=True)
        ends, found = pa.array(np.append(first, len(rows)), pa.int32()), pa.array(cols)
        lists = lambda values: pa.ListArray.from_arrays(ends, values)
        asking = queries.take(pa.array(hit))
        return pa.table(
            {
                "query_id": asking.column("query_id"),
                "block": asking.column("block"),
                "ids": lists(stored.column("id").combine_chunks().take(found)),
                "jobs": lists(stored.column("job_name").combine_chunks().take(found)),
                "distances": lists(pa.array(exact, pa.float64())),
            }
        )

    return search


def _lists(vectors: np.ndarray) -> pa.ListArray:
    ends = np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(vectors.reshape(-1)))


def _compare(
    pairs: DataFrame,
    vectors: DataFrame,
    cells: DataFrame,
    rows: DataFrame,
    pivots: DataFrame,
    dim: int,
    k: int,
    digits: int,
    cell_rows: int,
) -> DataFrame:
    """(query_id, block, ids, jobs, distances): the nearest rows per question and group that it visits, at most ``k``.

    ``pairs`` has query_id, block, hist_cell (the group) and limit, ``vectors`` the embedding of a query_id.
    """
    spark = pairs.sparkSession
    queries_per_part = max(1, CELL_BYTES // (8 * dim))
    visits = pairs.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("_asked"))
    visits = visits.join(cells.groupBy(*_GROUP).agg(F.sum("n").alias("_n")), _GROUP)
    work = F.col("_asked").cast("double") * F.col("_n")
    parts = F.ceil(F.greatest(F.col("_asked") / F.lit(queries_per_part), work / F.lit(float(GROUP_PAIRS)))).cast("int")
    visits = materialise(visits.withColumn("_parts", parts), "index-visits")
    all_work = visits.agg(F.sum(work)).first()[0] or 0
    # enough parts to keep every core busy, but none that is not worth a task
    per_part = max(all_work / (4 * spark.sparkContext.defaultParallelism), 1 << 24)
    busy = F.least(F.ceil(work / F.lit(float(per_part))), F.col("_asked")).cast("int")
    visits = visits.withColumn("_parts", F.greatest("_parts", busy))
    copies, n_cells = visits.agg(F.sum(F.col("_n") * F.col("_parts") + F.col("_asked")), F.sum(F.col("_parts"))).first()
    per_task = min(per_part, MAX_PAIRS)
    tasks = max(all_work / per_task, (copies or 0) / (16 * cell_rows), (n_cells or 0) / CELLS_PER_TASK)
    tasks = max(1, min(2 * math.ceil(tasks), n_cells or 0, MAX_TASKS))
    task = F.pmod(F.xxhash64(*_GROUP, "query_cell"), F.lit(tasks)).cast("int")
    dealt = visits.select(*_GROUP, "_parts")
    every_part = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    left = (
        pairs.join(dealt, _GROUP)
        .withColumn("query_cell", F.pmod(F.xxhash64("query_id"), F.col("_parts")).cast("int"))
        .join(vectors, "query_id")
        .select("query_id", *_GROUP, "query_cell", "embedding", "limit", task.alias("task"))
    )
    held = ["id", "job_name", "embedding", "pivot", "cell", "away"]
    grouped = rows.join(cells.select("block", "cell", "hist_cell"), ["block", "cell"]).select(*_GROUP, *held)
    centers = pivots.join(dealt.select(*_GROUP), "block").select(
        *_GROUP,
        F.lit(None).cast("string").alias("id"),
        F.lit(None).cast("string").alias("job_name"),
        "embedding",
        "pivot",
        F.lit(-1).cast("long").alias("cell"),
        F.lit(0.0).alias("away"),
    )
    right = grouped.unionByName(centers).join(dealt, _GROUP).withColumn("query_cell", every_part)
    right = right.select(*_GROUP, "query_cell", *held, task.alias("task"))
    left, right = (df.repartition(tasks, "task").groupBy("task") for df in (left, right))
    search = _per_cell(_group_search(k, dim, digits), _FOUND)
    hits = left.cogroup(right).applyInArrow(search, _HITS)
    return materialise(hits, "index-hits")


def _hit_rows(digits: int) -> Column:
    """The hits of a row of ids, jobs and distances, as (near, id, distance, job)."""
    return F.transform(
        F.arrays_zip("ids", "distances", "jobs"),
        lambda h: F.struct(
            F.round(h["distances"], digits).alias("near"), h["ids"].alias("id"), h["distances"].alias("distance"), h["jobs"].alias("job")
        ),
    )


def _first(hits: DataFrame, k: int, *keys: str) -> DataFrame:
    """The keys and the nearest ``k`` of their ``hits``, which may come in several rows."""
    gathered = hits.groupBy(*keys).agg(F.flatten(F.collect_list("hits")).alias("hits"))
    return gathered.select(*keys, F.slice(F.array_sort("hits"), 1, k).alias("hits"))


def _bare(block: Column) -> Column:
    return F.regexp_replace(block, "#[0-9]+$", "")


def _gap(away: Column, cell: Column) -> Column:
    """How near the cell's rows can be at best, given the distance to their pivot."""
    gap = F.greatest(F.lit(0.0), away - cell["high"], cell["low"] - away)
    gap = gap - F.lit(SLACK) * (away + cell["high"])
    return F.when(F.isnan(gap), 0.0).otherwise(F.greatest(F.lit(0.0), gap))


def _grouped_cells(spark: SparkSession, path: str, numbers: list[int], own: DataFrame, rows_per_group: int) -> DataFrame:
    """The cells of these blocks and the group of each: neighbours, up to about so many rows."""
    cells = _read(spark, path, "cells", numbers).join(own.withColumnRenamed("block", "bare"), "bare", "left_semi")
    before = W.partitionBy("block").orderBy("pivot", "cell").rowsBetween(W.unboundedPreceding, -1)
    group = F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / F.lit(rows_per_group)).cast("int")
    chosen = cells.select("bare", "block", "pivot", "cell", "low", "high", "n", group.alias("hist_cell"))
    return materialise(chosen, "asked-cells")


def plan_visits(
    asked: DataFrame,
    path: str,
    dim: int,
    k: int,
    digits: int,
    buckets: int,
    cell_rows: int = CELL_ROWS,
    vectors: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The (query_id, block, hist_cell, n) compared first, those compared after them, and all hits.

    What is asked of a block is a vector, so ``query_id`` is a vector's here. ``vectors`` has
    the vectors of ``asked``, each once, if it has only their identity, ``_vector``. ``n`` is
    the number of rows that are compared at most; the groups that come after the first are
    only those with a cell in reach, and of these only such cells count.
    """
    spark = asked.sparkSession
    numbers = asked_buckets(asked, buckets)
    if vectors is None:
        asked = asked.withColumn("_vector", vector_key(F.col("embedding")))
        vectors = materialise(_distinct_vectors(asked), "question-vectors")
    vectors = vectors.where(_finite(F.col("embedding"), dim)).withColumnRenamed("_vector", "query_id")
    places = _blocks(asked.select("job_name", "script_name", F.col("_vector").alias("query_id")), F.lit(False))
    places = materialise(places.select("block", "query_id").distinct(), "asked-places")
    own = places.select("block").distinct()
    rows_per_group = max(1, min(GROUP_CELLS * cell_rows, CELL_BYTES // (8 * dim)))
    cells = _grouped_cells(spark, path, numbers, own, rows_per_group)
    pivots = _read(spark, path, "pivots", numbers).join(own.withColumnRenamed("block", "bare"), "bare", "left_semi")
    pivots = materialise(pivots.select("block", "pivot", "embedding"), "asked-pivots")
    rows = _read(spark, path, "rows", numbers).select("block", "cell", "id", "job_name", "embedding", "pivot", "away")
    # a question meets the groups of each generation of its blocks
    generations = cells.groupBy("bare", F.col("block").alias("_place")).agg(F.max("hist_cell").alias("_last"))
    generations = materialise(generations, "asked-blocks")
    placed = places.withColumnRenamed("block", "bare").join(generations, "bare")
    placed = placed.select("query_id", F.col("_place").alias("block"), "_last")
    limit = F.lit(None).cast("double")
    sizes = cells.groupBy(*_GROUP).agg(F.sum("n").alias("n"))
    first = placed.where("_last = 0").select("query_id", "block", F.lit(0).alias("hist_cell"))
    if not generations.where("_last > 0").limit(1).count():
        hits = _compare(first.withColumn("limit", limit), vectors, cells, rows, pivots, dim, k, digits, cell_rows)
        probes = first.join(sizes, _GROUP)
        return probes, probes.limit(0), hits

    large = placed.where("_last > 0").select("query_id", "block").join(vectors, "query_id")
    names = large.columns

    def distances(part: pa.Table, centers: pa.Table) -> pa.Table:
        away = _distances(part, centers.sort_by("pivot"), dim)
        return part.select(names).append_column("away", _lists(away))

    element = pa.float32() if "float" in dict(large.dtypes)["embedding"] else pa.float64()
    kinds = [("query_id", pa.string()), ("block", pa.string()), ("embedding", pa.list_(element))]
    kinds += [("away", pa.list_(pa.float64()))]
    schema = T.StructType([*large.schema.fields, T.StructField("away", T.ArrayType(T.DoubleType()))])
    left, right = _meet(large, pivots.join(large.select("block").distinct(), "block", "left_semi"), "query_id", cell_rows)
    away = left.groupBy("task").cogroup(right.groupBy("task")).applyInArrow(_per_cell(distances, pa.schema(kinds)), schema)
    away = away.withColumn("pivot", F.array_position("away", F.array_min("away")).cast("int") - 1)
    by_pivot = cells.groupBy("block", "pivot").agg(F.collect_list(F.struct("hist_cell", "cell", "low", "high")).alias("_own"))
    nearest = F.array_min(
        F.transform("_own", lambda c: F.struct(_gap(F.array_min("away"), c).alias("gap"), c["cell"], c["hist_cell"].alias("hist_cell")))
    )
    home = F.coalesce(nearest["hist_cell"], F.lit(0)).alias("hist_cell")
    away = away.join(by_pivot, ["block", "pivot"], "left").select("query_id", "block", home, "away")
    away = materialise(away, "pivot-distances")
    first = first.unionByName(away.drop("away"))
    probes = first.join(sizes, _GROUP)
    hits = _compare(first.withColumn("limit", limit), vectors, cells, rows, pivots, dim, k, digits, cell_rows)
    # the bound of a block holds for the rows of all its generations
    bare = _bare(F.col("block")).alias("bare")
    found = hits.join(away.select("block").distinct(), "block", "left_semi").select("query_id", bare, _hit_rows(digits).alias("hits"))
    found = _first(found, k, "query_id", "bare").where(F.size("hits") == k)
    found = found.select("query_id", "bare", F.array_max(F.col("hits.distance")).alias("limit"))
    found = materialise(found, "index-limits")
    by_group = cells.groupBy(*_GROUP).agg(F.collect_list(F.struct("pivot", "low", "high", "n")).alias("_cells"))
    reach = F.coalesce(F.sqrt(F.col("limit") + F.lit(2 * 10.0**-digits)), F.lit(float("inf")))
    near = F.filter("_cells", lambda c: _gap(F.get("away", c["pivot"]), c) <= F.col("_reach"))
    rest = (
        away.withColumn("bare", bare)
        .join(found, ["query_id", "bare"], "left")
        .withColumnRenamed("hist_cell", "_home")
        .withColumn("_reach", reach)
        .join(by_group, "block")
        .where("hist_cell <> _home")
        .withColumn("n", F.aggregate(near, F.lit(0).cast("long"), lambda n, c: n + c["n"]))
        .where("n > 0")
    )
    rest = materialise(rest.select("query_id", *_GROUP, "limit", "n"), "index-rest")
    more = _compare(rest.drop("n"), vectors, cells, rows, pivots, dim, k, digits, cell_rows)
    return probes, rest.select("query_id", *_GROUP, "n"), hits.unionByName(more)


def _distinct_vectors(asked: DataFrame) -> DataFrame:
    return asked.select("_vector", "embedding").dropDuplicates(["_vector"])


def _nearest_hits(
    inc: DataFrame,
    path: str,
    store: DataFrame | None = None,
    k: int = TOP_K,
    embed: Embedder | None = None,
    vector: str = "embedding",
    digits: int = 9,
    buckets: int = BUCKETS,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """(query_id, hits): the nearest ``k`` of each question as (near, id, distance, job), in their order."""
    spark = inc.sparkSession
    if embed:
        asked = materialise(distinct_queries(inc, embed, vector), "questions")
        asked = asked.withColumn("_vector", vector_key(F.col("embedding")))
        vectors = _distinct_vectors(asked)
    else:
        # questions have but the identity of their vector, which many of them may share
        given = inc.withColumn("embedding", _floating(inc, vector)).withColumn("_vector", vector_key(F.col("embedding")))
        names = [or_empty(F.col(c)).alias(c) for c in ("job_name", "script_name")]
        asked = materialise(given.select("query_id", *names, "_vector").distinct(), "questions")
        vectors = _distinct_vectors(given)
    vectors = materialise(vectors, "question-vectors")
    width = spark.read.parquet(f"{path}/pivots").select(F.size("embedding")).head()
    if width is None:
        return spark.createDataFrame([], "query_id string, hits array<struct<near: double, id: string, distance: double, job: string>>")
    *_, hits = plan_visits(asked, path, width[0], k, digits, buckets, cell_rows, vectors)
    hits = hits.select(F.col("query_id").alias("_vector"), _bare(F.col("block")).alias("block"), _hit_rows(digits).alias("hits"))
    places = _blocks(asked.select("query_id", "job_name", "script_name", "_vector"), F.lit(False))
    # rows of the question's own job are found in the block of that job
    other = F.filter("hits", lambda h: ~h["job"].eqNullSafe(F.col("job_name")))
    by_script = F.col("block").startswith("script:") & (or_empty(F.col("job_name")) != "")
    hits = places.join(hits, ["block", "_vector"]).select("query_id", F.when(by_script, other).otherwise(F.col("hits")).alias("hits"))
    found = _first(hits, k, "query_id")
    if store is not None and asked.where(_has_neither()).limit(1).count():
        rest = nearest_by_query(inc.where(_has_neither()), store, k, embed, vector, width[0], digits)
        near = F.struct(F.round("distance", digits).alias("near"), "id", "distance", F.lit(None).cast("string").alias("job"))
        found = found.unionByName(rest.groupBy("query_id").agg(F.array_sort(F.collect_list(near)).alias("hits")))
    return found


def _ranked(hits: DataFrame, *keys: str) -> DataFrame:
    rows = hits.select(*keys, F.posexplode("hits").alias("_place", "hit"))
    return rows.select(*keys, "hit.id", "hit.distance", (F.col("_place") + 1).cast("int").alias("rank"))


def indexed_nearest(inc: DataFrame, path: str, store: DataFrame | None = None, k: int = TOP_K, embed: Embedder | None = None, **options) -> DataFrame:
    """As :func:`history.nearest_by_query`, from the index at ``path``: query_id, id, distance, rank.

    Questions without job and script, which concern all rows, are compared with ``store``.
    """
    return _ranked(_nearest_hits(inc, path, store, k, embed, **options), "query_id")


def indexed_search(inc: DataFrame, path: str, store: DataFrame | None = None, **options) -> DataFrame:
    """As :func:`history.history_search`, from the index at ``path``; ``inc`` has a query_id."""
    # hits travel to the incidents as one value per question
    hits = inc.select("request_id", "query_id").join(_nearest_hits(inc, path, store, **options), "query_id")
    return _ranked(hits, "request_id").withColumn("similarity_score", F.lit(1.0) - F.col("distance"))


def indexed_rows(hits: DataFrame, asked: DataFrame, path: str, buckets: int = BUCKETS) -> DataFrame:
    """The store rows of these hits with their attributes, from the folders of the questions' blocks."""
    rows = _read(hits.sparkSession, path, "rows", asked_buckets(asked, buckets))
    found = rows.drop("block", "bare", "cell", "pivot", "away", "bucket", "generation", "embedding")
    return found.join(hits.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
