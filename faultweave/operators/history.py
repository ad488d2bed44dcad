"""Nearest past incidents of the same job or script.

An incident may match every stored row of its job, so pairs are never made as rows.
Each job (and each script) is a block; a block is cut into a grid of cells of bounded
size, a cell compares its incidents with its stored rows by one matrix product and gives
back at most ``k`` rows per incident. The number of tasks follows the work, and a task
takes many small cells at a time. Equal questions are asked only once, and of equal stored
vectors only the ``k`` with the smallest ids are compared.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultweave.functions.text import non_empty, or_empty
from faultweave.functions.vectors import Embedder, as_double, single_dimension
from faultweave.operators.topk import ranked_array, top_k
from faultweave.session import materialise

TOP_K = 5
CELL_BYTES = 64 << 20
TILE_VALUES = 4 << 20
#: Points that are multiplied at a time.
CHUNK_ROWS = 1 << 12
MIN_PAIRS, MAX_PAIRS = 1 << 24, 1 << 32
CELLS_PER_TASK = 1000
MAX_TASKS = 100_000

_CELL = ["block", "hist_cell", "query_cell"]
_HIT = "query_id string, id string, distance double"
_NO_HITS = pa.schema([("query_id", pa.string()), ("id", pa.string()), ("distance", pa.float64())]).empty_table()


def metadata_predicate(job: Column, script: Column, stored_job: Column, stored_script: Column) -> Column:
    """Same job, or same script, or both; an incident with neither matches everything."""
    by_job = non_empty(job).isNotNull() & (stored_job == job)
    by_script = non_empty(script).isNotNull() & (stored_script == script)
    neither = non_empty(job).isNull() & non_empty(script).isNull()
    return F.coalesce(by_job, F.lit(False)) | F.coalesce(by_script, F.lit(False)) | neither


def matching_store_rows(inc: DataFrame, hist: DataFrame) -> DataFrame:
    """How many stored rows each incident may be compared with, from counts per key alone."""
    by_job = hist.groupBy("job_name").agg(F.count("*").alias("_job_n"))
    by_script = hist.groupBy("script_name").agg(F.count("*").alias("_script_n"))
    by_both = hist.groupBy("job_name", "script_name").agg(F.count("*").alias("_both_n"))
    total = hist.agg(F.count("*")).scalar()
    names = [or_empty(F.col(c)).alias(c) for c in ("job_name", "script_name")]
    asked = inc.select("request_id", *names)
    job_given, script_given = F.col("job_name") != "", F.col("script_name") != ""

    def n(name: str, given: Column) -> Column:
        return F.when(given, F.coalesce(F.col(name), F.lit(0))).otherwise(0).cast("long")

    matched = n("_job_n", job_given) + n("_script_n", script_given) - n("_both_n", job_given & script_given)
    pairs = (
        asked.select("job_name", "script_name")
        .distinct()
        .join(by_job, "job_name", "left")
        .join(by_script, "script_name", "left")
        .join(by_both, ["job_name", "script_name"], "left")
        .select(
            "job_name", "script_name", F.when(job_given | script_given, matched).otherwise(total).alias("candidates")
        )
    )
    return asked.join(materialise(pairs, "pairs"), ["job_name", "script_name"]).select("request_id", "candidates")


def match_union(hist: DataFrame, jobs: DataFrame, scripts: DataFrame) -> DataFrame:
    """Stored rows whose job is in ``jobs`` or whose script is in ``scripts``, each once."""
    wanted_jobs = jobs.select("job_name").where("job_name <> ''").distinct().withColumn("_by_job", F.lit(True))
    wanted_scripts = (
        scripts.select("script_name").where("script_name <> ''").distinct().withColumn("_by_script", F.lit(True))
    )
    return (
        hist.join(wanted_jobs, "job_name", "left")
        .join(wanted_scripts, "script_name", "left")
        .where(F.col("_by_job") | F.col("_by_script"))
        .drop("_by_job", "_by_script")
    )


def with_query_id(inc: DataFrame, vector: str | None = None) -> DataFrame:
    """Add the identity of the question an incident asks: job, script and text (or vector).

    Two 64-bit hashes side by side, so that billions of questions stay apart.
    """
    question = [or_empty(F.col("job_name")), or_empty(F.col("script_name")), F.col(vector) if vector else query_text()]
    halves = [F.hex(F.xxhash64(F.lit(seed), *question)) for seed in (1, 2)]
    return inc.withColumn("query_id", F.concat_ws("-", *halves))


def query_text(description: str = "description", log: str = "tws_log") -> Column:
    return F.concat(or_empty(F.col(description)), F.lit(" "), or_empty(F.col(log)))


def vector_key(vector: Column) -> Column:
    """The identity of a vector, as two 64-bit hashes of its values."""
    return F.concat_ws("-", *[F.hex(F.xxhash64(F.lit(seed), vector)) for seed in (1, 2)])


def _floating(df: DataFrame, vector: str) -> Column:
    """The vector as it is if it holds floats, which take half the room of doubles."""
    element = df.schema[vector].dataType.elementType
    return F.col(vector) if element == T.FloatType() else as_double(F.col(vector))


def distinct_queries(inc: DataFrame, embed: Embedder | None = None, vector: str = "embedding") -> DataFrame:
    """One row per question: query_id, job_name, script_name, embedding."""
    carried = query_text().alias("_text") if embed else _floating(inc, vector).alias("embedding")
    once = inc.select(
        "query_id", "job_name", non_empty(F.col("script_name")).alias("script_name"), carried
    ).dropDuplicates(["query_id"])
    if embed:
        once = once.withColumn("embedding", embed(F.col("_text"))).drop("_text")
    return once


EVERYTHING = "everything"


def _has_neither() -> Column:
    return (or_empty(F.col("job_name")) == "") & (or_empty(F.col("script_name")) == "")


def _blocks(df: DataFrame, everything: Column) -> DataFrame:
    """Each row under its job and under its script, and where asked for under the block of all rows."""
    places = F.array(
        F.when(F.col("job_name") != "", F.concat(F.lit("job:"), "job_name")),
        F.when(F.col("script_name") != "", F.concat(F.lit("script:"), "script_name")),
        F.when(everything, F.lit(EVERYTHING)),
    )
    return df.withColumn("block", F.explode(F.array_compact(places)))


def distinct_vectors(hist: DataFrame, k: int = TOP_K) -> DataFrame:
    """Of stored rows with the same job, script and vector the ``k`` with the smallest ids.

    The others can never be among the first ``k``. Copies are cut to ``k`` per task before
    the shuffle, so a vector that very many rows share stays small.
    """
    keyed = hist.withColumn("_vector", vector_key(F.col("embedding")))
    group = ["job_name", "script_name", "_vector"]
    first = top_k(keyed, group, [F.col("id")], k, spread=["id"], rank="_copy", salts=1)
    return first.drop("_vector", "_copy")


def _grid(
    asked: DataFrame, stored: DataFrame, rows_per_cell: int, pairs_per_cell: int | None = None
) -> tuple[DataFrame, int]:
    """Cells per block, for blocks that have rows on both sides, and the number of tasks.

    A cell holds at most about ``rows_per_cell`` rows of each side, which bounds its memory,
    and ``pairs_per_cell`` comparisons. The latter follow from all comparisons: enough cells
    to keep every core busy, but no smaller than is worth a task and no longer than is fit
    to be repeated when an executor is lost.
    """
    spark = asked.sparkSession

    def rows(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("block").agg(F.count("*").alias(name))

    sizes = materialise(rows(stored, "stored").join(rows(asked, "asked"), "block"), "blocks")
    pairs = F.col("stored").cast("double") * F.col("asked")
    all_pairs = sizes.agg(F.coalesce(F.sum(pairs), F.lit(0.0))).first()[0]
    if pairs_per_cell is None:
        cores = spark.sparkContext.defaultParallelism
        pairs_per_cell = min(max(int(all_pairs / (4 * cores)), MIN_PAIRS), MAX_PAIRS)

    # Rows are copied once per cell of the other side. For a number of cells the copies are
    # fewest when both sides are cut in proportion to their rows.
    wanted = pairs / F.lit(float(pairs_per_cell))
    hist_cells = F.greatest(
        F.ceil(F.col("stored") / F.lit(rows_per_cell)),
        F.ceil(F.sqrt(wanted * F.col("stored") / F.greatest(F.col("asked"), F.lit(1)))),
        F.lit(1),
    )
    query_cells = F.greatest(
        F.ceil(F.col("asked") / F.lit(rows_per_cell)), F.ceil(wanted / F.col("hist_cells")), F.lit(1)
    )
    grid = sizes.withColumn("hist_cells", hist_cells.cast("int")).withColumn("query_cells", query_cells.cast("int"))
    copied = F.col("stored") * F.col("query_cells") + F.col("asked") * F.col("hist_cells")
    cells, rows_copied = grid.agg(F.sum(F.col("hist_cells").cast("long") * F.col("query_cells")), F.sum(copied)).first()
    # A task is worth its comparisons, the rows it holds, and the cells it goes through.
    # Twice as many tasks, since cells fall on them by hash.
    work = max(all_pairs / pairs_per_cell, (rows_copied or 0) / (2 * rows_per_cell), (cells or 0) / CELLS_PER_TASK)
    tasks = min(2 * math.ceil(work), cells or 0, MAX_TASKS)
    return grid.select("block", "hist_cells", "query_cells"), max(tasks, 1)


def _vectors(table: pa.Table, dim: int) -> np.ndarray:
    column = table.column("embedding").combine_chunks()
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def _usable(table: pa.Table, dim: int) -> tuple[pa.Table, np.ndarray]:
    """The rows whose vector has ``dim`` finite values, and the vectors in their own precision."""
    table = table.filter(pc.equal(pc.list_value_length(table.column("embedding")), dim))
    column = table.column("embedding").combine_chunks()
    vectors = pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(-1, dim)
    table = table.drop_columns("embedding")
    finite = np.isfinite(vectors).all(axis=1)
    if finite.all():
        return table, vectors
    return table.filter(pa.array(finite)), vectors[finite]


def _square_norms(vectors: np.ndarray, center: np.ndarray) -> np.ndarray:
    """The squared distances from the center, in double precision, a tile at a time."""
    norms = np.empty(len(vectors))
    step = max(1, TILE_VALUES // max(1, vectors.shape[1]))
    for start in range(0, len(vectors), step):
        shifted = vectors[start : start + step] - center
        norms[start : start + step] = (shifted * shifted).sum(axis=1)
    return norms


def _cells(table: pa.Table) -> dict[tuple, pa.Table]:
    """The rows of each cell of a task."""
    if not table.num_rows:
        return {}
    table = table.sort_by([(c, "ascending") for c in _CELL]).combine_chunks()
    block = table.column("block").combine_chunks().dictionary_encode()
    keys = np.stack([block.indices.to_numpy(), *[table.column(c).to_numpy() for c in _CELL[1:]]], axis=1)
    bounds = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
    names = block.dictionary.to_pylist()
    return {
        (names[keys[start][0]], *keys[start][1:].tolist()): table.slice(start, end - start)
        for start, end in zip(bounds, bounds[1:])
    }


def _task_search(k: int, dim: int, digits: int):
    """Function for one task: the search of each of its cells."""
    search = _cell_search(k, dim, digits)

    def search_all(queries: pa.Table, stored: pa.Table) -> pa.Table:
        by_cell = _cells(stored)
        found = [search(part, by_cell[cell]) for cell, part in _cells(queries).items() if cell in by_cell]
        return pa.concat_tables(found) if found else _NO_HITS

    return search_all


def _kth_smallest(values: np.ndarray, k: int) -> np.ndarray:
    if values.shape[1] <= k:
        return np.full(len(values), np.inf)
    return np.partition(values, k - 1, axis=1)[:, k - 1]


def _factor(vectors: np.ndarray, center: np.ndarray, kind: type, scale: float, last: np.ndarray) -> np.ndarray:
    """The vectors around the center, times ``scale`` and with one value more, made a tile at a time."""
    out = np.empty((len(vectors), vectors.shape[1] + 1), kind)
    step = max(1, TILE_VALUES // max(1, vectors.shape[1]))
    for start in range(0, len(vectors), step):
        out[start : start + step, :-1] = (vectors[start : start + step] - center) * scale
    out[:, -1] = last
    return out


def _first_limit(rough: np.ndarray, k: int) -> np.ndarray:
    """What the ``k`` smallest values of each row do not exceed, from a sample of the columns."""
    stride = max(1, int(rough.shape[1] / np.sqrt(16.0 * k * rough.shape[1])))
    limit = _kth_smallest(rough[:, ::stride], k).astype(np.float64)
    unknown = ~np.isfinite(limit)
    if unknown.any():
        limit[unknown] = _kth_smallest(rough[unknown], k)
    return np.where(np.isfinite(limit), limit, np.inf)


def _nearest(
    asked: np.ndarray,
    points: np.ndarray,
    k: int,
    digits: int,
    jobs: tuple[np.ndarray, np.ndarray] | None = None,
    known: np.ndarray | None = None,
    chunks: list[tuple[int, int]] | None = None,
    gaps: Callable[[slice], np.ndarray] | None = None,
    places: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of at most ``k`` near points per question, and their distances: the question, the point, the distance.

    Of points at the same rounded distance the first come first, or those first in
    ``places``. Points of the question's own job are left out where ``jobs`` tells both
    sides' jobs, and those farther than ``known``, where that is given, need not be found.
    The points are gone through in ``chunks``; ``gaps`` may tell how near those of each can
    be to some of the questions, and chunks out of a question's reach are passed over.
    """
    # The product form |a|^2 + |b|^2 - 2ab is only a filter, so single precision will do.
    # It is taken around the center, where it is most precise; |b|^2 is one more value of
    # the vectors, so that one product gives all but |a|^2. A question's limit is the k-th
    # smallest value so far, at first of a sample.
    # Vectors stay in their own precision; only tiles of them are made double.
    dim = points.shape[1]
    center = points.mean(axis=0, dtype=np.float64)
    norms = _square_norms(points, center)
    small = max(norms.max(), _square_norms(asked, center).max()) < 1e30
    kind, precision = (np.float32, 2e-7) if small else (np.float64, 1e-14)
    near = _factor(points, center, kind, -2.0, norms)
    if chunks is None:
        chunks = [(start, min(start + CHUNK_ROWS, len(points))) for start in range(0, len(points), CHUNK_ROWS)]
    same = 2 * 10.0**-digits
    longest = max(end - start for start, end in chunks)
    step = max(1, min(TILE_VALUES // longest, len(asked)))
    # new memory for each product would cost as much as the product
    products, within = np.empty(step * longest, kind), np.empty(step * longest, bool)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for start in range(0, len(asked), step):
        tile = asked[start : start + step].astype(np.float64)
        tile_norms = _square_norms(tile, center)
        left = _factor(tile, center, kind, 1.0, np.ones(len(tile)))
        # Whatever rounding could move into the first k is measured again by differences.
        slack = same + 2 * precision * (dim + 4) * (tile_norms + norms.max())
        limit = np.full(len(tile), np.inf)
        if known is not None:
            limit = known[start : start + step] - tile_norms + slack
            limit[~np.isfinite(limit)] = np.inf
        best = np.full((len(tile), k), np.inf)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n_held = 0
        away = gaps(slice(start, start + step)) if gaps else None
        for c in range(len(chunks)) if away is None else np.argsort(away.mean(axis=0), kind="stable"):
            low, high = chunks[c]
            rows = np.arange(len(tile))
            if away is not None:
                rows = np.flatnonzero(away[:, c] <= np.sqrt(np.maximum(limit + tile_norms, 0.0) + same))
                if not len(rows):
                    continue
            shape = len(rows), high - low
            rough = products[: shape[0] * shape[1]].reshape(shape)
            np.matmul(left if len(rows) == len(tile) else left[rows], near[low:high].T, out=rough)
            if jobs:
                rough[jobs[0][start : start + step][rows][:, None] == jobs[1][None, low:high]] = np.inf
            unknown = ~np.isfinite(limit[rows])
            if unknown.any():
                limit[rows[unknown]] = _first_limit(rough if unknown.all() else rough[unknown], k) + slack[rows[unknown]]
            upto = np.nextafter(limit[rows].astype(kind), kind(np.inf))
            at = np.flatnonzero(np.less_equal(rough, upto[:, None], out=within[: rough.size].reshape(shape)))
            value = rough.reshape(-1)[at]
            at, value = at[value < np.inf], value[value < np.inf]
            if not len(at):
                continue
            row, col = np.divmod(at, high - low)
            row = rows[row]
            held.append((row, low + col, value))
            n_held += len(at)
            order = np.lexsort((value, row))
            bounds = np.append(np.flatnonzero(np.append(True, row[1:] != row[:-1])), len(row))
            counts = np.diff(bounds)
            slot, line = np.arange(len(row)) - np.repeat(bounds[:-1], counts), np.repeat(np.arange(len(counts)), counts)
            hit, first = row[bounds[:-1]], slot < k
            merged = np.concatenate([best[hit], np.full((len(hit), k), np.inf)], axis=1)
            merged[line[first], k + slot[first]] = value[order][first]
            merged.sort(axis=1)
            best[hit] = merged[:, :k]
            limit[hit] = np.fmin(limit[hit], best[hit, k - 1] + slack[hit])
            if n_held > TILE_VALUES:
                held = [_settled(tile, points, held, limit, k, digits, places)[:3]]
                n_held = len(held[0][0])
        if held:
            row, col, _, exact = _settled(tile, points, held, limit, k, digits, places)
            out.append((start + row, col, exact))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    rows, cols, exact = (np.concatenate(part) for part in zip(*out))
    return rows, cols, exact


def _settled(
    tile: np.ndarray,
    points: np.ndarray,
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]],
    limit: np.ndarray,
    k: int,
    digits: int,
    places: np.ndarray | None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` points per question of those held, measured by differences: question, point, rough value, distance."""
    rows, cols, values = (np.concatenate(part) for part in zip(*held))
    near = values <= np.nextafter(limit.astype(values.dtype), values.dtype.type(np.inf))[rows]
    rows, cols, values = rows[near], cols[near], values[near]
    exact = np.empty(len(rows))
    part = max(1, TILE_VALUES // points.shape[1])
    for i in range(0, len(rows), part):
        diff = tile[rows[i : i + part]] - points[cols[i : i + part]]
        exact[i : i + part] = (diff * diff).sum(axis=1)
    order = np.lexsort((cols if places is None else places[cols], np.round(exact, digits), rows))
    rows, cols, values, exact = rows[order], cols[order], values[order], exact[order]
    first = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
    return rows[first], cols[first], values[first], exact[first]


def _job_codes(queries: pa.Table, stored: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the jobs of both sides; a question without a job has one that no row has."""
    codes: dict[str | None, int] = {}
    point_jobs = np.array([codes.setdefault(j, len(codes)) for j in stored.column("job_name").to_pylist()])
    return np.array([codes.get(j, -1) if j else -1 for j in queries.column("job_name").to_pylist()]), point_jobs


def _cell_search(k: int, dim: int, digits: int):
    """Function for one cell: at most ``k`` (query, stored row, distance) per query."""

    def search(queries: pa.Table, stored: pa.Table) -> pa.Table:
        # Checked here and not by a Spark filter, which would make every vector twice.
        (queries, asked), (stored, points) = _usable(queries, dim), _usable(stored.sort_by("id"), dim)
        if queries.num_rows == 0 or stored.num_rows == 0:
            return _NO_HITS
        # Rows of the query's own job are compared in the job block.
        by_script = queries.column("block")[0].as_py().startswith("script:")
        # Points follow id order, so they break ties the way ids do.
        rows, cols, exact = _nearest(asked, points, k, digits, _job_codes(queries, stored) if by_script else None)
        return pa.table(
            {
                "query_id": queries.column("query_id").combine_chunks().take(pa.array(rows)),
                "id": stored.column("id").combine_chunks().take(pa.array(cols)),
                "distance": pa.array(exact, pa.float64()),
            }
        )

    return search


def nearest_by_query(
    inc: DataFrame,
    hist: DataFrame,
    k: int = TOP_K,
    embed: Embedder | None = None,
    vector: str = "embedding",
    dim: int | None = None,
    digits: int = 9,
    rows_per_cell: int | None = None,
    pairs_per_cell: int | None = None,
) -> DataFrame:
    """The ``k`` nearest stored rows per question: query_id, id, distance, rank.

    ``inc`` needs ``query_id`` (see :func:`with_query_id`). A question without job and
    script is compared with the whole store. Vectors of another width than ``dim``, and
    those with a null or non-finite value, find nothing and are not found. Without ``dim``
    the stored vectors must have one width.
    """
    if dim is None:
        dim = single_dimension(hist)
    if not dim:
        return inc.sparkSession.createDataFrame([], _HIT + ", rank int")
    asked = materialise(distinct_queries(inc, embed, vector), "questions")
    stored = hist.select("id", "job_name", "script_name", _floating(hist, "embedding").alias("embedding"))
    rows_per_cell = rows_per_cell or max(1, CELL_BYTES // (8 * dim))
    unfiltered = asked.where(_has_neither()).limit(1).count() > 0
    if not unfiltered:
        # A small batch of questions needs few of the stored rows, so those are picked first.
        stored = match_union(stored, asked, asked)
    stored = materialise(distinct_vectors(stored, k), "vectors")
    asked, stored = _blocks(asked, _has_neither()), _blocks(stored, F.lit(unfiltered))
    grid, tasks = _grid(asked, stored, rows_per_cell, pairs_per_cell)
    # Comparisons, not bytes, decide how many tasks there are. Cells fall on them by hash.
    task = F.pmod(F.xxhash64(*_CELL), F.lit(tasks)).cast("int")

    def spread(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        cell = F.pmod(F.xxhash64(key), F.col(f"{own}s")).cast("int").alias(own)
        copies = F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)).alias(other)
        placed = df.join(grid, "block")
        placed = placed.select("block", key, "job_name", "embedding", cell, copies).withColumn("task", task)
        return placed.repartition(tasks, "task").groupBy("task")

    left = spread(asked, "query_id", "query_cell", "hist_cell")
    right = spread(stored, "id", "hist_cell", "query_cell")
    hits = left.cogroup(right).applyInArrow(_task_search(k, dim, digits), _HIT)
    # A block of very many cells gives k hits per cell to one question, hence the salts.
    return top_k(hits, ["query_id"], [F.round("distance", digits), F.col("id")], k, spread=["id"])


# The attributes a search result carries, in result order.
RESULT_FIELDS = (
    "ticket_id",
    "job_name",
    "description",
    "resolution",
    "resolved_by",
    "resolved_at",
    "similarity_score",
    "script_name",
    "failure_type",
)


def with_attributes(hits: DataFrame, hist: DataFrame) -> DataFrame:
    """Add the stored attributes to search hits; the description is the stored text."""
    attributes = hist.select(
        "id",
        "ticket_id",
        "job_name",
        F.col("document").alias("description"),
        "resolution",
        "resolved_by",
        "resolved_at",
        "script_name",
        "failure_type",
    )
    return hits.join(attributes, "id").withColumn("similarity_score", F.lit(1.0) - F.col("distance"))


def history_search(
    inc: DataFrame,
    hist: DataFrame,
    k: int = TOP_K,
    embed: Embedder | None = None,
    vector: str = "embedding",
    dim: int | None = None,
    digits: int = 9,
    rows_per_cell: int | None = None,
    pairs_per_cell: int | None = None,
) -> DataFrame:
    """The ``k`` nearest stored rows per incident: request_id, rank, id, distance, similarity_score."""
    asked = with_query_id(inc, None if embed else vector)
    hits = nearest_by_query(asked, hist, k, embed, vector, dim, digits, rows_per_cell, pairs_per_cell)
    scored = hits.withColumn("similarity_score", F.lit(1.0) - F.col("distance"))
    return asked.select("request_id", "query_id").join(scored, "query_id").drop("query_id")


def history_arrays(hits: DataFrame, hist: DataFrame, fields: dict[str, int | None] | None = None) -> DataFrame:
    """One row per question: query_id and the ranked array of past incidents.

    ``fields`` names the attributes to carry, each with the number of characters that
    will be read (None for all). Long texts are cut before they are copied per question.
    """
    chosen = fields or dict.fromkeys(RESULT_FIELDS)
    cut = [F.substring(c, 1, n).alias(c) if n else F.col(c) for c, n in chosen.items()]
    found = with_attributes(hits, hist).select("query_id", "rank", *cut)
    return found.groupBy("query_id").agg(ranked_array("rank", *chosen).alias("history"))
