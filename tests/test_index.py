"""Searches through the kept index against brute force and against full scans."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultweave.operators import history, index
from tests.test_history import ASKED, STORE, brute, make

SMALL = {"cell_rows": 20, "buckets": 8}


def write(spark, stored, path, **options):
    index.write_index(spark.createDataFrame(stored, STORE), path, **{**SMALL, **options})


def search(spark, asked, path, k, store=None, **options):
    asked = history.with_query_id(spark.createDataFrame(asked, ASKED), "embedding")
    hits = index.indexed_search(asked, path, store, k=k, **{**SMALL, **options}).collect()
    return sorted((r.request_id, r["rank"], r.id, round(r.distance, 9)) for r in hits)


def clustered(seed, n, dim=8, clusters=12):
    """Rows of one job around a few far centers, as texts of a few kinds of failure are."""
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(clusters, dim)) * 50
    point = lambda: [float(x) for x in centers[rng.integers(clusters)] + rng.normal(size=dim)]
    stored = [(f"id{i:05d}", "HOT", "", point()) for i in range(n)]
    return stored, [(i, "HOT", None, point()) for i in range(30)]


@pytest.mark.parametrize("seed", [1])
def test_equals_brute_force(spark, tmp_path, seed):
    stored, asked = make(seed, 300, 40)
    asked = [a for a in asked if a[1] or a[2]]
    write(spark, stored, f"{tmp_path}/index")
    assert search(spark, asked, f"{tmp_path}/index", 5) == brute(stored, asked, 5)


def test_cells_are_skipped(spark, tmp_path):
    stored, asked = clustered(3, 2000)
    path = f"{tmp_path}/index"
    write(spark, stored, path)
    assert search(spark, asked, path, 5) == brute(stored, asked, 5)
    cells = spark.read.parquet(f"{path}/cells")
    assert cells.agg(F.sum("n")).first()[0] == len(stored) and cells.agg(F.max("n")).first()[0] <= 4 * SMALL["cell_rows"]
    queries = history.distinct_queries(history.with_query_id(spark.createDataFrame(asked, ASKED), "embedding"))
    probes, rest, _ = index.plan_visits(queries, path, 8, 5, 9, SMALL["buckets"], SMALL["cell_rows"])
    rows = sum(visits.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for visits in (probes, rest))
    assert probes.count() <= index.PROBES * len(asked)
    assert rows < 0.3 * len(asked) * len(stored)


def test_ties_at_the_bound_go_by_id(spark, tmp_path):
    """Equal distances on all sides of a question, in different rings and cells."""
    ring = [[float(np.cos(a)), float(np.sin(a))] for a in np.arange(64) * np.pi / 32]
    stored = [(f"id{(i * 37) % 64:02d}", "J", "", v) for i, v in enumerate(ring)]
    asked = [(1, "J", None, [0.0, 0.0]), (2, "J", None, [0.0, 1e-12])]
    write(spark, stored, f"{tmp_path}/index", cell_rows=4)
    assert search(spark, asked, f"{tmp_path}/index", 5, cell_rows=4) == brute(stored, asked, 5)


def test_generations_and_whole_store_questions(spark, tmp_path):
    stored, asked = make(5, 160, 30)
    path = f"{tmp_path}/index"
    write(spark, stored[:100], path)
    everything = spark.createDataFrame(stored, STORE)
    for _ in range(2):  # a repeated run overwrites its own generation
        index.add_to_index(everything, path, generation=1, **SMALL)
    assert spark.read.parquet(f"{path}/rows").where("generation = 1").select("id").distinct().count() <= 60
    asked += [(900, "", None, [0.0] * 6), (901, "HOT#0", "", [0.0] * 6)]
    assert search(spark, asked, path, 5, store=everything) == brute(stored, asked, 5)


def test_vectors_that_are_not_finite_or_of_another_width(spark, tmp_path):
    stored, asked = make(9, 60, 20)
    asked = [a for a in asked if a[1] or a[2]]
    more = [(f"bad{i}", "HOT", "a.py", v) for i, v in enumerate([[float("nan")] * 6, [float("inf")] * 6, [None] * 6, [1.0], None])]
    write(spark, stored + more, f"{tmp_path}/index", dim=6)
    bad = [(1000 + i, "HOT", None, m[3]) for i, m in enumerate(more[:4])]
    assert search(spark, asked + bad, f"{tmp_path}/index", 5) == brute(stored, asked, 5)


def test_a_batch_reads_only_its_buckets(spark, tmp_path):
    rows = [(f"id{i:04d}", f"J{i % 100}", "", [float(i), 0.0]) for i in range(400)]
    path = f"{tmp_path}/index"
    write(spark, rows, path, buckets=64)
    asked = spark.createDataFrame([(1, "J7", None, [0.0, 0.0])], ASKED)
    numbers = index.asked_buckets(asked, 64)
    assert len(numbers) == 1
    read = index._read(spark, path, "rows", numbers)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket", plan)
    everything = {f for f in spark.read.parquet(f"{path}/rows").inputFiles()}
    assert read.count() < 40 and len(everything) > 10
    assert len({r[0] for r in read.select(F.input_file_name()).distinct().collect()}) < len(everything) / 5
    found = index.indexed_rows(spark.createDataFrame([("id0007",)], "id string"), asked, path, 64).collect()
    assert [r.id for r in found] == ["id0007"]


def test_a_question_travels_to_a_group_once(spark, tmp_path):
    """However many cells of a block it visits; blocks of several groups, and rows added later."""
    stored, asked = make(11, 700, 60, copies=0.1)
    asked = [a for a in asked if a[1] or a[2]]
    path = f"{tmp_path}/index"
    write(spark, stored[:400], path, cell_rows=5)
    index.add_to_index(spark.createDataFrame(stored, STORE), path, generation=1, **{**SMALL, "cell_rows": 5})
    assert search(spark, asked, path, 5, cell_rows=5) == brute(stored, asked, 5)
    queries = history.distinct_queries(history.with_query_id(spark.createDataFrame(asked, ASKED), "embedding"))
    probes, rest, hits = index.plan_visits(queries, path, 6, 5, 9, SMALL["buckets"], 5)
    assert rest.count() > 0 and spark.read.parquet(f"{path}/cells").count() > 100
    travels = probes.select("query_id", "block", "hist_cell").unionByName(rest.select("query_id", "block", "hist_cell"))
    assert travels.count() == travels.distinct().count()
    assert hits.count() <= travels.count() and hits.agg(F.max(F.size("ids"))).first()[0] <= 5


def test_a_vector_travels_to_a_block_once(spark, tmp_path):
    """However many questions ask for it, also such that differ in their job or script."""
    rng = np.random.default_rng(12)
    vectors = [[float(x) for x in rng.normal(size=4)] for _ in range(3)]
    stored = [(f"id{i:03d}", ["HOT", "J1", ""][i % 3], f"s{i % 4}", [float(x) for x in rng.normal(size=4)]) for i in range(200)]
    stored += [(f"id{200 + i}", *s[1:]) for i, s in enumerate(stored[:40])]
    asked = [(i, ["HOT", "J1", "", "J2"][i % 4], f"s{i // 4 % 5}", vectors[i % 3]) for i in range(120)]
    path = f"{tmp_path}/index"
    write(spark, stored, path)
    assert search(spark, asked, path, 5) == brute(stored, asked, 5)
    queries = history.distinct_queries(history.with_query_id(spark.createDataFrame(asked, ASKED), "embedding"))
    probes, rest, hits = index.plan_visits(queries, path, 4, 5, 9, SMALL["buckets"], SMALL["cell_rows"])
    # two jobs and four scripts are stored
    assert probes.count() == (2 + 4) * len(vectors) and rest.count() == 0 and hits.count() == probes.count()
