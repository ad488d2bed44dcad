"""Nearest past incidents against brute force."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faultweave.functions.vectors import md5_embedding
from faultweave.operators import history, topk

STORE = "id string, job_name string, script_name string, embedding array<double>"
ASKED = "request_id long, job_name string, script_name string, embedding array<double>"


def make(seed, n_store, n_asked, dim=6, hot=0.5, copies=0.4):
    """A store in which one job holds half of the rows and many vectors are copies."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 3, size=(5, dim)).astype(float)

    def vector():
        if rng.random() < copies:
            return [float(x) for x in base[rng.integers(5)]]
        return [float(x) for x in rng.normal(size=dim)]

    def job():
        return "HOT" if rng.random() < hot else ["J0", "J1", "J2", ""][rng.integers(4)]

    def script():
        return [None, "", "a.py", "b.py"][rng.integers(4)]

    stored = [(f"id{i:05d}", job(), script() or "", vector()) for i in range(n_store)]
    asked = [(i, job(), script(), vector()) for i in range(n_asked)]
    return stored, asked


def brute(stored, asked, k, digits=9):
    out = []
    for request, job, script, v in asked:
        near = []
        for id_, j, s, w in stored:
            chosen = (job and j == job) or (script and s == script) or not (job or script)
            if len(w) == len(v) and chosen:
                near.append((round(float(((np.array(v) - np.array(w)) ** 2).sum()), digits), id_))
        out += [(request, rank, id_, d) for rank, (d, id_) in enumerate(sorted(near)[:k], 1)]
    return out


def search(spark, stored, asked, k, **options):
    hits = history.history_search(
        spark.createDataFrame(asked, ASKED), spark.createDataFrame(stored, STORE), k, **options
    ).collect()
    return sorted((r.request_id, r["rank"], r.id, round(r.distance, 9)) for r in hits)


@pytest.mark.parametrize("seed, rows, pairs", [(1, 1000, None), (2, 17, None), (3, 5, None), (4, 23, 100), (5, 1000, 40)])
def test_equals_brute_force(spark, seed, rows, pairs):
    stored, asked = make(seed, 90, 40)
    assert search(spark, stored, asked, 5, rows_per_cell=rows, pairs_per_cell=pairs) == brute(stored, asked, 5)


@pytest.mark.parametrize("copies", [0.0, 0.95])
def test_sampled_limit_in_a_large_block(spark, copies):
    stored, asked = make(7, 1500, 30, hot=1.0, copies=copies)
    assert search(spark, stored, asked, 3) == brute(stored, asked, 3)


def test_large_values_do_not_blur_the_order(spark):
    stored = [(f"id{i}", "J", "", [1e6 + i * 1e-3, 1e6]) for i in range(40)]
    asked = [(1, "J", None, [1e6 + 0.0141, 1e6])]
    assert [h[2] for h in search(spark, stored, asked, 3)] == ["id14", "id15", "id13"]


def test_other_widths_find_nothing(spark):
    stored = [("a", "J", "", [0.0, 0.0]), ("b", "J", "", [1.0])]
    asked = [(1, "J", None, [0.0, 1.0]), (2, "J", None, [0.0])]
    assert search(spark, stored, asked, 5, dim=2) == [(1, 1, "a", 1.0)]
    with pytest.raises(ValueError, match="1 to 2 values"):
        search(spark, stored, asked, 5)


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), None])
def test_vectors_without_a_finite_value_harm_no_others(spark, bad):
    stored, asked = make(9, 40, 20)
    spoilt = [[bad, *[0.0] * 5], [0.0] * 5 + [bad]]
    more = [(f"bad{i}", "HOT", "a.py", v) for i, v in enumerate(spoilt)]
    ask_more = [(1000 + i, "HOT", None, v) for i, v in enumerate(spoilt)]
    assert search(spark, stored + more, asked + ask_more, 5) == brute(stored, asked, 5)


def test_float_vectors(spark):
    stored, asked = make(10, 60, 30)
    as_float = lambda rows: [(*r[:3], [float(np.float32(x)) for x in r[3]]) for r in rows]
    stored, asked = as_float(stored), as_float(asked)
    hits = history.history_search(
        spark.createDataFrame(asked, ASKED.replace("double", "float")),
        spark.createDataFrame(stored, STORE.replace("double", "float")),
        5,
    ).collect()
    assert sorted((r.request_id, r["rank"], r.id, round(r.distance, 9)) for r in hits) == brute(stored, asked, 5)


def test_very_large_values(spark):
    stored = [(f"id{i}", "J", "", [1e200 * i, 0.0]) for i in range(20)]
    assert [h[2] for h in search(spark, stored, [(1, "J", None, [3.1e200, 0.0])], 2)] == []
    stored = [(f"id{i}", "J", "", [1e100 * i, 0.0]) for i in range(20)]
    assert [h[2] for h in search(spark, stored, [(1, "J", None, [3.1e100, 0.0])], 2)] == ["id3", "id4"]


def test_tasks_follow_the_work_not_the_jobs(spark):
    rows = [(f"id{i}", f"J{i % 500}", "", [float(i), 0.0]) for i in range(1000)]
    asked = [(i, f"J{i}", None, [0.0, 0.0]) for i in range(500)]
    hits = history.history_search(spark.createDataFrame(asked, ASKED), spark.createDataFrame(rows, STORE), 5)
    assert "hashpartitioning(task#" in hits._jdf.queryExecution().toString()
    assert search(spark, rows, asked, 5) == brute(rows, asked, 5)


def test_nothing_stored(spark):
    assert search(spark, [], [(1, "J", None, [0.0])], 5) == []
    assert search(spark, [("a", "K", "", [0.0])], [(1, "J", None, [0.0])], 5) == []


def test_questions_without_job_and_script_see_the_whole_store(spark):
    stored, _ = make(8, 60, 0)
    asked = [(1, "", None, [0.0] * 6), (2, None, "", [1.0] * 6), (3, "", "a.py", [0.0] * 6), (4, "J0", None, [0.0] * 6)]
    assert search(spark, stored, asked, 5, rows_per_cell=13) == brute(stored, asked, 5)


def test_equal_questions_are_asked_once(spark):
    asked = spark.createDataFrame(
        [(i, "J", None, "d", "same log") for i in range(50)] + [(50, "J", "", "d", "same log"), (51, "J", "s", "d", "same log")],
        "request_id long, job_name string, script_name string, description string, tws_log string",
    )
    with_id = history.with_query_id(asked)
    assert history.distinct_queries(with_id, md5_embedding).count() == 2


def test_metadata_predicate_and_counts(spark):
    stored, asked = make(5, 30, 25)
    asked += [(100, "", None, []), (101, None, "", []), (102, "", "a.py", []), (103, "Z", "zz", [])]
    hist = spark.createDataFrame(stored, STORE)
    inc = spark.createDataFrame(asked, ASKED)
    expected = {}
    for request, job, script, _ in asked:
        expected[request] = sum(
            1 for _, j, s, _ in stored if (job and j == job) or (script and s == script) or not (job or script)
        )
    counted = {r.request_id: r.candidates for r in history.matching_store_rows(inc, hist).collect()}
    assert counted == expected
    h = hist.select(F.col("job_name").alias("hj"), F.col("script_name").alias("hs"))
    predicate = history.metadata_predicate(F.col("job_name"), F.col("script_name"), F.col("hj"), F.col("hs"))
    pairs = inc.crossJoin(h).where(predicate).groupBy("request_id").count().collect()
    assert {r.request_id: r["count"] for r in pairs} == {r: n for r, n in expected.items() if n}


def test_match_union(spark):
    stored, _ = make(6, 40, 0)
    hist = spark.createDataFrame(stored, STORE)
    jobs = spark.createDataFrame([("J1",), ("",), ("J1",)], "job_name string")
    scripts = spark.createDataFrame([("a.py",), (None,), ("",)], "script_name string")
    got = sorted(r.id for r in history.match_union(hist, jobs, scripts).collect())
    assert got == sorted(id_ for id_, j, s, _ in stored if j == "J1" or s == "a.py")


@pytest.mark.parametrize("k", [1, 3])
def test_top_k_of_a_hot_key(spark, k):
    rows = [("hot", i % 50, i) for i in range(300)] + [("cold", 1, 1000)]
    df = spark.createDataFrame(rows, "key string, v long, id long")
    got = topk.top_k(df, ["key"], [F.col("v"), F.col("id")], k, spread=["id"]).collect()
    expected = [("cold", 1000, 1)] + [("hot", r[2], i) for i, r in enumerate(sorted(rows[:-1], key=lambda r: r[1:])[:k], 1)]
    assert sorted((r.key, r.id, r["rank"]) for r in got) == sorted(expected)
    with pytest.raises(ValueError):
        topk.top_k(df, ["key"], [F.col("v")], 0, spread=["id"])


def test_a_cell_holds_its_vectors_once_in_their_own_precision(monkeypatch):
    monkeypatch.setattr(history, "TILE_VALUES", 1 << 16)
    rng, n, dim = np.random.default_rng(3), 20_000, 64
    vectors = rng.normal(size=(n, dim)).astype(np.float32)

    def table(key, rows, block="job:J"):
        values = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, dim), pa.int32()), pa.array(rows.reshape(-1)))
        names = [f"{i:06d}" for i in range(len(rows))]
        return pa.table({"block": [block] * len(rows), key: names, "job_name": ["J"] * len(rows), "embedding": values})

    asked, stored = table("query_id", vectors[:8] + np.float32(0.01)), table("id", vectors)
    search = history._cell_search(3, dim, 9)
    tracemalloc.start()
    found = search(asked, stored)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * vectors.nbytes
    exact = ((vectors[:8] + np.float32(0.01)).astype(float)[:, None, :] - vectors.astype(float)[None, :, :]) ** 2
    exact = exact.sum(axis=2)
    best = np.argsort(exact, axis=1, kind="stable")[:, :3]
    assert found.column("id").to_pylist() == [f"{i:06d}" for i in best.reshape(-1)]
    assert np.allclose(found.column("distance").to_numpy(), np.take_along_axis(exact, best, 1).reshape(-1), rtol=1e-12)


@pytest.mark.parametrize("tile", [16, 1 << 10, 4 << 20])
def test_points_gone_through_in_chunks(monkeypatch, tile):
    """Chunks out of reach are not multiplied, what is held is settled in time, and ties go by place."""
    monkeypatch.setattr(history, "TILE_VALUES", tile)
    rng, k = np.random.default_rng(6), 4
    centers = rng.normal(size=(6, 8)) * 20
    points = np.concatenate([c + rng.integers(0, 3, size=(50, 8)) for c in centers])
    asked = np.concatenate([c + rng.integers(0, 3, size=(5, 8)) for c in centers])
    places = rng.permutation(len(points))
    exact = ((asked[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)
    order = np.lexsort((np.broadcast_to(places, exact.shape), np.round(exact, 9)), axis=1)[:, :k]
    chunks = [(i * 50, i * 50 + 50) for i in range(6)]
    away = np.sqrt(exact).reshape(len(asked), 6, 50).min(axis=2)
    for known in (None, np.take_along_axis(exact, order[:, -1:], 1)[:, 0]):
        rows, cols, found = history._nearest(asked, points, k, 9, None, known, chunks, lambda tile: away[tile], places)
        got = np.argsort(rows, kind="stable")
        assert (cols[got].reshape(-1, k) == order).all()
        assert np.allclose(found[got].reshape(-1, k), np.take_along_axis(exact, order, 1))
    rows, cols, _ = history._nearest(asked, points, k, 9, places=None)
    order = np.argsort(np.round(exact, 9), axis=1, kind="stable")[:, :k]
    assert (cols.reshape(-1, k) == order).all()
