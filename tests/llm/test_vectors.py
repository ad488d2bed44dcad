import math

import numpy as np
import pytest

from faultweave.llm import vectors
from faultweave.llm.vectors import near_duplicate_vectors, rotation, tables_for
from tests.llm.cases import dicts


def brute(rows, cosine=0.93):
    """(n_links, component) by place; ids are distinct."""
    def valid(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    links = [[] for _ in rows]
    for i in range(n):
        for j in range(i):
            (_, a, la), (_, b, lb) = rows[i], rows[j]
            if valid(a, la) and valid(b, lb) and la == lb and len(a) == len(b):
                a, b = np.array(a, "f4").astype("f8"), np.array(b, "f4").astype("f8")
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                    links[i].append(j)
                    links[j].append(i)
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            least = min([label[i], *[label[j] for j in links[i]]], key=lambda k: rows[k][0])
            if least != label[i]:
                label[i], changed = least, True
    return {rows[i][0]: (len(links[i]), rows[label[i]][0]) for i in range(n)}


def frame(spark, rows):
    return spark.createDataFrame(
        [(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, cls string, id string"
    )


def got(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in dicts(df)}


def clusters(seed, n, dim, n_labels=3):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        if k % 3 and rows:
            of = rows[int(rng.integers(len(rows)))]
            v = np.array(of[1]) + rng.normal(scale=0.25 / math.sqrt(dim), size=dim) * np.linalg.norm(of[1])
            label = of[2]
        else:
            v, label = rng.normal(size=dim), int(rng.integers(n_labels))
        rows.append((k, [float(np.float32(x)) for x in v], label))
    return rows


@pytest.mark.parametrize("dim", [1, 3, 16, 70])
def test_against_all_pairs(spark, dim):
    rows = clusters(dim, 250, dim)
    assert got(near_duplicate_vectors(frame(spark, rows))) == brute(rows)


def test_large_buckets_are_cut(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK", 20)
    rows = clusters(9, 120, 16, 1) + [(1000 + i, [1.0 + i / 5000] + [0.5] * 15, 0) for i in range(100)]
    assert got(near_duplicate_vectors(frame(spark, rows))) == brute(rows)


def test_edge_cases(spark):
    v = [1.0, 2.0, 3.0]
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, v, 1),
        (2, [2.0, 4.0, 6.0], 1),
        (3, v, 2),
        (4, v, None),
        (5, None, 1),
        (6, [], 1),
        (7, [0.0, 0.0, 0.0], 1),
        (8, [1.0, None, 3.0], 1),
        (9, [1.0, nan, 3.0], 1),
        (10, [1.0, inf, 3.0], 1),
        (11, v[:2], 1),
        (12, v, 1),
        (13, [-x for x in v], 1),
    ]
    found = near_duplicate_vectors(frame(spark, rows))
    assert got(found) == brute(rows)
    assert {r["vec_id"] for r in dicts(found) if not r["kept"]} == {2, 12}
    assert near_duplicate_vectors(frame(spark, [])).count() == 0


def test_repeated_and_nameless_rows(spark):
    v = [1.0, 2.0]
    rows = [(1, v, 1), (1, v, 1), (None, v, 1), (None, [5.0, -1.0], 1)]
    found = sorted(str((r["vec_id"], r["n_links"], r["component_id"], r["kept"])) for r in dicts(near_duplicate_vectors(frame(spark, rows))))
    assert found == sorted(["(1, 2, 1, True)", "(1, 2, 1, True)", "(None, 2, 1, False)", "(None, 0, None, False)"])


def test_rotations_are_orthogonal_and_fixed():
    for dim in (1, 5, 64):
        r = rotation(dim, 3)
        assert np.allclose(r @ r.T, np.eye(dim)) and (r == rotation(dim, 3)).all()


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    dim, cosine = 64, 0.9
    errors, outside = [], 0
    for k in range(200):
        turn = rotation(dim, 100 + k)
        a = rng.normal(size=dim)
        a /= np.linalg.norm(a)
        b = rng.normal(size=dim)
        b -= (b @ a) * a
        b = cosine * a + math.sqrt(1 - cosine**2) * b / np.linalg.norm(b)
        y = turn @ a
        code, factor = np.where(y > 0, 1.0, -1.0), np.abs(y).sum() / math.sqrt(dim)
        estimate = code @ (turn @ b) / math.sqrt(dim) / factor
        bound = vectors.WIDTH * math.sqrt((1 - factor**2) / factor**2 / (dim - 1))
        errors.append(estimate - cosine)
        outside += abs(estimate - cosine) > bound
    assert abs(np.mean(errors)) < 0.01 and not outside


def test_tables_bound_the_chance_of_a_miss():
    for largest in (2, 1000, 10**9):
        bits, tables = tables_for(largest)
        same = (1 - math.acos(0.93) / math.pi) ** bits
        assert (1 - same) ** tables <= vectors.MISS
