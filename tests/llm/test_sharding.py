import zlib
from bisect import bisect_left
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from faultweave.llm.catalog import op3_shards
from faultweave.llm.common import table
from faultweave.llm.sharding import best_fit_decreasing, best_fit_shards
from tests.llm.cases import DOCUMENTS, dicts, documents


def plain_best_fit(sizes, capacity):
    rooms, chosen = [], []
    for size in sizes:
        fits = [(r, k) for k, r in enumerate(rooms) if r >= size]
        if fits:
            k = min(fits)[1]
        else:
            k = len(rooms)
            rooms.append(capacity)
        rooms[k] -= size
        chosen.append(k)
    return chosen


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 130), max_size=300))
def test_tree_finds_the_tightest_bin(sizes):
    sizes = sorted(sizes, reverse=True)
    assert best_fit_decreasing(sizes, 100) == plain_best_fit(sizes, 100)


def test_many_bins():
    sizes = [60] * 5000 + [39] * 5000 + [1] * 100
    bins = Counter()
    for size, k in zip(sizes, best_fit_decreasing(sizes, 100)):
        bins[k] += size
    assert len(bins) == 5000 and max(bins.values()) == 100
    assert bisect_left(sorted(bins.values()), 100) == 4900


def laws(rows, texts, n_shards):
    total, slots, groups = Counter(), defaultdict(list), defaultdict(set)
    for row in rows:
        total[row["shard"]] += row["size"]
        slots[row["shard"]].append(row["slot"])
        groups[texts[row["doc_id"]]].add(row["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(total) <= set(range(n_shards))
    return total, groups


def test_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in table(spark, sf_dir, "documents").collect()}
    rows = dicts(op3_shards(spark, sf_dir))
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for row in rows:
        data = texts[row["doc_id"]].encode()
        assert (row["size"], row["text_crc32"], row["law"]) == (len(data) + 1, zlib.crc32(data), "bytes")
    total, groups = laws(rows, texts, 8)
    assert all(len(s) == 1 for s in groups.values())
    assert max(total.values()) - min(total.values()) <= 0.02 * max(total.values())


def test_a_group_beyond_the_capacity_is_cut_evenly(spark):
    rows = [(i, "the same text", "a") for i in range(100)] + [(1000 + i, f"text {i}", "a") for i in range(100)]
    texts = {i: t for i, t, _ in rows}
    found = dicts(best_fit_shards(documents(spark, rows), n_shards=8))
    total, groups = laws(found, texts, 8)
    assert max(total.values()) - min(total.values()) <= 60
    assert all(len(s) == 1 for t, s in groups.items() if t != "the same text")


def test_fixed_capacity(spark):
    rows = [(i, "x" * (9 if i % 2 else 89), "a") for i in range(20)]
    rows = [(i, t[:-1] + chr(97 + i), s) for i, t, s in rows]
    found = dicts(best_fit_shards(documents(spark, rows), capacity=100))
    assert len({r["shard"] for r in found}) == 10


def test_edge_cases(spark):
    rows = dicts(best_fit_shards(documents(spark), n_shards=8))
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(i) for i, _, _ in DOCUMENTS)
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    assert best_fit_shards(documents(spark, []), n_shards=8).count() == 0
