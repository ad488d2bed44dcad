from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from faultweave.llm.catalog import op4_mix_sources
from faultweave.llm.common import table
from faultweave.llm.mixing import CYCLE, in_mixed_order, mix, pfair_cycle, schedule, shares, walk
from tests.llm.cases import DOCUMENTS, dicts, documents


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.text("abcdefgh", min_size=1, max_size=2), st.floats(0.001, 1000), min_size=1, max_size=12))
def test_every_prefix_is_less_than_one_block_from_its_share(weights):
    slots = shares(weights, 256)
    assert sum(slots.values()) == 256 and min(slots.values()) >= 1
    cycle = pfair_cycle(slots, 256)
    assert sorted(t for places in cycle.values() for t in places) == list(range(256))
    for s, places in cycle.items():
        done = 0
        for now in range(1, 257):
            done += now - 1 in places
            assert abs(done * 256 - slots[s] * now) < 256


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(1, 700), min_size=1))
def test_a_schedule_uses_all_blocks_once(blocks):
    phases = schedule(blocks, {s: n**0.5 for s, n in blocks.items()}, 64)
    slots = []
    for s, n in blocks.items():
        mine = [p for p in phases if p.source == s]
        for block in range(n):
            phase = [p for p in mine if p.block <= block][-1]
            slots.append(phase.slot_of(block, 64))
    assert sorted(slots) == list(range(sum(blocks.values())))


def test_whole_table(spark, sf_dir):
    rows = dicts(op4_mix_sources(spark, sf_dir))
    source = {r.doc_id: r.source for r in table(spark, sf_dir, "documents").collect()}
    assert {r["doc_id"]: r["source"] for r in rows} == source
    assert sorted(r["position"] for r in rows) == list(range(len(source)))
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in rows)


def test_weights_hold_until_a_source_ends(spark):
    rows = [(i, f"t{i}", "big" if i % 4 else "small") for i in range(800)]
    found = dicts(mix(documents(spark, rows), weights={"big": 1, "small": 1}, block_docs=4))
    first = [r for r in found if r["phase"] == 0]
    counts = Counter(r["source"] for r in first)
    assert counts["small"] == 200 and abs(counts["big"] - 200) <= 4
    for n in range(4, 400, 4):
        got = sum(r["source"] == "small" for r in first if r["position"] < n)
        assert abs(got - n / 2) < 4


def test_order_of_rows(spark):
    docs = documents(spark, [(i, f"text {i}", "ab"[i % 3 == 0]) for i in range(300)])
    place = {r["doc_id"]: r["position"] for r in dicts(mix(docs))}
    ordered = in_mixed_order(docs)
    assert ordered.columns == docs.columns
    got = [place[r.doc_id] for r in ordered.collect()]
    assert got == sorted(got) and len(got) == 300


def test_edge_cases(spark):
    docs = documents(spark)
    rows = dicts(mix(docs))
    assert sorted(r["position"] for r in rows) == list(range(len(DOCUMENTS)))
    assert Counter(r["source"] for r in rows) == Counter(s for _, _, s in DOCUMENTS)
    back = in_mixed_order(docs).collect()
    assert sorted(str((r.doc_id, r.text, r.source)) for r in back) == sorted(str(d) for d in DOCUMENTS)
    assert mix(documents(spark, [])).count() == 0 and in_mixed_order(documents(spark, [])).count() == 0


def test_more_sources_than_weights(spark):
    rows = [(i, f"t{i}", f"s{i % 400}") for i in range(1200)]
    found = dicts(mix(documents(spark, rows), block_docs=2))
    assert sorted(r["position"] for r in found) == list(range(1200))


@pytest.mark.parametrize("n", [1, 7, 4096])
def test_equal_weights(n):
    assert sorted(shares(dict.fromkeys(map(str, range(n)), 1.0)).values())[0] >= CYCLE // n


def off_by(steps, weights, until):
    """The farthest that any source is from its exact share, in blocks, in the first slots."""
    total, done, worst = sum(weights), [0] * len(weights), 0.0
    for slot, step in enumerate(steps[:until]):
        assert step[5] == slot and step[3] <= slot < step[4]
        done[step[0]] += 1
        worst = max(worst, max(abs(d - w / total * (slot + 1)) for d, w in zip(done, weights)))
    return worst


def test_exact_weights_hold_over_many_cycles():
    """Weights that are no multiples of 1/4096, over 30 cycles of that length."""
    weights = [1.0, 2**0.5, 0.0003, 1 / 3]
    steps = list(walk([200_000] * 4, weights, 1))
    assert off_by(steps, weights, 30 * CYCLE) < 1 + 1e-6
    assert sorted(s[:2] for s in steps) == [(s, j) for s in range(4) for j in range(200_000)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.floats(0.001, 1000)), min_size=1, max_size=12))
def test_windows_hold_through_the_phases(sources):
    sizes, weights = zip(*sources)
    steps = list(walk(sizes, weights, 4))
    assert sorted(s[:2] for s in steps) == [(s, j) for s, n in enumerate(sizes) for j in range(-(-n // 4))]
    assert all(s[3] <= s[5] < s[4] for s in steps) and [s[5] for s in steps] == list(range(len(steps)))
    first = sum(s[2] == 0 for s in steps)
    assert off_by(steps, weights, first) < 1 + 1e-6


def test_300_sources_keep_their_weights(spark):
    rows = [(i, f"t{i}", f"s{i % 300}") for i in range(6000)]
    weights = {f"s{k}": 1 + k % 7 for k in range(300)}
    found = dicts(mix(documents(spark, rows), weights=weights, block_docs=2))
    assert sorted(r["position"] for r in found) == list(range(6000))
    slots = sorted({(r["slot"], r["source"]) for r in found if r["phase"] == 0})
    assert len(slots) > 300
    total, done = sum(weights.values()), Counter()
    for n, (slot, source) in enumerate(slots, 1):
        assert slot == n - 1
        done[source] += 1
        assert all(abs(done[s] - w * n / total) < 1 + 1e-6 for s, w in weights.items())


def test_weights_that_are_not_positive_are_refused(spark):
    with pytest.raises(ValueError, match="positive"):
        mix(documents(spark), weights={"a": 0})
