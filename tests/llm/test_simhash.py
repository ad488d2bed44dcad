import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from faultweave.llm import simhash
from faultweave.llm.catalog import op7_simhash
from faultweave.llm.common import components, table
from faultweave.llm.simhash import fingerprint_of, keep_one, simhash_documents
from tests.llm.cases import DOCUMENTS, PROSE, dicts, documents


def brute_print(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance=4):
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= distance and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


@settings(max_examples=100, deadline=None)
@given(st.text("aB é\n\x1c\xa0", max_size=60))
def test_fingerprints(text):
    assert fingerprint_of(text.encode()) == brute_print(text)


def test_fingerprint_in_chunks(monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 3)
    assert fingerprint_of(PROSE.encode()) == brute_print(PROSE)


@pytest.mark.parametrize("limit", [100, 1 << 22])
def test_collisions_with_little_memory(monkeypatch, limit):
    monkeypatch.setattr(simhash, "VARIANTS_AT_A_TIME", limit)
    rng = random.Random(3)
    prints = sorted({rng.getrandbits(16) for _ in range(60)})
    low = np.array(prints, "u8")
    found = list(simhash._collisions(low, np.full(len(low), 2), np.arange(len(low)), 16))
    a, b = (np.concatenate([p[k] for p in found]) for k in (0, 1))
    assert all((prints[i] ^ prints[j]).bit_count() <= 4 for i, j in zip(a, b))
    root = simhash.smallest_reachable(len(low), a, b)
    assert root.tolist() == brute_components(prints)


def near(rng, value, flips):
    for bit in rng.sample(range(64), flips):
        value ^= 1 << bit
    return value


def test_links_of_clusters_and_chains(spark):
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(40)]
    prints += [near(rng, prints[0], k % 9) for k in range(150)]
    for start in prints[1:8]:
        for _ in range(6):
            prints.append(start := near(rng, start, rng.randint(3, 6)))
    prints = sorted(set(prints))
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    links = simhash.ball_links(spark.createDataFrame(signed, "print long"), len(prints))
    pairs = [(r.a % (1 << 64), r.b % (1 << 64)) for r in links.collect()]
    place = {p: i for i, p in enumerate(prints)}
    a, b = (np.array([place[p[k]] for p in pairs]) for k in (0, 1))
    assert simhash.smallest_reachable(len(prints), a, b).tolist() == brute_components(prints)


def test_whole_table(spark, sf_dir):
    texts = sorted((r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect())
    prints = [brute_print(t) for _, t in texts]
    label = brute_components(prints)
    expected = {i: (f"{p:016x}", texts[c][0]) for (i, _), p, c in zip(texts, prints, label)}
    rows = dicts(op7_simhash(spark, sf_dir))
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == expected
    assert len(rows) == len(texts)


def test_edge_cases(spark):
    rows = dicts(simhash_documents(documents(spark)))
    assert len(rows) == len(DOCUMENTS)
    ids = [i for i, _, _ in DOCUMENTS]
    label = brute_components([brute_print(t) for _, t, _ in DOCUMENTS])
    least = [min((i for i, c in zip(ids, label) if c == mine and i is not None), default=None) for mine in label]
    expected = sorted(str((i, f"{brute_print(t):016x}", m)) for (i, t, _), m in zip(DOCUMENTS, least))
    assert sorted(str((r["doc_id"], r["fingerprint"], r["component_id"])) for r in rows) == expected
    assert simhash_documents(documents(spark, [])).count() == 0


def test_one_of_each_group_stays(spark):
    docs = documents(spark)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    groups = {r["component_id"] for r in dicts(simhash_documents(docs))}
    assert sorted(r["doc_id"] for r in dicts(kept)) == sorted(groups)
    nameless = documents(spark, [(None, PROSE, "a"), (None, PROSE + " x", "b"), (None, "other text here", "c")])
    texts = [r["text"] for r in dicts(keep_one(nameless))]
    assert len(texts) == 2 and "other text here" in texts
    assert keep_one(documents(spark, [])).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(300)] + [(7, 7), (5, 4)]
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    root = {r.node: r.root for r in rows}
    assert len(root) == len(rows)
    assert root == {i: 0 for i in range(101)} | {1000 + i: 1000 for i in range(300)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_distance_is_refused(spark):
    with pytest.raises(ValueError, match="even"):
        simhash.ball_links(spark.range(1).withColumnRenamed("id", "print"), 1, 3)
