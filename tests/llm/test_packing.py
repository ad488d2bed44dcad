import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from faultweave.llm.catalog import VOCABULARY, op5_pack_documents
from faultweave.llm.common import table
from faultweave.llm.packing import WordIds, configurations, linear_groups, pack, pack_documents, plan_runs
from tests.llm.cases import DOCUMENTS, dicts, documents

PATH = public_tokenizers.path(VOCABULARY)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def word_ids():
    return WordIds(PATH)


@settings(max_examples=200, deadline=None)
@given(
    st.lists(
        st.one_of(st.text(max_size=40), st.text("abAB 's1é.,!<|endoftext|>\n\x1c\xa0İΣ́\xad", max_size=40)),
        min_size=1,
        max_size=4,
    )
)
def test_ids_equal_the_tokenizers(word_ids, tokenizer, texts):
    got = [ids.tolist() for ids in word_ids(texts)]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_other_tokenizers_code_texts_whole(name):
    path = public_tokenizers.path(name)
    texts = ["", "Plain words  here.", " 1,234 don't\n\nÀ la carte 東京", "x" * 5000]
    other = Tokenizer.from_file(path)
    assert not WordIds(path).by_words and WordIds(PATH).by_words
    assert [i.tolist() for i in WordIds(path)(texts)] == [other.encode(t, add_special_tokens=False).ids for t in texts]


def expand(runs, capacity):
    """Sequences as lists of (offset, length), and the numbers used of each length."""
    bins, used = defaultdict(list), defaultdict(list)
    for length, first, n, each, bin_id, offset in runs:
        for k in range(n):
            bins[bin_id + k // each].append((offset + k % each * length, length))
            used[length].append(first + k)
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return bins, used


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plans_place_every_piece_once(histogram):
    bins, used = expand(plan_runs(histogram, 64), 64)
    assert {length: sorted(u) for length, u in used.items()} == {s: list(range(n)) for s, n in histogram.items()}
    bound = -(-sum(s * n for s, n in histogram.items()) // 64)
    decreasing = [s for s in sorted(histogram, reverse=True) for _ in range(histogram[s])]
    rooms = []
    for s in decreasing:
        fits = [(r, k) for k, r in enumerate(rooms) if r >= s]
        if fits:
            rooms[min(fits)[1]] -= s
        else:
            rooms.append(64 - s)
    assert bound <= len(bins) <= max(len(rooms) * 1.2, len(rooms) + 2)


def test_known_optimum():
    """Of 500 pieces that fill 200 sequences, rounding within 32 groups may waste one per group."""
    bins, _ = expand(plan_runs({60: 100, 40: 100, 34: 200, 32: 100}, 100), 100)
    assert 200 <= len(bins) <= 200 + 32 // 7


def test_groups_are_of_equal_cardinality():
    groups = linear_groups({s: 3 for s in range(30, 70)}, 8)
    assert [sum(n for _, n in part) for _, part in groups] == [15] * 8
    assert all(size == max(s for s, _ in part) for size, part in groups)


def test_configurations_meet_the_demand():
    sizes, demand = [60, 45, 30], [10, 10, 20]
    chosen = configurations(sizes, demand, 100)
    got = np.sum([np.array(uses) * times for uses, times in chosen], axis=0)
    assert (got >= np.array(demand) - 1e-6).all()
    assert all(sum(s * u for s, u in zip(sizes, uses)) <= 100 for uses, _ in chosen)


def check(rows, texts, tokenizer):
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    expected = defaultdict(list)
    for doc_id, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            expected[doc_id].append((k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert {k: Counter(v) for k, v in by_doc.items()} == {k: Counter(v) for k, v in expected.items()}
    return len(sequences), -(-sum(p[1] for s in sequences.values() for p in s) // 4096)


def test_whole_table(spark, sf_dir, tokenizer):
    texts = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    n, bound = check(dicts(op5_pack_documents(spark, sf_dir)), texts, tokenizer)
    assert n <= bound * 1.02 + 1


def test_edge_cases(spark, tokenizer):
    rows = dicts(pack_documents(documents(spark), PATH))
    check(rows, [(i, t) for i, t, _ in DOCUMENTS], tokenizer)
    assert pack_documents(documents(spark, []), PATH).count() == 0


def test_lengths_out_of_range_are_refused(spark):
    for length in (0, 4097, None):
        with pytest.raises(ValueError, match="lengths"):
            pack(spark.createDataFrame([(1, length)], "id long, length long"))
