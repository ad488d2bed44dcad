import re
from collections import defaultdict

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from faultweave.llm import mixing
from faultweave.llm.catalog import VOCABULARY
from faultweave.llm.common import table
from faultweave.llm.quality import measure
from faultweave.session import materialise
from tests.llm.cases import CLASHES, DOCUMENTS, LONG, PROSE, documents
from tests.llm.test_simhash import brute_components, brute_print


def test_stages_over_the_whole_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    stages = dict(corpus_pipeline.STAGES)
    before = {r.doc_id: r for r in docs.collect()}

    cleaned = materialise(stages["quality rules"](spark, docs, sf_dir))
    assert cleaned.columns == docs.columns
    good = {r.doc_id: r for r in cleaned.collect()}
    verdicts = {i: measure([r.text.encode()])[0] for i, r in before.items()}
    assert {i: r.text for i, r in good.items()} == {i: v[-1].decode() for i, v in verdicts.items() if v[6]}

    one = materialise(stages["simhash"](spark, cleaned, sf_dir))
    kept = {r.doc_id: r for r in one.collect()}
    ids = sorted(good)
    label = brute_components([brute_print(good[i].text) for i in ids])
    assert sorted(kept) == sorted({ids[c] for c in label})
    assert all(kept[i] == good[i] for i in kept)

    private = materialise(stages["pii"](spark, one, sf_dir))
    assert private.columns == docs.columns
    hidden = {r.doc_id: r for r in private.collect()}
    assert sorted(hidden) == sorted(kept)
    for i, row in hidden.items():
        assert row.n_chars == len(row.text)
        for mail in re.findall(r"[\w.]+@[\w.]+\w", kept[i].text):
            assert mail not in row.text

    mixed = materialise(stages["mixing"](spark, private, sf_dir))
    assert mixed.columns == docs.columns
    assert {r.doc_id: r for r in mixed.collect()} == hidden

    packed = stages["packing"](spark, mixed, sf_dir)
    total = defaultdict(int)
    for r in packed.collect():
        total[r.sequence_id] += r.length
    assert max(total.values()) <= 4096
    result = corpus_pipeline.run(spark, sf_dir)
    assert sorted(result.columns) == sorted(packed.columns)
    assert {r.doc_id for r in result.collect()} == set(hidden)


def test_edge_cases(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    good = [PROSE, PROSE.replace("alpha", "alfa"), LONG]
    texts = {good[c] for c in brute_components([brute_print(t) for t in good])}
    pieces = [len(tokenizer.encode(t, add_special_tokens=False).ids) // 4096 + 1 for t in texts]
    for rows, expected in (([], 0), (DOCUMENTS, sum(pieces))):
        docs = documents(spark, rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = materialise(stage(spark, docs, ""))
            assert set(CLASHES) <= set(docs.columns)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == expected


def test_the_mixture_decides_the_sequences(spark, sf_dir, monkeypatch):
    docs = table(spark, sf_dir, "documents").limit(400)
    docs = materialise(docs.withColumn("source", F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd")))
    pack = dict(corpus_pipeline.STAGES)["packing"]
    source = {r.doc_id: r.source for r in docs.collect()}

    def first_half(weights):
        monkeypatch.setattr(corpus_pipeline, "MIXTURE", {"weights": weights, "block_docs": 4})
        rows = pack(spark, docs, sf_dir).collect()
        place = {r.doc_id: r.position for r in mixing.places(docs, **corpus_pipeline.MIXTURE).collect()}
        least = {}
        for r in rows:
            least[r.sequence_id] = min(least.get(r.sequence_id, len(place)), place[r.doc_id])
        assert [least[s] for s in range(len(least))] == sorted(least.values())
        early = [r.doc_id for r in rows if r.sequence_id < len(least) / 2]
        return sum(source[i] == "even" for i in early) / len(early), {(r.doc_id, r.piece): r.sequence_id for r in rows}

    even, by_even = first_half({"even": 9, "odd": 1})
    odd, by_odd = first_half({"even": 1, "odd": 9})
    assert even > odd and by_even != by_odd
    assert by_even.keys() == by_odd.keys()


def test_the_mixture_reaches_run(spark, sf_dir, monkeypatch):
    docs = table(spark, sf_dir, "documents")
    names = sorted({r.source for r in docs.select("source").distinct().collect()})

    def run(first):
        monkeypatch.setattr(corpus_pipeline, "MIXTURE", {"weights": {s: 50 if s == first else 1 for s in names}})
        return {(r.doc_id, r.piece): (r.sequence_id, r.offset) for r in corpus_pipeline.run(spark, sf_dir).collect()}

    a, b = run(names[0]), run(names[-1])
    assert a.keys() == b.keys() and a != b
