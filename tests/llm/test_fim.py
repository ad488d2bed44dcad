import hashlib
import random
import re

import pytest

from faultweave.llm import fim
from faultweave.llm.common import table
from faultweave.llm.catalog import op13_fill_in_middle
from tests.llm.cases import DOCUMENTS, dicts, documents


def by_force(text, key):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(key.encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text.encode()
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}".encode()
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}".encode()


@pytest.mark.parametrize("window", [1, 3, 7, 1 << 20])
def test_chunks_equal_brute_force(monkeypatch, window):
    monkeypatch.setattr(fim, "WINDOW", window)
    pick = random.Random(window)
    pieces = ["a", "b", "Z", " ", "é", "😀", "\n", "<", "P", ">", "S>", "<M", "中", "\0"]
    for _ in range(150):
        texts = ["".join(pick.choices(pieces, k=pick.choice([0, 1, 2, 5, 40]))) for _ in range(pick.randint(1, 12))]
        keys = [f"1:{pick.randint(0, 10**6)}" for _ in texts]
        rows = fim.transform_chunk([t.encode() for t in texts], keys)
        assert rows == [by_force(t, k) for t, k in zip(texts, keys)]
        assert fim.restore_chunk([r[4] for r in rows], [r[1] for r in rows]) == [t.encode() for t in texts]


def test_edge_cases(spark):
    made, parts = fim.transform(documents(spark))
    rows = dicts(made)
    assert len(rows) == len(DOCUMENTS)
    for row in rows:
        key = "1:" if row["doc_id"] is None else f"1:{row['doc_id']}"
        got = row[parts].asDict()
        assert (got["n"], got["form"], got["prefix_chars"], got["middle_chars"], got["output"].encode()) == by_force(row["text"] or "", key)
    assert fim.transform(documents(spark, []))[0].count() == 0


def test_restoring_keeps_other_columns(spark):
    rows = [("<P>a<S>c<M>b", "psm", 1), ("<S>c<P>a<M>b", "spm", 2), (None, None, 4), ("x", None, 5), ("<P>", "plain", 6)]
    df = spark.createDataFrame(rows, "output string, form string, restored int")
    out, name = fim.restore(df, "output", "form")
    assert name != "restored"
    assert {r["restored"]: r[name] for r in out.collect()} == {1: "abc", 2: "abc", 4: "", 5: "x", 6: "<P>"}


def test_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in table(spark, sf_dir, "documents").collect()}
    rows = dicts(op13_fill_in_middle(spark, sf_dir))
    assert len(rows) == len(texts)
    for row in rows:
        *facts, output = by_force(texts[row["doc_id"]], f"1:{row['doc_id']}")
        assert [row[c] for c in ("n", "form", "prefix_chars", "middle_chars")] == facts
        assert row["output_sha256"] == hashlib.sha256(output).hexdigest()
        assert row["restored_sha256"] == hashlib.sha256(texts[row["doc_id"]].encode()).hexdigest()
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}
