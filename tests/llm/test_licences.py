import re

import duckdb
import pytest

from faultweave.llm import licences
from faultweave.llm.catalog import ORACLE, op12_licence_scan
from faultweave.llm.common import table
from tests.compare import difference, spark_side, sql_side
from tests.llm.cases import DOCUMENTS, PROSE, dicts, documents

TEXTS = {x.label: x.text for x in licences.LICENCES if len(x.text.split()) > 30}


def scan(spark, texts):
    rows = [(i, t, None) for i, t in enumerate(texts)]
    scanned, name = licences.scan_licences(documents(spark, rows), carry=["doc_id"])
    return {r["doc_id"]: r[name].asDict(recursive=True) for r in dicts(scanned)}


def labels(spark, *texts):
    return [row["labels"] for _, row in sorted(scan(spark, texts).items())]


def plain(text):
    """Words and base places of a text by a regular expression."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [
        (k, label)
        for phrase, label in licences.NAMED
        for k in range(len(words))
        if words[k : k + len(phrase.split())] == phrase.split()
    ]
    return len(words), sorted(k for k, _ in found), sorted({label for _, label in found})


@pytest.mark.parametrize("label", sorted(TEXTS))
def test_a_licence_is_found_in_its_text(spark, label):
    text = TEXTS[label]
    shouted = text.upper().replace(" ", ",\n * ")
    holder = text.split()
    holder[-2:-2] = ["made", "up", "words"]
    got = labels(spark, text, f"{PROSE} {shouted} {PROSE}", " ".join(holder), f"{PROSE}\n" * 50 + text)
    assert all(label in found for found in got)


def test_what_is_not_a_licence(spark):
    mit = TEXTS["mit"]
    words = mit.split()
    shuffled = " ".join(sorted(words))
    apart = " ".join(w + " " + " ".join(["x"] * 20) for w in words)
    phrases = "permission is hereby granted free of charge and they restriction the without software in deal"
    got = labels(spark, shuffled, apart, phrases, mit.replace("free of charge", "for a fee"), "a free license", PROSE, "", None)
    assert got == [[]] * 8


def test_score_is_the_share_that_agrees(spark):
    text = TEXTS["isc"]
    words = text.split()
    (row,) = scan(spark, [" ".join([*words[:20], *["x"] * 40, *words[20:]])]).values()
    rare = sorted(set(words))[: licences.RARE]  # all equally rare, so in order of the alphabet
    assert row["labels"] == ["isc"] and row["score"] == len(set(rare) & set(words[:20])) / len(rare) < 1
    rows = scan(spark, [text, "the MIT license", PROSE])
    assert rows[0]["score"] == 1 and rows[1]["score"] == 1 and rows[2]["score"] == 0


def test_copies_and_repeats(spark):
    text = TEXTS["bsd"]
    assert labels(spark, *[text] * 30, f"{text} {text} " * 20) == [["bsd"]] * 31


def test_base_places(spark):
    texts = ["MIT License, mit-license MIT\nlicense mitlicense mit licenses", "general public license " * 3, "É ß 中文 mit  license"]
    for i, row in scan(spark, texts).items():
        n, places, base = plain(texts[i])
        assert (row["n_words"], sorted(row["places"]), row["base_labels"]) == (n, places, base)


def test_edge_cases(spark):
    scanned, name = licences.scan_licences(documents(spark))
    rows = dicts(scanned)
    assert len(rows) == len(DOCUMENTS) and set(documents(spark).columns) < set(scanned.columns)
    for row in rows:
        assert row[name].n_words == plain(row["text"])[0]
    assert licences.scan_licences(documents(spark, []))[0].count() == 0


def test_sql_on_licence_texts(spark, tmp_path):
    texts = [f"{PROSE} {t}" for t in TEXTS.values()] + [t[: len(t) // 2] for t in TEXTS.values()]
    texts += [" ".join(w for k, w in enumerate(t.split()) if k % 7) for t in TEXTS.values()]
    texts += [*TEXTS.values()] * 2 + ["Licensed under CC BY-NC 4.0.", "Apache License, Version 2.0", None, ""]
    df = documents(spark, [(i, t, None) for i, t in enumerate(texts)])
    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    ours = spark_side(spark, op12_licence_scan, str(tmp_path))
    assert difference(ours, sql_side(con, ORACLE["op12_licence_scan"])) == ""


def test_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    rows = dicts(op12_licence_scan(spark, sf_dir))
    assert len(rows) == len(texts)
    for row in rows:
        n, places, base = plain(texts[row["doc_id"]])
        assert (row["n_words"], row["n_base"], row["base_labels"]) == (n, len(places), ",".join(base))
        assert (row["first_word"], row["last_word"]) == ((places[0], places[-1]) if places else (None, None))


def test_no_python_runs(spark, sf_dir):
    plan = op12_licence_scan(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan
