from faultweave.llm.catalog import op6_repeated_passages
from faultweave.llm.common import table
from faultweave.llm.substring import MIN_WORDS, repeated_passages, units_of, without_passages
from tests.llm.cases import DOCUMENTS, PROSE, dicts, documents


def brute(docs, unit="sentence", min_words=MIN_WORDS):
    """{(doc_id, start, end, units, words)} of removed runs; docs are distinct (id, text) with ids."""
    first = {}
    units = {}
    for doc_id, text in sorted(docs):
        units[doc_id] = [(s, e, " ".join((text or "")[s:e].lower().split())) for s, e, _, _ in units_of(text or "", unit)]
        for place, (_, _, said) in enumerate(units[doc_id]):
            first.setdefault(said, (doc_id, place))
    runs = set()
    for doc_id, found in units.items():
        run = []
        for place, (s, e, said) in enumerate([*found, (0, 0, None)]):
            if said is not None and first[said] != (doc_id, place):
                run.append((s, e, said))
            elif run:
                words = sum(len(u[2].split()) for u in run)
                if words >= min_words:
                    runs.add((doc_id, run[0][0], run[-1][1], len(run), words))
                run = []
    return runs


def got(df):
    return {(r["doc_id"], r["start"], r["end"], r["n_units"], r["n_words"]) for r in dicts(df)}


PASSAGE = " ".join(f"Passage {i} of the shared text goes on and on." for i in range(8))


def rows_of(n):
    return [(i, f"Own start {i} of it. {PASSAGE}\nAnd document {i} ends its own way.", "a") for i in range(n)]


def test_units():
    text = "One 1.5 two. Three!  Four\n\n Fünf… 😀 six? "
    assert [text[s:e] for s, e, _, _ in units_of(text)] == ["One 1.5 two.", "Three!", "Four", "Fünf… 😀 six?"]
    assert [text[s:e] for s, e, _, _ in units_of(text, "line")] == ["One 1.5 two. Three!  Four", " Fünf… 😀 six? "]
    blocks = "a\nb\n \nc"
    assert [blocks[s:e] for s, e, _, _ in units_of(blocks, "paragraph")] == ["a\nb", "c"]


def test_inline_passages(spark):
    rows = rows_of(12)
    docs = documents(spark, rows)
    found = repeated_passages(docs)
    assert got(found) == brute([(i, t) for i, t, _ in rows])
    assert {r["doc_id"] for r in dicts(found)} == set(range(1, 12))
    assert all(rows[r["doc_id"]][1][r["start"] : r["end"]] == PASSAGE for r in dicts(found))
    assert {r["first_doc_id"] for r in dicts(found)} == {0}
    cleaned = {r["doc_id"]: r for r in dicts(without_passages(docs))}
    assert cleaned[0]["text"] == rows[0][1]
    assert cleaned[5]["text"] == "Own start 5 of it. \nAnd document 5 ends its own way."
    assert cleaned[5]["n_chars"] == len(cleaned[5]["text"])


def test_short_repeats_go_unless_asked_otherwise(spark):
    rows = [(i, f"Unique words {i} here {i * 7}. All rights reserved.", "a") for i in range(20)]
    found = repeated_passages(documents(spark, rows))
    assert got(found) == brute([r[:2] for r in rows]) and found.count() == 19
    assert repeated_passages(documents(spark, rows), min_words=25).count() == 0


def test_sentences_find_lines_and_paragraphs(spark, sf_dir):
    """What whole lines or paragraphs repeat lies in the runs that sentences give."""
    docs = table(spark, sf_dir, "documents")
    inside = {}
    for r in dicts(repeated_passages(docs)):
        inside.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for unit in ("line", "paragraph"):
        for r in dicts(repeated_passages(docs, unit=unit)):
            kept = list(texts[r["doc_id"]][r["start"] : r["end"]])
            for start, end in inside[r["doc_id"]]:
                low, high = max(start - r["start"], 0), max(end - r["start"], 0)
                kept[low:high] = " " * len(kept[low:high])
            assert not "".join(kept).strip()


def test_whole_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    assert got(op6_repeated_passages(spark, sf_dir)) == brute(docs)


def test_lines_and_paragraphs(spark):
    text = "\n".join(f"Line {i} of a poem that is known to all of us" for i in range(5))
    rows = [(1, text, "a"), (2, "New.\n\n" + text + "\n\nEnd.", "b")]
    for unit in ("line", "paragraph"):
        assert got(repeated_passages(documents(spark, rows), unit=unit)) == brute([r[:2] for r in rows], unit)


def test_edge_cases(spark):
    docs = documents(spark)
    found = dicts(repeated_passages(docs, min_words=2))
    # 1 is the first of the equal texts; the two rows of 3 are one document, and 7 repeats its line
    assert sorted(str(r["doc_id"]) for r in found) == ["2", "7", "None"]
    rows = dicts(without_passages(docs, min_words=10))
    assert len(rows) == len(DOCUMENTS)
    assert {r["doc_id"]: r["text"] for r in rows if r["doc_id"] in (1, 2, 4, 5)} == {1: PROSE, 2: "", 4: None, 5: ""}
    assert without_passages(documents(spark, [])).count() == 0
    assert without_passages(docs).columns == docs.columns
