import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from faultweave.llm.quality import FIELDS, keep_good, line_first, measure
from tests.llm.cases import DOCUMENTS, LONG, PROSE, WORDS, dicts, documents


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), symbols, dups, len(covered), failed


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab é#\n\t\x1c\xa0😀", max_size=120), min_size=1, max_size=5))
def test_base_figures(texts):
    assert [m[:6] for m in measure([t.encode() for t in texts])] == [brute(t) for t in texts]


@pytest.mark.parametrize(
    ("line", "stays"),
    [
        ("A line that ends well.", True),
        ("Home", False),
        ("A long line of prose without an end mark still has its twelve words", True),
        ("Home | News | Sport | About.", False),
        ("This is about our privacy policy.", False),
        ("costs $$ %% ## and ** so on.", False),
        ("THIS IS SHOUTED AT ALL OF YOU.", False),
        ("the the the the the the the the end.", False),
        ("«Ça va ?», dit-il…", True),
        ("", True),
    ],
)
def test_lines(line, stays):
    n_removed = measure([line.encode()])[0][FIELDS.names.index("n_lines_removed")]
    assert (n_removed == 0) == stays


def test_documents_that_lose_too_much_go(spark):
    other = " ".join(reversed(WORDS)) + " and more of it."
    good = "\n".join([PROSE, "Menu", other])
    bad = "\n".join([PROSE, *["Menu item without end here"] * 10])
    kept = dicts(keep_good(documents(spark, [(1, good, "a"), (2, bad, "a")])))
    assert [(r["doc_id"], r["text"], r["n_chars"]) for r in kept] == [(1, good.replace("Menu\n", ""), len(good) - 5)]


def test_edge_cases(spark):
    docs = documents(spark)
    judged, verdict = line_first(docs)
    rows = dicts(judged)
    assert judged.columns == [*docs.columns, verdict] and verdict == "_quality"
    assert len(rows) == len(DOCUMENTS)
    for row in rows:
        found = row[verdict]
        assert tuple(found[n] for n in FIELDS.names[:6]) == brute(row["text"] or "")
        assert found["kept"] == (row["text"] in (LONG, PROSE, PROSE.replace("alpha", "alfa")))
    assert keep_good(documents(spark, [])).count() == 0
    assert keep_good(docs).columns == docs.columns
