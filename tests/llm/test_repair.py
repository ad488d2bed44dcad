import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from faultweave.llm import repair, trails
from faultweave.llm.catalog import op11_conversation_repair
from faultweave.llm.common import table
from faultweave.llm.trails import Step, Trails

WHITE = " \t\n\v\f\r"
AFTER = {"": "u", "s": "u", "u": "a", "a": "u"}
FULL = {"u": "user", "a": "assistant"}
NAMES = ("conv_id", *repair.COUNTS, "audit", "repaired_sha256")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        said = [" " if v is None else str(v) for v in (conv, turn, role, text)]
        draw = zlib.crc32(f"{said[0]}:{said[1]}".encode()) % 20
        role = "user" if draw == 4 else said[2]
        text = "" if draw == 1 else re.sub("[.!?]", "", said[3]) if draw == 2 else said[3]
        out += [(conv, turn, role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    return out


def inserted(best):
    """The prefixes with up to three more insertions."""
    best = dict(best)
    for _ in range(3):
        for state, (cost, audit, lines) in list(best.items()):
            way = (cost + 3, audit + "I", lines + (FULL[AFTER[state]] + ":",))
            best[AFTER[state]] = min(way, best.get(AFTER[state], way))
    return best


def repaired(rows):
    """Counts, cost, audit and hash of one conversation by comparing whole strings."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3].encode()))
    best, seen, faults = {"": (0, "", ())}, set(), []
    for _, _, role, text in rows:
        end = text.strip(WHITE)[-1:]
        fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else ""
        faults.append(fault)
        seen.add((role, text))
        new = {}

        def put(state, way, new=new):
            new[state] = min(way, new.get(state, way))

        for state, (cost, audit, lines) in inserted(best).items():
            put(state, (cost + 4, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            initial = role[:1]
            if AFTER[state] == initial or (initial == "s" and state == "" and not lines):
                put(initial, (cost + more, audit + "K", (*lines, f"{role}:{text}")))
            put(AFTER[state], (cost + more + 3, audit + "R", (*lines, f"{FULL[AFTER[state]]}:{text}")))
        best = new
    cost, audit, lines = min(way for state, way in inserted(best).items() if state in ("", "a"))
    turns = {r[1] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def by_force(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[0]].append(row)
    return {conv: repaired(group) for conv, group in groups.items()}


def found(spark, rows):
    schema = "conv_id long, turn long, role string, text string"
    extra = ["segment", "part", "section", "_n", "_key", "audit", "whole", "missing", "costs"]
    schema = ", ".join([schema, *[f"{c} string" for c in extra]])
    df = spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], schema)
    return {r.conv_id: tuple(r[c] for c in NAMES[1:]) for r in repair.digest(repair.repair_conversations(df)).collect()}


def conversations(seed, n, longest):
    pick = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(pick.randint(1, longest)):
            role = pick.choice(["user", "assistant", "user", "assistant", "system", "tool", " "])
            text = pick.choice(["One.", "Two!", "Three", "", " \t", "Four?  ", "a\nb."]) + str(pick.randint(0, 3))[: pick.randint(0, 1)]
            rows.append((conv, pick.choice([turn, turn, turn + 2, None]), role, text))
    return rows


@pytest.mark.parametrize(("size", "longest"), [(4096, 9), (2, 9), (1, 4), (3, 60)])
def test_equals_brute_force(spark, monkeypatch, size, longest):
    monkeypatch.setattr(repair, "SEGMENT_ROWS", size)
    rows = conversations(size + longest, 40, longest)
    assert found(spark, rows) == by_force(rows)


def test_nulls_copies_and_long_texts(spark):
    rows = [(1, None, None, None), (1, 0, "user", "x" * 300_000 + "."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes.")]
    rows += [(2, 7, "user", "Same.")] * 500 + [(2, 8, "assistant", None)] + [(3, None, "system", "Only.")] * 2
    rows += [(4, 0, "", "No role."), (4, 1, "assistant", "Yes.")]
    said = [tuple(" " if v is None and k > 1 else v for k, v in enumerate(r)) for r in rows]
    expected = by_force(said)
    got = found(spark, rows)
    assert {k: got[k] for k in (1, 2, 3)} == {k: expected[k] for k in (1, 2, 3)}
    # an empty role cannot be kept
    assert got[4][-2] == "RK"
    assert found(spark, []) == {}


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    expected = {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for conv, *_ in rows} | by_force(damaged(rows))
    got = {r.conv_id: tuple(r[c] for c in NAMES[1:]) for r in op11_conversation_repair(spark, sf_dir).collect()}
    assert got == expected
    assert op11_conversation_repair(spark, sf_dir).columns == list(NAMES)


def test_everything_dropped(spark, tmp_path):
    turn = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    schema = T.StructType.fromDDL("conv_id long, turn long, role string, text string")
    spark.createDataFrame([(5, turn, "user", "Gone.")], schema).write.parquet(f"{tmp_path}/conversations.parquet")
    (row,) = op11_conversation_repair(spark, str(tmp_path)).collect()
    assert tuple(row) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_repaired_rows_alternate(spark, sf_dir):
    for row in repair.repair_conversations(repair.damage(table(spark, sf_dir, "conversations"))).collect():
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in row.repaired))


@pytest.mark.parametrize("modulus", [trails.MODULUS, 97, 2, 1])
def test_collisions_do_not_decide(modulus):
    """Comparisons agree with those of whole strings, whatever the hashes are worth."""
    pick = random.Random(modulus)
    paths, texts = Trails(modulus), {0: ""}
    for _ in range(400):
        parent = pick.choice(list(texts))
        node = paths.add(parent, edit := pick.choice("DIKR"))
        texts[node] = texts[parent] + edit
    assert all(paths.text(n) == t for n, t in texts.items())
    for _ in range(4000):
        a, b = pick.choices(list(texts), k=2)
        assert paths.less(a, b) == (texts[a] < texts[b])


def test_segments_compose():
    pick = random.Random(5)
    for _ in range(200):
        steps = [Step(pick.choice("suaat "), pick.random() < 0.2, pick.random() < 0.2, 0) for _ in range(pick.randint(1, 9))]
        paths = Trails()
        ends = trails.run(steps, trails.START, paths)
        whole = [-1 if e is None else e[0] for e in ends]
        cut = pick.randint(1, len(steps))
        costs, rank = [0, -1, -1, -1], [0] * 4
        for part in filter(None, (steps[:cut], steps[cut:])):
            costs, rank, _ = trails.compose(costs, rank, trails.summarise(part, range(4)))
        assert costs == whole
        assert trails.best_end(costs, rank) == trails.best_end(whole, trails.ranks(ends, paths))


def test_long_runs_keep_linked_prefixes():
    """Twenty thousand rows whose every edit is a tie take one node per way."""
    paths = Trails()
    steps = [Step("x", False, False, 0)] * 20_000
    ends = trails.run(steps, trails.START, paths)
    assert len(paths.edit) < 14 * len(steps)
    assert len(paths.text(ends[trails.ASSISTANT][1])) >= len(steps)
