"""Tickets by job name, and the ends of logs."""

import json

import pytest
from pyspark.sql import functions as F

from faultweave.operators import logs as log_ops
from faultweave.operators import tickets as ticket_ops
from faultweave.operators.scripts import script_lookup
from faultweave.session import scratch_path
from faultweave.sources.logs import read_logs
from faultweave.sources.scripts import read_scripts
from faultweave.sources.tickets import read_tickets

TICKETS = [
    {"key": "T-0", "summary": "dbs_load fails", "description": "x", "labels": []},
    {"key": "T-1", "summary": "y", "description": "Job DBS_LOADER", "labels": ["a"]},
    {"ticket_key": "T-2", "summary": "z", "description": "", "labels": ["night", "batch"]},
    {"key": "T-3", "summary": None, "labels": ["DBS_LOAD"]},
    {"key": "T-4", "summary": "DBS_load", "description": "dbs_load dbs_load", "labels": None},
]
NAMES = ["DBS_LOAD", "dbs_loader", "night batch", "absent", "", "d", "DBS_LOAD"]


def brute(names, n):
    out = []
    for name in {x.lower() for x in names if x}:
        hits = []
        for seq, t in enumerate(TICKETS):
            fields = (t.get("summary") or "", t.get("description") or "", " ".join(t.get("labels") or []))
            if any(name in f.lower() for f in fields):
                hits.append(seq)
        out += [(name, rank, seq, len(hits)) for rank, seq in enumerate(hits[:n], 1)]
    return sorted(out)


@pytest.mark.parametrize("chars", [1 << 20, 8, 1])
def test_matches_equal_brute_force_with_few_and_many_names(spark, tmp_path, chars):
    path = tmp_path / "tickets.json"
    path.write_text(json.dumps(TICKETS))
    tickets = read_tickets(spark, str(path), "array").repartition(3)
    jobs = spark.createDataFrame([(n,) for n in NAMES], "job_name string")
    got = ticket_ops.ticket_matches(jobs, tickets, 2, name_chars=chars).collect()
    assert sorted((r.name, r["rank"], r.seq, r.total) for r in got) == brute(NAMES, 2)


def test_no_job_names(spark, tmp_path):
    path = tmp_path / "tickets.json"
    path.write_text(json.dumps(TICKETS))
    jobs = spark.createDataFrame([("",)], "job_name string")
    assert ticket_ops.ticket_matches(jobs, read_tickets(spark, str(path), "array")).count() == 0


def test_tickets_per_incident(spark, tmp_path):
    path = tmp_path / "tickets.json"
    path.write_text(json.dumps(TICKETS))
    tickets = read_tickets(spark, str(path), "array")
    inc = spark.createDataFrame([(1, "DBS_LOAD"), (2, "dbs_load"), (3, "none")], "request_id long, job_name string")
    got = ticket_ops.ticket_match(inc, tickets).collect()
    assert sorted((r.request_id, r["rank"], r.seq, r.total) for r in got) == [
        (q, i + 1, s, 4) for q in (1, 2) for i, s in enumerate((0, 1, 3))
    ]


def test_first_n_in_order(spark):
    rows = [("hot", i) for i in range(100)] + [("cold", 7)]
    got = ticket_ops.first_n_in_order(spark.createDataFrame(rows, "name string, seq long"), 2).collect()
    assert sorted((r.name, r["rank"], r.seq, r.total) for r in got) == [
        ("cold", 1, 7, 1),
        ("hot", 1, 0, 100),
        ("hot", 2, 1, 100),
    ]


@pytest.fixture
def log_folder(tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "long+name 1.log").write_text("".join(f"[{i}] line {'x' * (i % 17)}\n" for i in range(1, 400)))
    (folder / "crlf.log").write_bytes(b"a\r\nb\r\n\r\nc")
    (folder / "empty.log").write_text("")
    return str(folder)


@pytest.mark.parametrize("split", ["134217728", "300"])
def test_line_numbers_across_splits(spark, log_folder, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = read_logs(spark, log_folder).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    long = sorted((r.line_no, r.line) for r in rows if r.log_name == "long+name 1.log")
    assert long == [(i, f"[{i}] line {'x' * (i % 17)}") for i in range(1, 400)]
    assert sorted((r.line_no, r.line) for r in rows if r.log_name == "crlf.log") == [
        (1, "a"),
        (2, "b"),
        (3, ""),
        (4, "c"),
    ]


def test_tail(spark, log_folder):
    manifest = spark.createDataFrame([("empty.log",), ("crlf.log",), ("long+name 1.log",)], "log_name string")
    got = {r.log_name: r for r in log_ops.log_tail(read_logs(spark, log_folder), 2, manifest).collect()}
    assert (got["crlf.log"].content, got["crlf.log"].total_lines, got["crlf.log"].returned_lines) == ("\nc\n", 4, 2)
    assert (got["empty.log"].content, got["empty.log"].total_lines) == ("", 0)
    assert got["long+name 1.log"].total_lines == 399
    with pytest.raises(ValueError):
        log_ops.log_tail(read_logs(spark, log_folder), 0)


def test_scripts(spark, tmp_path):
    folder = tmp_path / "scripts"
    folder.mkdir()
    (folder / "a.py").write_bytes(b"x = 1\r\ny = 2\n")
    manifest = spark.createDataFrame([("a.py", "755")], "name string, permissions string")
    row = read_scripts(spark, str(folder), manifest).first()
    assert (row.name, row.content, row.size, row.permissions) == ("a.py", "x = 1\ny = 2\n", 13, "755")
    assert abs(row.modified - (folder / "a.py").stat().st_mtime) < 1e-3
    assert read_scripts(spark, str(folder)).first().permissions is None


def test_lines_must_be_cut_as_they_were_counted(spark, log_folder):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        rows = read_logs(spark, log_folder)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    with pytest.raises(Exception, match="cut otherwise"):
        rows.collect()


def test_only_a_part_of_a_script_is_carried(spark):
    wanted = spark.createDataFrame([("J", None)], "job_name string, script_name string")
    have = spark.createDataFrame([("J.py", "abcdef", "755")], "name string, content string, permissions string")
    row = script_lookup(wanted, have, 3).first()
    assert (row.config_content, row.node_content, row.on_node) == ("abc", "abc", True)


def test_scratch_paths_differ(spark):
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_tickets_from_lines(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text("\n".join(json.dumps({"seq": i, **t}) for i, t in enumerate(TICKETS)))
    rows = read_tickets(spark, str(path)).orderBy("seq").select("seq", F.coalesce("key", "ticket_key")).collect()
    assert [tuple(r) for r in rows] == [(i, f"T-{i}") for i in range(5)]
    with pytest.raises(ValueError):
        read_tickets(spark, str(path), "xml")


@pytest.mark.parametrize("text", ['{"key": "T-0"}', "[1, 2", '[{"key": "T-0"}', "null", "x"])
def test_broken_ticket_files_are_errors(spark, tmp_path, text):
    path = tmp_path / "t.json"
    path.write_text(text)
    with pytest.raises(Exception):  # noqa: B017
        read_tickets(spark, str(path), "array").collect()
    with pytest.raises(Exception):  # noqa: B017
        read_tickets(spark, str(path)).select("seq", "key").collect()


def test_arrays_of_several_files_are_numbered_in_a_row(spark, tmp_path):
    for name, part in (("b", TICKETS[3:]), ("a", TICKETS[:3])):
        (tmp_path / f"{name}.json").write_text(json.dumps(part))
    rows = read_tickets(spark, str(tmp_path), "array").select("seq", F.coalesce("key", "ticket_key")).collect()
    assert sorted(map(tuple, rows)) == [(i, f"T-{i}") for i in range(5)]
    (tmp_path / "c.json").write_text("[]")
    assert read_tickets(spark, str(tmp_path), "array").count() == 5


def test_kept_matches_spare_the_tickets(spark, tmp_path):
    path, kept = tmp_path / "tickets.json", scratch_path(spark, "kept")
    path.write_text(json.dumps(TICKETS))
    tickets = read_tickets(spark, str(path), "array")
    broken = tickets.withColumn("summary", F.raise_error(F.lit("tickets were read")).cast("string"))

    def ask(names, source, owner):
        asked = spark.createDataFrame([(n,) for n in names], "job_name string")
        rows = ticket_ops.kept_ticket_matches(asked, source, kept, owner, 2).collect()
        return sorted((r.name, r["rank"], r.seq, r.total) for r in rows)

    assert ask(NAMES[:4], tickets, 0) == brute(NAMES[:4], 2)
    # known names, also one without a match, need no tickets; a repeated owner finds them anew
    assert ask(NAMES[1:4], broken, 1) == brute(NAMES[1:4], 2)
    assert ask(NAMES, tickets, 2) == brute(NAMES, 2)
    assert ask(NAMES[:4], tickets, 0) == brute(NAMES[:4], 2)
    with pytest.raises(Exception, match="tickets were read"):
        ask(["new name"], broken, 3)
