"""Exports, the store, and streams into it."""

from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultweave.functions.vectors import encoder_embedding, md5_embedding
from faultweave.schemas import STORE
from faultweave.session import dropping_tables, materialise, scratch_path
from faultweave.sources import exports, store
from faultweave.sources.vectors import embed_kept
from faultweave.streaming.store import _first_rows, store_stream, store_stream_by_state


def docs(spark, rows):
    return spark.createDataFrame(rows, "ticket_id string, summary string, resolution string, seq long")


def ids(spark, path):
    return sorted((r.id, r.document) for r in store.read_store(spark, path).collect())


def test_headers_in_upper_and_lower_case(spark):
    columns = ("ticket_id", "job_name", "JOB_NAME", "DESCRIPTION", "RESOLVED_DATE")
    raw = spark.createDataFrame([("1", "low", "UP", "D", None)], ", ".join(f"{c} string" for c in columns))
    row = exports.resolve_headers(raw).first()
    assert (row.ticket_id, row.job_name, row.summary, row.incident_details, row.description) == ("1", "low", "D", "D", "D")
    assert (row.failure_type, row.resolved_at, row.command) == ("unknown", "", "")


def test_blank_ids_are_dropped(spark):
    raw = spark.createDataFrame([("",), (None,), ("x",)], "INCIDENT_ID string")
    assert [r.ticket_id for r in exports.drop_blank_ids(exports.resolve_headers(raw)).collect()] == ["x"]


def test_export_formats(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('INCIDENT_ID,Summary Text\n1,"a, ""b"""\n')
    row = exports.read_incident_export(spark, str(path), "csv", schema=None).first()
    assert tuple(row) == ("1", 'a, "b"')
    path.write_text('JOB_NAME,INCIDENT_ID,MTTD\nDBS_A,INC-1,x\nDBS_B,,7\n')
    rows = exports.read_incident_export(spark, str(path), "csv").collect()
    assert [(r.INCIDENT_ID, r.JOB_NAME, r.MTTD, r.SUMMARY) for r in rows] == [
        ("INC-1", "DBS_A", None, None),
        (None, "DBS_B", 7, None),
    ]
    with pytest.raises(ValueError):
        exports.read_incident_export(spark, str(path), "json", schema=None)
    with pytest.raises(ValueError):
        exports.read_incident_export(spark, str(path), "xlsx")


def test_adding_twice_changes_nothing(spark):
    path = scratch_path(spark, "store")
    store.recreate(spark, path)
    first = store.store_documents(docs(spark, [("a", "1", "", 0), ("b", "2", "", 1)]))
    assert store.append_new(spark, path, first, md5_embedding) == 2
    assert store.append_new(spark, path, first, md5_embedding) == 0
    again = store.store_documents(docs(spark, [("b", "other", "", 0), ("c", "3", "", 1)]))
    assert store.append_new(spark, path, again, md5_embedding) == 1
    assert ids(spark, path) == [("a", "1"), ("b", "2"), ("c", "3")]
    assert store.read_store(spark, path).schema == STORE
    store.recreate(spark, path)
    assert store.store_count(store.read_store(spark, path)) == 0


def test_a_store_is_made_when_absent(spark):
    path = scratch_path(spark, "store")
    rows = store.store_documents(docs(spark, [("a", "1", "", 0)]))
    assert store.append_new(spark, path, rows.limit(0), md5_embedding) == 0
    assert store.append_new(spark, path, rows, md5_embedding) == 1
    assert ids(spark, path) == [("a", "1")]


def test_widths_and_ids_are_checked(spark):
    path = scratch_path(spark, "store")
    rows = store.store_documents(docs(spark, [("a", "1", "", 0), ("b", "2", "", 1)]))
    assert store.append_new(spark, path, rows.where("id = 'a'"), md5_embedding) == 1
    wide = rows.withColumn("embedding", F.array_repeat(F.lit(0.0), 9))
    with pytest.raises(Exception, match="other than 8"):
        store.append_new(spark, path, wide)
    mixed = rows.withColumn("embedding", F.array_repeat(F.lit(0.0), F.when(F.col("id") == "a", 3).otherwise(4)))
    with pytest.raises(Exception, match="other than"):
        store.append_new(spark, scratch_path(spark, "store"), mixed)
    with pytest.raises(Exception, match="other than 8"):
        store.append_new(spark, path, rows.withColumn("embedding", F.lit(None).cast("array<double>")))
    with pytest.raises(ValueError, match="no id"):
        store.append_new(spark, path, rows.withColumn("id", F.lit(None).cast("string")), md5_embedding)
    assert ids(spark, path) == [("a", "1")]


def test_repeated_ids(spark):
    path = scratch_path(spark, "store")
    store.recreate(spark, path)
    rows = store.store_documents(docs(spark, [("a", "late", "", 5), ("a", "early", "", 2)]))
    with pytest.raises(ValueError):
        store.append_new(spark, path, rows, md5_embedding)
    assert store.append_new(spark, path, rows, md5_embedding, repeats="first") == 1
    assert ids(spark, path) == [("a", "early")]


def test_ids_default_to_the_place(spark):
    rows = docs(spark, [("a", "1", "", 0), ("b", "2", "", 1)])
    assert sorted(r.id for r in store.store_documents(rows.drop("ticket_id")).collect()) == ["0", "1"]
    with pytest.raises(ValueError):
        store.store_documents(rows.drop("ticket_id", "seq"))


def test_sync_takes_both_ends(spark):
    path = scratch_path(spark, "store")
    store.recreate(spark, path)
    rows = spark.createDataFrame(
        [("a", "2024-01-01"), ("b", "2024-01-31"), ("c", "2024-02-01"), ("", "2024-01-05")],
        "ticket_id string, resolved_at string",
    )
    assert tuple(store.sync_range(spark, path, rows, "2024-01-01", "2024-01-31", md5_embedding).first()) == ("synced", 2, 2)
    assert tuple(store.sync_range(spark, path, rows, "2024-01-31", "2024-02-01", md5_embedding).first()) == ("synced", 2, 1)
    timed = rows.withColumn("resolved_at", F.concat("resolved_at", F.lit(" 23:59:59")))
    assert store.sync_range(spark, path, timed, "2024-01-31", "2024-02-01", md5_embedding).first().tickets_added == 2
    assert store.sync_range(spark, path, rows, "2030", "2031", md5_embedding).first().status == "no tickets found"


def test_feed_stream_survives_a_replay(spark):
    inbox, path = scratch_path(spark, "inbox"), scratch_path(spark, "store")
    store.recreate(spark, path)
    raw = spark.createDataFrame(
        [("a", "x", 1), ("a", "first", 0), ("", "y", 2), ("b", "z", 3)], "INCIDENT_ID string, SUMMARY string, seq long"
    )
    raw.write.parquet(inbox)
    for _ in range(2):
        # A new checkpoint folder makes the stream start over, as after a lost one.
        feed = spark.readStream.schema(raw.schema).parquet(inbox)
        store_stream(feed, path, md5_embedding, scratch_path(spark, "state")).awaitTermination()
    assert ids(spark, path) == [("a", "first"), ("b", "z")]


def test_stream_batches_drop_their_tables(spark):
    path, made = scratch_path(spark, "store"), []
    store.recreate(spark, path)
    rows = store.store_documents(docs(spark, [("a", "1", "", 0)]))
    with dropping_tables(spark):
        store.append_new(spark, path, rows, md5_embedding)
        kept = materialise(rows, "kept")
        made.append(kept.inputFiles()[0].removeprefix("file://"))
        assert Path(made[0]).exists()
    assert not Path(made[0]).exists()
    assert ids(spark, path) == [("a", "1")]
    assert Path(materialise(rows).inputFiles()[0].removeprefix("file://")).exists()


def test_union_matches_by_name(spark):
    a = spark.createDataFrame([("1", "x")], "a string, b string")
    b = spark.createDataFrame([("y", "2")], "b string, a string")
    assert sorted(map(tuple, exports.union_batches([a, b]).collect())) == [("1", "x"), ("2", "y")]


def test_only_new_rows_are_embedded(spark):
    path = scratch_path(spark, "store")
    store.recreate(spark, path)
    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda t: (seen.add(1), [0.0])[1], "array<double>")
    rows = store.store_documents(docs(spark, [(str(i), "x", "", i) for i in range(20)]))
    store.append_new(spark, path, rows.where("seq < 15"), lambda t: count(t))
    store.append_new(spark, path, rows, lambda t: count(t))
    assert seen.value == 20


def test_sync_days_reach_the_files(spark):
    path = scratch_path(spark, "dated")
    days = [f"2024-{m:02d}-{d:02d}" for m in (1, 2) for d in range(1, 32)]
    rows = [(f"{day}{time}",) for day in days for time in ("", " 00:00:00", "T23:59:59.9")]
    spark.createDataFrame(rows, "resolved_at string").write.parquet(path)
    read = spark.read.parquet(path).where(store.in_days(F.col("resolved_at"), "2024-01-09", "2024-01-19 12:00"))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(resolved_at,2024-01-09), LessThan(resolved_at,2024-01" in plan
    assert sorted({r[0][:10] for r in read.collect()}) == [f"2024-01-{d:02d}" for d in range(9, 20)]
    assert read.count() == 33


def test_a_text_is_embedded_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def make_encoder():
        import uuid

        import numpy as np

        def encode(texts):
            (calls / uuid.uuid4().hex).write_text("\n".join(texts))
            return np.array([[len(t), 1.0] for t in texts])

        return encode

    def asked():
        return sorted(t for f in calls.iterdir() for t in f.read_text().split("\n"))

    embed, path = encoder_embedding(make_encoder, normalise=False), f"{tmp_path}/vectors"
    first = spark.createDataFrame([(i, f"text {i % 3}") for i in range(30)], "id long, t string")
    rows = embed_kept(first, "t", embed, path, owner="0").collect()
    assert len(rows) == 30 and all(r.embedding == [6.0, 1.0] for r in rows) and asked() == ["text 0", "text 1", "text 2"]
    more = spark.createDataFrame([(1, "text 1"), (2, "new"), (3, "new")], "id long, t string")
    for _ in range(2):  # known texts are read, and so are those of a call that is done again by another owner
        assert {r.t: r.embedding for r in embed_kept(more, "t", embed, path).collect()} == {"text 1": [6.0, 1.0], "new": [3.0, 1.0]}
    assert asked() == ["new", "text 0", "text 1", "text 2"]
    assert embed_kept(first.limit(0), "t", embed, path).count() == 0


def test_append_with_kept_vectors(spark, tmp_path):
    rows = store.store_documents(docs(spark, [("a", "1", "", 0), ("b", "2", "", 1)]))
    plain, kept = scratch_path(spark, "plain"), scratch_path(spark, "kept")
    store.append_new(spark, plain, rows, md5_embedding)
    for _ in range(2):
        store.append_new(spark, kept, rows, md5_embedding, vectors=f"{tmp_path}/vectors")
    read = lambda path: sorted(map(str, store.read_store(spark, path).collect()))
    assert read(plain) == read(kept)


def test_sync_since_reads_only_what_is_new(spark):
    path, marks = scratch_path(spark, "store"), scratch_path(spark, "marks")
    rows = [("a", "2024-01-01"), ("b", "2024-01-31 10:00"), ("", "2024-01-05")]
    make = lambda rows: spark.createDataFrame(rows, "ticket_id string, resolved_at string")
    sync = lambda rows: tuple(store.sync_since(spark, path, make(rows), md5_embedding, marks).first())
    assert sync(rows) == ("synced", 2, 2)
    assert sync(rows) == ("no tickets found", 0, 0)
    assert sync([*rows, ("c", "2024-01-31 10:01"), ("b", "2024-02-01")]) == ("synced", 2, 1)
    assert sync(rows) == ("no tickets found", 0, 0)


def test_feed_by_state_adds_an_id_once(spark):
    inbox, path, state = (scratch_path(spark, n) for n in ("inbox", "store", "state"))
    schema = "INCIDENT_ID string, SUMMARY string, seq long"
    batches = [[("a", "x", 1), ("a", "first", 0), ("", "y", 2), ("b", "z", 3)], [("a", "later", 9), ("c", "w", 4)], [("c", "w2", 0)]]
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{inbox}/{k}")
        feed = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(inbox)
        store_stream_by_state(feed, path, md5_embedding, state).awaitTermination()
    assert ids(spark, path) == [("a", "first"), ("b", "z"), ("c", "w")]


def test_known_ids_cost_no_look_at_their_rows():
    class State:
        hasTimedOut, exists, updates = False, False, 0

        def update(self, value):
            self.exists, self.updates = True, self.updates + 1

    state, first = State(), _first_rows(None)
    parts = [pd.DataFrame({"id": ["a"], "seq": [s]}) for s in (2, 1)]
    assert [r["seq"].iloc[0] for r in first(("a",), iter(parts), state)] == [1]
    left = iter(parts)
    assert list(first(("a",), left, state)) == [] and len(list(left)) == 2 and state.updates == 1
