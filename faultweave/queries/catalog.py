"""One query per operator, each over whole tables.

A query takes the session and a folder of Parquet tables and returns flat columns, so
that ``oracle.py`` can state the same result in SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultweave.functions import failure, scoring, text, vectors
from faultweave.operators import evidence, history, logs, postings, recommend, skew, topk, trace
from faultweave.operators import index as history_index
from faultweave.operators import scripts as script_ops
from faultweave.operators import tickets as ticket_ops
from faultweave.plans import credit, investigate, recon, retention, risk, settlement
from faultweave.queries import views as v
from faultweave.schemas import FAILURE_TYPES
from faultweave.session import scratch_path
from faultweave.sources import exports, partitions, store
from faultweave.sources import logs as log_source
from faultweave.sources import scripts as script_source
from faultweave.sources import tickets as ticket_source
from faultweave.streaming.incidents import investigate_stream
from faultweave.streaming.store import store_stream, store_stream_by_state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CALC_DATE = "1996-01-01"
AS_OF = "2000-01-01 00:00:00"
SYNC_FROM, SYNC_TO = "2024-03-01", "2024-06-30"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _str(col: str | Column) -> Column:
    """Text for comparison; null as a dash."""
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit("-"))


def _num(col: str | Column, digits: int = 6) -> Column:
    return F.round((F.col(col) if isinstance(col, str) else col).cast("double"), digits)


def _flat_store(df: DataFrame) -> DataFrame:
    return df.select(
        "id",
        F.md5("document").alias("document"),
        _num(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)).alias("embedding_sum"),
        F.size("embedding").alias("dim"),
        "ticket_id",
        "job_name",
        "script_name",
        "resolved_by",
        "resolved_at",
        "failure_type",
        "resolution",
    )


# --- sources and sinks -------------------------------------------------------------


def _flat_export(df: DataFrame) -> DataFrame:
    return df.select(
        F.coalesce("INCIDENT_ID", F.lit("")).alias("incident_id"),
        "JOB_NAME",
        "SCRIPT_NAME",
        "COMMAND",
        _str("SUMMARY").alias("summary"),
        F.md5("INCIDENT_DETAILS").alias("details"),
        "RESOLUTION",
        "ROOT_CAUSE",
        F.coalesce("FAILURE_TYPE", F.lit("")).alias("FAILURE_TYPE"),
        "RESOLVED_BY",
        "RESOLVED_DATE",
        "MTTD",
        "MTTR",
    )


@query
def read_export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "export-csv")
    (
        v.export(spark, sf_dir)
        .write.option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return _flat_export(exports.read_incident_export(spark, path, "csv", multiline=True))


@query
def read_export_csv_reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns in reverse order, and one that the schema does not have."""
    path = scratch_path(spark, "export-csv")
    rows = v.export(spark, sf_dir)
    (
        rows.select(F.lit("x").alias("NOTE"), *reversed(rows.columns))
        .write.option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return _flat_export(exports.read_incident_export(spark, path, "csv", multiline=True))


@query
def read_export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "export-json")
    v.export(spark, sf_dir).write.json(path)
    return _flat_export(exports.read_incident_export(spark, path, "json"))


@query
def read_export_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "export-parquet")
    v.export(spark, sf_dir).write.parquet(path)
    return _flat_export(exports.read_incident_export(spark, path))


@query
def read_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tickets")
    v.tickets(spark, sf_dir).write.json(path)
    return _flat_tickets(ticket_source.read_tickets(spark, path))


@query
def read_tickets_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tickets as JSON arrays of a bounded number, by language, numbered over the files."""
    path = scratch_path(spark, "tickets")
    block = F.lpad(F.floor(F.col("seq") / 1000).cast("string"), 12, "0")
    rows = v.tickets(spark, sf_dir).withColumn("file", F.concat(F.col("comments")[0]["body"], F.lit("-"), block))
    fields = F.struct(*[c for c in rows.columns if c not in ("seq", "file")])
    ordered = F.array_sort(F.collect_list(F.struct("seq", F.to_json(fields).alias("j"))))
    text = F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda t: t["j"]), ","), F.lit("]"))
    rows.groupBy("file").agg(text.alias("value")).write.partitionBy("file").text(path)
    return _flat_tickets(ticket_source.read_tickets(spark, path, "array"))


def _flat_tickets(rows: DataFrame) -> DataFrame:
    comment = F.col("comments")[0]
    return rows.select(
        "seq",
        _str("key").alias("key"),
        _str("ticket_key").alias("ticket_key"),
        "summary",
        "status",
        "priority",
        F.md5("description").alias("description"),
        F.md5("root_cause").alias("root_cause"),
        _str("workaround").alias("workaround"),
        _str("fix_details").alias("fix_details"),
        F.array_join("labels", " ").alias("labels"),
        F.concat_ws("|", F.size("comments"), comment["author"], comment["created"], comment["body"]).alias("comments"),
    )


@query
def read_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as one log per day, written in time order and read back as numbered lines."""
    path = scratch_path(spark, "logs")
    events = v.table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        "ts",
        "event_id",
        F.concat_ws(" ", F.lit("INFO:"), "event_type", F.col("event_id").cast("string"), "props").alias("value"),
    )
    # Range partitions split a long day over several files, whose names keep their order.
    (
        events.repartitionByRange("day", "ts", "event_id")
        .sortWithinPartitions("day", "ts", "event_id")
        .select("day", "value")
        .write.partitionBy("day")
        .text(path)
    )
    return log_source.read_logs(spark, path, by_folder=True).select(
        F.regexp_extract("log_name", "day=(.*)", 1).alias("log_name"), "line_no", "line"
    )


@query
def read_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as script files."""
    path = scratch_path(spark, "scripts")
    i = F.col("item_id")
    suffix = F.when(i % 3 == 0, F.lit(".sh")).otherwise(F.lit(".py"))
    items = v.table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("S"), i.cast("string"), suffix).alias("name"), F.col("text").alias("value"), i
    )
    items.select("name", "value").write.partitionBy("name").text(path)
    manifest = items.select(
        F.concat(F.lit("name="), "name").alias("name"),
        F.when(i % 2 == 0, F.lit("755")).otherwise(F.lit("644")).alias("permissions"),
    )
    scripts = script_source.read_scripts(spark, path, manifest, by_folder=True)
    return scripts.select(
        F.substring_index("name", "=", -1).alias("name"),
        F.md5("content").alias("content"),
        "size",
        (F.col("modified") > 1.0e9).alias("dated"),
        "permissions",
    )


def _write_netting(spark: SparkSession, sf_dir: str, name: str) -> str:
    path = scratch_path(spark, name)
    rows = v.netting(spark, sf_dir)
    spread = F.pmod(F.xxhash64("record_id"), F.lit(2))
    rows.repartition("date", "currency", spread).write.partitionBy("date", "currency").parquet(path)
    return path


@query
def read_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _write_netting(spark, sf_dir, "netting")
    return partitions.read_partition(spark, path, CALC_DATE, "2-HIGH").select(
        "record_id", _str("date").alias("date"), "currency", _num("gross_amount", 2).alias("gross_amount")
    )


@query
def read_partition_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _write_netting(spark, sf_dir, "netting")
    return partitions.read_partition(spark, path, CALC_DATE).select(
        "record_id", _str("date").alias("date"), "currency", _num("gross_amount", 2).alias("gross_amount")
    )


@query
def append_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Into no store the out-of-memory incidents, then all of them twice under another resolver."""
    path = scratch_path(spark, "store")
    docs = v.store_documents(spark, sf_dir)
    held = docs.where("failure_type = 'oom'")
    store.append_new(spark, path, held.withColumn("resolved_by", F.lit("first")), vectors.md5_embedding)
    for _ in range(2):
        store.append_new(spark, path, docs.withColumn("resolved_by", F.lit("second")), vectors.md5_embedding)
    return _flat_store(store.read_store(spark, path))


@query
def not_yet_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.store(spark, sf_dir)
    stored = rows.where(F.col("failure_type") != "oom")
    return store.not_yet_stored(rows, stored).select("id", "failure_type")


@query
def recreate_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "store")
    v.store(spark, sf_dir).write.parquet(path)
    before = store.read_store(spark, path).agg(F.count("*").alias("rows_before")).first().rows_before
    store.recreate(spark, path)
    return store.read_store(spark, path).agg(
        F.lit(before).cast("long").alias("rows_before"), F.count("*").alias("rows_after")
    )


@query
def sync_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "store")
    incidents = exports.resolve_headers(v.export(spark, sf_dir))
    v.store(spark, sf_dir).where("failure_type = 'oom'").write.parquet(path)
    return store.sync_range(spark, path, incidents, SYNC_FROM, SYNC_TO, vectors.md5_embedding)


@query
def sync_range_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same days with a time after each."""
    path = scratch_path(spark, "store")
    incidents = exports.resolve_headers(v.export(spark, sf_dir))
    timed = incidents.withColumn("resolved_at", F.concat("resolved_at", F.lit(" 14:00:00")))
    v.store(spark, sf_dir).where("failure_type = 'oom'").write.parquet(path)
    return store.sync_range(spark, path, timed, SYNC_FROM, SYNC_TO, vectors.md5_embedding)


@query
def sync_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents handed to a store that has the oom ones."""
    path = scratch_path(spark, "store")
    rows = v.store(spark, sf_dir)
    rows.where("failure_type = 'oom'").write.parquet(path)
    added = store.append_new(spark, path, v.store_documents(spark, sf_dir), vectors.md5_embedding)
    return store.sync_report(spark, rows.count(), added)


@query
def write_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All dates are written, then one again with other amounts; the rest must stay."""
    path = scratch_path(spark, "totals")
    totals = settlement.settlement_totals(v.netting(spark, sf_dir))
    partitions.write_result(totals, path)
    again = totals.where(F.col("date") == CALC_DATE).withColumn("gross", F.lit(1).cast("decimal(28,2)"))
    partitions.write_result(again, path)
    return spark.read.parquet(path).select(
        _str("date").alias("date"), "currency", _num("gross", 2).alias("gross"), "records"
    )


@query
def upsert_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two days of scores, then new scores for the customers due on the first day."""
    path = scratch_path(spark, "scores")
    everyone = v.customers(spark, sf_dir)
    score = F.col("c_acctbal") / F.lit(10000.0)
    first = credit.score_table(everyone.where("c_nationkey < 12"), score, CALC_DATE)
    second = credit.score_table(everyone, score, "1996-01-02")
    first.unionByName(second).write.partitionBy("calc_date").parquet(path)
    due = credit.due_for_scoring(everyone, CALC_DATE)
    updates = credit.score_table(due, F.lit(0.5) + F.col("c_nationkey") / F.lit(100.0), CALC_DATE)
    credit.write_scores(spark, path, updates, CALC_DATE)
    return spark.read.parquet(path).select(
        "customer_id", _num("score").alias("score"), "risk_band", _str("calc_date").alias("calc_date")
    )


@query
def archive_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive report of a present and a missing date, next to what the archive holds."""
    source, archive = _write_netting(spark, sf_dir, "netting"), scratch_path(spark, "archive")
    done = partitions.archive_partition(spark, source, archive, CALC_DATE)
    missing = partitions.archive_partition(spark, source, archive, "1901-01-01")
    held = spark.read.parquet(archive).groupBy(_str("date").alias("date")).agg(
        F.count("*").alias("archived_rows"), _num(F.sum("gross_amount"), 2).alias("archived_gross")
    )
    report = done.unionByName(missing).withColumn("has_files", F.col("files") > 0).drop("files")
    return report.join(held, "date", "left").na.fill({"archived_rows": 0, "archived_gross": 0.0})


# --- projections and predicates ----------------------------------------------------


@query
def normalise_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field padded with blanks of several kinds."""
    padded = v.incidents(spark, sf_dir).withColumns(
        {
            "ticket_id": F.concat(F.lit("\t "), "ticket_id", F.lit("\n")),
            "job_name": F.concat(F.lit(" "), "job_name", F.lit(" \u00a0\u3000")),
            "script_name": F.coalesce(F.col("script_name"), F.lit(" \t ")),
            "command": F.concat(F.lit("\ufeff"), "command"),
        }
    )
    return text.normalise_input(padded).select(
        "request_id", "ticket_id", "job_name", _str("script_name").alias("script_name"), _str("command").alias("command")
    )


@query
def resolve_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export with mixed headers: some lower-case, some missing, DESCRIPTION as fallback."""
    raw = v.export(spark, sf_dir).select(
        "INCIDENT_ID",
        F.col("JOB_NAME").alias("job_name"),
        F.concat(F.lit("old "), "JOB_NAME").alias("JOB_NAME"),
        F.col("SUMMARY").alias("DESCRIPTION"),
        F.col("INCIDENT_DETAILS").alias("incident_details"),
        "RESOLVED_DATE",
        F.col("MTTD").alias("resolved_by"),
    )
    return exports.resolve_headers(raw).withColumn("incident_details", F.md5("incident_details"))


@query
def drop_blank_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exports.drop_blank_ids(exports.resolve_headers(v.export(spark, sf_dir)))
    return rows.select("ticket_id", "job_name", "failure_type")


@query
def document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some documents lose all their text and fall back to job and description."""
    d = F.col("doc_id")
    docs = v.table(spark, sf_dir, "documents").select(
        d,
        F.when(d % 9 != 0, F.concat(F.lit(" "), "source")).alias("summary"),
        F.when(d % 6 != 0, F.col("text")).alias("details"),
        F.when(d % 4 == 1, F.col("lang")).otherwise(F.lit(" ")).alias("resolution"),
        F.when(d % 9 == 0, F.lit(" \n")).otherwise(F.col("lang")).alias("description"),
    )
    document = text.document_text(
        F.col("summary"), F.col("details"), F.col("resolution"), F.lit("J"), F.col("description")
    )
    return docs.select("doc_id", F.md5(document).alias("document"), F.length(document).alias("n"))


@query
def classify_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failure.classify_failure(v.incidents(spark, sf_dir)).select("request_id", "failure_type")


@query
def classify_failure_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules on whole document texts, a keyword added to some."""
    d = F.col("doc_id")
    word = v._pick(("", " GC Overhead", " wallclock", " Upstream", " rc=127", " Breach", " HOLD STATE"), d % 7)
    docs = v.table(spark, sf_dir, "documents").select(d, F.concat("text", word).alias("tws_log"))
    labelled = failure.classify_failure(docs.withColumn("description", F.lit(None).cast("string")))
    return labelled.select("doc_id", "failure_type")


@query
def extract_job_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_of = failure.search_text(F.col("tws_log"), F.col("description"))
    return failure.resolve_job_name(v.incidents(spark, sf_dir), out="resolved").select(
        "request_id",
        _str(failure.job_name_in(text_of)).alias("compat"),
        _str(failure.job_name_in(text_of, "name")).alias("name"),
        "resolved",
    )


@query
def matching_store_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.matching_store_rows(v.incidents(spark, sf_dir), v.past_vectors(spark, sf_dir))


@query
def coerce_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = text.coerce_enum(F.col("FAILURE_TYPE"), FAILURE_TYPES, "unknown")
    return v.export(spark, sf_dir).groupBy("FAILURE_TYPE", kind.alias("coerced")).agg(F.count("*").alias("n"))


@query
def script_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Script names with, without and with a foreign suffix."""
    r = F.col("request_id")
    name = F.when(r % 3 == 1, F.regexp_replace("script_name", r"\.py$", "")).when(
        r % 3 == 2, F.regexp_replace("script_name", r"\.py$", ".sh")
    )
    own = F.coalesce(name, F.col("script_name"))
    asked = v.incidents(spark, sf_dir).select("request_id", "job_name", own.alias("script_name"))
    return asked.select(
        "request_id",
        text.script_request(F.col("script_name"), F.col("job_name")).alias("request"),
        text.script_target(F.col("script_name"), F.col("job_name")).alias("target"),
        text.log_target(F.col("job_name")).alias("log"),
    )


@query
def env_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variable maps of nodes; what is allowed and filled comes out as rows."""
    c = F.col("c_custkey")
    env = F.create_map(
        F.lit("PATH"),
        F.col("c_name"),
        F.lit("HOME"),
        F.lit("/home"),
        F.lit("JAVA_HOME"),
        F.when(F.col("c_acctbal") < 0, F.lit("")).otherwise(F.lit("/opt/java")),
        F.lit("TWS_ENV"),
        F.when(c % 4 != 0, F.col("c_mktsegment")),
        F.lit("path"),
        F.lit("x"),
    )
    return v.table(spark, sf_dir, "customer").select(
        c.alias("node"), F.explode(text.env_allow_list(env)).alias("name", "value")
    )


@query
def ticket_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in whole document texts; some texts get keys appended at different edges."""
    d = F.col("doc_id")
    tail = v._pick(("", " AB-12", "xAB-12", " see OPS-7, OPS-7.", " A-1 ABCDEFGHIJK-2", "éZZ-3 ZZ-3"), d % 6)
    docs = v.table(spark, sf_dir, "documents").select(d, F.concat("text", tail).alias("text"))
    stubs = failure.ticket_stubs(F.col("text"))
    return docs.select("doc_id", F.posexplode(stubs).alias("place", "stub")).select(
        "doc_id",
        F.col("place").cast("long").alias("place"),
        _str("stub.key").alias("key"),
        F.md5("stub.summary").alias("summary"),
    )


@query
def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.statuses(spark, sf_dir).select("job", failure.job_status(F.col("status_text")).alias("status"))


@query
def risk_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances over 10,000 as scores; they run from below 0 to about 1."""
    score = F.col("c_acctbal") / F.lit(10000.0)
    return v.table(spark, sf_dir, "customer").select("c_custkey", scoring.risk_band(score).alias("band"))


@query
def due_for_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = credit.due_for_scoring(v.customers(spark, sf_dir), CALC_DATE)
    return due.select("customer_id", _str("last_score_date").alias("last_score_date"))


@query
def volume_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = v.table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return risk.volume_period(dated, "day").drop("day")


@query
def expired_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.expired(v.files(spark, sf_dir), AS_OF).select("file_id", "l_linenumber", "age_days")


@query
def truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.md5(text.truncate(F.col("text"), 3000, "…")).alias("long"),
        text.truncate(F.col("text"), 120).alias("short"),
    )


# --- joins -------------------------------------------------------------------------


@query
def history_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = history.history_search(v.asked_vectors(spark, sf_dir), v.past_vectors(spark, sf_dir))
    return hits.select(
        "request_id", "rank", "id", _num("distance").alias("distance"), _num("similarity_score").alias("similarity_score")
    )


@query
def history_search_many_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some thousand jobs of few rows each."""
    hits = history.history_search(v.job_customers(spark, sf_dir), v.job_parts(spark, sf_dir))
    return hits.select("request_id", "rank", "id", _num("distance").alias("distance"))


@query
def history_search_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors made from the texts of incidents and documents."""
    asked = investigate.prepare(v.incidents(spark, sf_dir))
    hits = history.history_search(
        asked, v.store(spark, sf_dir), embed=vectors.md5_embedding, dim=v.EMBEDDING_DIM
    )
    return hits.select("request_id", "rank", "id", _num("similarity_score").alias("similarity_score"))


def _from_index(asked: DataFrame, past: DataFrame, name: str) -> DataFrame:
    spark = asked.sparkSession
    path = scratch_path(spark, name)
    history_index.write_index(past, path)
    asked = history.with_query_id(asked, "embedding")
    return history_index.indexed_search(asked, path, past).select(
        "request_id", "rank", "id", _num("distance").alias("distance"), _num("similarity_score").alias("similarity_score")
    )


@query
def history_search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search from an index that is kept with the store."""
    return _from_index(v.asked_vectors(spark, sf_dir), v.past_vectors(spark, sf_dir), "history-index")


@query
def history_search_indexed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some thousand jobs of few rows each, from an index."""
    hits = _from_index(v.job_customers(spark, sf_dir), v.job_parts(spark, sf_dir), "jobs-index")
    return hits.drop("similarity_score")


@query
def ticket_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = investigate.prepare(v.incidents(spark, sf_dir))
    return ticket_ops.ticket_match(asked, v.tickets(spark, sf_dir)).select(
        "request_id", "name", "rank", "seq", _str("key").alias("key"), "total"
    )


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = v.table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("job_name"))
    words = v.table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("job_name"))
    nations = v.table(spark, sf_dir, "nation").select(F.col("n_name").alias("job_name"))
    return parts.unionByName(words).unionByName(nations)


@query
def ticket_match_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many names in whole texts: all words of parts and of benchmark items, and nations."""
    names = _words(spark, sf_dir)
    return ticket_ops.ticket_matches(names, v.tickets(spark, sf_dir)).select("name", "rank", "seq", "total")


@query
def ticket_match_posted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tickets per incident from a kept index of their texts, half of which came later."""
    tickets = v.tickets(spark, sf_dir)
    path = scratch_path(spark, "postings")
    for generation in range(2):
        part = tickets.where(F.col("seq") % 2 == generation)
        postings.write_postings(ticket_ops.ticket_texts(part), path, generation)
    asked = investigate.prepare(v.incidents(spark, sf_dir))
    matches = ticket_ops.posted_ticket_matches(asked, path)
    keyed = matches.join(tickets.select(F.col("seq").cast("long").alias("seq"), "key"), "seq")
    return asked.select("request_id", F.lower("job_name").alias("name")).join(keyed, "name").select(
        "request_id", "name", "rank", "seq", _str("key").alias("key"), "total"
    )


@query
def ticket_match_many_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same names as ``ticket_match_words``, looked up by their grams."""
    names = _words(spark, sf_dir)
    found = ticket_ops.ticket_matches(names, v.tickets(spark, sf_dir), name_chars=0)
    return found.select("name", "rank", "seq", "total")


@query
def script_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = investigate.prepare(v.incidents(spark, sf_dir))
    return script_ops.script_lookup(asked, v.scripts(spark, sf_dir)).select(
        "job_name",
        _str("script_name").alias("script_name"),
        "config_script",
        F.md5("config_content").alias("config_content"),
        _str(F.md5("node_content")).alias("node_content"),
        _str("permissions").alias("permissions"),
        "on_node",
    )


@query
def node_for_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = v.incidents(spark, sf_dir).select("request_id", "job_name")
    return script_ops.node_for_job(asked, v.nodes(spark, sf_dir)).select(
        "request_id", "job_name", F.col("node.name").alias("node"), F.col("node.port").alias("port")
    )


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = v.knowledge(spark, sf_dir)
    return investigate.gather(v.incidents(spark, sf_dir), known, fields=evidence.EVIDENCE_FIELDS)


@query
def assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = investigate.gather(v.incidents(spark, sf_dir), v.knowledge(spark, sf_dir))
    return found.select(
        "request_id",
        F.size("history").alias("past"),
        F.size("tickets").alias("tickets"),
        "ticket_total",
        "on_node",
        F.md5("config_content").alias("config_content"),
        F.md5(F.array_join(F.transform("history", lambda h: h["resolution"]), "|")).alias("resolutions"),
    )


@query
def recommend_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules on every incident, with evidence counts taken from its number."""
    r = F.col("request_id")
    found = failure.classify_failure(v.incidents(spark, sf_dir)).withColumns(
        {
            "failure_type": F.when(r % 17 == 0, F.lit("disk_full")).otherwise(F.col("failure_type")),
            "historical_tickets": (r % 3).cast("int"),
            "jira_tickets": (r % 2).cast("int"),
            "edge_node_available": r % 5 == 0,
        }
    )
    return recommend.recommend(found, v.playbook(spark, sf_dir)).select(
        "request_id",
        "failure_type",
        "confidence",
        "root_cause",
        F.array_join("actions", "; ").alias("actions"),
        "escalation_needed",
        F.col("escalation_reason").isNotNull().alias("has_reason"),
    )


@query
def recommend_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents by failure type and confidence when no evidence was found."""
    bare = failure.classify_failure(v.incidents(spark, sf_dir)).withColumns(
        {"historical_tickets": F.lit(0), "jira_tickets": F.lit(0), "edge_node_available": F.lit(False)}
    )
    return recommend.recommend(bare, v.playbook(spark, sf_dir)).groupBy("failure_type", "confidence").agg(F.count("*").alias("n"))


@query
def reconcile_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recon.reconcile(v.trade_schedule(spark, sf_dir), v.trades(spark, sf_dir))
    return rows.withColumn("recon_date", _str("recon_date")).withColumn("amount", _num("amount", 2))


@query
def reconcile_trades_skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recon.reconcile(v.trade_schedule(spark, sf_dir), v.trades(spark, sf_dir), skewed=True)
    return rows.withColumn("recon_date", _str("recon_date")).withColumn("amount", _num("amount", 2))


@query
def reconcile_trades_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recon.reconcile(v.trade_schedule(spark, sf_dir), v.trades(spark, sf_dir), "1997-05-28")
    return rows.withColumn("recon_date", _str("recon_date")).withColumn("amount", _num("amount", 2))


@query
def positions_with_factors(spark: SparkSession, sf_dir: str, skewed: bool = False) -> DataFrame:
    rows = risk.positions_with_factors(v.positions(spark, sf_dir), v.risk_factors(spark, sf_dir), skewed)
    return rows.select(
        "position_id", "instrument_id", "portfolio_id", _num("notional_value", 2).alias("notional_value"),
        _str("risk_weight").alias("risk_weight"),
    )


@query
def positions_with_factors_skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions_with_factors(spark, sf_dir, skewed=True)


@query
def predecessor_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settlement.predecessor_gate(v.waiting_jobs(spark, sf_dir), v.statuses(spark, sf_dir))


@query
def predecessor_gate_skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settlement.predecessor_gate(v.waiting_jobs(spark, sf_dir), v.statuses(spark, sf_dir), skewed=True)


@query
def predecessor_gate_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settlement.predecessor_gate(v.waiting_jobs(spark, sf_dir), v.statuses(spark, sf_dir), strict=True)


# --- aggregations ------------------------------------------------------------------


@query
def store_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The count of a store after all rows and then some of them again were added."""
    path = scratch_path(spark, "store")
    docs = v.store_documents(spark, sf_dir)
    for rows in (docs, docs.where("failure_type = 'oom'")):
        store.append_new(spark, path, rows, vectors.md5_embedding)
    stored = store.read_store(spark, path)
    counted = store.store_count(stored)
    return stored.agg(F.lit(counted).cast("long").alias("count"), F.countDistinct("id").alias("ids"))


@query
def evidence_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select(
        "request_id",
        "historical_tickets",
        "jira_tickets",
        "edge_node_available",
        "bitbucket_config",
        F.array_join("historical_ticket_ids", ",").alias("historical_ticket_ids"),
        F.array_join("jira_ticket_keys", ",").alias("jira_ticket_keys"),
        _str("edge_node_ref").alias("edge_node_ref"),
        _str("bitbucket_ref").alias("bitbucket_ref"),
    )


@query
def pending_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recon.pending_accounts(v.trade_schedule(spark, sf_dir))
    return rows.select("account_id", _str("sched_date").alias("sched_date"))


@query
def risk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = risk.risk_totals(v.positions(spark, sf_dir), v.risk_factors(spark, sf_dir))
    return rows.select(
        "portfolio_id",
        "currency_code",
        _num("total_notional", 2).alias("total_notional"),
        _num("total_risk", 2).alias("total_risk"),
        "position_count",
    )


@query
def settlement_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day, not per year: the netting rows with their own date."""
    daily = v.netting(spark, sf_dir).withColumn("date", _str("run_date"))
    return settlement.settlement_totals(daily).select(
        "date", "currency", _num("gross", 2).alias("gross"), _num("net", 3).alias("net"), "records"
    )


@query
def salted_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = skew.salted_totals(
        v.positions(spark, sf_dir), ["currency_code"], "notional_value", ["position_id", "instrument_id"]
    )
    return rows.select("currency_code", _num("total", 2).alias("total"), "n")


@query
def key_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = skew.key_counts(v.positions(spark, sf_dir), "instrument_id")
    return rows.select("instrument_id", "n", _num("share", 9).alias("share"))


@query
def heavy_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of status and priority that at least a fiftieth of all orders have."""
    orders = v.table(spark, sf_dir, "orders")
    pairs = skew.heavy_keys(orders, ["o_orderstatus", "o_orderpriority"], 0.02)
    return pairs.withColumn("share", _num("share", 9))


@query
def largest_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = skew.largest_share(v.positions(spark, sf_dir), "currency_code")
    return rows.withColumn("max_share", _num("max_share", 9))


@query
def stage_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(spark, sf_dir).withColumn(
        "analysis", F.when(F.col("request_id") % 3 == 0, F.lit("done")).when(F.col("request_id") % 3 == 1, F.lit(""))
    )
    return evidence.stage_outcomes(found, "analysis")


@query
def stage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.stage_summary(evidence.stage_outcomes(_found(spark, sf_dir)))


@query
def instrument_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.instrument_count(v.positions(spark, sf_dir), "portfolio_id")


# --- top-k and runs ----------------------------------------------------------------


@query
def top_k_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per label the vectors nearest to the label's first vector."""
    rows = v.table(spark, sf_dir, "embeddings")
    first = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("center"))
    candidates = rows.join(first, "label").select(
        F.col("label").alias("request_id"),
        F.concat(F.lit("H-"), F.col("vec_id").cast("string")).alias("id"),
        vectors.l2_sq(F.col("embedding"), F.col("center")).alias("distance"),
    )
    return topk.top_k_nearest(candidates).withColumn("distance", _num("distance"))


@query
def first_n_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = v.table(spark, sf_dir, "documents").select(F.col("source").alias("name"), F.col("doc_id").alias("seq"))
    return ticket_ops.first_n_in_order(matches)


@query
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three turns of each conversation; every conversation and one unknown log is listed."""
    lines = v.log_lines(spark, sf_dir)
    manifest = lines.select("log_name").union(lines.agg(F.lit(-1).cast("long").alias("log_name")))
    return logs.log_tail(lines, 3, manifest).withColumn("content", F.md5("content"))


@query
def last_call_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = v.calls(spark, sf_dir).withColumn("asked_name", F.concat(F.lit("s"), F.col("run_id").cast("string")))
    return trace.last_call_path(calls, "asked_name").withColumn("resolved_path", _str("resolved_path"))


@query
def last_model_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.last_model_text(v.run_events(spark, sf_dir))


@query
def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.tool_calls(v.run_events(spark, sf_dir))


# --- set operations ----------------------------------------------------------------


@query
def union_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six lists by failure type, one with its columns in another order."""
    rows = exports.resolve_headers(v.export(spark, sf_dir)).select("ticket_id", "job_name", "failure_type")
    kinds = ("oom", "cpu_high", "unknown", "long_running", "python_version")
    batches = [rows.where(F.col("failure_type") == kind) for kind in kinds]
    rest = rows.where(~F.col("failure_type").isin(*kinds)).select("failure_type", "ticket_id", "job_name")
    return exports.union_batches([*batches, rest])


@query
def match_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Past incidents of one job or of the two scripts that some incidents name."""
    asked = v.incidents(spark, sf_dir)
    jobs = asked.where(F.col("job_name").isin("DBS_ASIA", ""))
    scripts = asked.where(F.col("request_id") % 40 == 0)
    found = history.match_union(v.past_vectors(spark, sf_dir), jobs, scripts)
    return found.select("vec_id", "job_name", "script_name")


# --- vectors -----------------------------------------------------------------------


def _place_sum(vector: str) -> Column:
    """A sum that depends on the order of the values."""
    places = F.transform(vector, lambda x, i: x * (i + 1))
    return _num(F.aggregate(places, F.lit(0.0), lambda a, x: a + x))


@query
def sha_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = v.table(spark, sf_dir, "documents")
    docs = vectors.embed_column(docs, "text", lambda t: vectors.sha_embedding(t, 100))
    return docs.select(
        "doc_id",
        F.size("embedding").alias("dim"),
        _num(F.col("embedding")[0]).alias("first"),
        _num(F.col("embedding")[99]).alias("last"),
        _place_sum("embedding").alias("places"),
    )


@query
def md5_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = vectors.embed_column(v.table(spark, sf_dir, "documents"), "text", vectors.md5_embedding)
    return docs.select("doc_id", F.size("embedding").alias("dim"), _place_sum("embedding").alias("places"))


VOWELS = "aeiou"


def _vowel_encoder():
    def encode(texts: list[str]) -> np.ndarray:
        return np.array([[t.count(c) for c in VOWELS] for t in texts], dtype=np.float64)

    return encode


@query
def encoder_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch encoder (vowel counts) with normalisation, on whole texts."""
    embed = vectors.encoder_embedding(_vowel_encoder)
    docs = vectors.embed_column(v.table(spark, sf_dir, "documents"), "text", embed)
    return docs.select("doc_id", *[_num(F.col("embedding")[i]).alias(c) for i, c in enumerate(VOWELS)])


@query
def embedding_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same store built with each provider; only the vectors differ."""
    rows = exports.drop_blank_ids(exports.resolve_headers(v.export(spark, sf_dir)))
    providers = {"md5": vectors.md5_embedding, "sha": lambda t: vectors.sha_embedding(t, 16)}
    built = [
        store.store_rows(rows, embed).select(
            F.lit(name).alias("provider"), "id", F.size("embedding").alias("dim"), _place_sum("embedding").alias("places")
        )
        for name, embed in providers.items()
    ]
    return built[0].unionByName(built[1])


@query
def l2_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector to the next one."""
    a = v.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    d = vectors.l2_sq(F.col("embedding"), F.col("other"))
    return a.join(b, "vec_id").select(
        "vec_id", _num(d).alias("distance"), _num(vectors.similarity(d)).alias("similarity")
    )


@query
def same_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of mixed widths against a 64-value query; the others drop out."""
    rows = v.table(spark, sf_dir, "embeddings")
    cut = F.when(F.col("label") == 3, F.slice("embedding", 1, 8)).otherwise(F.col("embedding"))
    query_vector = F.array_repeat(F.lit(0.0), 64)
    mixed = rows.select("vec_id", cut.alias("embedding"))
    kept = mixed.where(vectors.same_dimension(F.col("embedding"), query_vector))
    return kept.select("vec_id", F.size("embedding").alias("dim"))


# --- texts -------------------------------------------------------------------------


@query
def diagnosis_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = investigate.contexts(v.incidents(spark, sf_dir), v.knowledge(spark, sf_dir))
    return texts.select("request_id", F.length("context").alias("n"), F.md5("context").alias("context"))


@query
def repo_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repository paths with a workspace, a path or both missing."""
    p = F.col("p_partkey")
    ref = script_ops.repo_ref(
        F.when(p % 3 != 0, F.lit("ops")).otherwise(F.lit("")),
        F.lit("batch-jobs"),
        F.when(p % 2 == 0, F.lit("jobs")).otherwise(F.lit("")),
        F.lit("main"),
        F.when(p % 5 == 0, F.concat(F.lit("x/"), "p_name")),
        F.col("p_type"),
    )
    return v.table(spark, sf_dir, "part").select("p_partkey", ref.alias("ref"))


@query
def node_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Script places on every node, some nodes without a port, some scripts not there."""
    s = v.nodes(spark, sf_dir).select(
        "rank",
        F.struct(
            "name",
            "host",
            F.when(F.col("rank") % 4 != 0, F.col("port")).alias("port"),
            F.col("scripts_path"),
        ).alias("node"),
    )
    return s.select(
        "rank", _str(script_ops.node_ref(F.col("rank") % 7 != 0, F.col("node"), F.lit("a.py"))).alias("ref")
    )


# --- scoring by a model ------------------------------------------------------------


class CentredScaler:
    """Subtracts and divides per column."""

    def __init__(self, mean: list[float], scale: list[float]):
        self.mean, self.scale = np.array(mean), np.array(scale)

    def transform(self, frame: pd.DataFrame) -> np.ndarray:
        return (frame.to_numpy(dtype=np.float64) - self.mean) / self.scale


class LogisticModel:
    def __init__(self, weights: list[float]):
        self.weights = np.array(weights)

    def predict_proba(self, x: np.ndarray) -> np.ndarray:
        p = 1.0 / (1.0 + np.exp(-(x @ self.weights)))
        return np.column_stack([1.0 - p, p])


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = (
        v.table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("customer_id"))
        .agg(F.count("*").cast("double").alias("num_accounts"))
    )
    return (
        v.customers(spark, sf_dir)
        .join(orders, "customer_id", "left")
        .select(
            "customer_id",
            F.col("c_acctbal").alias("annual_income"),
            F.col("c_nationkey").cast("double").alias("debt_ratio"),
            F.coalesce("num_accounts", F.lit(0.0)).alias("num_accounts"),
        )
    )


@query
def score_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = ["annual_income", "debt_ratio", "num_accounts"]
    scaler = CentredScaler([4500.0, 12.0, 10.0], [3000.0, 7.0, 4.0])
    scored = scoring.score_customers(_features(spark, sf_dir), features, scaler, LogisticModel([0.5, -0.25, 0.125]))
    return credit.score_table(scored, "score", CALC_DATE).withColumn("score", _num("score"))


@query
def linear_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = scoring.linear_score({"annual_income": 1.0 / 11000.0}, 1000.0 / 11000.0)
    scored = credit.score_table(_features(spark, sf_dir), score, CALC_DATE)
    return scored.withColumn("score", _num("score"))


# --- whole flow --------------------------------------------------------------------


def _flat_investigation(df: DataFrame) -> DataFrame:
    return df.select(
        "request_id",
        "ticket_id",
        "job_name",
        "failure_type",
        "root_cause",
        F.array_join("recommended_actions", "; ").alias("actions"),
        "confidence",
        "historical_tickets",
        "jira_tickets",
        "ticket_total",
        "edge_node_available",
        "bitbucket_config",
        F.array_join("historical_ticket_ids", ",").alias("historical_ticket_ids"),
        F.array_join("jira_ticket_keys", ",").alias("jira_ticket_keys"),
        "escalation_needed",
    )


@query
def investigate_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_investigation(investigate.investigate(v.incidents(spark, sf_dir), v.knowledge(spark, sf_dir)))


@query
def response_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = investigate.responses(v.incidents(spark, sf_dir), v.knowledge(spark, sf_dir), analysis="command")
    return rows.select(
        "request_id",
        "job_name",
        "confidence",
        F.col("evidence.historical_tickets").alias("past"),
        F.array_join("evidence.jira_ticket_keys", ",").alias("keys"),
        _str("log_analysis").alias("log_analysis"),
        F.array_join(F.transform("agent_outputs", lambda s: F.concat_ws(":", s["stage"], s["status"])), " ").alias(
            "stages"
        ),
    )


def _halves(rows: DataFrame, inbox: str, key: str) -> None:
    """The rows as files in two folders, by a hash of ``key``: every task writes what it reads."""
    rows.withColumn("half", F.pmod(F.hash(key), F.lit(2))).write.partitionBy("half").parquet(inbox)


def _feed(spark: SparkSession, schema: T.StructType, inbox: str, half: int) -> DataFrame:
    """A stream of the first half, or with the same checkpoint of what came after it: a batch each."""
    path = inbox if half else f"{inbox}/half=0"
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(path)


@query
def investigate_incident_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same incidents as a file stream, in micro-batches."""
    inbox, out, state = (scratch_path(spark, n) for n in ("inbox", "investigations", "stream"))
    incidents = v.incidents(spark, sf_dir)
    _halves(incidents, inbox, "request_id")
    # Lookup tables are written once, not derived again for every micro-batch.
    known = v.knowledge(spark, sf_dir)
    path = scratch_path(spark, "store")
    known.store.write.parquet(path)

    def look_up() -> investigate.Knowledge:
        return replace(known, store=store.read_store(spark, path))

    kept = scratch_path(spark, "kept-tickets")
    for half in range(2):
        feed = _feed(spark, incidents.schema, inbox, half)
        investigate_stream(feed, look_up, out, state, kept_tickets=kept).awaitTermination()
    return _flat_investigation(spark.read.option("basePath", out).parquet(out))


@query
def investigate_indexed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same stream; a batch reads the folders of its jobs, scripts and grams in kept indexes."""
    inbox, out, state = (scratch_path(spark, n) for n in ("inbox", "investigations", "stream"))
    incidents = v.incidents(spark, sf_dir)
    _halves(incidents, inbox, "request_id")
    known = v.knowledge(spark, sf_dir)
    index, posted = scratch_path(spark, "index"), scratch_path(spark, "postings")
    history_index.write_index(known.store, index)
    postings.write_postings(ticket_ops.ticket_texts(known.tickets), posted)
    look_up = lambda: replace(known, index=index, postings=posted)
    for half in range(2):
        feed = _feed(spark, incidents.schema, inbox, half)
        investigate_stream(feed, look_up, out, state).awaitTermination()
    return _flat_investigation(spark.read.option("basePath", out).parquet(out))


@query
def store_feed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export as a stream into a store that already has the oom rows under another resolver."""
    inbox, path, state = (scratch_path(spark, n) for n in ("feed", "store", "stream"))
    export = v.export(spark, sf_dir)
    _halves(export, inbox, "INCIDENT_DETAILS")
    held = v.store(spark, sf_dir).where("failure_type = 'oom'").withColumn("resolved_by", F.lit("held"))
    held.write.parquet(path)
    for half in range(2):
        feed = _feed(spark, export.schema, inbox, half)
        store_stream(feed, path, vectors.md5_embedding, state).awaitTermination()
    return _flat_store(store.read_store(spark, path))


@query
def store_feed_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export as a stream, then all of it again under another resolver, which adds nothing."""
    inbox, path, state = (scratch_path(spark, n) for n in ("feed", "store", "stream"))
    export = v.export(spark, sf_dir)
    export.write.parquet(f"{inbox}/part=1")
    export.withColumn("RESOLVED_BY", F.lit("again")).write.parquet(f"{inbox}/part=2")
    for part in (1, 2):
        # the same checkpoint, so the second run knows the ids of the first
        feed = spark.readStream.schema(export.schema).option("recursiveFileLookup", True).parquet(inbox if part == 2 else f"{inbox}/part=1")
        store_stream_by_state(feed, path, vectors.md5_embedding, state).awaitTermination()
    return _flat_store(store.read_store(spark, path))


@query
def sync_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incidents up to a day, then all, then all again: three reports."""
    path, marks = scratch_path(spark, "store"), scratch_path(spark, "marks")
    incidents = exports.resolve_headers(v.export(spark, sf_dir))
    reports = [
        store.sync_since(spark, path, incidents, vectors.md5_embedding, marks, until).withColumn("run", F.lit(run))
        for run, until in enumerate((SYNC_TO, None, None))
    ]
    return reports[0].unionByName(reports[1]).unionByName(reports[2])
