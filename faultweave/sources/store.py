"""The table of past incidents that searches run against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from faultweave.functions.text import document_text
from faultweave.functions.vectors import Embedder
from faultweave.schemas import STORE, STORE_ATTRIBUTES
from faultweave.session import materialise, path_exists
from faultweave.sources.exports import drop_blank_ids
from faultweave.sources.vectors import embed_kept


def store_documents(docs: DataFrame) -> DataFrame:
    """Incidents as store rows without their vectors: id, document and seven attributes.

    The id is the ticket_id; where that column is absent it is the row's place ``seq``,
    counted from 0.
    """
    have = set(docs.columns)
    if "ticket_id" in have:
        row_id = F.col("ticket_id")
    elif "seq" in have:
        row_id = F.col("seq").cast("string")
    else:
        raise ValueError("documents need a ticket_id or a seq column")

    def text(name: str, default: str = ""):
        return F.coalesce(F.col(name).cast("string"), F.lit(default)) if name in have else F.lit(default)

    def or_null(name: str):
        return F.col(name).cast("string") if name in have else F.lit(None).cast("string")

    document = document_text(
        or_null("summary"), or_null("incident_details"), or_null("resolution"), or_null("job_name"), or_null("description")
    )
    attributes = [
        text(c, "unknown" if c == "failure_type" else "").alias(c) for c in STORE_ATTRIBUTES
    ]
    kept = [F.col("seq")] if "seq" in have else []
    return docs.select(row_id.alias("id"), document.alias("document"), *attributes, *kept)


def store_rows(docs: DataFrame, embed: Embedder) -> DataFrame:
    """Incidents as full store rows."""
    return store_documents(docs).withColumn("embedding", embed(F.col("document"))).select(*STORE.fieldNames())


def recreate(spark: SparkSession, path: str) -> None:
    """Leave an empty store at ``path``."""
    spark.createDataFrame([], STORE).write.mode("overwrite").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    # a store that a stream wrote has a folder for each batch
    return spark.read.schema(STORE).parquet(path).select(*STORE.fieldNames())


def not_yet_stored(docs: DataFrame, store: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Rows whose id is new.

    The store's ids are first reduced to those in ``docs``. With ``ids``, a written table of
    the batch's ids, Spark knows their size and for a small batch scans the store's ids
    without shuffling them.
    """
    ids = docs.select("id") if ids is None else ids
    known = store.select("id").join(ids, "id", "left_semi")
    return docs.join(known, "id", "left_anti")


def first_per_id(docs: DataFrame) -> DataFrame:
    """One row per id: the smallest ``seq``, or without that column the smallest row.

    Repeats are merged before the shuffle.
    """
    others = [c for c in docs.columns if c != "id"]
    order = F.col("seq") if "seq" in others else F.struct(*others)
    first = F.min_by(F.struct(*others), order).alias("_first")
    return docs.groupBy("id").agg(first).select("id", "_first.*")


def append_new(
    spark: SparkSession,
    path: str,
    docs: DataFrame,
    embed: Embedder | None = None,
    repeats: str = "error",
    dim: int | None = None,
    vectors: str | None = None,
) -> int:
    """Add the rows whose id the store does not have, and return how many those were.

    ``docs`` come from :func:`store_documents`, and only the new ones are embedded; without
    ``embed`` they carry their vectors.
    A store that does not exist is made. A stored id keeps its row. Repeats of an id inside
    ``docs`` are an error, or with ``repeats="first"`` the row with the smallest ``seq`` is
    taken. A missing id is an error, and so is a vector without ``dim`` values; by default
    these are as many as the stored vectors have, or the first new one. A second run over
    the same rows adds nothing, so a lost run may be repeated. ``vectors`` is the path of
    vectors kept by text (``sources.vectors``): a text that is there is not embedded again.
    """
    ids = materialise(docs.select("id"), "ids")
    if ids.where("id IS NULL").limit(1).count():
        raise ValueError("a row has no id")
    if repeats == "first":
        docs = first_per_id(docs)
    elif ids.groupBy("id").count().where("count > 1").limit(1).count():
        raise ValueError("an id occurs twice in one batch")
    if not path_exists(spark, path):
        recreate(spark, path)
    stored = read_store(spark, path)
    new = not_yet_stored(docs, stored, ids)
    if embed and vectors:
        new = embed_kept(new, "document", embed, vectors)
    elif embed:
        new = new.withColumn("embedding", embed(F.col("document")))
    if dim is None:
        dim = _width_of_first(stored) or _width_of_first(new)
    if dim is None:
        return 0
    wrong = F.raise_error(F.concat(F.lit(f"a vector of other than {dim} values: "), "id"))
    checked = F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(wrong)
    added = Observation()
    new = new.withColumn("embedding", checked).select(*STORE.fieldNames())
    new.observe(added, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return added.get.get("n", 0)


def _width_of_first(rows: DataFrame) -> int | None:
    row = rows.select(F.size("embedding").alias("n")).head()
    return row.n if row else None


def store_count(store: DataFrame) -> int:
    return store.count()


def in_days(when: Column, start: str, end: str) -> Column:
    """Whether a text that begins with an ISO date falls on the days from ``start`` to ``end``.

    Nothing sorts between the texts that begin with a day and that day with its last
    character raised by one, which is no digit if it was 9.
    """
    first, last = start[:10], end[:10]
    if not last:
        return when >= first
    return (when >= first) & (when < last[:-1] + chr(ord(last[-1]) + 1))


def sync_range(
    spark: SparkSession, path: str, incidents: DataFrame, start: str, end: str, embed: Embedder
) -> DataFrame:
    """Add the incidents resolved from the day ``start`` to the day ``end`` (both included) and report.

    ``resolved_at`` holds ISO dates as text, with or without a time, so the order of texts is
    the order of days; the range is asked of the column as it is, so that it prunes files.
    """
    chosen = drop_blank_ids(incidents.where(in_days(F.col("resolved_at"), start, end)))
    docs = materialise(store_documents(chosen), "chosen")
    added = append_new(spark, path, docs, embed)
    return sync_report(spark, docs.count(), added)


_MARK = "mark string, rows long"


def sync_since(
    spark: SparkSession, path: str, incidents: DataFrame, embed: Embedder, marks: str, until: str | None = None
) -> DataFrame:
    """Add the incidents resolved after the last sync, up to the day ``until``, and report.

    The greatest ``resolved_at`` that was synced is kept at ``marks``; only later ones are
    read, so a repeated sync is empty. The mark is written after the rows, so a lost run is
    done again. Incidents that are entered late, with a time before the mark, need
    :func:`sync_range`.
    """
    known = path_exists(spark, marks)
    mark = spark.read.schema(_MARK).parquet(marks).agg(F.max("mark")).first()[0] if known else None
    when = F.col("resolved_at")
    if mark is not None:
        incidents = incidents.where(when > mark)
    if until is not None:
        incidents = incidents.where(in_days(when, "", until))
    docs = materialise(store_documents(drop_blank_ids(incidents)), "chosen")
    handed_in, newest = docs.agg(F.count(F.lit(1)), F.max("resolved_at")).first()
    added = append_new(spark, path, docs, embed) if handed_in else 0
    if newest:
        spark.createDataFrame([(newest, handed_in)], _MARK).write.mode("append").parquet(marks)
    return sync_report(spark, handed_in, added)


def sync_report(spark: SparkSession, handed_in: int, added: int) -> DataFrame:
    """status, the rows handed in, and of those the rows that were new."""
    status = "synced" if handed_in else "no tickets found"
    return spark.createDataFrame(
        [(status, handed_in, added)], "status string, tickets_added long, rows_added long"
    )
