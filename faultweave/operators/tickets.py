"""Tracker tickets that name a job.

A ticket matches when the lower-cased job name occurs anywhere in its summary, its
description or its joined labels. Ticket texts are read by a multi-pattern matcher over the
distinct job names, or by their grams where names are many, which gives (name, ticket)
rows; Spark counts them and takes the first.
"""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultweave.functions.text import or_empty
from faultweave.operators.postings import matcher, pairs_by_blocks, posted_pairs
from faultweave.operators.topk import ranked_array, top_k
from faultweave.session import materialise, path_exists

FIRST_N = 3
#: Characters of names that a worker may hold.
NAME_CHARS = 4 << 20


def _worker_matcher(token: str, shared) -> Callable[[str], set[str]]:
    """The matcher of this pass, built once per Python worker.

    It is kept in a module of the worker's own, since functions that travel with a job get
    new globals with every task.
    """
    place = sys.modules.setdefault("_ticket_matcher", types.ModuleType("_ticket_matcher"))
    if getattr(place, "token", None) != token:
        place.token, place.find = token, matcher(shared.value)
    return place.find


def _name_rows(shared, token: str):
    """(name, seq) of every name that a ticket holds, once per ticket."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _worker_matcher(token, shared)
        for batch in batches:
            names: list[str] = []
            tickets: list[int] = []
            for seq, *texts in zip(*(column.to_pylist() for column in batch.columns)):
                held = set().union(*map(find, texts))
                names.extend(held)
                tickets.extend([seq] * len(held))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(tickets, pa.int64())], names=["name", "seq"]
            )

    return scan


def label_text(labels: Column) -> Column:
    return F.array_join(F.coalesce(labels, F.array().cast("array<string>")), " ")


def first_n_in_order(matches: DataFrame, n: int = FIRST_N, key: str = "name", order: str = "seq") -> DataFrame:
    """The first ``n`` rows per key with the full count of its rows in ``total``.

    The counts come from a partial aggregation and the rows from a salted top-k, so no key
    is gathered in one place.
    """
    totals = matches.groupBy(key).agg(F.count("*").alias("total"))
    return top_k(matches, [key], [F.col(order)], n, spread=[order]).join(totals, key)


def ticket_texts(tickets: DataFrame) -> DataFrame:
    """seq and the lower-cased texts that are looked through: summary, description, joined labels."""
    joined = label_text(F.col("labels")) if dict(tickets.dtypes)["labels"].startswith("array") else F.col("labels")
    return tickets.select(
        F.col("seq").cast("long").alias("seq"),
        F.lower(or_empty(F.col("summary"))).alias("summary"),
        F.lower(or_empty(F.col("description"))).alias("description"),
        F.lower(or_empty(joined)).alias("labels"),
    )


def _asked_names(jobs: DataFrame) -> DataFrame:
    return materialise(jobs.select(F.lower("job_name").alias("name")).where("name <> ''").distinct(), "names")


def ticket_matches(
    jobs: DataFrame, tickets: DataFrame, n: int = FIRST_N, name_chars: int = NAME_CHARS
) -> DataFrame:
    """The first ``n`` tickets per lower-cased job name: name, seq, rank, total.

    ``tickets`` has seq (the file order), summary, description and labels (an array, or
    text that is already joined). Up to ``name_chars`` characters of names, enough for more
    than a hundred thousand, go to the workers, which read the ticket texts once. More
    names stay in Spark and are looked up by their grams in blocks of texts (``postings``).
    """
    spark = tickets.sparkSession
    names = _asked_names(jobs)
    size = names.agg(F.sum(F.length("name")).alias("chars")).first().chars or 0
    if size == 0:
        return spark.createDataFrame([], "name string, seq long, rank int, total long")
    texts = ticket_texts(tickets)
    if size > name_chars:
        rows = pairs_by_blocks(names, texts)
    else:
        shared = spark.sparkContext.broadcast([r.name for r in names.collect()])
        rows = texts.mapInArrow(_name_rows(shared, uuid.uuid4().hex), "name string, seq long")
    found = materialise(rows, "ticket-names")
    return materialise(first_n_in_order(found, n), "ticket-matches")


def posted_ticket_matches(asked: DataFrame, path: str, n: int = FIRST_N) -> DataFrame:
    """As :func:`ticket_matches`, from the index that ``postings.write_postings`` keeps of the ``ticket_texts``."""
    found = materialise(posted_pairs(_asked_names(asked), path), "ticket-names")
    return first_n_in_order(found, n)


def kept_ticket_matches(
    asked: DataFrame, tickets: DataFrame, path: str, owner: int, n: int = FIRST_N
) -> DataFrame:
    """:func:`ticket_matches` that remembers its answers at ``path``, also for names without a match.

    Tickets are read for names that no other owner has asked for. An owner, such as a
    micro-batch, rewrites its own folder, so it may be repeated. The answers hold as long as
    the tickets do not change; give another path for other tickets.
    """
    spark = asked.sparkSession
    schema = "name string, seq long, rank int, total long"
    names = asked.select(F.lower("job_name").alias("name")).where("name <> ''").distinct()
    names = materialise(names, "asked-names")

    def kept() -> DataFrame:
        if not path_exists(spark, path):
            return spark.createDataFrame([], f"{schema}, owner long")
        return spark.read.schema(f"{schema}, owner long").parquet(path)

    known = kept().where(F.col("owner") != owner).select("name").distinct()
    new = materialise(names.join(known, "name", "left_anti"), "new-names")
    if not new.isEmpty():
        found = ticket_matches(new.withColumnRenamed("name", "job_name"), tickets, n)
        rows = new.join(found, "name", "left").select("name", "seq", "rank", "total")
        rows.write.mode("overwrite").parquet(f"{path}/owner={owner}")
    return kept().drop("owner").where("seq IS NOT NULL").join(names, "name", "left_semi").distinct()


TICKET_FIELDS = ("key", "ticket_key", "summary", "fix_details", "root_cause")


def ticket_arrays(
    matches: DataFrame, tickets: DataFrame, fields: dict[str, int | None] | None = None
) -> DataFrame:
    """One row per job name: the ranked array of tickets and the full match count.

    ``fields`` names the ticket columns to carry, each with the number of characters that
    will be read (None for all).
    """
    wanted = fields or dict.fromkeys(TICKET_FIELDS)
    carried = []
    for c, n in wanted.items():
        value = F.col(c) if c in tickets.columns else F.lit(None).cast("string")
        carried.append((F.substring(value, 1, n) if n else value).alias(c))
    chosen = matches.join(tickets.select(F.col("seq").cast("long").alias("seq"), *carried), "seq")
    return chosen.groupBy("name").agg(
        ranked_array("rank", "seq", *wanted).alias("tickets"), F.max("total").alias("ticket_total")
    )


def ticket_match(inc: DataFrame, tickets: DataFrame, n: int = FIRST_N) -> DataFrame:
    """The first ``n`` tickets per incident: request_id, rank, seq, key, total."""
    matches = ticket_matches(inc, tickets, n)
    keyed = matches.join(tickets.select(F.col("seq").cast("long").alias("seq"), "key"), "seq")
    asked = inc.select("request_id", F.lower("job_name").alias("name"))
    return asked.join(keyed, "name").select("request_id", "name", "rank", "seq", "key", "total")
