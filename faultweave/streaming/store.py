"""Keeping the store in step with a feed of past incidents."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from faultweave.functions.vectors import Embedder
from faultweave.schemas import STORE
from faultweave.session import dropping_tables
from faultweave.sources.exports import drop_blank_ids, resolve_headers
from faultweave.sources.store import append_new, store_documents


def store_stream(
    feed: DataFrame, path: str, embed: Embedder, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Add each micro-batch to the store at ``path``.

    A stored id wins over a new row, and inside a batch the row with the smallest ``seq``
    wins, so repeating a batch adds nothing.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        docs = store_documents(drop_blank_ids(resolve_headers(batch)))
        with dropping_tables(batch.sparkSession):
            append_new(batch.sparkSession, path, docs, embed, repeats="first")

    writer = feed.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def _first_rows(keep: timedelta | None):
    """The row of an id that has no state, the one with the smallest place; the id is then remembered."""

    def first(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = state.exists
        least = None
        # a known id needs no look at its rows; most ids have one row, which needs no comparison
        for part in () if known else parts:
            if len(part) == 1:
                row = part
            else:
                row = part.nsmallest(1, "seq") if "seq" in part and part["seq"].notna().any() else part.head(1)
            if least is None or ("seq" in row and row["seq"].iloc[0] < least["seq"].iloc[0]):
                least = row
        if least is not None:
            yield least
        if not known:
            state.update((True,))
        if keep:
            state.setTimeoutDuration(int(keep.total_seconds() * 1000))

    return first


def store_stream_by_state(
    feed: DataFrame,
    path: str,
    embed: Embedder,
    checkpoint: str,
    keep: timedelta | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Add a feed to a store of its own at ``path`` without ever reading that store.

    The state of the stream knows all ids, or with ``keep`` those of that time, so an id that
    the feed repeats is added once: its first row, and inside a batch the one with the
    smallest ``seq``. Ids can only be forgotten by a stream that goes on. A batch owns the folder ``batch_id=<n>`` and overwrites it; its input
    and state are in the checkpoint, so a repeated batch leaves the same rows.
    """
    if keep and available_now:
        raise ValueError("a run that ends cannot forget ids after a time")
    timeout = GroupStateTimeout.ProcessingTimeTimeout if keep else GroupStateTimeout.NoTimeout
    docs = store_documents(drop_blank_ids(resolve_headers(feed)))
    # A group costs by its columns, so the texts travel as one.
    texts = [c for c in docs.columns if c not in ("id", "seq")]
    packed = docs.select("id", *(["seq"] if "seq" in docs.columns else []), F.array(*texts).alias("texts"))
    first = packed.groupBy("id").applyInPandasWithState(
        _first_rows(keep), packed.schema, "seen boolean", "append", timeout
    )
    first = first.select("id", *[F.get("texts", F.lit(i)).alias(c) for i, c in enumerate(texts)])

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("embedding", embed(batch["document"])).select(*STORE.fieldNames())
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = first.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
