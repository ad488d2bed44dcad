"""Investigating a stream of incidents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from faultweave.functions.failure import classify_failure
from faultweave.functions.text import normalise_input
from faultweave.operators.tickets import kept_ticket_matches
from faultweave.plans.investigate import Knowledge, investigate
from faultweave.session import dropping_tables


def label_stream(incidents: DataFrame) -> DataFrame:
    """The stateless part: trimmed input with failure_type, fit for a streaming frame as it is."""
    return classify_failure(normalise_input(incidents))


def investigate_stream(
    incidents: DataFrame,
    known: Callable[[], Knowledge],
    out: str,
    checkpoint: str,
    available_now: bool = True,
    kept_tickets: str | None = None,
    **options,
) -> StreamingQuery:
    """Investigate every micro-batch as the batch form does and write the results to ``out``.

    A batch owns the folder ``batch_id=<n>`` and overwrites it, so a repeated batch leaves
    the same rows. ``known`` is asked per batch and so sees a store that has grown. With
    ``kept_tickets``, a folder for tickets that do not change, the tickets found for a job
    name are kept there, and the ticket texts are read for new names only.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        with dropping_tables(batch.sparkSession):
            knowledge = known()
            match = None
            if kept_tickets:
                match = lambda asked: kept_ticket_matches(asked, knowledge.tickets, kept_tickets, batch_id)
            results = investigate(batch, knowledge, match_tickets=match, **options)
            results.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    writer = incidents.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
