"""The whole investigation of a table of incidents as one plan."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultweave.functions.failure import classify_failure, resolve_job_name
from faultweave.functions.text import normalise_input
from faultweave.functions.vectors import Embedder
from faultweave.operators.evidence import (
    CONTEXT_FIELDS,
    EVIDENCE_FIELDS,
    EVIDENCE_KEYS,
    Fields,
    assemble,
    diagnosis_context,
    evidence,
    stage_records,
)
from faultweave.operators.history import TOP_K, history_arrays, nearest_by_query, with_query_id
from faultweave.operators.index import indexed_nearest, indexed_rows
from faultweave.operators.recommend import recommend
from faultweave.operators.scripts import node_for_job, script_lookup
from faultweave.operators.tickets import FIRST_N, posted_ticket_matches, ticket_arrays, ticket_matches
from faultweave.session import in_this_context, materialise


@dataclass(frozen=True)
class Knowledge:
    """The tables an investigation looks things up in.

    ``embed`` makes the vector of a question and must be the one the store was built
    with, giving ``dim`` values. ``playbook`` has failure_type, root_cause and actions. With
    ``index`` and ``postings``, the paths of kept indexes of the store and of the ticket texts,
    searches read the indexes' folders for the jobs at hand and not all rows.
    """

    store: DataFrame
    tickets: DataFrame
    scripts: DataFrame
    nodes: DataFrame
    embed: Embedder
    dim: int
    playbook: DataFrame
    repo: dict[str, str] = field(default_factory=dict)
    index: str | None = None
    postings: str | None = None


def prepare(incidents: DataFrame, mode: str = "compat") -> DataFrame:
    """Trimmed input with failure_type, a job name that is never blank, and query_id."""
    clean = classify_failure(normalise_input(incidents)).withColumn("given_job_name", F.col("job_name"))
    return with_query_id(resolve_job_name(clean, mode=mode))


def gather(
    incidents: DataFrame,
    known: Knowledge,
    k: int = TOP_K,
    n: int = FIRST_N,
    mode: str = "compat",
    fields: Fields | None = None,
    match_tickets: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One row per incident with everything that was found about it.

    ``fields`` limits what is carried of past incidents, tickets and scripts; by default all.
    ``match_tickets`` may stand in for :func:`ticket_matches`.

    The prepared incidents feed all branches, so they are written once; so are the narrow
    hits, for Spark to know their size before it joins the store's texts to them. The three
    searches do not need each other and run at the same time.
    """
    asked = materialise(prepare(incidents, mode), "asked")
    of_past, of_tickets, script_chars = fields or (None, None, None)

    def search_history() -> DataFrame:
        if known.index:
            hits = materialise(indexed_nearest(asked, known.index, known.store, k, known.embed), "hits")
            # job names are never blank here, so all hits lie under the jobs and scripts asked for
            return history_arrays(hits, indexed_rows(hits, asked, known.index), of_past)
        hits = materialise(nearest_by_query(asked, known.store, k, embed=known.embed, dim=known.dim), "hits")
        return history_arrays(hits, known.store, of_past)

    def search_tickets() -> DataFrame:
        if match_tickets:
            matches = match_tickets(asked)
        elif known.postings:
            matches = materialise(posted_ticket_matches(asked, known.postings, n), "ticket-matches")
        else:
            matches = ticket_matches(asked, known.tickets, n)
        found = ticket_arrays(matches, known.tickets, of_tickets)
        # One row per job name: written out, it is seen to be small, and the incidents need
        # not be shuffled by a job name that many of them share.
        return materialise(found, "tickets")

    def search_scripts() -> DataFrame:
        return script_lookup(asked, known.scripts, script_chars)

    spark = incidents.sparkSession
    with ThreadPoolExecutor(3) as pool:
        searches = (search_history, search_tickets, search_scripts)
        branches = [pool.submit(inheritable_thread_target(spark)(in_this_context(s))) for s in searches]
        history, tickets, scripts = [b.result() for b in branches]
    found = assemble(asked, history, scripts, tickets)
    return evidence(node_for_job(found, known.nodes), known.repo)


def investigate(incidents: DataFrame, known: Knowledge, **options) -> DataFrame:
    """One row per incident: label, recommendation and evidence."""
    return recommend(gather(incidents, known, fields=EVIDENCE_FIELDS, **options), known.playbook).select(
        "request_id",
        "ticket_id",
        "job_name",
        "failure_type",
        "root_cause",
        F.col("actions").alias("recommended_actions"),
        "confidence",
        "historical_tickets",
        "jira_tickets",
        "ticket_total",
        "edge_node_available",
        "bitbucket_config",
        "historical_ticket_ids",
        "jira_ticket_keys",
        "edge_node_ref",
        "bitbucket_ref",
        "escalation_needed",
        "escalation_reason",
    )


def responses(incidents: DataFrame, known: Knowledge, analysis: str | None = None, **options) -> DataFrame:
    """One nested record per incident, in the form a caller of the service gets.

    The job name is the one that was handed in. ``analysis`` names an incident column with
    a diagnosis made elsewhere, if there is one.
    """
    found = recommend(gather(incidents, known, fields=EVIDENCE_FIELDS, **options), known.playbook)
    return found.select(
        "request_id",
        "ticket_id",
        F.col("given_job_name").alias("job_name"),
        "failure_type",
        "root_cause",
        F.col("actions").alias("recommended_actions"),
        "confidence",
        F.struct(*EVIDENCE_KEYS).alias("evidence"),
        "escalation_needed",
        (F.col(analysis) if analysis else F.lit(None).cast("string")).alias("log_analysis"),
        stage_records(analysis).alias("agent_outputs"),
    )


def contexts(incidents: DataFrame, known: Knowledge, **options) -> DataFrame:
    """One diagnosis text per incident."""
    found = gather(incidents, known, fields=CONTEXT_FIELDS, **options)
    return diagnosis_context(found).select("request_id", "context")
