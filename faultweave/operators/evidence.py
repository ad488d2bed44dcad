"""Fan-in of the search results to one row per incident, and what is read off them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultweave.functions.text import non_empty, or_empty, script_request, truncate
from faultweave.operators.scripts import node_ref, repo_ref
from faultweave.operators.trace import base_name

# How much of each text goes into a diagnosis text, and how many entries.
SCRIPT_CHARS = 3000
SUMMARY_CHARS = 120
OUTCOME_CHARS = 160
CONTEXT_ENTRIES = 3
NOTHING = "None found"

Fields = tuple[dict[str, int | None], dict[str, int | None], int | None]

# What evidence and a diagnosis text read of each past incident, each ticket and each script.
EVIDENCE_FIELDS: Fields = ({"ticket_id": None}, {"key": None, "ticket_key": None}, 1)
CONTEXT_FIELDS: Fields = (
    {"ticket_id": None, "description": SUMMARY_CHARS, "resolution": OUTCOME_CHARS},
    {"key": None, "ticket_key": None, "summary": SUMMARY_CHARS, "fix_details": None, "root_cause": OUTCOME_CHARS},
    SCRIPT_CHARS + 1,
)

# The keys of the evidence record, and the stages of an investigation.
EVIDENCE_KEYS = (
    "historical_tickets",
    "jira_tickets",
    "edge_node_available",
    "bitbucket_config",
    "historical_ticket_ids",
    "jira_ticket_keys",
    "edge_node_ref",
    "bitbucket_ref",
)
STAGES = (
    "historical_search",
    "bitbucket_context",
    "edge_node_script",
    "jira_intelligence",
    "log_analysis",
    "resolution_synthesis",
)


def assemble(inc: DataFrame, history: DataFrame, scripts: DataFrame, tickets: DataFrame) -> DataFrame:
    """One row per incident with what each search found.

    Every branch has one row per question, per (job, script) or per job name, not per
    incident: equal incidents share one result until here, and each join has a unique
    right side, so a hot job only grows the left side, which Spark can split.
    """
    own = F.coalesce(F.col("script_name"), F.lit(""))
    no_history = F.array().cast(history.schema["history"].dataType)
    no_tickets = F.array().cast(tickets.schema["tickets"].dataType)
    found_scripts = scripts.withColumn("_script", own).drop("script_name")
    return (
        inc.withColumn("_script", own)
        .withColumn("name", F.lower("job_name"))
        .join(history, "query_id", "left")
        .join(found_scripts, ["job_name", "_script"], "left")
        .join(tickets, "name", "left")
        .drop("_script", "name")
        .withColumns(
            {
                "history": F.coalesce("history", no_history),
                "tickets": F.coalesce("tickets", no_tickets),
                "ticket_total": F.coalesce("ticket_total", F.lit(0).cast("long")),
            }
        )
    )


def ticket_key(t: Column) -> Column:
    return F.coalesce(non_empty(t["key"]), non_empty(t["ticket_key"]))


def evidence(found: DataFrame, repo: dict[str, str]) -> DataFrame:
    """Add counts, id lists and reference paths.

    ``repo`` names workspace, repo, path and branch of the script repository.
    """
    path = F.col("resolved_path") if "resolved_path" in found.columns else F.lit(None).cast("string")
    script = script_request(F.coalesce(non_empty(F.col("script_name")), base_name(path)), F.col("job_name"))
    ids = F.filter(F.transform("history", lambda t: non_empty(t["ticket_id"])), lambda i: i.isNotNull())
    keys = F.filter(F.transform("tickets", ticket_key), lambda k: k.isNotNull())
    configured = F.col("config_script").isNotNull()
    full = repo_ref(
        F.lit(repo.get("workspace", "")),
        F.lit(repo.get("repo", "")),
        F.lit(repo.get("path", "")),
        F.lit(repo.get("branch", "main")),
        path,
        script,
    )
    on_node = F.coalesce(F.col("on_node"), F.lit(False)) & F.col("node").isNotNull()
    return found.withColumns(
        {
            "historical_tickets": F.size("history"),
            "jira_tickets": F.size("tickets"),
            "edge_node_available": on_node,
            "bitbucket_config": configured,
            "historical_ticket_ids": ids,
            "jira_ticket_keys": keys,
            "edge_node_ref": node_ref(on_node, F.col("node"), script),
            "bitbucket_ref": F.when(configured, full),
        }
    )


def _listing(entries: Column) -> Column:
    return F.when(F.size(entries) == 0, F.lit(NOTHING)).otherwise(F.array_join(entries, "\n"))


def _past_line(t: Column) -> Column:
    about = truncate(or_empty(t["description"]), SUMMARY_CHARS)
    outcome = truncate(or_empty(t["resolution"]), OUTCOME_CHARS)
    return F.concat(F.lit("* "), or_empty(t["ticket_id"]), F.lit(" | "), about, F.lit(" | "), outcome)


def _ticket_line(t: Column) -> Column:
    about = truncate(or_empty(t["summary"]), SUMMARY_CHARS)
    # A fix is quoted in full, only a root cause in its place is cut.
    outcome = F.coalesce(non_empty(t["fix_details"]), truncate(or_empty(t["root_cause"]), OUTCOME_CHARS))
    return F.concat(F.lit("* "), F.coalesce(ticket_key(t), F.lit("?")), F.lit(" | "), about, F.lit(" | "), outcome)


def diagnosis_context(found: DataFrame, out: str = "context") -> DataFrame:
    """Add one text per incident that holds all a later reader needs."""
    script = F.coalesce(
        non_empty(F.col("config_content")), non_empty(F.col("node_content")), F.lit("No script text available")
    )
    past = F.transform(F.slice("history", 1, CONTEXT_ENTRIES), _past_line)
    tickets = F.transform(F.slice("tickets", 1, CONTEXT_ENTRIES), _ticket_line)
    sections = [
        F.concat(F.lit("Job: "), F.col("job_name")),
        F.concat(F.lit("Failure type: "), F.col("failure_type")),
        F.concat(F.lit("Description: "), or_empty(F.col("description"))),
        F.concat(F.lit("Scheduler log:\n"), or_empty(F.col("tws_log"))),
        F.concat(
            F.lit("Script "), or_empty(F.col("script_name")), F.lit(":\n"), truncate(script, SCRIPT_CHARS, "…")
        ),
        F.concat(F.lit("Past incidents:\n"), _listing(past)),
        F.concat(F.lit("Tickets:\n"), _listing(tickets)),
    ]
    return found.withColumn(out, F.concat_ws("\n\n", *sections))


def stage_records(analysis: str | None = None) -> Column:
    """The six stages of one incident as an array of stage, status, metric, value."""
    text = F.col(analysis) if analysis else F.lit(None).cast("string")
    analysed = non_empty(text).isNotNull()

    def row(stage: str, metric: str, value: Column, done: Column | None = None) -> Column:
        status = F.lit("completed") if done is None else F.when(done, "completed").otherwise("skipped")
        return F.struct(
            F.lit(stage).alias("stage"),
            status.alias("status"),
            F.lit(metric).alias("metric"),
            value.cast("string").alias("value"),
        )

    rows = [
        row(STAGES[0], "results_count", F.col("historical_tickets")),
        row(STAGES[1], "config_found", F.col("bitbucket_config")),
        row(STAGES[2], "script_retrieved", F.col("edge_node_available")),
        row(STAGES[3], "tickets_found", F.col("jira_tickets")),
        row(STAGES[4], "status", F.when(analysed, "completed").otherwise("unavailable"), analysed),
        row(STAGES[5], "", F.lit("")),
    ]
    return F.array(*rows)


def stage_outcomes(found: DataFrame, analysis: str | None = None) -> DataFrame:
    """Six rows per incident: request_id, stage, status, metric, value."""
    return found.select("request_id", F.explode(stage_records(analysis)).alias("s")).select("request_id", "s.*")


def stage_summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("stage", "status").agg(F.count("*").alias("n"))
