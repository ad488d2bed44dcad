"""Root cause, actions, confidence and escalation per failure type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultweave.functions.text import coerce_enum
from faultweave.schemas import CONFIDENCE_LEVELS, FAILURE_TYPES

ESCALATION_REASON = "Confidence is low, so a person should review this incident"

def confidence(failure_type: Column, past: Column, tickets: Column, on_node: Column) -> Column:
    """How sure a recommendation is, by what evidence was found."""
    high, moderate = F.lit("high"), F.lit("moderate")

    def if_any(found: Column) -> Column:
        return F.when(found, high).otherwise(moderate)

    return (
        F.when(failure_type.isin("job_not_trigger", "upstream_dependency"), if_any((past > 0) | (tickets > 0)))
        .when(failure_type.isin("cpu_high", "oom", "python_version"), if_any(past > 0))
        .when(failure_type == "long_running", if_any(on_node))
        .when(failure_type == "permission_error", high)
        .otherwise(F.lit("low"))
    )


def recommend(found: DataFrame, playbook: DataFrame) -> DataFrame:
    """Add root_cause, actions, confidence, escalation_needed and escalation_reason.

    ``found`` has failure_type, historical_tickets, jira_tickets and edge_node_available.
    ``playbook`` is the user's table of failure_type, root_cause and actions (an array);
    types without a row get nulls, of several rows of a type the smallest counts. Reduced to
    the closed list of types it has at most eight rows, so it is broadcast.
    """
    rule = F.struct("root_cause", "actions")
    rules = (
        playbook.where(F.col("failure_type").isin(*FAILURE_TYPES))
        .groupBy("failure_type")
        .agg(F.min(rule).alias("_rule"))
        .select("failure_type", "_rule.*")
    )
    kind = coerce_enum(F.col("failure_type"), FAILURE_TYPES, "unknown")
    sure = confidence(
        F.col("failure_type"), F.col("historical_tickets"), F.col("jira_tickets"), F.col("edge_node_available")
    )
    graded = found.withColumn("failure_type", kind).withColumn(
        "confidence", coerce_enum(sure, CONFIDENCE_LEVELS, "low")
    )
    low = F.col("confidence") == "low"
    return graded.join(F.broadcast(rules), "failure_type", "left").withColumns(
        {"escalation_needed": low, "escalation_reason": F.when(low, F.lit(ESCALATION_REASON))}
    )
