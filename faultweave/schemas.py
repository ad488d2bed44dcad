"""Record types and closed value lists."""

from __future__ import annotations

from pyspark.sql import types as T

# The closed lists of the result format.
FAILURE_TYPES = (
    "job_not_trigger",
    "cpu_high",
    "long_running",
    "upstream_dependency",
    "oom",
    "permission_error",
    "python_version",
    "unknown",
)
CONFIDENCE_LEVELS = ("high", "moderate", "low")


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


INCIDENT = T.StructType(
    _strings("request_id", "ticket_id", "job_name", "description", "tws_log", "script_name", "command")
)

# The column names of an incident export.
EXPORT = T.StructType(
    _strings(
        "INCIDENT_ID",
        "JOB_NAME",
        "SCRIPT_NAME",
        "COMMAND",
        "SUMMARY",
        "INCIDENT_DETAILS",
        "RESOLUTION",
        "ROOT_CAUSE",
        "RESOLUTION_CODE",
        "APPLICATION_CODE",
        "FAILURE_TYPE",
        "RESOLVED_BY",
        "RESOLVED_DATE",
    )
    + [T.StructField("MTTD", T.IntegerType()), T.StructField("MTTR", T.IntegerType())]
)

COMMENT = T.StructType(_strings("author", "created", "body"))

TICKET = T.StructType(
    _strings(
        "key",
        "ticket_key",
        "summary",
        "status",
        "priority",
        "description",
        "root_cause",
        "workaround",
        "fix_details",
    )
    + [
        T.StructField("labels", T.ArrayType(T.StringType())),
        T.StructField("comments", T.ArrayType(COMMENT)),
    ]
)

STORE_ATTRIBUTES = (
    "ticket_id",
    "job_name",
    "script_name",
    "resolved_by",
    "resolved_at",
    "failure_type",
    "resolution",
)

STORE = T.StructType(
    _strings("id")
    + [T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("document", T.StringType())]
    + _strings(*STORE_ATTRIBUTES)
)
