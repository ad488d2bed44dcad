"""Incident exports: reading them and bringing their headers to one form."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultweave.schemas import EXPORT

# Accepted headers per field, first come first served.
HEADERS: dict[str, tuple[str, ...]] = {
    "ticket_id": ("ticket_id", "INCIDENT_ID"),
    "job_name": ("job_name", "JOB_NAME"),
    "script_name": ("script_name", "SCRIPT_NAME"),
    "command": ("command", "COMMAND"),
    "summary": ("summary", "SUMMARY", "DESCRIPTION"),
    "incident_details": ("incident_details", "INCIDENT_DETAILS", "DESCRIPTION"),
    "description": ("description", "DESCRIPTION"),
    "resolution": ("resolution", "RESOLUTION"),
    "failure_type": ("failure_type", "FAILURE_TYPE"),
    "resolved_by": ("resolved_by", "RESOLVED_BY"),
    "resolved_at": ("resolved_at", "RESOLVED_DATE"),
}
MISSING = {"failure_type": "unknown"}


def read_incident_export(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: T.StructType | None = EXPORT,
    multiline: bool = False,
) -> DataFrame:
    """Past incidents from CSV, JSON or Parquet files.

    CSV columns are bound by the names in the header line, whatever their order; of the
    schema's columns those without a header are null. Files of one folder must agree in
    their headers, or reading fails. Give ``schema=None`` for a CSV or Parquet file whose
    headers differ from the usual ones: CSV columns are then all text. Texts with line
    breaks in CSV need ``multiline``, which stops Spark from splitting a file. A blank CSV
    cell is read as null, which :func:`resolve_headers` turns into ''.
    """
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    if fmt == "json":
        if schema is None:
            raise ValueError("JSON exports need a schema; inferring one would read all data twice")
        return spark.read.schema(schema).json(path)
    if fmt == "csv":
        reader = spark.read.option("header", True).option("multiLine", multiline).option("escape", '"')
        rows = reader.option("enforceSchema", False).csv(path)
        return rows if schema is None else _by_name(rows, schema)
    raise ValueError(f"unknown export format {fmt!r}")


def _by_name(rows: DataFrame, schema: T.StructType) -> DataFrame:
    have = set(rows.columns)
    return rows.select(
        *[
            (F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema
        ]
    )


def resolve_headers(raw: DataFrame) -> DataFrame:
    """The eleven text fields of an incident, each from the first header that is present.

    A field without a header gets its default; a missing value in a present column
    becomes ''.
    """
    # Headers may differ in case only, so columns are addressed by position.
    position = {name: f"_c{i}" for i, name in reversed(list(enumerate(raw.columns)))}
    numbered = raw.toDF(*[f"_c{i}" for i in range(len(raw.columns))])
    fields = []
    for field, headers in HEADERS.items():
        present = next((h for h in headers if h in position), None)
        value = F.lit(MISSING.get(field, ""))
        if present:
            value = F.coalesce(F.col(position[present]).cast("string"), F.lit(""))
        fields.append(value.alias(field))
    extra = [F.col(position["seq"]).alias("seq")] if "seq" in position else []
    return numbered.select(*fields, *extra)


def drop_blank_ids(incidents: DataFrame) -> DataFrame:
    return incidents.where(F.col("ticket_id") != "")


def union_batches(batches: Sequence[DataFrame]) -> DataFrame:
    """Several lists of incidents as one table, matched by column name."""
    return reduce(lambda a, b: a.unionByName(b), batches)
