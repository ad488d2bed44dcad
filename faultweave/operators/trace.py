"""What can be read off the event tables of earlier runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultweave.functions.text import non_empty, or_empty

# Event kinds, and the call that fetches a file.
FETCH_CALL = "get_repo_file_content"
CALL_STARTED = "on_tool_start"
MODEL_DONE = "on_chat_model_end"


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def last_call_path(calls: DataFrame, default_name: str | None = None) -> DataFrame:
    """Per run the path of the last file fetch that has one, and its base name.

    ``calls`` has run_id, seq, name, file_path, path, filePath. One aggregation with
    partial results per task; runs without such a call keep a null path.
    """
    path = F.coalesce(*[non_empty(F.col(c)) for c in ("file_path", "path", "filePath")])
    counts = F.contains(F.col("name"), F.lit(FETCH_CALL)) & path.isNotNull()
    last = F.max_by(path, F.when(counts, F.col("seq")))
    columns = [last.alias("resolved_path")]
    if default_name:
        columns.append(F.max(default_name).alias("_default"))
    per_run = calls.groupBy("run_id").agg(*columns)
    name = base_name(F.col("resolved_path"))
    if default_name:
        name = F.coalesce(name, F.col("_default"))
    return per_run.select("run_id", "resolved_path", name.alias("script_name"))


def last_model_text(events: DataFrame) -> DataFrame:
    """Per run the last non-empty model output, '' when there is none."""
    said = (F.col("kind") == MODEL_DONE) & (or_empty(F.col("content")) != "")
    last = F.max_by(F.col("content"), F.when(said, F.col("seq")))
    return events.groupBy("run_id").agg(F.coalesce(last, F.lit("")).alias("final_content"))


def tool_calls(events: DataFrame) -> DataFrame:
    """The calls of every run as rows; ``seq`` gives their order, so no run is gathered."""
    return events.where(F.col("kind") == CALL_STARTED).select("run_id", "seq", "name", "input")
