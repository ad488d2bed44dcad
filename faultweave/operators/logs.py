"""The end of each log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultweave.operators.topk import top_k

TAIL_LINES = 100


def log_tail_lines(log_lines: DataFrame, n: int = TAIL_LINES) -> DataFrame:
    """The last ``n`` lines of each log, one row per line, with ``total_lines``."""
    totals = log_lines.groupBy("log_name").agg(F.count("*").alias("total_lines"))
    tail = top_k(log_lines, ["log_name"], [F.col("line_no").desc()], n, spread=["line_no"], rank="from_end")
    return tail.join(totals, "log_name")


def log_tail(log_lines: DataFrame, n: int = TAIL_LINES, manifest: DataFrame | None = None) -> DataFrame:
    """One row per log: content of the last ``n`` lines, total_lines, returned_lines.

    At most ``n`` lines per log are gathered. Every line ends in a line feed, as lines of a
    log do; a last line without one gets it. Logs named in ``manifest`` that have no
    lines (Spark's readers skip empty files) come out with empty content.
    """
    line = F.struct("line_no", "line")
    tails = (
        log_tail_lines(log_lines, n)
        .groupBy("log_name")
        .agg(
            F.array_sort(F.collect_list(line)).alias("_lines"),
            F.max("total_lines").alias("total_lines"),
            F.count("*").alias("returned_lines"),
        )
        .select(
            "log_name",
            F.array_join(F.transform("_lines", lambda x: F.concat(F.coalesce(x["line"], F.lit("")), F.lit("\n"))), "").alias(
                "content"
            ),
            "total_lines",
            "returned_lines",
        )
    )
    if manifest is None:
        return tails
    return (
        manifest.select("log_name")
        .distinct()
        .join(tails, "log_name", "left")
        .na.fill({"content": "", "total_lines": 0, "returned_lines": 0})
    )
