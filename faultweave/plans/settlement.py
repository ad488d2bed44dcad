"""Settlement totals and the gate before a settlement run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultweave.functions.failure import job_status
from faultweave.operators.skew import skewed_join


def settlement_totals(netting: DataFrame) -> DataFrame:
    """Gross, net and record count per date and currency; missing amounts count as 0."""
    zero = F.lit(0)
    return netting.groupBy("date", "currency").agg(
        F.sum(F.coalesce("gross_amount", zero)).alias("gross"),
        F.sum(F.coalesce("net_amount", zero)).alias("net"),
        F.count("*").alias("records"),
    )


def predecessor_gate(jobs: DataFrame, statuses: DataFrame, strict: bool = False, skewed: bool = False) -> DataFrame:
    """Add predecessor_status, go and exit_code to jobs.

    ``statuses`` has one row per job with its status text; a job without a row is not
    found. A held or ended predecessor blocks with code 2; ``strict`` lets only a
    completed one pass and blocks with code 1. With ``skewed``, predecessors that very many
    jobs wait for are found and dealt first.
    """
    states = statuses.select(F.col("job").alias("predecessor"), job_status(F.col("status_text")).alias("_state"))
    status = F.coalesce("_state", F.lit("NOTFOUND"))
    if strict:
        go: Column = status == "COMPLETE"
        code = 1
    else:
        go = ~status.isin("HOLD", "ABEND")
        code = 2
    keys = ["predecessor"]
    both = skewed_join(jobs, states, keys, "left") if skewed else jobs.join(states, keys, "left")
    return both.select(
        *[c for c in jobs.columns],
        status.alias("predecessor_status"),
        go.alias("go"),
        F.when(go, F.lit(0)).otherwise(F.lit(code)).alias("exit_code"),
        status.isin("COMPLETE", "UNKNOWN").alias("logged"),
    )
