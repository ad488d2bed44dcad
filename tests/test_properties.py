"""Text rules against Python restatements of them, on many made-up texts at once."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faultweave.functions import failure, text

FRAGMENTS = st.sampled_from(
    ["job", "Job", ":", " ", "\t", "\u00a0", "\u2003", "\n", "DBS_", "A_B", "X", "x", "9", "OPS-12", "AB-", "-7", "Q-1"]
    + ["\u00e9", "\u00b2", "\u0661", "_", "ABCDEFGHIJK-3", "\u0301", "\x1c", "\x0b", "\u3000", "\ufeff", "\u00c9"]
)
TEXTS = st.lists(st.lists(FRAGMENTS, max_size=9).map("".join), min_size=150, max_size=150)
BULK = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def evaluate(spark, texts, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


@BULK
@given(TEXTS)
def test_ticket_keys(spark, texts):
    got = evaluate(spark, texts, failure.ticket_keys(F.col("t")))
    assert [list(r[0]) for r in got] == [re.findall(r"\b[A-Z]{2,10}-\d+\b", t) for t in texts]


NAMED = [re.compile(lead + "[A-Z_]+") for lead in (r"job[:\s]+", r"Job[:\s]+", "DBS_")]


def job_name(t):
    hits = (pattern.search(t) for pattern in NAMED)
    return next((h[0].rpartition(":")[2].strip() for h in hits if h), None)


@BULK
@given(TEXTS)
def test_job_names(spark, texts):
    got = evaluate(spark, texts, failure.job_name_in(F.col("t")))
    assert [r[0] for r in got] == [job_name(t) for t in texts]


@BULK
@given(TEXTS)
def test_trimming_and_cutting(spark, texts):
    got = evaluate(spark, texts, text.strip(F.col("t")), text.truncate(F.col("t"), 5, "~"))
    assert got == [(t.strip(), t[:5] + ("~" if len(t) > 5 else "")) for t in texts]
