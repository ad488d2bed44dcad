"""Failure labels from ordered keyword rules, job names and ticket keys from text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultweave.functions.text import non_empty, or_empty, strip

# Keywords per label, tried in this order on the lower-cased log and
# description. After a hit in NOT_STARTED the keywords of STALLED decide between two labels.
NOT_STARTED = ("not submitted", "not trigger", "hold state")
STALLED = ("predecessor", "hold state", "awsbhv026e")
KEYWORDS = (
    (
        "oom",
        (
            "outofmemory",
            "java heap",
            "oom",
            "executor lost",
            "gc overhead",
            "heap space",
            "fetchfailedexception",
        ),
    ),
    (
        "permission_error",
        ("permission denied", "rc=126", "rc=127", "exit code 126", "exit code 127", "abend rc=126"),
    ),
    (
        "python_version",
        (
            "syntaxerror",
            "invalid syntax",
            "modulenotfounderror",
            "importerror",
            "syntax error",
            "/usr/bin/python ",
        ),
    ),
    ("cpu_high", ("cpu",)),
    ("long_running", ("exceeded", "long-running", "breach", "wallclock")),
    ("upstream_dependency", ("predecessor", "upstream", "did not complete", "awsbhv026e")),
)

# Job name patterns, in order of preference.
_BLANK = r"[:\t\n\x0B\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
JOB_PATTERNS = ((f"job{_BLANK}([A-Z_]+)", 1), (f"Job{_BLANK}([A-Z_]+)", 1), ("DBS_[A-Z_]+", 0))

# Fixed value: the form of a tracker key, 2 to 10 capitals, a dash and digits, as a whole word.
# Letters, numbers of any script and the underscore belong to words.
_WORD = r"[\p{L}\p{N}_]"
TICKET_KEY = rf"(?<!{_WORD})[A-Z]{{2,10}}-\p{{Nd}}+(?!{_WORD})"

# Words looked for in a scheduler status, in this order.
JOB_STATES = ("COMPLETE", "HOLD", "ABEND", "RUNNING")


def _any_of(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in words])


def failure_label(lowered: Column) -> Column:
    """The label for a text that is already lower-cased; the first rule that hits wins."""
    waiting = F.when(_any_of(lowered, STALLED), F.lit("upstream_dependency")).otherwise(F.lit("job_not_trigger"))
    label = F.when(_any_of(lowered, NOT_STARTED), waiting)
    for name, words in KEYWORDS:
        label = label.when(_any_of(lowered, words), F.lit(name))
    return label.otherwise(F.lit("unknown"))


def classify_failure(
    df: DataFrame, log: str = "tws_log", description: str = "description", out: str = "failure_type"
) -> DataFrame:
    """Add the failure label. The lower-cased text is one projected column, made once per row."""
    text = F.lower(search_text(F.col(log), F.col(description)))
    return df.withColumn("_text", text).withColumn(out, failure_label(F.col("_text"))).drop("_text")


def search_text(log: Column, description: Column) -> Column:
    """The text that labels and names are looked for in."""
    return F.concat(or_empty(log), F.lit(" "), or_empty(description))


def job_name_in(text: Column, mode: str = "compat") -> Column:
    """The job a text speaks of, or null.

    ``compat`` gives the whole match after its last colon (so ``Job X`` stays ``Job X``),
    ``name`` gives the bare name.
    """
    if mode not in ("compat", "name"):
        raise ValueError(f"unknown mode {mode!r}")
    hits = []
    for pattern, group in JOB_PATTERNS:
        if mode == "name":
            hits.append(non_empty(F.regexp_extract(text, pattern, group)))
        else:
            hits.append(non_empty(strip(F.substring_index(F.regexp_extract(text, pattern, 0), ":", -1))))
    return F.coalesce(*hits)


def resolve_job_name(
    df: DataFrame,
    job_name: str = "job_name",
    log: str = "tws_log",
    description: str = "description",
    mode: str = "compat",
    out: str | None = None,
) -> DataFrame:
    """Fill blank job names from the texts, and with ``UNKNOWN`` where these name none."""
    named = F.coalesce(non_empty(F.col(job_name)), job_name_in(F.col("_text"), mode), F.lit("UNKNOWN"))
    texts = df.withColumn("_text", search_text(F.col(log), F.col(description)))
    return texts.withColumn(out or job_name, named).drop("_text")


def ticket_keys(text: Column) -> Column:
    """Keys named in a text, in order, repeats kept."""
    return F.regexp_extract_all(text, F.lit(TICKET_KEY), F.lit(0))


def ticket_stubs(text: Column) -> Column:
    """One (key, summary) per named key; a text without keys becomes one keyless summary."""
    keys = ticket_keys(text)
    named = F.transform(keys, lambda k: F.struct(k.alias("key"), F.concat(F.lit("Ticket "), k).alias("summary")))
    bare = F.array(F.struct(F.lit(None).cast("string").alias("key"), text.alias("summary")))
    return F.when(F.size(keys) == 0, bare).otherwise(named)


def job_status(text: Column) -> Column:
    """A scheduler state by substring (so ``incomplete`` counts as COMPLETE); null text is a failed check."""
    upper = F.upper(text)
    state = F.when(text.isNull(), F.lit("UNKNOWN"))
    for word in JOB_STATES:
        state = state.when(F.contains(upper, F.lit(word)), F.lit(word))
    return state.otherwise(F.lit("NOTFOUND"))
