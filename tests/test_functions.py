"""Column functions at their edges."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultweave.functions import failure, scoring, text, vectors
from faultweave.schemas import CONFIDENCE_LEVELS, FAILURE_TYPES


def one(spark, column, **values):
    """The value of a column expression over one row of strings."""
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


def label(spark, log, description=""):
    df = spark.createDataFrame([(log, description)], "tws_log string, description string")
    return failure.classify_failure(df).first().failure_type


@pytest.mark.parametrize(
    "log, description, expected",
    [
        ("Stream NOT SUBMITTED", "", "job_not_trigger"),
        ("stream not submitted", "Predecessor late", "upstream_dependency"),
        ("not trigger AWSBHV026E", "", "upstream_dependency"),
        ("in HOLD state", "", "upstream_dependency"),
        ("on hold", "", "unknown"),
        ("java.lang.OutOfMemoryError", "rc=126", "oom"),
        ("no room left", "", "oom"),
        ("FetchFailedException", "", "oom"),
        ("RC=1260", "", "permission_error"),
        ("Permission denied", "syntax error", "permission_error"),
        ("ModuleNotFoundError: x", "", "python_version"),
        ("runs /usr/bin/python x.py", "", "python_version"),
        ("runs /usr/bin/python3 x.py", "", "unknown"),
        ("runs /usr/bin/python", "x", "python_version"),
        ("CPU exceeded", "", "cpu_high"),
        ("limit exceeded by predecessor", "", "long_running"),
        ("wallclock", "", "long_running"),
        ("did not complete", "", "upstream_dependency"),
        ("", "", "unknown"),
        (None, None, "unknown"),
        (None, "gc overhead", "oom"),
    ],
)
def test_labels(spark, log, description, expected):
    assert label(spark, log, description) == expected


# What the seven sample logs must give, on logs of our own with the same marks.
LOGS = [
    ("Job: DBS_SCORES starts /usr/bin/python run.py\nSyntaxError", "python_version", "DBS_SCORES"),
    ("Job DBS_ARCHIVE ended, exit code 126: permission denied", "permission_error", "Job DBS_ARCHIVE"),
    ("Job DBS_FLOW: AWSBHV026E stream not submitted, predecessor pending", "upstream_dependency", "Job DBS_FLOW"),
    ("Job DBS_RECON uses CPU 97 %, limit exceeded", "cpu_high", "Job DBS_RECON"),
    ("job DBS_EOD is in HOLD state", "upstream_dependency", "job DBS_EOD"),
    ("job DBS_RISK: high cpu on node", "cpu_high", "job DBS_RISK"),
    ("Job DBS_TOTALS: ExecutorLostFailure, java heap space", "oom", "Job DBS_TOTALS"),
]


@pytest.mark.parametrize("log, kind, job", LOGS)
def test_sample_logs(spark, log, kind, job):
    df = spark.createDataFrame([(log, "")], "tws_log string, description string")
    row = failure.classify_failure(df).select("failure_type", failure.job_name_in(F.col("tws_log")).alias("job")).first()
    assert tuple(row) == (kind, job)


@pytest.mark.parametrize(
    "details, summary, given, found",
    [
        ("permission check hit a syntax error", "script fails", "permission_error", "python_version"),
        ("interpreter of the host is old", "wrong interpreter", "python_version", "unknown"),
        ("the upstream feed exceeded its window", "late feed", "upstream_dependency", "long_running"),
        ("upstream ended but the plan did not trigger the run", "no start", "upstream_dependency", "job_not_trigger"),
    ],
)
def test_rules_win_over_given_labels(spark, details, summary, given, found):
    """Cases in which past incidents carry another label than the rules give."""
    assert label(spark, details, summary) == found != given


def test_labels_are_a_closed_list():
    assert {name for name, _ in failure.KEYWORDS} | {"unknown", "job_not_trigger"} == set(FAILURE_TYPES)
    assert CONFIDENCE_LEVELS == ("high", "moderate", "low")


@pytest.mark.parametrize(
    "log, compat, name",
    [
        ("Job: DBS_X ended", "DBS_X", "DBS_X"),
        ("Job DBS_X ended", "Job DBS_X", "DBS_X"),
        ("see job:DBS_LOAD", "DBS_LOAD", "DBS_LOAD"),
        ("Job AAA then job BBB", "job BBB", "BBB"),
        ("DBS_A_B2 failed", "DBS_A_B", "DBS_A_B"),
        ("job: : Q", "Q", "Q"),
        ("job Q", "job Q", "Q"),
        ("joby X", None, None),
        ("nothing", None, None),
    ],
)
def test_job_names(spark, log, compat, name):
    assert one(spark, failure.job_name_in(F.col("t")), t=log) == compat
    assert one(spark, failure.job_name_in(F.col("t"), "name"), t=log) == name


def test_job_name_mode_is_checked():
    with pytest.raises(ValueError):
        failure.job_name_in(F.lit("x"), "other")


def test_blank_job_names_are_filled(spark):
    df = spark.createDataFrame(
        [("A", "job B", ""), ("", "job B", ""), (None, "", "Job: C"), ("", "x", "y")],
        "job_name string, tws_log string, description string",
    )
    assert [r.job_name for r in failure.resolve_job_name(df).collect()] == ["A", "job B", "C", "UNKNOWN"]


def test_ticket_keys(spark):
    def keys(t):
        return one(spark, failure.ticket_keys(F.col("t")), t=t)

    assert keys("OPS-1, see OPS-1 and AB-22.") == ["OPS-1", "OPS-1", "AB-22"]
    assert keys("xOPS-1 A-1 ABCDEFGHIJK-1 OPS_1 OPS-") == []
    assert keys("éOPS-1") == []
    stubs = one(spark, failure.ticket_stubs(F.col("t")), t="no key")
    assert [(s.key, s.summary) for s in stubs] == [(None, "no key")]


def test_job_status(spark):
    def state(t):
        return one(spark, failure.job_status(F.col("t")), t=t)

    assert state("incomplete") == "COMPLETE"
    assert state("hold after abend") == "HOLD"
    assert state("Abend running") == "ABEND"
    assert state("") == "NOTFOUND"
    assert one(spark, failure.job_status(F.lit(None).cast("string")), t="") == "UNKNOWN"


def test_input_is_trimmed(spark):
    df = spark.createDataFrame(
        [("\t A \n", "\ufeffJ\u3000", " d ", " l ", " \n", None)],
        "ticket_id string, job_name string, description string, tws_log string, script_name string, command string",
    )
    assert tuple(text.normalise_input(df).first()) == ("A", "J", "d", "l", None, None)


def test_truncate(spark):
    assert one(spark, text.truncate(F.col("t"), 3, "…"), t="abcd") == "abc…"
    assert one(spark, text.truncate(F.col("t"), 3, "…"), t="abc") == "abc"
    assert one(spark, text.truncate(F.col("t"), 2), t="\U0001f600bc") == "\U0001f600b"


@pytest.mark.parametrize(
    "script, expected",
    [("a.py", "a.py"), ("a.sh", "a.sh"), ("a", "a.py"), ("a.pl", "a.pl.py"), ("", "J.py"), (None, "J.py")],
)
def test_script_target(spark, script, expected):
    df = spark.createDataFrame([(script, "J")], "s string, j string")
    assert df.select(text.script_target(F.col("s"), F.col("j"))).first()[0] == expected


def test_environment_is_limited(spark):
    env = F.create_map(*[F.lit(x) for x in ("PATH", "/bin", "path", "x", "JAVA_HOME", "", "HOME", "/h")])
    assert one(spark, text.env_allow_list(env), t="") == {"PATH": "/bin"}


@pytest.mark.parametrize("dim", [1, 31, 32, 33, 100, 1024])
def test_sha_embedding(spark, dim):
    digest = [b / 255.0 for b in hashlib.sha256("café".encode()).digest()]
    expected = [digest[i % 32] for i in range(dim)]
    assert one(spark, vectors.sha_embedding(F.col("t"), dim), t="café") == expected


def test_md5_embedding(spark):
    digest = hashlib.md5(b"x").hexdigest()
    expected = [int(digest[i : i + 2], 16) / 255.0 for i in range(0, 16, 2)]
    assert one(spark, vectors.md5_embedding(F.col("t")), t="x") == expected


def test_encoder_runs_in_batches(spark):
    def make():
        def encode(texts):
            assert len(texts) <= 4
            return np.array([[len(t), 1.0] for t in texts])

        return encode

    df = spark.createDataFrame([("a" * n,) for n in range(11)], "t string")
    out = vectors.embed_column(df, "t", vectors.encoder_embedding(make, batch_size=4)).collect()
    for r in out:
        n = len(r.t)
        assert r.embedding == pytest.approx([n / math.hypot(n, 1), 1 / math.hypot(n, 1)])


def test_dimension_check(spark):
    mixed = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "embedding array<double>")
    with pytest.raises(ValueError):
        vectors.single_dimension(mixed)
    assert vectors.single_dimension(mixed.limit(1)) == 1
    assert vectors.single_dimension(mixed.limit(0)) is None


@pytest.mark.parametrize(
    "score, band",
    [
        (0.0, "low"),
        (0.2999, "low"),
        (0.30, "medium"),
        (0.65, "high"),
        (1.0, "high"),
        (7.0, "high"),
        (-0.1, "high"),
        (float("nan"), "high"),
        (None, None),
    ],
)
def test_risk_band(spark, score, band):
    df = spark.createDataFrame([(score,)], "s double")
    assert df.select(scoring.risk_band(F.col("s"))).first()[0] == band


def test_document_text(spark):
    def document(*parts):
        df = spark.createDataFrame([parts], "s string, d string, r string, j string, x string")
        return df.select(text.document_text(*[F.col(c) for c in "sdrjx"])).first()[0]

    assert document("a", "b", "c", "J", "D") == "a b c"
    assert document(" a", None, "c ", "J", "D") == "a  c"
    assert document(None, None, None, "J", "D") == "D"
    assert document("", " ", None, "J", "D") == "Job: J Description: D"
