"""What the plans must and must not hold."""

import re
from pathlib import Path

import pytest

import __spark_entry__ as entry

SOURCES = sorted((Path(entry.__file__).parent / "faultweave").rglob("*.py"))


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize(
    "name",
    ["ticket_match", "history_search", "investigate_incidents", "match_union", "matching_store_rows", "node_for_job", "key_skew"],
)
def test_no_nested_loops(name, spark, sf_dir):
    text = plan(entry.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["log_tail", "top_k_nearest", "first_n_in_order", "history_search"])
def test_groups_are_cut_before_the_shuffle(name, spark, sf_dir):
    assert "Partial" in plan(entry.queries()[name](spark, sf_dir)) and "WindowGroupLimit" in plan(
        entry.queries()[name](spark, sf_dir)
    )


def test_scans_read_only_what_is_used(spark, sf_dir):
    text = plan(entry.queries()["largest_share"](spark, sf_dir))
    assert "ReadSchema: struct<l_returnflag:string>" in text


def test_no_row_functions_local_checkpoints_or_rdds():
    for path in SOURCES:
        code = path.read_text()
        assert not re.search(r"localCheckpoint|\.rdd\b|F\.udf\(|crossJoin|toPandas|\.persist\(|\.cache\(", code), path
