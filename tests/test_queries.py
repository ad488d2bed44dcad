"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry
from faultweave.queries.catalog import QUERIES
from faultweave.queries.oracle import ORACLE
from tests.compare import difference, spark_side, sql_side


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(name, spark, con, sf_dir):
    ours = spark_side(spark, QUERIES[name], sf_dir)
    theirs = sql_side(con, ORACLE[name])
    assert difference(ours, theirs) == ""


def test_entry_gives_one_row_per_incident(spark):
    result = entry.entry(spark)
    rows = result.collect()
    assert len(rows) == len({r.request_id for r in rows}) == 1000
    for r in rows:
        assert r.historical_tickets == len(r.historical_ticket_ids) <= 5
        assert len(r.jira_ticket_keys) <= r.jira_tickets <= 3
        assert r.jira_tickets == min(3, r.ticket_total)
        assert r.escalation_needed == (r.confidence == "low") == (r.escalation_reason is not None)
