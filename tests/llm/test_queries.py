"""Registered queries against their SQL, over whole tables."""

import pytest

from faultweave.llm.catalog import ORACLE, QUERIES
from tests.compare import connect, difference, spark_side, sql_side


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(name, spark, con, sf_dir):
    assert difference(spark_side(spark, QUERIES[name], sf_dir), sql_side(con, ORACLE[name])) == ""


def test_vectors_equal_sql_where_there_are_links(spark):
    sf_dir = "/root/testdata/sf0.1"
    ours = spark_side(spark, QUERIES["op10_near_vectors"], sf_dir)
    assert difference(ours, sql_side(connect(sf_dir), ORACLE["op10_near_vectors"])) == ""
