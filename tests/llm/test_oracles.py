"""Queries that SQL can express, against it; and all queries on the smallest tables."""

import pytest
from cases import SF
from oracle import compare, connect

from panelspark.llm.queries import QUERIES


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_equals_sql(spark, name):
    fn, sql = QUERIES[name]
    assert not compare(fn(spark, SF), connect(SF), sql)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows(spark, name):
    df = QUERIES[name][0](spark, SF)
    assert len(df.collect()) > 0 and len(set(df.columns)) == len(df.columns)
