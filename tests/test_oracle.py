"""Every registered query against its SQL on the smallest driver tables."""

import os

import pytest

from oracle import compare, connect
from panelspark.queries import registered

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
REGISTERED = registered()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in REGISTERED.items() if sql))
def test_equals_sql(spark, con, name):
    fn, sql = REGISTERED[name]
    problems = [p for p in compare(fn(spark, SF_DIR), con, sql) if p != "no rows at all"]
    assert not problems


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in REGISTERED.items() if not sql))
def test_has_rows(spark, name):
    df = REGISTERED[name][0](spark, SF_DIR)
    assert len(df.collect()) > 0 and len(set(df.columns)) == len(df.columns)
