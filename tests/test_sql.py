"""Every core query with SQL gives DuckDB's rows, and every one without runs; on the smallest tables."""

import pytest

from procmill import queries as Q
from tools.compare import compare, duck

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(D)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_rows(spark, con, name):
    said = compare(spark, con, D, name, Q.QUERIES[name], Q.SQL.get(name))
    assert said.endswith(("rows equal", "rows, no SQL")), said


def test_entry_without_and_with_more():
    import __spark_entry__ as E

    assert set(Q.QUERIES) <= set(E.queries()) and set(Q.SQL) <= set(E.oracle_sql()) and set(E.oracle_sql()) <= set(E.queries())
