"""Every registered core query against its SQL on whole tables."""

import pytest

from quernel import queries as registry
from tests.compare import connection, rows

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return connection(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, data, con, name):
    df = QUERIES[name](spark, data)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in SQL:
        found = con.execute(SQL[name])
        assert got == rows([c[0] for c in found.description], found.fetchall())


def test_names_leave_the_numbered_problems_free():
    assert not [n for n in QUERIES if n[0] == "p" and n[1].isdigit()]
