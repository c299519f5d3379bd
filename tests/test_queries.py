"""Every registered query of the library against its SQL, on the smallest tables."""

import pytest

from cairnlake.queries import QUERIES, SQL

from .compare import connect, spark_rows, sql_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    names, rows = spark_rows(QUERIES[name](spark, SF))
    if name in SQL:
        want_names, want = sql_rows(con, SQL[name])
        assert names == want_names
        assert rows == want
    else:
        assert names


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
