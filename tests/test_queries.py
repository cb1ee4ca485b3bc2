"""Every registered query against its SQL in DuckDB, over whole tables at two sizes."""

from __future__ import annotations

import pytest
from compare import connect, differ

from quillon import queries as core

SQL = core.oracle_sql()


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_matches_sql(spark, medium, name):
    df = core.queries()[name](spark, medium)
    if name in SQL:
        assert differ(df, connect(medium), SQL[name]) == ""
    else:
        df.collect()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(core.queries())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns
    assert set(e.oracle_sql()) <= set(e.queries())
