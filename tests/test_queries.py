"""Every registered query of the library against its SQL, over whole tables."""

import pytest

from conftest import comparable
from loamline import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, data, oracle, name):
    df = queries.QUERIES[name](spark, data)
    assert comparable([tuple(r) for r in df.collect()], df.columns) == oracle(queries.ORACLES[name], data, df.columns)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_without_sql(spark, data, name):
    assert queries.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns
