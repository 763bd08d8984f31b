import pytest
from reprise import registry


# Queries without SQL are in test_brute.py and test_sources.py.
@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_query(spark, agree, small, name):
    agree(spark, registry.QUERIES[name], registry.ORACLES[name], small)


def test_entry_points(spark, small):
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    df = e.entry(spark)
    assert df.schema == e.entry(spark).schema and df.count() > 0
