"""Each registered query against its SQL; those without SQL give rows of a stable schema."""

import pytest
from conftest import same_rows

from corpusgraph.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_agrees_with_sql(spark, sf, duck, name):
    same_rows(registry.QUERIES[name](spark, sf), duck, registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_gives_rows(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark, sf):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["vec_id", "label", "score", "rank"] and df.count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
