import pytest

from loomdex.plans import oracles, queries


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_matches_sql(spark, sf_dir, duck, same, name):
    same(queries.QUERIES[name](spark, sf_dir), duck, oracles.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracles.ORACLES)))
def test_runs(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0


def test_registry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(queries.QUERIES) <= set(e.queries())
    assert e.entry(spark).count() > 0
