import pytest
from checks import same

from burstframe.plans import catalogue

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, data, name):
    same(spark, f"{data}/sf0.001", catalogue.queries()[name], SQL[name])


def test_every_query_without_peeling_has_sql():
    assert set(catalogue.queries()) - set(SQL) == {"composition_peel", "cull_run"}


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["photos", "bursts"]
