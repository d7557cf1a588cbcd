"""Every query of the engine against its SQL on DuckDB, on the smallest tables."""

from pathlib import Path

import compare
import pytest

from lumenframe.plans import adapting, contexts, extended, flowing, matching, planning, publishing, refining, registry, searching, shooting  # noqa: F401

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, name):
    df = registry.QUERIES[name](spark, SF)
    columns, data = compare.oracle(SF, registry.ORACLE_SQL[name])
    assert sorted(columns) == sorted(df.columns)
    assert compare.rows(df.columns, df.collect()) == compare.rows(columns, data)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 20
    assert set(e.oracle_sql()) <= set(e.queries())
