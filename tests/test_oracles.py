"""Every query that has SQL gives the SQL's rows."""

import pytest
from conftest import DATA

from lenticule.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    want = duck.sql(registry.ORACLES[name])
    assert sorted(want.columns) == cols
    rows = want.project(", ".join(f'"{c}"' for c in cols)).fetchall()
    assert rows, "the comparison would be empty"
    assert sorted(map(repr, (tuple(r) for r in got.select(cols).collect()))) == sorted(map(repr, rows))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["image_id", "n", "dx0", "dy0", "dx2", "dy2"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
