"""Every query with SQL against DuckDB; the others give rows."""

import pytest

from dustloom.plans import catalogue
from tests.conftest import SF, canonical


#: On the smallest tables no supplier is near a sample; test_targets_by_cells has pairs.
NO_ROWS = {"j08_targets_x_samples"}


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    want = duck.execute(catalogue.ORACLE[name])
    expected = canonical([d[0] for d in want.description], want.fetchall())
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == expected
    assert expected[1] or name in NO_ROWS, "a query without rows proves nothing"


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
