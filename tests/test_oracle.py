"""Every query with a SQL twin gives the same rows in Spark and DuckDB."""

import pytest

import __spark_entry__ as E
from tessera.plans.catalog import ORACLE_SQL
from tests.conftest import SF_SMALL
from tests.util import duck_bag, spark_bag

# those of the training-data queries are tested in tests/llm
KEYS = sorted(ORACLE_SQL)


def test_every_twin_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_sql(spark, duck, key):
    con = duck(SF_SMALL)
    df = E.queries()[key](spark, SF_SMALL)
    assert spark_bag(df) == duck_bag(con, E.oracle_sql()[key])


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["rmse", "scored"]
    assert len(rows) == 1 and rows[0]["scored"] > 0


def test_cold_start_drops_rows(spark):
    from tessera.plans import ratings as R

    kept = E.queries()["cold_start_kept"](spark, SF_SMALL).count()
    assert 0 < kept < R.split(spark, SF_SMALL)[1].count()
