"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

import __spark_entry__ as E
from oracle_compare import duck, rows_duck, rows_spark

from conftest import SF_SMALL
from roverlake.plans.oracle import ORACLE
from roverlake.plans.queries import QUERIES

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    cols, rows = rows_spark(E.queries()[name](spark, SF_SMALL))
    if name not in ORACLE:
        assert cols
        return
    dcols, drows = rows_duck(con, ORACLE[name])
    assert cols == dcols
    assert len(rows) == len(drows)
    assert rows == drows


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["robot_id", "bucket", "avg_value", "min_value", "max_value", "data_points"]
    assert df.count() >= 0


def test_entry_lists_every_query():
    assert set(QUERIES) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())


def test_every_query_has_oracle_or_is_stateful():
    rows_only = set(NAMES) - set(ORACLE)
    assert not rows_only
