from pathlib import Path

import pytest

import __spark_entry__ as entry
import compare

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def sql():
    return compare.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sql, name):
    columns, rows = compare.spark_rows(QUERIES[name](spark, SF_DIR))
    sql_columns, sql_rows = compare.sql_rows(sql, ORACLES[name])
    assert columns == sql_columns
    assert len(rows) == len(sql_rows)
    assert compare.differences(rows, sql_rows) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_fitted_models_give_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    frame = entry.entry(spark)
    assert len(frame.columns) == 270
    assert frame.count() > 0
