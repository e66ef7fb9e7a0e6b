"""Every registered query with an SQL twin, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle_check import connect, duck_rows, first_difference, spark_rows

SF = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    assert first_difference(spark_rows(entry.queries()[name](spark, SF)), duck_rows(con, ORACLE[name])) is None


def test_every_twin_has_a_query():
    assert set(ORACLE) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["project_id", "doc_id", "text", "n_hidden"]
    assert df.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
