"""Every core query against its SQL over the middle tables; all of them must give rows, those without SQL too."""

import pytest

import __spark_entry__ as entry
from relata.plans import catalogue
from tests.helpers import MIDDLE, rows_of, rows_of_sql

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES) and catalogue.FLAGSHIP in QUERIES


def test_entry_gives_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "id", "score", "rank"] and df.count() > 100


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, MIDDLE)
    found = rows_of(df)
    assert found
    if name in SQL:
        columns, expected = rows_of_sql(SQL[name], MIDDLE)
        assert sorted(df.columns) == columns
        assert found == expected
