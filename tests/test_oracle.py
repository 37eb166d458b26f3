import pytest

from tests.compare import DATA, of_sql, rows
from tidemark.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    assert rows(QUERIES[name](spark, str(DATA)).toPandas()) == of_sql(SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, str(DATA))
    assert df.columns and df.count() >= 0
