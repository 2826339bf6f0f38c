import pytest

from __spark_entry__ import entry
from check import difference, tables
from pulse.catalog.oracle import all_sql as oracle_sql
from pulse.catalog.queries import all_queries as queries

FOLDER = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(oracle_sql()) <= set(queries())
    assert set(queries()) == set(oracle_sql())


def test_entry_gives_rows(spark):
    assert entry(spark).count() == 9


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_its_sql(spark, name):
    mine = queries()[name](spark, FOLDER).toPandas()
    assert len(mine) > 0
    if name in oracle_sql():
        assert difference(mine, tables(FOLDER).execute(oracle_sql()[name]).df()) is None
