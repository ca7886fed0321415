import pytest

from quern.plans.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, duck, sf_dir, check_rows, name):
    check_rows(QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLE_SQL[name]).fetchdf())


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
