import pytest

from cairnworks.plans.all_queries import QUERIES, SQL
from tests.conftest import SMALL
from tests.oracle import connect, rows


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    if name in SQL:
        want = con.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got) > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["gc_league", "nearby_five", "upsert_sticky", "binding_cascade"])
def test_partitions_do_not_matter(spark, name):
    first = rows(QUERIES[name](spark, SMALL).toPandas())
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert rows(QUERIES[name](spark, SMALL).toPandas()) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
