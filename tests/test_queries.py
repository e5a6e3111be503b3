import pytest
from compare import compare, connect

from polyweave.suite import registered

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(registered()))
def test_query_matches_sql(spark, con, name):
    fn, sql = registered()[name]
    ok, text = compare(spark, con, FOLDER, name, fn, sql)
    assert ok, text


def test_entry_contract(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).columns == ["sys", "n", "structures"]
    assert set(registered()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registered()) - set(entry.oracle_sql()) == {"polygen_mixed", "polyenum_mixed"}


def test_queries_without_sql_agree_with_each_other(spark):
    """Mixed shapes have no lattice SQL; the two strategies must count the same."""
    from pyspark.sql import functions as F
    level = registered()["polygen_mixed"][0](spark, FOLDER).groupBy("sys").agg(F.sum("structures").alias("s"))
    found = registered()["polyenum_mixed"][0](spark, FOLDER)
    assert level.join(found, "sys").where("s <> n_strs").count() == 0 < found.count() == level.count()
