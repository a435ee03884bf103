import __spark_entry__
from keelstone.plans import catalogue


def test_every_sql_has_its_query(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert sql.keys() <= queries.keys() and catalogue.QUERIES.keys() <= queries.keys()
    assert catalogue.ORACLES.keys() == catalogue.QUERIES.keys()
    assert __spark_entry__.entry(spark).count() > 0
