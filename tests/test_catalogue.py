import pytest

from keelstone.plans import catalogue
from tests.oracle import same

SF = "/root/testdata/sf0.001"
EMPTY = {"range_empty", "range_reversed"}


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, name):
    n = same(catalogue.QUERIES[name](spark, SF), catalogue.ORACLES[name], SF)
    assert (n == 0) == (name in EMPTY)
