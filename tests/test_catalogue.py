import pytest

from quillframe.catalogue import ORACLE_SQL, QUERIES
from tests.oracle import connection, differences

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    assert not differences(spark, SF, QUERIES[name], ORACLE_SQL[name], con)
