"""Every query against its SQL, on the smallest tables."""

import os

import pytest

from parity.check import connect, difference
from parity.oracles import ORACLES
from parity.queries import QUERIES

SF = os.environ.get("PARITY_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.fixture(scope="module")
def sql():
    return connect(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, sql, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert difference(got, sql.execute(ORACLES[name]).df()) == ""
