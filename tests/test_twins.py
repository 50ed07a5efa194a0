import os

import pytest
from redactica.plans import registry as queries
from twins import SF_DIR, assert_equal, connection

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no shared tables")


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_twin(spark, con, name):
    assert_equal(spark, con, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_a_twin_runs(spark, name):
    assert queries.QUERIES[name](spark, SF_DIR).count() > 0
