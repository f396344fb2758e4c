import os

import pytest
from oracle import DATA, same

from strandlake.plans.registry import ORACLE_SQL, QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_and_sql(spark, name):
    same(spark, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
