import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle import DATA, same  # noqa: E402

from strandlake.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_and_sql(spark, name):
    same(spark, QUERIES[name], ORACLE_SQL[name])
