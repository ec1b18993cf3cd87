"""The subpackage's registered queries at the smallest scale."""

import os

import pytest
from compare import FOLDER, oracle, same

from lotwerk.llm import queries as Q

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.mark.parametrize("name", Q.QUERIES)
def test_query(spark, name):
    if name in Q.SQL:
        same(spark, oracle(), Q.QUERIES[name], Q.SQL[name])
    else:
        assert Q.QUERIES[name](spark, FOLDER).count() > 0
