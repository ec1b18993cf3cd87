"""Every registered core query with SQL, at the smallest scale."""

import os
from importlib import import_module

import pytest
from compare import FOLDER, oracle, same

import __spark_entry__ as entry

MODULES = [import_module(m) for m in entry.MODULES]
NAMES = [(m, n) for m in MODULES for n in m.QUERIES]
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return oracle()


@pytest.mark.parametrize("module,name", NAMES, ids=[n for _, n in NAMES])
def test_query(spark, con, module, name):
    if name in module.SQL:
        same(spark, con, module.QUERIES[name], module.SQL[name])
    else:
        assert module.QUERIES[name](spark, FOLDER).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
