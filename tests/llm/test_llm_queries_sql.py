import os

import pytest
from compare import assert_same, views

from crossweave.llm import oracle, queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def tables():
    return views(FOLDER)


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_against_sql(spark, tables, name):
    assert_same(queries.queries()[name](spark, FOLDER), tables, oracle.oracle_sql()[name])
