import os
import subprocess
import sys
from pathlib import Path

import pytest
from compare import assert_same, views

import __spark_entry__
from crossweave.plans import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
NAMES = sorted(registry.oracle_sql())


@pytest.fixture(scope="module")
def tables():
    return views(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, tables, name):
    assert_same(registry.queries()[name](spark, FOLDER), tables, registry.oracle_sql()[name])


def test_entry(spark, tables):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["uid", "iid"] and df.count() == len(tables.execute(registry.oracle_sql()[registry.FLAGSHIP]).fetchall()) > 0
    names = set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= names and set(registry.queries()) <= names


def test_the_rest_needs_no_llm():
    code = "import sys; sys.modules['crossweave.llm'] = None; import __spark_entry__ as e; assert 'p2_found' in e.queries() and 'p1_found' not in e.queries() and 'p1_found' not in e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)
