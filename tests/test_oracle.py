"""Every registered query against its SQL on the smallest driver tables."""

import pytest

from catalog import CATALOG
from tools import compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", list(CATALOG))
def test_query(spark, con, name):
    good, note, _ = compare.compare(spark, con, SF, name)
    assert good, note


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
