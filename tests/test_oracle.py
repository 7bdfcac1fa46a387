"""Every registered query against its SQL at the smallest scale."""

import pytest

from pagewell.catalog import ENTRIES
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(ENTRIES))
def test_query(spark, con, name):
    assert compare(spark, con, name, ENTRIES[name], FOLDER) is None


def test_every_query_has_sql():
    assert [n for n, e in ENTRIES.items() if e.sql is None] == []
