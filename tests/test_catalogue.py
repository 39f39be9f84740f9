"""Every query against its oracle on the smallest tables."""

import os

import pytest

from oracle import compare, connect
from catalogue import ORACLES, QUERIES

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, note = compare(spark, con, FOLDER, name)
    assert ok, note


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
