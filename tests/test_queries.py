"""Every query of the engine against its SQL."""

import os

import pytest

from tessera import catalog

from .oracle import compare, connected

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connected(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    compare(catalog.queries()[name](spark, FOLDER), con, catalog.oracle_sql()[name])
