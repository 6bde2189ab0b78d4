"""Every registered query against its DuckDB equivalent on the smallest data set."""

import pytest

from firmament.registry import load
from tests.compare import compare, duck

QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, con, sf, key):
    ok, n, _, _, note = compare(spark, con, key, QUERIES[key], ORACLES.get(key), sf)
    assert ok, note
    assert n >= 0
