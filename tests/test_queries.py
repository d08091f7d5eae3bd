"""Every query against its DuckDB counterpart on the smallest tables; a sample of shapes, all names."""

from __future__ import annotations

import pytest

import oracle
from quarry.plans import registry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(DIR)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_duckdb(spark, con, name):
    assert oracle.compare(spark, con, DIR, registry.QUERIES[name], registry.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DIR).count() > 0
