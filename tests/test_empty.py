"""All core queries over tables without rows."""

import os

import pytest

from docloom.plans import queries as core

FIXED = {"supported_types", "provider_list", "schema_leaves", "runs_cube", "runs_rollup"}


@pytest.fixture(scope="module")
def empty(spark, sf, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for f in os.listdir(sf):
        spark.read.parquet(f"{sf}/{f}").limit(0).write.parquet(f"{d}/{f}")
    return str(d)


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - FIXED))
def test_empty(name, spark, empty):
    assert core.QUERIES[name](spark, empty).count() == 0
