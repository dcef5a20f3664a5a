"""All training-data queries over tables without rows."""

import os

import pytest

from docloom.llm import queries as llm


@pytest.fixture(scope="module")
def empty(spark, sf, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for f in os.listdir(sf):
        spark.read.parquet(f"{sf}/{f}").limit(0).write.parquet(f"{d}/{f}")
    return str(d)


@pytest.mark.parametrize("name", sorted(llm.QUERIES))
def test_empty(name, spark, empty):
    assert llm.QUERIES[name](spark, empty).count() == 0
