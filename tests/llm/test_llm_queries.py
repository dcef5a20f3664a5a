"""Every training-data query runs on the smallest tables; those with SQL equal it."""

import pytest

from docloom.llm import queries as llm
from tests.parity import check


@pytest.mark.parametrize("name", sorted(llm.QUERIES))
def test_query(name, spark, sf, oracle):
    df = llm.QUERIES[name](spark, sf)
    if name in llm.ORACLE:
        check(df, oracle.execute(llm.ORACLE[name]))
    else:
        df.collect()
    assert len(set(df.columns)) == len(df.columns)
