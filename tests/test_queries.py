"""Every core query runs; those with SQL equal it."""

import pytest

from docloom.plans import queries as core
from tests.parity import check


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(name, spark, sf, oracle):
    df = core.QUERIES[name](spark, sf)
    if name in core.ORACLE:
        check(df, oracle.execute(core.ORACLE[name]))
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
