"""Arrow-batch mapping: Python sees whole column batches, never single rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def map_columns(df: DataFrame, fn: Callable[..., dict[str, list]], schema: str | T.StructType, setup: Callable[[], tuple] | None = None) -> DataFrame:
    """``fn(*columns[, *setup()]) -> {name: values}`` over each Arrow batch.

    Columns arrive as Python lists; the result may have any number of rows.
    ``setup`` runs once a task (model files, compiled tables).
    """
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extra = setup() if setup else ()
        for b in batches:
            if b.num_rows:
                got = fn(*[c.to_pylist() for c in b.columns], *extra)
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, out)
