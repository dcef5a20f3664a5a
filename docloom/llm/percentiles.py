"""Problem 4: percentiles of very large numeric columns, by mergeable q-digests.

Values are quantised to a bounded ordered universe of 2^UNIVERSE cells: the
leading bits of the IEEE double (order-preserving for positive numbers), so a
cell spans at most 2^-13 of its value. Cell 2^UNIVERSE + x is leaf x of a
dyadic tree with the root 1. A digest holds counts on tree nodes; compressing
from the leaves up moves a pair of siblings into its parent while parent and
pair together hold at most n / k values. Digests merge by adding the counts of
equal nodes, so those of separate partitions or days combine.

Guarantee: a rank is off by at most n * UNIVERSE / k, here EPS / 2 of n, for
any merge order, as every node above the leaves holds at most the sum of the
parts' n_i / k <= n / k values; a digest has at most 3k + 1 nodes, and so has a
merged one, as it is compressed again.

Each task digests its rows by group in numpy, so only digests are shuffled; a
group that holds a third of all rows costs no more than any other. Nodes are
added by a map-side combined aggregation and compressed by group, and ranks are
read off by a window over the bounded digest.

Defined results: null, NaN, infinite, zero and negative values are left out
(``n`` counts the rest); values beyond [2^-12, 2^39) fall into the end cells;
a group without valid values has no row; null keys form a group of their own;
redelivered keys count once when ``key_col`` is given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

EPS = 0.01
_EXP = 12  # lowest exponent 2^-12
_MANTISSA = 13
_OCTAVES = 51
UNIVERSE = 19  # log2 of _OCTAVES << _MANTISSA, rounded up
K = int(UNIVERSE / (EPS / 2))


def cells(v: np.ndarray) -> np.ndarray:
    """Positive finite doubles -> cells of the universe, in order."""
    bits = np.ascontiguousarray(v, np.float64).view(np.int64) >> (52 - _MANTISSA)
    return np.clip(bits - ((1023 - _EXP) << _MANTISSA), 0, (_OCTAVES << _MANTISSA) - 1)


def cell_value(x: np.ndarray) -> np.ndarray:
    """The middle of a cell."""
    bits = (np.asarray(x, np.int64) + ((1023 - _EXP) << _MANTISSA)) << (52 - _MANTISSA)
    return (bits + (1 << (51 - _MANTISSA))).view(np.float64)


def compress(nodes: np.ndarray, counts: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """A q-digest's compression, all pairs of a level at once, leaves first."""
    most = counts.sum() // k
    if most < 1:
        return nodes, counts
    for level in range(UNIVERSE, 0, -1):
        at = (nodes >> level) == 1
        if not at.any():
            continue
        parent, where = np.unique(nodes[at] >> 1, return_inverse=True)
        pair = np.bincount(where, weights=counts[at]).astype(np.int64)
        known = np.searchsorted(nodes, parent)
        has = (known < len(nodes)) & (nodes[np.minimum(known, len(nodes) - 1)] == parent)
        up = np.where(has, counts[np.minimum(known, len(nodes) - 1)], 0)
        move = pair + up <= most
        gone = np.zeros(len(nodes), bool)
        gone[np.flatnonzero(at)[move[where]]] = True
        gone[known[has & move]] = True
        nodes = np.concatenate((nodes[~gone], parent[move]))
        counts = np.concatenate((counts[~gone], (pair + up)[move]))
        order = np.argsort(nodes)
        nodes, counts = nodes[order], counts[order]
    return nodes, counts


def digests(df: DataFrame, keys: list[str], value_col: str, key_col: str | None = None, k: int = K) -> DataFrame:
    """(keys, node, n): the merged digest of each group, a row for each node."""
    v = F.col(value_col).cast("double")
    rows = df.where((v > 0) & (v < float("inf")) & ~F.isnan(v)).select(*([key_col] if key_col else []), *keys, v.alias("__v"))
    if key_col:
        rows = rows.dropDuplicates([key_col])
    rows = rows.select(*keys, "__v")
    out = T.StructType([*[rows.schema[c] for c in keys], T.StructField("node", T.IntegerType()), T.StructField("n", T.LongType())])
    arrow = to_arrow_schema(out)

    def fold(parts: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(parts).groupby([*keys, "node"], dropna=False, sort=False, as_index=False)["n"].sum()

    def run(batches):
        held: pd.DataFrame | None = None
        parts, size = [], 0
        for b in batches:
            p = b.to_pandas()
            p["node"] = cells(p.pop("__v").to_numpy()) + (1 << UNIVERSE)
            p["n"] = 1
            parts.append(p.groupby([*keys, "node"], dropna=False, sort=False, as_index=False)["n"].sum())
            size += len(parts[-1])
            if size > 500_000:
                held = shrink(fold([*([held] if held is not None else []), *parts]))
                parts, size = [], len(held) // 2
        if held is not None or parts:
            done = shrink(fold([*([held] if held is not None else []), *parts]))
            for i in range(0, len(done), 100_000):
                yield pa.RecordBatch.from_pandas(done.iloc[i : i + 100_000][[f.name for f in out]], schema=arrow, preserve_index=False)

    def shrink(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values([*keys, "node"], kind="stable").reset_index(drop=True)
        code = p.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
        edge = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1], [True]))) if len(p) else np.zeros(1, int)
        keep = []
        for a, b in zip(edge[:-1], edge[1:]):
            nodes, counts = compress(p["node"].to_numpy()[a:b], p["n"].to_numpy()[a:b], k)
            q = p.iloc[np.full(len(nodes), a)][keys].reset_index(drop=True)
            q["node"], q["n"] = nodes, counts
            keep.append(q)
        return pd.concat(keep, ignore_index=True) if keep else p

    return merge(rows.mapInArrow(run, out), keys, k)


def merge(parts: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """Digests of tasks, finer groups or several days -> digests of ``keys``: equal
    nodes are added (combined in the tasks first), then each digest is compressed
    again, so it has at most 3k + 1 nodes however many were merged. A group has at
    most 2^(UNIVERSE + 1) different nodes, which bounds what one task compresses."""
    added = parts.groupBy(*keys, "node").agg(F.sum("n").alias("n"))
    out = T.StructType([*[added.schema[c] for c in keys], T.StructField("node", T.IntegerType()), T.StructField("n", T.LongType())])
    arrow = to_arrow_schema(out)

    def shrink(p: pd.DataFrame) -> Iterator[pa.RecordBatch]:
        code = p.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
        edge = np.flatnonzero(np.diff(code, prepend=-1, append=-2))
        big = np.add.reduceat(p["n"].to_numpy(), edge[:-1]) >= k  # smaller groups have nothing to compress
        keep, rest = [], np.ones(len(p), bool)
        for a, b in zip(edge[:-1][big], edge[1:][big]):
            nodes, counts = compress(p["node"].to_numpy()[a:b].astype(np.int64), p["n"].to_numpy()[a:b], k)
            q = p.iloc[np.full(len(nodes), a)].copy()
            q["node"], q["n"] = nodes, counts
            keep.append(q)
            rest[a:b] = False
        for q in [p[rest], *keep]:
            if len(q):
                yield pa.RecordBatch.from_pandas(q[[f.name for f in out]], schema=arrow, preserve_index=False)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []  # a group may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            p = b.to_pandas()
            code = p.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            last = int(np.flatnonzero(np.diff(code, prepend=-1))[-1])
            if last:
                yield from shrink(pd.concat([*held, p.iloc[:last]]) if held else p.iloc[:last])
                held = [p.iloc[last:]]
            elif held and not _same(held[0].iloc[0], p.iloc[0], keys):
                yield from shrink(pd.concat(held))
                held = [p]
            else:
                held.append(p)
        if held:
            yield from shrink(pd.concat(held))

    return added.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(again, out)


def _same(x: pd.Series, y: pd.Series, keys: list[str]) -> bool:
    return all(x[c] == y[c] or pd.isna(x[c]) and pd.isna(y[c]) for c in keys)


def quantiles(digest: DataFrame, keys: list[str], qs: dict[str, float]) -> DataFrame:
    """(keys, n, one column for each named quantile).

    Nodes are read in order of their largest cell, smaller ranges first; the
    value of a quantile is that of the first node that brings the count to it.
    """
    depth = F.floor(F.log2(F.col("node").cast("double"))).cast("int")
    span = F.lit(UNIVERSE) - depth
    top = F.expr(f"shiftleft(cast(node as bigint) + 1, {UNIVERSE} - cast(floor(log2(cast(node as double))) as int)) - 1 - {1 << UNIVERSE}")
    x = digest.select(*keys, "n", top.alias("top"), span.alias("span"))
    w = Window.partitionBy(*keys).orderBy("top", "span")
    x = x.select(*keys, "n", "top", F.sum("n").over(w).alias("c"), F.sum("n").over(Window.partitionBy(*keys)).alias("all"))
    # the middle of the cell, back from the bits by exponent and mantissa
    exponent = F.floor(F.col("top") / (1 << _MANTISSA)) - _EXP
    middle = F.pow(F.lit(2.0), exponent) * (1 + ((F.col("top") % (1 << _MANTISSA)) + 0.5) / (1 << _MANTISSA))
    x = x.withColumn("v", middle)
    picks = [F.min(F.when(F.col("c") >= F.ceil(F.lit(float(q)) * F.col("all")), F.col("v"))).alias(name) for name, q in qs.items()]
    return x.groupBy(*keys).agg(F.max("all").alias("n"), *picks)


def run_digests(runs: DataFrame) -> DataFrame:
    """Digests of processing_time by provider, model and day; a run counts once."""
    norm = lambda c: F.lower(F.trim(F.col(c)))
    src = runs.select("run_id", norm("provider").alias("provider"), norm("model").alias("model"), F.date_format("started_at", "yyyy-MM-dd").alias("run_day"), "processing_time")
    return digests(src, ["provider", "model", "run_day"], "processing_time", "run_id")


def slow_days(daily: DataFrame, factor: float = 3.0) -> DataFrame:
    """Days whose 95th percentile is over ``factor`` times the model's median of all days."""
    p95 = quantiles(daily, ["provider", "model", "run_day"], {"p95": 0.95})
    p50 = quantiles(merge(daily, ["provider", "model"]), ["provider", "model"], {"p50": 0.5})
    a, b = p95.alias("a"), p50.alias("b")
    same = F.col("a.provider").eqNullSafe(F.col("b.provider")) & F.col("a.model").eqNullSafe(F.col("b.model"))
    return a.join(b, same).where(F.col("p95") > factor * F.col("p50")).select("a.provider", "a.model", "run_day")
