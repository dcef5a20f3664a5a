import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import percentiles as P


@pytest.mark.parametrize("name", ["lognormal", "ties", "bimodal", "sorted"])
def test_rank_error_of_merges(name):
    rng = np.random.default_rng(3)
    n = 200_000
    v = {"lognormal": rng.lognormal(8, 2, n), "ties": rng.integers(1, 6, n).astype(float), "bimodal": np.concatenate([rng.normal(10, 1, n // 2).clip(1), rng.normal(1e5, 10, n // 2)]), "sorted": np.arange(1.0, n + 1)}[name]
    k = 600  # a coarse digest, so that it must compress
    nodes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for part in np.array_split(v, 13):
        x, c = np.unique(P.cells(part) + (1 << P.UNIVERSE), return_counts=True)
        x, c = P.compress(x, c, k)
        assert c.sum() == len(part) and len(x) <= 3 * k + 1
        both = np.concatenate([nodes, x])
        u, w = np.unique(both, return_inverse=True)
        nodes, counts = u, np.bincount(w, weights=np.concatenate([counts, c])).astype(np.int64)
    level = np.floor(np.log2(nodes)).astype(int)
    span = P.UNIVERSE - level
    top = ((nodes + 1) << span) - 1 - (1 << P.UNIVERSE)
    order = np.lexsort((span, top))
    cum = np.cumsum(counts[order])
    cells = np.sort(P.cells(v))
    for q in (0.01, 0.25, 0.5, 0.75, 0.95, 0.99):
        cell = top[order][np.searchsorted(cum, np.ceil(q * n))]
        lo, hi = np.searchsorted(cells, [cell, cell + 1])
        assert max(0, lo / n - q, q - hi / n) <= P.UNIVERSE / k


def test_cells_keep_order():
    v = np.sort(np.random.default_rng(1).lognormal(5, 8, 10_000))
    c = P.cells(v)
    assert (np.diff(c) >= 0).all() and c.min() >= 0 and c.max() < 1 << P.UNIVERSE
    inside = (v > 2.0**-12) & (v < 2.0**38)
    assert (abs(P.cell_value(c[inside]) / v[inside] - 1) < 2.0**-13).all()


def test_columns(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(i, "a", float(i)) for i in range(1, 101)] + [(1, "a", 1.0), (200, "b", nan), (201, "b", inf), (202, "b", -1.0), (203, "b", 0.0), (204, "b", None), (205, None, 7.0)]
    df = spark.createDataFrame(rows, "id long, g string, v double").selectExpr("*", "1 AS node", "2 AS n")
    d = P.digests(df.select("id", "g", "v"), ["g"], "v", "id")
    got = {r.g: r for r in P.quantiles(d, ["g"], {"p50": 0.5, "p99": 0.99}).collect()}
    assert set(got) == {"a", None} and got["a"].n == 100
    assert abs(got["a"].p50 / 50 - 1) < 1e-3 and abs(got["a"].p99 / 99 - 1) < 1e-3 and abs(got[None].p50 / 7 - 1) < 1e-3
    assert P.quantiles(P.digests(df.limit(0).select("id", "g", "v"), ["g"], "v"), ["g"], {"p50": 0.5}).count() == 0


def test_merged_digests_stay_small(spark):
    n, k = 1_000_000, 300
    df = spark.range(0, n, 1, 16).selectExpr("id % 2 AS g", "id % 7 AS day", "exp(rand(5) * 12) AS v")
    daily = P.digests(df, ["g", "day"], "v", k=k)
    whole = P.merge(daily, ["g"], k)
    size = {r.g: (r.c, r.n) for r in whole.groupBy("g").agg(F.count("*").alias("c"), F.sum("n").alias("n")).collect()}
    assert set(size) == {0, 1} and all(c <= 3 * k + 1 and m == n // 2 for c, m in size.values())
    assert daily.groupBy("g", "day").count().agg({"count": "max"}).first()[0] <= 3 * k + 1
    qs = {"q5": 0.05, "q50": 0.5, "q95": 0.95}
    truth = {r.g: r for r in df.groupBy("g").agg(*[F.expr(f"percentile(v, {q})").alias(c) for c, q in qs.items()]).collect()}
    got = {r.g: r for r in P.quantiles(whole, ["g"], qs).collect()}
    for g in (0, 1):  # ln v is uniform: a rank error of e shifts it by 12 e
        assert all(abs(np.log(got[g][q] / truth[g][q])) <= 12 * (P.UNIVERSE / k + 0.002) for q in qs)
