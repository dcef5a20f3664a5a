"""Compares a query's rows with its SQL twin's, columns by name, order ignored."""

import math


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def check(df, cursor):
    names = [x[0] for x in cursor.description]
    order = sorted(df.columns)
    assert sorted(names) == order
    got = sorted((tuple(norm(r[k]) for k in order) for r in df.collect()), key=repr)
    want = sorted((tuple(norm(r[names.index(k)]) for k in order) for r in cursor.fetchall()), key=repr)
    assert got == want
