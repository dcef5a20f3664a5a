import random

import pytest

from docloom.llm import mixing as M


def test_budgets():
    leaves = [(("a", "en", "0"), 100.0), (("a", "fr", "0"), 100.0), (("b", "en", "0"), 10.0), (("x", "en", "0"), 790.0)]
    got = M.plan(leaves, {"a": (0.5, 3), "b": (0.4, 2), "c": (0.1, 9)}, 1000.0)
    by = {s: sum(v for p, (v, _) in got.items() if p[0] == s) for s in "ab"}
    assert by == {"a": 600.0, "b": 20.0}  # both are full; c has nothing
    one = M.plan([(("a", "en", "0"), 10.0), (("a", "fr", "0"), 90.0), (("b", "en", "0"), 900.0)], {"a": (0.1, 1), "b": (0.9, 1)}, 1000.0)
    assert round(one[("a", "en", "0")][0], 6) == 10 and round(one[("b", "en", "0")][0], 6) == 900


def test_share_out_prefers_siblings():
    kids = [M.Node(size=1, weight=1, room=2), M.Node(size=1, weight=1, room=100)]
    assert M.share_out(20, kids) == 0 and [k.budget for k in kids] == [2, 18]
    assert M.share_out(200, kids) == pytest.approx(98)


def test_mixture(spark):
    docs = [(i, f"word{i} " * (1 + i % 7), ["A ", "a", "b", None][i % 4], "en" if i % 3 else None, i % 2) for i in range(400)] + [(1000, None, "a", "en", 0), (1001, "", "b", "en", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, namespace_no int").selectExpr("*", "9 AS n_tokens")
    t = spark.createDataFrame([("A", 0.3, 2), ("b ", 0.6, 1), ("none", 0.1, None)], "source string, weight double, max_repeats int")
    mix, shares, plan = M.mixture(df, t)
    rows = mix.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and {r.source for r in rows} <= {"a", "b"}
    cap = {"a": 2, "b": 1}
    assert all(r.n_repeats <= cap[r.source] for r in rows)
    s = {r.source: r for r in shares.collect()}
    assert s["none"].tokens == 0 and not s["none"].reachable and abs(sum(r.actual_share for r in s.values()) - 1) < 1e-5
    p = {r.source: r for r in plan.collect()}
    for k in "ab":
        assert p[k].budget - 8 * 40 <= s[k].tokens <= p[k].budget + 1e-6
    again = {(r.doc_id, r.n_repeats) for r in M.mixture(df.repartition(5), t)[0].collect()}
    assert again == {(r.doc_id, r.n_repeats) for r in rows}
    assert {r.source for r in M.short_sources(df, t).collect()} == {"b", "none"}
    assert M.mixture(df.limit(0), t)[0].count() == 0


def test_short_sources_come_from_the_tree(monkeypatch):
    leaves = [(("a", "en", "0"), 100.0), (("a", "fr", "0"), 100.0), (("b", "en", "0"), 10.0), (("x", "en", "0"), 790.0)]
    goal = {"a": (0.5, 3), "b": (0.4, 2), "c": (0.1, 9), "d": (0.0, 1)}
    assert {r[0]: r[5] for r in M.report(leaves, goal)} == {"a": True, "b": False, "c": False, "d": True}
    assert {r[0]: r[4] for r in M.report(leaves, goal)} == pytest.approx({"a": 600, "b": 20, "c": 0, "d": 0})
    monkeypatch.setattr(M, "plan", lambda *a: {})
    assert {r[0]: r[5] for r in M.report(leaves, goal)} == {"a": False, "b": False, "c": False, "d": True}


@pytest.mark.parametrize("seed", range(20))
def test_reachable_is_the_inequality(seed):
    rnd = random.Random(seed)
    leaves = [((s, la, n), float(rnd.randrange(0, 500))) for s in "abcdex" for la in ("en", "fr", None) for n in "01"]
    goal = {s: (rnd.choice([0.02, 0.1, 0.2, 0.3]), rnd.randrange(1, 4)) for s in "abcdez"}
    every = sum(w for w, _ in goal.values())
    goal = {s: (w / every, r) for s, (w, r) in goal.items()}
    total = sum(x for _, x in leaves)
    size = {s: sum(x for p, x in leaves if p[0] == s) for s in goal}
    assert {r[0]: r[5] for r in M.report(leaves, goal)} == {s: r * size[s] >= w * total for s, (w, r) in goal.items()}
