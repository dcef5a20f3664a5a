import random

import pytest

from docloom.llm.leakage import Index, leaked_items, words

random.seed(9)
V = [f"t{i}" for i in range(300)]
ITEMS = [(i, " ".join(random.choices(V[:200], k=40)), "what is t1", "t2") for i in range(40)] + [(99, None, None, None), (98, "too short", "q", "a")]
ITEMS.append((100, ITEMS[0][1], "other", "x"))


def test_equals_brute_force():
    texts = []
    for n in (11, 12, 20):
        for k in range(15):
            p = ITEMS[k][1].split()
            at = random.randrange(len(p) - n)
            run = [w.upper() if random.random() < 0.3 else w for w in p[at : at + n]]
            run[3] = f"[[Page (x)|{run[3]}]]"
            run[5] = f"'''{run[5]}''',<ref>{{{{cite|a={{{{b}}}}}}}}</ref>\n"
            texts.append(" ".join(random.choices(V, k=30) + ["oov"] + run + ["oov"]))
    texts += ["", None, " ".join(random.choices(V[:200], k=5000))]
    x = Index(ITEMS)
    got = {(a, b) for a, b, *_ in x.leaks(texts)}
    want = set()
    for i, t in enumerate(texts):
        w = words(t)
        grams = {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
        for item, p, _, _ in ITEMS:
            q = words(p)
            if any(tuple(q[k : k + 12]) in grams for k in range(len(q) - 11)):
                want.add((i, item))
    assert got == want and any(b == 100 for _, b in got) and len(got) >= 30


def test_columns(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, passage string, question string, answer string")
    df = spark.createDataFrame([(1, ITEMS[3][1] + " t1"), (2, None), (3, "")], "doc_id long, text string").selectExpr("*", "5 AS item_id")
    got = leaked_items(df, items).collect()
    assert [(r.doc_id, r.item_id, r.passage_share) for r in got] == [(1, 3, 1.0)]
    assert leaked_items(df.limit(0), items).count() == 0 and leaked_items(df, items.limit(0)).count() == 0
    with pytest.raises(ValueError):
        leaked_items(df, items, max_items=3)
