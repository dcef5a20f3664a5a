import copy
import random

import numpy as np

from docloom.llm import subjects as S
from docloom.llm.wikitext import running_lines, visible

random.seed(4)
NOUNS = {"law": [f"law{i}" for i in range(12)], "sport": [f"spo{i}" for i in range(12)], "music": [f"mus{i}" for i in range(12)]}
NAMES = sorted(NOUNS)


def sentence(subject):
    a, b = random.sample(NOUNS[subject], 2) if subject else ("thing", "matter")
    return f"The {a} of Name{random.randrange(50)} was seen by a {random.choice(['old', 'new'])} {b} in {random.randrange(1800, 2000)}."


def page(*subjects):
    return "'''T''' – " + " ".join(sentence(s) for s in subjects for _ in range(6))


def test_sentences():
    t = "{{Infobox|a=b}}\n'''X''' – First one ends here in 1950. Second [[a (b)|goes]] on\nover a line.<ref>{{c}}</ref> Third is short.\n== Head ==\n* item, one two\n{| class=x\n| a || b\n|}\nhi mum\n__NOTOC__"
    assert S.sentences(t) == ["X – First one ends here in 1950.", "Second goes on over a line.", "item, one two"]
    for none in (None, "", "#REDIRECT [[a b c d e f]]", "goal goal GOAL!!! hi mum", "your server is a volcano lol who needs a judge and so on and on and on ever"):
        assert S.sentences(none) == []
    assert visible("a<!--b-->c ''d'' &amp; [[Category:x]] [https://q.invalid e]") == "ac d &  e" and running_lines("") == []


def labelled(n):
    y = [random.sample(NAMES, random.choice([1, 1, 2])) for _ in range(n)]
    m = np.zeros((n, 3))
    for i, s in enumerate(y):
        m[i, [NAMES.index(x) for x in s]] = 1
    return [page(*s) for s in y], y, m


def test_held_out_accuracy():
    texts, _, y = labelled(300)
    wrong = y.copy()
    for i in range(0, 300, 40):
        wrong[i] = np.roll(wrong[i], 1)
    spare = [page(*random.choice([[None], [None, None], ["law"]])) for _ in range(200)]
    m = S.fit(texts, ["src"] * 300, wrong, NAMES, unlabelled=(spare, [None] * 200))
    test, want, _ = labelled(200)
    test += [page(None), page(None, None), "", None, page("law", None, None, None, None, None, None, None, None, None)]
    got, p, _ = S.predict(m, test, [None] * len(test))
    names = [sorted(NAMES[k] for k in np.flatnonzero(r)) for r in got]
    assert np.mean([a == sorted(b) for a, b in zip(names, want)]) >= 0.98
    assert names[200:] == [[]] * 5 and ((0 < p) & (p <= 1)).all()


def planted(shares, n=25):
    """A page of n sentences, so many of each subject; ``a+b`` puts one term of each into a sentence."""
    out = []
    for name, share in shares.items():
        a, _, b = name.partition("+")
        for _ in range(round(share * n)):
            x, y = random.choice(NOUNS[a]), random.choice(NOUNS[b or a])
            out.append(f"The {x} of Name{random.randrange(50)} was seen by a new {y} in {random.randrange(1800, 2000)}.")
    out += [sentence(None) for _ in range(n - len(out))]
    random.shuffle(out)
    return "'''T''' – " + " ".join(out)


def without_chain(m):
    z = copy.deepcopy(m)
    for w in z.weights:
        w[S.chain_columns(len(m.subjects))] = 0
    return z


def test_chain_and_beam_decide():
    # law and sport mostly come together, each with little text of its own; law often has stray terms of music in its sentences
    random.seed(2)
    texts, y, u = [], [], random.uniform
    for i in range(800):
        kind = i % 8
        if kind < 3:
            texts.append(planted({"law": u(0.12, 0.4), "sport": u(0.12, 0.4)}))
            y.append([1, 0, 1])
        elif kind == 3:
            texts.append(planted({"law": u(0.35, 0.6), "law+music": u(0.2, 0.35)}))
            y.append([1, 0, 0])
        else:
            one = ("law", "sport", "music", "music")[kind - 4]
            texts.append(planted({one: u(0.3, 0.9)} | {s: u(0, 0.1) for s in NAMES if s != one}))
            y.append([s == one for s in NAMES])
    spare = [planted({random.choice(NAMES): u(0, 0.1)}) for _ in range(100)]
    m = S.fit(texts, ["s"] * 800, np.array(y, float), NAMES, unlabelled=(spare, [None] * 100))
    two = [planted({"law": u(0.05, 0.3), "sport": u(0.05, 0.3)}) for _ in range(300)]
    stray = [planted({"law": 0.5, "law+music": u(0.3, 0.45)}) for _ in range(100)]
    none = [planted({"law": u(0, 0.05)}) for _ in range(50)]
    src = ["s"] * 300
    full, zero = S.predict(m, two, src)[0], S.predict(without_chain(m), two, src)[0]
    assert (full[:, 0] & full[:, 2]).sum() >= (zero[:, 0] & zero[:, 2]).sum()  # seen together, expected together
    got, bare = S.predict(m, stray, src[:100])[0], S.predict(without_chain(m), stray, src[:100])[0]
    assert got[:, 0].all() and got[:, 1].sum() <= 5  # law explains the stray terms of music
    assert bare[:, 1].sum() >= 50  # which are taken for music without the chain
    assert not S.predict(m, none, src[:50])[0].any()


def test_beam_takes_back_a_decision():
    # law alone is a little unlikely, law with sport likely: the best combination starts with the worse first step
    k, rest = 2, [0.0] * (2 + S.SOURCES)
    law = np.array([0, 0, 0, 0, 0, 0, *rest, -0.2])
    sport = np.array([0, 0, 0, 0, 4.6, 0, *rest, 0.0])
    m = S.Model(["law", "sport"], np.zeros(0, np.uint64), np.zeros(0, np.int64), [0, 1], [law, sport], [(1.0, 0.0)] * k, np.zeros(2), np.ones(2))
    assert S.predict(m, [page(None)], [None])[0].tolist() == [[True, True]]
    assert S.predict(m, [page(None)], [None], beam=1)[0][0, 0] == False  # noqa: E712
    m.weights[1][S.chain_columns(k)] = 0
    assert S.predict(m, [page(None)], [None])[0][0, 0] == False  # noqa: E712


def test_wrong_labels_are_doubted_not_dropped():
    y, p = np.array([1.0, 1.0, 0.0, 0.0]), np.array([0.99, 0.001, 0.999, 0.01])
    q = S._true_label(y, p)
    assert q[0] > 0.99 and q[1] < 0.1 and q[2] > 0.9 and q[3] < 0.01


def test_sample_bounds(spark):
    docs = spark.range(50).selectExpr("id AS doc_id", "repeat('x', 10) AS text", "'s' AS source")
    assert S._bounded(docs, 20, 1000).count() == 20 and S._bounded(docs, 20, 55).count() == 5 and S._bounded(docs, 20, 3).count() == 1


def test_columns(spark):
    texts, y, _ = labelled(120)
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(500, None, None), (501, "", " ")], "doc_id long, text string, source string").selectExpr("*", "'x' AS subject")
    labels = spark.createDataFrame([(i, s.upper() + " ") for i, ss in enumerate(y[:100]) for s in ss] + [(0, "unknown"), (None, "law"), (7, None), (9999, "law")], "doc_id long, subject string")
    areas = spark.createDataFrame([(s, None) for s in NAMES], "subject string, description string")
    c = S.classify(docs, S.train(docs, labels, areas)).cache()
    got = {}
    for r in S.subject_rows(c).collect():
        got.setdefault(r.doc_id, []).append(r.subject)
    assert sum(sorted(got.get(i, [])) == sorted(s) for i, s in enumerate(y)) >= 115 and 500 not in got and 501 not in got
    total = S.composition(c).agg({"text_share": "sum"}).first()[0]
    assert abs(total - 1) < 1e-4
    assert S.subject_rows(S.classify(docs, S.train(docs, labels.limit(0), areas))).count() == 0
    assert S.classify(docs.limit(0), S.train(docs, labels, areas)).count() == 0
