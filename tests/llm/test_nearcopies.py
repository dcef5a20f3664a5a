import random

from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import nearcopies as N
from docloom.llm.nearcopies import near_groups, near_pairs

random.seed(5)
WORDS = [f"w{i}" for i in range(400)]


def edited(words, k):
    w = list(words)
    for _ in range(k):
        w[random.randrange(len(w))] = random.choice(WORDS) + "x"
    return w


def brute(docs):
    sets = {}
    for i, t in docs:
        w = t.lower().split() if t else []
        s = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
        if s:
            sets[i] = s
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}


def corpus():
    docs = []
    for g in range(30):
        base = [random.choice(WORDS) for _ in range(random.choice([4, 8, 30, 120]))]
        docs += [" ".join(base)] + [" ".join(edited(base, k)) for k in (1, 2, 5)] + [" ".join(base[: max(3, len(base) * 3 // 4)]), " ".join(base) + " tail end"]
    docs += [None, "", "one two", "three short words", "three short words", "three short words more"]
    return [(i, t) for i, t in enumerate(docs)]


def test_pairs_and_groups(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t, "c") for i, t in docs] + [(0, docs[0][1], "c")], "conv_id long, markdown string, cls string")
    got = [tuple(r) for r in near_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs)
    groups = {r.conv_id: r for r in near_groups(df).collect()}
    parent = {i: i for i in groups}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in got:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert all((groups[a].group_id == groups[b].group_id) == (find(a) == find(b)) for a in groups for b in groups)


def test_empty(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "conv_id long, markdown string")
    assert near_pairs(df).count() == 0 and near_groups(df).count() == 0
    assert near_pairs(df.limit(0)).count() == 0


def test_copies_of_one_text(spark):
    df = spark.createDataFrame([(i, "the same five words here") for i in range(60)], "conv_id long, markdown string")
    assert near_pairs(df).count() == 60 * 59 // 2


def test_variants():
    fps = [np.arange(10, 10 + n) for n in range(7)]
    t, v, role = N.variants(fps, [0] * 7, [0] * 7, [])
    for n in range(7):
        pairs = v[(t == n) & (role == 0)]
        assert len(set(pairs)) == len(pairs) == (len(list(combinations(range(n), 2))) if n <= 4 else 2 * n - 3)
        assert (role[t == n] == n).sum() == (n if n in (1, 2) else 0) or n == 0
    full = np.ones(N.FLAGS, bool)
    t, v, role = N.variants([np.arange(10)], [0], [0], [full])
    # every pair is extended by one of the next three but those at the end
    assert len(v) == len(set(v)) == sum(min(3, 9 - j) or 1 for i in range(10) for j in (i + 1, i + 2) if j < 10)
    assert len(N.variants([np.arange(10)], [0b1111111111], [0], [])[0]) == 0  # frequent hashes alone, in a text of few
    assert (N.variants([np.arange(10)], [0b1111111111], [1], [])[2] == 2).all()


def collisions(spark, docs):
    """Largest group of a variant and all pairs that collide."""
    df = spark.createDataFrame(docs, "conv_id long, markdown string")
    hot, _ = N.frequent_slots(df)
    reps = N.fingerprints(df, hot, "conv_id", "markdown").withColumnRenamed("conv_id", "rep")
    wide = []
    while len(wide) < N.LEVELS - N.CORE and (f := N.wide_flags(N.variant_rows(reps, wide, open_only=True), N.WIDE)):
        wide.append(f)
    count = lambda k, c: N.variant_rows(reps, wide, only=k).groupBy("v").agg(F.count("*").alias(c))
    groups = [count(0, "a").withColumn("b", F.col("a")), count(1, "a").join(count(2, "b"), "v")]
    most, pairs = zip(*[g.agg(F.coalesce(F.max(F.least("a", "b")), F.lit(0)), F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0))).first() for g in groups])
    return max(most), sum(pairs)


def test_short_texts_with_a_stock_phrase_do_not_collide(spark):
    r = random.Random(3)
    stock = words(r, 17)
    docs = [(i, " ".join(stock + words(r, 22))) for i in range(4000)]
    small, large = collisions(spark, docs[:2000]), collisions(spark, docs)
    assert large[0] <= 2 and large[1] <= 2.2 * small[1]
    tiny = [(i, " ".join([*stock[:3], f"u{i}"])) for i in range(3000)] + [(9000, " ".join(stock[:3]))]
    assert collisions(spark, tiny)[1] <= 3000 * 6  # (a, b) meets (a) but not (a, c)
    got = near_pairs(spark.createDataFrame(tiny, "conv_id long, markdown string")).collect()
    assert {tuple(x) for x in got} == {(i, 9000) for i in range(3000)}


def test_wide_variants_keep_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(N, "WIDE", 3)
    r = random.Random(8)
    stock = [words(r, 40) for _ in range(4)]
    docs = []
    for g in range(120):  # two stock passages of four and own text: variants of the stock are wide
        own = words(r, 90)
        base = [*stock[g % 4], *own, *stock[(g + 1) % 4]]
        docs += [base, edited(base, 6)]
    docs = [(i, " ".join(t)) for i, t in enumerate(docs)]
    got = {tuple(p) for p in near_pairs(spark.createDataFrame(docs, "conv_id long, markdown string")).collect()}
    assert got == brute(docs) and len(got) == 120


def test_texts_of_stock_phrases_alone(spark):
    r = random.Random(9)
    stock = [words(r, 12) for _ in range(5)]
    docs = [(i, " ".join(stock[0] + stock[1] + stock[2] + words(r, 3))) for i in range(80)]  # a form letter
    docs += [(100 + i, " ".join(stock[0] + words(r, 9))) for i in range(80)]  # half of it stock
    docs.append((999, " ".join(stock[0])))
    got = {tuple(p) for p in near_pairs(spark.createDataFrame(docs, "conv_id long, markdown string")).collect()}
    assert got == brute(docs) and len(got) >= 80 * 79 // 2


def words(r, n):
    return [f"v{r.randrange(10**6)}" for _ in range(n)]


def test_recall_of_cut_copies(spark):
    r = random.Random(11)
    stock = [words(r, 28) for _ in range(12)]
    texts = []
    for _ in range(150):  # almost half stock phrases, and a copy that keeps them with a sixth of the rest
        head, own = [w for b in r.sample(stock, 4) for w in b], words(r, 122)
        texts += [head + own, head + own[:24]]
    for _ in range(200):  # no stock phrase, one set inside the other
        own = words(r, 240)
        texts += [own, own[: r.randrange(122, 140)]]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want = brute(docs)
    assert len(want & {(i, i + 1) for i in range(0, len(docs), 2)}) == 350
    got = {tuple(p) for p in near_pairs(spark.createDataFrame(docs, "conv_id long, markdown string")).collect()}
    assert got == want
