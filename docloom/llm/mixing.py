"""Problem 8: mixing sources to target weights, by hierarchical budgeting.

The sizes of all documents, in tokens of a public tokenizer, are summed by the
leaves of a tree (source, then language, then namespace). The total goes down
the tree: a source gets its target weight of it, its children get shares of
their size. A node can hold at most ``max_repeats`` times its tokens; what a
child cannot take goes to its siblings first, by their weights, and only what
the whole family cannot take to the siblings of the parent. A leaf's budget is
filled by whole epochs and a token prefix of one more epoch in a seeded order.

Only sums a leaf (a checked, bounded number) reach the driver. The prefix is
found without sorting a leaf: sums of 2^BITS ranges of the seeded order locate
the range where the budget ends, and only that range is sorted.

Defined results: null and empty texts hold no token; sources are compared
trimmed and in lower case; documents of unlisted or null sources count in the
size of all documents but get no share; a listed source without documents gets
nothing; a null max_repeats counts as 1; repeated rows of a source in the
targets add their weights and take the largest max_repeats.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.arrow import map_columns
from docloom.plans.session import materialise

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: fixed value: the word pattern that belongs to the byte-level vocabulary
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
BITS, MAX_LEAVES = 12, 100_000
TREE = ("source", "lang", "namespace_no")


def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("docloom", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, lang, namespace_no, n_tokens) of every document."""
    cache: dict = {}

    def fn(ids, texts, sources, langs, spaces):
        if "enc" not in cache:
            cache["enc"] = _encoding(tokenizer)
        enc = cache["enc"]
        return {"doc_id": ids, "source": sources, "lang": langs, "namespace_no": spaces, "n_tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in texts]}

    src = documents.select("doc_id", "text", F.lower(F.trim("source")).alias("source"), F.lower(F.trim("lang")).alias("lang"), F.col("namespace_no").cast("string").alias("namespace_no"))
    return map_columns(src, fn, "doc_id bigint, source string, lang string, namespace_no string, n_tokens bigint")


@dataclass
class Node:
    size: float = 0.0
    weight: float = 0.0
    room: float = 0.0
    budget: float = 0.0
    children: dict = field(default_factory=dict)


def share_out(budget: float, children: list[Node]) -> float:
    """Give each child its weight of the budget; what it cannot take goes to its siblings. Returns the rest."""
    for c in children:
        c.budget = 0.0
    open_, left = [c for c in children if c.weight > 0 and c.room > 0], budget
    while open_ and left > 1e-9 * max(1.0, budget):
        total, given = sum(c.weight for c in open_), 0.0
        for c in open_:
            give = min(left * c.weight / total, c.room - c.budget)
            c.budget += give
            given += give
        left -= given
        open_ = [c for c in open_ if c.room - c.budget > 1e-9 * c.room]
        if given <= 0:
            break
    return max(0.0, left)


def _tree(leaves: list[tuple], targets: dict[str, tuple[float, int]]) -> Node:
    root = Node()
    for path, size in leaves:
        if path[0] not in targets:
            continue
        repeats, node = targets[path[0]][1], root
        for key in path:
            node = node.children.setdefault(key, Node())
            node.size += size
            node.room += size * repeats
            node.weight = node.size
    for s, (w, _) in targets.items():
        root.children.setdefault(s, Node()).weight = w
    return root


def plan(leaves: list[tuple], targets: dict[str, tuple[float, int]], total: float) -> dict[tuple, tuple[float, float]]:
    """Budgets: path -> (tokens, size) of each leaf of listed sources. ``leaves``: (path, size)."""
    root = _tree(leaves, targets)
    out: dict[tuple, tuple[float, float]] = {}

    def down(path: tuple, node: Node, budget: float) -> None:
        if not node.children:
            out[path] = (budget, node.size)
            return
        share_out(budget, list(node.children.values()))
        for key, c in node.children.items():
            down((*path, key), c, c.budget)

    down((), root, total)
    return {p: b for p, b in out.items() if len(p) > 1}


def leaf_sums(sizes: DataFrame, max_leaves: int = MAX_LEAVES) -> list[tuple]:
    rows = sizes.groupBy(*TREE).agg(F.sum("n_tokens").alias("size")).limit(max_leaves + 1).collect()
    if len(rows) > max_leaves:
        raise ValueError(f"more than {max_leaves} leaves: take a coarser tree")
    return [(tuple(r[c] for c in TREE), float(r["size"] or 0)) for r in rows]


def target_map(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """Listed sources, trimmed and in lower case (a stated, small table)."""
    rows = targets.groupBy(F.lower(F.trim("source")).alias("s")).agg(F.sum("weight").alias("w"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("r")).where("s is not null").orderBy("s").collect()
    return {r.s: (float(r.w or 0), int(r.r)) for r in rows}


def report(leaves: list[tuple], targets: dict[str, tuple[float, int]]) -> list[tuple]:
    """(source, weight, max_repeats, size, budget, reachable) of each listed source.

    The budget is what the plan gives the source's leaves: its own share first and
    then of what others leave over. So a share is out of reach if the budget falls
    short of it, but for what rounding leaves.
    """
    total = sum(x for _, x in leaves)
    budget, size = dict.fromkeys(targets, 0.0), dict.fromkeys(targets, 0.0)
    for path, (b, n) in plan(leaves, targets, total).items():
        budget[path[0]] += b
        size[path[0]] += n
    return [(s, w, r, size[s], budget[s], budget[s] >= w * total * (1 - 1e-9)) for s, (w, r) in targets.items()]


def mixture(documents: DataFrame, targets: DataFrame, seed: int = 7, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mixture, shares, plan): (doc_id, source, n_repeats, n_tokens); the actual
    shares by source; the plan by source. ``n_repeats`` is how often a document enters."""
    spark = documents.sparkSession
    sizes = materialise(token_sizes(documents, tokenizer), "sizes")
    leaves, goal = leaf_sums(sizes), target_map(targets)
    budgets = plan(leaves, goal, sum(x for _, x in leaves))
    rows = []
    for path, (budget, size) in budgets.items():
        epochs = int(budget // size) if size else 0
        rest = budget - epochs * size if size else 0.0
        if size and rest > size * (1 - 1e-9):
            epochs, rest = epochs + 1, 0.0
        rows.append((*path, epochs, rest))
    schema = ", ".join(f"{c} string" for c in TREE) + ", epochs int, rest double"
    leaf = F.broadcast(spark.createDataFrame(rows, schema).withColumnsRenamed({c: f"l_{c}" for c in TREE}))  # at most MAX_LEAVES rows
    same = [F.col(c).eqNullSafe(F.col(f"l_{c}")) for c in TREE]
    x = sizes.join(leaf, same).drop(*[f"l_{c}" for c in TREE])
    # the order of the epoch that is not whole depends on the seed, the epoch and the document
    x = x.withColumn("h", F.xxhash64(F.lit(seed), "epochs", "doc_id")).withColumn("part", F.shiftrightunsigned("h", 64 - BITS).cast("int"))
    keys = list(TREE)
    sums = x.where("rest > 0").groupBy(*keys, "part").agg(F.sum("n_tokens").alias("t"))
    w = Window.partitionBy(*keys).orderBy("part")
    sums = sums.withColumn("before", F.sum("t").over(w) - F.col("t")).withColumnsRenamed({c: f"s_{c}" for c in keys} | {"part": "s_part"})
    y = x.where("rest > 0").join(sums, [*[F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in keys], F.col("part") == F.col("s_part")]).drop(*[f"s_{c}" for c in keys], "s_part")
    full = y.where("before + t <= rest").select("doc_id")
    edge = y.where("before < rest and before + t > rest")
    v = Window.partitionBy(*keys, "part").orderBy("h", "doc_id")
    edge = edge.withColumn("c", F.col("before") + F.sum("n_tokens").over(v)).where("c <= rest").select("doc_id")
    extra = full.union(edge).withColumn("extra", F.lit(1))
    mix = x.join(extra, "doc_id", "left").select("doc_id", "source", (F.col("epochs") + F.coalesce("extra", F.lit(0))).alias("n_repeats"), "n_tokens").where("n_repeats > 0")
    mix = materialise(mix, "mixture")
    total = mix.agg(F.sum(F.col("n_repeats") * F.col("n_tokens")).alias("all"))
    planned = spark.createDataFrame(report(leaves, goal), "source string, weight double, max_repeats int, size double, budget double, reachable boolean")
    by = mix.groupBy("source").agg(F.sum(F.col("n_repeats") * F.col("n_tokens")).alias("tokens"), F.count("*").alias("n_docs"), F.max("n_repeats").alias("most_repeats"))
    shares = planned.select("source", "weight", "max_repeats", "reachable").join(by, "source", "left").join(F.broadcast(total))
    shares = shares.select("source", "weight", "reachable", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.round(F.coalesce(F.try_divide("tokens", "all"), F.lit(0.0)), 6).alias("actual_share"))
    return mix, shares, planned


def short_sources(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(source): the listed sources whose budget in the plan stays below their share."""
    goal = target_map(targets)
    rows = [(r[0],) for r in report(leaf_sums(token_sizes(documents, tokenizer)), goal) if not r[5]]
    return documents.sparkSession.createDataFrame(rows, "source string")
