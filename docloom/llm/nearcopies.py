"""Problem 6: near copies, by meet-in-the-middle ball hashing.

A text's fingerprint is the set of the ``WIDTH`` smallest hashes of its distinct
three-word shingles (a bottom-k sketch, so two fingerprints overlap as the texts
do). In the metric of symmetric difference two fingerprints within radius
2 * (WIDTH - CORE) share at least CORE hashes, and the midpoint between them lies
within half the radius of both: a fingerprint emits sets that it reaches by
dropping WIDTH - CORE of its hashes. Similar texts share many hashes, and some
of these stand close together in both, so of the sets of two only those at most
``REACH`` ranks apart are emitted. These variants are shuffled, equal ones meet,
the colliding pairs are deduplicated and each is verified on the full shingle
sets. Pairs whose sizes or whose 64 two-bit minhashes are too far apart are
dropped in the join, before they are written anywhere, and those whose 256 are
before the sets are fetched.

A binary fingerprint was computed first: at the lowest true similarity (0.58)
one minhash bit differs with probability 0.21, so 64 bits need radius 20 and
half of it has 10^11 variants; the ball over sets of hashes needs 45.

Variants that many texts emit. The variants are counted; one of more than ``WIDE``
texts is replaced by its extensions, sets with one hash more from the next
``FURTHER`` ranks (a smaller radius for crowded places), level by level up to
``LEVELS`` hashes or the end of the fingerprint, where it stays. So the pairs that
collide grow with the texts, not with their square, whatever the size of the
collection; which variants are wide is known from 2 MB of flags.

Frequent shingles (stock phrases) are recognised by counters over all texts
(one row of 2^20, so a bounded broadcast of 128 KB of flags). Let f and g be the
shares of frequent shingles in two texts' sets. At a similarity of 1/2 or more a
quarter of the larger set or more is common and not frequent, and so are some six
hashes of the fingerprints, unless one share is at least 1/4 and the other at
least 5/12. So variants of frequent hashes alone are emitted only by texts with a
share of 1/4, and those below 5/12 meet only those above. A set of one shingle and one of two are
found by their single hashes, the smaller set on one side of the join.

Texts with the same shingle set form one class and one member stands for it;
pairs are found between classes and expanded at the end.

Defined results: null, empty and texts of fewer than three words have no
shingle and no partner; redelivered rows count once; input ids are unique but
for redelivery.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.arrow import map_columns
from docloom.llm import shingles as S
from docloom.llm.lookalike import canonical
from docloom.plans.session import free_shuffles, materialise

WIDTH, CORE, REACH, SHINGLE = 24, 2, 2, 3
#: a variant of more texts is extended, by one of so many next ranks, to at most so many hashes
WIDE, FURTHER, LEVELS = 25, 3, 6
COUNTERS, FLAGS, PART_ROWS = 1 << 20, 1 << 24, 400_000
#: a shingle in more than this share of the texts (and more than HOT_LEAST texts) is frequent
HOT_SHARE, HOT_LEAST = 0.002, 64
#: 256 two-bit minhashes, their first bits in s0 to s3, the second in s4 to s7; those of 64 travel with the variants
SIGNATURE = tuple(f"s{k}" for k in range(8))
CARRIED = ("s0", "s4")
_BLOCK = 1 << 12
_STEP, _ASIDE, _ALONE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def _sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    own = [canonical(t).lower() if t else "" for t in texts]
    return S.distinct_sets(own, SHINGLE)


def frequent_slots(df: DataFrame, text_col: str = "markdown") -> tuple[bytes, int]:
    """Flags of the counters that frequent shingles fall into, and the number of texts.

    Each task counts the texts of its shingles into 2^20 counters; the counters
    are summed by block, and only packed flags (128 KB) come to the driver.
    """

    def count(batches):
        total, n = np.zeros(COUNTERS, np.int64), 0
        for b in batches:
            texts = b.column(0).to_pylist()
            h, _ = _sets(texts)
            total += np.bincount((h & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
            n += sum(t is not None for t in texts)
        if n:
            blocks = [total[k : k + _BLOCK].astype(np.uint32).tobytes() for k in range(0, COUNTERS, _BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary()), pa.array([n] * len(blocks), pa.int64())], ["block", "counts", "n"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(_BLOCK, np.int64), 0
        for b in batches:
            for c, k in zip(b.column("counts").to_pylist(), b.column("n").to_pylist()):
                total += np.frombuffer(c, np.uint32)
                n += k
        hot = np.packbits(total > max(HOT_LEAST, HOT_SHARE * n)).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([hot], pa.binary()), pa.array([n], pa.int64())], ["block", "hot", "n"])

    counts = df.select(text_col).mapInArrow(count, "block int, counts binary, n long")
    rows = counts.groupBy("block").applyInArrow(add, "block int, hot binary, n long").collect()  # 256 rows of 0.5 KB
    rows.sort(key=lambda r: r.block)
    return b"".join(bytes(r.hot) for r in rows), rows[0].n if rows else 0


def fingerprints(df: DataFrame, hot: bytes, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """(id, cls, fp, hot, stock, s0 to s3, n, s): class digest of the shingle set, its
    fingerprint with a bit for each frequent hash, how many of 1/4 and 5/12 the share
    of its frequent shingles reaches, 256 two-bit minhashes, its size
    and the set itself as 32-bit hashes, for verification."""
    share = df.sparkSession.sparkContext.broadcast(hot)
    names = (id_col, "cls", "fp", "hot", "stock", *SIGNATURE, "n", "s")

    def fn(ids, texts):
        flags = np.unpackbits(np.frombuffer(share.value, np.uint8)).astype(bool)
        h, at = _sets(texts)
        key = S.mix(h + np.uint64(1))  # another order than the counters'
        is_hot = flags[(h & np.uint64(COUNTERS - 1)).astype(np.int64)] if len(flags) else np.zeros(len(h), bool)
        sig = _signatures(h, at)
        low = (S.mix(h) >> np.uint64(32)).astype(np.uint32).astype(np.int32)
        out = {c: [] for c in names}
        for k, i in enumerate(ids):
            a, b = at[k], at[k + 1]
            if a == b:
                continue
            own, frequent = key[a:b], is_hot[a:b]
            least = np.argpartition(own, width)[:width] if len(own) > width else np.arange(len(own))
            least = least[np.argsort(own[least])]
            bits = int(sum(1 << j for j in np.flatnonzero(frequent[least]).tolist()))
            f = frequent.sum()
            stock = int(4 * f >= b - a) + int(12 * f >= 5 * (b - a))
            digest = hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest()
            for name, y in zip(names, (i, digest, own[least].astype(np.int64), bits, stock, *sig[k], b - a, low[a:b])):
                out[name].append(y)
        return out

    kind = df.schema[id_col].dataType.simpleString()
    return map_columns(df.select(id_col, text_col), fn, f"{id_col} {kind}, cls binary, fp array<bigint>, hot bigint, stock int, {', '.join(f'{c} bigint' for c in SIGNATURE)}, n int, s array<int>")


def _signatures(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """256 two-bit values a text: of each of 256 equal ranges of the hashes, two bits
    of the least hash in it."""
    n = len(at) - 1
    sig = np.zeros((n, 8), np.uint64)
    if len(h):
        of, range_ = np.repeat(np.arange(n), np.diff(at)), (h >> np.uint64(40)).astype(np.int64)
        first = np.concatenate(([True], (of[1:] != of[:-1]) | (range_[1:] != range_[:-1])))
        least, place = S.mix(h[first]), (range_[first] & 63).astype(np.uint64)
        for p in (0, 1):
            bit = ((least >> np.uint64(p)) & np.uint64(1)) << place
            np.bitwise_or.at(sig, (of[first], 4 * p + (range_[first] >> 6)), bit)
    return sig.astype(np.int64)


def _apart(halves: list[tuple[str, str]]) -> Column:
    """How many two-bit values of a and b differ."""
    x = lambda c: F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))
    return sum((F.bit_count(x(p).bitwiseOR(x(q))) for p, q in halves[1:]), F.bit_count(x(halves[0][0]).bitwiseOR(x(halves[0][1]))))


def variants(fps: list, hots: list[int], stocks: list[int], wide: list[np.ndarray], open_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, variant, role) of all texts: sets of ``CORE`` hashes, extended where ``wide``.

    ``wide`` has the flags of the levels counted so far. Role 0 meets its like; 1 meets 2.
    With ``open_only`` only the variants of the last level, which are still to be counted.
    """
    size = np.fromiter(map(len, fps), np.int64, len(fps))
    most = int(size.max()) if len(fps) else 0
    f, hot = np.zeros((len(fps), most), np.uint64), np.zeros((len(fps), most), bool)
    for k, x in enumerate(fps):
        f[k, : len(x)] = np.asarray(x, np.int64).view(np.uint64)
    for j in range(most):
        hot[:, j] = (np.asarray(hots, np.int64) >> j) & 1
    stock = np.asarray(stocks, np.int64)

    def grow(at, reach):
        t, last, h, bare = at
        parts = []
        for d in range(1, most):
            ok = (last + d < size[t]) & ((d <= reach) | (size[t] <= 2 * CORE))
            if not ok.any():
                break
            i, j = t[ok], last[ok] + d
            parts.append((i, j, S.mix(h[ok] * _STEP + f[i, j]), bare[ok] & hot[i, j]))
        return tuple(map(np.concatenate, zip(*parts))) if parts else tuple(x[:0] for x in at)

    t, last = np.nonzero(np.arange(most) < size[:, None])
    at = (t, last, S.mix(f[t, last]), hot[t, last])
    alone = size[t] <= 2
    at = grow(at, REACH)
    at = tuple(x[~at[3] | (stock[at[0]] > 0)] for x in at)
    done = []
    for flags in wide:
        more = flags[(at[2] & np.uint64(FLAGS - 1)).astype(np.int64)] & (at[1] + 1 < size[at[0]])
        done.append(tuple(x[~more] for x in at))
        at = grow(tuple(x[more] for x in at), FURTHER)
        at = tuple(x[~at[3] | (stock[at[0]] > 0)] for x in at)
    if open_only:
        return at[0], at[2], np.zeros(len(at[0]), np.int8)
    i, _, h, bare = (np.concatenate(x) for x in zip(*done, at))
    # of frequent hashes alone: full sets of them meet each other, and on one side of a second join the less full ones
    some, full = bare & (stock[i] == 1), bare & (stock[i] == 2)
    texts = [i[~some], i[some], i[full], t[alone]]
    keys = [h[~some], h[some] ^ _ASIDE, h[full] ^ _ASIDE, S.mix(f[t[alone], last[alone]] ^ _ALONE)]
    roles = [np.zeros((~some).sum(), np.int8), np.full(some.sum(), 2, np.int8), np.full(full.sum(), 1, np.int8), size[t[alone]].astype(np.int8)]
    return np.concatenate(texts), np.concatenate(keys), np.concatenate(roles)


def variant_rows(reps: DataFrame, wide: list[bytes], open_only: bool = False, only: int = 0, asked: bytes | None = None) -> DataFrame:
    """``variants`` of one role of (rep, fp, hot, stock, CARRIED, n): (v, rep, CARRIED, n), or v only.
    ``asked`` has the flags of the only variants that can meet another."""
    share = reps.sparkSession.sparkContext.broadcast([zlib.compress(x, 1) for x in (*wide, *([asked] if asked else []))])
    carried = [] if open_only else ["rep", *CARRIED, "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = [np.unpackbits(np.frombuffer(zlib.decompress(x), np.uint8)).astype(bool) for x in share.value]
        last = flags.pop() if asked else None
        for b in batches:
            if not b.num_rows:
                continue
            fp = b.column("fp")
            at, values = fp.offsets.to_numpy(), fp.values.to_numpy()
            fps = [values[x:y] for x, y in zip(at[:-1], at[1:])]
            t, v, role = variants(fps, b.column("hot").to_pylist(), b.column("stock").to_pylist(), flags, open_only)
            cols = [pa.array(v.view(np.int64))]
            if not open_only:
                mine = np.flatnonzero(role == only)
                if asked:
                    mine = mine[last[(v[mine] & np.uint64(FLAGS - 1)).astype(np.int64)]]
                cols = [pa.array(v.view(np.int64)[mine]), *[b.column(c).take(pa.array(t[mine])) for c in carried]]
            yield pa.RecordBatch.from_arrays(cols, ["v", *carried])

    kind = reps.schema["rep"].dataType.simpleString()
    schema = "v bigint" if open_only else f"v bigint, rep {kind}, {', '.join(f'{c} bigint' for c in CARRIED)}, n int"
    return reps.select("fp", "hot", "stock", *carried).mapInArrow(run, schema)


def wide_flags(keys: DataFrame, most: int = WIDE) -> bytes | None:
    """Flags of the places (``v`` modulo FLAGS) of variants that more than ``most`` texts emit; None if there are none."""
    crowded = keys.groupBy("v").agg(F.count("*").alias("k")).where(F.col("k") > most)
    place = F.col("v").bitwiseAND(F.lit(FLAGS - 1))
    size = FLAGS // 512

    def pack(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for b in batches:
            bits[b.column("p").to_numpy() % size] = True
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["block", "bits"])

    places = crowded.select((place / size).cast("int").alias("block"), place.alias("p")).distinct()
    rows = places.groupBy("block").applyInArrow(pack, "block int, bits binary").collect()  # at most 512 rows of 4 KB
    if not rows:
        return None
    by = {r.block: bytes(r.bits) for r in rows}
    return b"".join(by.get(k, bytes(size // 8)) for k in range(512))


def flagged(rows: DataFrame, flags: bytes) -> DataFrame:
    """The rows whose ``v`` has its flag set; a superset of the flagged values, without a shuffle."""
    share = rows.sparkSession.sparkContext.broadcast(zlib.compress(flags, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(share.value), np.uint8)).astype(bool)
        for b in batches:
            keep = bits[b.column("v").to_numpy() & (FLAGS - 1)]
            if keep.any():
                yield b.filter(pa.array(keep))

    return rows.mapInArrow(run, rows.schema)


def near_classes(df: DataFrame, id_col: str = "conv_id", text_col: str = "markdown", threshold: float = 0.5, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(members, links): (id, rep) of every text with shingles, and the verified
    (rep_a, rep_b, similarity) between classes. Both are tables in the shared folder."""
    src = df.select(id_col, text_col).where(F.col(text_col).isNotNull())
    hot, _ = frequent_slots(src, text_col)
    prints = materialise(fingerprints(src, hot, id_col, text_col, width), "prints")
    # copies of one class hold the same fingerprint: the smallest id stands for them
    first = [F.first(c).alias(c) for c in ("fp", "hot", "stock", *SIGNATURE, "n")]
    reps = materialise(prints.groupBy("cls").agg(F.min(id_col).alias("rep"), *first), "reps")
    members = materialise(prints.select(id_col, "cls").distinct().join(reps.select("cls", "rep"), "cls").select(id_col, "rep"), "members")
    free_shuffles(df.sparkSession)
    wide: list[bytes] = []
    while len(wide) < LEVELS - CORE and (flags := wide_flags(variant_rows(reps, wide, open_only=True), WIDE)):
        wide.append(flags)
    free_shuffles(df.sparkSession)
    side = lambda df, x: df.select("v", *[F.col(c).alias(f"{c}_{x}") for c in ("rep", *CARRIED, "n")])
    like = (F.col("n_a") >= threshold * F.col("n_b")) & (F.col("n_b") >= threshold * F.col("n_a")) & _close([CARRIED], threshold)
    # one shuffle serves both sides, in parts of about PART_ROWS rows whatever the size of the collection
    alike = variant_rows(reps, wide).repartition(1 + reps.count() * 2 * width // PART_ROWS, "v")
    met = side(alike, "a").join(side(alike, "b"), "v").where(F.col("rep_a") < F.col("rep_b")).where(like)
    fewer = variant_rows(reps, wide, only=2)
    fuller = variant_rows(reps, wide, only=1, asked=wide_flags(fewer.select("v"), 0) or bytes(FLAGS // 8))
    across = side(fuller, "a").join(side(fewer, "b"), "v").where(like)
    pair = [F.least("rep_a", "rep_b").alias("rep_a"), F.greatest("rep_a", "rep_b").alias("rep_b")]
    met = materialise(met.select("rep_a", "rep_b").union(across.select(*pair)).distinct(), "met")
    free_shuffles(df.sparkSession)
    whole = lambda x: reps.select(F.col("rep").alias(f"rep_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in (*SIGNATURE, "n")])
    near = _close([(f"s{k}", f"s{k + 4}") for k in range(4)], threshold)
    cand = met.join(whole("a"), "rep_a").join(whole("b"), "rep_b").where(near)
    cand = materialise(cand.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")), "candidates")
    free_shuffles(df.sparkSession)
    # only sets of texts with candidates are shuffled
    ids = cand.select(F.col("a").alias("i")).union(cand.select("b"))
    asked = wide_flags(ids.select(F.xxhash64("i").alias("v")), 0)
    held = flagged(prints.select(F.xxhash64(id_col).alias("v"), F.col(id_col).alias("i"), "s"), asked or bytes(FLAGS // 8))
    sets = lambda i, c: held.select(F.col("i").alias(i), F.col("s").alias(c))
    y = cand.join(sets("a", "sa"), "a").join(sets("b", "sb"), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    scored = y.select(F.col("a").alias("rep_a"), F.col("b").alias("rep_b"), both.alias("k"), (F.size("sa") + F.size("sb")).alias("n"))
    links = scored.select("rep_a", "rep_b", (F.col("k") / (F.col("n") - F.col("k"))).alias("similarity")).where(F.col("similarity") >= threshold)
    return members, materialise(links.distinct(), "links")  # redelivered rows give a link twice


def _close(halves: list[tuple[str, str]], threshold: float) -> Column:
    """Whether so few two-bit values differ as they do for a pair at the threshold, but for a chance below 10^-4.

    Of the ranges that the union of both sets occupies, at most a share of
    1 - threshold has a least hash that is not common, and three in four of these
    differ; the bound is 3.8 standard deviations above.
    """
    values = 64 * len(halves)
    union = (F.col("n_a") + F.col("n_b")) / (1 + threshold)
    occupied, differ = 1 - F.exp(-union / values), (1 - threshold) * 3 / 4
    mean = values * occupied * differ
    return _apart(halves) <= mean + 3.8 * F.sqrt(mean * (1 - occupied * differ)) + 1


def near_pairs(df: DataFrame, id_col: str = "conv_id", text_col: str = "markdown", threshold: float = 0.5, width: int = WIDTH) -> DataFrame:
    """(id_a, id_b): all pairs of different ids whose texts reach the threshold."""
    members, links = near_classes(df, id_col, text_col, threshold, width)
    m = lambda x, r: members.select(F.col(id_col).alias(x), F.col("rep").alias(r))
    same = m("x", "r").join(m("y", "r"), "r").where("x < y").select("x", "y")
    cross = links.select("rep_a", "rep_b").join(m("x", "rep_a"), "rep_a").join(m("y", "rep_b"), "rep_b").select("x", "y")
    return same.union(cross).select(F.least("x", "y").alias(f"{id_col}_a"), F.greatest("x", "y").alias(f"{id_col}_b"))


def near_groups(df: DataFrame, id_col: str = "conv_id", text_col: str = "markdown", threshold: float = 0.5, width: int = WIDTH) -> DataFrame:
    """(id, rep, group_id, n_links): the class, the group of copies and the
    number of links to other classes of every text with shingles."""
    members, links = near_classes(df, id_col, text_col, threshold, width)
    edges = links.select(F.col("rep_a").alias("u"), F.col("rep_b").alias("w"))
    edges = edges.union(edges.select("w", "u")).toDF("u", "w")
    degree = edges.groupBy("u").agg(F.count("*").alias("n_links"))
    label = degree.select("u", F.col("u").alias("g"))
    moved = True
    while moved:  # each round the smallest id reaches twice as far
        best = edges.join(label.select(F.col("u").alias("w"), "g"), "w").groupBy("u").agg(F.min("g").alias("m"))
        # the label of one's label: halves the distance to the smallest id
        step = label.join(best, "u").select("u", "g", F.least("g", "m").alias("m"))
        jump = label.select(F.col("u").alias("m"), F.col("g").alias("j"))
        nxt = materialise(step.join(jump, "m").select("u", F.col("j").alias("g"), (F.col("j") != F.col("g")).alias("moved")), "labels")
        label, moved = nxt.select("u", "g"), not nxt.where("moved").isEmpty()
    out = members.join(label.withColumnRenamed("u", "rep"), "rep", "left").join(degree.withColumnRenamed("u", "rep"), "rep", "left")
    return out.select(id_col, "rep", F.coalesce("g", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
