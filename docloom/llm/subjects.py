"""Problem 9: subject areas of each document, by calibrated classifier chains.

Features. Running prose and list text is cut into sentences and list items;
unfinished stray lines are neither. A term table (term -> subject) is learned
from the sentences of the labelled pages, in rounds, so that pages of two
subjects do not blur it. A page's features for a subject are
the share of its text in sentences with a term of the subject, and how much of
that another subject explains (has at least as many terms there); besides them
its source and its structure.

Chain. One logistic model for each subject in order of frequency. It sees the
decisions of those before it in two ways: as bits, for co-occurrence, and through
the evidence: text that a subject already decided on explains is told from text
that only undecided or rejected subjects would explain. So a stray term of a
subject in another's sentences counts for little once that other one is decided.
Label combinations are decoded by beam search over the product of the
probabilities, each calibrated on held-out labels (Platt).

Labels. Hand labels are never dropped: a share ``NOISE`` of them is expected to
be wrong, and each fit works with the labels' probabilities under that rate
(expectation maximisation, ``ROUNDS`` rounds). Labelled pages all have a subject,
so negatives come from the unlabelled pages (positive-unlabelled learning): a
first model without chain is fitted on the labelled pages, and unlabelled pages
on which it is sure of every subject, none included, join the chain's training.

Training uses at most ``max_labelled`` labelled and as many unlabelled pages
(those of the smallest hash, default 2,000) and of either at most ``max_chars``
characters; scoring covers every document in one narrow pass.

Defined results: null, empty and redirect pages and pages without running text
have no row; labels are compared trimmed and in lower case, labels of unknown
subjects or documents are left out, repeated labels count once; without any
label the result is empty.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.arrow import map_columns
from docloom.llm.shingles import chunked_words
from docloom.llm.wikitext import running_lines

MAX_LABELLED, MAX_CHARS, BEAM, SOURCES = 2_000, 20_000_000, 6, 8
#: shares count in tenths up to four; the share of wrong labels; rounds of expectation maximisation; a sure probability
LEVEL, NOISE, ROUNDS, SURE = 4.0, 0.02, 3, 0.9
#: rounds over the term table; a term's subject has LEAN of its uses in sentences with a subject (FIRST while pages of
#: two subjects count half for each) and MOSTLY of all its uses; the likelihood ratio against chance must pass an information criterion: RATIO times the log of the sentences
TERM_ROUNDS, FIRST, LEAN, MOSTLY, RATIO = 2, 0.6, 0.75, 0.6, 1.25
_SENTENCE = re.compile(r"(?<=[^\W\d_]{2}[.?])\s+|(?<=\d[.?])\s+(?=\w)|(?<=[^\W\d_]{2}[.?])(?=[A-ZÀ-Þ])")
_ITEM = re.compile(r"[*#:;]+\s*")


def sentences(text: str | None) -> list[str]:
    """Sentences and list items of the running text; unfinished short lines are none."""
    if not text or text.lstrip()[:9].lower() == "#redirect":
        return []
    out: list[str] = []
    prose: list[str] = []
    finished = False

    def flush() -> None:
        nonlocal finished
        for s in _SENTENCE.split(" ".join(prose)) if prose else ():
            n = s.count(" ") + 1
            if n >= 5 and s[-1:] in ".?":
                finished = True
                out.append(s)
            elif n >= 15 and "!!" not in s:
                out.append(s)
        prose.clear()

    for s in running_lines(text):
        m = _ITEM.match(s)
        if m:
            flush()
            if s.find(" ", m.end()) > 0:
                finished = True
                out.append(s[m.end() :])
        else:
            prose.append(s)
    flush()
    # a page without any finished sentence or list item is no prose
    return out if finished else []


def _terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(term hash, sentence index) and of each sentence (text index, length)."""
    parts = [sentences(t) for t in texts]
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    flat = [s.lower() for p in parts for s in p]
    size = np.fromiter(map(len, flat), np.float64, len(flat))
    got = [(h, of + i) for i, _, h, of in chunked_words(flat)]
    if not got:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), doc, size
    return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]), doc, size


@dataclass
class Model:
    subjects: list[str]
    terms: np.ndarray  # sorted hashes
    subject: np.ndarray  # of each term
    order: list[int]
    weights: list[np.ndarray]  # a row of ``_link`` features each
    calibration: list[tuple[float, float]]
    mean: np.ndarray  # of the structure features
    scale: np.ndarray


@dataclass
class Evidence:
    """Of each text: the share of it in sentences with a term of a subject, and
    with terms of a subject and at least as many of another one."""

    some: np.ndarray  # texts x subjects
    over: np.ndarray  # texts x subjects x other subjects
    shape: np.ndarray  # log length, share of sentences without any term
    source: np.ndarray

    def take(self, rows) -> Evidence:
        return Evidence(self.some[rows], self.over[rows], self.shape[rows], self.source[rows])

    def join(self, more: Evidence) -> Evidence:
        return Evidence(*(np.concatenate([getattr(self, f), getattr(more, f)]) for f in ("some", "over", "shape", "source")))


def evidence(terms: np.ndarray, subject: np.ndarray, k: int, got: tuple, sources: list[str | None]) -> Evidence:
    h, of, doc, size = got
    n = len(sources)
    c = _counts(terms, subject, k, h, of, len(size))
    length = np.bincount(doc, weights=size, minlength=n)
    part = size / np.maximum(length, 1)[doc] if len(size) else size
    add = lambda at, w: np.bincount(doc[at], weights=w, minlength=n)
    some, over = np.zeros((n, k)), np.zeros((n, k, k))
    mixed = (c > 0).sum(1) > 1
    for s in range(k):
        at = np.flatnonzero(c[:, s] > 0)
        some[:, s] = add(at, part[at])
        at = at[mixed[at]]
        for d in range(k):
            if d != s:
                by = at[c[at, d] >= c[at, s]]
                over[:, s, d] = add(by, part[by])
    bare = np.flatnonzero(c.sum(1) == 0)
    return Evidence(some, over, np.stack([np.log1p(length), add(bare, part[bare])], 1), _source(sources))


def _counts(terms: np.ndarray, subject: np.ndarray, k: int, h: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    if not len(terms):
        return np.zeros((n, k))
    at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
    hit = terms[at] == h
    return np.bincount(of[hit] * k + subject[at[hit]], minlength=n * k).reshape(n, k).astype(float)


def _source(names: list[str | None]) -> np.ndarray:
    """A small hashed one-hot of the source, spelled trimmed and in lower case."""
    import zlib

    out = np.zeros((len(names), SOURCES))
    for i, s in enumerate(names):
        if s and s.strip():
            out[i, zlib.crc32(s.strip().lower().encode()) % SOURCES] = 1
    return out


def learn_terms(got: tuple, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The term table of labelled texts: (sorted term hashes, subject).

    First from shares: a sentence of a page of two subjects is half about each.
    Then in rounds a sentence is about that one of its page's subjects it has
    most terms of.
    """
    n, k = y.shape
    h, of, doc, size = got
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    vocab, t = np.unique(h, return_inverse=True)
    v = len(vocab)
    pair = np.unique(of * v + t)  # each term once a sentence
    sent, w = pair // v, pair % v
    least = RATIO * np.log(max(2, len(size)))
    one = y / np.maximum(1, y.sum(1, keepdims=True))
    n_ts = np.stack([np.bincount(w, weights=one[doc[sent], s], minlength=v) for s in range(k)], 1)
    table = _assign(n_ts, n_ts.sum(1), n_ts.sum(0) / max(1.0, n_ts.sum()), least, FIRST)
    for _ in range(TERM_ROUNDS):
        hit = table[w] >= 0
        c = np.bincount(sent[hit] * k + table[w[hit]], minlength=len(size) * k).reshape(-1, k) * y[doc]
        about = np.where(c.max(1) > 0, np.argmax(c, 1), -1)
        at = about[sent]
        n_ts = np.stack([np.bincount(w[at == s], minlength=v) for s in range(k)], 1)
        prior = (about[:, None] == np.arange(k)).sum(0) / max(1, (about >= 0).sum())
        table = _assign(n_ts, np.bincount(w, minlength=v), prior, least, LEAN)
    keep = table >= 0
    return vocab[keep], table[keep]


def _assign(n_ts: np.ndarray, n_all: np.ndarray, prior: np.ndarray, least: float, lean: float) -> np.ndarray:
    """The subject of each term, or -1: the one it leans to most, if it holds ``lean`` of the
    term's uses in sentences with a subject, ``MOSTLY`` of all its uses, and the likelihood
    ratio against chance is at least ``least``."""
    prior = np.clip(prior, 1e-6, 1 - 1e-6)
    best = np.argmax(n_ts / prior, 1)
    top, p, n = n_ts[np.arange(len(n_ts)), best], prior[best], n_ts.sum(1)
    n, rest = np.maximum(n, 1e-9), np.maximum(n - top, 0)
    g = 2 * (top * np.log(np.maximum(top, 1e-9) / (n * p)) + rest * np.log(np.maximum(rest, 1e-9) / (n * (1 - p))))
    return np.where((top >= lean * n) & (top >= min(lean, MOSTLY) * n_all) & (g >= least), best, -1)


def _logistic(x: np.ndarray, y: np.ndarray, l2: float | np.ndarray, steps: int = 30) -> np.ndarray:
    """Newton's method with an unpenalised intercept in the last column; ``y`` may be probabilities."""
    w = np.zeros(x.shape[1])
    ridge = np.zeros(len(w)) + l2
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = _sigmoid(x @ w)
        g = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), g)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _true_label(y: np.ndarray, p: np.ndarray, noise: float = NOISE) -> np.ndarray:
    """Probability that a label is true, given the label as written and the model's p."""
    yes, no = np.where(y > 0, 1 - noise, noise) * p, np.where(y > 0, noise, 1 - noise) * (1 - p)
    return yes / (yes + no)


def _level(share: np.ndarray) -> np.ndarray:
    return np.minimum(share * 10, LEVEL)


def _alone(e: Evidence, s: int, shape: np.ndarray) -> np.ndarray:
    """Features of a subject without any decision."""
    own = np.stack([_level(e.some[:, s]), _level(e.over[:, s].max(1))], 1)
    return np.concatenate([own, shape, e.source / 4, np.ones((len(own), 1))], 1)


def _link(e: Evidence, s: int, order: list[int], shape: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Features of subject ``s`` given the decisions ``before`` (columns in the order of the chain).

    Of the text with terms of s: what decided subjects explain, what only rejected
    and what only open ones would; then the decisions themselves.
    """
    i = order.index(s)
    done, later = order[:i], order[i + 1 :]
    over = e.over[:, s]
    most = lambda v: v.max(1) if v.shape[1] else np.zeros(len(v))
    yes = most(over[:, done] * before[:, :i])
    no = np.maximum(0, most(over[:, done] * (1 - before[:, :i])) - yes)
    open_ = np.maximum(0, most(over[:, later]) - yes)
    own = np.stack([_level(e.some[:, s]), _level(open_), _level(yes), _level(no)], 1)
    return np.concatenate([own, before, shape, e.source / 4, np.ones((len(own), 1))], 1)


def chain_columns(k: int) -> list[int]:
    """Columns of ``_link`` that depend on decisions: explained and rejected evidence, then a bit a subject."""
    return [2, 3, *range(4, 4 + k)]


def _ridge(x: np.ndarray, n_evidence: int, l2: float, rest: float) -> np.ndarray:
    return np.where(np.arange(x.shape[1]) < n_evidence, l2, rest)


def _fit_labels(x: np.ndarray, y: np.ndarray, use: np.ndarray, noisy: np.ndarray, l2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights on the rows ``use`` and the labels' probabilities of all rows; only ``noisy`` ones are doubted."""
    q = y.astype(float)
    for _ in range(ROUNDS):
        w = _logistic(x[use], q[use], l2)
        q = np.where(noisy, _true_label(y, _sigmoid(x @ w)), y)
    return w, q


def fit(texts: list[str], sources: list[str | None], y: np.ndarray, subjects: list[str], l2: float = 0.05, l2_rest: float = 1.0, unlabelled: tuple[list[str], list[str | None]] = ((), ())) -> Model:
    """Fit term table, chain and calibration on labelled texts (y: texts x subjects) and unlabelled ones.

    Evidence has the ridge penalty ``l2``; decisions, structure and source, which
    can explain a wrong label by chance, have ``l2_rest``.
    """
    k, n, m = len(subjects), len(texts), len(unlabelled[0])
    got = _terms(texts)
    terms, subject = learn_terms(got, y)
    e = evidence(terms, subject, k, got, sources)
    if m:
        e = e.join(evidence(terms, subject, k, _terms(unlabelled[0]), unlabelled[1]))
    mean, scale = e.shape.mean(0), 4 * e.shape.std(0) + 1e-6
    shape = (e.shape - mean) / scale
    order = np.argsort(-y.sum(0), kind="stable").tolist()
    # unlabelled pages on which models without chain are sure of every subject
    sure, guess = np.ones(m, bool), np.zeros((m, k))
    for s in range(k):
        x = _alone(e, s, shape)
        w, _ = _fit_labels(x[:n], y[:, s], np.ones(n, bool), np.ones(n, bool), _ridge(x, 2, l2, l2_rest))
        p = _sigmoid(x[n:] @ w)
        sure &= np.abs(p - 0.5) >= SURE - 0.5
        guess[:, s] = p > 0.5
    rows = np.concatenate([np.arange(n), n + np.flatnonzero(sure)])
    e, shape, y = e.take(rows), shape[rows], np.concatenate([y, guess[sure]])
    noisy = np.arange(len(rows)) < n
    held = noisy & (np.arange(len(rows)) % 5 == 4) if n >= 50 else np.zeros(len(rows), bool)
    weights, calibration = [], []
    before = np.zeros((len(rows), k))
    for i, s in enumerate(order):
        x = _link(e, s, order, shape, before)
        w, q = _fit_labels(x, y[:, s], ~held, noisy, _ridge(x, 4, l2, l2_rest))
        a, b = 1.0, 0.0
        if held.any() and 0.5 < q[held].sum() < held.sum() - 0.5:
            z = np.stack([np.clip(x[held] @ w, -30, 30), np.ones(held.sum())], 1)
            pos = q[held].sum()
            neg = held.sum() - pos
            a, b = _logistic(z, q[held] * (pos + 1) / (pos + 2) + (1 - q[held]) / (neg + 2), 0.01)  # Platt's targets
            a = max(a, 1e-3)
        weights.append(w)
        calibration.append((float(a), float(b)))
        before[:, i] = q > 0.5
    return Model(subjects, terms, subject, order, weights, calibration, mean, scale)


def predict(m: Model, texts: list[str | None], sources: list[str | None], beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts x subjects decisions, probability of the decoded combination, running-text length)."""
    k, n = len(m.subjects), len(texts)
    e = evidence(m.terms, m.subject, k, _terms(texts), sources)
    shape = (e.shape - m.mean) / m.scale
    paths, logp = np.zeros((n, 1, k)), np.zeros((n, 1))
    for i, s in enumerate(m.order):
        width = paths.shape[1]
        rows = np.repeat(np.arange(n), width)
        x = _link(e.take(rows), s, m.order, shape[rows], paths.reshape(n * width, k))
        a, b = m.calibration[i]
        z = np.clip(a * np.clip(x @ m.weights[i], -30, 30) + b, -30, 30).reshape(n, width)
        yes, no = -np.log1p(np.exp(-z)), -np.log1p(np.exp(z))
        lp = np.concatenate([logp + no, logp + yes], 1)
        grown = np.concatenate([paths, paths], 1)
        grown[:, width:, i] = 1
        pick = np.argsort(-lp, 1, kind="stable")[:, :beam]
        logp, paths = np.take_along_axis(lp, pick, 1), np.take_along_axis(grown, pick[:, :, None], 1)
    y = np.zeros((n, k), bool)
    if n:
        y[:, m.order] = paths[:, 0] > 0
    length = np.expm1(e.shape[:, 0])
    y[length < 1] = False
    return y, np.exp(logp[:, 0]), length


def _bounded(pages: DataFrame, max_pages: int, max_chars: int) -> DataFrame:
    """The pages of the smallest hash, at most so many and of so many characters (at least one)."""
    first = pages.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_pages)
    w = Window.orderBy(F.xxhash64("doc_id"), "doc_id")  # over at most max_pages rows
    size = F.sum(F.char_length("text")).over(w)
    return first.withColumns({"__size": size, "__at": F.row_number().over(w)}).where((F.col("__size") <= max_chars) | (F.col("__at") == 1)).drop("__size", "__at")


def train(documents: DataFrame, labels: DataFrame, areas: DataFrame, max_labelled: int = MAX_LABELLED, max_chars: int = MAX_CHARS) -> Model | None:
    """The model of a bounded sample of labelled and unlabelled pages, fitted on the driver."""
    subjects = [r.subject for r in areas.select("subject").where("subject is not null").distinct().orderBy("subject").collect()]
    known = {s.strip().lower(): i for i, s in enumerate(subjects)}
    norm = F.lower(F.trim("subject"))
    by_doc = labels.where(norm.isin(list(known))).groupBy("doc_id").agg(F.sort_array(F.collect_set(norm)).alias("ys"))
    pages = documents.select("doc_id", "text", "source").where("text is not null")
    rows = _bounded(pages.join(by_doc, "doc_id"), max_labelled, max_chars).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: r.doc_id)
    y = np.zeros((len(rows), len(subjects)))
    for i, r in enumerate(rows):
        y[i, [known[s] for s in r.ys]] = 1
    more = _bounded(pages.join(by_doc.select("doc_id"), "doc_id", "left_anti"), max_labelled, max_chars).collect()
    more.sort(key=lambda r: r.doc_id)
    return fit([r.text for r in rows], [r.source for r in rows], y, subjects, unlabelled=([r.text for r in more], [r.source for r in more]))


def classify(documents: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, subjects, probability, n_running): a row for each document."""
    share = documents.sparkSession.sparkContext.broadcast(model)

    def fn(ids, texts, sources):
        m = share.value
        if m is None:
            return {"doc_id": ids, "subjects": [[] for _ in ids], "probability": [None] * len(ids), "n_running": [0] * len(ids)}
        y, p, length = predict(m, texts, sources)
        return {"doc_id": ids, "subjects": [[m.subjects[s] for s in np.flatnonzero(row)] for row in y], "probability": p, "n_running": length.astype(np.int64)}

    return map_columns(documents.select("doc_id", "text", "source"), fn, "doc_id bigint, subjects array<string>, probability double, n_running bigint")


def subject_rows(classified: DataFrame) -> DataFrame:
    return classified.select("doc_id", F.explode("subjects").alias("subject"))


def composition(classified: DataFrame) -> DataFrame:
    """The corpus by subject: documents and running text, both also as shares of
    the whole; a document of two subjects gives half its text to each."""
    one = classified.select(F.explode(F.when(F.size("subjects") > 0, F.col("subjects")).otherwise(F.array(F.lit("(none)")))).alias("subject"), (F.col("n_running") / F.greatest(F.size("subjects"), F.lit(1))).alias("size"))
    total = classified.agg(F.count("*").alias("docs"), F.sum("n_running").alias("chars"))
    by = one.groupBy("subject").agg(F.count("*").alias("n_docs"), F.sum("size").alias("n_chars"))
    return by.join(F.broadcast(total)).select("subject", "n_docs", F.round("n_chars", 1).alias("n_chars"), F.round(F.col("n_docs") / F.col("docs"), 6).alias("doc_share"), F.round(F.try_divide("n_chars", "chars"), 6).alias("text_share"))
