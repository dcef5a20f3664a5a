"""Problem 7: evaluation texts leaking into training text.

An inverted index holds the test items: for each term its items with BM25
weights, the lists cut into blocks of neighbouring items with their largest
weight. Each document is cut into training passages at the words that no item
has (they score nothing and end any shared run), and every passage that is long
enough is a query. WAND over the blocks skips items that cannot reach their
threshold; every item that reaches it is retrieved, there is no top k. The
threshold of an item is the least score of any run of ``min_words`` words of
its passage, so a passage that holds such a run always reaches it and nothing
is lost. Retrieved pairs are verified word by word, and the overlap of the
document with question and answer is reported.

The index is built from the test items, which are a stated, bounded set
(``max_items`` and ``max_chars``, checked); the corpus is only scanned, never shuffled.

Defined results: null or empty texts and passages match nothing; items that
share a passage all match; repeated rows give one row; case, punctuation, line
breaks and markup do not count.
"""

from __future__ import annotations

import math
import re
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.arrow import map_columns
from docloom.llm.shingles import chunked_words, mix
from docloom.llm.wikitext import visible

MIN_WORDS, MAX_ITEMS, MAX_CHARS = 12, 200_000, 20_000_000
_WORD = re.compile(r"[^\W_]+")
_K1, _B, _BLOCK = 1.2, 0.75, 16


def words(text: str | None) -> list[str]:
    return _WORD.findall(visible(text).lower()) if text else []


_POWERS = np.cumprod(np.full(4096, 0xD6E8FEB86659FD93, np.uint64))  # of the longest run


def _spread(w: np.ndarray) -> np.ndarray:
    return mix(w.astype(np.uint64) + np.uint64(1))


def _ranges(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The numbers of all ranges a..b, one after another."""
    n = b - a
    return np.repeat(b - np.cumsum(n), n) + np.arange(n.sum())


class Lists:
    """Many short lists of numbers in one array."""

    def __init__(self, lists: list[list], kind: type) -> None:
        self.at = np.cumsum([0, *map(len, lists)])
        self.values = np.fromiter((x for y in lists for x in y), kind, int(self.at[-1]))

    def __getitem__(self, k: int) -> np.ndarray:
        return self.values[self.at[k] : self.at[k + 1]]


class Index:
    """Block-max inverted index of the test items, in arrays: about 2 KB an item."""

    def __init__(self, items: list[tuple[int, str | None, str | None, str | None]], min_words: int = MIN_WORDS) -> None:
        self.min_words = min_words
        ids: dict[str, int] = {}
        number = lambda t: [ids.setdefault(x, len(ids)) for x in words(t)]
        rows = [(i, w) for i, p, _, _ in items if len(w := number(p)) >= min_words]
        n_passage = len(ids)  # terms of passages come first
        asked = {i: (sorted(set(number(q))), sorted(set(number(a)))) for i, _, q, a in items}
        h = np.concatenate([p[2] for p in chunked_words(list(ids))]) if ids else np.zeros(0, np.uint64)
        order = np.argsort(h)
        self.hashes, self.numbers, self.n_passage = h[order], order, n_passage
        # items in the order of their passages, so that blocks hold like items
        rows.sort(key=lambda r: (r[1], r[0]))
        self.ids = [r[0] for r in rows]
        self.question, self.answer = Lists([asked[r[0]][0] for r in rows], np.int32), Lists([asked[r[0]][1] for r in rows], np.int32)
        self.words = Lists([r[1] for r in rows], np.int32)
        self.runs = Lists([self._runs(np.array(r[1])) for r in rows], np.uint64)
        mean = sum(len(r[1]) for r in rows) / max(1, len(rows))
        df = np.bincount(np.concatenate([np.unique(r[1]) for r in rows]), minlength=n_passage) if rows else np.zeros(n_passage, int)
        n = len(rows)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        terms, owners, weights = [], [], []
        self.threshold = np.zeros(n)
        for k, (_, w) in enumerate(rows):
            t, where, c = np.unique(w, return_inverse=True, return_counts=True)
            x = idf[t] * c * (_K1 + 1) / (c + _K1 * (1 - _B + _B * len(w) / mean))
            terms.append(t)
            owners.append(np.full(len(t), k, np.int32))
            weights.append(x)
            # the least score of a run: each term once, where it occurs first in the run
            before = np.full(len(w), -1)
            seen: dict[int, int] = {}
            for j, v in enumerate(w):
                before[j] = seen.get(v, -1)
                seen[v] = j
            at = np.arange(len(w) - min_words + 1)[:, None] + np.arange(min_words)
            self.threshold[k] = np.where(before[at] < at[:, :1], x[where][at], 0).sum(1).min() - 1e-9
        term = np.concatenate(terms) if rows else np.zeros(0, np.int64)
        order = np.argsort(term, kind="stable")  # items stay in order within a term
        self.post_item = np.concatenate(owners)[order] if rows else np.zeros(0, np.int32)
        self.post_weight = np.concatenate(weights)[order] if rows else np.zeros(0)
        term = term[order]
        block = self.post_item // _BLOCK
        first = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])))) if len(term) else np.zeros(0, np.int64)
        self.block_at = np.append(first, len(term))  # of each block of each term: its postings
        self.block_no = block[first] if len(term) else block
        self.block_max = np.maximum.reduceat(self.post_weight, first) if len(term) else np.zeros(0)
        self.term_at = np.searchsorted(term[first] if len(term) else term, np.arange(n_passage + 1))  # of each term: its blocks
        self.upper = np.zeros(n_passage)
        if len(term):
            np.maximum.at(self.upper, term, self.post_weight)
        self.least = np.minimum.reduceat(self.threshold, np.arange(0, n, _BLOCK)) if n else np.zeros(0)
        self.floor = float(self.threshold.min()) if n else math.inf

    def retrieve(self, query: set[int]) -> list[int]:
        """All items whose score over the query's terms reaches their threshold."""
        terms = np.array(sorted(t for t in query if t < self.n_passage), np.int64)
        terms = terms[np.argsort(self.upper[terms], kind="stable")]
        # the terms below the pivot cannot carry any item to the floor by themselves
        pivot = int(np.searchsorted(np.cumsum(self.upper[terms]), self.floor))
        if pivot == len(terms):
            return []
        rest = float(self.upper[terms[:pivot]].sum())
        j = _ranges(self.term_at[terms[pivot:]], self.term_at[terms[pivot:] + 1])
        blocks, of = np.unique(self.block_no[j], return_inverse=True)
        high = np.bincount(of, weights=self.block_max[j], minlength=len(blocks))
        open_ = high + rest >= self.least[blocks]
        if not open_.any():
            return []
        # the low terms' own blocks instead of their largest weights
        found, at = [j[open_[of]]], blocks[open_]
        bound = high[open_]
        for t in terms[:pivot].tolist():
            lo, hi = self.term_at[t], self.term_at[t + 1]
            k = lo + np.searchsorted(self.block_no[lo:hi], at)
            ok = k < hi
            ok[ok] = self.block_no[k[ok]] == at[ok]
            bound[ok] += self.block_max[k[ok]]
            found.append(k[ok])
        live = at[bound >= self.least[at]]
        if not len(live):
            return []
        j = np.concatenate(found)
        j = j[np.isin(self.block_no[j], live)]
        i = _ranges(self.block_at[j], self.block_at[j + 1])
        items, of = np.unique(self.post_item[i], return_inverse=True)
        score = np.bincount(of, weights=self.post_weight[i])
        return items[score + 1e-9 >= self.threshold[items]].tolist()

    def _runs(self, w: np.ndarray) -> np.ndarray:
        """A hash of each run of ``min_words`` words."""
        v = np.lib.stride_tricks.sliding_window_view(_spread(w), self.min_words)
        return (v * _POWERS[: self.min_words]).sum(1, dtype=np.uint64)

    def _shared(self, w: np.ndarray, runs: np.ndarray, order: np.ndarray, k: int) -> set[int]:
        """Places of the item's runs that occur in the passage, compared word by word."""
        n, own = self.min_words, self.words[k]
        mine = self.runs[k]
        at = np.minimum(np.searchsorted(runs, mine, sorter=order), len(runs) - 1)
        hit = np.flatnonzero(runs[order[at]] == mine)
        return {int(i) for i in hit if (own[i : i + n] == w[order[at[i]] : order[at[i]] + n]).all()}

    def leaks(self, texts: list[str | None]) -> list[tuple[int, int, float, float, float]]:
        """(text, item, share of the passage's runs found, share of question and answer words found)."""
        n, out = self.min_words, []
        if not self.ids:
            return out
        for i, _, h, of in chunked_words([visible(t).lower() if t else "" for t in texts]):
            place = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            term = np.where(self.hashes[place] == h, self.numbers[place], -1)
            # passages: runs of the items' words within one text
            inside = (term >= 0) & (term < self.n_passage)
            run = np.cumsum(~inside) * np.int64(1 << 20) + of
            edge = np.flatnonzero(np.concatenate(([True], (run[1:] != run[:-1]) | ~inside[1:], [True])))
            long = np.flatnonzero(np.diff(edge) >= n)
            found: dict[tuple[int, int], set] = {}
            for a, b in zip(edge[long].tolist(), edge[long + 1].tolist()):
                w = term[a + (not inside[a]) : b]
                items = self.retrieve(set(w.tolist())) if len(w) >= n else ()
                if items:
                    runs = self._runs(w)
                    order = np.argsort(runs, kind="stable")
                    for k in items:
                        if hit := self._shared(w, runs, order, k):
                            found.setdefault((int(of[a]), k), set()).update(hit)
            for (d, k), hit in found.items():
                lo, hi = np.searchsorted(of, [d, d + 1])
                has = np.unique(term[lo:hi])
                share = lambda x: float(np.isin(x, has).mean()) if len(x) else 0.0
                out.append((i + d, self.ids[k], len(hit) / len(self.runs[k]), share(self.question[k]), share(self.answer[k])))
        return out


#: the index of the last run of this worker process, so that it is built once a worker and not once a task
_BUILT: dict[str, Index] = {}


def _index(key: str, items: list[tuple], min_words: int) -> Index:
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Index(items, min_words)
    return _BUILT[key]


def leaked_items(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, max_items: int = MAX_ITEMS, max_chars: int = MAX_CHARS) -> DataFrame:
    """(id, item_id, passage_share, question_share, answer_share) of each leak.

    Raises if there are more than ``max_items`` items or ``max_chars`` characters in
    them: run such a set in parts. The index takes up to some 20 bytes a character.
    """
    size = items.agg(F.sum(sum((F.coalesce(F.char_length(c), F.lit(0)) for c in ("passage", "question", "answer")), F.lit(0)))).first()[0] or 0
    if size > max_chars:
        raise ValueError(f"more than {max_chars} characters in the test items: split them and union the results")
    rows = items.select("item_id", "passage", "question", "answer").limit(max_items + 1).collect()
    if len(rows) > max_items:
        raise ValueError(f"more than {max_items} test items: split them and union the results")
    share = df.sparkSession.sparkContext.broadcast([tuple(r) for r in {r.item_id: r for r in rows}.values()])
    run = uuid.uuid4().hex

    def fn(ids, texts):
        got = [(ids[x[0]], *x[1:]) for x in _index(run, share.value, min_words).leaks(texts)]
        return dict(zip((id_col, "item_id", "passage_share", "question_share", "answer_share"), map(list, zip(*got) if got else [()] * 5)))

    kind = df.schema[id_col].dataType.simpleString()
    return map_columns(df.select(id_col, text_col).where(F.col(text_col).isNotNull()), fn, f"{id_col} {kind}, item_id bigint, passage_share double, question_share double, answer_share double")
