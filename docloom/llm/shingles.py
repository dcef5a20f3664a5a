"""Word and shingle hashing for whole Arrow batches at once.

The texts of a batch are laid out as one array of code points; word bounds,
word hashes and shingle hashes are numpy passes over that array, so a text
costs nanoseconds a character and no Python object a word.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_M = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def word_chars() -> np.ndarray:
    """Code point -> is a letter or digit."""
    table = np.zeros(0x110000, bool)
    for c in [*range(0xD800), *range(0xE000, 0x32000)]:
        table[c] = chr(c).isalnum()
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finisher over uint64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_CHUNK = 1 << 17


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2^64."""
    p = 0xD6E8FEB86659FD93
    n = 2 * _CHUNK
    return np.cumprod(np.full(n, p, np.uint64)), np.cumprod(np.full(n, pow(p, -1, 1 << 64), np.uint64))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """A random value for each code point of the BMP."""
    return mix(np.arange(1 << 16, dtype=np.uint64) * _M + _M)


def _chunk_words(joined: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word: a polynomial of the word's letters, taken
    from running sums that overflow freely modulo 2^64."""
    cp = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    edge = np.flatnonzero(np.diff(word_chars()[cp].view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    a, b = edge[0::2], edge[1::2]
    table, (up, down) = _letters(), _powers()
    x = table[cp & 0xFFFF] if not len(cp) or cp.max() < 0x10000 else table[cp & 0xFFFF] + (cp >> 16).astype(np.uint64) * _M
    n = len(up)
    if len(cp) <= n:
        sums = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum(x * up[: len(cp)], out=sums[1:])
        h = (sums[b] - sums[a]) * down[a]
    else:  # one very long text: powers by place within the word's window
        x = x * up[np.arange(len(cp)) % n]
        sums = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum(x, out=sums[1:])
        h = (sums[b] - sums[a]) * down[a % n]
        for k in np.flatnonzero(a // n != (b - 1) // n):  # words across a window's edge
            c = cp[a[k] : b[k]]
            y = (table[c & 0xFFFF] + (c >> 16).astype(np.uint64) * _M) * np.resize(up, len(c))
            h[k] = (y.sum(dtype=np.uint64, keepdims=True) * down[:1])[0]
    return mix(h + (b - a).astype(np.uint64) * _M), a


def _chunks(texts: list[str]):
    """(first text, one past the last) of chunks that stay in the processor's cache."""
    at = size = 0
    for k, t in enumerate(texts):
        size += len(t) + 1
        if size > _CHUNK and k > at:
            yield at, k
            at, size = k, len(t) + 1
        if k - at >= 4096:
            yield at, k
            at, size = k, len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def chunked_words(texts: list[str]):
    """(first text, hash of each word, index of its text in the chunk), in order.

    Words are maximal runs of letters and digits; the caller lower-cases.
    """
    for i, j in _chunks(texts):
        own = texts[i:j]
        h, a = _chunk_words("\n".join(own))
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in own), np.int64, j - i))
        yield i, j, h, np.searchsorted(ends, a, side="right")


def runs(h: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of each run of ``n`` consecutive words of a text."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(h) - n + 1
    s = h[:m].copy()
    for k in range(1, n):
        s *= _M
        s ^= s >> np.uint64(29)
        s += h[k : m + k]
    whole = of[:m] == of[n - 1 :]
    return mix(s)[whole], of[:m][whole]


def distinct_sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 48-bit hashes of the runs of ``n`` words of each text, and
    the offsets (len(texts) + 1) of the texts. 48 bits: within a text of 10^4
    runs two of them fall together with a chance below 10^-6."""
    parts, at = [], [np.zeros(1, np.int64)]
    total = 0
    for i, j, h, of in chunked_words(texts):
        s, o = runs(h, of, n)
        key = (o.astype(np.uint64) << np.uint64(48)) | (s >> np.uint64(16))
        key.sort()
        if len(key):
            key = key[np.concatenate(([True], key[1:] != key[:-1]))]
        bounds = np.searchsorted(key >> np.uint64(48), np.arange(1, j - i + 1, dtype=np.uint64))
        at.append(bounds + total)
        total += len(key)
        parts.append(key & np.uint64((1 << 48) - 1))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.concatenate(at)
