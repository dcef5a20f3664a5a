import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import shingles as S

WORD = re.compile(r"[^\W_]+")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab1é_ \n中\U0001d400", max_size=30), max_size=6))
def test_words_and_runs(texts):
    seen, words = {}, 0
    for i, j, h, of in S.chunked_words(texts):
        want = [(k, w) for k, t in enumerate(texts[i:j]) for w in WORD.findall(t)]
        assert [k for k, _ in want] == of.tolist()
        for (_, w), x in zip(want, h.tolist()):
            assert seen.setdefault(w, x) == x
        words += len(want)
    assert len(set(seen.values())) == len(seen)
    h, at = S.distinct_sets(texts, 2)
    for k, t in enumerate(texts):
        w = WORD.findall(t)
        assert at[k + 1] - at[k] == len({tuple(w[n : n + 2]) for n in range(len(w) - 1)})


def test_long_text():
    t = " ".join(f"{'y' * (k % 37)}z{k}" for k in range(40_000))
    hashes = np.concatenate([h for _, _, h, _ in S.chunked_words([t, t[5:]])])
    assert len(set(hashes[:40_000].tolist())) == 40_000 and (hashes[:40_000][-100:] == hashes[-100:]).all()
