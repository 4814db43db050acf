import random

import numpy as np
import pyarrow as pa
import pytest
from made_texts import words_of

from srcatlas.llm.words import blocks, distinct, listed

TEXTS = [None, "", "  a b  c", "d", "\x0bé\x1fq  ", "x" * 50 + " a b c d e f g", "a b c", "   ", "日本 語 x y", "a b"]


@pytest.mark.parametrize("most", [1, 40, 1 << 20])
@pytest.mark.parametrize("cut", [slice(0, None), slice(3, 17)])
def test_words_and_windows_are_those_of_each_text(most, cut):
    texts = (TEXTS * 4)[cut]
    column = pa.array(TEXTS * 4)[cut]
    seen, hashes, windows = [], {}, {}
    for block in blocks(column, most):
        words = block.words()
        found = [words_of(block.text(i).decode()) for i in range(block.n)]
        assert [len(x) for x in found] == list(words.count)
        flat = [w for x in found for w in x]
        for word, value in zip(flat, words.hash, strict=True):
            assert hashes.setdefault(word, value) == value
        for k in (3, 9):
            at, made = words.windows(k)
            want = [(words.first[i] + j, (k, *x[j : j + k])) for i, x in enumerate(found) for j in range(len(x) - k + 1)]
            assert list(at) == [p for p, _ in want]
            for (_, key), value in zip(want, made, strict=True):
                assert windows.setdefault(key, value) == value
        seen += [block.text(i).decode() for i in range(block.n)]
    assert seen == [t or "" for t in texts]
    assert len(set(hashes.values())) == len(hashes) and len(set(windows.values())) == len(windows)


def test_distinct_values_of_each_text():
    rng = random.Random(3)
    doc = np.sort(np.array([rng.randrange(6) for _ in range(60)]))
    values = np.array([rng.randrange(5) for _ in range(60)])
    flat, counts = distinct(doc, values, 8)
    lists = listed(flat, counts, pa.int64()).to_pylist()
    assert lists == [sorted({int(v) for d, v in zip(doc, values, strict=True) if d == i}) for i in range(8)]
