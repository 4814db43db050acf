import hashlib
import re

import pytest
from made_texts import prose
from pyspark.sql import functions as F

from srcatlas.llm import spotsigs as S

COMMON = set(S._common())


def slow_signatures(text):
    """Named signatures, by a loop over words."""
    words = [w for w in re.split(r"\s+", re.sub(r"[^\w\s]|_", "", text.lower())) if w]
    out = set()
    for i, w in enumerate(words):
        chain = [x for x in words[i:] if x not in COMMON][: S.CHAIN]
        if w in COMMON and len(chain) == S.CHAIN:
            out.add((w, *chain))
    return out or {(w, n) for w, n in zip(words, [*words[1:], ""], strict=False)}


TEXTS = ["The cat sat on the mat, and the dog ran.", "no anchors anywhere here", "", "the", "a the of", "Le chat de la maison est ici", "word", " \n"]


def test_signatures_like_a_loop(spark, documents):
    texts = TEXTS + [r.text for r in documents.limit(60).collect()]
    hashed = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.s for r in hashed.select("i", S.signatures(F.col("t")).alias("s")).collect()}
    named = [(i, *s) for i, t in enumerate(texts) for s in slow_signatures(t)]
    rows = spark.createDataFrame([(n[0], n[1], n[2], n[3] if len(n) == 4 else None) for n in named], "i int, a string, b string, c string")
    two, three = F.hash("a", "b"), F.hash("a", "b", "c")
    want = {}
    for r in rows.select("i", F.when(F.col("c").isNull(), two).otherwise(three).alias("h")).collect():
        want.setdefault(r.i, set()).add(r.h)
    for i in range(len(texts)):
        assert got[i] == sorted(want.get(i, set()))


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(t) // 4
        out.append((i, len(t), hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in S.edited_likeness(df).collect()), key=repr)


def test_edited_texts(documents, monkeypatch):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert result(documents) == expected(rows)
    monkeypatch.setattr(S, "BUCKET_ROWS", 1)
    assert result(documents) == expected(rows)


def test_likeness_of_documents(documents):
    rows = S.edited_likeness(documents).collect()
    assert sorted(r.near_edited for r in rows)[len(rows) // 2] > 0.5
    assert sum(r.near_next for r in rows) / len(rows) < 0.05
    texts = {r.doc_id: r.text for r in documents.collect()}
    prints = {}
    for r in rows:
        assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
        a, b = set(r.fingerprint.split()), set(r.edited_fingerprint.split())
        assert r.near_edited == (len(a & b) / len(a | b) if a | b else 1.0)


def test_odd_rows(table):
    rows = [(None, "a"), (None, None), (7, ""), (7, "the cat sat down"), (7, "the cat sat down"), (9, prose(30_000)), (10**15, "é😀" * 9), (-4, "of")]
    assert result(table(rows)) == expected(rows)
    assert S.edited_likeness(table([])).collect() == []
    (one,) = S.edited_likeness(table([(3, "the quick brown fox")])).collect()
    assert one.near_next == 1.0
    empty = S.edited_likeness(table([(1, ""), (2, "the cat sat")])).collect()
    assert {r.doc_id: (r.near_edited, r.near_next) for r in empty}[1] == (1.0, 0.0)


@pytest.mark.parametrize("like", [0.5, 0.75])
def test_pairs_like_brute_force(spark, documents, like):
    rows = documents.select("doc_id", S.signatures(F.col("text")).alias("signature")).cache()
    # close ones too: each document again without its last signatures
    near = rows.select((F.col("doc_id") + 10_000).alias("doc_id"), F.expr("slice(signature, 1, cast(size(signature) * 0.8 as int))").alias("signature"))
    rows = rows.union(near)
    sets = {r.doc_id: frozenset(r.signature) for r in rows.collect()}
    members, pairs = S.near_pairs(rows, like)
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    assert {r.doc_id: r.class_id for r in members.collect()} == {i: first[s] for i, s in sets.items()}
    classes = sorted((i, s) for s, i in first.items() if s)
    want = {
        frozenset((a, b))
        for k, (a, x) in enumerate(classes)
        for b, y in classes[:k]
        if len(x & y) >= like * len(x | y)
    }
    assert {frozenset((r.a, r.b)) for r in pairs.collect()} == want and want


def slow_classes(sets, like):
    """The smallest id that links lead to, for a dict of sets by id."""
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x == y or (x and y and len(x & y) >= like * len(x | y)):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in ids}


def chained(n):
    """Texts that share words with the next ones: chains of near copies, and some that only share a passage."""
    words = prose(400).split()
    shift = [" ".join(words[k : k + 200]) for k in range(0, 60, 4)]
    shared = " ".join(words[200:260])
    other = [f"{shared} {' '.join(f'the w{k}x{j} of z{k}y{j}' for j in range(40))}" for k in range(n)]
    return shift + other


@pytest.mark.parametrize("like", [0.5, 0.75])
def test_classes_like_brute_force(table, documents, like, monkeypatch):
    texts = [r.text or "" for r in documents.collect()]
    texts += [t[: int(len(t) * 0.9)] for t in texts] + [t + " the end of it all" for t in texts] + chained(30) + ["", "", " "]
    df = table(list(enumerate(texts)))
    sets = {r.doc_id: frozenset(r.s) for r in df.select("doc_id", S.signatures(F.col("text")).alias("s")).collect()}
    want = slow_classes(sets, like)
    assert len(set(want.values())) < len(set(sets.values()))
    assert {r.doc_id: r.near_class for r in S.near_classes(df, like).collect()} == want
    monkeypatch.setattr(S, "COUNTERS", 2)  # another order, the same classes
    assert {r.doc_id: r.near_class for r in S.near_classes(df, like).collect()} == want


def test_class_of_each_row(table):
    text = prose(300)
    rows = [(5, text), (2, text + " of the end"), (2, "nothing like it at all"), (None, text), (9, text), (9, text), (7, ""), (8, None), (4, prose(80)[::-1])]
    got = sorted((r.doc_id, r.near_class) for r in S.near_classes(table(rows)).collect())
    # one row for each distinct document; those without an id are in no class
    assert got == [(2, 2), (2, 2), (4, 4), (5, 2), (7, 7), (8, 7), (9, 2)]
    assert S.near_classes(table([])).collect() == []
