import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from srcatlas.llm import langid as L
from srcatlas.llm.words import blocks


def block_of(texts):
    (made,) = blocks(pa.array(texts, pa.large_string()), 1 << 60)
    return made


def brute_grams(text):
    """n-grams as strings; a gap is a blank."""
    spaced = " " + re.sub(r"[\W\d_]+", " ", text or "").strip().lower() + " "
    out = []
    for k in L.SIZES:
        for i in range(len(spaced) - k + 1):
            gram = spaced[i : i + k]
            if gram.strip() and " " not in gram[1:-1]:
                out.append(gram)
    return out


TEXTS = ["Über den Wolken, wo's 3 Éc_oles gibt", "", "a", None, "日本 語 x", "12 !", "aa aa aa", "no\nline  breaks\t.", "I x"]


def test_grams_are_those_of_a_plain_loop():
    grams = L.Grams(block_of(TEXTS))
    names = {}
    for i, text in enumerate(TEXTS):
        own = Counter(grams.value[grams.doc == i].tolist())
        want = brute_grams(text)
        assert sorted(own.values()) == sorted(Counter(want).values()), text
        alone = L.Grams(block_of([text]))
        assert Counter(alone.value.tolist()) == own
        names.setdefault(i, own)
    assert grams.lettered.tolist() == [any(c.isalpha() for c in t or "") for t in TEXTS]


@pytest.fixture(scope="module")
def filters(spark):
    return L.learned(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_filters_hold_what_was_counted(spark, filters):
    # every n-gram that the rule puts into a language, by plain Python over the texts
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    texts = {lang: list({r.text for r in rows if r.lang == lang}) for lang in filters.languages}
    share = {}
    for k, lang in enumerate(filters.languages):
        for text in texts[lang]:
            for value in set(L.Grams(block_of([text])).value.tolist()):
                share.setdefault(value, np.zeros(len(filters.languages)))[k] += 1
    n_texts = np.array([len(texts[lang]) for lang in filters.languages])
    values = np.array(list(share), np.uint64)
    n = np.array(list(share.values()))
    ratio = n / n_texts
    enough = (n >= 2) & (ratio >= L.SUPPORT)
    most = np.where(enough, ratio, 0).max(axis=1, keepdims=True)
    want = enough & (ratio * L.RATIO >= most)
    got = np.unpackbits(filters.masks(values), axis=1, bitorder="little")[:, : len(filters.languages)].astype(bool)
    assert got[want].all()
    wrong = got[~want].mean()
    assert wrong < 3 * filters.false_positive.max() + 1e-3


def test_false_positives_are_as_predicted():
    rng = np.random.default_rng(4)
    slots = 1 << 12
    table = np.zeros((slots, 2), np.uint8)
    held = rng.integers(0, 1 << 63, (10, 600), dtype=np.uint64)
    for k, values in enumerate(held):
        for at in L.places(values, slots):
            table[at, k // 8] |= 1 << (k % 8)
    made = L.Filters(table, [str(k) for k in range(10)])
    for k, values in enumerate(held):
        assert (made.masks(values)[:, k // 8] >> (k % 8) & 1).all()
    others = rng.integers(0, 1 << 63, 200_000, dtype=np.uint64)
    bits = np.unpackbits(made.masks(others), axis=1, bitorder="little")[:, :10]
    assert np.allclose(bits.mean(axis=0), made.false_positive, rtol=0.1)


def test_decisions_like_brute_force(spark, filters):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(80).collect()
    texts = [r.text for r in rows] + TEXTS
    place, score, n = filters.decide(L.Grams(block_of(texts)))
    wrong = [f**L.HASHES for f in filters.fill]
    for i, text in enumerate(texts):
        values = L.Grams(block_of([text])).value
        masks = [int(m) for m in filters.masks(values)[:, 0]] if len(values) else []
        right = [max(0.0, (sum(m >> k & 1 for m in masks) - w * len(masks)) / (1 - w)) for k, w in enumerate(wrong)]
        first, second = sorted(right)[::-1][:2]
        if not any(c.isalpha() for c in text or ""):
            assert (place[i], score[i]) == (-1, 0)
        else:
            assert place[i] == right.index(first) and np.isclose(score[i], first / (first + second) if first else 0)
        assert n[i] == len(masks)


def test_held_out_accuracy(spark):
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = L.identified(documents).join(documents.select("doc_id", "lang"), "doc_id").filter(L.held_out(F.col("doc_id")))
    right, score = rows.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg("score")).first()
    assert right > 0.985 and 0.5 < score <= 1


def test_languages_of_held_out_rows_do_not_matter(documents):
    changed = documents.withColumn("lang", F.when(L.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("y"))
    key = lambda rows: sorted(map(tuple, L.identified(rows).collect()))
    assert key(documents) == key(changed)


def test_odd_rows(table, documents):
    odd = [(None, "the of and that is by", None, None, 1), (-1, None, None, None, 0), (-2, "", "en", None, 0), (-3, "12 !?", "en", "s", 0), (-4, "日本語", None, "s", 0), (-5, "that it is of the and " * 20_000, "fr", "s", 0), (-6, "que la de los", "es", "s", 0), (-6, "que la de los", "es", "s", 0)]
    rows = table(odd).union(documents.select("doc_id", "text", "lang", "source", "n_chars"))
    more = rows.selectExpr("*", "1 as score", "'x' as lang_pred", "2 as language", "3 as `a.b`")
    got = {}
    for r in L.identified(more).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [r.lang_pred for i in (None, -5, -6) for r in got[i]] == ["en", "en", "es", "es"]
    assert all(got[i][0].lang_pred == "und" and got[i][0].score == 0 for i in (-1, -2, -3))
    assert got[-4][0].lang_pred == "en" and got[-4][0].score == 0
    assert L.identified(table([])).collect() == []
    assert [(r.lang_pred, r.score) for r in L.identified(table([(1, "a b", None, "s", 3)])).collect()] == [("und", 0.0)]


def test_many_languages(table):
    # more than a byte of them, and more copies of one text than of all others
    words = [f"{a}{b}{a}" for a in "bcdfghjkl" for b in "aeo"]
    rows = [(i, " ".join(words[i % 27] for _ in range(5 + i // 27 % 3)), f"l{i % 27}", "s", 1) for i in range(540)]
    rows += [(1000 + i, "zzyzx zzyzx", "l3", "s", 1) for i in range(500)]
    got = L.identified(table(rows)).collect()
    assert all(r.lang_pred == f"l{r.doc_id % 27}" for r in got if r.doc_id < 540)
