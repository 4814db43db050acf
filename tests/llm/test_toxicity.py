import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from srcatlas.llm import toxicity as T


def slow_marginals(odds, move):
    """One token after another, in logarithms."""
    n = len(odds)
    weight = np.stack([np.zeros(n), odds], axis=1)
    ahead, back = np.zeros((n, 2)), np.zeros((n, 2))
    for t in range(n):
        before = ahead[t - 1] if t else np.zeros(2)
        ahead[t] = np.logaddexp(*(before[:, None] + move)) + weight[t]
    for t in range(n - 2, -1, -1):
        back[t] = np.logaddexp(*(move + weight[t + 1] + back[t + 1]).T)
    both = ahead + back + np.log(np.exp(move).sum(axis=1)) * (np.arange(n) == n - 1)[:, None] * 0
    return np.exp(both[:, 1] - np.logaddexp(*both.T))


def test_marginals_are_exact_across_pieces():
    rng = np.random.default_rng(1)
    # equal rows of moves: what follows the last token does not change it
    counts = np.array([0, 1, 63, 64, 65, 300, 0, 129])
    odds, move = rng.normal(size=counts.sum()) * 3, np.log(np.array([[0.7, 0.3], [0.4, 0.6]]))
    got, pairs = T.Chains(counts).run(odds, move)
    ends = np.cumsum(counts)
    for end, n in zip(ends, counts, strict=True):
        if n:
            assert np.allclose(got[end - n : end], slow_marginals(odds[end - n : end], move))
    assert np.isclose(pairs.sum(), (counts[counts > 0] - 1).sum())


def test_held_out_rows_are_told_by_checksum(spark):
    ids = list(range(200))
    rows = spark.createDataFrame([(i,) for i in ids] + [(None,)], "doc_id long").select("doc_id", T.held_out(F.col("doc_id")).alias("h"))
    for r in rows.collect():
        assert r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


@pytest.fixture(scope="module")
def larger(spark):
    d = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_held_out_accuracy(larger):
    documents, labels = larger
    rows = T.scored(documents, labels).join(labels, "doc_id").filter(T.held_out(F.col("doc_id"))).collect()
    toxic, other = (np.array([r.score for r in rows if r.toxic == k]) for k in (1, 0))
    ranks = (toxic[:, None] > other).mean() + 0.5 * (toxic[:, None] == other).mean()
    assert ranks > 0.93
    assert (toxic >= 0.7).mean() > 0.75 and (other >= 0.7).mean() < 0.01


def test_labels_of_held_out_rows_do_not_matter(documents, labels):
    flipped = labels.withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r.doc_id: r.score for r in T.scored(documents, labels).collect()}
    assert a == {r.doc_id: r.score for r in T.scored(documents, flipped).collect()}


def test_odd_rows_and_spans(table, larger):
    documents, labels = larger
    texts, toxic = T.sample(documents, labels)
    model = T.train(texts, toxic)
    block = T._block(["", "é you idiot, you MORON", "clean words here", "x" * 100_000])
    tokens = T.Tokens(block)
    spans = T._spans(block, tokens, model.marginals(tokens)).to_pylist()
    assert [(s["start"], s["end"]) for s in spans[1]] in ([(6, 11), (17, 22)], [(6, 22)])
    assert spans[0] == spans[2] == spans[3] == []
    rows = table([(None, "idiot moron scum"), (1, None), (2, ""), (3, "a b"), (3, "a b"), (4, "é " * 40_000)])
    known = labels.limit(0)
    assert {r.score for r in T.scored(rows, known).collect()} == {0.5}
    assert T.scored(rows.limit(0), labels).collect() == []


def test_equal_texts_get_equal_scores(documents, labels):
    same = documents.limit(3).union(documents.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    scores = [r.score for r in T.scored(documents.union(same), labels).join(same.select("doc_id").distinct(), "doc_id", "left_semi").collect()]
    assert all(0 <= s <= 1 for s in scores)
