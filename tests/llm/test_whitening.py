from fractions import Fraction

import numpy as np
import pytest

from srcatlas.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>"


def integers(vectors):
    return [[int(np.floor(float(np.float32(c)) * 64)) + 1_000_000 for c in v] for v in vectors]


def brute(vectors, k=32):
    """Covariances as fractions of integers, centred before multiplying."""
    x = np.array(integers(vectors), object)
    n, total = len(x), x.sum(axis=0)
    y = n * x - total
    exact = [[Fraction(int(v), n**3) for v in row] for row in y.T.dot(y)]
    value, vector = np.linalg.eigh(np.array(exact, float))
    value, vector = value[::-1][:k], vector[:, ::-1][:, :k]
    centred = np.array([[float(Fraction(int(v), n)) for v in row] for row in y])
    return [int(v) for v in (y * y).sum(axis=1)], centred @ vector / np.sqrt(value), value / float(sum(exact[i][i] for i in range(len(exact))))


def agrees(frame, vectors, ids):
    got = {r.vec_id: r for r in W.whitened(frame, "vec_id", "embedding").collect()}
    deviation, white, explained = brute(vectors)
    assert sorted(got) == sorted(ids)
    made = np.array([got[i].whitened for i in ids])
    sign = np.sign((made * white).sum(axis=0))
    assert np.allclose(made, white * sign, atol=1e-7)
    assert [int(got[i].deviation) for i in ids] == deviation
    for r in got.values():
        assert np.allclose(r.explained, explained, rtol=1e-9) and r.identity_error < 1e-9 and r.n == len(ids)


def test_embeddings_like_brute_force(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = frame.collect()
    agrees(frame, [r.embedding for r in rows], [r.vec_id for r in rows])


@pytest.mark.parametrize("scale", [1e-1, 3.0, 1e6, 1e12])
def test_sums_stay_exact_at_any_size(spark, scale):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(60, 3)) @ rng.normal(size=(3, 3)) * scale + scale).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], SCHEMA)
    agrees(frame, vectors.tolist(), list(range(60)))


def test_covariances_are_those_of_the_definition():
    rng = np.random.default_rng(5)
    x = rng.integers(-50, 50, (200, 5))
    total = x.sum(axis=0)
    middle = np.round(total / 200).astype(np.int64)
    out = W.covariance(200, [int(r) for r in total - 200 * middle], W.squares(x, middle).tolist())
    assert np.allclose(out, np.cov(x.T, bias=True), rtol=1e-13)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, 1.0]), (2, [1.5, -1.0]), (2, [1.5, -1.0]), (None, [0.25, 0.75])]
    bad = [(3, None), (4, []), (5, [None, 1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [-inf, 1.0]), (9, [1.0]), (10, [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame(good + bad, SCHEMA)
    more = frame.selectExpr("*", "1 as n", "vec_id as key", "embedding as vector", "2 as `a.b`")
    for rows in (frame, more):
        got = W.whitened(rows, "vec_id", "embedding").collect()
        assert sorted(map(repr, (r.vec_id for r in got))) == ["1", "2", "2", "None"]
        deviation, _, _ = brute([v for _, v in good])
        assert sorted(int(r.deviation) for r in got) == sorted(deviation)
    assert W.whitened(frame.limit(0), "vec_id", "embedding").collect() == []
    assert W.whitened(frame.filter("vec_id > 2 and vec_id < 9"), "vec_id", "embedding").collect() == []


def test_no_variance_has_no_scale(spark):
    (one,) = W.whitened(spark.createDataFrame([(1, [0.5, 1.0])], SCHEMA), "vec_id", "embedding").collect()
    assert one.whitened == [None, None] and one.explained == [0.0, 0.0] and one.identity_error is None and one.deviation == 0
    flat = spark.createDataFrame([(i, [float(i), 2.0]) for i in range(9)], SCHEMA)
    for r in W.whitened(flat, "vec_id", "embedding").collect():
        assert r.whitened[1] is None and r.whitened[0] is not None and r.identity_error < 1e-9
    wide = spark.createDataFrame([(i, [float((i * j) % 7) for j in range(40)]) for i in range(90)], SCHEMA)
    assert {len(r.whitened) for r in W.whitened(wide, "vec_id", "embedding").collect()} == {32}


def test_entries_beyond_64_bits_do_not_fail(spark):
    rows = spark.createDataFrame([(i, [3e38 * (-1) ** i, float(i)]) for i in range(5)], SCHEMA)
    got = W.whitened(rows, "vec_id", "embedding").collect()
    assert len(got) == 5 and all(r.identity_error < 1e-6 for r in got)
