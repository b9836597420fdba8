"""Whitening against numpy over all rows, with exact integers, repeated vectors and degenerate tables."""

from decimal import Decimal

import numpy as np
import pytest

from mnemo.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x int, digest string, n long, z int, rows int"


def frame(spark, vectors):
    """Rows of (id, vector) with extra columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, v, 1, "d", 2, 3, 4) for i, v in vectors], SCHEMA).repartition(3)


def gaussian(n, d, seed=3):
    r = np.random.default_rng(seed)
    return (r.normal(size=(n, d)) @ r.normal(size=(d, d)) * 0.1).astype(np.float32)


def brute(vectors, components=8, distinct=False):
    x = np.array([[int(np.floor(1024 * float(c))) + 100000 for c in v] for _, v in vectors], dtype=object)
    fit = np.array([list(t) for t in dict.fromkeys(map(tuple, x))], dtype=object) if distinct else x
    n, s = len(fit), fit.sum(0)
    c = (n * fit - s).astype(float) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    at = n * x - s
    z = (at.astype(float) / n) @ v[:, :components] / np.sqrt(e[:components])
    return n, [sum(int(a) ** 2 for a in row) for row in at], z, e[:components] / e.sum()


def compare(out, vectors, **kw):
    n, deviation, z, explained = brute(vectors, **kw)
    by = {}
    for r in out.collect():
        by.setdefault(r.id, {})[r.component] = r
    ids = [i for i, _ in vectors]
    k = z.shape[1]
    assert sorted(by) == sorted(set(ids)) and all(sorted(c) == list(range(1, k + 1)) for c in by.values())
    got = np.array([[by[i][j + 1].whitened for j in range(k)] for i in ids])
    sign = np.sign((got * z).sum(0))
    np.testing.assert_allclose(got * sign, z, rtol=1e-7, atol=1e-7)
    for i, d in zip(ids, deviation):
        assert all(r.n == n and r.deviation == Decimal(d) and r.identity_error < 1e-9 for r in by[i].values())
        np.testing.assert_allclose([by[i][j + 1].explained for j in range(k)], explained, rtol=1e-9)


def test_against_numpy(spark):
    vectors = [(k, v.tolist()) for k, v in enumerate(gaussian(400, 12))]
    vectors += [(1000 + k, vectors[5][1]) for k in range(300)]  # one vector of a large share of the rows
    compare(whitening.whitened(frame(spark, vectors)), vectors)
    compare(whitening.whitened(frame(spark, vectors), components=3, weights="one"), vectors, components=3, distinct=True)


def test_unusable_rows_are_dropped(spark):
    good = [(k, v.tolist()) for k, v in enumerate(gaussian(60, 4))]
    bad = [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0]), (103, [float("nan")] * 4), (104, [0.0, float("inf"), 0.0, 0.0]), (105, [1.0, 2.0]), (106, [0.1] * 5)]
    compare(whitening.whitened(frame(spark, good + bad)), good, components=4)


def test_repeated_and_null_ids(spark):
    v = [x.tolist() for x in gaussian(30, 3)]
    rows = [(k, x) for k, x in enumerate(v)] + [(0, v[1]), (0, v[1]), (None, v[2])]
    out = whitening.whitened(frame(spark, rows)).collect()
    assert len(out) == 3 * 33 and sum(r.id == 0 for r in out) == 9 and sum(r.id is None for r in out) == 3


def test_without_variance(spark):
    assert whitening.whitened(frame(spark, [])).count() == 0
    alone = whitening.whitened(frame(spark, [(1, [0.5, 0.25])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in alone] == [(1, 0, None, None, None)] * 2
    flat = whitening.whitened(frame(spark, [(k, [float(k % 7), 3.0]) for k in range(50)])).collect()
    assert {(r.component, r.whitened is None) for r in flat} == {(1, False), (2, True)}
    assert max(r.identity_error for r in flat) < 1e-9


def test_entries_beyond_64_bits(spark):
    rows = [(k, [float(v), 1e14 * (k % 5)]) for k, v in enumerate(range(40))]
    schema = "vec_id long, embedding array<double>"
    out = whitening.whitened(spark.createDataFrame(rows, schema)).collect()
    deviation = brute(rows, 1)[1]
    assert {(r.id, int(r.deviation)) for r in out} == set(enumerate(deviation)) and max(deviation) > 1 << 63
    far = whitening.whitened(spark.createDataFrame([(1, [1e300]), (2, [-1e300])], schema)).collect()
    assert [r.deviation for r in far] == [None, None] and all(abs(abs(r.whitened) - 1) < 1e-9 for r in far)


@pytest.mark.parametrize("big", [10, (1 << 52) - 1, 1 << 55])
def test_square_sums(big):
    d = np.array([[big, -big, 3], [0, 1, -big]], np.int64)
    assert whitening.square_sums(d) == [sum(int(v) ** 2 for v in row) for row in d]
