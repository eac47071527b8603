"""Whitening and exact search over embeddings against plain numpy and integers."""

import math
from collections import Counter

import numpy as np
import pytest

from baitwatch.llm import topk_search as T
from baitwatch.llm import whitening as W

SF = "/root/testdata/sf0.001"
EMB = "vec_id long, embedding array<float>, label int, x array<long>, block int, n long, rank int"
BAD = [(900, None), (901, [1.0, None]), (902, [float("nan"), 1.0]), (903, [float("-inf"), 0.0])]


@pytest.fixture(scope="module")
def table(spark):
    def make(rows):
        return spark.createDataFrame([(k, v, 1, [1], 1, 1, 1) for k, v in rows], EMB)

    return make


def sound(rows):
    return [(k, [float(np.float32(c)) for c in v]) for k, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def check_whitening(df, rows, components=16):
    """Deviations as exact integers, the rest by an eigensolver; signs are free."""
    rows = sound(rows)
    dims = max(len(v) for _, v in rows)
    xs = [[math.floor(64 * c) + 1_000_000 for c in v] + [1_000_000] * (dims - len(v))
          for _, v in rows]
    fit = sorted(set(map(tuple, xs)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[n * c - s for c, s in zip(x, sums)] for x in fit], float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    got = df.collect()
    assert len(got) == len(rows) * min(dims, components)
    deviation = Counter((k, sum((n * c - s) ** 2 for c, s in zip(x, sums)))
                        for (k, _), x in zip(rows, xs))
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == deviation
    assert {r.n for r in got} == {n}
    kept = [j for j in range(min(dims, components)) if values[j] > 1e-9 * values[0]]
    own = {}
    for r in got:
        j = r.component - 1
        if j in kept:
            assert math.isclose(r.explained, values[j] / values.sum(), rel_tol=1e-9)
            assert r.identity_error < 1e-8
            own.setdefault(j, []).append(r.whitened)
        else:
            assert r.whitened is None and r.explained == 0
    for j in kept:
        gaps = np.abs(np.delete(values, j) - values[j])
        if gaps.min(initial=np.inf) > 1e-3 * values[j]:
            want = (np.array([[n * c - s for c, s in zip(x, sums)] for x in xs]) / n) @ vectors[
                :, j] / math.sqrt(values[j])
            assert np.allclose(sorted(np.abs(own[j])), sorted(np.abs(want)), atol=1e-8)
    return got


def test_whitening_of_the_whole_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    check_whitening(W.op11_whitening(spark, SF), [(r.vec_id, r.embedding) for r in df.collect()])


def test_whitening_of_odd_rows(spark, table):
    draw = np.random.default_rng(3)
    rows = [(i, [float(c) for c in draw.normal(size=3)] + [0.25, 0.0]) for i in range(40)]
    rows += rows[:5] + [(None, [9.0, 9.0, 9.0, 0.25, 0.0]), (50, [1.0]), (51, [])] + BAD
    rows += [(k, rows[7][1]) for k in range(100, 200)]
    check_whitening(W.whiten(table(rows)), rows)
    check_whitening(W.whiten(table(rows), components=2), rows, 2)


def test_whitening_without_variance_or_rows(table):
    got = W.whiten(table([(1, [1.0, 2.0]), (2, [1.0, 2.0])] + BAD)).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in got] == [
        (k, c, 1, 0, None, 0.0) for k in (1, 2) for c in (1, 2)]
    assert W.whiten(table(BAD)).collect() == [] == W.whiten(table(BAD[:0])).collect()
    assert W.whiten(table([(1, [])])).collect() == []


def test_whitening_of_huge_entries(table):
    got = W.whiten(table([(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 3.0])])).collect()
    assert len(got) == 6 and {r.deviation for r in got if r.vec_id != 3} == {None}


def test_fold_in_many_rounds(spark, monkeypatch):
    monkeypatch.setattr(W, "FAN", 2)
    draw = np.random.default_rng(8)
    x = draw.integers(-500, 500, (300, 6))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>").repartition(7)
    fit = W.fit_whitening(df, 6, 6)
    values = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert np.allclose(fit.explained, values / values.sum()) and W.identity_error(df, fit) < 1e-12


def orthogonal(n, seed):
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))[0]


@pytest.mark.parametrize("values", [
    [3.0] * 10 + [1.0] * 20, [3.0] * 5 + [3.0 + 1e-9] * 5 + [3.0 - 1e-12] * 5 + [0.0] * 3,
    [10.0**-i for i in range(12)], [1.0], [0.0, 0.0], list(range(1, 40))])
def test_singular_vectors(values):
    matrix = np.diag(values) @ orthogonal(len(values), 2)
    squares, vectors = W.right_singular(matrix, len(values))
    want = np.sort(values)[::-1]
    assert np.allclose(np.sqrt(squares), want, atol=1e-13 * want[0], rtol=0)
    assert vectors.shape[1] == (want > 0).sum()
    assert np.abs(vectors.T @ vectors - np.eye(vectors.shape[1])).max(initial=0) < 1e-11
    residual = matrix.T @ (matrix @ vectors) - vectors * squares[:vectors.shape[1]]
    assert np.abs(residual).max(initial=0) <= 1e-13 * want[0] ** 2


def test_values_that_agree_to_the_last_bits():
    """Wilkinson matrices joined by weak links: three and more values in a cluster each."""
    one = np.diag(np.abs(np.arange(-10.0, 11))) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    joined = np.kron(np.eye(3), one)
    for i in (20, 41):
        joined[i, i + 1] = joined[i + 1, i] = 1e-8
    matrix = np.linalg.cholesky(joined + 3 * np.eye(63)).T
    _, vectors = W.right_singular(matrix, 63)
    assert np.abs(vectors.T @ vectors - np.eye(63)).max() < 1e-11


def test_dqds_keeps_small_values_accurate():
    """A product of powers of two: the least value is far below the rounding of the largest."""
    d, e = [2.0 ** -i for i in range(0, 60, 3)], [2.0 ** (-i - 2) for i in range(0, 57, 3)]
    from fractions import Fraction

    det = Fraction(1)
    for v in d:
        det *= Fraction(v) ** 2
    found = Fraction(1)
    for v in W.dqds(d, e):
        found *= Fraction(v)
    assert abs(found / det - 1) < Fraction(1, 10**12)


def plain_nearest(rows, k=5, every=50):
    """Each row is told from its twins by its place."""
    xs = [(key, [math.floor(256 * c) for c in v]) for key, v in sound(rows)]
    found = Counter()
    for i, (query, q) in enumerate(xs):
        if query is not None and query % every == 0:
            scores = [(min(max(sum(a * b for a, b in zip(q, x)), -(1 << 63)), (1 << 63) - 1), key)
                      for j, (key, x) in enumerate(xs) if j != i]
            scores = sorted(scores, key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:k]
            found.update((query, rank, key, s) for rank, (s, key) in enumerate(scores, 1))
    return found


def check_nearest(df, rows, k=5):
    assert Counter(tuple(r) for r in df.collect()) == plain_nearest(rows, k)


def test_search_of_the_whole_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    check_nearest(T.op12_topk(spark, SF), [(r.vec_id, r.embedding) for r in df.collect()])


def test_search_of_odd_rows(table):
    """Ties, twins, a vector that most rows hold, no ids, other lengths and large entries."""
    draw = np.random.default_rng(4)
    rows = [(i, [float(c) for c in draw.normal(size=4)]) for i in range(200)]
    rows += [(i, rows[50][1]) for i in range(200, 400)] + rows[50:52] + [(450, [])] + BAD
    rows += [(None, rows[100][1]), (500, [0.0] * 4), (550, [1.0, 2.0]), (600, [-0.001] * 4)]
    asks = T.F.col("vec_id") % 50 == 0
    for block in (16, 4096):
        check_nearest(T.nearest(table(rows), asks, block=block), rows)
    check_nearest(T.nearest(table(rows), asks, k=1, block=32), rows, 1)
    for size in (10.0**6, 10.0**14):  # sums that floats round, and scores outside a long
        huge = [(i, [float(c) * size for c in draw.normal(size=3)]) for i in range(60)]
        check_nearest(T.nearest(table(huge), asks, block=16), huge)
    for few in (rows[:1], rows[:3], BAD, []):
        check_nearest(T.nearest(table(few), asks), few)


def test_search_stops_early():
    """Vectors around the query lead all lists, so most entries are never read."""
    draw = np.random.default_rng(9)
    x = draw.integers(-50, 50, (2_000, 8))
    x[:5] = 200
    lists = T.SortedLists(x, np.arange(2_000), np.arange(2_000))
    looked = []
    resolved = lists._resolved
    lists._resolved = lambda q, w, alive, k: (looked.append(int(alive.sum())), resolved(q, w, alive, k))[1]
    found = list(lists.search(np.full((1, 8), 7), np.array([-1]), np.array([-np.inf]),
                              np.array([T._NO_ID]), 5))
    assert [(p, s) for _, p, s in found] == [(i, 200 * 7 * 8) for i in range(5)]
    assert looked[0] <= 5 + T.RESOLVE
