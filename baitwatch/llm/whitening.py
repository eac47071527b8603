"""Whitening of embeddings by a bidiagonal qd solver.

Rows are centred and reduced to one triangular factor by blockwise QR: every task folds its
batches into one factor, and factors are folded in groups until one is left. What follows
depends on the number of dimensions only and happens on the driver: Householder reflections make the factor
bidiagonal, dqds finds its singular values, and twisted factorisations of the tridiagonal
product its right singular vectors. Values that lie close together are told apart on a
representation shifted next to them, where their relative gaps are large.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from baitwatch.llm.common import _arrow_schema, map_batches, table, written

COMPONENTS = 16
SCALE, OFFSET = 64, 1_000_000
#: States of tasks that are folded together.
FAN = 32
#: Entries beyond it count as if they were equal to it.
LIMIT = 2.0**53
EPS = 2.0**-52
#: Values closer than this part of their size are told apart by a shift.
GAP = 1e-3
_LONG = (1 << 63) - 1
_STATE = "part long, state binary"
SCHEMA = ("vec_id long, component int, n long, deviation long, whitened double, "
          "explained double, identity_error double")


def integer_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding",
                    scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """``vec_id, x`` of the rows whose vector is there and has finite entries only."""
    own = vectors[vector]
    entry = F.transform(own, lambda c: c.cast("double"))
    sound = own.isNotNull() & F.forall(
        entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.filter(sound).select(vectors[key].cast("long").alias("vec_id"),
                                        entry.alias("x"))

    def whole(c: Column) -> Column:
        bounded = F.least(F.greatest(c * float(scale), F.lit(-LIMIT)), F.lit(LIMIT))
        return F.floor(bounded) + F.lit(offset).cast("long")

    return rows.withColumn("x", F.transform("x", whole))


# Bidiagonal form, its singular values and vectors


def bidiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right factor of a square matrix by Householder reflections."""
    a, m = np.array(matrix, float), len(matrix)
    right = np.eye(m)

    def reflection(x: np.ndarray):
        size = np.linalg.norm(x)
        v = x.copy()
        v[0] += math.copysign(size, x[0])
        length = np.linalg.norm(v)
        return v / length if length else None

    for i in range(m):
        if (v := reflection(a[i:, i])) is not None:
            a[i:, i:] -= 2 * np.outer(v, v @ a[i:, i:])
        if i < m - 2 and (v := reflection(a[i, i + 1:])) is not None:
            a[i:, i + 1:] -= 2 * np.outer(a[i:, i + 1:] @ v, v)
            right[:, i + 1:] -= 2 * np.outer(right[:, i + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _dqds_step(q: list[float], e: list[float], shift: float):
    """One transform with a shift, or nothing where the shift exceeds the least value."""
    d = q[0] - shift
    if d < 0:
        return None
    next_q, next_e = [], []
    for i, own in enumerate(e):
        total = d + own
        if total <= 0:
            return None
        ratio = q[i + 1] / total
        next_q.append(total)
        next_e.append(own * ratio)
        d = d * ratio - shift
        if not d >= 0:
            return None
    return [*next_q, d], next_e


def dqds(diagonal, above) -> list[float]:
    """Squares of the singular values of an upper bidiagonal matrix, falling."""
    found, open_ = [], [([float(d) ** 2 for d in diagonal], [float(e) ** 2 for e in above], 0.0)]
    while open_:
        q, e, moved = open_.pop()
        while len(q) > 1:
            cut = next((i for i in range(len(e) - 1, -1, -1)
                        if e[i] <= EPS * EPS * (moved + min(q[i], q[i + 1]))), None)
            if cut is not None:
                open_.append((q[cut + 1:], e[cut + 1:], moved))
                q, e = q[:cut + 1], e[:cut]
                continue
            if 1.5 * q[0] < q[-1]:  # small values are found faster at the end
                q, e = q[::-1], e[::-1]
            # The least value of the last two by two of the product, seldom below the least of all.
            before = e[-2] if len(e) > 1 else 0.0
            one, other = q[-2] + before, q[-1] + e[-1]
            inner = q[-2] * q[-1] + before * q[-1] + before * e[-1]
            low = 2 * inner / (one + other + math.hypot(one - other, 2 * math.sqrt(q[-2] * e[-1])))
            for shift in (low * (1 - 1e-10), low * 0.9, low * 0.25, 0.0):
                after = _dqds_step(q, e, shift)
                if after is not None:
                    break
            q, e = after
            moved += shift
        found += [own + moved for own in q]
    return sorted(found, reverse=True)


class Product(NamedTuple):
    """A symmetric tridiagonal matrix as the product L D L^T: the diagonal of D, and below that
    of L."""

    d: list[float]
    l: list[float]  # noqa: E741


def _from_above(p: Product, value: float) -> tuple[list[float], list[float], list[float]]:
    """Stationary qd: pivots, multipliers and remainders of the product minus ``value``."""
    s, pivots, multipliers, rests = -value, [], [], [-value]
    for d, low in zip(p.d, p.l):
        pivot = (d + s) or EPS * EPS
        m = d * low / pivot
        s = m * low * s - value
        pivots.append(pivot)
        multipliers.append(m)
        rests.append(s)
    return [*pivots, (p.d[-1] + s) or EPS * EPS], multipliers, rests


def _from_below(p: Product, value: float) -> tuple[list[float], list[float]]:
    """Progressive qd: multipliers and remainders from the last row upwards."""
    r = p.d[-1] - value
    multipliers, rests = [], [r]
    for d, low in zip(reversed(p.d[:-1]), reversed(p.l)):
        pivot = (d * low * low + r) or EPS * EPS
        ratio = d / pivot
        r = r * ratio - value
        multipliers.append(low * ratio)
        rests.append(r)
    return multipliers[::-1], rests[::-1]


def _twisted(p: Product, value: float) -> tuple[np.ndarray, float]:
    """Unit vector of the twisted factorisation with the least twist element, and by how much
    its Rayleigh quotient differs from ``value``."""
    _, down, s = _from_above(p, value)
    up, r = _from_below(p, value)
    twist = [a + b + value for a, b in zip(s, r)]
    k = min(range(len(twist)), key=lambda i: abs(twist[i]))
    z = [0.0] * len(twist)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(k, len(z) - 1):
        z[i + 1] = -up[i] * z[i]
    vector = np.array(z)
    size = float(vector @ vector)
    return vector / math.sqrt(size), twist[k] / size


def _smaller(p: Product, value: float) -> int:
    """How many eigenvalues are below ``value``."""
    return sum(pivot < 0 for pivot in _from_above(p, value)[0])


def _bisected(p: Product, number: int, low: float, high: float) -> float:
    """Eigenvalue with ``number`` smaller ones, to its last bits."""
    width = high - low or EPS
    while _smaller(p, low) > number:
        low, width = low - width, 2 * width
    while _smaller(p, high) <= number:
        high, width = high + width, 2 * width
    while True:
        middle = (low + high) / 2
        if high - low <= 2 * EPS * max(abs(low), abs(high)) or middle in (low, high):
            return middle
        low, high = (low, middle) if _smaller(p, middle) > number else (middle, high)


def _vectors(p: Product, values: list[float], wanted: set[int], depth: int = 0):
    """``number, unit vector`` of the ``wanted`` of all ``values``, which fall."""
    start = 0
    for i in range(len(values)):
        near = i + 1 < len(values) and values[i] - values[i + 1] <= GAP * max(
            abs(values[i]), abs(values[i + 1]))
        if near:
            continue
        group = range(start, i + 1)
        start = i + 1
        if not wanted.intersection(group):
            continue
        if len(group) == 1 or depth > 8:
            for j in group:
                value = values[j]
                vector, off = _twisted(p, value)
                for _ in range(3):
                    if abs(off) <= EPS * abs(value):
                        break
                    value += off
                    vector, off = _twisted(p, value)
                yield j, vector
            continue
        top, end = values[group[0]], values[group[-1]]
        step = max(top - end, 4 * EPS * abs(top))
        options = []
        for shift in (end - step / 8, top + step / 8):
            pivots, multipliers, _ = _from_above(p, shift)
            options.append((max(map(abs, pivots)), shift, Product(pivots, multipliers)))
        _, shift, moved = min(options, key=lambda o: o[0])
        total = len(values)
        own = [_bisected(moved, total - 1 - j, end - shift - step / 4, top - shift + step / 4)
               if j in group else values[j] - shift for j in range(total)]
        yield from _vectors(moved, own, wanted.intersection(group), depth + 1)


def right_singular(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Squares of all singular values, falling, and unit right vectors of the first ``count``
    as columns. Values that rounding can't tell from zero are zero, and have no vector here."""
    diagonal, above, right = bidiagonal(matrix)
    size = len(diagonal)
    norm = float(max(np.abs(diagonal).max(initial=0), np.abs(above).max(initial=0)))
    if not norm:
        return np.zeros(size), np.zeros((size, 0))
    diagonal, above = diagonal / norm, above / norm
    diagonal = np.where(np.abs(diagonal) < EPS, EPS, diagonal)
    above = np.where(np.abs(above) < EPS, 0.0, above)
    parts = np.split(np.arange(size), np.flatnonzero(above == 0) + 1)
    found = [(value, at, j) for at, part in enumerate(parts) for j, value in
             enumerate(dqds(diagonal[part], above[part[:-1]]))]
    found.sort(key=lambda f: -f[0])
    squares = np.array([value for value, _, _ in found])
    squares[squares <= (4 * size * EPS) ** 2 * squares[0]] = 0
    count = min(count, int((squares > 0).sum()))
    vectors = np.zeros((size, count))
    for at, part in enumerate(parts):
        place = {j: i for i, (_, own, j) in enumerate(found[:count]) if own == at}
        values = sorted((value for value, own, _ in found if own == at), reverse=True)
        product = Product((diagonal[part] ** 2).tolist(),
                          (above[part[:-1]] / diagonal[part[:-1]]).tolist())
        for j, vector in _vectors(product, values, set(place)):
            vectors[part, place[j]] = vector
    return squares * norm * norm, right @ vectors


# States of tasks, folded in groups


def _folded(rows: DataFrame, columns: list[str], fold: Callable, merge: Callable) -> bytes | None:
    """One state of all rows: ``fold(state, batch)`` inside tasks, ``merge(states)`` between
    them, ``FAN`` at a time, each round written to the shared folder."""
    types, fan = _arrow_schema(_STATE), FAN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state = None
        for batch in batches:
            if batch.num_rows:
                state = fold(state, batch)
        if state is not None:
            yield pa.RecordBatch.from_pydict(
                {"part": [TaskContext.get().partitionId()], "state": [state]}, schema=types)

    def join(group: pa.Table) -> pa.Table:
        own = group.sort_by("part")
        return pa.Table.from_pydict({"part": [own["part"][0].as_py() // fan],
                                     "state": [merge(own["state"].to_pylist())]}, schema=types)

    states = written(rows.select(*columns).mapInArrow(run, _STATE), "states")
    while states.count() > 1:
        states = written(states.groupBy(F.floor(F.col("part") / fan).alias("together"))
                         .applyInArrow(join, _STATE), "states")
    found = states.first()
    return bytes(found["state"]) if found else None


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


class Fit(NamedTuple):
    """Size of the fit list, sums of its dimensions, and the whitening as a matrix by columns."""

    n: int
    sums: list[int]
    explained: list[float]
    matrix: np.ndarray

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """``n * x - sums``, exactly, as objects where longs would not hold its squares' sum."""
        sums, size = np.array(self.sums, object), float(np.abs(x).max(initial=0))
        if (2 * self.n * size) ** 2 * len(self.sums) < 2.0**62:
            return self.n * x - sums.astype(np.int64)
        return self.n * x.astype(object) - sums

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.offsets(x).astype(np.float64) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.matrix


def fit_whitening(distinct: DataFrame, dims: int, components: int = COMPONENTS) -> Fit:
    """The whitening of the vectors in ``distinct(x)``, each of ``dims`` entries."""

    def add(batch: pa.RecordBatch):
        x = _matrix(batch.column(0), dims)
        halves = ((x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0))
        yield {"place": list(range(dims)), "n": [len(x)] * dims,
               "high": halves[0], "low": halves[1]}

    sums = map_batches(distinct, ["x"], add, "place int, n long, high long, low long")
    sums = sums.groupBy("place").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
                                       for c in ("n", "high", "low"))).orderBy("place").collect()
    if not sums:
        return Fit(0, [], [], np.zeros((dims, 0)))
    n, totals = int(sums[0].n), [(int(r.high) << 32) + int(r.low) for r in sums]
    plain = Fit(n, totals, [], np.zeros((dims, 0)))

    def triangle(rows: np.ndarray) -> bytes:
        r = np.linalg.qr(np.concatenate([rows, np.zeros((max(0, dims - len(rows)), dims))]), "r")
        return r.tobytes()

    def reduce(state: bytes | None, batch: pa.RecordBatch) -> bytes:
        rows = plain.centred(_matrix(batch.column(0), dims))
        return triangle(rows if state is None else np.concatenate([_square(state, dims), rows]))

    def join(states: list[bytes]) -> bytes:
        return triangle(np.concatenate([_square(s, dims) for s in states]))

    squares, vectors = right_singular(
        _square(_folded(distinct, ["x"], reduce, join), dims), components)
    if not vectors.shape[1]:
        return plain
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    own = squares[:vectors.shape[1]]
    return Fit(n, totals, (own / squares.sum()).tolist(), vectors * signs / np.sqrt(own / n))


def _square(state: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(state).reshape(-1, dims)


def identity_error(distinct: DataFrame, fit: Fit) -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity.

    Tasks centre on means of their own, and means are merged with the covariances.
    """
    dims, k = fit.matrix.shape
    if not k:
        return None

    def merge(states: list[bytes]) -> bytes:
        n, mean, spread = 0.0, np.zeros(k), np.zeros((k, k))
        for state in states:
            own = np.frombuffer(state)
            size, off = own[0], own[1:k + 1] - mean
            spread = spread + own[k + 1:].reshape(k, k) + np.outer(off, off) * (
                n * size / (n + size))
            n += size
            mean = mean + off * (size / n)
        return np.concatenate([[n], mean, spread.ravel()]).tobytes()

    def fold(state: bytes | None, batch: pa.RecordBatch) -> bytes:
        w = fit.whitened(_matrix(batch.column(0), dims))
        mean = w.mean(0)
        off = w - mean
        own = np.concatenate([[len(w)], mean, (off.T @ off).ravel()]).tobytes()
        return own if state is None else merge([state, own])

    state = np.frombuffer(_folded(distinct, ["x"], fold, merge))
    return float(np.abs(state[k + 1:].reshape(k, k) / state[0] - np.eye(k)).max())


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding",
           components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each row and
    component, up to ``components`` and the number of dimensions.

    Entries become ``floor(scale * c) + offset``. Rows whose vector is null or holds null or
    non-finite entries are dropped; missing entries of shorter vectors count as zero, and
    entries beyond ``LIMIT`` as equal to it. A null id stays, repeated rows are all returned but
    fitted once, and other columns are ignored. A component without variance has no direction:
    ``whitened`` is null there and ``explained`` 0. A deviation that no long holds is null, and
    ``identity_error`` covers the components with variance. Without any row there is none.
    """
    rows = integer_vectors(vectors, key, vector, scale, offset)
    dims = rows.agg(F.max(F.size("x"))).first()[0] or 0
    zeros = F.array_repeat(F.lit(offset).cast("long"), F.lit(dims) - F.size("x"))
    rows = rows.select("vec_id", F.concat("x", zeros).alias("x"))
    if not dims:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    distinct = written(rows.select("x").distinct(), "fit_list")
    fit = fit_whitening(distinct, dims, components)
    error = identity_error(distinct, fit)
    count, known = min(components, dims), len(fit.explained)
    shares = np.array([*fit.explained, *[0.0] * (count - known)])

    def project(batch: pa.RecordBatch):
        x = _matrix(batch.column(1), dims)
        n, off = len(x), fit.offsets(x)
        squares = (off * off).sum(1).tolist()
        whitened = np.full((n, count), np.nan)
        whitened[:, :known] = (off.astype(np.float64) / fit.n) @ fit.matrix
        yield {
            "vec_id": batch.column(0).take(pa.array(np.repeat(np.arange(n), count))),
            "component": np.tile(np.arange(1, count + 1, dtype=np.int32), n),
            "n": np.full(n * count, fit.n),
            "deviation": pa.array([s if s <= _LONG else None for s in squares], pa.int64()).take(
                pa.array(np.repeat(np.arange(n), count))),
            "whitened": pa.array(whitened.ravel(), from_pandas=True),
            "explained": np.tile(shares, n),
            "identity_error": pa.array([error] * (n * count), pa.float64()),
        }

    return map_batches(rows, ["vec_id", "x"], project, SCHEMA)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
