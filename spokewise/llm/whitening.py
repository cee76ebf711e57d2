"""Whitening of vectors over a compensated covariance.

Entries are whole numbers with a large common offset, so they are centred first, at the exact mean, each as a
double and the double of what that one leaves out. Outer products of the centred entries are formed with
error-free products, added with error-free sums, and kept as such pairs (high and low part) in every task and
between tasks; only the finished covariance is rounded. Its eigenvectors come from the symmetric solver that
reduces to a tridiagonal matrix and divides and conquers, sharpened once in extended precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stash

#: Vectors of which the outer products are formed at once, and rows of whitened output in a batch.
BLOCK, OUT = 256, 4096
#: Eigenvalues below this share of the largest one are rounding.
LEAST = 1e-13

Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """The sum, and exactly what rounding took from it."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def quick_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """The same where no ``|b|`` is above its ``|a|``."""
    s = a + b
    return s, b - (s - a)


def halves(a: np.ndarray) -> Pair:
    """Two parts of 26 bits, whose products are exact."""
    t = 134217729.0 * a
    high = t - (t - a)
    return high, a - high


def added(x: Pair, y: Pair) -> Pair:
    s, e = two_sum(x[0], y[0])
    return quick_sum(s, e + (x[1] + y[1]))


def total(x: Pair) -> Pair:
    """The sum over the last axis, by halves."""
    high, low = x
    while high.shape[-1] > 1:
        h = high.shape[-1] // 2
        odd = (high[..., 2 * h :], low[..., 2 * h :])
        high, low = added((high[..., :h], low[..., :h]), (high[..., h : 2 * h], low[..., h : 2 * h]))
        if odd[0].shape[-1]:
            high, low = np.concatenate([high, odd[0]], -1), np.concatenate([low, odd[1]], -1)
    return high[..., 0], low[..., 0]


def outer_sum(x: Pair) -> Pair:
    """``sum of c_i * c_j`` over the rows of ``c`` (rows, dimensions), for ``i <= j``, row after row of the triangle."""
    high, low = (np.ascontiguousarray(a.T) for a in x)
    left, right = halves(high)
    parts = []
    for i in range(len(high)):
        a, al, ar, b, bl, br = high[i], left[i], right[i], high[i:], left[i:], right[i:]
        p = a * b
        e = ((al * bl - p) + al * br + ar * bl) + ar * br
        parts.append(total(quick_sum(p, e + (a * low[i:] + low[i] * b))))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


@dataclass(frozen=True)
class Mean:
    """``n`` vectors with exact sums, per dimension ``n * quotient + rest``."""

    n: int
    quotient: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, n: int, sums: list[int]) -> Mean:
        q, r = zip(*(divmod(s, n) for s in sums))
        return cls(n, np.array(q, dtype=np.int64), np.array(r, dtype=np.int64))

    def centred(self, x: np.ndarray) -> Pair:
        """``x`` less the mean, as pairs."""
        f = self.rest / self.n
        # what f leaves out, from an exact product of f and n
        fl, fr = halves(f)
        nl, nr = halves(np.float64(self.n))
        p = f * self.n
        e = ((fl * nl - p) + fl * nr + fr * nl) + fr * nr
        g = ((self.rest - p) - e) / self.n
        s, e = two_sum((x - self.quotient).astype(np.float64), -f)
        return quick_sum(s, e - g)

    def deviations(self, x: np.ndarray) -> list[int]:
        """``sum of (n * x - sum)**2`` of each row, exact."""
        d = x - self.quotient
        if d.size and (int(np.abs(d).max()) + 1) * self.n < 2**31 / max(1, d.shape[1]) ** 0.5:
            return ((d * self.n - self.rest) ** 2).sum(1).tolist()
        wide = d.astype(object) * self.n - self.rest.astype(object)
        return (wide**2).sum(1).tolist()


@dataclass(frozen=True)
class Whitening:
    """Mean, components as columns already over the root of their eigenvalue, shares of the trace."""

    mean: Mean
    columns: np.ndarray
    explained: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        high, low = self.mean.centred(x)
        return high @ self.columns + low @ self.columns


def components(high: np.ndarray, low: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric matrix and their unit vectors (columns); rounding's are left out."""
    _, x = np.linalg.eigh(high)  # tridiagonal form, divide and conquer
    v, x = high.astype(np.longdouble) + low, x.astype(np.longdouble)
    # one step of refinement: errors of the vectors are solved to first order, equal eigenvalues apart
    r, s = np.eye(len(v)) - x.T @ x, x.T @ v @ x
    e = np.diag(s) / (1 - np.diag(r))
    gap = e[None, :] - e[:, None]
    near = np.abs(gap) <= 1e-9 * np.abs(e).max(initial=0)
    step = np.where(near, r / 2, (s + e[None, :] * r) / np.where(near, 1, gap))
    x = x + x @ step
    x /= np.sqrt((x * x).sum(0))
    e = np.einsum("ij,ij->j", x, v @ x)
    order = np.argsort(-e, kind="stable")[:most]
    order = order[e[order] > LEAST * e.max(initial=0)]
    e, x = e[order].astype(np.float64), x[:, order].astype(np.float64)
    # the entry of the largest size is positive, so that a sign never depends on the solver
    return e, x * np.where(x[np.abs(x).argmax(0), np.arange(len(e))] < 0, -1.0, 1.0) if len(e) else x


def matrix(triangle: np.ndarray, d: int) -> np.ndarray:
    out = np.zeros((d, d))
    out[np.triu_indices(d)] = triangle
    return np.triu(out) + np.triu(out, 1).T


def _blocks(batches: Iterator[pa.RecordBatch], d: int, most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for k in range(0, b.num_rows, most):
            part = b.slice(k, most)
            if part.num_rows:
                yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


PAIRS = "high array<double>, low array<double>"


def _row(x: Pair) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a.tolist()], pa.list_(pa.float64())) for a in x], ["high", "low"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own: Pair | None = None
    for b in batches:
        for k in range(b.num_rows):
            new = tuple(b.column(c)[k].values.to_numpy() for c in ("high", "low"))
            own = new if own is None else added(own, new)
    if own is not None:
        yield _row(own)


def pair_sum(fit: DataFrame, d: int, of: Callable[[np.ndarray], Pair]) -> Pair:
    """The sum of ``of(block)`` over all vectors: added in each task, then in about the root of their number, and
    the driver adds one row from each of these."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Pair | None = None
        for _, x in _blocks(batches, d, BLOCK):
            new = of(x)
            own = new if own is None else added(own, new)
        if own is not None:
            yield _row(own)

    tasks = max(1, int(int(fit.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    rows = fit.mapInArrow(summed, PAIRS).repartition(tasks).mapInArrow(_merged, PAIRS).collect()
    own = np.array(rows[0].high), np.array(rows[0].low)
    for r in rows[1:]:
        own = added(own, (np.array(r.high), np.array(r.low)))
    return own


def exact_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of vectors and the sum of each dimension; a task adds the upper and the lower digits apart."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, upper, lower = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for _, x in _blocks(batches, d, OUT):
            n, upper, lower = n + len(x), upper + (x >> 31).sum(0), lower + (x & (2**31 - 1)).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), *(pa.array([a.tolist()]) for a in (upper, lower))], ["n", "upper", "lower"])

    rows = fit.mapInArrow(summed, "n long, upper array<long>, lower array<long>").select("n", F.posexplode(F.arrays_zip("upper", "lower")).alias("k", "v"))
    of = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    got = rows.select("n", "k", "v.*").groupBy("k").agg(of("n"), of("upper"), of("lower")).orderBy("k").collect()
    return (int(got[0]["n"]) if got else 0), [int(r["upper"]) * 2**31 + int(r["lower"]) for r in got]


def whole(vector: str | Column, factor: int, offset: int) -> Column:
    """``floor(factor * c) + offset`` of every entry; null if any is null, not finite, or too large for a long."""
    v = (F.col(vector) if isinstance(vector, str) else vector).cast("array<double>")
    # a null entry is no true comparison, so it counts as a bad one
    good = F.forall(v, lambda c: F.coalesce((c * factor > -(2.0**61)) & (c * factor < 2.0**61), F.lit(False)))
    return F.when(good, F.transform(v, lambda c: F.floor(c * factor).cast("long") + F.lit(offset).cast("long")))


def fit_whitening(fit: DataFrame, d: int, most: int) -> Whitening | None:
    """The whitening of a table of different vectors ``x`` of ``d`` entries; None where it has none."""
    n, sums = exact_sums(fit, d)
    if not n:
        return None
    mean = Mean.of(n, sums)
    high, low = pair_sum(fit, d, lambda x: outer_sum(mean.centred(x)))
    # the division is done in extended precision, and what a double leaves out is kept
    v = (high.astype(np.longdouble) + low) / n
    high = v.astype(np.float64)
    high, low = matrix(high, d), matrix((v - high).astype(np.float64), d)
    e, x = components(high, low, most)
    return Whitening(mean, x / np.sqrt(e), e / np.trace(high) if len(e) else e)


def identity_error(fit: DataFrame, d: int, w: Whitening) -> float:
    """The largest entry, in size, of the covariance of whitened fit vectors less the identity."""
    n, k = w.mean.n, len(w.explained)
    if not k:
        return 0.0
    high, low = pair_sum(fit, d, lambda x: (lambda y: total((y, np.zeros_like(y))))(w(x).T))
    middle = (high + low) / n
    high, low = pair_sum(fit, d, lambda x: outer_sum(two_sum(w(x), -middle)))
    return float(np.abs(matrix((high + low) / n, k) - np.eye(k)).max())


WHITENED = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, most: int = 16, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = 64, offset: int = 1_000_000) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: each row's first components.

    Vectors count as ``x = floor(factor * c) + offset``. The mean and covariance are those of each different ``x``
    once (``n`` of them, divisor ``n``); component 1 has the largest eigenvalue. ``deviation``: the sum of
    ``(n * x - sum)**2``, exact (null beyond 38 digits). ``explained``: the eigenvalue's share of the trace.

    Rows whose vector is null, or has a null, non-finite or over-large entry, give none, nor do vectors that don't
    have the length that most have (at a tie the longer), nor empty ones. Repeated rows are each whitened, and fitted
    once; a null id stays. There are fewer components where the fitted vectors span fewer dimensions, and none where
    all are equal; an empty table gives no rows; other columns are not read.

    The different vectors are written once to the shared folder, after a map-side distinct; each pass over them
    gives one row from each task, and the driver holds a few matrices of the dimensions. Rows are whitened where they
    are read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), whole(vector_col, factor, offset).alias("x")).where("size(x) > 0")
    fit = stash(rows.select("x").distinct(), "vectors")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], WHITENED)
    d = lengths["d"]
    fit = fit.where(F.size("x") == d)
    w = fit_whitening(fit, d, most)
    error, k = identity_error(fit, d, w), len(w.explained)

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _blocks(batches, d, OUT):
            m = len(x)
            own = pa.array(np.repeat(np.arange(m), k))
            deviation = pa.array([str(v) for v in w.mean.deviations(x)], pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id").take(own), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), deviation.take(own), pa.array(w(x).ravel()), pa.array(np.tile(w.explained, m))],
                ["vec_id", "component", "deviation", "whitened", "explained"],
            )

    found = rows.where(F.size("x") == d).mapInArrow(whitened, "vec_id long, component int, deviation string, whitened double, explained double")
    return found.select("vec_id", "component", F.lit(w.mean.n).cast("long").alias("n"), F.col("deviation").try_cast("decimal(38,0)").alias("deviation"), "whitened", "explained", F.lit(error).alias("identity_error"))
