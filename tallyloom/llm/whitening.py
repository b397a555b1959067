"""Whitening of embeddings: leading principal components of an exactly centred covariance, scaled to unit variance.

Two passes over all usable vectors give exact sums and the centred covariance (partial
matrices a partition, summed row by row).  The driver sees that matrix alone, whose size is
bounded by ``MOST_DIMENSIONS``: it is brought to tridiagonal form by Householder
reflections, leading eigenvalues come from bisection on Sturm counts, eigenvectors from
inverse iteration with reorthogonalisation inside clusters.  Rows are then projected with
the broadcast components, and the covariance of what comes out is measured.

Defined results: null vectors and vectors with null or non-finite entries are dropped, and
so are vectors of another length than the most frequent one (ties: the longer); repeated
rows and ids each count; null ids stay; an empty table, or one whose vectors are all equal
or empty, gives no rows; components whose eigenvalue is below ``LEAST_SHARE`` of the first have no
whitened value and are left out; other columns are ignored.  Entries beyond what a long can
hold raise an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: The covariance is held by the driver.
MOST_DIMENSIONS = 4096
LEAST_SHARE = 1e-12
#: Rows that a task turns into a dense matrix at once, times dimensions.
CELLS = 1 << 20


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``key`` and ``x``, the integer vector, of the rows whose vector counts."""
    good = rows.select(F.col(key), F.col(vector).cast("array<double>").alias("_v")).filter(F.coalesce(whole(F.col("_v")), F.lit(False)))
    return good.select(key, F.transform("_v", lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))


def whole(v: Column) -> Column:
    """No entry is null, NaN or infinite."""
    return F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))


def _matrices(batches: Iterator[pa.RecordBatch], column: str, d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of bounded size with their vectors as a matrix."""
    step = max(1, CELLS // d)
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            yield part, part.column(part.schema.get_field_index(column)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums by dimension."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for _, x in _matrices(batches, "x", d):
            big = np.abs(x).max(initial=0) >= 1 << 40
            n, total = n + len(x), [a + int(b) for a, b in zip(total, (x.astype(object) if big else x).sum(0))]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(d)], pa.int32()), pa.array([n, *total], pa.decimal128(38, 0))], ["i", "s"])

    found = {r["i"]: int(r["s"]) for r in rows.select("x").mapInArrow(partial, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()}  # d + 1 rows
    return found.get(-1, 0), [found.get(i, 0) for i in range(d)]


def covariance(rows: DataFrame, column: str, d: int, centre: Callable[[np.ndarray], np.ndarray], n: int) -> np.ndarray:
    """Covariance (divisor ``n``) of a vector column; ``centre`` is applied to matrices before they are multiplied."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_row = np.zeros((d, d)), False
        for _, x in _matrices(batches, column, d):
            c = centre(x)
            total, any_row = total + c.T @ c, True
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    def added(part: pd.DataFrame) -> pd.DataFrame:  # one row of the matrix, from every partition
        return pd.DataFrame({"i": part["i"].iloc[:1], "row": [np.sum(np.stack(list(part.sort_values("p")["row"])), axis=0)]})

    partials = rows.select(column).mapInArrow(partial, "i int, row array<double>").withColumn("p", F.spark_partition_id())
    out = np.zeros((d, d))
    for r in partials.groupBy("i").applyInPandas(added, "i int, row array<double>").collect():  # d rows, d bounded
        out[r["i"]] = r["row"]
    return (out + out.T) / (2 * n)


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Diagonal and off-diagonal of a symmetric matrix after Householder reflections, and the reflections in order."""
    a, reflections = np.array(v, dtype=float), []
    for k in range(len(a) - 2):
        u = a[k + 1 :, k].copy()
        length = np.linalg.norm(u)
        if not length:
            reflections.append(None)
            continue
        edge = -np.copysign(length, u[0])
        u[0] -= edge
        u /= np.linalg.norm(u)
        rest = a[k + 1 :, k + 1 :]
        w = rest @ u
        p = 2 * (w - (u @ w) * u)
        rest -= np.outer(u, p) + np.outer(p, u)
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = edge
        reflections.append(u)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of a tridiagonal matrix are below each value of ``at``: negative pivots of its factors."""
    tiny = np.finfo(float).tiny * max(1.0, float(np.max(off**2, initial=0.0)))
    pivot, below = np.ones_like(at), np.zeros(len(at), dtype=int)
    for i, entry in enumerate(diagonal):
        pivot = entry - at - (off[i - 1] ** 2 / pivot if i else 0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        below += pivot < 0
    return below


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection."""
    d = len(diagonal)
    reach = np.abs(np.concatenate([off, [0]])) + np.abs(np.concatenate([[0], off]))
    low, high = np.full(k, np.min(diagonal - reach)), np.full(k, np.max(diagonal + reach))
    pad = np.finfo(float).eps * max(abs(low[0]), abs(high[0])) * d
    low, high = low - pad, high + pad
    rank = d - 1 - np.arange(k)  # eigenvalues that are smaller
    for _ in range(256):
        middle = (low + high) / 2
        if np.all((middle <= low) | (middle >= high)):
            break
        less = sturm_counts(diagonal, off, middle) <= rank
        low, high = np.where(less, middle, low), np.where(less, high, middle)
    return (low + high) / 2


def _solver(diagonal: np.ndarray, off: np.ndarray, shift: float) -> Callable[[np.ndarray], np.ndarray]:
    """Solves (T - shift) y = b by elimination with row exchanges; zero pivots become tiny ones."""
    d = len(diagonal)
    tiny = np.finfo(float).eps * max(float(np.max(np.abs(diagonal))), float(np.max(np.abs(off), initial=0.0)), np.finfo(float).tiny)
    main, upper, second = diagonal - shift, np.append(off, 0.0), np.zeros(d)
    steps = []
    for i in range(d - 1):
        low = off[i]
        if swap := abs(low) > abs(main[i]):
            main[i], low = low, main[i]
            upper[i], main[i + 1] = main[i + 1], upper[i]
            second[i], upper[i + 1] = upper[i + 1], second[i]
        if abs(main[i]) < tiny:
            main[i] = tiny
        factor = low / main[i]
        main[i + 1] -= factor * upper[i]
        upper[i + 1] -= factor * second[i]
        steps.append((swap, factor))
    if abs(main[-1]) < tiny:
        main[-1] = tiny

    def solve(b: np.ndarray) -> np.ndarray:
        y = b.copy()
        for i, (swap, factor) in enumerate(steps):
            if swap:
                y[i], y[i + 1] = y[i + 1], y[i]
            y[i + 1] -= factor * y[i]
        for i in range(d - 1, -1, -1):
            y[i] -= (upper[i] * y[i + 1] if i + 1 < d else 0) + (second[i] * y[i + 2] if i + 2 < d else 0)
            y[i] /= main[i]
        return y

    return solve


def vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Unit eigenvectors (columns) for falling ``values`` by inverse iteration; those of a cluster are kept orthogonal."""
    d, scale = len(diagonal), float(np.max(np.abs(diagonal)) + 2 * np.max(np.abs(off), initial=0.0)) or 1.0
    random, out, begin, shift = np.random.default_rng(1), np.zeros((d, len(values))), 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * scale:
            begin = j
        shift = min(value, shift - 10 * np.finfo(float).eps * scale)  # equal ones are set apart
        solve, y = _solver(diagonal, off, shift), random.standard_normal(d)
        for _ in range(rounds):
            y = solve(y / np.linalg.norm(y))
            y /= np.max(np.abs(y))
            for _ in range(2):
                y -= out[:, begin:j] @ (out[:, begin:j].T @ y)
        out[:, j] = y / np.linalg.norm(y)
    return out


def leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors (columns)."""
    scale = float(np.max(np.abs(v), initial=0.0))
    if not scale or not k:
        return np.zeros(0), np.zeros((len(v), 0))
    diagonal, off, reflections = tridiagonal(v / scale)
    values = leading_values(diagonal, off, k)
    found = vectors(diagonal, off, values)
    for i in range(len(reflections) - 1, -1, -1):
        if (u := reflections[i]) is not None:
            found[i + 1 :] -= 2 * np.outer(u, u @ found[i + 1 :])
    return values * scale, found / np.linalg.norm(found, axis=0)


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[int]:
    """Exact sums over dimensions of (n x - S)^2, as integers of any size."""
    bound = n * (int(np.abs(x).max(initial=0)) + max(map(abs, total), default=0) // n + 1)
    if bound < 1 << 52 and x.shape[1] < 1 << 10:  # halves of 26 bits: no sum leaves 63 bits
        d = n * x - np.array(total, dtype=np.int64)
        high, low = d >> 26, d & ((1 << 26) - 1)
        return [(int(a) << 52) + (int(b) << 27) + int(c) for a, b, c in zip((high * high).sum(1), (high * low).sum(1), (low * low).sum(1))]
    d = n * x.astype(object) - np.array(total, dtype=object)
    return [int(y) for y in (d * d).sum(1)]


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per usable row and component: key, ``component``, ``n``, ``deviation`` (decimal, exact), ``whitened``, ``explained``, ``identity_error``."""
    spark, kind = rows.sparkSession, rows.schema[key].dataType.simpleString()
    empty = spark.createDataFrame([], f"`{key}` {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double")
    good = keep(usable(rows, key, vector), "vectors")
    most = good.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if most is None or not most["d"]:
        return empty
    d = most["d"]
    if d > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {d} dimensions; at most {MOST_DIMENSIONS}")
    good = good.filter(F.size("x") == d)
    n, total = sums(good, d)
    floors, rests = np.array([s // n for s in total], dtype=np.int64), np.array([(s % n) / n for s in total])

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - floors).astype(float) - rests

    v = covariance(good, "x", d, centred, n)
    values, found = leading(v, min(components, d))
    k = int(np.sum(values > LEAST_SHARE * (values[0] if len(values) else 0)))
    if not k:
        return empty
    share = spark.sparkContext.broadcast((found[:, :k] / np.sqrt(values[:k]), total))

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, all_sums = share.value
        for part, x in _matrices(batches, "x", d):
            y = centred(x) @ matrix
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * k), pa.array(y.reshape(-1)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(deviations(x, n, all_sums), pa.decimal128(38, 0)), lists], [key, "deviation", "y"])

    white = keep(good.select(key, "x").mapInArrow(projected, f"`{key}` {kind}, deviation decimal(38,0), y array<double>"), "whitened")
    means = np.array(list(white.agg(*[F.avg(F.get("y", F.lit(i))).alias(f"m{i}") for i in range(k)]).first()))
    error = float(np.max(np.abs(covariance(white, "y", k, lambda y: y - means, n) - np.eye(k))))
    shares = F.array(*[F.lit(float(e)) for e in values[:k] / np.trace(v)])
    each = white.select(key, "deviation", F.posexplode("y").alias("_i", "whitened"))
    return each.select(key, (F.col("_i") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", F.get(shares, F.col("_i")).alias("explained"), F.lit(error).alias("identity_error"))
