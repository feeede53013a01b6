"""Whitening of embeddings: centred scatter added up by tasks, its eigenvectors by cyclic Jacobi rotations on the driver.

The driver holds a matrix of dimension by dimension and nothing that grows with the rows.

Rows whose vector is null or holds null or non-finite entries are dropped.  Entries beyond what a long holds are cut to its
range, as casts do.  Shorter vectors are read with zeros behind up to the longest one's dimension.  Repeated rows are given out
each, and fitted once.  A component without variance (fewer distinct vectors than dimensions, or a constant one) has a null
whitened and counts for nothing in identity_error; a deviation that no long holds is null.  Empty tables give empty tables,
other columns of any name are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolex.llm.common import stored

SCALE, COMPONENTS, MAX_SWEEPS = 256.0, 4, 60
LONG = 2**63 - 1
#: Sums of entries below this, over a batch, are exact in longs, and squares of n * x - S below SQUARES in doubles' range of longs.
SMALL, SQUARES = 2**40, 4e18
#: Rows that are taken into one product of matrices.
BLOCK = 4096


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, x array<long>: floor(256 * c) of the entries c, of the rows that have a vector of finite entries only."""
    c = F.transform("embedding", lambda e: e.cast("double"))
    whole = F.col("embedding").isNotNull() & F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    return vectors.where(F.coalesce(whole, F.lit(False))).select("vec_id", F.transform(c, lambda e: F.floor(e * SCALE)).alias("x"))


def _matrix(column, d: int) -> np.ndarray:
    """A list column of longs as rows of d entries."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    if len(column) and (np.diff(offsets) == d).all():
        return flat[offsets[0] : offsets[-1]].reshape(-1, d)
    out = np.zeros((len(column), d), np.int64)
    for row, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        out[row, : b - a] = flat[a:b]
    return out


def _exact_sums(x: np.ndarray) -> list[int]:
    if x.size and max(int(x.max()), -int(x.min())) >= SMALL:
        return x.astype(object).sum(axis=0).tolist()
    return x.sum(axis=0).tolist()


def sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """The rows' number and the exact sum of each dimension: a row of the latter for each task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            n, total = n + len(x), [a + b for a, b in zip(total, _exact_sums(x), strict=True)]
        if n:
            yield pa.record_batch({"i": pa.array(range(-1, d), pa.int32()), "s": pa.array([Decimal(n), *map(Decimal, total)], pa.decimal128(38, 0))})

    rows = fit.mapInArrow(add, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()
    found = {r["i"]: int(r["s"]) for r in rows}
    return found.pop(-1, 0), [found.get(i, 0) for i in range(d)]


def _centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """x - S / n: the difference n * x - S is exact before it is divided."""
    if x.size and n * max(int(x.max()), -int(x.min()), max(map(abs, total)) // n + 1) < LONG // 2:
        return (n * x - np.array(total, np.int64)) / n
    return ((n * x.astype(object) - np.array(total, object)) / n).astype(float) if x.size else x.astype(float)


def _scatter(rows: DataFrame, d: int, of) -> np.ndarray:
    """The sum of z z' over the rows z = of(x) of all batches, divided by nothing: tasks send a line of the matrix a row, added up in Spark."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = None
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            for a in range(0, len(x), BLOCK):
                z = of(x[a : a + BLOCK])
                m = z.T @ z if m is None else m + z.T @ z
        if m is not None:
            upper = [m[i, i:] for i in range(len(m))]
            yield pa.record_batch({"i": pa.array(range(len(m)), pa.int32()), "v": pa.array(upper, pa.list_(pa.float64()))})

    lines = rows.mapInArrow(products, "i int, v array<double>").select("i", F.posexplode("v").alias("k", "v"))
    found = lines.groupBy("i", "k").agg(F.sum("v").alias("v")).groupBy("i").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("line")).select("i", F.col("line.v").alias("line")).collect()
    m = np.zeros((len(found), len(found)))
    for r in found:
        m[r["i"], r["i"] :] = r["line"]
    return np.triu(m) + np.triu(m, 1).T


def jacobi(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and their unit vectors as columns.

    A sweep turns every pair of dimensions once, in the rounds of a tournament: the pairs of a round share no dimension, so
    their rotations are done together.  It ends when every entry off the diagonal is below rounding of the two on it, by
    which small eigenvalues keep their digits too.
    """
    a, d = np.array(a, float), len(a)
    vectors, m = np.eye(d), d + d % 2
    eps, order = np.finfo(float).eps, np.arange(m)
    for _ in range(MAX_SWEEPS):
        turned = False
        for _ in range(m - 1):
            p, q = np.minimum(order[: m // 2], order[m // 2 :][::-1]), np.maximum(order[: m // 2], order[m // 2 :][::-1])
            order = np.concatenate([order[:1], order[-1:], order[1:-1]])
            p, q = p[q < d], q[q < d]
            apq, app, aqq = a[p, q], a[p, p], a[q, q]
            due = np.abs(apq) > eps * np.sqrt(np.abs(app) * np.abs(aqq))
            if not due.any():
                continue
            turned, (p, q, apq, app, aqq) = True, (x[due] for x in (p, q, apq, app, aqq))
            with np.errstate(over="ignore"):
                theta = (aqq - app) / (2 * apq)
                t = np.where(theta == 0, 1.0, np.sign(theta)) / (np.abs(theta) + np.hypot(theta, 1))
            c = 1 / np.hypot(t, 1)
            s = t * c
            rows_p, rows_q = a[p].copy(), a[q].copy()
            a[p], a[q] = c[:, None] * rows_p - s[:, None] * rows_q, s[:, None] * rows_p + c[:, None] * rows_q
            cols_p, cols_q = a[:, p].copy(), a[:, q].copy()
            a[:, p], a[:, q] = c * cols_p - s * cols_q, s * cols_p + c * cols_q
            a[p, p], a[q, q], a[p, q], a[q, p] = app - t * apq, aqq + t * apq, 0, 0
            v_p, v_q = vectors[:, p].copy(), vectors[:, q].copy()
            vectors[:, p], vectors[:, q] = c * v_p - s * v_q, s * v_p + c * v_q
        if not turned:
            falling = np.argsort(-np.diag(a), kind="stable")
            return np.diag(a)[falling], vectors[:, falling]
    raise RuntimeError(f"entries off the diagonal are left after {MAX_SWEEPS} sweeps")


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: up to `components` rows for each vector."""
    spark = vectors.sparkSession
    rows = stored(quantised(vectors), "quantised")
    fit = stored(rows.select("x").distinct(), "distinct")
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    least, d = fit.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if not d:
        return spark.createDataFrame([], schema)
    if least < d:
        rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("x"))))
        fit = stored(rows.select("x").distinct(), "distinct")
    n, total = sums(fit, d)
    cov = _scatter(fit, d, lambda x: _centred(x, n, total)) / n
    values, axes = jacobi(cov)
    k, trace = min(components, d), float(np.trace(cov))
    real = values[:k] > d * np.finfo(float).eps * max(values[0], 0)
    weights = axes[:, :k] / np.where(real, np.sqrt(np.where(real, values[:k], 1)), np.inf)
    explained = [float(v / trace) if trace > 0 else None for v in values[:k]]
    box = spark.sparkContext.broadcast(weights)
    got = _scatter(fit, d, lambda x: _centred(x, n, total) @ box.value) / n
    error = float(np.abs(got[np.ix_(real, real)] - np.eye(int(real.sum()))).max()) if real.any() else None

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.array(total, object)
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            z = _centred(x, n, total)
            white = (z @ box.value).ravel()
            squares = ((z * n) ** 2).sum(axis=1)
            if len(x) and squares.max() < SQUARES:
                dev = ((n * x - np.array(total, np.int64)) ** 2).sum(axis=1).tolist()
            else:
                dev = [v if v <= LONG else None for v in ((n * x.astype(object) - shift) ** 2).sum(axis=1).tolist()]
            times = len(x)
            ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(times), k)))
            yield pa.record_batch({
                "vec_id": ids, "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), times)), "n": pa.array(np.full(times * k, n, np.int64)),
                "deviation": pa.array(dev, pa.int64()).take(pa.array(np.repeat(np.arange(times), k))), "whitened": pa.array(white, mask=~np.tile(real, times)),
                "explained": pa.array(explained * times, pa.float64()), "identity_error": pa.array([error] * (times * k), pa.float64()),
            })

    return rows.select(F.col("vec_id").cast("long"), "x").mapInArrow(project, schema)
