"""Embeddings on their principal components, each scaled to unit variance.

Spark takes the distinct vectors, their sums and, after centring, the covariance: every task multiplies
its rows and hands on one triangle, which is added up by rows of the matrix. What follows works on one
matrix as wide as an embedding, whatever the number of rows: Householder reflections make it tridiagonal,
counting sign changes (Sturm) bisects its leading eigenvalues, inverse iteration finds their vectors, made
orthogonal within clusters of close values. The components are broadcast and rows are projected where
they are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perfweave.llm.common import stage, table

COMPONENTS = 16
# Fixed values of the contract: how an entry becomes a whole number.
SCALE, SHIFT = 64, 1_000_000
# Rows that a task multiplies or projects at a time.
BLOCK_ROWS = 4096
# Values closer than this part of the matrix's norm make a cluster.
CLUSTER = 1e-3


def whole_vector(vec: Column) -> Column:
    """floor(64 * c) + 1000000 per entry; null where the vector or an entry is null, not finite, or no long."""
    limit = F.lit(float(1 << 62))
    scaled = F.transform(vec, lambda c: F.floor(c.cast("double") * SCALE))
    usable = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * SCALE) < limit))
    return F.when(usable, F.transform(scaled, lambda c: c + F.lit(SHIFT).cast("long")))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, len(batch), BLOCK_ROWS):
            yield batch.slice(lo, BLOCK_ROWS)


def sums_of(distinct: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """(rows, exact sums per dimension)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for batch in _blocks(batches):
            x = _matrix(batch["x"], width)
            n += len(x)
            # Two halves of every entry, so that sums of a block stay exact.
            high, low = (x >> 31).sum(axis=0), (x & (2**31 - 1)).sum(axis=0)
            total = [t + (int(h) << 31) + int(l) for t, h, l in zip(total, high, low)]
        if n:
            # As text: sums of many large entries are longer than a long.
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1, *range(width)], pa.int32()), pa.array([str(n), *map(str, total)])], names=["dim", "total"]
            )

    parts = distinct.mapInArrow(run, "dim int, total string").withColumn("total", F.col("total").cast("decimal(38,0)"))
    rows = {r["dim"]: int(r["total"]) for r in parts.groupBy("dim").agg(F.sum("total").alias("total")).collect()}
    return rows.get(-1, 0), np.array([rows.get(i, 0) for i in range(width)], dtype=object)


def centred_times_n(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S: as longs where that is exact, else as Python's whole numbers."""
    reach = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if n * reach + max(map(abs, sums), default=0) < 1 << 62:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def squared_length(z: np.ndarray) -> list[int | None]:
    """Exact sums of squares per row; null where one is longer than a long."""
    reach = int(np.abs(z).max(initial=0))
    if reach * reach * max(1, z.shape[1]) < 1 << 63:
        return (z.astype(np.int64) ** 2).sum(axis=1).tolist()
    exact = (z.astype(object) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def covariance(distinct: DataFrame, n: int, sums: np.ndarray, columns: np.ndarray | None = None) -> np.ndarray:
    """Covariance of the centred rows, or of their projections on ``columns``, with divisor ``n``."""
    width = len(sums)
    size = width if columns is None else columns.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in _blocks(batches):
            y = centred_times_n(_matrix(batch["x"], width), n, sums).astype(float) / n
            y = y if columns is None else y @ columns
            total = y.T @ y + (0 if total is None else total)
        if total is not None:
            rows = pa.array([total[i, i:] for i in range(size)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), rows], names=["row", "part"])

    parts = distinct.mapInArrow(run, "row int, part array<double>").select("row", F.posexplode("part").alias("at", "v"))
    out = np.zeros((size, size))
    for r in parts.groupBy("row", "at").agg(F.sum("v").alias("v")).toLocalIterator():
        i, j = r["row"], r["row"] + r["at"]
        out[i, j] = out[j, i] = r["v"] / n
    return out


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflections) of a symmetric matrix under Householder reflections."""
    a, mirrors = v.copy(), []
    d = len(a)
    for k in range(d - 2):
        below = a[k + 1:, k]
        scale = np.abs(below).max()
        u = np.zeros(d - k - 1)
        if np.abs(below[1:]).max() > 0:
            u = below / scale
            u[0] += np.copysign(np.linalg.norm(u), u[0])
            u /= np.linalg.norm(u)
            inner = a[k + 1:, k + 1:]
            p = inner @ u
            w = 2 * (p - (u @ p) * u)
            inner -= np.outer(u, w) + np.outer(w, u)
            a[k + 1:, k] -= 2 * (u @ below) * u
        mirrors.append(u)
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def reflected_back(vec: np.ndarray, mirrors: list[np.ndarray]) -> np.ndarray:
    out = vec.copy()
    for k in range(len(mirrors) - 1, -1, -1):
        out[k + 1:] -= 2 * (mirrors[k] @ out[k + 1:]) * mirrors[k]
    return out


def values_above(diag: np.ndarray, off: np.ndarray, at: np.ndarray, least: float) -> np.ndarray:
    """How many eigenvalues lie above each of ``at``: the positive terms of Sturm's sequence."""
    count = np.zeros(len(at), int)
    q = np.full(len(at), np.inf)
    for i in range(len(diag)):
        square = off[i - 1] ** 2 if i else 0.0
        q = diag[i] - at - square / q
        q = np.where(np.abs(q) < least, -least, q)
        count += q > 0
    return count


def leading_values(diag: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, bisected until their bounds are neighbours."""
    reach = np.append(np.abs(off), 0) + np.append(0, np.abs(off))
    low, high = (diag - reach).min(), (diag + reach).max()
    norm = max(abs(low), abs(high))
    least = max(np.finfo(float).tiny / np.finfo(float).eps, np.finfo(float).eps**2 * norm)
    lo, hi = np.full(k, low - 1e-12 * norm), np.full(k, high + 1e-12 * norm)
    rank = np.arange(k)
    for _ in range(200):
        mid = (lo + hi) / 2
        if np.all((mid <= lo) | (mid >= hi)):
            break
        above = values_above(diag, off, mid, least) > rank
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return (lo + hi) / 2


def _solver(diag: np.ndarray, off: np.ndarray, shift: float, tiny: float):
    """Solves (T - shift) y = b by elimination with row exchanges."""
    d = len(diag)
    rows = []
    # The row at hand: its entries at i, i + 1 and i + 2.
    here = [diag[0] - shift, off[0] if d > 1 else 0.0, 0.0]
    for i in range(d - 1):
        below = [off[i], diag[i + 1] - shift, off[i + 1] if i + 2 < d else 0.0]
        swap = abs(below[0]) > abs(here[0])
        if swap:
            here, below = below, here
        if abs(here[0]) < tiny:
            here[0] = tiny
        m = below[0] / here[0]
        rows.append((here, m, swap))
        here = [below[1] - m * here[1], below[2] - m * here[2], 0.0]
    if abs(here[0]) < tiny:
        here[0] = tiny

    def solve(b: np.ndarray) -> np.ndarray:
        y = b.copy()
        for i, (_, m, swap) in enumerate(rows):
            if swap:
                y[i], y[i + 1] = y[i + 1], y[i]
            y[i + 1] -= m * y[i]
        y[d - 1] /= here[0]
        for i in range(d - 2, -1, -1):
            (a, b1, c), _, _ = rows[i]
            y[i] = (y[i] - b1 * y[i + 1] - (c * y[i + 2] if i + 2 < d else 0.0)) / a
        return y

    return solve


def leading_vectors(diag: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors, one column for each of ``values``, by inverse iteration."""
    d, eps = len(diag), np.finfo(float).eps
    norm = np.abs(diag).max() + 2 * np.abs(off).max(initial=0)
    out = np.zeros((d, len(values)))
    start = np.random.default_rng(1)
    first = 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            first = j
        # Equal values are told apart by a few units in the last place, else each solve gives the same vector.
        solve = _solver(diag, off, value - (j - first) * 4 * eps * norm, eps * norm)
        y = start.standard_normal(d)
        for _ in range(6):
            y = solve(y / np.linalg.norm(y))
            y /= np.linalg.norm(y)
            for _ in range(2):
                y -= out[:, first:j] @ (out[:, first:j].T @ y)
            y /= np.linalg.norm(y)
        out[:, j] = y
    return out


def principal(v: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of a covariance, the ``k`` largest that are not zero.

    A value of less than its width times 2^-50 of the largest one is rounding, and no component. The sign
    is such that a vector's largest entry is positive.
    """
    d = len(v)
    if d == 0 or not np.abs(v).max() > 0:
        return np.zeros(0), np.zeros((d, 0))
    scale = np.abs(v).max()
    diag, off, mirrors = tridiagonal(v / scale)
    values = leading_values(diag, off, min(k, d))
    values = values[values > d * 2.0**-50 * values[0]]
    found = leading_vectors(diag, off, values)
    vectors = np.array([reflected_back(found[:, j], mirrors) for j in range(len(values))]).T
    biggest = np.abs(vectors).argmax(axis=0)
    return values * scale, vectors * np.sign(vectors[biggest, np.arange(len(values))])


def whitened(docs: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``, a row per vector and component.

    Rows are dropped where the vector is null, holds null or non-finite entries, or an entry that is no long
    once multiplied by 64. Of vectors of different widths the commonest counts (of equally common ones the
    widest), as covariance needs one width. Directions without variance are no components, so a table of one
    distinct vector gives no rows. Repeated rows and ids each give theirs; ids may be null and of any type.
    ``deviation`` is null where it is longer than a long.

    The driver holds matrices of width times width.
    """
    spark = docs.sparkSession
    rows = stage(
        docs.select(F.col(id_col).alias("vec_id"), whole_vector(F.col(vec_col)).alias("x")).filter("x IS NOT NULL")
    )
    commonest = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = 0 if commonest is None else commonest["width"]
    rows = rows.filter(F.size("x") == width)
    # Copies combine before the shuffle.
    distinct = stage(rows.groupBy("x").agg(F.lit(1).alias("one")).select("x"))
    n, sums = sums_of(distinct, width) if width else (0, np.zeros(0, dtype=object))
    v = covariance(distinct, n, sums) if n else np.zeros((0, 0))
    values, vectors = principal(v, components)
    k = len(values)
    scaled = vectors / np.sqrt(values) if k else vectors
    error = np.abs(covariance(distinct, n, sums, scaled) - np.eye(k)).max() if k else 0.0
    explained = values / np.trace(v) if k else values
    shared = spark.sparkContext.broadcast((scaled, explained, sums))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scaled, explained, sums = shared.value
        for batch in _blocks(batches if k else ()):
            z = centred_times_n(_matrix(batch["x"], width), n, sums)
            m = len(z)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["vec_id"].take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n)),
                    pa.array(squared_length(z), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array((z.astype(float) / n @ scaled).ravel()), pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
