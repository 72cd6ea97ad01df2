"""Whitening against exact fractions and another eigenvalue solver."""

import math

import numpy as np
import pytest
from pyspark.sql import types as T

from perfweave.llm import whitening


def plain(vectors):
    """(x by row, n, S, eigenvalues, vectors) with numpy's solver."""
    xs = [None if v is None or any(c is None or not math.isfinite(c) for c in v) else tuple(math.floor(64 * c) + 1_000_000 for c in v) for v in vectors]
    fit = sorted({x for x in xs if x is not None})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
    values, found = np.linalg.eigh(y.T @ y / n)
    return xs, n, sums, values[::-1], found[:, ::-1]


def held(spark, vectors, got):
    xs, n, sums, values, found = plain(vectors)
    k = min(16, len(sums))
    assert len(got) == k * sum(x is not None for x in xs)
    by_id = {}
    for r in got:
        by_id.setdefault(r["vec_id"], {})[r["component"]] = r
    signs = np.zeros(k)
    for i, x in enumerate(xs):
        if x is None:
            assert i not in by_id
            continue
        z = [n * c - s for c, s in zip(x, sums)]
        want = np.array([c / n for c in z]) @ found[:, :k] / np.sqrt(values[:k])
        rows = [by_id[i][c] for c in range(1, k + 1)]
        assert all(r["n"] == n and r["deviation"] == sum(c * c for c in z) for r in rows)
        assert np.allclose([r["explained"] for r in rows], values[:k] / values.sum(), rtol=1e-9)
        mine = np.array([r["whitened"] for r in rows])
        signs = np.where((signs == 0) & (np.abs(want) > 1e-3), np.sign(mine * want), signs)
        assert np.allclose(mine, want * np.where(signs == 0, 1, signs), atol=1e-7)
        assert all(r["identity_error"] < 1e-9 for r in rows)


def test_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()
    assert [r["vec_id"] for r in rows] == list(range(len(rows)))
    got = whitening.op12_whitening(spark, "/root/testdata/sf0.001")
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    held(spark, [r["embedding"] for r in rows], got.collect())


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    vectors = [list(map(float, v)) for v in rng.normal(size=(60, 5)) * [9, 5, 3, 2, 1]]
    vectors += vectors[:20] * 3 + [None, [1.0, None, 0.0, 0.0, 0.0], [float("nan")] * 5, [float("inf"), 0.0, 0.0, 0.0, 0.0], [1e300] * 5]
    schema = T.StructType.fromDDL("id long, x string, component int, vec array<double>, vec_id string")
    docs = spark.createDataFrame([(i, "e", 1, v, "f") for i, v in enumerate(vectors)], schema)
    got = whitening.whitened(docs, "id", "vec").collect()
    held(spark, vectors[:-1] + [None], got)


def test_without_variance(spark):
    one = spark.createDataFrame([(1, [0.5, 0.25]), (1, [0.5, 0.25]), (None, None)], "vec_id long, embedding array<float>")
    assert whitening.whitened(one).collect() == []
    assert whitening.whitened(one.limit(0)).collect() == []
    assert whitening.whitened(spark.createDataFrame([(1, [])], "vec_id long, embedding array<float>")).collect() == []
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 3.0]) for i in range(9)] + [(9, [1.0])], "vec_id long, embedding array<float>")
    got = whitening.whitened(line).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 9 and got[0]["identity_error"] < 1e-9


@pytest.mark.parametrize("case", ["random", "clusters", "equal", "diagonal", "graded", "blocks", "tiny"])
def test_solver(case):
    rng = np.random.default_rng(3)
    d = 40
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    wanted = {
        "random": rng.uniform(1, 5, d), "clusters": 1 + np.repeat(np.arange(8), 5) + rng.uniform(0, 1e-9, d),
        "equal": np.repeat([4.0, 3.0, 2.0, 1.0], 10), "diagonal": np.arange(1.0, d + 1), "graded": 10.0 ** -np.arange(0, d, dtype=float),
        "blocks": np.arange(1.0, d + 1), "tiny": rng.uniform(1, 5, d) * 1e-200,
    }[case]
    if case == "diagonal":
        v = np.diag(wanted)
    elif case == "blocks":
        b = np.array([[2.0, 1.0], [1.0, 2.0]])
        v = np.kron(np.eye(d // 2), b)
    else:
        v = q @ np.diag(wanted) @ q.T
    v = (v + v.T) / 2
    values, vectors = whitening.principal(v)
    want = np.linalg.eigvalsh(v)[::-1][: len(values)]
    top = want[0]
    assert len(values) == 16 or case == "graded" and len(values) >= 13
    assert np.abs(values - want).max() <= 1e-13 * d * top
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.abs(v @ vectors - vectors * values).max() <= 1e-13 * d * top


def test_long_deviation():
    z = whitening.centred_times_n(np.array([[1 << 40, 3]]), 1 << 30, np.array([5, 7], dtype=object))
    assert z.tolist() == [[(1 << 70) - 5, (3 << 30) - 7]]
    assert whitening.squared_length(z) == [None]
    assert whitening.squared_length(np.array([[3, 4]])) == [25]
