import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgrid.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, component string"


def symmetric(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * values) @ q.T


@pytest.mark.parametrize("values", [
    [9.0, 7, 5, 3, 1, 0.5], [4.0, 4, 4, 4, 4, 4, 1], [5.0, 5, 5, 2, 1], [1e12, 1e6, 1, 1e-6], [2.0], [3.0, 1], [0.0, 0],
    list(np.linspace(100, 1, 40)), [7.0] * 12, [1.0, 1 - 1e-9, 1 - 2e-9, 1 - 3e-9, 1 - 4e-9, 0.5], [1.0, 0, 0, 0, 0],
])
def test_leading_pairs_equal_a_full_decomposition(values):
    v = symmetric(np.array(values))
    v = (v + v.T) / 2
    known = np.linalg.eigvalsh(v)[::-1]
    found, vectors = whitening.leading_pairs(v, 4)
    scale = np.abs(v).sum(axis=1).max()
    expected = [e for e in known[:4] if e > len(v) * 8 * whitening.EPS * scale]
    assert len(found) == len(expected) and np.allclose(found, expected, rtol=1e-12, atol=1e-13 * scale)
    assert np.allclose(v @ vectors, vectors * found, atol=1e-12 * max(scale, 1e-300))
    assert np.allclose(vectors.T @ vectors, np.eye(len(found)), atol=1e-12)


def test_inertia_counts_eigenvalues():
    v = symmetric(np.array([6.0, 4, 4, -1, -3]))
    diagonal, off = whitening.tridiagonal(v)
    assert [whitening.count_above(diagonal, off, s) for s in (7, 5, 3.9, 0, -2, -4)] == [0, 1, 3, 3, 4, 5]


def test_equals_brute_force(spark, tmp_path):
    source = np.random.default_rng(3)
    good = (source.standard_normal((300, 12)) * np.linspace(1, 0.2, 12)).astype(np.float32)
    rows = [(i, [float(c) for c in v], "old") for i, v in enumerate(good)]
    # copies, a zero of either sign, and what is dropped
    rows += [(300 + i, rows[0][1], "old") for i in range(120)]
    rows += [(500, [0.0] * 12, "old"), (501, [-0.0] * 12, "old"), (None, rows[1][1], "old")]
    rows += [(502, None, "x"), (503, [None] + [0.1] * 11, "x"), (504, [math.nan] + [0.1] * 11, "x"),
             (505, [math.inf] + [0.1] * 11, "x"), (506, [], "x"), (507, [0.5] * 3, "x"), (508, [1e30] * 12, "x")]
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op13_embedding_whitening(spark, str(tmp_path))
    assert dict(got.dtypes) == {
        "vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double",
        "explained": "double", "identity_error": "double",
    }
    x = {i: [math.floor(256 * c) for c in np.float32(v).astype(float)] for i, v, mark in rows if mark == "old"}
    fit = np.array(sorted(set(map(tuple, x.values()))))
    n, sums = len(fit), fit.sum(axis=0)
    assert n == 301
    v = np.cov(fit.T, bias=True)
    values, vectors = np.linalg.eigh(v)
    found = got.collect()
    assert len(found) == 4 * 423
    turned = {}
    for row in found:
        e, q = values[-row["component"]], vectors[:, -row["component"]]
        assert row["n"] == n and row["identity_error"] < 1e-12
        assert row["deviation"] == sum((n * a - int(s)) ** 2 for a, s in zip(x[row["vec_id"]], sums))
        assert math.isclose(row["explained"], e / np.trace(v), rel_tol=1e-10)
        expected = float((np.array(x[row["vec_id"]]) - sums / n) @ q / math.sqrt(e))
        sign = turned.setdefault(row["component"], math.copysign(1, expected * row["whitened"]))
        assert math.isclose(row["whitened"], sign * expected, rel_tol=1e-8, abs_tol=1e-9)


def test_no_vectors_equal_vectors_few_entries(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.fit_whitening(empty) is None
    assert whitening.whiten(empty, None).count() == 0
    none = spark.createDataFrame([(1, None, "a"), (2, [math.nan], "b")], SCHEMA)
    assert whitening.fit_whitening(none) is None and whitening.whiten(none, None).count() == 0
    equal = spark.createDataFrame([(i, [0.5, 0.25], "a") for i in range(5)], SCHEMA)
    model = whitening.fit_whitening(equal)
    assert model.n == 1 and not len(model.values) and whitening.whiten(equal, model).count() == 0
    line = spark.createDataFrame([(i, [0.5 * i, 0.25], "a") for i in range(5)], SCHEMA).withColumn("Whitened", F.lit("old"))
    out = whitening.whiten(line, whitening.fit_whitening(line)).orderBy("vec_id").collect()
    assert [row["component"] for row in out] == [1] * 5 and abs(out[2]["whitened"]) < 1e-12
    assert math.isclose(out[0]["explained"], 1.0)


def test_deviations_beyond_a_long():
    rows = np.array([[2**52, -(2**52)], [3, 4]])
    assert whitening.exact_deviations(rows, 2, [0, 0]) == [None, 100]
    assert whitening.exact_deviations(rows[1:], 2, [1, 1]) == [25 + 49]
