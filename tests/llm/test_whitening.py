import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lifelog.llm import whitening


def plain(vectors, components=8):
    """(n, x, deviations, eigenvalues, vectors, trace) by a dense decomposition."""
    x = np.array([[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    deviation = [int(sum((n * a - b) ** 2 for a, b in zip(row, s))) for row in x]
    y = x.astype(float) - np.array([float(t) / n for t in s])
    cov = y.T @ y / n
    e, u = np.linalg.eigh(cov)
    return n, deviation, e[::-1][:components], u[:, ::-1][:, :components], np.trace(cov), y


def check(rows, ids, vectors, key="vec_id", components=8, close=1e-9):
    n, deviation, e, u, trace, y = plain(vectors, components)
    k = min(components, len(e))
    z = y @ u / np.sqrt(e)
    by = {(r[key], r.component): r for r in rows}
    assert len(rows) == len(ids) * k == len(by)
    for c in range(k):
        got = np.array([by[i, c + 1].whitened for i in ids])
        sign = np.sign(got @ z[:, c])
        assert np.abs(got * sign - z[:, c]).max() < close
        assert all(abs(by[i, c + 1].explained / (e[c] / trace) - 1) < 1e-9 for i in ids)
    assert [by[i, 1].deviation for i in ids] == deviation
    assert {r.n for r in rows} == {n} and len({r.identity_error for r in rows}) == 1
    assert rows[0].identity_error < 1e-9


def table(spark, rows, kind="array<float>"):
    return spark.createDataFrame([(*r, 0) for r in rows], f"vec_id long, embedding {kind}, n int")


def test_query_against_a_dense_decomposition(spark, sf):
    given = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    check(whitening.op13_whitening(spark, sf).collect(), [r.vec_id for r in given], [r.embedding for r in given])


def test_bad_vectors_go(spark):
    rng = np.random.default_rng(2)
    good = [(k, [float(np.float32(c)) for c in rng.normal(0, 1 + np.arange(5), 5)]) for k in range(60)]
    bad = [(100, None), (101, [1.0, None, 2.0, 3.0, 4.0]), (102, [float("nan")] * 5), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (104, []),
           (105, [1.0, 2.0]), (106, [1e30] * 5)]
    rows = whitening.whitened(table(spark, good + bad).repartition(3)).collect()
    check(rows, [k for k, _ in good], [v for _, v in good])
    assert {r.component for r in rows} == {1, 2, 3, 4, 5}


def test_wide_numbers_and_doubles(spark):
    rng = np.random.default_rng(3)
    good = [(k, [float(c) for c in rng.normal(0, [1e9, 1.0, 50.0])]) for k in range(40)]
    rows = whitening.whitened(table(spark, good, "array<double>")).collect()
    n, deviation, e, u, trace, y = plain([v for _, v in good])
    held = {r.vec_id: r.deviation for r in rows}
    assert [held[k] for k in range(40)] == [d if d < 2**63 else None for d in deviation] and None in held.values()
    assert {r.component for r in rows} == {1} | {c + 1 for c in range(3) if e[c] > whitening.LEAST * e[0]}


def test_passes_are_few_and_a_restart_converges():
    rng = np.random.default_rng(5)
    d = 300
    y = rng.standard_normal((2000, d)) * np.linspace(1, 1.6, d)
    cov = y.T @ y / len(y)
    asked = []
    values, vectors = whitening.jacobi_davidson(lambda q: asked.append(q.shape[1]) or cov @ q, d, 8)
    e, u = np.linalg.eigh(cov)
    assert np.abs(values / e[::-1][:8] - 1).max() < 1e-13
    for k in range(8):
        assert abs(abs(vectors[:, k] @ u[:, -1 - k]) - 1) < 1e-12
    assert np.linalg.norm(cov @ vectors - vectors * values, axis=0).max() < 100 * whitening.TOLERANCE * e[-1]
    assert len(asked) < 150  # a product with all unit vectors would be ``d`` columns: the matrix itself
    assert max(asked) <= 10


def test_correction_is_the_least_residual():
    rng = np.random.default_rng(6)
    a = rng.standard_normal((20, 20))
    v = a + a.T
    q = np.linalg.qr(rng.standard_normal((20, 3)))[0]
    theta = np.diag(q.T @ v @ q)
    r = v @ q - q * theta
    project = np.eye(20) - q @ q.T
    t = whitening.corrections(lambda x: v @ x, q, theta, r, 25)
    for k in range(3):  # with as many steps as dimensions the equation is solved
        left = project @ (v - theta[k] * np.eye(20)) @ project @ t[:, k]
        assert np.abs(left + project @ r[:, k]).max() < 1e-6
    assert np.abs(q.T @ t).max() < 1e-10


@pytest.mark.parametrize("values", [[[1.0, 2.0]] * 5, [[0.5, 0.25]]])
def test_no_spread_has_no_components(spark, values):
    assert whitening.whitened(table(spark, list(enumerate(values)))).collect() == []


def test_ties_and_ids(spark):
    rows = [(None, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [-1.0, -3.0])]
    got = whitening.whitened(table(spark, rows)).collect()
    assert sorted((str(r.vec_id), r.component) for r in got) == sorted((str(k), c) for k in (None, 1, 1, 2) for c in (1, 2))
    equal = [(k, [float(k % 2), float(k // 2 % 2), float(k // 4)]) for k in range(8)]  # three equal eigenvalues
    got = whitening.whitened(table(spark, equal)).toPandas()
    z = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(z.T @ z / 8 - np.eye(3)).max() < 1e-12 and np.allclose(got["explained"], 1 / 3)


def test_empty_table(spark):
    none = table(spark, [(1, [1.0])]).where("vec_id > 1")
    assert whitening.whitened(none).count() == 0
    assert whitening.whitened(none.withColumn("vec_id", F.col("vec_id").cast("string"))).schema["vec_id"].dataType.simpleString() == "string"
