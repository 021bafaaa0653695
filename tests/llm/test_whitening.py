"""Whitening against exact sums and numpy's eigenvectors."""

import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from martlet.llm import queries
from martlet.llm.whitening import deviations, orthogonal_columns, pivoted_cholesky, principal, whiten

SCHEMA = "vec_id long, embedding array<double>, label long, n string"


def whole(vector):
    if not vector or any(c is None or not math.isfinite(c) for c in vector):
        return None
    x = tuple(math.floor(256 * c) for c in vector)
    return x if all(-2**63 <= v < 2**63 for v in x) else None


def brute(rows, k=4):
    cells = [(i, whole(v)) for i, v, *_ in rows]
    lengths = Counter(len(x) for x in {x for _, x in cells if x})
    d = max(lengths, key=lambda length: (lengths[length], length))
    fit = sorted({x for _, x in cells if x and len(x) == d})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(Fraction(n * v - s, n)) for v, s in zip(x, sums)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return {"n": n, "values": values, "vectors": vectors, "rows": [
        (i, sum((n * v - s) ** 2 for v, s in zip(x, sums)), [float(Fraction(n * v - s, n)) for v, s in zip(x, sums)]) for i, x in cells if x and len(x) == d], "k": k}


def check(got, want):
    k, explained = want["k"], want["values"] / want["values"].sum()
    assert sorted((str(r.vec_id), r.deviation) for r in got) == sorted((str(i), dev if dev < 2**63 else None) for i, dev, _ in want["rows"])
    sign = None
    for i, dev, y in want["rows"]:
        mine = [r for r in got if r.vec_id == i and r.deviation in (dev, None)]
        expected = np.array(y) @ want["vectors"][:, :k] / np.sqrt(want["values"][:k])
        if sign is None:
            sign = np.sign(expected) * np.sign(np.array(mine[0].whitened))
        assert any(np.allclose(np.array(r.whitened) * sign, expected, atol=1e-9) for r in mine)
    for r in got:
        assert r.n == want["n"] and len(r.whitened) == k and r.identity_error < 1e-9
        assert np.allclose(r.explained, explained[:k], rtol=1e-9)


@pytest.fixture(scope="module")
def vectors():
    random = np.random.default_rng(3)
    scales = np.array([3, 2, 1.5, 1, 0.5, 0.2, 0.1])
    rows = [(i, (random.standard_normal(7) * scales + 5).tolist(), i % 3, "x") for i in range(300)]
    rows += [(400 + i, rows[0][1], 0, "x") for i in range(150)] + [rows[7], (None, rows[5][1], 1, "x"), (None, rows[6][1], None, None)]
    bad = [None, [], [1.0] * 6 + [None], [1.0] * 6 + [math.nan], [math.inf] + [0.0] * 6, [1e300] + [0.0] * 6, [1.0, 2.0], [None] * 7]
    return rows + [(900 + i, v, 0, "x") for i, v in enumerate(bad)]


def test_whitening(spark, vectors):
    table = spark.createDataFrame(vectors, SCHEMA).withColumnsRenamed({"n": "whitened"}).repartition(5)
    rows, fitted = whiten(table)
    got = rows.collect()
    check(got, brute(vectors))
    assert fitted.n == 300 and fitted.components.shape == (4, 7)
    for whitened in {tuple(r.whitened) for r in got if r.vec_id in range(400, 550)}:
        assert np.allclose(whitened, next(r.whitened for r in got if r.vec_id == 0))
    again = {(r.vec_id, r.deviation, tuple(np.round(r.whitened, 9))) for r in whiten(table.repartition(2))[0].collect()}
    assert again == {(r.vec_id, r.deviation, tuple(np.round(r.whitened, 9))) for r in got}


def test_large_entries_stay_exact(spark):
    random = np.random.default_rng(4)
    rows = [(i, [float(v) for v in random.integers(-2**44, 2**44, 3)], 0, "") for i in range(60)]
    check(whiten(spark.createDataFrame(rows, SCHEMA), components=3)[0].collect(), brute(rows, 3))
    assert deviations(np.array([[2**40, -2**40]]), 1 << 30, (5, 7)) == [None]
    x, sums, n = np.array([[3, -4], [0, 9]]), (10**12, -(10**12)), 10**6
    assert deviations(x, n, sums) == [v if (v := sum((n * int(c) - s) ** 2 for c, s in zip(row, sums))) < 2**63 else None for row in x]


def test_vectors_that_do_not_vary(spark):
    same = spark.createDataFrame([(i, [0.5, 1.0], 0, "") for i in range(5)], SCHEMA)
    empty = spark.createDataFrame([], SCHEMA)
    for table in (same, empty, spark.createDataFrame([(1, None, 0, "")], SCHEMA)):
        rows, fitted = whiten(table)
        assert rows.count() == 0 and fitted is None and "whitened" in rows.columns
    # Two dimensions that move together and one that stays: one component.
    line = spark.createDataFrame([(i, [i / 256, 2 * i / 256, 3.0], 0, "") for i in range(40)], SCHEMA)
    got = whiten(line)[0].collect()
    assert len(got) == 40 and all(len(r.whitened) == 1 and abs(r.explained[0] - 1) < 1e-12 for r in got)


def test_factor_and_rotations():
    random = np.random.default_rng(5)
    for d, rank in ((1, 1), (2, 2), (9, 9), (30, 12)):
        half = random.standard_normal((d, rank)) * np.logspace(0, -5, rank)
        matrix = half @ half.T
        factor, order = pivoted_cholesky(matrix)
        assert factor.shape[1] <= rank and np.allclose(factor @ factor.T, matrix[np.ix_(order, order)], atol=1e-12)
        columns = orthogonal_columns(factor)
        product = columns.T @ columns
        assert np.abs(product - np.diag(np.diag(product))).max() <= 1e-12
        values, vectors = principal(matrix)
        assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-8)
        assert np.allclose(values[:3], np.linalg.eigvalsh(matrix)[::-1][:3], rtol=1e-10) and (np.diff(values) <= 0).all()


def test_query(spark):
    path = "/root/testdata/sf0.001"
    got = queries.op11_embedding_whitening(spark, path)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    want, out = brute(rows), got.groupBy("vec_id", "n", "deviation").agg(F.sort_array(F.collect_list(F.struct("component", "whitened", "explained"))).alias("of"), F.max("identity_error").alias("identity_error"))
    flat = [type("R", (), {"vec_id": r.vec_id, "n": r.n, "deviation": r.deviation, "whitened": [x.whitened for x in r.of], "explained": [x.explained for x in r.of], "identity_error": r.identity_error}) for r in out.collect()]
    check(flat, want)
