"""Whitening against NumPy's singular vectors of the centred distinct rows."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.llm import whitening
from vitrine.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>"


def run(spark, rows, k=4, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema).where(whitening.whole(F.col("embedding")))
    df = df.withColumn("x", whitening.quantise(F.col("embedding")))
    return whitening.transform(df, whitening.fit(df, k=k), k=k)


def brute(vectors, k=4):
    """Distinct integer vectors, their covariance, and its leading eigenvectors."""
    x = np.floor(256 * np.array(vectors, np.float64)).astype(np.int64)
    fit = np.unique(x, axis=0)
    centred = fit - fit.sum(0) / len(fit)
    _, singular, rows = np.linalg.svd(centred)
    values, columns = singular**2 / len(fit), rows.T
    deviation = [sum((len(fit) * int(a) - int(s)) ** 2 for a, s in zip(row, fit.sum(0))) for row in x]
    whitened = (x - fit.sum(0) / len(fit)) @ columns[:, :k] / np.sqrt(values[:k])
    return len(fit), deviation, whitened, values[:k] / values.sum()


def against(rows, vectors, k=4):
    n, deviation, whitened, share = brute(vectors, k)
    by = {}
    for r in rows:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert len(by) == len(vectors)
    for at, vec_id in enumerate(sorted(by)):
        assert sorted(by[vec_id]) == list(range(1, k + 1))
        for c, r in by[vec_id].items():
            assert (r.n, r.deviation) == (n, deviation[at])
            assert abs(r.explained / share[c - 1] - 1) < 1e-9 and 0 <= r.identity_error < 1e-9
    for c in range(1, k + 1):
        mine = np.array([by[v][c].whitened for v in sorted(by)])
        sign = np.sign(mine @ whitened[:, c - 1])
        assert np.abs(sign * mine - whitened[:, c - 1]).max() < 1e-8


def draw_vectors(n, dim, seed=0):
    draw = np.random.default_rng(seed)
    return (draw.normal(size=(n, dim)) @ np.diag(2.0 ** -np.arange(dim)) @ draw.normal(size=(dim, dim))).astype(np.float32).tolist()


def test_against_eigenvectors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 37)
    monkeypatch.setattr(whitening, "BLOCK", 20)  # a few rows of a matrix at a time
    vectors = draw_vectors(500, 8)
    vectors += [vectors[0]] * 300  # a third of all rows are copies
    against(run(spark, list(enumerate(vectors))).collect(), vectors)


def test_long_thin_shapes(spark):
    """Extents over five orders of magnitude."""
    draw = np.random.default_rng(5)
    vectors = (draw.normal(size=(400, 5)) * [5e3, 500, 30, 1, 0.05]).tolist()
    against(run(spark, list(enumerate(vectors)), 5, "vec_id long, embedding array<double>").collect(), vectors, 5)


def test_directions_without_extent(spark):
    """A constant element and a repeated one: two of five eigenvalues are zero."""
    base = draw_vectors(200, 3, 2)
    rows = [(i, [*v, 1.5, v[0]]) for i, v in enumerate(base)]
    found = run(spark, rows, 5).collect()
    assert len(found) == 1000
    for r in found:
        assert (r.whitened is None) == (r.component > 3) and r.identity_error < 1e-9
        assert r.explained > 1e-3 if r.component < 4 else abs(r.explained) < 1e-12
    few = run(spark, rows[:2], 4).collect()  # fewer vectors than elements
    assert {(r.component, r.whitened is None) for r in few} == {(1, False), (2, True), (3, True), (4, True)}
    same = run(spark, [(i, [1.0, 2.0]) for i in range(50)]).collect()
    assert len(same) == 100 and {(r.n, r.deviation, r.whitened, r.explained) for r in same} == {(1, 0, None, 0.0)}


def test_odd_rows(spark):
    vectors = draw_vectors(60, 3, 7)
    rows = list(enumerate(vectors))
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan"), 0.0, 0.0]), (103, [float("inf"), 0.0, 0.0]), (104, []), (105, [1.0]), (None, vectors[3])]
    found = run(spark, rows + odd, 3).collect()
    dropped = {100, 101, 102, 103}
    assert {r.vec_id for r in found} == {i for i, _ in rows + odd} - dropped
    for r in found:
        assert (r.deviation is None and r.whitened is None) == (r.vec_id in (104, 105)) and r.n == 60
    kept = {(r.component, r.whitened) for r in found if r.vec_id is None}
    assert kept == {(r.component, r.whitened) for r in found if r.vec_id == 3}
    assert run(spark, []).count() == 0 and run(spark, [(1, []), (2, None)]).count() == 0
    clash = [(i, v, "mine", "mine") for i, v in rows]
    mixed = run(spark, clash, 2, f"{SCHEMA}, component string, note string").collect()
    assert {r.component for r in mixed} == {1, 2} and {r.note for r in mixed} == {"mine"}


def test_exact_deviations():
    """Products beyond 64 bits are exact; sums beyond a long are null."""
    sums = [10**17, -(10**17)]
    x = np.array([[10**9, -(10**9)], [10**9 - 1, 5]], np.int64)
    n = 10**8
    want = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
    assert whitening._deviations(x, n, sums) == [w if w < 2**63 else None for w in want] and want[0] == 0
    rows = np.random.default_rng(1).integers(-(10**5), 10**5, (50, 3))
    own = [int(s) for s in rows.sum(0)]
    assert whitening._deviations(rows, 50, own) == [sum((50 * int(a) - s) ** 2 for a, s in zip(r, own)) for r in rows]


def test_solves_rows():
    draw = np.random.default_rng(3)
    factors = [np.triu(draw.normal(size=(6, 6))) + 3 * np.eye(6) for _ in range(2)]
    y = draw.normal(size=(20, 6))
    assert np.allclose(whitening.solve_rows(y, factors) @ factors[1] @ factors[0], y)


@pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables are not here")
def test_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    against(QUERIES["op11_whitening"](spark, SF).collect(), [r.embedding for r in rows])
