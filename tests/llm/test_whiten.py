"""Whitening against exact sums and numpy's own decomposition; the refinement on matrices whose eigenvectors are known."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from shelflife.llm import queries, whiten
from shelflife.llm.common import read_table

SF = "/root/testdata/sf0.001"
WIDE = np.longdouble


def integers(vectors):
    return [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]


def check(rows, vectors):
    """``rows`` of one length of vectors against plain sums; ``vectors`` by id."""
    x = dict(zip(vectors, integers(vectors.values())))
    n, d = len(x), len(next(iter(x.values())))
    sums = [sum(v[j] for v in x.values()) for j in range(d)]
    apart = {i: [n * a - s for a, s in zip(v, sums)] for i, v in x.items()}
    z = np.array([[a / n for a in v] for v in apart.values()])
    values, turn = np.linalg.eigh(z.T @ z / n)
    values, turn = values[::-1], turn[:, ::-1]
    found = {(r["vec_id"], r["component"]): r for r in rows}
    count = min(32, d)
    assert len(found) == len(rows) == n * count
    for i, v in apart.items():
        for k in range(1, count + 1):
            assert found[i, k]["n"] == n and found[i, k]["deviation"] == sum(a * a for a in v)
    error = {r["identity_error"] for r in rows}
    assert len(error) == 1 and error.pop() <= 1e-9
    for k in range(count):
        column = np.array([found[i, k + 1]["whitened"] if found[i, k + 1]["whitened"] is not None else np.nan for i in x])
        explained = {found[i, k + 1]["explained"] for i in x}
        assert len(explained) == 1 and abs(explained.pop() - values[k] / values.sum()) <= 1e-9
        if values[k] > 1e-9 * values[0]:
            plain = z @ turn[:, k] / np.sqrt(values[k])
            assert min(np.abs(column - plain).max(), np.abs(column + plain).max()) <= 1e-6
        else:
            assert np.isnan(column).all()


def test_query_equals_numpy(spark):
    rows = read_table(spark, SF, "embeddings").collect()
    check(queries.QUERIES["op12_embedding_whitening"](spark, SF).collect(), {r["vec_id"]: r["embedding"] for r in rows})


def test_odd_rows(spark):
    rng = random.Random(12)
    good = {i: [rng.gauss(0, 1 + j) for j in range(5)] for i in range(60)}
    good[60] = good[61] = good[3]  # repeated vectors
    short = {100 + i: [rng.gauss(0, 1), 2.0, rng.gauss(3, 1)] for i in range(20)}
    bad = [(200, None), (201, []), (202, [1.0, None, 3.0, 1.0, 1.0]), (203, [float("nan")] * 5), (204, [float("inf")] * 5)]
    rows = [(i, v, 1, "x", 0.0) for i, v in [*good.items(), *short.items(), *bad]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, dim int, numbers string, n double").repartition(4)
    found = whiten.whiten(df).collect()
    check([r for r in found if r["vec_id"] < 100], good)
    check([r for r in found if r["vec_id"] >= 100], short)


def test_rows_without_an_id_and_one_row(spark):
    schema = "vec_id long, embedding array<float>"
    found = whiten.whiten(spark.createDataFrame([(None, [1.0, 2.0]), (None, [2.0, 1.0]), (None, [1.0, 2.0])], schema)).collect()
    assert len(found) == 6 and all(r["vec_id"] is None and r["n"] == 3 for r in found)
    alone = whiten.whiten(spark.createDataFrame([(1, [1.0, 2.0])], schema)).collect()
    assert [(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in alone] == [(0, None, None, 0.0)] * 2
    assert whiten.whiten(spark.createDataFrame([], schema)).collect() == []


def test_huge_entries(spark):
    rows = [(i, [1e30 * (-1) ** i, float(i), 5e8 * i]) for i in range(10)]
    found = whiten.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(found) == 30 and all(r["deviation"] is None for r in found)
    assert found[0]["identity_error"] <= 1e-4


def test_sums_are_exact():
    rng = np.random.default_rng(4)
    for size in (10, 1 << 30, 1 << 61):
        rows = rng.integers(-size, size, (50, 4))
        plain = [[sum(int(r[i]) * int(r[j]) for r in rows) for j in range(4)] for i in range(4)]
        assert whiten.exact_products(rows).tolist() == plain
        assert whiten.exact_sums(rows).tolist() == [sum(int(r[i]) for r in rows) for i in range(4)]


def orthogonal(d, seed):
    """An orthogonal matrix in extended precision."""
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0].astype(WIDE)
    for _ in range(4):
        q = q + q @ (np.eye(d, dtype=WIDE) - q.T @ q) / 2
    return q


@pytest.mark.parametrize(
    "values",
    [
        np.arange(1, 41)[::-1],
        np.concatenate([[5, 5 - 1e-9, 5 - 2e-9, 5 - 1e-12], np.linspace(3, 1, 20)]),  # closer than float32 can tell
        np.concatenate([[2] * 6, [1 + 1e-10, 1], [1e-6, 1e-9]]),  # equal ones
        np.logspace(0, -12, 13),
    ],
)
def test_refinement(values):
    values = np.sort(np.array(values, WIDE))[::-1]
    q = orthogonal(len(values), 7)
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    found, x = whiten.eigen(a)
    assert np.abs(found - values).max() <= 1e-17 * len(values)
    assert np.abs(x.T @ x - np.eye(len(values))).max() <= 1e-17 * len(values)
    assert np.abs(a @ x - x * found).max() <= 1e-17 * len(values)
    # Vectors whose eigenvalue stands apart are found to double precision, however small the gap.
    for k in range(len(values)):
        gap = min(abs(values[k] - v) for j, v in enumerate(values) if j != k)
        if gap > 1e-13:
            wrong = min(np.abs(x[:, k] - q[:, k]).max(), np.abs(x[:, k] + q[:, k]).max())
            assert wrong <= 1e-17 * len(values) / gap


def test_covariance_is_the_exact_one():
    x = integers([[0.5, 0.25, -0.1], [0.1, 0.3, 0.2], [0.9, -0.4, 0.0]])
    n, sums = 3, [sum(c) for c in zip(*x)]
    own = whiten.Fit(n, [s - n * whiten.OFFSET for s in sums])
    y = np.array(x) - whiten.OFFSET - own.whole
    own.solve(whiten.exact_products(y).tolist(), 3)
    trace = sum(Fraction(sum((n * v[j] - sums[j]) ** 2 for v in x), n**3) for j in range(3))
    assert abs(sum(own.explained) - 1) < 1e-15 and trace > 0
    assert own.deviations(np.array(x) - whiten.OFFSET) == [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in x]
