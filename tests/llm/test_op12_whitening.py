import math
from fractions import Fraction

import numpy as np
import pytest

from cairnworks.llm import whitening
from cairnworks.llm.queries import QUERIES
from tests.conftest import SMALL


def test_products_keep_what_plain_sums_lose():
    rng = np.random.default_rng(1)
    rows = rng.integers(-(2**40), 2**40, (1000, 3)) / 2.0**20 + rng.integers(0, 2, (1000, 3)) * 2.0**30
    high, low = whitening.products((rows, np.zeros_like(rows)))
    i, j = np.triu_indices(3)
    for k in range(len(i)):
        exact = sum(Fraction(float(r[i[k]])) * Fraction(float(r[j[k]])) for r in rows)
        assert abs(Fraction(float(high[k])) + Fraction(float(low[k])) - exact) <= abs(exact) * Fraction(1, 2**95)


def exact_covariance(x):
    """Of integer rows, in fractions."""
    n, d = len(x), len(x[0])
    mean = [Fraction(sum(int(r[k]) for r in x), n) for k in range(d)]
    return [[sum((int(r[i]) - mean[i]) * (int(r[j]) - mean[j]) for r in x) / n for j in range(d)] for i in range(d)]


def test_covariance_is_exact_to_double(spark):
    rng = np.random.default_rng(2)
    given = [(i, [float(v) for v in rng.standard_normal(5) * 10.0 ** rng.integers(-2, 6)]) for i in range(300)]
    x = whitening.remaining(spark.createDataFrame(given, "vec_id long, embedding array<double>").repartition(7))
    n, sums = whitening.fit_sums(x)
    rows = [[math.floor(64 * c) + 1000000 for c in e] for _, e in given]
    assert n == 300 and sums == [sum(r[k] for r in rows) for k in range(5)]
    high, low = whitening.covariance(x, lambda b: whitening._centred_rows(b, n, sums), 5, n)
    want = exact_covariance(rows)
    for i in range(5):
        for j in range(5):
            assert abs(Fraction(float(high[i, j])) + Fraction(float(low[i, j])) - want[i][j]) <= abs(want[i][i] + want[j][j]) * Fraction(1, 2**90)


def test_query(spark):
    rows = QUERIES["op12_whitening"](spark, SMALL).collect()
    given = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    ids = sorted(given)
    x = np.array([[math.floor(64 * c) + 1000000 for c in given[i]] for i in ids])
    n, sums = len(x), x.sum(0)
    y = (n * x - sums) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    k = min(32, x.shape[1])
    assert len(rows) == n * k and {r["n"] for r in rows} == {n}
    made = np.zeros((n, k))
    for r in rows:
        at = ids.index(r["vec_id"])
        assert r["deviation"] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[at], sums, strict=True))
        made[at, r["component"] - 1] = r["whitened"]
        assert math.isclose(r["explained"], values[-r["component"]] / values.sum(), rel_tol=1e-9)
    want = y @ vectors[:, ::-1][:, :k] / np.sqrt(values[::-1][:k])
    for c in range(k):
        assert min(np.abs(made[:, c] - want[:, c]).max(), np.abs(made[:, c] + want[:, c]).max()) < 1e-8
    errors = {r["identity_error"] for r in rows}
    assert len(errors) == 1 and errors.pop() < 1e-10


KIND = "vec_id long, embedding array<float>, component int, n long, x string"


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    given = [(1, [1.0, 2.0, 3.0]), (2, None), (3, [nan, 1.0, 1.0]), (4, [1.0, None, 1.0]), (5, [inf, 0.0, 0.0]), (6, []), (7, [1.0]), (8, [-1.0, 0.5, 3.0]), (8, [-1.0, 0.5, 3.0]), (None, [0.0, 0.25, 3.0])]
    rows = whitening.whitened(spark.createDataFrame([(*r, 1, 2, "x") for r in given], KIND).repartition(3)).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in rows) == sorted((i, c) for i in (0, 1, 8, 8) for c in (1, 2, 3))
    third = [r for r in rows if r["component"] == 3]  # the third dimension is constant
    assert all(r["whitened"] is None and r["explained"] < 1e-12 for r in third)
    assert all(r["whitened"] is not None and r["identity_error"] < 1e-9 and r["n"] == 4 for r in rows if r["component"] < 3)


@pytest.mark.parametrize("given", [[(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (1, [1.0, 2.0])]])
def test_nothing_varies(spark, given):
    rows = whitening.whitened(spark.createDataFrame([(*r, 1, 2, "x") for r in given], KIND)).collect()
    assert len(rows) == 2 * len(given)
    assert all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in rows)


def test_empty_and_huge(spark):
    assert whitening.whitened(spark.createDataFrame([], KIND)).collect() == []
    rows = whitening.whitened(spark.createDataFrame([(i, [1e30 * i, 1.0], 1, 2, "x") for i in (-1, 1)], KIND)).collect()
    assert {r["deviation"] for r in rows} == {None}
