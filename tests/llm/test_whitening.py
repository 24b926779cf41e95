"""Whitening: held against numpy's eigenvectors and whole-number arithmetic."""

import math

import numpy as np

from tessera.llm import queries, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>"


def whole(rows):
    return np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in rows])


def check(out, x, ids, k):
    """Rows of the query against numpy on the same whole numbers."""
    n, d = x.shape
    cov = np.cov(x.T.astype(float), bias=True).reshape(d, d)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    white = (x - x.mean(0)) @ vectors / np.sqrt(values)
    got = {}
    for r in out:
        got.setdefault(r["component"], []).append(r)
        assert r["n"] == n and r["identity_error"] <= 1e-4
    assert sorted(got) == list(range(1, k + 1))
    at = {i: row for row, i in enumerate(ids)}
    for c, rows in got.items():
        assert sorted(r["vec_id"] for r in rows) == sorted(ids)
        mine = np.array([r["whitened"] for r in sorted(rows, key=lambda r: at[r["vec_id"]])])
        want = white[:, c - 1]
        sign = np.sign(mine @ want)
        assert np.allclose(mine, sign * want, atol=1e-6)
        assert np.isclose(rows[0]["explained"], values[c - 1] / np.trace(cov), rtol=1e-6)
    sums = [int(s) for s in x.sum(0)]
    for r in got[1]:
        assert r["deviation"] == sum((n * int(v) - s) ** 2 for v, s in zip(x[at[r["vec_id"]]], sums))


def test_factors_of_known_matrices():
    rng = np.random.default_rng(4)
    for d, rank in ((1, 1), (5, 5), (12, 4), (64, 64)):
        b = rng.normal(size=(d, rank)) * np.logspace(0, -4, rank)
        a = b @ b.T
        low, order = whitening.pivoted_cholesky(a)
        assert np.allclose(low @ low.T, a[np.ix_(order, order)], atol=1e-12)
        assert np.allclose(low, np.tril(low)[:, :low.shape[1]])
        values, vectors, trace = whitening.factors(a * 3, 3, d)
        want = np.linalg.eigvalsh(a)[::-1][:len(values)]
        assert np.allclose(values, want, rtol=1e-6, atol=1e-12 * want[0]) and np.isclose(trace, np.trace(a))
        assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-7)
    assert len(whitening.factors(np.zeros((3, 3)), 1)[0]) == 0


def test_query_against_numpy(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    out = queries.op12_embedding_whitening(spark, SF).collect()
    usable = [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    check(out, whole([r[1] for r in usable]), [r[0] for r in usable], 8)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, 1.0, -2.0]), (2, [0.25, -1.0, 3.0]), (3, [0.125, 5.0, 1.0]), (4, [-0.5, 2.0, 0.0]), (9, [7.0, 2.0, 0.5])]
    bad = [(5, None), (6, []), (7, [1.0, None, 2.0]), (8, [1.0, nan, 2.0]), (10, [inf, 1.0, 1.0]), (11, [1.0, 2.0]),
           (None, [1e30, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in good + bad], SCHEMA + ", whitened string, n int")
    out = whitening.whiten_all(whitening.whole_vectors(df)).collect()
    check(out, whole([v for _, v in good]), [i for i, _ in good], 3)
    assert whitening.whiten_all(whitening.whole_vectors(df.limit(0))).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0])] * 3, SCHEMA)
    assert whitening.whiten_all(whitening.whole_vectors(one)).count() == 0
    line = spark.createDataFrame([(None, [1.0, 2.0]), (None, [1.0, 2.0]), (3, [2.0, 4.0])], SCHEMA)
    assert sorted(r["component"] for r in whitening.whiten_all(whitening.whole_vectors(line)).collect()) == [1, 1, 1]


def test_deviations_stay_exact():
    x = np.array([[2 ** 40, 5], [3, -2 ** 40]])
    sums = [int(s) for s in x.sum(0)]
    want = [sum((2 * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    assert whitening.deviations(x, 2, sums) == [w if w < 2 ** 63 else None for w in want]
    n = 2_000_000
    x = np.array([[100_001, 99_990], [100_300, 100_000]])
    sums = [100_000 * n + 7, 99_995 * n + 3]
    want = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    assert whitening.deviations(x, n, sums) == want
