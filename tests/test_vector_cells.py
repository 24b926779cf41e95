"""The cell index equals brute force, skips far cells, and its probes reach the recall."""

import numpy as np
import pytest

from test_similarity import brute_topk, spark_topk
from tessera.operators import similarity as S
from tessera.operators import vector_cells as V

Q, B = "q long, v array<double>", "b long, v array<double>"


def cosine(a, b):
    """Written from the definition: 0 for bad vectors and for two lengths."""
    good = lambda v: v is not None and len(v) and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0
    if not good(a) or not good(b) or len(a) != len(b):
        return 0.0
    return float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))


def odd_rows():
    rng = np.random.default_rng(3)
    vecs = [v.tolist() for v in rng.integers(-2, 3, size=(70, 5)).astype(float)]  # many exact ties
    vecs += [[1.0, 2.0, 0.0, 0.0, 1.0]] * 40  # one vector holds a third of the rows
    vecs += [None, None, [], [0.0] * 5, [float("nan")] + [1.0] * 4, [None, 1.0, 1.0, 1.0, 1.0]]
    vecs += [[1.0], [-3.0], [2.0], [1.0, 1.0], [1.0, 0.0], [0.0, 0.0]]  # other widths
    order = rng.permutation(len(vecs))
    return [vecs[i] for i in order]


@pytest.mark.parametrize("include_self,cells,probes", [(True, 6, 1), (False, 6, 2), (False, 1, 1)])
def test_exact_search_equals_brute_force_on_odd_rows(spark, include_self, cells, probes):
    vecs = odd_rows()
    keys = list(range(len(vecs)))
    q = spark.createDataFrame(list(zip(keys, vecs)), Q)
    b = spark.createDataFrame([(k, v, "x") for k, v in zip(keys, vecs)], B + ", _group string")  # a clashing name
    got = spark_topk(V.exact_topk(q, b, q_key="q", b_key="b", q_vec="v", b_vec="v", k=4, include_self=include_self,
                                  cells=cells, probes=probes, block_rows=16), "q", "b")
    scores = np.array([[cosine(x, y) for y in vecs] for x in vecs])
    valid = None if include_self else ~np.eye(len(vecs), dtype=bool)
    assert got == brute_topk(scores, keys, keys, keys, 4, valid)


def test_far_cells_are_skipped(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    vecs = (centres[rng.integers(0, 12, 600)] + rng.normal(scale=0.1, size=(600, 16))).tolist()
    q = spark.createDataFrame([(i, v) for i, v in enumerate(vecs)], Q)
    b = spark.createDataFrame([(i, v) for i, v in enumerate(vecs)], B)
    names = dict(q_key="q", b_key="b", q_vec="v", b_vec="v", k=3, include_self=False)
    row = V.skipped_share(q, b, **names).first()
    assert row["n_pairs"] == 600 * 600 and row["skipped"] > 0.5
    assert spark_topk(V.exact_topk(q, b, **names), "q", "b") == spark_topk(S.vector_topk(q, b, **names), "q", "b")


def test_probes_reach_the_recall(spark):
    """Ids divisible by 100 against all rows, on vectors without any cluster."""
    from __spark_entry__ import queries
    sf = "/root/testdata/sf0.1"
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = e.filter("vec_id % 100 = 0").selectExpr("vec_id q", "embedding v")
    b = e.selectExpr("vec_id b", "embedding v")
    want = {(r["q"], r["b"]) for r in S.vector_topk(q, b, q_key="q", b_key="b", q_vec="v", b_vec="v", k=3,
                                                    include_self=False).collect()}
    got = {(r["q_vec"], r["b_vec"]) for r in queries()["vec_topk_probed"](spark, sf).collect()}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_pairs_above_equal_brute_force(spark):
    vecs = odd_rows()
    q = spark.createDataFrame(list(enumerate(vecs)), Q)
    b = spark.createDataFrame(list(enumerate(vecs)), B)
    names = dict(q_key="q", b_key="b", q_vec="v", b_vec="v")
    got = {(r["q"], r["b"], r["sim"]) for r in V.pairs_above(q, b, threshold=0.7, cells=6, block_rows=16, **names).collect()}
    want = {(i, j, round(cosine(x, y), 6)) for i, x in enumerate(vecs) for j, y in enumerate(vecs)}
    assert got == {w for w in want if w[2] >= 0.7}
    with pytest.raises(ValueError):
        V.pairs_above(q, b, threshold=0.0, **names)


@pytest.mark.parametrize("search", [V.exact_topk, V.probed_topk])
def test_empty_sides_and_no_direction(spark, search):
    some, none = [(1, [1.0, 2.0]), (2, None)], []
    names = dict(q_key="q", b_key="b", q_vec="v", b_vec="v", k=2)
    assert search(spark.createDataFrame(some, Q), spark.createDataFrame(none, B), **names).count() == 0
    assert search(spark.createDataFrame(none, Q), spark.createDataFrame(some, B), **names).count() == 0
    flat = spark.createDataFrame([(5, None), (4, [0.0, 0.0]), (6, [])], B)
    assert spark_topk(search(spark.createDataFrame(some, Q), flat, **names), "q", "b") == {
        1: [(4, 0.0), (5, 0.0)], 2: [(4, 0.0), (5, 0.0)]}
