"""Block-grid top-k equals brute force; plans hold no cross join."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import blocks
from tessera.operators import similarity as S


def brute_topk(scores, qkeys, bkeys, ties, k, valid=None):
    out = {}
    r = np.round(scores, 6)
    for i, q in enumerate(qkeys):
        c = [(-r[i, j], ties[j], bkeys[j]) for j in range(len(bkeys)) if valid is None or valid[i, j]]
        c.sort()
        out[q] = [(b, -s) for s, _, b in c[:k]]
    return out


def spark_topk(df, q_key, b_key):
    out = {}
    for r in df.orderBy(q_key, "rank").collect():
        out.setdefault(r[q_key], []).append((r[b_key], round(r["sim"], 6)))
    return out


@pytest.mark.parametrize("block_rows,include_self", [(7, True), (7, False), (1000, True)])
def test_dense_grid_equals_brute_force(spark, block_rows, include_self):
    rng = np.random.default_rng(1)
    n, d = 60, 5
    vecs = rng.integers(-2, 3, size=(n, d)).astype(float)  # many exact ties
    vecs[3] = 0.0  # a zero vector scores 0 with everything
    rows = [(i, vecs[i].tolist()) for i in range(n)]
    q = spark.createDataFrame(rows, "q long, v array<double>")
    b = spark.createDataFrame(rows, "b long, v array<double>")
    got = spark_topk(S.vector_topk(q, b, q_key="q", b_key="b", q_vec="v", b_vec="v", k=4,
                                   include_self=include_self, block_rows=block_rows), "q", "b")
    u = np.array([x / np.linalg.norm(x) if np.linalg.norm(x) else x for x in vecs])
    valid = None if include_self else ~np.eye(n, dtype=bool)
    want = brute_topk(u @ u.T, list(range(n)), list(range(n)), list(range(n)), 4, valid)
    assert got == want


def test_sparse_grid_pads_with_zero_by_tie_order(spark):
    q = spark.createDataFrame([(1, "red fox"), (2, "zzz"), (3, None)], "q long, t string")
    b = spark.createDataFrame(
        [(10, "red red fox", 5), (11, "blue fox", 1), (12, "green", 0), (13, "grey", 2)],
        "b long, t string, pos long")
    got = spark_topk(S.sparse_topk(q, b, q_key="q", b_key="b", q_text="t", b_text="t", k=3,
                                   tie_cols=["pos"]), "q", "b")
    # q1: cos with "red red fox" = 3/sqrt(2*5), with "blue fox" = 1/2
    assert got[1] == [(10, round(3 / np.sqrt(10), 6)), (11, 0.5), (12, 0.0)]
    # no shared word: zero scores, first positions first
    assert got[2] == [(12, 0.0), (11, 0.0), (13, 0.0)]
    assert got[3] == [(12, 0.0), (11, 0.0), (13, 0.0)]


def test_grouped_grid_splits_a_hot_group(spark):
    rng = np.random.default_rng(2)
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    rows = []
    for i in range(120):
        g = 0 if i < 80 else i % 5  # group 0 holds two thirds of all rows
        rows.append((i, g, " ".join(rng.choice(words, size=3))))
    q = spark.createDataFrame(rows, "q long, g long, t string")
    b = spark.createDataFrame(rows, "b long, g long, t string")
    got = spark_topk(S.sparse_topk(q, b, q_key="q", b_key="b", q_text="t", b_text="t", k=2,
                                   group="g"), "q", "b")
    toks = [r[2].split() for r in rows]
    vocab = sorted(set(words))
    m = np.array([[t.count(w) for w in vocab] for t in toks], dtype=float)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    same = np.array([[r1[1] == r2[1] for r2 in rows] for r1 in rows])
    want = brute_topk(u @ u.T, list(range(120)), list(range(120)), list(range(120)), 2, same)
    assert got == want


def test_keyword_gate_fallback_and_stats(spark):
    q = spark.createDataFrame([(1, "the red car"), (2, "zebra")], "q long, t string")
    b = spark.createDataFrame([(10, "a red bus", 1, 2), (11, "the car", 2, 1), (12, "blue", 3, 1)],
                              "b long, t string, pos long, n_dup long")
    got = spark_topk(S.keyword_gate(q, b, q_key="q", b_key="b", q_text="t", b_text="t", k=2, tie_cols=["pos"]), "q", "b")
    # q1 keyword "car": only "the car" keeps its score, others score 0
    assert got[1][0][0] == 11 and got[1][1] == (10, 0.0)
    # q2 keyword "zebra" in no example: fallback to plain scores (all 0 here)
    assert got[2] == [(10, 0.0), (11, 0.0)]
    st = S.keyword_stats(q, b, b_key="b", q_text="t", b_text="t", weight_col="n_dup").first()
    assert (st.total_hits, st.fallbacks) == (1, 1)


@pytest.mark.parametrize("n", [1, 2])
def test_keyword_rows_equal_contains(spark, n):
    rng = np.random.default_rng(9)
    parts = ["ab", "abc", "b", "cab", "Abcab", "c_d", "é1", "-", "x"]
    text = lambda: " ".join(rng.choice(parts, size=int(rng.integers(0, 6))))
    q = spark.createDataFrame([(k, text()) for k in range(40)] + [(99, None)], "q long, t string")
    b = spark.createDataFrame([(k, text()) for k in range(60)] + [(99, None)], "b long, t string")
    got = {(r["_kw"], r["b"]) for r in S.keyword_rows(q, b, b_key="b", q_text="t", b_text="t", n=n).collect()}
    kws = {r[0] for r in q.select(S.min_ngram("t", n)).collect() if r[0]}
    assert got == {(k, r["b"]) for r in b.collect() for k in kws if k in (r["t"] or "").lower()}


def test_local_topk_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(200):
        nq, nb = rng.integers(1, 9), rng.integers(1, 12)
        s = rng.integers(0, 3, size=(nq, nb)) / 3.0
        valid = rng.random((nq, nb)) > 0.3
        tie = rng.permutation(nb)
        k = int(rng.integers(1, 5))
        qi, bi, v = blocks.local_topk(s, valid, tie, k)
        want = brute_topk(s, list(range(nq)), list(range(nb)), tie, k, valid)
        got = {}
        for a, b_, x in zip(qi, bi, v):
            got.setdefault(int(a), []).append((int(b_), float(x)))
        assert {q: w for q, w in want.items() if w} == got


def test_plan_has_no_cross_join(spark):
    from tessera.plans import strategies
    df = strategies.nl_topk(spark, "/root/testdata/sf0.001", 2)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_fewshot_random_is_reproducible(spark):
    e = spark.range(30).withColumnRenamed("id", "k")
    a = S.fewshot_random(e.withColumnRenamed("k", "q"), e.withColumnRenamed("k", "b"),
                         q_key="q", b_key="b", k=3, seed=7)
    b = S.fewshot_random(e.withColumnRenamed("k", "q"), e.withColumnRenamed("k", "b"),
                         q_key="q", b_key="b", k=3, seed=7)
    assert sorted(a.collect()) == sorted(b.collect())
    assert a.count() == 90
    assert a.filter("q = b").count() == 0 and a.select("q", "b").distinct().count() == 90
    every = S.fewshot_random(e.withColumnRenamed("k", "q"), e.withColumnRenamed("k", "b"),
                             q_key="q", b_key="b", k=50, seed=7)
    assert every.count() == 30 * 29  # a bank smaller than k is given whole


def test_dedup_keeps_last_values_first_position(spark):
    b = spark.createDataFrame([(1, "Same Q", "c1"), (2, "other", "c2"), (3, "same q", "c3")],
                              "seq long, question string, code string")
    d = {r.nl: r for r in S.bank_dedup_last(b, "question", ["seq"]).collect()}
    assert d["same q"].code == "c3" and d["same q"].first_seq == 1 and d["same q"].n_dup == 2


@pytest.mark.parametrize("exclude_self", [False, True])
def test_packed_small_groups_equal_brute_force(spark, exclude_self):
    rng = np.random.default_rng(4)
    words = ["a1", "b2", "c3", "d4"]
    rows = []
    for i in range(150):
        g = int(rng.integers(0, 40))  # many tiny groups share packs
        n = int(rng.integers(0, 3))
        rows.append((i, g, " ".join(rng.choice(words, size=n)) if n else None, int(rng.integers(0, 3))))
    q = spark.createDataFrame(rows, "q long, g long, t string, pos long")
    b = spark.createDataFrame(rows, "b long, g long, t string, pos long")
    got = spark_topk(S.sparse_topk(q, b, q_key="q", b_key="b", q_text="t", b_text="t", k=3,
                                   group="g", tie_cols=["pos"], exclude_self=exclude_self), "q", "b")
    vocab = sorted(set(words))
    m = np.array([[(r[2] or "").split().count(w) for w in vocab] for r in rows], dtype=float)
    norm = np.linalg.norm(m, axis=1)
    dots = m @ m.T
    den = norm[:, None] * norm[None, :]
    sim = np.where(den > 0, dots / np.where(den > 0, den, 1), 0.0)
    valid = np.array([[r1[1] == r2[1] for r2 in rows] for r1 in rows])
    if exclude_self:
        valid &= ~np.eye(len(rows), dtype=bool)
    ties = [(r[3], r[0]) for r in rows]
    want = brute_topk(sim, [r[0] for r in rows], [r[0] for r in rows], ties, 3, valid)
    assert got == {k: v for k, v in want.items() if v}


def test_token_topk_with_repeated_texts_equals_brute_force(spark):
    """Distinct bags stand for all their rows; ties go by key."""
    rng = np.random.default_rng(6)
    words = ["aa", "bb", "cc", "dd", "ee", "ff"]
    rows = [(i, i % 4, " ".join(rng.choice(words, size=int(rng.integers(1, 6))))) for i in range(90)]
    q = spark.createDataFrame(rows, "q long, g long, t string")
    b = spark.createDataFrame(rows, "b long, g long, t string")
    m = np.array([[r[2].split().count(w) for w in words] for r in rows], dtype=float)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    keys = [r[0] for r in rows]
    got = spark_topk(S.sparse_topk(q, b, q_key="q", b_key="b", q_text="t", b_text="t", k=3),
                     "q", "b")
    assert got == brute_topk(u @ u.T, keys, keys, keys, 3)
    same = np.array([[r1[1] == r2[1] for r2 in rows] for r1 in rows])
    got_g = spark_topk(S.sparse_topk(q, b, q_key="q", b_key="b", q_text="t", b_text="t", k=3,
                                     group="g"), "q", "b")
    assert got_g == brute_topk(u @ u.T, keys, keys, keys, 3, same)


def test_broadcast_scan_equals_grid_and_brute_force(spark):
    """A question side within one block is broadcast and the bank scanned in
    place (in chunks); the result equals the grid's and brute force."""
    rng = np.random.default_rng(8)
    qv = rng.integers(-2, 3, size=(5, 4)).astype(float)
    bv = rng.integers(-2, 3, size=(200, 4)).astype(float)
    q = spark.createDataFrame([(i, qv[i].tolist()) for i in range(5)], "q long, v array<double>")
    b = spark.createDataFrame([(100 + i, bv[i].tolist()) for i in range(200)], "b long, v array<double>")
    kern = blocks.dense_kernel("v", "v")
    scan = blocks.grid_scores(q, b, q_key="q", b_key="b", kernel=kern, k=4, block_rows=8)
    assert "MapInPandas" in scan._jdf.queryExecution().executedPlan().toString()
    grid = blocks.grid_scores(q, b, q_key="q", b_key="b", kernel=kern, k=4, block_rows=8,
                              broadcast_small=False)
    got_scan = spark_topk(blocks.merge_topk(scan, "q", "b", 4), "q", "b")
    got_grid = spark_topk(blocks.merge_topk(grid, "q", "b", 4), "q", "b")
    nq = lambda m: np.where(np.linalg.norm(m, axis=1, keepdims=True) > 0,
                            m / np.where(np.linalg.norm(m, axis=1, keepdims=True) > 0,
                                         np.linalg.norm(m, axis=1, keepdims=True), 1), 0)
    want = brute_topk(nq(qv) @ nq(bv).T, list(range(5)), list(range(100, 300)), list(range(200)), 4)
    assert got_scan == got_grid == want


def test_grid_merge_limits_before_the_shuffle(spark):
    rows = [(i, [float(i % 7), 1.0]) for i in range(50)]
    q = spark.createDataFrame(rows, "q long, v array<double>")
    b = spark.createDataFrame(rows, "b long, v array<double>")
    df = S.vector_topk(q, b, q_key="q", b_key="b", q_vec="v", b_vec="v", k=2, block_rows=8)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan  # 50 questions > one block: the grid
    assert re.search(r"WindowGroupLimit .*Partial", plan)


def test_large_grid_moves_each_row_once(spark, monkeypatch):
    """Beyond COPIED_AT_MOST rows are packed into blocks: not copied to tiles, with the same pairs for
    repeated keys, ties, a null key, null and bad vectors and tie columns that are strings."""
    rng = np.random.default_rng(12)
    vecs = [v.tolist() for v in rng.integers(-2, 3, size=(60, 4)).astype(float)] + [None, [], [None, 1.0, 1.0, 1.0], [1.0]]
    rows = [(i % 50 if i != 7 else None, f"t{i % 3}", v) for i, v in enumerate(vecs)]
    q = spark.createDataFrame(rows, "q long, t string, v array<double>")
    b = spark.createDataFrame(rows, "b long, t string, v array<double>")

    def run(include_self):
        top = S.vector_topk(q, b, q_key="q", b_key="b", q_vec="v", b_vec="v", k=3, tie_cols=["t"], block_rows=9,
                            include_self=include_self)
        pairs = S.vector_pairs_above(q, b, q_key="q", b_key="b", q_vec="v", b_vec="v", threshold=0.5)
        plan = top._jdf.queryExecution().executedPlan().toString()
        return plan, *[sorted(map(repr, df.collect())) for df in (top, pairs)]

    copied = [run(x) for x in (True, False)]
    monkeypatch.setattr(blocks, "COPIED_AT_MOST", 0)
    moved = [run(x) for x in (True, False)]
    assert [x[1:] for x in moved] == [x[1:] for x in copied]
    for plan, *_ in moved:
        assert "Generate" not in plan and "CoGroups" not in plan and re.search(r"WindowGroupLimit .*Partial", plan)


def test_token_topk_plan_is_built_in(spark):
    q = spark.createDataFrame([(1, "a b")], "q long, t string")
    b = spark.createDataFrame([(2, "b c")], "b long, t string")
    plan = S.sparse_topk(q, b, q_key="q", b_key="b", q_text="t", b_text="t", k=1)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Pandas", "Python", "Arrow", "sequence("))


def test_bad_vectors_score_zero(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.0, 0.0])], "q long, v array<double>")
    b = spark.createDataFrame([(11, [2.0, 0.0]), (12, None), (13, [5.0]), (14, [1.0, None]), (15, [float("nan"), 1.0])],
                              "b long, v array<double>")
    got = spark_topk(S.vector_topk(q, b, q_key="q", b_key="b", q_vec="v", b_vec="v", k=2), "q", "b")
    assert got == {1: [(11, 1.0), (12, 0.0)], 2: [(11, 0.0), (12, 0.0)], 3: [(13, 1.0), (11, 0.0)], 4: [(11, 0.0), (12, 0.0)]}


@pytest.mark.parametrize("sets", [False, True])
def test_bounds_give_the_scores_of_the_direct_join(spark, sets):
    """Both ways of scoring equal brute force, ties and repeated texts included."""
    rng = np.random.default_rng(21)
    vocab = [f"w{k}" for k in range(40)]
    share = 1.0 / np.arange(1, 41)
    text = lambda: " ".join(rng.choice(vocab, size=int(rng.integers(0, 9)), p=share / share.sum()))
    qs, bs = [text() for _ in range(25)], [text() for _ in range(70)]
    bs[30:36] = [bs[5]] * 6
    q = spark.createDataFrame(list(enumerate(qs)), "q long, t string")
    b = spark.createDataFrame(list(enumerate(bs)), "b long, t string")
    words = sorted(set(vocab))
    count = lambda texts: np.array([[(min(1, t.split().count(w)) if sets else t.split().count(w)) for w in words] for t in texts], float)
    mq, mb = count(qs), count(bs)
    dot, nq, nb = mq @ mb.T, (mq * mq).sum(1), (mb * mb).sum(1)
    with np.errstate(invalid="ignore", divide="ignore"):
        s = dot / (nq[:, None] + nb[None] - dot) if sets else dot / np.sqrt(nq)[:, None] / np.sqrt(nb)[None]
    want = brute_topk(np.nan_to_num(s), list(range(25)), list(range(70)), list(range(70)), 3)
    for direct in (None, 0):  # 0: by bounds
        got = spark_topk(S.token_topk(q, b, q_key="q", b_key="b", q_text="t", b_text="t", k=3, sets=sets, direct_rows=direct), "q", "b")
        assert got == want


def test_heads_share_a_constant(spark):
    rng = np.random.default_rng(22)
    head = lambda: "turn role text " + " ".join(rng.choice(["user", "text", "hello", "there", "role"], size=int(rng.integers(0, 4))))
    qs, bs = [head() for _ in range(20)] + ["", "other words"], [head() for _ in range(50)]
    q = spark.createDataFrame(list(enumerate(qs)), "q long, t string")
    b = spark.createDataFrame(list(enumerate(bs)), "b long, t string")
    cols = dict(q_key="q", b_key="b", q_text="t", b_text="t", k=2)
    assert spark_topk(S.head_topk(q, b, **cols), "q", "b") == spark_topk(S.token_topk(q, b, **cols), "q", "b")


def test_two_signals_on_texts_equal_brute_force(spark):
    rng = np.random.default_rng(23)
    gates = ["a1 b1 c1", "a1 b1 c1 d1", "x1 y1", "", "a1 b1"]
    rank = lambda: " ".join(rng.choice(["red", "fox", "blue", "sky"], size=3))
    qs = [(k, gates[k % 5], rank()) for k in range(15)]
    bs = [(k, gates[int(rng.integers(0, 5))], rank()) for k in range(40)]
    q = spark.createDataFrame(qs, "q long, g string, r string")
    b = spark.createDataFrame(bs, "b long, g string, r string")

    def cos(x, y):
        words = sorted(set(x.split()) | set(y.split()))
        u, v = (np.array([t.split().count(w) for w in words], float) for t in (x, y))
        return u @ v / np.sqrt(u @ u) / np.sqrt(v @ v) if u.sum() and v.sum() else 0.0

    s = np.array([[cos(x[2], y[2]) if cos(x[1], y[1]) > 0.8 else 0.0 for y in bs] for x in qs])
    got = spark_topk(S.threshold_rank_topk(q, b, q_key="q", b_key="b", q_gate="g", b_gate="g", q_rank="r", b_rank="r", k=3,
                                           threshold=0.8, kind="sparse"), "q", "b")
    assert got == brute_topk(s, list(range(15)), list(range(40)), list(range(40)), 3)


def test_row_selection_over_buckets_and_long_lines(spark, monkeypatch):
    monkeypatch.setattr(S, "ROW_BUCKET", 3)
    rng = np.random.default_rng(24)
    line = lambda: " ".join(rng.choice(["aa", "bb", "cc", "dd"], size=int(rng.integers(0, 6))))
    rows = [(t, k, line()) for t in ("x", "y", "z") for k in range(1 if t == "z" else 20)]
    df = spark.createDataFrame(rows, "table_id string, row_idx long, row_text string")
    qs = df.where("row_idx = 0").select("table_id", F.col("row_text").alias("question"))
    out = {r["table_id"]: r["text"] for r in S.select_rows(df, qs, k=4).collect()}
    monkeypatch.setattr(S, "IN_PLACE", 0)
    assert {r["table_id"]: r["text"] for r in S.select_rows(df, qs, k=4).collect()} == out
    from tessera.functions.literals import ROWSEP
    for t in ("x", "y", "z"):
        own = [r[2] for r in rows if r[0] == t]
        body = [(k, own[k]) for k in range(1, len(own))]
        words = ["aa", "bb", "cc", "dd"]
        vec = lambda s: np.array([s.split().count(w) for w in words], float)
        sim = lambda a, b: float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)) if a.any() and b.any() else 0.0
        best = sorted(body, key=lambda r: (-round(sim(vec(own[0]), vec(r[1])), 6), r[0]))[:4]
        assert out[t] == ROWSEP.join([own[0], *(r[1] for r in best)])


def zipf_texts(rng, n, most=9):
    vocab = [f"w{k}" for k in range(40)]
    share = 1.0 / np.arange(1, 41)
    return [" ".join(rng.choice(vocab, size=int(rng.integers(0, most)), p=share / share.sum())) for _ in range(n)]


@pytest.fixture
def tiled(monkeypatch):
    """Texts are scored in tiles of a few rows; counts the uses."""
    from tessera.operators import bags
    used, whole = [], bags.pairs_by_tiles
    monkeypatch.setattr(bags, "DIRECT_MOST", 0)
    monkeypatch.setattr(blocks, "DEFAULT_BLOCK_ROWS", 8)
    monkeypatch.setattr(blocks, "MAX_BLOCK_ROWS", 8)
    monkeypatch.setattr(bags, "pairs_by_tiles", lambda *a, **b: used.append(1) or whole(*a, **b))
    return used


@pytest.mark.parametrize("sets,group,exclude_self", [(False, False, False), (True, False, False), (False, True, True)])
def test_tiles_of_texts_equal_brute_force(spark, tiled, sets, group, exclude_self):
    rng = np.random.default_rng(31)
    bs = zipf_texts(rng, 60)
    bs[30:36] = [bs[5]] * 6
    qs = bs[:25]
    q = spark.createDataFrame([(i, i % 3, t) for i, t in enumerate(qs)], "q long, g long, t string")
    b = spark.createDataFrame([(i, i % 3, t) for i, t in enumerate(bs)], "b long, g long, t string")
    words = sorted({w for t in bs for w in t.split()})
    count = lambda texts: np.array([[(min(1, t.split().count(w)) if sets else t.split().count(w)) for w in words] for t in texts], float)
    mq, mb = count(qs), count(bs)
    dot, nq, nb = mq @ mb.T, (mq * mq).sum(1), (mb * mb).sum(1)
    with np.errstate(invalid="ignore", divide="ignore"):
        s = dot / (nq[:, None] + nb[None] - dot) if sets else dot / np.sqrt(nq)[:, None] / np.sqrt(nb)[None]
    valid = np.array([[(not group or i % 3 == j % 3) and not (exclude_self and i == j) for j in range(60)] for i in range(25)])
    got = spark_topk(S.token_topk(q, b, q_key="q", b_key="b", q_text="t", b_text="t", k=3, sets=sets,
                                  group="g" if group else None, exclude_self=exclude_self), "q", "b")
    assert tiled and got == brute_topk(np.nan_to_num(s), list(range(25)), list(range(60)), list(range(60)), 3, valid)


def test_table_heads_in_tiles_equal_the_direct_way(spark, tiled):
    rng = np.random.default_rng(32)
    heads = ["turn role text " + t for t in zipf_texts(rng, 60)]
    q = spark.createDataFrame(list(enumerate([*heads[:20], "", "other words"])), "q long, t string")
    b = spark.createDataFrame(list(enumerate(heads)), "b long, t string")
    got = spark_topk(S.head_topk(q, b, q_key="q", b_key="b", q_text="t", b_text="t", k=2), "q", "b")
    assert tiled and got == spark_topk(S.token_topk(q, b, q_key="q", b_key="b", q_text="t", b_text="t", k=2, direct_rows=0), "q", "b")


def test_keyword_gate_in_tiles_equals_the_direct_way(spark, tiled, monkeypatch):
    from tessera.operators import bags
    rng = np.random.default_rng(33)
    bs = zipf_texts(rng, 60)
    qs = [*zipf_texts(rng, 25), "", "zz w1 w2", "zz", "w39 w38"]
    q = spark.createDataFrame(list(enumerate(qs)), "q long, t string")
    b = spark.createDataFrame(list(enumerate(bs)), "b long, t string")
    names = dict(q_key="q", b_key="b", q_text="t", b_text="t", k=3)
    got = spark_topk(S.keyword_gate(q, b, **names), "q", "b")
    assert tiled
    monkeypatch.setattr(bags, "DIRECT_MOST", 1 << 22)
    assert got == spark_topk(S.keyword_gate(q, b, **names), "q", "b")


def stages_of(monkeypatch):
    """Names of the stages written from now on."""
    from tessera.operators import bags
    names, whole = [], bags.write_stage
    for module in (bags, blocks, S):
        monkeypatch.setattr(module, "write_stage", lambda df, name, **b: names.append(name) or whole(df, name, **b))
    return names


def test_gate_in_tiles_lists_no_bags_of_a_keyword_and_shuffles_no_blocks(spark, tiled, monkeypatch):
    rng = np.random.default_rng(36)
    monkeypatch.setattr(blocks, "COPIED_AT_MOST", 0)
    names = stages_of(monkeypatch)
    monkeypatch.setattr(blocks, "_packed", None)  # blocks of rows that lie together
    q = spark.createDataFrame(list(enumerate([*zipf_texts(rng, 25), "", "zz w1 w2", "zz"])), "q long, t string")
    b = spark.createDataFrame(list(enumerate([*zipf_texts(rng, 60), "xzzy w1"])), "b long, t string")
    got = spark_topk(S.keyword_gate(q, b, q_key="q", b_key="b", q_text="t", b_text="t", k=3), "q", "b")
    assert got[27][0] == (0, 0.0) and "grid-blocks" in names and "gate-hits" not in names
    assert len(got) == 28 and all(len(x) == 3 for x in got.values())


def test_containing_equals_a_search_in_each_word():
    from tessera.operators import bags
    keywords = pd.Series(["ab", None, "b1", "zz", "ab", "abc", "é_"])
    words = [np.array(x, dtype=object) for x in (["abc", "xab"], ["b1"], ["ab1", "qq"], ["aé_", "zz"], ["a"])]
    let_in = bags.containing(keywords, pd.Series(words))
    want = [[kw is None or any(kw in w for w in ws) for ws in words] for kw in keywords]
    assert np.vstack([let_in(slice(0, 3)), let_in(slice(3, 7))]).tolist() == want


def test_blocks_packed_in_place_hold_every_row_once(spark):
    df = spark.createDataFrame([(i, "x" * (i % 7)) for i in range(100)], "k long, t string").repartition(5).withColumn("_weight", F.length("t").cast("double"))
    rows = blocks._packed_in_place(df, 8, 100, 294.0, "_q").collect()
    assert sorted((r.k, r.t) for x in rows for r in x._q) == [(i, "x" * (i % 7)) for i in range(100)]
    assert len({x._qn for x in rows}) == len(rows) >= 8
    assert all(len(x._q) <= 13 and (sum(len(r.t) for r in x._q) <= 37 or len(x._q) == 1) for x in rows)


def test_small_groups_meet_in_place_and_large_ones_by_words(spark, monkeypatch):
    from tessera.operators import bags
    rng = np.random.default_rng(37)
    texts = [*zipf_texts(rng, 80), "w1 w1 w2", ""]
    q = spark.createDataFrame([(i, 0 if i < 20 else i % 9, t) for i, t in enumerate(texts)], "q long, g long, t string")
    b = spark.createDataFrame([(i, 0 if i < 20 else i % 7, t) for i, t in enumerate(texts)], "b long, g long, t string")
    names = dict(q_key="q", b_key="b", q_text="t", b_text="t", k=2, group="g")
    want = spark_topk(S.token_topk(q, b, **names, direct_rows=0), "q", "b")
    used = []
    monkeypatch.setattr(bags, "met_rows", lambda *a, whole=bags.met_rows: used.append(1) or whole(*a))
    assert spark_topk(S.token_topk(q, b, **names), "q", "b") == want and not used
    monkeypatch.setattr(bags, "DIRECT_ROWS", 0)
    monkeypatch.setattr(bags, "GROUP_PAIRS", 200)
    assert spark_topk(S.token_topk(q, b, **names), "q", "b") == want and used


def test_count_products_are_exact(monkeypatch):
    from tessera.operators import bags
    rng = np.random.default_rng(34)
    m = rng.integers(0, 4, size=(30, 50)) * (rng.random((30, 50)) < 0.2)
    m[3, 2] = 1 << 25  # beyond whole numbers of 32-bit floats
    lists = [[np.array([f"w{c}" for c in np.flatnonzero(r)], dtype=object) for r in m], [r[r > 0] for r in m]]
    monkeypatch.setattr(bags, "MET_AT_ONCE", 7)
    for dense, share in ((1024, 400), (0, 400), (1024, 5)):
        monkeypatch.setattr(bags, "DENSE_WORDS", dense)
        monkeypatch.setattr(bags, "DENSE_SHARE", share)
        dots = bags.count_products(lists[0][:20], lists[1][:20], *lists)
        assert (np.vstack([dots(slice(0, 7)), dots(slice(7, 20))]) == m[:20] @ m.T).all()
    got = bags.round_half_up(np.array([0.0078125, 3 / 128, 0.1234565, 0.5, 2 / 3]))
    assert got.tolist() == [0.007813, 0.023438, 0.123457, 0.5, 0.666667]


def test_ordered_topk_equals_local_topk(monkeypatch):
    monkeypatch.setattr(blocks, "FIRST_COLUMNS", 4)
    rng = np.random.default_rng(35)
    for _ in range(200):
        nq, nb, k = (int(rng.integers(1, top)) for top in (9, 40, 6))
        s = rng.integers(0, 5, size=(nq, nb)) / 3.0
        s[rng.random((nq, nb)) > 0.7] = -np.inf
        got, want = blocks.ordered_topk(s, k), blocks.local_topk(s, None, np.arange(nb), k)
        assert sorted(zip(*got)) == sorted(zip(*want))
