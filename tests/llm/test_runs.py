"""Periodic runs: brute force over every period, awkward rows, digests of the query."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tessera.llm import queries, runs

DOCS = "doc_id long, text string"


def brute_runs(words):
    """Every maximal stretch with equal words q apart, by its smallest q."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def some_text(rng):
    k = rng.choice([1, 2, 3, 8])
    words = [rng.choice("abcdefgh"[:k]) for _ in range(rng.randint(0, 50))]
    if rng.random() < 0.6:
        root = [rng.choice("abcdefgh"[:k]) for _ in range(rng.randint(1, 7))]
        at = rng.randint(0, len(words))
        words[at:at] = (root * 12)[:rng.randint(1, 60)]
    return words


def test_runs_of_a_slice_equal_brute_force():
    rng = random.Random(11)
    for _ in range(400):
        texts = [some_text(rng) for _ in range(rng.randint(1, 7))]
        numbers = np.array([ord(w) for t in texts for w in t], np.int64)
        got = zip(*(v.tolist() for v in runs.find_runs(numbers, np.array([len(t) for t in texts]))))
        assert list(got) == [(k, *r) for k, t in enumerate(texts) for r in brute_runs(t)]


@pytest.mark.parametrize("least, copies", [(2, 2), (6, 3)])
def test_other_bounds(least, copies):
    words = np.array([ord(c) for c in "xabababyzzzq"], np.int64)
    got = [tuple(int(v) for v in r) for r in zip(*runs.find_runs(words, np.array([12]), least, copies))]
    want = [(0, 1, 6, 2)] + ([(0, 8, 3, 1)] if least == 2 else [])
    assert got == want


def test_suffix_ranks_and_prefixes():
    codes = np.array([1, 2, 1, 2, 1, 9])
    levels = runs.suffix_ranks(codes)
    order = sorted(range(6), key=lambda i: codes[i:].tolist())
    assert np.argsort(levels[-1]).tolist() == order
    assert runs.common_prefix(levels, np.array([0, 1, 0]), np.array([2, 3, 1])).tolist() == [3, 2, 0]
    assert runs.common_suffix(levels, np.array([3, 2]), np.array([5, 3])).tolist() == [3, 0]


def test_smaller_batches_of_tests_find_the_same(monkeypatch):
    rng = random.Random(2)
    words = np.array([rng.randrange(2) for _ in range(3000)], np.int64)
    want = runs.find_runs(words, np.array([3000]))
    monkeypatch.setattr(runs, "_AT_ONCE", 7)
    got = runs.find_runs(words, np.array([3000]))
    assert all((a == b).all() for a, b in zip(got, want)) and len(want[0])


def test_odd_rows(spark):
    long = "w " * 60_000
    rows = [(None, "a " * 9), (1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "a b " * 4), (5, "a b " * 4), (6, long),
            (7, "  \x00 ü " * 5)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS + ", n_words int, runs string")
    out = runs.periodic_runs(df).collect()
    assert [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]]) for r in out] == [
        (None, 9, [(0, 9, 1)]), (1, 0, []), (2, 0, []), (3, 0, []), (4, 1, []), (5, 8, [(0, 8, 2)]), (5, 8, [(0, 8, 2)]),
        (6, 60_000, [(0, 60_000, 1)]), (7, 15, [(0, 15, 3)])]
    assert [r["collapsed"] for r in out] == ["a", "", "", "", "a", "a b", "a b", "w", "  \x00 ü"]
    assert runs.periodic_runs(df.limit(0)).count() == 0
    digests = {r["doc_id"]: r for r in runs.run_digests(runs.periodic_runs(df)).collect()}
    assert digests[1]["start"] is None and digests[1]["runs_sha256"] == hashlib.sha256(b"").hexdigest()


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    for row in queries.op13_periodic_runs(spark, sf).join(
            spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "doc_id").collect():
        words, h = (row["text"] or "").encode().split(), zlib.crc32(str(row["doc_id"]).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        found = brute_runs(words)
        assert row["n_runs"] == len(found)
        assert row["runs_sha256"] == hashlib.sha256("".join("%d,%d,%d\n" % r for r in found).encode()).hexdigest()
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        assert row["collapsed_sha256"] == hashlib.sha256(kept).hexdigest()
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        assert (row["start"], row["length"], row["period"]) == best
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
