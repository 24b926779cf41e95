"""Packing: ids against the tokenizers library, plans against exact counts and bounds, gapless places."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import packing, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
FILES = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def own_ids(text, library=Tokenizer.from_file(FILES[0])):
    return library.encode(text or "", add_special_tokens=False).ids + [0]


def check_places(rows, capacity=2048):
    """Sequences are filled from 0 without a gap, none over capacity."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return by


def test_ids_are_those_of_the_library():
    rng, own = random.Random(3), packing.encoder(*FILES)
    texts = ["", "I'll   go\n\n now<|endoftext|> it's <|endoftext|>", "x" * 20_000, " " * 5000 + "a", "  　 é中文😀\x85\x1c١٢"]
    texts += ["".join(chr(rng.choice([rng.randrange(128), rng.randrange(0x3000), rng.randrange(0xE000, 0x2FFFF)])) for _ in range(60))
              for _ in range(300)]
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    for t in texts:
        assert own.ids(t).tolist() + [0] == own_ids(t), t


def test_piece_bounds():
    assert packing.piece_bounds(5, 4) == [(0, 1), (1, 5)]
    assert packing.piece_bounds(8, 4) == [(0, 4), (4, 8)]
    assert packing.piece_bounds(1, 4) == [(0, 1)]


def fewest(sizes, capacity):
    """Exact bin packing of a few items."""
    best = [len(sizes)]

    def put(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + sizes[k] <= capacity and bins[i] not in bins[:i]:
                put(k + 1, bins[:i] + [bins[i] + sizes[k]] + bins[i + 1:])
        put(k + 1, bins + [sizes[k]])

    put(0, [])
    return best[0]


def test_plans_cover_counts_and_respect_the_bound():
    rng = random.Random(5)
    for _ in range(60):
        capacity = rng.choice([10, 16, 30])
        sizes = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        lengths, counts = np.unique(sizes, return_counts=True)
        plan = packing.pack(lengths, counts, capacity)
        got = np.zeros(len(lengths), int)
        for at, row, times in plan.configurations:
            assert times > 0 and (lengths[at] * row).sum() <= capacity
            got[at] += row * times
        least = fewest(sizes, capacity)
        assert (got == counts).all() and plan.bound <= least + 1e-9 and plan.sequences <= least + 1


@pytest.mark.parametrize("shape", ["mixed", "hot", "long"])
def test_large_histograms_come_close_to_the_bound(shape):
    rng = np.random.default_rng(6)
    sizes = {"mixed": np.minimum(rng.geometric(1 / 600, 40_000), 2048),
             "hot": np.concatenate([np.full(20_000, 700), rng.integers(1, 2048, 20_000)]),
             "long": rng.integers(600, 2048, 20_000)}[shape]
    lengths, counts = np.unique(sizes, return_counts=True)
    plan = packing.pack(lengths, counts)
    keep = lengths < 2048
    plain = sum(m for *_, m in packing.best_fit(lengths[keep], counts[keep], 2048)) + counts[~keep].sum()
    assert plan.bound <= plan.sequences <= 1.002 * plain
    if shape == "mixed":
        assert plan.sequences <= 1.001 * plan.bound + 1
    assert len(plan.configurations) <= 2 * len(lengths) + 1


def test_query_places_every_token(spark):
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op11_best_fit_packing(spark, SF).collect()
    mine = defaultdict(list)
    for r in rows:
        mine[r["doc_id"]].append(r)
    assert set(mine) == set(docs)
    for doc, pieces in mine.items():
        ids, at = np.array(own_ids(docs[doc]), "<u4"), 0
        assert len(pieces) == -(-len(ids) // 2048)
        for k, r in enumerate(sorted(pieces, key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and (k == 0 or r["length"] == 2048)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"]:at].tobytes())
        assert at == len(ids)
    assert len(check_places(rows)) <= 1.02 * sum(r["length"] for r in rows) / 2048 + 1


def test_odd_rows(spark):
    rows = [(None, "no id"), (1, None), (2, ""), (3, " \n"), (5, "twin"), (5, "twin"), (6, "word " * 9000), (7, "x" * 70_000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS + ", length int, part string").repartition(3)
    out = packing.pack_documents(df, *FILES, with_ids=True).collect()
    check_places(out)
    assert sorted(r["doc_id"] or 0 for r in out if r["piece"] == 0) == [0, 1, 2, 3, 5, 5, 6, 7]
    assert [r["ids"] for r in out if r["doc_id"] in (1, 2)] == [[0], [0]]
    for doc, text in rows:
        if doc and doc != 5:
            found = sum((r["ids"] for r in sorted(out, key=lambda r: r["piece"]) if r["doc_id"] == doc), [])
            assert found == own_ids(text)
    assert packing.pack_documents(df.limit(0), *FILES).count() == 0
