"""Periodic runs of words, by an enhanced suffix array.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical) and a length of at least ``max(MIN_WORDS, MIN_COPIES * q)``, that
no neighbouring word extends keeping period q. All runs of a slice of texts are
found together, in numpy arrays:

1. the suffix array by prefix doubling: the text's number is part of the first
   rank, so suffixes of different texts never meet, and only suffixes that are
   not yet unique are sorted again; the ranks of every doubling are held;
2. the LCP of neighbouring suffixes, by descending through those ranks;
3. the LCP intervals, from the nearest smaller LCP values on either side: each
   is an inner node of the suffix tree, which is never built;
4. the branching-tandem test: for an interval of depth d, each suffix i of every
   child but the largest looks up whether ISA[i + d] or ISA[i - d] lies in the
   interval and outside its own child. Then the d words twice in a row are a
   square that the next word doesn't continue;
5. each such square ends a repetition: it is rotated to the left while the word
   before it equals its last word (again by descent through the ranks). Squares
   of a multiple of a period merge with the run of the same bounds.

A word of a run occurs at least ``MIN_COPIES`` times in its text, so rarer words
get a rank of their own at once; an interval that holds a run's square has at
least ``MIN_COPIES`` suffixes. Both prune without losing a run.

One pass over the texts, no shuffle, nothing is sent to the driver. Memory: a
slice of about ``SLICE`` bytes of text, or one longer text, with four bytes a
word and doubling; there are as many doublings as the longest repeat of a text
has binary digits.

Defined cases: a null text has no words; texts without a word or a run give an
empty list; the collapsed text of a text without a run is its words joined by
one space; repeated rows and null ids each give a row; extra columns are not
read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import byte_texts, map_slices

MIN_WORDS = 6
MIN_COPIES = 4
SLICE = 2 << 20
_AT_ONCE = 1 << 20  # suffixes tested at once


def suffix_ranks(codes: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... codes; the last are the inverse suffix array.

    Equal ranks mean equal codes. ``codes`` ends with a code that no other place has.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    first = np.r_[True, codes[order][1:] != codes[order][:-1]]
    head = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int32)
    rank[order] = head
    levels, step = [rank], 1
    active = order[~(first & np.r_[first[1:], True])]
    while len(active):
        key = rank[active].astype(np.int64) * (n + 1) + rank[active + step]
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        old, at = rank[active], np.arange(len(active))
        fresh = np.r_[True, old[1:] != old[:-1]]
        first = np.r_[True, key[1:] != key[:-1]]
        offset = np.maximum.accumulate(np.where(first, at, 0)) - np.maximum.accumulate(np.where(fresh, at, 0))
        rank = rank.copy()
        rank[active] = old + offset
        levels.append(rank)
        active, step = active[~(first & np.r_[first[1:], True])], step * 2
    return levels


def common_prefix(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many codes the suffixes at a and b (a != b) share."""
    length = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        length += (levels[k][a + length] == levels[k][b + length]).astype(np.int64) << k
    return length


def common_suffix(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many codes before a equal those before b (a < b)."""
    length = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        at = a - length - (1 << k)
        inside = np.maximum(at, 0)
        same = (at >= 0) & (levels[k][inside] == levels[k][inside + (b - a)])
        length += same.astype(np.int64) << k
    return length


def lcp_intervals(lcp: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last suffix number of the interval of depth ``lcp[j]`` around each boundary j of ``places``.

    ``lcp[j]`` belongs to the suffixes numbered j - 1 and j; ``lcp[0]`` is 0.
    """
    n, depth = len(lcp), lcp[places]
    breaks = np.flatnonzero(lcp == 0)
    widest = int(np.diff(np.r_[breaks, n]).max(initial=1))
    least = [lcp]  # least[k][j]: the smallest of 2 ** k values from j on
    while (1 << len(least)) <= widest:
        half = 1 << (len(least) - 1)
        least.append(np.minimum(least[-1][:-half], least[-1][half:]))
    right, left = places.copy(), places.copy()
    for k in range(len(least) - 1, -1, -1):
        inside = right + (1 << k) <= n
        right += np.where(inside & (least[k][np.where(inside, right, 0)] >= depth), 1 << k, 0)
        inside = left - (1 << k) >= 0
        left -= np.where(inside & (least[k][np.where(inside, left - (1 << k), 0)] >= depth), 1 << k, 0)
    return left - 1, right - 1


def branching_squares(levels: list[np.ndarray], min_copies: int = MIN_COPIES) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of squares not continued by the next code, in intervals of ``min_copies`` suffixes or more."""
    isa = levels[-1].astype(np.int64)
    n = len(isa)
    sa = np.empty(n, np.int64)
    sa[isa] = np.arange(n)
    none = np.zeros(0, np.int64)
    near = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1
    if not len(near):
        return none, none
    lcp = np.zeros(n, np.int64)
    lcp[near] = common_prefix(levels, sa[near - 1], sa[near])
    lo, hi = lcp_intervals(lcp, near)
    wide = hi - lo + 1 >= min_copies
    near, lo, hi = near[wide], lo[wide], hi[wide]
    if not len(near):
        return none, none
    depth = lcp[near]
    by = np.lexsort((near, depth, lo))
    near, lo, hi, depth = near[by], lo[by], hi[by], depth[by]
    # children of an interval: from its first suffix or a boundary of its depth to the next one
    first = np.r_[True, (lo[1:] != lo[:-1]) | (depth[1:] != depth[:-1])]
    opens = np.flatnonzero(first)
    node = np.cumsum(first) - 1
    at = np.arange(len(near)) + node + 1  # place of the child that begins at the boundary
    total = len(near) + len(opens)
    begin, of = np.empty(total, np.int64), np.empty(total, np.int64)
    begin[at], of[at] = near, node
    begin[at[opens] - 1], of[at[opens] - 1] = lo[opens], np.arange(len(opens))
    last = np.r_[of[1:] != of[:-1], True]
    end = np.where(last, hi[opens][of], np.r_[begin[1:], 0] - 1)
    size = end - begin + 1
    heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    largest = np.maximum.reduceat(size, heads)
    big = size == largest[of]
    seen = np.cumsum(big)
    big &= seen - (seen[heads] - big[heads])[of] == 1  # of equally large ones the first
    child = np.flatnonzero(~big)
    ends = np.cumsum(size[child])
    found, start = [], 0
    while start < len(child):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + _AT_ONCE, "right")))
        own = child[start:stop]
        rep = np.repeat(own, size[own])
        number = np.arange(len(rep)) - np.repeat(np.cumsum(size[own]) - size[own], size[own]) + begin[rep]
        place, d = sa[number], depth[opens][of[rep]]
        low, high = lo[opens][of[rep]], hi[opens][of[rep]]
        for way in (1, -1):
            other = place + way * d
            inside = (other >= 0) & (other < n)
            rank = isa[np.where(inside, other, 0)]
            hit = inside & (rank >= low) & (rank <= high) & ((rank < begin[rep]) | (rank > end[rep]))
            found.append(np.stack([np.minimum(place, other)[hit], d[hit]]))
        start = stop
    if not found:
        return none, none
    squares = np.unique(np.concatenate(found, axis=1), axis=1)
    return squares[0], squares[1]


def find_runs(words: np.ndarray, counts: np.ndarray, min_words: int = MIN_WORDS,
              min_copies: int = MIN_COPIES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs, by text, start and period.

    ``words`` are the numbers of all words, ``counts`` how many each text has.
    """
    n_texts, n_words = len(counts), len(words)
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    if not n_words:
        return none
    text = np.repeat(np.arange(n_texts), counts)
    spread = int(words.max()) + 1
    pairs = text * spread + words
    _, code, often = np.unique(pairs, return_inverse=True, return_counts=True)
    rare = often[code] < min_copies
    code = np.where(rare, len(often) + np.arange(n_words), code)
    # a code of its own after each text
    place = np.arange(n_words) + text
    codes = np.empty(n_words + n_texts, np.int64)
    ends = np.cumsum(counts) + np.arange(n_texts)
    codes[place] = code
    codes[ends] = len(often) + n_words + np.arange(n_texts)
    levels = suffix_ranks(codes)
    at, period = branching_squares(levels, min_copies)
    if not len(at):
        return none
    rotated = common_suffix(levels, at, at + period)
    start, length = at - rotated, rotated + 2 * period
    good = length >= np.maximum(min_words, min_copies * period)
    start, length, period = start[good], length[good], period[good]
    by = np.lexsort((period, length, start))
    start, length, period = start[by], length[by], period[by]
    if not len(start):
        return none
    least = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])]
    start, length, period = start[least], length[least], period[least]
    by = np.lexsort((period, start))
    start, length, period = start[by], length[by], period[by]
    of = np.searchsorted(ends, start, "left")
    return of, start - (ends - counts)[of], length, period


def _numbers(words: list[bytes]) -> np.ndarray:
    return pa.array(words, pa.large_binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _collapsed(words: list[bytes], starts, lengths, periods) -> bytes:
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, starts + periods, 1)
    np.add.at(change, starts + lengths, -1)
    keep = np.cumsum(change)[:-1] == 0
    return b" ".join([words[k] for k in np.flatnonzero(keep).tolist()])


def periodic_runs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_words: int = MIN_WORDS, min_copies: int = MIN_COPIES) -> DataFrame:
    """One row per document row: doc_id, n_words, runs (start, length, period; by start, then period), collapsed.

    Words are parted by ASCII white space and numbered from 0. ``collapsed`` has
    the words joined by one space, of each run only the first period.
    """
    id_type = documents.schema[id_col].dataType.simpleString()
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [t.split() for t in byte_texts(batch.column(1))]
        counts = np.array([len(w) for w in words], np.int64)
        of, *run = find_runs(_numbers([w for own in words for w in own]), counts, min_words, min_copies)
        bounds = np.searchsorted(of, np.arange(len(words) + 1)).tolist()
        texts = [b" ".join(w) if a == b else _collapsed(w, *(v[a:b] for v in run))
                 for w, a, b in zip(words, bounds, bounds[1:])]
        parts = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in run], ["start", "length", "period"])
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), parts),
             pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return map_slices(docs, kernel, f"doc_id {id_type}, n_words long, "
                      "runs array<struct<start:long,length:long,period:long>>, collapsed string", limit=SLICE)


def run_digests(found: DataFrame) -> DataFrame:
    """Per document: n_runs, the greatest run (ties: smallest start, then period) and digests of runs and text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))), "\n")
    rows = found.withColumn("best", best).withColumn("lines", F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.encode("lines", "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"))
