"""Benchmark decontamination by Wu-Manber multi-pattern search.

The patterns are windows of ``window`` consecutive words of every benchmark
item (an item of fewer words, but not none, is one window). Texts and items
are lower-cased (A-Z) and their words joined by single spaces, with a space at
either end, so a byte match is a match of whole words.

Search (``WuManber``): a shift table by hash of a block of bytes tells how far
the search position may jump; where the shift is 0, the bucket of that suffix
hash gives the patterns to try; each is confirmed by a prefix test and then by
direct comparison of all its bytes. Many positions ("lanes") of a slice of
texts advance together in numpy.

Scale: the documents are read once and never shuffled. The pattern tables are
built from a measured number of benchmark bytes: up to ``block_bytes`` they
are one broadcast (about eight times as many bytes: 46 a window and the texts);
a larger benchmark is cut into blocks by a hash of its rows, each block is one
pass over the documents, and the hits of a text meet in one aggregation keyed by
the text (nothing is dropped). A single item text is never cut.

Defined cases: a null or empty text has no words and no hits; a null item
text has no windows; items that share an id count once; a null item id reads
``null``; repeated document rows each give a row; an empty documents table
gives no rows, an empty benchmark no hits; extra columns are not read, whatever
their names; a very long text is searched whole, and of a very long window the
first ``REACH`` bytes are in the tables and all are compared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import byte_texts, map_slices, slices

#: ASCII: A-Z to a-z, digits and letters kept, all else a separator; bytes from 0x80 belong to words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
              for c in range(256))
BLOCK_BYTES = 8 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _ranks(code: np.ndarray, n: int) -> np.ndarray:
    """Equal numbers for equal windows of n codes, at each place (those that reach beyond the end mean nothing).

    Windows of 1, 2, 4, ... codes are numbered in turn; n is the sum of some.
    """
    level, size = code, 1
    out, reach = None, 0
    while size <= n:
        if n & size:
            out, reach = (level, size) if out is None else (_pairs(out, level, reach), reach + size)
        level, size = _pairs(level, level, size), 2 * size
    return out


def _pairs(a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    later = np.concatenate([b[step:], np.full(min(step, len(b)), -1)])
    return np.unique(a * (int(b.max(initial=0)) + 2) + later + 1, return_inverse=True)[1]


class WuManber:
    """Pattern tables over windows of the given items.

    Windows are (offset, length) into one buffer of item texts, so memory
    follows the item text and not the number of windows times their length.
    """

    PAD = 8
    LANE = 256
    REACH = 1024

    def __init__(self, items: list[tuple[str, bytes]], window: int = 10):
        self.ids = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.ids)}
        buf, vocabulary, codes, counts, owner = bytearray(b"\0" * self.PAD), {}, [], [], []
        begins = []
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            begins.append(len(buf) + 1)
            buf += b" " + b" ".join(words) + b" \0"
            codes.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int64, len(words)))
            counts.append(len(words))
            owner.append(number[item_id])
        buf += b"\0" * self.PAD
        self.buf = bytes(buf)
        size = np.fromiter((len(w) for w in vocabulary), np.int64, len(vocabulary))
        code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        counts, owner = np.array(counts, np.int64), np.array(owner, np.int64)
        self._windows(code, counts, owner, np.array(begins, np.int64), size, window)
        # windows of few bytes would force short shifts on the others
        self.groups = [g for g in (np.flatnonzero(self.len < 16), np.flatnonzero(self.len >= 16)) if len(g)]
        self.tables = [self._table(g) for g in self.groups]

    def _windows(self, code, counts, owner, begins, size, window: int) -> None:
        """Distinct windows: offset and length in the buffer, words, and the items that have them."""
        item = np.repeat(np.arange(len(counts)), counts)
        first_word = np.cumsum(counts) - counts
        place = np.arange(len(code)) - first_word[item]
        step = size[code] + 1
        before = np.cumsum(step) - step
        start = begins[item] + before - before[first_word][item] if len(code) else np.zeros(0, np.int64)
        off, length, words, owners, owned = [], [], [], [], 0
        for n in sorted(set(np.minimum(counts, window).tolist())):
            whole = counts >= window if n == window else counts == n
            at = np.flatnonzero(whole[item] & (place + n <= counts[item]))
            _, one, same = np.unique(_ranks(code, n)[at], return_index=True, return_inverse=True)
            last = at[one] + n - 1
            off.append(start[at[one]] - 1)
            length.append(start[last] + step[last] - off[-1])
            words.append(np.full(len(one), n))
            owners.append(np.unique((same + owned) * (len(self.ids) + 1) + owner[item[at]]))
            owned += len(one)
        joined = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        self.off, self.len, self.n_words = joined(off, np.int64), joined(length, np.int64), joined(words, np.int32)
        pairs = joined(owners, np.int64)
        self.owner = (pairs % (len(self.ids) + 1)).astype(np.int32)
        self.owner_from = np.searchsorted(pairs // (len(self.ids) + 1), np.arange(owned + 1)).astype(np.int64)

    def owners(self, patterns: np.ndarray) -> list[int]:
        """Numbers of the items that have any of the windows."""
        own = [self.owner[self.owner_from[p]:self.owner_from[p + 1]] for p in np.unique(patterns).tolist()]
        return np.unique(np.concatenate(own)).tolist() if own else []

    @staticmethod
    def _view(buf: np.ndarray) -> np.ndarray:
        """The 8 bytes at every offset, as one number each."""
        return np.ndarray((max(0, len(buf) - 7),), "<u8", buf, 0, (1,))

    def _table(self, group: np.ndarray) -> dict:
        m = min(int(self.len[group].min()), self.REACH)  # only the first m bytes of a window are in the tables
        block = min(8, m)
        drop = np.uint64(8 * (8 - block))
        view = self._view(np.frombuffer(self.buf, np.uint8))
        off = self.off[group]
        bits = int(np.clip(np.ceil(np.log2(len(group) * (m - block + 1) + 1)) + 4, 12, 22))
        down = np.uint64(64 - bits)
        shift = np.full(1 << bits, m - block + 1, np.uint16)
        for end in range(block, m + 1):  # the block that ends after `end` bytes
            h = ((view[off + end - 8] >> drop) * _MIX) >> down
            np.minimum.at(shift, h.astype(np.int64), m - end)
        suffix = view[off + m - 8] >> drop
        order = np.argsort(suffix, kind="stable")
        prefix = view[off] << drop  # the first `block` bytes
        return {"m": m, "drop": drop, "down": down, "shift": shift, "suffix": suffix[order],
                "pattern": group[order].astype(np.int32), "prefix": prefix[order]}

    def find(self, hay: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(start offset, pattern) of every occurrence. ``hay`` has PAD zero bytes at either end."""
        raw = np.frombuffer(hay, np.uint8)
        view = self._view(raw)
        starts, found = [], []
        for t in self.tables:
            m, drop, down, shift = t["m"], t["drop"], t["down"], t["shift"]
            lo, hi = self.PAD + m - 1, len(hay) - self.PAD
            if hi <= lo:
                continue
            at = np.arange(lo, hi, self.LANE)
            end = np.minimum(at + self.LANE, hi)
            zeros = []
            while at.size:
                h = ((view[at - 7] >> drop) * _MIX) >> down
                jump = shift[h.astype(np.int64)]
                hit = jump == 0
                if hit.any():
                    zeros.append(at[hit])
                at = at + np.maximum(jump, 1)
                more = at < end
                at, end = at[more], end[more]
            if not zeros:
                continue
            ends = np.concatenate(zeros)
            suffix = view[ends - 7] >> drop
            left = np.searchsorted(t["suffix"], suffix, "left")
            count = np.searchsorted(t["suffix"], suffix, "right") - left
            keep = count > 0
            ends, left, count = ends[keep], left[keep], count[keep]
            cuts = np.searchsorted(np.cumsum(count), np.arange(1 << 20, int(count.sum()), 1 << 20))
            for part in np.split(np.arange(len(ends)), cuts):  # a bounded number of tries at once
                n = count[part]
                which = np.repeat(part, n)
                slot = left[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                begin = ends[which] - m + 1
                same = (view[begin] << drop) == t["prefix"][slot]
                for s, p in zip(begin[same].tolist(), t["pattern"][slot[same]].tolist()):
                    o, k = self.off[p], self.len[p]
                    if hay[s:s + k] == self.buf[o:o + k]:
                        starts.append(s)
                        found.append(p)
        return np.array(starts, np.int64), np.array(found, np.int64)

    def search(self, texts: list[bytes]) -> tuple[list[int], dict[int, tuple[list, list]]]:
        """Words of each text; for each text with hits, its (first word, words) spans and item numbers."""
        hay, begin, n_words = bytearray(b"\0" * self.PAD), [], []
        for text in texts:
            words = words_of(text)
            begin.append(len(hay))
            n_words.append(len(words))
            if words:
                hay += b" " + b" ".join(words) + b" \0"
        hay += b"\0" * self.PAD
        hay = bytes(hay)
        at, pattern = self.find(hay)
        hits: dict[int, tuple[list, list]] = {}
        if len(at):
            order = np.lexsort((at,))
            at, pattern = at[order], pattern[order]
            doc = np.searchsorted(np.array(begin), at, "right") - 1
            found, first_hit = np.unique(doc, return_index=True)
            for d, lo, hi in zip(found.tolist(), first_hit.tolist(), [*first_hit[1:].tolist(), len(doc)]):
                spaces = np.flatnonzero(np.frombuffer(hay, np.uint8)[begin[d]:int(at[hi - 1]) + 1] == 32)
                first = np.searchsorted(spaces, at[lo:hi] - begin[d])
                spans = set(zip(first.tolist(), self.n_words[pattern[lo:hi]].tolist()))
                hits[d] = (sorted(spans), self.owners(pattern[lo:hi]))
        return n_words, hits


def covered(spans: list[tuple[int, int]]) -> int:
    """Words inside at least one span."""
    total, reach = 0, 0
    for start, n in sorted(spans):
        total += max(0, start + n - max(reach, start))
        reach = max(reach, start + n)
    return total


def _digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """Item blocks of about ``block_bytes``, one at a time on the driver."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"),
                             F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8").alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b)
        yield n, b, [(r["item"], bytes(r["text"])) for r in part.collect()]


def contamination(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = 10,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items (their ids), items_sha256, contaminated."""
    id_type = documents.schema[id_col].dataType.simpleString()
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sc = documents.sparkSession.sparkContext
    passes = []
    for n, b, items in _blocks(benchmark, item_col, item_text_col, block_bytes):
        shared = sc.broadcast(WuManber(items, window))
        passes.append(_whole(docs, shared, id_type) if n == 1 else _partial(docs, shared, id_type, b))
    if len(passes) == 1:
        return passes[0]
    every = passes[0]
    for p in passes[1:]:
        every = every.unionByName(p)
    merged = (every.groupBy("doc_id", "text_key", "n_words")
              .agg(F.sum("rows").alias("rows"), F.flatten(F.collect_list("spans")).alias("spans"),
                   F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")))
    # repeated rows of one text were counted; each is given back
    merged = merged.select("*", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("copy"))
    covered_words = F.expr("""aggregate(array_sort(spans), named_struct('n', 0L, 'reach', 0L), (t, s) -> named_struct(
        'n', t.n + greatest(0L, s.first + s.n - greatest(t.reach, s.first)), 'reach', greatest(t.reach, s.first + s.n)), t -> t.n)""")
    return merged.select(
        "doc_id", "n_words", covered_words.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items",
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"))


def _whole(docs: DataFrame, shared, id_type: str) -> DataFrame:
    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        wm: WuManber = shared.value
        n_words, hits = wm.search(byte_texts(batch.column(1)))
        none = _digest([])
        ids = [[wm.ids[i] for i in hits[k][1]] if k in hits else [] for k in range(len(n_words))]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()),
             pa.array([covered(hits[k][0]) if k in hits else 0 for k in range(len(n_words))], pa.int64()),
             pa.array([len(x) for x in ids], pa.int64()), pa.array([sorted(x) for x in ids], pa.list_(pa.string())),
             pa.array([_digest(x) if x else none for x in ids]), pa.array([bool(x) for x in ids])],
            ["doc_id", "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated"])

    return map_slices(docs, kernel, f"doc_id {id_type}, n_words long, n_hit long, n_items long, "
                                    "items array<string>, items_sha256 string, contaminated boolean")


def _partial(docs: DataFrame, shared, id_type: str, number: int) -> DataFrame:
    """Hits of one item block; block 0 also lists the texts without hits."""
    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        wm: WuManber = shared.value
        texts = byte_texts(batch.column(1))
        n_words, hits = wm.search(texts)
        rows = [k for k in range(len(texts)) if number == 0 or k in hits]
        empty = ([], [])
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(rows, pa.int64())),
             pa.array([hashlib.sha256(texts[k]).hexdigest() for k in rows], pa.string()),
             pa.array([n_words[k] for k in rows], pa.int64()), pa.array([int(number == 0)] * len(rows), pa.int64()),
             pa.array([[{"first": s, "n": c} for s, c in hits.get(k, empty)[0]] for k in rows],
                      pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())]))),
             pa.array([[wm.ids[i] for i in hits.get(k, empty)[1]] for k in rows], pa.list_(pa.string()))],
            ["doc_id", "text_key", "n_words", "rows", "spans", "items"])

    return map_slices(docs, kernel, f"doc_id {id_type}, text_key string, n_words long, rows long, "
                                    "spans array<struct<first:long,n:long>>, items array<string>")


def clean(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents without any benchmark window, all their columns kept: one filtering pass per item block."""
    sc = documents.sparkSession.sparkContext
    field = documents.columns.index(text_col)
    for _, _, items in _blocks(benchmark, item_col, item_text_col, block_bytes):
        shared = sc.broadcast(WuManber(items, window))

        def run(batches, shared=shared):
            for batch in batches:
                for part in slices(batch, field):
                    hits = shared.value.search(byte_texts(part.column(field)))[1]
                    yield part.filter(pa.array([k not in hits for k in range(part.num_rows)], pa.bool_()))

        documents = documents.mapInArrow(run, documents.schema)
    return documents
