"""Best-fit packing of token sequences: a configuration linear program over the length histogram.

1. One pass encodes every text and cuts what is longer than a sequence. Each
   piece is a narrow row with its length, a checksum of its ids and its number
   among the pieces of that length in its partition. The rows are written.
2. The histogram of lengths (at most ``capacity`` rows, whatever the corpus) is
   the program: a configuration is a multiset of lengths that fits a sequence,
   and as few configurations as possible shall cover the histogram.
3. It is solved by multiplicative weights: a length's price is its share of the
   sequence times its weight; a knapsack dynamic program over the capacity gives
   the dearest configuration for every room left; each length still needed gets
   a configuration traced through that table, mostly of near-best value, and it
   is used until one of its lengths is covered. After a round, weights of
   lengths that lag behind grow by ``exp(ETA * lag)``, those ahead shrink.
   Prices also prove a bound: no packing has fewer than
   ``sum(count * price) / value of the dearest configuration`` sequences.
4. Rounding: configurations are used a whole number of times; what is left over
   is packed best-fit by the same histogram (each length at once, as often as
   counts allow). Several shares of the program's solution are rounded and the
   fewest sequences win.
5. Pieces of a length are numbered (a running sum of the counts by partition),
   and their number names sequence and place: one search in the plan's table.

Prices begin as shares of the sequence and move little in ``ROUNDS`` rounds, so
the bound is sharp where short pieces can fill every sequence, as in a corpus of
mixed texts; with long pieces only, it stays near the volume bound.

The plan has at most two configurations a length, so it is broadcast with a
fixed bound. Only narrow rows are shuffled, once, by (partition, length).

Ids are those of the ``tokenizers`` library. Texts are encoded by ``tiktoken``
with the same vocabulary (the same ids, several times faster; tests hold them
together); texts with a special token's string, and any that it can't encode,
go through ``tokenizers`` itself.

Defined cases: a null text is empty and still has its end id; null ids and
repeated rows each give their pieces; extra columns are not read, whatever their
names; an empty table gives no rows; a very long text is many full pieces, its
first the shorter one.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import slices, str_texts, write_stage

CAPACITY = 2048
END_ID = 0
ROUNDS = 12  # prices and weights
ETA = 0.05
SLACK = 2e-4  # of a sequence: how far below the best value a traced item may stay
FILL = 1 - 5e-4  # value of a configuration in use, as a share of the sequence
SHARES = (1.0, 0.9, 0.75, 0.5, 0.25)  # of the program's solution that are rounded
_BLOCK = 8  # lengths traced at once
_LENGTH_BITS = 44  # ranks of a length stay below 2 ** 44


# -- encoding ------------------------------------------------------------------

class Encoder:
    """Ids of a text, as the ``tokenizers`` library gives them."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.own.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if not any(s in text for s in self.special):
            try:
                return np.asarray(self.fast.encode_to_numpy(text), "<u4")
            except Exception:  # noqa: BLE001 - its regular expression gives up on some very long stretches
                pass
        return np.array(self.own.encode(text, add_special_tokens=False).ids, "<u4")


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(*paths: str) -> Encoder:
    """One per worker process."""
    if paths not in _ENCODERS:
        _ENCODERS[paths] = Encoder(*paths)
    return _ENCODERS[paths]


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of n ids: all of ``capacity`` but the first, which has the rest."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(a, a + capacity) for a in range(first, n, capacity)]


def token_pieces(documents: DataFrame, json_path: str, ranks_path: str, pattern: str, id_col: str = "doc_id",
                 text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part, nth (and the ids): a row for each piece.

    ``nth`` counts the pieces of the same length in partition ``part``.
    """
    id_type = documents.schema[id_col].dataType.simpleString()
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        from pyspark import TaskContext

        part_number, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4")
        for batch in batches:
            for part in slices(batch):
                own, rows, out, ids = encoder(json_path, ranks_path, pattern), [], [], []
                for k, text in enumerate(str_texts(part.column(1))):
                    all_ids = np.concatenate([own.ids(text), end])
                    for piece, (a, b) in enumerate(piece_bounds(len(all_ids), capacity)):
                        rows.append(k)
                        out.append((piece, a, b - a, zlib.crc32(all_ids[a:b].tobytes()), seen[b - a]))
                        seen[b - a] += 1
                        if with_ids:
                            ids.append(all_ids[a:b].astype(np.int64))
                cols = np.array(out, np.int64).reshape(-1, 5).T
                arrays = [part.column(0).take(pa.array(rows, pa.int64())), pa.array(cols[0].astype(np.int32)),
                          *(pa.array(c) for c in cols[1:4]), pa.array(np.full(len(rows), part_number, np.int32)), pa.array(cols[4])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
                if with_ids:
                    arrays, names = [*arrays, pa.array(ids, pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.mapInArrow(run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, part int, nth long"
                           + (", ids array<long>" if with_ids else ""))


# -- the program ---------------------------------------------------------------

def knapsack(lengths: np.ndarray, price: np.ndarray, capacity: int) -> np.ndarray:
    """value[c]: the dearest multiset of lengths that fits c."""
    value = np.zeros(capacity + 1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        k = upto[c]
        value[c] = max(value[c - 1], (value[c - lengths[:k]] + price[:k]).max()) if k else value[c - 1]
    return value


def traced(lengths: np.ndarray, most: np.ndarray, price: np.ndarray, value: np.ndarray, pull: np.ndarray,
           starts: np.ndarray, capacity: int, slack: float, rng: np.random.Generator) -> np.ndarray:
    """A configuration (row of counts) around each length of ``starts``.

    Every further length is drawn in proportion to ``pull`` among those that
    reach the table's value for the room left, less ``slack``.
    """
    counts = np.zeros((len(starts), len(lengths)), np.int32)
    counts[np.arange(len(starts)), starts] = 1
    room, live = capacity - lengths[starts], np.arange(len(starts))
    live = live[room >= lengths[0]]
    while len(live):
        c = room[live]
        fits = (lengths[None, :] <= c[:, None]) & (counts[live] < most[None, :])
        reach = np.where(fits, value[np.maximum(c[:, None] - lengths[None, :], 0)] + price[None, :], -1.0)
        best = reach.max(1)
        live, reach, best = live[best >= 0], reach[best >= 0], best[best >= 0]
        if not len(live):
            break
        near = (reach >= best[:, None] - slack) & (reach >= 0)
        weight = np.where(near, pull[None, :], 0.0)
        bare = weight.sum(1) == 0
        weight[bare] = near[bare]
        upto = weight.cumsum(1)
        pick = (upto <= (rng.random(len(live)) * upto[:, -1])[:, None]).sum(1)
        pick = np.minimum(pick, weight.shape[1] - 1 - (weight[:, ::-1] > 0).argmax(1))
        counts[live, pick] += 1
        room[live] -= lengths[pick]
        live = live[room[live] >= lengths[0]]
    return counts


@dataclass
class Plan:
    """Configurations (numbers of lengths, their counts, how often) that cover the histogram exactly."""

    lengths: np.ndarray
    configurations: list[tuple[np.ndarray, np.ndarray, int]] = field(default_factory=list)
    bound: float = 0.0  # no packing has fewer sequences

    @property
    def sequences(self) -> int:
        return sum(m for _, _, m in self.configurations)


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS, eta: float = ETA,
          slack: float = SLACK, fill: float = FILL, seed: int = 7) -> tuple[list[tuple[np.ndarray, np.ndarray, float]], float]:
    """Fractional use of configurations that never exceeds the counts, and the best bound."""
    rng, weight = np.random.default_rng(seed), np.ones(len(lengths))
    need, used, bound = counts.astype(float), [], 0.0
    sharp = (lengths / lengths.max()) ** 40.0  # the longest that still fits, as best-fit has it
    for _ in range(rounds):
        price = lengths / capacity * weight
        bound = max(bound, float((counts * price).sum() / knapsack(lengths, price, capacity)[capacity]))
        open_ = np.flatnonzero(need > 1e-9)
        if not len(open_):
            break
        own, own_price = lengths[open_], price[open_]
        value = knapsack(own, own_price, capacity)
        top = value[capacity]
        for block in np.array_split(np.arange(len(open_))[::-1], -(-len(open_) // _BLOCK)):
            left = need[open_]
            block = block[left[block] > 1e-9]
            if not len(block):
                continue
            most = np.where(left > 1e-9, counts[open_], 0)
            for row in traced(own, most, own_price / top, value / top, left * sharp[open_], block, capacity, slack, rng):
                at = np.flatnonzero(row)
                use = float((need[open_[at]] / row[at]).min())
                if use <= 1e-9 or (row[at] * own[at]).sum() < fill * capacity:
                    continue
                need[open_[at]] -= use * row[at]
                used.append((open_[at], row[at].astype(np.int64), use))
        lag = need / counts
        weight = weight * np.exp(eta * (lag - lag.mean()))
    return used, bound


def best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Sequences opened by the longest length left and filled by the longest that fits, equal ones at once."""
    left, out = left.copy(), []
    have = np.flatnonzero(left).tolist()
    sizes = lengths[have].tolist()
    while have:
        room, taken = capacity, {}
        at = len(have) - 1
        while at >= 0:
            k = have[at]
            fits = min(room // sizes[at], int(left[k]))
            if fits:
                taken[k] = fits
                room -= fits * sizes[at]
            at = min(at, bisect.bisect_right(sizes, room)) - 1
        times = min(int(left[k]) // n for k, n in taken.items())
        for k, n in taken.items():
            left[k] -= times * n
            if not left[k]:
                at = bisect.bisect_left(have, k)
                del have[at], sizes[at]
        out.append((np.array(list(taken)), np.array(list(taken.values()), np.int64), times))
    return out


def rounded(counts: np.ndarray, used: list, share: float) -> tuple[list, np.ndarray]:
    """Whole uses of the first configurations that make up ``share`` of the solution, and the counts left."""
    left, out = counts.copy(), []
    total, upto = sum(use for *_, use in used), 0.0
    for at, row, use in used:
        if upto >= share * total:
            break
        upto += use
        times = min(int(use + 1e-6), int((left[at] // row).min()))
        if times > 0:
            left[at] -= times * row
            out.append((at, row, times))
    return out, left


def pack(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """The plan of fewest sequences for ``counts`` pieces of ascending ``lengths``."""
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    full = [(np.array([k]), np.array([1]), int(counts[k])) for k in np.flatnonzero(lengths == capacity)]
    sealed = sum(m for *_, m in full)
    keep = lengths < capacity
    plan = Plan(lengths, full, float(sealed))
    if not keep.any():
        return plan
    some, n = lengths[keep], counts[keep]
    used, bound = solve(some, n, capacity)
    tries = []
    for share in SHARES:
        whole, left = rounded(n, used, share)
        tries.append(whole + best_fit(some, left, capacity))
    best = min(tries, key=lambda t: sum(m for *_, m in t))
    plan.bound += bound
    plan.configurations = full + best  # lengths of a whole sequence are the last of ``lengths``
    return plan


def slots(plan: Plan) -> dict[str, np.ndarray]:
    """Where the r-th piece of a length goes: for r from ``first`` on, ``times`` sequences from ``sequence`` on."""
    key, first, times, sequence, place = [], [], [], [], []
    reached, base = np.zeros(len(plan.lengths), np.int64), 0
    for at, row, m in plan.configurations:
        inside = 0
        for k, n in sorted(zip(at.tolist(), row.tolist()), reverse=True):
            size = int(plan.lengths[k])
            key.append((size << _LENGTH_BITS) + int(reached[k]))
            first.append(int(reached[k]))
            times.append(m)
            sequence.append(base)
            place.append(inside)
            reached[k] += n * m
            inside += n * size
        base += m
    by = np.argsort(np.array(key, np.int64), kind="stable")
    named = {"key": key, "first": first, "times": times, "sequence": sequence, "place": place}
    return {c: np.array(v, np.int64)[by] for c, v in named.items()}


# -- on the cluster --------------------------------------------------------------

def numbered(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``rank``: their number among all pieces of their length."""
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return pieces.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth")).drop("base", "nth", "part")


def placed(pieces: DataFrame, plan: Plan) -> DataFrame:
    """Numbered pieces with sequence_id and offset."""
    shared = pieces.sparkSession.sparkContext.broadcast(slots(plan))
    names = [c for c in pieces.columns if c != "rank"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name in names)

    def run(batches):
        table = shared.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(table["key"], (length << _LENGTH_BITS) + rank, "right") - 1
            r, times = rank - table["first"][at], table["times"][at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(table["sequence"][at] + r % times),
                 pa.array(table["place"][at] + r // times * length)], [*names, "sequence_id", "offset"])

    return pieces.select(*names, "rank").mapInArrow(run, schema + ", sequence_id long, offset long")


def histogram(pieces: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, ascending, and how many pieces have them: at most ``capacity`` numbers."""
    rows = sorted((r["length"], r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect())
    return np.array([a for a, _ in rows], np.int64), np.array([b for _, b in rows], np.int64)


def pack_documents(documents: DataFrame, json_path: str, ranks_path: str, pattern: str, id_col: str = "doc_id",
                   text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids), sequence_id, offset."""
    pieces = write_stage(token_pieces(documents, json_path, ranks_path, pattern, id_col, text_col, capacity,
                                      with_ids=with_ids), "packing-pieces")
    plan = pack(*histogram(pieces), capacity)
    order = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), "sequence_id", "offset"]
    return placed(numbered(pieces), plan).select(*order)
