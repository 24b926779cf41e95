"""Vector search through a cell index: tiles that no bound lets in are skipped.

Spherical k-means centres are fitted on a bounded sample of the bank
(``SAMPLE_ROWS`` rows and ``SAMPLE_NUMBERS`` numbers, the documented bound);
every bank row is then indexed under its nearest centre, by its angle to it.
A cell is cut into bands of that angle. For a question at angle ``t`` to a
centre, the rows of a band ``[lo, hi]`` are at least ``max(t - hi, lo - t, 0)``
away (triangle inequality of angles), so the cosine of that is an upper bound.

* :func:`exact_topk` scores the nearest cells first; the k-th score found is the
  floor, and only bands whose bound reaches it are scored after that. The result
  equals a full sort of all pairs, whatever the centres are.
* :func:`probed_topk` stops after the nearest cells. How many these are is
  measured on the sample, so that the wanted recall is met there.
* :func:`pairs_above` scores the bands whose bound reaches the threshold.

Near cells are bundled, about a grid block (``blocks.MAX_BLOCK_ROWS``) of bank rows in
each, and scoring is done by the block grid (``blocks.grid_scores``) with bundles as
groups: a question travels once to a bundle, with the list of the cells or bands it
meets there. The tile multiplies some questions at a time with the bands that any of
them meets, and keeps the scores of what each meets. A bundle that holds a third of all rows is split over many tasks.

Only vectors of the commonest width have cells. Rows of another width are one
group a width, scored by the questions of that width; any other pair (other
width, null, zero, null or non-finite element) scores 0. Of these only the first
rows in key order can be among the best k, so they are taken from a list of at
most ``2 * (k + 1)`` rows instead of being paired. In top-k searches a vector
that many bank rows share keeps its ``k + 1`` least keys; no later one can be
among the best k. Keys are unique and not null, ties go to the least key. An empty
side gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import blocks
from tessera.operators.blocks import Kernel
from tessera.session import write_stage

SAMPLE_ROWS = 8192
SAMPLE_NUMBERS = 4_000_000
MAX_CELLS = 1024
ROUNDS = 8  # k-means rounds
QUESTIONS = 256  # sample rows that measure the recall of the probes
BANDS = 16  # of the angle to the centre
BAND = math.pi / BANDS
SLACK = 2e-6  # scores are ranked at 6 decimals
CHUNK = 256  # questions or rows that meet all centres at once
ALL = 1 << 30


@dataclass
class Cells:
    """Fitted centres (unit rows) of vectors of ``width`` numbers, and how many
    nearest cells reached the wanted recall on the sample; ``bundle`` of every cell."""

    width: int
    centres: np.ndarray
    probes: int
    bundle: np.ndarray


def _chunks(batches):
    """Arrow batches in chunks whose angles to all bands stay small."""
    for pdf in batches:
        for at in range(0, len(pdf), CHUNK):
            yield pdf.iloc[at:at + CHUNK]


def _kmeans(rows: np.ndarray, n_cells: int, seed: int) -> np.ndarray:
    centres = rows[np.random.default_rng(seed).choice(len(rows), n_cells, replace=False)]
    for _ in range(ROUNDS):
        near = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        moved = blocks._unit_rows(sums)
        centres = np.where((moved != 0).any(axis=1)[:, None], moved, centres)
    return centres


def _probes(rows: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """The fewest nearest cells that hold ``recall`` of the k nearest sample rows
    of the first sample rows."""
    n = min(QUESTIONS, len(rows))
    k = min(k, len(rows) - 1)
    if k < 1:
        return 1
    score = rows[:n] @ rows.T
    score[np.arange(n), np.arange(n)] = -np.inf
    best = np.argpartition(-score, k - 1, axis=1)[:, :k]
    order = np.argsort(-(rows[:n] @ centres.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
    cell = (rows @ centres.T).argmax(axis=1)
    needed = np.sort(np.take_along_axis(place, cell[best], axis=1).ravel())
    return int(needed[max(0, math.ceil(recall * len(needed)) - 1)]) + 1


def fit_cells(bank: DataFrame, b_key: str, b_vec: str, *, k: int, recall: float = 0.95,
              cells: int | None = None, seed: int = 1) -> Cells | None:
    """Centres fitted on the sample (the rows of the commonest width with the least
    key hashes); None if no bank row has a direction. ``cells`` defaults to the
    square root of the bank's rows, at most ``MAX_CELLS`` and half the sample."""
    widths = bank.filter(F.size(b_vec) > 0).groupBy(F.size(b_vec).alias("w")).count()
    top = widths.orderBy(F.col("count").desc(), "w").limit(1).collect()
    if not top:
        return None
    width, n = top[0]["w"], top[0]["count"]
    sample = (bank.filter(F.size(b_vec) == width).select(b_key, b_vec).orderBy(F.xxhash64(b_key), b_key)
              .limit(max(2, min(SAMPLE_ROWS, SAMPLE_NUMBERS // width))).toPandas())
    rows = blocks._matrix(sample[b_vec], width)
    rows = rows[(rows != 0).any(axis=1)]
    if not len(rows):
        return None
    distinct = rows[np.sort(np.unique(np.round(rows, 6), axis=0, return_index=True)[1])]
    n_cells = min(cells or math.ceil(math.sqrt(n)), MAX_CELLS, max(1, len(distinct) // 2))
    centres = _kmeans(distinct, n_cells, seed)
    bundles = min(len(centres), math.ceil(n / blocks.MAX_BLOCK_ROWS))
    bundle = (centres @ _kmeans(centres, bundles, seed).T).argmax(axis=1)
    return Cells(width, centres, _probes(distinct, centres, k, recall), bundle)


NOTHING = Cells(1, np.ones((1, 1)), 1, np.zeros(1, dtype=np.int64))  # no direction: every pair scores 0


def _place(df: DataFrame, key: str, vec: str, model: Cells) -> DataFrame:
    """``key, vec, _class, _cell, _angle``, written: the class is the width (0 without a
    direction), the cell is -1 outside the commonest width."""
    fixed = df.sparkSession.sparkContext.broadcast(model.centres)  # MAX_CELLS rows at most
    width = model.width

    def run(batches):
        for pdf in _chunks(batches):
            vecs = pdf[vec]
            size = np.array([len(v) if v is not None and np.ndim(v) == 1 else 0 for v in vecs], dtype=np.int64)
            cls = np.zeros(len(pdf), dtype=np.int64)
            cell = np.full(len(pdf), -1, dtype=np.int64)
            angle = np.zeros(len(pdf))
            for w in np.unique(size[size > 0]):
                at = np.flatnonzero(size == w)
                unit = blocks._matrix(vecs.iloc[at], int(w))
                has = (unit != 0).any(axis=1)
                cls[at[has]] = w
                if w == width and has.any():
                    cos = unit[has] @ fixed.value.T
                    cell[at[has]] = cos.argmax(axis=1)
                    angle[at[has]] = np.arccos(np.clip(cos.max(axis=1), -1.0, 1.0))
            yield pdf.assign(_class=cls.astype(np.int32), _cell=cell.astype(np.int32), _angle=angle)

    schema = T.StructType([*df.select(key, vec).schema.fields, T.StructField("_class", T.IntegerType()),
                           T.StructField("_cell", T.IntegerType()), T.StructField("_angle", T.DoubleType())])
    return write_stage(df.select(key, vec).mapInPandas(run, schema), "vector-cells")


def _bands(bank: DataFrame) -> pd.DataFrame:
    """Least and largest angle of every band: at most BANDS rows a cell."""
    return (bank.filter(F.col("_cell") >= 0).groupBy("_cell", _band().alias("_band"))
            .agg(F.min("_angle").alias("lo"), F.max("_angle").alias("hi")).toPandas())


def _band() -> F.Column:
    return F.least(F.floor(F.col("_angle") / BAND), F.lit(BANDS - 1)).cast("int")


def _meetings(pdf: pd.DataFrame, met: np.ndarray, ids: np.ndarray, bundle: np.ndarray, q_key: str, q_vec: str):
    """The questions of a chunk once for every bundle in which they meet something."""
    for g in np.unique(bundle):
        here = bundle == g
        rows = np.flatnonzero(met[:, here].any(axis=1))
        if len(rows):
            own = ids[here].astype(np.int32)
            some = pdf.iloc[rows]
            yield pd.DataFrame({q_key: some[q_key], q_vec: some[q_vec], "_group": np.int32(g),
                                "_meets": [own[m] for m in met[rows][:, here]]})


def _meeting_schema(questions: DataFrame, q_key: str, q_vec: str) -> T.StructType:
    return T.StructType([*questions.select(q_key, q_vec).schema.fields, T.StructField("_group", T.IntegerType()),
                         T.StructField("_meets", T.ArrayType(T.IntegerType()))])


def _places(cos: np.ndarray) -> np.ndarray:
    """Place of every cell in each question's order of nearness, from 0."""
    place = np.empty(cos.shape, dtype=np.int64)
    np.put_along_axis(place, np.argsort(-cos, axis=1, kind="stable"), np.arange(cos.shape[1])[None, :], axis=1)
    return place


def _nearest(questions: DataFrame, q_key: str, q_vec: str, model: Cells) -> DataFrame:
    """Meetings of the questions with their nearest cells (``_group, _meets``); a question
    of another width meets the group of that width, one without a direction none."""
    fixed = questions.sparkSession.sparkContext.broadcast((model.centres, model.bundle))
    width, probes = model.width, model.probes

    def run(batches):
        centres, bundle = fixed.value
        for pdf in _chunks(batches):
            met = _places(blocks._matrix(pdf[q_vec], width) @ centres.T) < probes
            yield from _meetings(pdf, met, np.arange(len(centres)), bundle, q_key, q_vec)

    inner = (questions.filter(F.col("_cell") >= 0).select(q_key, q_vec)
             .mapInPandas(run, _meeting_schema(questions, q_key, q_vec)))
    others = _other_widths(questions).withColumn("_meets", F.array("_group"))
    return inner.unionByName(others.select(q_key, q_vec, "_group", "_meets"))


def _other_widths(rows: DataFrame) -> DataFrame:
    return rows.filter((F.col("_class") > 0) & (F.col("_cell") < 0)).withColumn("_group", -F.col("_class"))


def _reached(questions: DataFrame, q_key: str, q_vec: str, bands: pd.DataFrame, model: Cells, probed: int) -> DataFrame:
    """Meetings of the questions with the bands outside their ``probed`` nearest cells whose
    bound reaches the question's ``_floor``."""
    fixed = questions.sparkSession.sparkContext.broadcast(
        (model.centres, model.bundle, *(bands[c].to_numpy() for c in ("_cell", "_band", "lo", "hi"))))
    width = model.width

    def run(batches):
        centres, bundle, cell, band, lo, hi = fixed.value
        for pdf in _chunks(batches):
            cos = blocks._matrix(pdf[q_vec], width) @ centres.T
            t = np.arccos(np.clip(cos, -1.0, 1.0))[:, cell]
            away = np.maximum(np.maximum(t - hi[None, :], lo[None, :] - t), 0.0)
            met = (np.cos(away) >= pdf["_floor"].to_numpy()[:, None] - SLACK) & (_places(cos)[:, cell] >= probed)
            yield from _meetings(pdf, met, cell * BANDS + band, bundle[cell], q_key, q_vec)

    return (questions.filter(F.col("_cell") >= 0).select(q_key, q_vec, "_floor")
            .mapInPandas(run, _meeting_schema(questions, q_key, q_vec)))


def _bundled(bank: DataFrame, model: Cells) -> DataFrame:
    of_cell = F.array(*[F.lit(int(g)) for g in model.bundle])  # MAX_CELLS numbers at most
    return bank.filter(F.col("_cell") >= 0).withColumn("_group", F.get(of_cell, F.col("_cell")))


def _in_cells(bank: DataFrame, model: Cells) -> DataFrame:
    return (_bundled(bank, model).withColumn("_at", F.col("_cell"))
            .unionByName(_other_widths(bank).withColumn("_at", F.col("_group"))))


def _in_bands(bank: DataFrame, model: Cells) -> DataFrame:
    return _bundled(bank, model).withColumn("_at", F.col("_cell") * BANDS + _band())


def _zero_pairs(questions: DataFrame, bank: DataFrame, q_key: str, b_key: str, k: int, exclude_self: bool) -> DataFrame:
    """The first ``k + 1`` bank rows, in key order, of other classes than the question's:
    pairs that score 0. The list holds ``k + 1`` rows a class, ``2 * (k + 1)`` in all, so
    without any one class it still has the first ``k + 1`` of the others."""
    a_class = Window.partitionBy("_class").orderBy(b_key)
    first = (bank.select(b_key, "_class").withColumn("_r", F.row_number().over(a_class)).filter(F.col("_r") <= k + 1)
             .orderBy(b_key).limit(2 * (k + 1)).collect())
    if not first:
        return questions.sparkSession.createDataFrame([], T.StructType(
            [questions.schema[q_key], bank.schema[b_key], T.StructField("sim", T.DoubleType())]))
    kind = bank.schema[b_key].dataType
    listed = F.array(*[F.struct(F.lit(r[b_key]).cast(kind).alias("b"), F.lit(r["_class"]).alias("c")) for r in first])
    # without a direction a row scores 0 with its own class too
    other = F.filter(listed, lambda e: (e["c"] != F.col("_class")) | (F.col("_class") == 0))
    pairs = questions.select(q_key, F.explode(F.slice(other, 1, k + 1)).alias("_e"))
    pairs = pairs.select(q_key, F.col("_e.b").alias(b_key), F.lit(0.0).alias("sim"))
    return pairs.filter(F.col(q_key) != F.col(b_key)) if exclude_self else pairs


def _kernel(q_vec: str, b_vec: str, least: float = -math.inf) -> Kernel:
    """Scores a question with the rows of the cells or bands it meets; other pairs of the tile,
    and scores under ``least``, are left out. All vectors of a group have one width."""

    def score(q, b):
        width = len(b[b_vec].iloc[0])
        qm, bm = blocks._matrix(q[q_vec], width), blocks._matrix(b[b_vec], width)
        ids, at = np.unique(b["_at"].to_numpy(), return_inverse=True)
        lists = [np.asarray(m, dtype=np.int64) for m in q["_meets"]]
        owner, flat = np.repeat(np.arange(len(lists)), [len(m) for m in lists]), np.concatenate(lists)
        place = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
        here = ids[place] == flat
        met = np.zeros((len(q), len(ids)), dtype=bool)
        met[owner[here], place[here]] = True

        def strip(rows: slice) -> np.ndarray:
            own = met[rows]
            cols = np.flatnonzero(own.any(axis=0)[at])
            s = np.where(own[:, at[cols]], qm[rows] @ bm[cols].T, -np.inf)
            s = s if least == -math.inf else blocks.at_least(s, least)
            if len(cols) == len(b):
                return s
            out = np.full((len(own), len(b)), -np.inf)
            out[:, cols] = s
            return out

        return {"sim": strip}, {}

    return Kernel([q_vec, "_meets"], [b_vec, "_at"], score,
                  q_weight=blocks.vector_weight(q_vec), b_weight=blocks.vector_weight(b_vec))


def _scored(questions: DataFrame, bank: DataFrame, q_key: str, b_key: str, q_vec: str, b_vec: str, k: int,
            exclude_self: bool, block_rows: int | None) -> DataFrame:
    tiles = blocks.grid_scores(questions, bank, q_key=q_key, b_key=b_key, kernel=_kernel(q_vec, b_vec), k=k,
                               group="_group", exclude_self=exclude_self, block_rows=block_rows)
    return tiles.select(q_key, b_key, "sim")


def _best(pairs: DataFrame, q_key: str, b_key: str, k: int) -> DataFrame:
    return blocks.merge_topk(pairs.withColumn("mode", F.lit("sim")), q_key, b_key, k)


@dataclass
class Search:
    """Written index, questions and the nearest cells' best rows of one search."""

    model: Cells
    questions: DataFrame
    bank: DataFrame
    best: DataFrame


def _search(queries: DataFrame, bank: DataFrame, *, q_key: str, b_key: str, q_vec: str, b_vec: str, k: int,
            include_self: bool, cells: int | None, probes: int | None, recall: float, block_rows: int | None) -> Search:
    same = Window.partitionBy(b_vec).orderBy(b_key)
    model = fit_cells(bank, b_key, b_vec, k=k, recall=recall, cells=cells)
    model = model or NOTHING
    if probes:
        model = replace(model, probes=probes)
    kept = bank.select(b_key, b_vec).withColumn("_r", F.row_number().over(same)).filter(F.col("_r") <= k + 1).drop("_r")
    b = _place(kept, b_key, b_vec, model)
    q = _place(queries, q_key, q_vec, model)
    near = _scored(_nearest(q, q_key, q_vec, model), _in_cells(b, model), q_key, b_key, q_vec, b_vec, k, not include_self, block_rows)
    zero = _zero_pairs(q, b, q_key, b_key, k, not include_self)
    return Search(model, q, b, _best(near.unionByName(zero), q_key, b_key, k))


def probed_topk(queries: DataFrame, bank: DataFrame, *, q_key: str, b_key: str, q_vec: str, b_vec: str, k: int,
                include_self: bool = True, recall: float = 0.95, cells: int | None = None, probes: int | None = None,
                block_rows: int | None = None) -> DataFrame:
    """Approximate top-k (``q_key, b_key, sim, rank``): every bank row is indexed, a question meets its
    nearest cells only, as many as gave ``recall`` on the sample (or ``probes``)."""
    return _search(queries, bank, q_key=q_key, b_key=b_key, q_vec=q_vec, b_vec=b_vec, k=k, include_self=include_self,
                   cells=cells, probes=probes, recall=recall, block_rows=block_rows).best


def exact_topk(queries: DataFrame, bank: DataFrame, *, q_key: str, b_key: str, q_vec: str, b_vec: str, k: int,
               include_self: bool = True, recall: float = 0.5, cells: int | None = None, probes: int | None = None,
               block_rows: int | None = None) -> DataFrame:
    """Exact top-k (``q_key, b_key, sim, rank``). The first cells (``recall`` of the sample's best rows)
    only set the floor; a question with fewer than k rows so far has none and meets all bands."""
    s = _search(queries, bank, q_key=q_key, b_key=b_key, q_vec=q_vec, b_vec=b_vec, k=k, include_self=include_self,
                cells=cells, probes=probes, recall=recall, block_rows=block_rows)
    first = write_stage(s.best, "vector-first")
    rest = _scored(_reached(_with_floor(s, first, q_key, k), q_key, q_vec, _bands(s.bank), s.model, s.model.probes),
                   _in_bands(s.bank, s.model), q_key, b_key, q_vec, b_vec, k, not include_self, block_rows)
    return _best(first.select(q_key, b_key, "sim").unionByName(rest), q_key, b_key, k)


def _with_floor(s: Search, first: DataFrame, q_key: str, k: int) -> DataFrame:
    floor = first.filter(F.col("rank") == k).select(q_key, F.col("sim").alias("_floor"))
    return s.questions.join(floor, q_key, "left").withColumn("_floor", F.coalesce("_floor", F.lit(-2.0)))


def pairs_above(queries: DataFrame, bank: DataFrame, *, q_key: str, b_key: str, q_vec: str, b_vec: str,
                threshold: float, cells: int | None = None, block_rows: int | None = None) -> DataFrame:
    """Every pair with cosine (6 decimals) of at least ``threshold``, which must be above 0: pairs that
    score 0 are not looked at. A question meets the bands whose bound reaches the threshold."""
    if threshold <= 0:
        raise ValueError("threshold must be above 0")

    model = fit_cells(bank, b_key, b_vec, k=1, cells=cells) or NOTHING
    b, q = _place(bank, b_key, b_vec, model), _place(queries, q_key, q_vec, model)
    met = _reached(q.withColumn("_floor", F.lit(float(threshold))), q_key, q_vec, _bands(b), model, 0)
    met = met.unionByName(_other_widths(q).withColumn("_meets", F.array("_group")).select(q_key, q_vec, "_group", "_meets"))
    rows = _in_bands(b, model).unionByName(_other_widths(b).withColumn("_at", F.col("_group")))
    return blocks.grid_scores(met, rows, q_key=q_key, b_key=b_key, kernel=_kernel(q_vec, b_vec, threshold), k=ALL, group="_group",
                              block_rows=block_rows).select(q_key, b_key, "sim")


def skipped_share(queries: DataFrame, bank: DataFrame, *, q_key: str, b_key: str, q_vec: str, b_vec: str, k: int,
                  include_self: bool = True, recall: float = 0.5, cells: int | None = None) -> DataFrame:
    """How much the exact search leaves out: ``n_pairs, n_scored, skipped`` over the bank rows
    it keeps, from counts of questions and rows per cell and band."""
    s = _search(queries, bank, q_key=q_key, b_key=b_key, q_vec=q_vec, b_vec=b_vec, k=k, include_self=include_self,
                cells=cells, probes=None, recall=recall, block_rows=None)
    first = write_stage(s.best, "vector-first")
    per = lambda rows, at, n: rows.groupBy(at.alias("_at")).agg(F.count("*").alias(n))
    near = _nearest(s.questions, q_key, q_vec, s.model).select(F.explode("_meets").alias("_m"))
    met = per(near, F.col("_m"), "m").join(per(_in_cells(s.bank, s.model), F.col("_at"), "n"), "_at")
    reached = _reached(_with_floor(s, first, q_key, k), q_key, q_vec, _bands(s.bank), s.model, s.model.probes)
    later = per(reached.select(F.explode("_meets").alias("_m")), F.col("_m"), "m").join(
        per(_in_bands(s.bank, s.model), F.col("_at"), "n"), "_at")
    scored = met.unionByName(later).agg(F.coalesce(F.sum(F.col("m") * F.col("n")), F.lit(0)).alias("n_scored"))
    n_pairs = s.questions.count() * s.bank.count()
    return scored.select(F.lit(n_pairs).alias("n_pairs"), "n_scored",
                         F.try_divide(F.lit(n_pairs) - F.col("n_scored"), F.lit(n_pairs)).alias("skipped"))
