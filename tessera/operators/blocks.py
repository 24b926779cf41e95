"""Exact top-k similarity without a cross join: the block grid.

The reference scores every question against every bank example (a dense
Q x B matrix) and keeps the top k. Materialising those pairs as Spark rows
(a cross join) costs Q x B rows of shuffle. Instead, like a blocked matrix
multiply:

1. both sides are hashed into blocks of at most ``block_rows`` rows
   (per group when pairs are only allowed inside a group, so a hot group is
   split into several blocks instead of landing in one task); blocks grow with
   the sides up to ``MAX_BLOCK_ROWS``, so that rows are copied to few tiles;
2. each block is written once, as one row, and block rows meet block rows in
   ``crossJoin(...).mapInArrow``: a task reads the blocks it pairs from the shared
   folder, so no row is shuffled more than once (inside groups, and up to
   ``COPIED_AT_MOST`` numbers, each row is replicated to the blocks of the other
   side, and ``cogroup(...).applyInPandas`` hands one tile to one task);
3. the task scores the tile with numpy (a matmul), some questions at a time, and
   emits only its local top-k per question, ties included by a total order;
4. a ``row_number`` window partitioned by question merges the local lists.

The result equals a full sort of all pairs, because every tile keeps its k
best under the same total order (score rounded to 6 dp desc, tie columns asc,
bank key asc). Shuffle and written volume is O(Q + B) and the local lists (inside
groups O((Q + B) x tiles-per-side)), and no task ever scores more than one tile.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import ship_package, write_stage

DEFAULT_BLOCK_ROWS = 2048
MAX_BLOCK_ROWS = 16384
DEFAULT_BLOCK_WEIGHT = 2_000_000  # numbers per block side
TILES_PER_CORE = 16  # of a large grid, as long as blocks stay under MAX_BLOCK_ROWS
COPIED_AT_MOST = 1 << 23  # numbers that a grid without groups copies to tiles
STRIP_SCORES = 1 << 20  # scores of a tile that are held at once
FIRST_COLUMNS = 64  # bank rows of a strip whose k best are the first floor of the others
STAT_PREFIX = "#"


# ---------------------------------------------------------------- kernels


def _unit_rows(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1))
    out = np.zeros_like(m)
    nz = norm > 0
    out[nz] = m[nz] / norm[nz, None]
    return out


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Unit rows; a null vector, one of another length and one with a null or
    non-finite element become zero rows."""
    out = np.zeros((len(vectors), width))
    rows = [(k, np.asarray(v)) for k, v in enumerate(vectors) if v is not None and np.ndim(v) == 1 and len(v) == width]
    plain = [(k, v) for k, v in rows if v.dtype != object]
    if plain and width:
        out[[k for k, _ in plain]] = np.stack([v for _, v in plain])
    for k, v in rows:
        if v.dtype == object:
            out[k] = [np.nan if x is None else x for x in v]
    out[~np.isfinite(out).all(axis=1)] = 0.0
    return _unit_rows(out)


def dense_strips(qv: pd.Series, bv: pd.Series):
    """Function of a slice of question rows: their cosines with all bank rows.

    Pairs of different lengths and pairs with a null, zero or bad vector score 0.
    """
    lens = lambda s: {len(v) for v in s if v is not None and np.ndim(v) == 1 and len(v)}
    units = [(_matrix(qv, width), _matrix(bv, width).T) for width in sorted(lens(qv) & lens(bv))]

    def strip(rows: slice) -> np.ndarray:
        scores = [q[rows] @ b for q, b in units]
        return sum(scores[1:], scores[0]) if scores else np.zeros((len(qv.iloc[rows]), len(bv)))

    return strip


def dense_cosine(qv: pd.Series, bv: pd.Series) -> np.ndarray:
    """Cosine of every row pair of two vector columns."""
    return dense_strips(qv, bv)(slice(None))


# ---------------------------------------------------------------- local top-k


def local_topk(score: np.ndarray, valid: np.ndarray | None, tie_rank: np.ndarray, k: int):
    """Indices (qi, bi) and rounded scores of the k best per row.

    Order: score rounded to 6 dp descending, then ``tie_rank`` ascending (a
    total order over the block's bank rows). Invalid cells never qualify.
    Linear per row even when every score ties: the k-th value is found by a
    partition, entries above it are kept, and the remaining places go to the
    smallest tie ranks among entries equal to it (a second partition).
    """
    nq, nb = score.shape
    r = np.round(score, 6)
    if valid is not None:
        r = np.where(valid, r, -np.inf)
    kk = min(k, nb)
    if kk <= 0 or nq == 0:
        e = np.zeros(0, dtype=np.int64)
        return e, e, np.zeros(0)
    kth = -np.partition(-r, kk - 1, axis=1)[:, kk - 1]
    greater = r > kth[:, None]
    need = kk - greater.sum(axis=1)
    big = np.iinfo(np.int64).max
    ties = np.where((r == kth[:, None]) & np.isfinite(r), tie_rank[None, :].astype(np.int64), big)
    smallest = np.sort(np.partition(ties, kk - 1, axis=1)[:, :kk], axis=1)
    take = (np.arange(kk)[None, :] < need[:, None]) & (smallest < big)
    col_of_rank = np.empty(nb, dtype=np.int64)
    col_of_rank[tie_rank] = np.arange(nb)
    tq, tpos = np.nonzero(take)
    tb = col_of_rank[smallest[tq, tpos]]
    gq, gb = np.nonzero(greater)
    qi = np.concatenate([gq, tq])
    bi = np.concatenate([gb, tb])
    vals = r[qi, bi]
    o = np.lexsort((tie_rank[bi], -vals, qi))
    return qi[o], bi[o], vals[o]


def _round6(score: np.ndarray) -> np.ndarray:
    return np.round(score, 6)


def at_least(score: np.ndarray, threshold: float) -> np.ndarray:
    """The scores that round to at least ``threshold``, -inf in place of the others."""
    near = np.flatnonzero(score >= threshold - 1e-6)
    near = near[_round6(score.flat[near]) >= threshold]
    out = np.full(score.shape, -np.inf)
    out.flat[near] = score.flat[near]
    return out


def ordered_topk(score: np.ndarray, k: int, rounded=_round6):
    """Like ``local_topk`` where columns stand in tie order and invalid scores are -inf.

    The columns so far give a floor for each row. Of the next only scores that
    round to more than it are looked at: a tie goes to an earlier column.
    """
    nq, nb = score.shape
    if k >= nb:
        qi, bi = np.divmod(np.flatnonzero(np.isfinite(score)), max(1, nb))
        return qi, bi, rounded(score[qi, bi])
    done = min(nb, max(FIRST_COLUMNS, 4 * k))
    qi, bi, vals = local_topk(rounded(score[:, :done]), None, np.arange(done), k)
    while done < nb:  # wider steps as the floor rises
        upto = min(nb, 8 * done)
        found = np.bincount(qi, minlength=nq)
        floor, full = np.full(nq, -np.inf), found == k
        floor[full] = vals[np.cumsum(found)[full] - 1]
        more_q, more_b = np.divmod(np.flatnonzero(score[:, done:upto] > (floor + 4e-7)[:, None]), upto - done)
        more = rounded(score[more_q, more_b + done])
        above = more > floor[more_q]
        qi, bi, vals = (np.concatenate(x) for x in ((qi, more_q[above]), (bi, more_b[above] + done), (vals, more[above])))
        o = np.lexsort((bi, -vals, qi))
        qi, bi, vals = qi[o], bi[o], vals[o]
        keep = np.arange(len(qi)) - np.searchsorted(qi, np.arange(nq))[qi] < k
        qi, bi, vals, done = qi[keep], bi[keep], vals[keep], upto
    return qi, bi, vals


# ---------------------------------------------------------------- grid


@dataclass
class Kernel:
    """How a tile is scored.

    ``score(q_pdf, b_pdf)`` returns ``({mode: matrix}, {stat: per-question
    vector})``; every mode is ranked separately, every stat is summed over
    the question's tiles. Instead of a matrix there may be a function of a slice
    of question rows, which returns their rows of it. ``rounded`` rounds scores.
    """

    q_cols: list[str]
    b_cols: list[str]
    score: object
    modes: list[str] = field(default_factory=lambda: ["sim"])
    # optional row weights (functions of the functions module -> Column) that
    # bound a block's total weight, e.g. the numbers of its vectors
    q_weight: object = None
    b_weight: object = None
    rounded: object = _round6


def dense_kernel(q_vec: str, b_vec: str) -> Kernel:
    return Kernel([q_vec], [b_vec], lambda q, b: ({"sim": dense_strips(q[q_vec], b[b_vec])}, {}),
                  q_weight=vector_weight(q_vec), b_weight=vector_weight(b_vec))


def vector_weight(col: str):
    """Weight of a row = numbers in its vector."""
    return lambda f: f.coalesce(f.size(f.col(col)), f.lit(0)).cast("long")


def _spark_type(df: DataFrame, c: str) -> T.DataType:
    return df.schema[c].dataType


def grid_scores(queries: DataFrame, bank: DataFrame, *, q_key: str, b_key: str,
                kernel: Kernel, k: int, tie_cols: list[str] | None = None,
                group: str | None = None, exclude_self: bool = False,
                block_rows: int | None = None,
                block_weight: float = DEFAULT_BLOCK_WEIGHT,
                broadcast_small: bool = True, in_place: bool = False) -> DataFrame:
    """Local top-k rows of every tile: ``q_key, b_key, tie cols, mode, sim``.

    ``block_rows`` defaults to what gives every core ``TILES_PER_CORE`` tiles, from
    DEFAULT_BLOCK_ROWS to MAX_BLOCK_ROWS (inside groups: MAX_BLOCK_ROWS).
    ``in_place`` (sides that lie in files): blocks are rows that lie together, so
    that packing them shuffles nothing.

    Rows whose mode starts with ``#`` carry per-question statistics in
    ``sim``. Use :func:`merge_topk` / :func:`merge_stats` on the result.
    """
    tie_cols = list(tie_cols or [])
    spark = queries.sparkSession
    ship_package(spark)
    q = queries.select(q_key, *([group] if group else []), *kernel.q_cols)
    b = bank.select(b_key, *([group] if group else []), *tie_cols, *kernel.b_cols)
    # Row weights: a tile is bounded by rows and, for weighted kernels
    # (vectors), by total weight, so long rows make more, smaller blocks.
    qw = kernel.q_weight(F) if kernel.q_weight else F.lit(1)
    bw = kernel.b_weight(F) if kernel.b_weight else F.lit(1)
    wmax = block_weight

    def nblocks(n, w):
        return F.greatest(F.lit(1), F.ceil(n / (block_rows or MAX_BLOCK_ROWS)), F.ceil(w / wmax)).cast("int")

    if group is None:
        # Counts and weights of both sides in one job pick the grid shape;
        # nothing else reaches the driver.
        sides = (q.select(F.lit(0).alias("_side"), qw.cast("double").alias("_w"))
                 .unionByName(b.select(F.lit(1).alias("_side"), bw.cast("double").alias("_w")))
                 .groupBy("_side").agg(F.count("*").alias("n"), F.sum("_w").alias("w")).collect())
        n = {r["_side"]: (r["n"], r["w"] or 0.0) for r in sides}
        nq, wq = n.get(0, (0, 0.0))
        nb, wb = n.get(1, (0, 0.0))
        if block_rows is None:
            tiles = TILES_PER_CORE * spark.sparkContext.defaultParallelism
            block_rows = min(MAX_BLOCK_ROWS, max(DEFAULT_BLOCK_ROWS, math.isqrt(nq * nb // tiles)))
        nqb = max(1, math.ceil(nq / block_rows), math.ceil(wq / wmax))
        nbb = max(1, math.ceil(nb / block_rows), math.ceil(wb / wmax))
        # The question side fits one block (rows and weight counted above):
        # ship it once to the executors and score the bank where it lies,
        # so the bank is never shuffled. Beyond that bound the grid runs.
        small_questions = broadcast_small and nq > 0 and nqb == 1
        packed = wq * nbb + wb * nqb > COPIED_AT_MOST
        q, b = (x.withColumns({"_pack": F.lit(""), "_nqb": F.lit(nqb), "_nbb": F.lit(nbb)}) for x in (q, b))
    else:
        small_questions = packed = False
        # Per-group grid shape. A group needing one tile shares a "pack" with
        # other small groups (hash of the group); a larger group gets its own
        # grid of tiles, so one hot group is spread over many tasks.
        sizes = (
            q.groupBy(group).agg(F.count("*").alias("_nq"), F.sum(qw).alias("_wq"))
            .join(b.groupBy(group).agg(F.count("*").alias("_nb"), F.sum(bw).alias("_wb")), group)
            .select(group, nblocks(F.col("_nq"), F.col("_wq")).alias("_nqb"),
                    nblocks(F.col("_nb"), F.col("_wb")).alias("_nbb"))
        )
        n_packs = int(spark.conf.get("spark.sql.shuffle.partitions", "200")) * 2
        single = (F.col("_nqb") == 1) & (F.col("_nbb") == 1)
        pack = F.when(single, F.concat(F.lit("p"), F.pmod(F.xxhash64(F.col(group)), F.lit(n_packs))
                                      .cast("string"))).otherwise(
            F.concat(F.lit("g"), F.col(group).cast("string")))
        sizes = sizes.withColumn("_pack", pack)
        q = q.join(sizes, group)  # inner: groups without a bank side give nothing
        b = b.join(sizes, group)
    qkt, bkt = _spark_type(queries, q_key), _spark_type(bank, b_key)
    fields = [T.StructField(q_key, qkt), T.StructField(b_key, bkt)]
    fields += [T.StructField(c, _spark_type(bank, c)) for c in tie_cols]
    fields += [T.StructField("mode", T.StringType()), T.StructField("sim", T.DoubleType())]
    schema = T.StructType(fields)
    names = [f.name for f in fields]
    if q_key == b_key:
        raise ValueError("question and bank keys need distinct column names")

    def tile(qpdf: pd.DataFrame, bpdf: pd.DataFrame) -> pd.DataFrame:
        if qpdf.empty or bpdf.empty:
            return pd.DataFrame({n: [] for n in names})
        if group is not None and qpdf[group].nunique() > 1:
            outs = []
            if len(qpdf):
                bgroups = dict(tuple(bpdf.groupby(group, sort=False)))
                outs += [one_group(qg, bgroups[g]) for g, qg in qpdf.groupby(group, sort=False)
                         if g in bgroups]
            outs = [o for o in outs if len(o)]
            return pd.concat(outs, ignore_index=True) if outs else pd.DataFrame({n: [] for n in names})
        return one_group(qpdf, bpdf)

    def one_group(qpdf: pd.DataFrame, bpdf: pd.DataFrame) -> pd.DataFrame:
        order_keys = [bpdf[c].to_numpy() for c in [b_key, *reversed(tie_cols)]]
        bpdf = bpdf.iloc[np.lexsort(order_keys)].reset_index(drop=True)
        qpdf = qpdf.reset_index(drop=True)
        modes, stats = kernel.score(qpdf, bpdf)
        qkeys, bkeys = qpdf[q_key].to_numpy(), bpdf[b_key].to_numpy()
        same_q = same_b = np.zeros(0, dtype=np.int64)
        if exclude_self:
            keyed = [pd.DataFrame({"key": x, side: np.arange(len(x))}).dropna() for side, x in (("q", qkeys), ("b", bkeys))]
            same = keyed[0].merge(keyed[1], on="key").sort_values("q")
            same_q, same_b = same["q"].to_numpy(), same["b"].to_numpy()
        step = max(1, STRIP_SCORES // len(bpdf))
        parts = []
        for mode, scores in modes.items():
            for at in range(0, len(qpdf), step):
                rows = slice(at, min(at + step, len(qpdf)))
                mat = scores(rows) if callable(scores) else scores[rows].copy()
                own = slice(*np.searchsorted(same_q, [rows.start, rows.stop]))
                mat[same_q[own] - at, same_b[own]] = -np.inf
                qi, bi, vals = ordered_topk(mat, k, kernel.rounded)
                d = {q_key: qkeys[qi + at], b_key: bkeys[bi]}
                for c in tie_cols:
                    d[c] = bpdf[c].to_numpy()[bi]
                d["mode"] = mode
                d["sim"] = vals
                parts.append(pd.DataFrame(d))
        for name, vec in stats.items():
            d = {q_key: qkeys, b_key: bkeys[0]}
            for c in tie_cols:
                d[c] = bpdf[c].to_numpy()[0]
            d["mode"] = STAT_PREFIX + name
            d["sim"] = np.asarray(vec, dtype=np.float64)
            parts.append(pd.DataFrame(d))
        return pd.concat(parts, ignore_index=True)[names]

    if small_questions:
        bank_in = b.select(b_key, *tie_cols, *kernel.b_cols).withColumn("_w", bw.cast("double"))
        cores = spark.sparkContext.defaultParallelism
        if nb <= 64 * block_rows and cores > 1:
            # a small bank may sit in one coalesced partition: spread it over
            # the cores (cheap at this size); a large bank keeps its own
            # partitioning and is never shuffled
            bank_in = bank_in.repartition(min(cores, max(1, math.ceil(nb / 64))))
        return _scan_bank(spark, q.select(q_key, *kernel.q_cols), bank_in, one_group, schema, block_rows, wmax)

    if packed:
        q, b = q.select(q_key, *kernel.q_cols), b.select(b_key, *tie_cols, *kernel.b_cols)
        if in_place:
            q, b = (_packed_in_place(x.withColumn("_weight", w.cast("double")), n, rows, weight, name)
                    for x, w, n, rows, weight, name in ((q, qw, nqb, nq, wq, "_q"), (b, bw, nbb, nb, wb, "_b")))
        else:
            q, b = _packed(q, q_key, nqb, "_q"), _packed(b, b_key, nbb, "_b")
        return _cross_blocks(q, b, one_group, schema)

    qx = (q.withColumn("_qb", F.pmod(F.xxhash64(F.col(q_key)), F.col("_nqb").cast("long")).cast("int"))
            .withColumn("_bb", F.explode(F.sequence(F.lit(0), F.col("_nbb") - 1))))
    bx = (b.withColumn("_bb", F.pmod(F.xxhash64(F.col(b_key)), F.col("_nbb").cast("long")).cast("int"))
            .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.col("_nqb") - 1))))
    gsel = [group] if group else []
    qx = qx.select(*gsel, "_pack", "_qb", "_bb", q_key, *kernel.q_cols)
    bx = bx.select(*gsel, "_pack", "_qb", "_bb", b_key, *tie_cols, *kernel.b_cols)
    # fresh attribute ids: both sides may come from one source DataFrame
    qx = qx.select(*[F.col(c).alias(c) for c in qx.columns])
    bx = bx.select(*[F.col(c).alias(c) for c in bx.columns])
    keys = ["_pack", "_qb", "_bb"]
    return qx.groupBy(*keys).cogroup(bx.groupBy(*keys)).applyInPandas(tile, schema)


def _packed(df: DataFrame, key: str, blocks: int, name: str) -> DataFrame:
    """``{name}, {name}n``: the rows of each block as one list, and the block's number; a file each, so that
    tasks read them apart."""
    block = F.pmod(F.xxhash64(F.col(key)), F.lit(blocks)).alias(name + "n")
    rows = df.groupBy(block).agg(F.collect_list(F.struct(*df.columns)).alias(name))
    return write_stage(rows, "grid-blocks", rows_a_file=1)


def _packed_in_place(df: DataFrame, blocks: int, rows: int, weight: float, name: str) -> DataFrame:
    """Like ``_packed``, of rows that lie together: a block ends with its partition, or where it has its
    share of all rows or of their ``_weight``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    most_rows, most_weight = math.ceil(rows / blocks), max(1.0, weight / blocks)
    number = name + "n"
    schema = T.StructType([T.StructField(name, T.ArrayType(df.drop("_weight").schema)), T.StructField(number, T.StringType())])
    out, fields = to_arrow_schema(schema), [c for c in df.columns if c != "_weight"]

    def packed(parts) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        lists = pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), pa.StructArray.from_arrays(whole.columns, whole.schema.names))
        return pa.RecordBatch.from_arrays([lists.cast(out.field(0).type), pa.array([uuid.uuid4().hex])], schema=out)

    def run(batches):
        parts, held, heavy = [], 0, 0.0
        for batch in batches:
            weights = np.cumsum(batch.column("_weight").fill_null(0).to_numpy())
            batch, at = batch.select(fields), 0
            while at < len(batch):
                before = weights[at - 1] if at else 0.0
                end = min(at + most_rows - held, int(np.searchsorted(weights, before + most_weight - heavy, "right")))
                end = max(end, at + (not parts))
                if end > at:
                    parts.append(batch.slice(at, end - at))
                    held, heavy = held + end - at, heavy + weights[end - 1] - before
                if end < len(batch):
                    yield packed(parts)
                    parts, held, heavy = [], 0, 0.0
                at = end
        if parts:
            yield packed(parts)

    return write_stage(df.coalesce(blocks).mapInArrow(run, schema), "grid-blocks", rows_a_file=1)


def _cross_blocks(q: DataFrame, b: DataFrame, score_block, schema: T.StructType) -> DataFrame:
    """Every question block meets every bank block: rows of the join are blocks."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)

    def frame(block) -> pd.DataFrame:
        return pa.RecordBatch.from_struct_array(block.values).to_pandas()

    def run(batches):
        number, qp = None, None
        for batch in batches:
            qs, bs, qn = batch.column("_q"), batch.column("_b"), batch.column("_qn").to_pylist()
            for k in range(batch.num_rows):
                if qn[k] != number:  # the pairs of a question block follow each other
                    number, qp = qn[k], frame(qs[k])
                found = score_block(qp, frame(bs[k]))
                if len(found):
                    yield pa.RecordBatch.from_pandas(found, schema=out, preserve_index=False)

    return q.crossJoin(b).mapInArrow(run, schema)


def _scan_bank(spark, q: DataFrame, b: DataFrame, score_block, schema: T.StructType,
               block_rows: int, block_weight: float) -> DataFrame:
    """Score every bank partition in place against the broadcast question
    block (at most ``block_rows`` rows and ``block_weight`` weight, checked
    by the caller's count). Bank batches are cut into chunks bounded the
    same way; each chunk emits its local top-k like a tile."""
    q_block = spark.sparkContext.broadcast(q.toPandas())

    def scan(batches):
        qp = q_block.value
        for bp in batches:
            w = np.cumsum(bp["_w"].fillna(0).to_numpy())
            start, n = 0, len(bp)
            while start < n:
                base = w[start - 1] if start else 0.0
                end = min(start + block_rows, int(np.searchsorted(w, base + block_weight, "right")))
                end = max(end, start + 1)
                out = score_block(qp, bp.iloc[start:end])
                if len(out):
                    yield out
                start = end

    return b.mapInPandas(scan, schema)


def merge_topk(tiles: DataFrame, q_key: str, b_key: str, k: int,
               tie_cols: list[str] | None = None, mode: str = "sim") -> DataFrame:
    """Global top-k per question from the tiles' local lists: ``rank`` 1..k."""
    tie_cols = list(tie_cols or [])
    w = Window.partitionBy(q_key).orderBy(
        F.col("sim").desc(), *[F.col(c).asc() for c in tie_cols], F.col(b_key).asc())
    return (tiles.filter(F.col("mode") == mode).drop("mode")
            .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)  # as an int: limited below the shuffle too
            .withColumn("rank", F.col("rank").cast("long")))


def merge_stats(tiles: DataFrame, q_key: str, names: list[str]) -> DataFrame:
    """Per-question statistics: one column per name (``#name`` mode), summed
    over the question's tiles (partial aggregation, no pivot pass)."""
    st = tiles.filter(F.startswith(F.col("mode"), F.lit(STAT_PREFIX)))
    return st.groupBy(q_key).agg(*[F.sum(F.when(F.col("mode") == STAT_PREFIX + n, F.col("sim")))
                                   .alias(n) for n in names])


def topk(queries: DataFrame, bank: DataFrame, *, q_key: str, b_key: str, kernel: Kernel,
         k: int, tie_cols: list[str] | None = None, group: str | None = None,
         exclude_self: bool = False, block_rows: int | None = None,
         block_weight: float = DEFAULT_BLOCK_WEIGHT) -> DataFrame:
    """Top-k bank rows per question: ``q_key, rank, b_key, tie cols, sim``."""
    tiles = grid_scores(queries, bank, q_key=q_key, b_key=b_key, kernel=kernel, k=k,
                        tie_cols=tie_cols, group=group, exclude_self=exclude_self,
                        block_rows=block_rows, block_weight=block_weight)
    return merge_topk(tiles, q_key, b_key, k, tie_cols)
