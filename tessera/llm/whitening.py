"""Embedding whitening: principal components of whole-number vectors, scaled to unit variance.

Entries become longs, ``floor(1024 * c) + 100000``, so that counts, sums and
deviations are exact. Three statistics are gathered over all vectors, each by a
pass of numpy partial results per partition that Spark adds up: number and sums,
the centred scatter, and the covariance of the result. Only d x d numbers come
to the driver (d: entries of a vector), whatever the number of rows.

The factors come from the scatter's pivoted Cholesky factor L: one-sided Jacobi
rotations turn the columns of L until they are orthogonal. Then L J = U s, so
the scatter is U s^2 U': the squared norms of the rotated columns are its
eigenvalues and the normalised columns its eigenvectors. No product of L with
itself is formed, so small eigenvalues keep their digits.

A component's sign makes its largest entry positive. Components without
variance (their eigenvalue is below ``RANK`` of the largest) can't be scaled and
are left out, so fewer than ``k`` may remain.

Defined cases: rows whose vector is null or empty or holds a null, NaN or
infinite entry are dropped, and so are vectors with an entry beyond +-2**40 (no
exact double holds their long) and vectors whose length isn't the commonest one
(of equally common lengths the greatest); a null id and repeated rows each stay
a row; a deviation that no long holds is null; without a row, or with equal
vectors only, the result is empty; extra columns are not read, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
LARGEST = float(2 ** 40)
RANK = 1e-13
COMPONENTS = 8
_ROWS = 8192  # vectors turned at once


def whole_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and x (array of long) of the rows whose vectors can be used, all of one length."""
    c = F.col(vector_col).cast("array<double>")
    own = embeddings.select(F.col(id_col).alias("vec_id"), c.alias("c"))
    own = own.where(F.expr(f"size(c) > 0 and forall(c, v -> v is not null and abs(v) <= {LARGEST!r}D)"))  # NaN is above
    common = own.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = common[0]["d"] if common else 0
    return own.where(F.size("c") == d).select("vec_id", F.transform(
        "c", lambda v: F.floor(F.lit(float(SCALE)) * v).cast("long") + F.lit(SHIFT)).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _batches(batches: Iterator[pa.RecordBatch], field: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            yield part, _matrix(part.column(field))


def _added(df: DataFrame, partial: Callable[[np.ndarray], np.ndarray], field: int, kind: str, wide: str) -> dict[int, np.ndarray]:
    """Sums over all rows of ``partial`` (one matrix a partition), its rows added by number in Spark."""
    def run(batches):
        total = None
        for _, x in _batches(batches, field):
            own = partial(x)
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.int64() if kind == "long" else pa.float64()))],
                ["i", "v"])

    parts = df.mapInArrow(run, f"i int, v array<{kind}>").select("i", F.posexplode("v").alias("j", "value"))
    sums = parts.groupBy("i", "j").agg(F.sum(F.col("value").cast(wide)).alias("s")).collect()  # d x d numbers at most
    out: dict[int, dict] = {}
    for r in sums:
        out.setdefault(r["i"], {})[r["j"]] = r["s"]
    return {i: [row[j] for j in sorted(row)] for i, row in out.items()}


def moments(vectors: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and their exact sums by entry."""
    def partial(x):  # in two halves, so that no partition's sum leaves a long
        return np.stack([np.r_[0, (x >> 24).sum(0)], np.r_[len(x), (x & 0xFFFFFF).sum(0)]])

    total = _added(vectors.select("x"), partial, 0, "long", "decimal(38,0)")
    row = [(int(a) << 24) + int(b) for a, b in zip(total.get(0, [0]), total.get(1, [0]))]
    return row[0], row[1:]


def centred_scatter(vectors: DataFrame, mean: np.ndarray) -> np.ndarray:
    """Sum of (x - mean)(x - mean)' over all rows, centred before multiplying."""
    def partial(x):
        own = x - mean
        return own.T @ own

    total = _added(vectors, partial, len(vectors.columns) - 1, "double", "double")
    return np.array([total[i] for i in range(len(mean))], float)


def pivoted_cholesky(a: np.ndarray, least: float = 1e-15) -> tuple[np.ndarray, np.ndarray]:
    """Lower-trapezoidal L (d x rank) and the order p of rows with ``a[p][:, p] = L L'``.

    The largest remaining diagonal entry is taken first; it ends where that is
    ``least`` of the first one.
    """
    a = np.array(a, float)
    d = len(a)
    p, low = np.arange(d), np.zeros((d, d))
    left = np.diag(a).copy()
    top = left.max(initial=0.0)
    for k in range(d):
        at = k + int(np.argmax(left[k:]))
        if left[at] <= least * top:
            return low[:, :k], p
        for v in (p, left, low):
            v[[k, at]] = v[[at, k]]
        low[k, k] = np.sqrt(left[k])
        low[k + 1:, k] = (a[p[k + 1:], p[k]] - low[k + 1:, :k] @ low[k, :k]) / low[k, k]
        left[k + 1:] -= low[k + 1:, k] ** 2
    return low, p


def one_sided_jacobi(low: np.ndarray, sweeps: int = 60, enough: float = 1e-15) -> np.ndarray:
    """Columns of ``low`` rotated in pairs until all are orthogonal."""
    g = np.array(low, float)
    rank = g.shape[1]
    for _ in range(sweeps):
        turned = False
        for i in range(rank - 1):
            for j in range(i + 1, rank):
                alpha, beta, gamma = g[:, i] @ g[:, i], g[:, j] @ g[:, j], g[:, i] @ g[:, j]
                if abs(gamma) <= enough * np.sqrt(alpha * beta):
                    continue
                turned = True
                zeta = (beta - alpha) / (2 * gamma)
                t = (1.0 if zeta >= 0 else -1.0) / (abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                g[:, i], g[:, j] = c * g[:, i] - c * t * g[:, j], c * t * g[:, i] + c * g[:, j]
        if not turned:
            break
    return g


@dataclass
class Whitening:
    n: int
    sums: list[int]
    eigenvalues: np.ndarray  # of the covariance, falling
    components: np.ndarray  # a unit eigenvector a column
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums], float)

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.components / np.sqrt(self.eigenvalues)


def factors(scatter: np.ndarray, n: int, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """The k greatest eigenvalues of ``scatter / n``, their eigenvectors as columns, and its trace."""
    covariance = scatter / n
    low, order = pivoted_cholesky(covariance)
    g = one_sided_jacobi(low)
    norms = np.sqrt((g * g).sum(0))
    by = np.argsort(-norms, kind="stable")[:k]
    by = by[norms[by] ** 2 > RANK * norms.max(initial=0.0) ** 2]
    vectors = np.empty((len(scatter), len(by)))
    vectors[order] = g[:, by] / norms[by]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(by))]) if len(by) else np.ones(0)
    return norms[by] ** 2, vectors * signs, float(np.trace(covariance))


def fit(vectors: DataFrame, k: int = COMPONENTS) -> Whitening | None:
    """Components of all rows of ``whole_vectors``; None without variance."""
    n, sums = moments(vectors)
    if not n:
        return None
    mean = np.array([s / n for s in sums], float)
    values, components, trace = factors(centred_scatter(vectors.select("x"), mean), n, k)
    return Whitening(n, sums, values, components, trace) if len(values) else None


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, x and the array ``white`` of every row."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    id_type = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for part, x in _batches(batches, 1):
            white = shared.value.project(x)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.FixedSizeListArray.from_arrays(pa.array(white.ravel()), white.shape[1]).cast(pa.list_(pa.float64()))],
                ["vec_id", "x", "white"])

    return vectors.select("vec_id", "x").mapInArrow(run, f"vec_id {id_type}, x array<long>, white array<double>")


def identity_error(white: DataFrame, n: int, k: int) -> float:
    """Largest absolute entry of the covariance of ``white`` minus the identity."""
    own = white.select("white")
    total = _added(own, lambda w: w.sum(0)[None, :], 0, "double", "double")[0]
    scatter = centred_scatter(own, np.array(total, float) / n)
    return float(np.abs(scatter / n - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over entries of (n * x - S)^2 by row, exact; null where no long holds it."""
    s = np.array(sums, object)
    most = n * int(np.abs(x).max(initial=0)) + max((abs(v) for v in sums), default=0)
    if most * most * max(1, x.shape[1]) < 2 ** 63:
        own = n * x - np.array(sums, np.int64)
        return (own * own).sum(1).tolist()
    # n * x and S share a large part: the difference from whole means is small
    whole = np.array([v // n for v in sums], np.int64)
    rest = np.array([v % n for v in sums], np.int64)
    near = x - whole
    most = n * int(np.abs(near).max(initial=0)) + n
    if most * most * max(1, x.shape[1]) < 2 ** 63:
        own = n * near - rest
        return (own * own).sum(1).tolist()
    exact = ((n * x.astype(object) - s) ** 2).sum(1)
    return [int(v) if v < 2 ** 63 else None for v in exact]


def whitened_rows(white: DataFrame, model: Whitening, error: float) -> DataFrame:
    """A row for each vector and component: component, n, deviation, whitened, explained, identity_error."""
    shared = white.sparkSession.sparkContext.broadcast((model.n, model.sums, (model.eigenvalues / model.trace).tolist()))
    id_type = white.schema["vec_id"].dataType.simpleString()
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches):
        n, sums, explained = shared.value
        k = len(explained)
        for part, x in _batches(batches, 1):
            rows = part.num_rows
            at = pa.array(np.repeat(np.arange(rows), k))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                 pa.array(np.full(rows * k, n, np.int64)), pa.array(deviations(x, n, sums), pa.int64()).take(at),
                 part.column(2).flatten(), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error))], names)

    return white.mapInArrow(run, f"vec_id {id_type}, component int, n long, deviation long, whitened double, "
                                 "explained double, identity_error double")


def whiten_all(vectors: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """Fit on all rows of ``whole_vectors``, whiten them and measure the result."""
    model = fit(vectors, k)
    if model is None:
        own = vectors.limit(0).select("vec_id", "x", F.array().cast("array<double>").alias("white"))
        return whitened_rows(own, Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 1.0), 0.0)
    white = whiten(vectors, model)
    return whitened_rows(white, model, identity_error(white, model.n, len(model.eigenvalues)))
