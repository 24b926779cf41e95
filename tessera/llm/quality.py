"""Quality classifier: ordinal cumulative-link regression on hashed text.

A document has one score, the sum of the weights of its distinct hashed tokens
and shape marks. Ordered thresholds turn the score into grades:
``P(grade >= k) = sigmoid(score - threshold[k])``. The weights are shared by all
thresholds; the thresholds stay ordered because their gaps are exponentials.
Selection uses the tail probability ``P(grade >= keep_grade)``; the expected
grade ranks what is kept.

Fit: at most ``max_train`` labelled documents (a documented bound; chosen by a
hash of their id) are turned into token hashes on the executors, and only those
hashes come to the driver, where numpy fits weights and thresholds. Scoring is
one pass over all documents with the weights broadcast (2 ** BITS floats, a
fixed size); nothing is shuffled.

Defined cases: null and empty texts have no tokens and get the score 0; a
document with several labels takes the lowest grade; labels with a null are not
used; without labels of two grades every document is kept with a null score; of
rows that share a labelled id one is learned from; repeated rows each give a row;
an empty table gives no rows; extra columns are kept by ``keep`` and not read
otherwise, whatever their names; a very long text is scored whole.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import byte_texts, map_slices, slices

BITS = 20
MAX_TRAIN = 6000
KEEP_GRADE = 2
_TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+|[^\x00-\x20a-z0-9\x80-\xff]+")


def grade(quality: str = "quality", toxic: str = "toxic") -> F.Column:
    """0 toxic, 1 poor, 2 good; null if a label is missing."""
    return (F.when(F.col(toxic).isNull() | F.col(quality).isNull(), None)
            .when(F.col(toxic) > 0, 0).when(F.col(quality) > 0, 2).otherwise(1))


def tokens(text: bytes) -> np.ndarray:
    """Hashes of the distinct tokens and shape marks of a whole text, sorted."""
    found = _TOKEN.findall(text.lower())
    if not found:
        return np.zeros(0, np.int32)
    n, kinds = len(found), set(found)
    marks = sum(1 for t in found if t[0] < 128 and not t.isalnum())
    again = sum(1 for a, b in zip(found, found[1:]) if a == b)
    kinds.add(b"\x00marks%d" % (10 * marks // n))
    kinds.add(b"\x00again%d" % (10 * again // n))
    kinds.add(b"\x00kinds%d" % (10 * len(kinds) // (n + 3)))
    kinds.add(b"\x00long%d" % min(16, n.bit_length()))
    mask = (1 << BITS) - 1
    return np.unique(np.fromiter((zlib.crc32(k) & mask for k in kinds), np.int32, len(kinds)))


@dataclass
class OrdinalModel:
    weights: np.ndarray  # by token hash
    thresholds: np.ndarray  # ascending; threshold[k - 1] opens grade k

    def score(self, text: bytes) -> float:
        return float(self.weights[tokens(text)].sum())

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1..K, a column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - np.asarray(score)[:, None], -60, 60)))


def fit(rows: list[np.ndarray], grades: np.ndarray, steps: int = 300, decay: float = 1e-4, least: float = 2.0) -> OrdinalModel | None:
    """Cumulative-link maximum likelihood by Adam over all rows; None without two grades.

    Each token's column is scaled by how far its rate differs between the grade
    halves, less ``least`` standard errors, so that rare tokens can't be learned
    by heart.
    """
    grades = np.asarray(grades, np.int64)
    if len(set(grades.tolist())) < 2:
        return None
    top, dim = int(grades.max()), 1 << BITS
    lens = np.array([len(r) for r in rows])
    flat = np.concatenate(rows).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(rows)), lens)
    used, at = np.unique(flat, return_inverse=True)
    scale = np.zeros(len(used))
    total = np.bincount(at, minlength=len(used)).astype(float)
    for k in range(1, top + 1):
        high = grades >= k
        if high.all() or not high.any():
            continue
        n_high, n_low = high.sum(), (~high).sum()
        in_high = np.bincount(at, high[doc].astype(float), len(used))
        ratio = np.log((in_high + 0.5) / (n_high + 1)) - np.log((total - in_high + 0.5) / (n_low + 1))
        # in units of its standard error: chance differences count little
        error = np.sqrt(1 / (in_high + 0.5) + 1 / (total - in_high + 0.5))
        z = np.abs(ratio) / error
        scale = np.maximum(scale, np.where(z > least, np.minimum(np.abs(ratio), 4.0) * (1 - least / np.maximum(z, least)), 0))
    weight, gaps = np.zeros(len(used)), np.zeros(top)
    share = np.array([(grades >= k).mean() for k in range(1, top + 1)]).clip(1e-3, 1 - 1e-3)
    start = -np.log(share / (1 - share))
    gaps[0] = start[0]
    gaps[1:] = np.log(np.maximum(np.diff(start), 0.1))
    state = [np.zeros(len(used)), np.zeros(len(used)), np.zeros(top), np.zeros(top)]
    bounds = lambda g: np.concatenate([[g[0]], g[0] + np.cumsum(np.exp(g[1:]))])
    index = np.arange(len(rows))
    for step in range(1, steps + 1):
        score = np.bincount(doc, (weight * scale)[at], len(rows))
        cut = bounds(gaps)
        upper = np.ones((len(rows), top + 2))
        upper[:, 1:top + 1] = 1 / (1 + np.exp(np.clip(cut[None, :] - score[:, None], -60, 60)))
        upper[:, top + 1] = 0
        p = np.maximum(upper[index, grades] - upper[index, grades + 1], 1e-9)
        slope = upper * (1 - upper)
        by_score = (slope[index, grades] - slope[index, grades + 1]) / p  # d log p / d score
        to_weight = np.bincount(at, by_score[doc], len(used)) * scale / len(rows) - decay * weight
        to_cut = np.zeros(top + 2)
        np.add.at(to_cut, grades, -slope[index, grades] / p)
        np.add.at(to_cut, grades + 1, slope[index, grades + 1] / p)
        to_cut = to_cut[1:top + 1] / len(rows)
        to_gap = np.concatenate([[to_cut.sum()], [to_cut[k:].sum() * np.exp(gaps[k]) for k in range(1, top)]])
        for value, grad, m, v in ((weight, to_weight, state[0], state[1]), (gaps, to_gap, state[2], state[3])):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value += 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    full = np.zeros(dim, np.float32)
    full[used] = weight * scale
    return OrdinalModel(full, bounds(gaps))


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          max_train: int = MAX_TRAIN) -> OrdinalModel | None:
    """Fit on at most ``max_train`` labelled documents, those of the least hash of their id."""
    graded = (labels.select(F.col(id_col).alias("id"), grade().alias("grade")).where("id is not null and grade is not null")
              .groupBy("id").agg(F.min("grade").alias("grade"))
              .orderBy(F.xxhash64("id"), "id").limit(max_train))
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    chosen = texts.join(F.broadcast(graded), "id")  # max_train rows of two numbers
    # one text an id, that of the least hash, so that the bound holds for rows
    chosen = (chosen.groupBy("id", "grade").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
              .select("id", "t.text", "grade"))
    id_type = chosen.schema["id"].dataType.simpleString()

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([tokens(t) for t in byte_texts(batch.column(1))], pa.list_(pa.int32())),
             batch.column(2)], ["id", "tokens", "grade"])

    table = map_slices(chosen, kernel, f"id {id_type}, tokens array<int>, grade int").toArrow()
    table = table.sort_by([("id", "ascending"), ("grade", "ascending")])
    rows = [np.asarray(t, np.int32) for t in table.column("tokens").to_pylist()]
    order = sorted(range(len(rows)), key=lambda k: (table.column("id")[k].as_py(), rows[k].tobytes()))
    grades = np.array(table.column("grade").to_pylist(), np.int64)
    return fit([rows[k] for k in order], grades[order]) if rows else None


def _scores(model: OrdinalModel, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    score = np.array([model.score(t) for t in texts], float)
    return score, model.tails(score)


def classify(documents: DataFrame, model: OrdinalModel | None, id_col: str = "doc_id", text_col: str = "text",
             keep_grade: int = KEEP_GRADE, min_tail: float = 0.5) -> DataFrame:
    """One row per document row: score, expected grade, tail probability and whether it is kept."""
    id_type = documents.schema[id_col].dataType.simpleString()
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        if shared.value is None:
            none = pa.nulls(n, pa.float64())
            columns = [none, none, none, pa.array([True] * n, pa.bool_())]
        else:
            score, tails = _scores(shared.value, byte_texts(batch.column(1)))
            tail = tails[:, min(keep_grade, tails.shape[1]) - 1]
            columns = [pa.array(score), pa.array(tails.sum(1)), pa.array(tail), pa.array(tail >= min_tail)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns],
                                          ["doc_id", "score", "expected_grade", "tail_probability", "kept"])

    return map_slices(docs, kernel, f"doc_id {id_type}, score double, expected_grade double, "
                                    "tail_probability double, kept boolean")


def keep(documents: DataFrame, model: OrdinalModel | None, text_col: str = "text",
         keep_grade: int = KEEP_GRADE, min_tail: float = 0.5) -> DataFrame:
    """The documents that the classifier keeps, all their columns as they are."""
    if model is None:
        return documents
    field = documents.columns.index(text_col)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch, field):
                tails = _scores(shared.value, byte_texts(part.column(field)))[1]
                yield part.filter(pa.array(tails[:, min(keep_grade, tails.shape[1]) - 1] >= min_tail))

    return documents.mapInArrow(run, documents.schema)
