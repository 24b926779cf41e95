"""Quality rules: base statistics and learned decision lists.

The base statistics of a whole text are counted in one pass over the documents
(Arrow and numpy inside the tasks, no shuffle). Ratios of them are the features
of a decision list: an ordered list of threshold conjunctions that reject a
document, learned by sequential covering. Each rule is grown on two thirds of
the labelled rows (the condition of the best FOIL gain is added until no good
row is covered) and pruned on the last third (final conditions go while the
precision there doesn't fall); rows it covers leave the training set. A rule is
listed only if its precision on the pruning rows is high enough, and the list
ends where no such rule is found.

The list is emitted as ordered Spark conditional expressions, so it reads as
SQL and runs inside the plan that has the statistics.

Learning sees at most ``max_train`` labelled documents (a documented bound, by
hash of their id): eight numbers each come to the driver.

Defined cases: null and empty texts have no words (and fail the base rule); a
document with several labels takes the lowest; labels with a null are not used;
without both classes the list is empty and keeps what passes the base rule; of
rows that share a labelled id one is learned from; repeated rows each give a row;
an empty table gives no rows; extra columns are not read, whatever their names; a
very long text is counted whole. A rule has at most ``MAX_CONDITIONS`` conditions
and the list ``MAX_RULES`` rules.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import byte_texts, map_slices
from tessera.llm.shingles import _mix, word_hashes

MAX_TRAIN = 20_000
MAX_CONDITIONS, MAX_RULES = 6, 32  # length of a rule and of the list, so that they stay readable
WINDOW = 3
_SYMBOLS = b"#*$%&|<>"
_NOT_CHARS = b"\x20\x09\x0a\x0b\x0c\x0d" + bytes(range(0x80, 0xC0))  # white space, and later bytes of a character
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Features of the rules, as Spark SQL over the statistics.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_lines_per_100_words": "100 * n_dup_lines / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
}


def _statistics(batch: pa.RecordBatch) -> list[pa.Array]:
    texts = byte_texts(batch.column(1))
    hashes, counts = word_hashes(batch.column(1), fold=False)
    rolled = hashes.copy()
    with np.errstate(over="ignore"):
        for k in range(1, WINDOW):
            if len(hashes) > k:
                rolled[:-k] = _mix(rolled[:-k] * np.uint64(0x9E3779B97F4A7C15) + hashes[k:])
    repeated, at = [], 0
    for n in counts.tolist():
        windows = rolled[at:at + n - WINDOW + 1] if n > WINDOW else rolled[:0]
        covered = 0
        if len(windows):
            order = np.argsort(windows, kind="stable")
            same = windows[order][1:] == windows[order][:-1]
            if same.any():
                twice = np.zeros(n - WINDOW + 1, bool)
                twice[order[1:][same]] = True
                twice[order[:-1][same]] = True
                inside = np.zeros(n, bool)
                for k in range(WINDOW):
                    inside[k:n - WINDOW + 1 + k] |= twice
                covered = int(inside.sum())
        repeated.append(covered)
        at += n
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    return [pa.array(v, pa.int64()) for v in (
        counts.tolist(), [len(t.translate(None, _NOT_CHARS)) for t in texts],
        [len(t) - len(t.translate(None, _SYMBOLS)) for t in texts],
        [len(x) - len(set(x)) for x in lines], repeated)]


def statistics(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the base statistics, with the verdict of the base rule."""
    id_type = documents.schema[id_col].dataType.simpleString()
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = map_slices(docs, lambda b: pa.RecordBatch.from_arrays([b.column(0), *_statistics(b)], ["doc_id", *STATS]),
                     f"doc_id {id_type}, " + ", ".join(f"{s} long" for s in STATS))
    return out.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


@dataclass(frozen=True)
class Rule:
    """Rejects rows that meet all conditions (feature, ``<=`` or ``>``, threshold)."""

    conditions: tuple[tuple[str, str, float], ...]

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        hit = np.ones(len(next(iter(x.values()))), bool)
        for name, way, value in self.conditions:
            hit &= x[name] <= value if way == "<=" else x[name] > value
        return hit

    def column(self) -> Column:
        return F.expr(" and ".join(f"({FEATURES[n]}) {way} {value!r}D" for n, way, value in self.conditions))


def _best_condition(x: dict, bad: np.ndarray, inside: np.ndarray) -> tuple[float, tuple] | None:
    """The condition of most FOIL gain among the thresholds between neighbouring values."""
    p0, n0 = (bad & inside).sum(), (~bad & inside).sum()
    if not p0 or not n0:
        return None
    base, best = math.log2(p0 / (p0 + n0)), None
    for name in sorted(x):
        v = x[name][inside]
        order = np.argsort(v, kind="stable")
        v, b = v[order], bad[inside][order]
        cut = np.flatnonzero(v[1:] > v[:-1])  # between cut and cut + 1
        if not len(cut):
            continue
        p_low = np.cumsum(b)[cut].astype(float)
        n_low = cut + 1 - p_low
        middle = (v[cut] + v[cut + 1]) / 2
        for way, p, n in (("<=", p_low, n_low), (">", p0 - p_low, n0 - n_low)):
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1e-9) / np.maximum(p + n, 1e-9)) - base), -1.0)
            k = int(np.argmax(gain))
            if gain[k] > 1e-9 and (best is None or gain[k] > best[0] + 1e-12):
                best = (float(gain[k]), (name, way, float(middle[k])))
    return best


def _grow(x: dict, bad: np.ndarray) -> Rule | None:
    conditions, inside = [], np.ones(len(bad), bool)
    while len(conditions) < MAX_CONDITIONS and (found := _best_condition(x, bad, inside)):
        conditions.append(found[1])
        inside &= Rule((found[1],)).covers(x)
    return Rule(tuple(conditions)) if conditions else None


def _precision(rule: Rule, x: dict, bad: np.ndarray) -> float:
    hit = rule.covers(x)
    return ((bad & hit).sum() + 0.5) / (hit.sum() + 1.0)


def _prune(rule: Rule, x: dict, bad: np.ndarray) -> Rule:
    best = rule
    for k in range(len(rule.conditions) - 1, 0, -1):
        shorter = Rule(rule.conditions[:k])
        if _precision(shorter, x, bad) >= _precision(best, x, bad):
            best = shorter
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, ids: list, min_precision: float = 0.8, min_cover: int = 3,
          max_rules: int = MAX_RULES) -> list[Rule]:
    """An ordered decision list; rows are split into growing and pruning rows by a hash of their id."""
    bad = np.asarray(bad, bool)
    if not bad.any() or bad.all():
        return []
    third = np.array([zlib.crc32(str(i).encode()) % 3 == 0 for i in ids])
    left, rules = np.ones(len(bad), bool), []
    while len(rules) < max_rules and (bad & left).any():
        part = lambda mask: ({n: v[mask] for n, v in x.items()}, bad[mask])
        grow, prune = part(left & ~third), part(left & third)
        rule = _grow(*grow) if len(grow[1]) else None
        if rule is None:
            break
        rule = _prune(rule, *prune)
        if _precision(rule, *prune) < min_precision or rule.covers(prune[0]).sum() < min_cover:
            break
        rules.append(rule)
        left &= ~rule.covers(x)
    return rules


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          max_train: int = MAX_TRAIN) -> list[Rule]:
    """Rules for labelled documents of low quality that pass the base rule; only those texts are counted."""
    marked = (labels.select(F.col(id_col).alias("doc_id"), "quality").where("doc_id is not null and quality is not null")
              .groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train))
    marked = F.broadcast(marked)  # max_train rows of two numbers
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(marked, "doc_id", "left_semi")
    # one text an id, that of the least hash, so that the bound holds for rows
    docs = docs.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "t.text")
    stats = statistics(docs)
    features = [F.expr(e).alias(n) for n, e in FEATURES.items()]
    rows = (stats.where("not base_failed").join(marked, "doc_id")
            .select("doc_id", "quality", *features).toPandas().sort_values(["doc_id", *FEATURES]))
    if rows.empty:
        return []
    return learn({n: rows[n].to_numpy(float) for n in FEATURES}, (rows["quality"] <= 0).to_numpy(), rows["doc_id"].tolist())


def verdict(rules: list[Rule]) -> Column:
    """kept: false for the base rule, then the list in order, else true."""
    out = F.when(F.col("base_failed"), False)
    for rule in rules:
        out = out.when(rule.column(), False)
    return out.otherwise(True)


def matched(rules: list[Rule]) -> Column:
    """Number of the rule that rejects a row: 0 the base rule, then the list's; null if kept."""
    out = F.when(F.col("base_failed"), 0)
    for k, rule in enumerate(rules, 1):
        out = out.when(rule.column(), k)
    return out
