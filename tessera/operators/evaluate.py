"""Scoring predictions and comparing runs (joins by key, aggregations).

The source matches predictions to answers by position in two files; here
every input carries a key and is joined on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.literals import ERROR_MARK, PROGRESS_EVERY, REPAIR_ATTEMPTS
from tessera.functions.text import py_strip
from tessera.functions.unicode import nfkd_columns
from tessera.operators.sequence import running_sum


def _one_per_key(pred: DataFrame, key: str, col: str) -> DataFrame:
    """One prediction per key, the least if a key was answered more than once."""
    return pred.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.col(col).cast("string")).alias(col))


def exact_match(gold: DataFrame, pred: DataFrame, key: str, answer: str = "answer",
                prediction: str = "prediction") -> DataFrame:
    """``n, hits, ratio``: stripped answer equals stripped prediction, both in
    NFKD (a composed and a decomposed spelling are equal).

    Every gold row counts: an unanswered question is a miss, and a null answer
    never matches (not even a null prediction).
    """
    gold = nfkd_columns(gold.select(key, F.col(answer).cast("string").alias(answer)), [answer])
    pred = nfkd_columns(_one_per_key(pred, key, prediction), [prediction])
    j = gold.join(pred, key, "left")
    hit = py_strip(F.col(answer)) == py_strip(F.col(prediction))
    return j.agg(F.count("*").alias("n"), F.count_if(hit).alias("hits")).select(
        "n", "hits", F.try_divide(F.col("hits"), F.col("n")).alias("ratio"))


def outcome_label(answer, prediction) -> F.Column:
    """1 exact match (tested first, no strip), -1 error text, 0 otherwise."""
    a, p = F.col(answer).cast("string"), F.col(prediction).cast("string")
    return (F.when(a == p, F.lit(1))
             .when(F.contains(p, F.lit(ERROR_MARK)), F.lit(-1))
             .otherwise(F.lit(0)))


def label_counts(labelled: DataFrame, label: str = "label") -> DataFrame:
    return labelled.groupBy(label).agg(F.count("*").alias("n"))


def progress(labelled: DataFrame, run: str, seq: str, label: str = "label",
             every: int = PROGRESS_EVERY) -> DataFrame:
    """Cumulative 1 / 0 / -1 counts per run after every ``every`` items (and
    after the last one): ``run, batch, n_items, c1, c0, cerr``.

    One skew-safe running sum of (1, hit, miss, error), so one run holding most
    items is still spread over many tasks; the counts never fall, so a batch's
    last ones are its largest.
    """
    is_ = lambda v: F.coalesce(F.col(label) == v, F.lit(False)).cast("long")
    marked = labelled.select(run, seq, F.lit(1).cast("long").alias("n"), is_(1).alias("b1"), is_(0).alias("b0"),
                             is_(-1).alias("berr"))
    c = running_sum(marked, run, [seq], ["n", "b1", "b0", "berr"])
    return c.groupBy(run, F.floor((F.col("cum_n") - 1) / every).alias("batch")).agg(
        F.max("cum_n").alias("n_items"), F.max("cum_b1").alias("c1"), F.max("cum_b0").alias("c0"),
        F.max("cum_berr").alias("cerr"))


def _two_runs(gold: DataFrame, run1: DataFrame, run2: DataFrame, key: str, answer: str, p1: str, p2: str):
    """Gold rows with both runs' predictions (null where unanswered), and whether each is right (in NFKD)."""
    gold = nfkd_columns(gold.select(key, F.col(answer).cast("string").alias(answer)), [answer])
    j = gold
    for run, p in ((run1, p1), (run2, p2)):
        j = j.join(nfkd_columns(_one_per_key(run, key, p), [p]), key, "left")
    right = [F.coalesce(F.col(answer) == F.col(p), F.lit(False)) for p in (p1, p2)]
    return j, *right


def compare_runs(gold: DataFrame, run1: DataFrame, run2: DataFrame, key: str,
                 answer: str = "answer", p1: str = "p1", p2: str = "p2") -> DataFrame:
    """``both, only1, only2, neither`` right-counts of two runs, over all gold rows."""
    j, r1, r2 = _two_runs(gold, run1, run2, key, answer, p1, p2)
    return j.agg(F.count_if(r1 & r2).alias("both"), F.count_if(r1 & ~r2).alias("only1"),
                 F.count_if(~r1 & r2).alias("only2"), F.count_if(~r1 & ~r2).alias("neither"))


def only_first_right(gold: DataFrame, run1: DataFrame, run2: DataFrame, key: str,
                     answer: str = "answer", p1: str = "p1", p2: str = "p2") -> DataFrame:
    """Keys the first run got right and the second did not."""
    j, r1, r2 = _two_runs(gold, run1, run2, key, answer, p1, p2)
    return j.filter(r1 & ~r2).select(key)


def _first(attempts: DataFrame, item: str, order: str, n: int) -> DataFrame:
    """The first ``n`` attempts of each item, numbered; the limit is pushed below the shuffle."""
    w = Window.partitionBy(item).orderBy(order)
    return attempts.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= n)


def attempts_fold(attempts: DataFrame, item: str, order: str, reply: str, ok: str,
                  cap: int = REPAIR_ATTEMPTS) -> DataFrame:
    """Repair loop on a log of attempts: execute replies in order, stop at the
    first success; after ``cap`` failed executions the next reply is kept
    unexecuted. ``item, reply, tries`` (executions made)."""
    a = _first(attempts.select(item, order, reply, ok), item, order, cap + 1)
    good = F.col(ok) & (F.col("n") <= cap)
    g = a.groupBy(item).agg(
        F.min_by(F.col(reply), F.when(good, F.col("n"))).alias("_ok_reply"),
        F.min(F.when(good, F.col("n"))).alias("_ok_n"),
        F.max_by(F.col(reply), F.when(F.col("n") <= cap + 1, F.col("n"))).alias("_last"),
        F.count("*").alias("_m"))
    return g.select(item, F.coalesce("_ok_reply", "_last").alias("reply"),
                    F.coalesce(F.col("_ok_n"), F.least(F.col("_m"), F.lit(cap))).cast("long").alias("tries"))


def attempts_until_match(attempts: DataFrame, item: str, order: str, reply: str, hit: str,
                         cap: int = 1) -> DataFrame:
    """Ask again until the prediction matches the gold answer or ``cap``
    attempts are used: ``item, reply, hit``."""
    a = _first(attempts.select(item, order, reply, hit), item, order, cap)
    good = F.col(hit) & (F.col("n") <= cap)
    g = a.groupBy(item).agg(
        F.min_by(F.col(reply), F.when(good, F.col("n"))).alias("_hit_reply"),
        F.max_by(F.col(reply), F.when(F.col("n") <= cap, F.col("n"))).alias("_cap_reply"))
    return g.select(item, F.coalesce("_hit_reply", "_cap_reply").alias("reply"),
                    F.col("_hit_reply").isNotNull().alias("hit"))


def canonical_answer(c) -> F.Column:
    """Normalise a printed prediction before comparing (optional rules).

    In order: ``True``/``False`` -> ``yes``/``no``; three or more ``", "``
    parts -> joined by ``|``; a printed one-column series (holds
    ``dtype: object``) -> its first line without the index; double quotes
    removed; a printed list (``[`` and ``]``) loses brackets and quotes.
    """
    p = F.col(c) if isinstance(c, str) else c
    p = (F.when(p.isin("False", "false"), F.lit("no"))
          .when(p.isin("True", "true"), F.lit("yes")).otherwise(p))
    p = F.when(F.size(F.split(p, ", ", -1)) > 2, F.replace(p, F.lit(", "), F.lit("|"))).otherwise(p)
    first = F.split(F.split_part(p, F.lit("\n"), F.lit(1)), " ", -1)
    p = F.when(F.contains(p, F.lit("dtype: object")),
               F.array_join(F.slice(first, 2, F.greatest(F.size(first) - 1, F.lit(0))), " ")).otherwise(p)
    p = F.replace(p, F.lit('"'), F.lit(""))
    p = F.when(F.contains(p, F.lit("[")) & F.contains(p, F.lit("]")),
               F.replace(F.replace(F.replace(p, F.lit("["), F.lit("")), F.lit("]"), F.lit("")),
                         F.lit("'"), F.lit(""))).otherwise(p)
    return p
