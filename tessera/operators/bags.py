"""Word bags: distinct texts as counted words, and exact scores of pairs of them.

Texts with equal bags (or sets) of words score alike with everything, so each
distinct bag is named, counted and written once, and everything later reads
these narrow tables. Scores are sums of whole numbers over whole-number norms,
so ties are exact.

Three ways lead to the same scores. Measured by the number of postings that meet
(the sum over words of questions times examples that have it):

* up to ``DIRECT_ROWS`` a bag, and ``DIRECT_MOST`` in all, the words are joined and summed;
* beyond, where most pairs share words, blocks of questions meet blocks of examples
  in the grid (:mod:`tessera.operators.blocks`): a tile multiplies their word counts
  and gives its k best, so that neither postings nor pairs are shuffled;
* beyond, where over ``PAIRS_A_POSTING`` pairs come to a posting, words of a question are taken from the rarest on. With the score that
  its k-th example surely reaches, words whose remaining bound can't reach that
  score are not joined; the bound of a tail of words is the lesser of its norm
  (Cauchy-Schwarz) and of the sum of the words' largest impacts, or for sets the
  share of words left. Examples that may still reach the score have the words
  left out looked up, pair by pair.

Words that every example has (headers of tables) are one constant for each
question: only counts above the least one are joined.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import words
from tessera.operators import blocks
from tessera.session import write_stage

DIRECT_ROWS = 4096  # postings that may meet for each question bag before bounds are used
DIRECT_MOST = 1 << 22  # postings that may meet in all
PAIRS_A_POSTING = 1000  # pairs for each posting beyond which bounds are used instead of tiles
GROUP_PAIRS = 1 << 16  # pairs of a small group
WORD_WEIGHT = 8  # a word of a block weighs as much as so many numbers of a vector
DENSE_WORDS = 1024  # words of a tile that are multiplied as columns of a matrix
DENSE_SHARE = 400  # such a word meets in at least one of so many pairs
MET_AT_ONCE = 1 << 21  # postings of other words that meet at once
SEED_WORDS = 4  # rarest words of a question that give its first examples
SLACK = 2e-6  # scores are compared after rounding to 6 places


@dataclass
class Bags:
    """``rows(keys, _g, _t)``: the bag of each row; ``bags(_g, _t, _words, _norm)``: each distinct bag.

    An index made for ``k`` best rows has ``_top`` in ``bags``, the first k rows
    of the bag as structs in order, and no ``rows``.
    """

    rows: DataFrame | None
    bags: DataFrame

    def words(self, side: str) -> DataFrame:
        """``_g, _{side}t, _w, _{side}n, _{side}norm``: a row for each word of each bag."""
        return self.bags.select("_g", F.col("_t").alias(f"_{side}t"), F.explode("_words").alias("w"),
                                F.col("_norm").alias(f"_{side}norm")).select(
            "_g", f"_{side}t", F.col("w.w").alias("_w"), F.col("w.n").alias(f"_{side}n"), f"_{side}norm")


def counted(bag: Column) -> Column:
    """Sorted words to ``array<struct<w, n>>``, in one pass over the places where a new word begins."""
    starts = F.filter(F.sequence(F.lit(0), F.size(bag) - 1),
                      lambda i: (i == 0) | (F.get(bag, i) != F.get(bag, i - 1)))
    starts = F.when(F.size(bag) > 0, starts).otherwise(F.array().cast("array<int>"))
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(F.size(bag)))
    return F.zip_with(starts, ends, lambda s, e: F.struct(F.get(bag, s).alias("w"), (e - s).cast("long").alias("n")))


def _bagged(df: DataFrame, keys: list[str], text: str, group: str | None, sets: bool) -> DataFrame:
    """``keys, _g, _t, _bag``: sorted words, joined (a list of words takes twice the room); a 128-bit hash is the bag's name."""
    bag = words(text)
    bag = F.coalesce(F.array_join(F.array_sort(F.array_distinct(bag) if sets else bag), " "), F.lit(""))
    rows = df.select(*keys, (F.coalesce(F.col(group).cast("string"), F.lit("")) if group else F.lit("")).alias("_g"), bag.alias("_bag"))
    return rows.withColumn("_t", F.substring(F.unhex(F.sha2(F.encode("_bag", "UTF-8"), 256)), 1, 16))


def _counted_bags(bags: DataFrame, name: str) -> DataFrame:
    """``_bag`` as ``_words`` and their ``_norm``, written."""
    counts = bags.withColumn("_bag", F.filter(F.split("_bag", " "), lambda x: x != ""))  # once, not in each step of counted()
    counts = counts.withColumn("_words", counted(F.col("_bag"))).drop("_bag")
    return write_stage(counts.withColumn("_norm", _norm(F.col("_words"))), name)


def _norm(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x["n"] * x["n"])


def index(df: DataFrame, keys: list[str], text: str, group: str | None = None, sets: bool = False) -> Bags:
    """The bags of a text column, with all rows; ``group`` keeps equal bags of different groups apart."""
    rows = write_stage(_bagged(df, keys, text, group, sets), "bag-rows")
    one = rows.groupBy("_g", "_t").agg(F.first("_bag").alias("_bag"))
    return Bags(rows.select(*keys, "_g", "_t"), _counted_bags(one, "bags"))


def index_best(df: DataFrame, order: list[str], text: str, k: int, group: str | None = None, sets: bool = False) -> Bags:
    """The distinct bags of a text column, each with its first k rows by ``order``: one shuffle, limited below it."""
    first = Window.partitionBy("_g", "_t").orderBy(*order)
    rows = _bagged(df, order, text, group, sets).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k)
    one = rows.groupBy("_g", "_t").agg(F.first("_bag").alias("_bag"), F.array_sort(F.collect_list(F.struct(*order))).alias("_top"))
    return Bags(None, _counted_bags(one, "bags"))


def score(dot, qnorm, bnorm, sets: bool) -> Column:
    if sets:
        return dot / (qnorm + bnorm - dot)
    return dot / F.sqrt(qnorm.cast("double")) / F.sqrt(bnorm.cast("double"))


def joined_dot(q: Column, r: Column) -> Column:
    """Sum of products over two long word lists, by sorting their words together."""
    both = F.array_sort(F.concat(q, r))  # a shared word stands twice in a row
    step = lambda acc, x: F.struct(
        F.when(acc["w"] == x["w"], acc["s"] + acc["n"] * x["n"]).otherwise(acc["s"]).alias("s"), x["w"].alias("w"), x["n"].alias("n"))
    start = F.struct(F.lit(0).cast("long").alias("s"), F.lit(None).cast("string").alias("w"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(both, start, step, lambda acc: acc["s"])


def _slim(bags: DataFrame, side: str) -> DataFrame:
    """``_g, _{side}t, _{side}w, _{side}c, _{side}norm`` of bags with words: words joined and their counts, to be shuffled."""
    return bags.where("_norm > 0").select("_g", F.col("_t").alias(f"_{side}t"), F.array_join(F.transform("_words", lambda x: x["w"]), " ").alias(f"_{side}w"),
                                          F.transform("_words", lambda x: x["n"]).alias(f"_{side}c"), F.col("_norm").alias(f"_{side}norm"))


def _in_place(q: DataFrame, b: DataFrame) -> DataFrame:
    """Like ``_meet``: each bag meets the bags of its group whole, so that no postings are shuffled."""
    counts = lambda side: F.zip_with(F.split(f"_{side}w", " "), f"_{side}c", lambda w, n: F.struct(w.alias("w"), n.alias("n")))
    met = _slim(q, "q").join(_slim(b, "b"), "_g").withColumn("_dot", joined_dot(counts("q"), counts("b")))
    return met.where("_dot > 0").select("_g", "_qt", "_bt", "_qnorm", "_bnorm", "_dot")


def pairs_in_groups(q: Bags, b: Bags, k: int, sets: bool = False, direct_rows: int | None = None) -> DataFrame:
    """Like ``pairs``, where groups are many and small: up to ``GROUP_PAIRS`` pairs a group meet in place, other groups by ``pairs``."""
    most = min(GROUP_PAIRS, DIRECT_MOST)
    qn, bn = q.bags.groupBy("_g").agg(F.count("*").alias("_a")), b.bags.groupBy("_g").agg(F.count("*").alias("_b"))
    large = qn.join(bn, "_g").where(F.col("_a").cast("decimal(38,0)") * F.col("_b") > most).select("_g")
    large = write_stage(large, "bag-groups")
    if large.isEmpty():
        return _scored(_in_place(q.bags, b.bags), sets)
    small = _in_place(q.bags.join(large, "_g", "left_anti"), b.bags.join(large, "_g", "left_anti"))
    rest = [Bags(None, x.bags.join(large, "_g", "left_semi")) for x in (q, b)]
    return _scored(small, sets).unionByName(pairs(*rest, k, sets, direct_rows))


def _meet(qw: DataFrame, bw: DataFrame) -> DataFrame:
    """``_g, _qt, _bt, _qnorm, _bnorm, _dot``: sums over the words that two bags share."""
    return (qw.join(bw, ["_g", "_w"]).groupBy("_g", "_qt", "_bt", "_qnorm", "_bnorm")
            .agg(F.sum(F.col("_qn") * F.col("_bn")).alias("_dot")))


def _looked_up(pairs: DataFrame, qw: DataFrame, bw: DataFrame) -> DataFrame:
    """``_g, _qt, _bt, _more``: what the given question words add to the given pairs."""
    asked = pairs.select("_g", "_qt", "_bt").join(qw.select("_g", "_qt", "_w", "_qn"), ["_g", "_qt"])
    return (asked.join(bw.select("_g", "_bt", "_w", "_bn"), ["_g", "_bt", "_w"])
            .groupBy("_g", "_qt", "_bt").agg(F.sum(F.col("_qn") * F.col("_bn")).alias("_more")))


def _ranked_words(qw: DataFrame, bw: DataFrame, sets: bool) -> DataFrame:
    """Question words that the bank has, rarest first, with the bound of a score from each word on."""
    impact = F.lit(1.0) if sets else F.col("_bn") / F.sqrt(F.col("_bnorm").cast("double"))
    stats = bw.groupBy("_g", "_w").agg(F.count("*").alias("_df"), F.max(impact).alias("_top"))
    order = Window.partitionBy("_g", "_qt").orderBy("_df", "_w")
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    qnorm = F.sqrt(F.col("_qnorm").cast("double"))
    if sets:
        bound = F.count("*").over(rest) / F.col("_qnorm")
    else:
        bound = F.least(F.sqrt(F.sum(F.col("_qn") * F.col("_qn")).over(rest).cast("double")) / qnorm,
                        F.sum(F.col("_qn") * F.col("_top")).over(rest) / qnorm)
    return qw.join(stats, ["_g", "_w"]).select("_g", "_qt", "_w", "_qn", "_qnorm", F.row_number().over(order).alias("_place"),
                                               bound.alias("_bound"))


def _reached(ranked: DataFrame, bw: DataFrame, k: int, sets: bool) -> DataFrame:
    """``_g, _qt, _floor``: the score of the k-th of some examples that share a question's rarest words."""
    seeds = _meet(ranked.where(F.col("_place") <= SEED_WORDS), bw)
    best = Window.partitionBy("_g", "_qt").orderBy(score(F.col("_dot"), F.col("_qnorm"), F.col("_bnorm"), sets).desc(), "_bt")
    seeds = write_stage(seeds.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k), "bag-seeds")
    exact = seeds.join(_looked_up(seeds, ranked, bw), ["_g", "_qt", "_bt"]).withColumn(
        "_s", score(F.col("_more"), F.col("_qnorm"), F.col("_bnorm"), sets))
    return exact.groupBy("_g", "_qt").agg(F.min("_s").alias("_floor"), F.count("*").alias("_n")).where(F.col("_n") >= k).drop("_n")


def _by_bounds(ranked: DataFrame, bw: DataFrame, floors: DataFrame, sets: bool) -> DataFrame:
    """Pairs that can reach the floor of their question, with their whole dot product."""
    own = ranked.join(floors, ["_g", "_qt"], "left").withColumn("_floor", F.coalesce("_floor", F.lit(0.0)) - F.lit(SLACK))
    own = write_stage(own.withColumn("_joined", F.col("_bound") >= F.col("_floor")), "bag-words")
    part = _meet(own.where("_joined"), bw)
    left = own.where("not _joined").groupBy("_g", "_qt").agg(F.max("_bound").alias("_rest"), F.count("*").alias("_left"), F.max("_floor").alias("_floor"))
    part = part.join(left, ["_g", "_qt"], "left")
    if sets:  # at most the words left, and those of the example
        most = F.col("_dot") + F.least(F.col("_left"), F.col("_bnorm") - F.col("_dot"))
        could = most / (F.col("_qnorm") + F.col("_bnorm") - most)
    else:
        could = score(F.col("_dot"), F.col("_qnorm"), F.col("_bnorm"), False) + F.col("_rest")
    part = write_stage(part.where(F.col("_rest").isNull() | (could >= F.col("_floor"))), "bag-candidates")
    more = _looked_up(part.where("_rest is not null"), own.where("not _joined"), bw)
    return part.join(more, ["_g", "_qt", "_bt"], "left").select(
        "_g", "_qt", "_bt", "_qnorm", "_bnorm", (F.col("_dot") + F.coalesce("_more", F.lit(0))).alias("_dot"))


def met_rows(qw: DataFrame, bw: DataFrame) -> int:
    """How many rows a join of the words has."""
    q = qw.groupBy("_g", "_w").agg(F.count("*").alias("_a"))
    b = bw.groupBy("_g", "_w").agg(F.count("*").alias("_b"))
    return int(q.join(b, ["_g", "_w"]).agg(F.sum(F.col("_a").cast("decimal(38,0)") * F.col("_b"))).first()[0] or 0)


def n_pairs(q: Bags, b: Bags) -> int:
    """How many pairs of bags the groups have."""
    qn, bn = q.bags.groupBy("_g").agg(F.count("*").alias("_a")), b.bags.groupBy("_g").agg(F.count("*").alias("_b"))
    return int(qn.join(bn, "_g").agg(F.sum(F.col("_a").cast("decimal(38,0)") * F.col("_b"))).first()[0] or 0)


def pairs(q: Bags, b: Bags, k: int, sets: bool = False, direct_rows: int | None = None) -> DataFrame:
    """``_g, _qt, _bt, sim`` (rounded): all pairs that can be among a question bag's k best of score above 0."""
    qw, bw = q.words("q"), b.words("b")
    direct_rows = DIRECT_ROWS if direct_rows is None else direct_rows
    asked = max(1, q.bags.count())
    few = direct_rows >= DIRECT_ROWS and b.bags.count() <= direct_rows and asked * direct_rows <= DIRECT_MOST  # then few can meet
    met = 0 if few else met_rows(qw, bw)
    if met <= min(direct_rows * asked, DIRECT_MOST):
        found = _meet(qw, bw)
    elif direct_rows and n_pairs(q, b) <= PAIRS_A_POSTING * met:
        return pairs_by_tiles(q, b, k, sets)
    else:
        ranked = write_stage(_ranked_words(qw, bw, sets), "bag-ranked")
        found = _by_bounds(ranked, bw, _reached(ranked, bw, k, sets), sets)
    return _scored(found, sets)


def _scored(found: DataFrame, sets: bool) -> DataFrame:
    return found.select("_g", "_qt", "_bt", F.round(score(F.col("_dot"), F.col("_qnorm"), F.col("_bnorm"), sets), 6).alias("sim"))


def first_word(counts: str = "_words") -> Column:
    """The alphabetically first word of a bag, null if it has none."""
    return F.get(counts, 0)["w"]


def _numbered(bags: DataFrame, name: str, number: str, *own: str, order: Column | None = None) -> DataFrame:
    """``_g, {name}, _w, _n, _norm, {number}`` of the bags that have words, written; words are joined while they are sorted."""
    words = F.transform("_words", lambda x: x["w"])
    rows = bags.where("_norm > 0").select("_g", F.col("_t").alias(name), F.array_join(words, " ").alias("_w"), F.transform("_words", lambda x: x["n"]).alias("_n"),
                                          "_norm", *own, *([order.alias("_o")] if order is not None else []))
    rows = rows.orderBy("_o").drop("_o") if order is not None else rows
    return write_stage(rows.withColumns({"_w": F.split("_w", " "), number: F.monotonically_increasing_id()}), "tile-bags")


def pairs_by_tiles(q: Bags, b: Bags, k: int, sets: bool = False, gate: DataFrame | None = None) -> DataFrame:
    """``_g, _qt, _bt, sim`` (rounded, above 0): the k best of each question bag in each tile.

    ``b`` has the first rows of its bags; they are numbered in the order of these,
    which decides ties. With ``gate(_kw)`` a question whose first word is in it meets
    only examples of which a word contains that first word.
    """
    asked = q.bags
    if gate is not None:
        asked = asked.withColumn("_kw", first_word()).join(gate.withColumn("_shut", F.lit(True)), "_kw", "left")
        asked = asked.withColumn("_open", F.col("_shut").isNull())
    own = [] if gate is None else ["_kw", "_open"]
    asked = _numbered(asked, "_qt", "_q", *own)
    held = _numbered(b.bags, "_bt", "_b", order=F.col("_top")[0])
    groups = asked.select("_g").union(held.select("_g")).distinct().limit(2).count()
    weight = lambda f: (f.size("_w") * f.lit(WORD_WEIGHT)).cast("long")
    kernel = blocks.Kernel(["_w", "_n", "_norm", *own], ["_w", "_n", "_norm"], _tile_scores(sets, gate is not None),
                           q_weight=weight, b_weight=weight, rounded=round_half_up)
    tiles = blocks.grid_scores(asked, held, q_key="_q", b_key="_b", kernel=kernel, k=k, group="_g" if groups > 1 else None, in_place=True)
    best = blocks.merge_topk(tiles.where("sim > 0"), "_q", "_b", k)
    return best.join(asked.select("_g", "_qt", "_q"), "_q").join(held.select("_bt", "_b"), "_b").select("_g", "_qt", "_bt", "sim")


def round_half_up(score: np.ndarray) -> np.ndarray:
    """To 6 decimals as Spark rounds a double: halves of its shortest decimal form go up."""
    scaled = score * 1e6
    out = np.floor(scaled + 0.5) / 1e6
    near = np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6
    if near.any():
        exact, at = np.unique(score[near], return_inverse=True)
        out[near] = np.array([float(Decimal(repr(float(x))).quantize(Decimal("0.000001"), ROUND_HALF_UP)) for x in exact])[at]
    return out


def _tile_scores(sets: bool, gated: bool):
    """Kernel of a tile of bags: word counts are multiplied; pairs that no gate lets in are left out."""

    def run(q: pd.DataFrame, b: pd.DataFrame):
        dots = count_products(q["_w"], q["_n"], b["_w"], b["_n"])
        qnorm, bnorm = q["_norm"].to_numpy().astype(float)[:, None], b["_norm"].to_numpy().astype(float)[None]
        let_in = containing(q["_kw"].where(~q["_open"].astype(bool), None), b["_w"]) if gated else None

        def strip(rows: slice) -> np.ndarray:
            dot = dots(rows)
            s = dot / (qnorm[rows] + bnorm - dot) if sets else dot / np.sqrt(qnorm[rows]) / np.sqrt(bnorm)
            return np.where(let_in(rows), s, -np.inf) if gated else s

        return {"sim": strip}, {}

    return run


def containing(keywords: pd.Series, bw):
    """Function of a slice of questions: which bags have a word that contains the question's keyword (null: all).

    Every part of a distinct word that is as long as some keyword is looked up.
    """
    nb = len(bw)
    own, known = pd.factorize(keywords)  # null: -1
    number = {w: n for n, w in enumerate(known)}
    lengths = sorted({len(w) for w in known})
    codes, vocabulary = pd.factorize(np.concatenate([*bw]))
    held = [{number[w[at:at + n]] for n in lengths if n <= len(w) for at in range(len(w) - n + 1) if w[at:at + n] in number} for w in vocabulary]
    sizes = np.array([len(x) for x in held], dtype=np.int64)
    found = np.fromiter((n for x in held for n in x), np.int64, sizes.sum())
    first = np.cumsum(sizes) - sizes
    times = sizes[codes]
    place = np.arange(times.sum()) + np.repeat(first[codes] - (np.cumsum(times) - times), times)
    row = np.repeat(np.repeat(np.arange(nb), [len(x) for x in bw]), times)
    keyword, row = np.divmod(np.unique(found[place] * nb + row), max(1, nb))
    ends = np.searchsorted(keyword, np.arange(len(known) + 1))

    def let_in(rows: slice) -> np.ndarray:
        out = np.zeros((len(own[rows]), nb), dtype=bool)
        for at, n in enumerate(own[rows]):
            out[at, row[ends[n]:ends[n + 1]] if n >= 0 else slice(None)] = True
        return out

    return let_in


def count_products(qw, qn, bw, bn):
    """Function of a slice of questions: dot products of their counts with all examples, exact.

    ``qw`` and ``bw`` list the distinct words of each row, ``qn`` and ``bn`` their counts.
    Words that meet in many pairs are columns of a matrix product; the others are
    added posting by posting.
    """
    nq, nb = len(qw), len(bw)
    codes = pd.factorize(np.concatenate([*qw, *bw]))[0]
    sizes = [np.array([len(x) for x in lists], dtype=np.int64) for lists in (qw, bw)]
    q_row, b_row = np.repeat(np.arange(nq), sizes[0]), np.repeat(np.arange(nb), sizes[1])
    q_code, b_code = codes[:len(q_row)], codes[len(q_row):]
    q_n, b_n = np.concatenate([*qn]).astype(float), np.concatenate([*bn]).astype(float)
    n = int(codes.max(initial=-1)) + 1
    q_df, b_df = np.bincount(q_code, minlength=n), np.bincount(b_code, minlength=n)
    often = np.argsort(-(q_df * b_df), kind="stable")[:DENSE_WORDS]
    often = often[(q_df * b_df)[often] * DENSE_SHARE > nq * nb]
    column = np.full(n, -1)
    column[often] = np.arange(len(often))
    most = np.sqrt(np.bincount(q_row, q_n * q_n).max(initial=0)) * np.sqrt(np.bincount(b_row, b_n * b_n).max(initial=0))
    kind = np.float32 if most < 1 << 24 else np.float64  # whole numbers below are exact

    def dense(rows, code, counts, height):
        out, at = np.zeros((height, len(often)), dtype=kind), column[code] >= 0
        out[rows[at], column[code[at]]] = counts[at]
        return out

    q_dense, b_dense = dense(q_row, q_code, q_n, nq), dense(b_row, b_code, b_n, nb)
    rare = (column[q_code] < 0) & (b_df[q_code] > 0)
    q_row, q_code, q_n = q_row[rare], q_code[rare], q_n[rare]
    by_word = np.argsort(b_code, kind="stable")
    b_row, b_n = b_row[by_word], b_n[by_word]
    first = np.cumsum(b_df) - b_df

    def products(rows: slice) -> np.ndarray:
        out = (q_dense[rows] @ b_dense.T).astype(np.float64)
        flat = out.ravel()
        at, end = np.searchsorted(q_row, [rows.start, rows.stop])
        until = np.cumsum(b_df[q_code[at:end]])
        start = 0
        while at + start < end:
            before = until[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(until, before + MET_AT_ONCE, "right")))
            some = slice(at + start, at + stop)
            times = b_df[q_code[some]]
            place = np.arange(times.sum()) + np.repeat(first[q_code[some]] - (np.cumsum(times) - times), times)
            np.add.at(flat, np.repeat((q_row[some] - rows.start) * nb, times) + b_row[place], np.repeat(q_n[some], times) * b_n[place])
            start = stop
        return out

    return products


def pairs_above(q: Bags, b: Bags, threshold: float) -> DataFrame:
    """``_g, _qt, _bt``: pairs of bags of a cosine strictly above ``threshold`` (a similarity join).

    Only words from which the threshold can still be reached are joined.
    """
    qw, bw = q.words("q"), b.words("b")
    floors = q.bags.select("_g", F.col("_t").alias("_qt"), F.lit(float(threshold)).alias("_floor"))
    found = _by_bounds(write_stage(_ranked_words(qw, bw, False), "bag-ranked"), bw, floors, False)
    return found.where(score(F.col("_dot"), F.col("_qnorm"), F.col("_bnorm"), False) > threshold).select("_g", "_qt", "_bt")


def common_words(b: Bags) -> DataFrame:
    """``_w, _least``: words that every bag has, with the least count, where all bags are one group."""
    total = b.bags.count()
    return b.words("b").groupBy("_w").agg(F.count("*").alias("_df"), F.min("_bn").alias("_least")).where(F.col("_df") == total).drop("_df")


def pairs_with_constant(q: Bags, b: Bags, k: int) -> DataFrame:
    """Like ``pairs`` for one group whose bags share words: those are a constant of the question.

    Joined are the counts above the least one. A pair that shares nothing else
    scores the constant over the norms, so of these only the first bags of each
    norm (in the order of their rows) can be among the best. Where more than
    ``DIRECT_MOST`` other postings meet, bags are scored whole in tiles.
    """
    qw, bw = q.words("q"), b.words("b")
    shared = write_stage(common_words(b), "bag-common")  # words of all examples: few
    fixed = qw.join(F.broadcast(shared), "_w").groupBy("_qt", "_qnorm").agg(F.sum(F.col("_qn") * F.col("_least")).alias("_fixed"))
    rest = (bw.join(F.broadcast(shared), "_w", "left").withColumn("_bn", F.col("_bn") - F.coalesce("_least", F.lit(0)))
            .where("_bn > 0").drop("_least"))
    if met_rows(qw, rest) > DIRECT_MOST:
        return pairs_by_tiles(q, b, k)
    joined = _meet(qw, rest).select("_qt", "_bt", "_qnorm", "_bnorm", "_dot")
    near = Window.partitionBy("_norm").orderBy(F.col("_top")[0])
    stand = b.bags.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= k)
    norms = stand.groupBy().agg(F.collect_list(F.struct(F.col("_t").alias("_bt"), F.col("_norm").alias("_bnorm"))).alias("s"))
    alone = fixed.select("_qt", "_qnorm", F.explode(norms.scalar()).alias("s")).select(  # k rows a distinct norm
        "_qt", "s._bt", "_qnorm", "s._bnorm", F.lit(0).cast("long").alias("_dot"))
    every = joined.unionByName(alone).groupBy("_qt", "_bt", "_qnorm", "_bnorm").agg(F.max("_dot").alias("_dot"))
    every = every.join(fixed.drop("_qnorm"), "_qt", "left").withColumn("_dot", F.col("_dot") + F.coalesce("_fixed", F.lit(0)))
    return every.where("_dot > 0").select(F.lit("").alias("_g"), "_qt", "_bt", F.round(
        score(F.col("_dot"), F.col("_qnorm"), F.col("_bnorm"), False), 6).alias("sim"))


def best_lists(found: DataFrame, b: Bags, k: int, by: list[str]) -> DataFrame:
    """``by, _found``: at most k*k of the best rows as (neg, row) structs, from scored pairs that have ``_bt``.

    ``b`` has the first k rows of each bag; a bag's first row stands for it in ties.
    """
    tops = b.bags.select("_g", F.col("_t").alias("_bt"), "_top")
    best = Window.partitionBy(*by).orderBy(F.col("sim").desc(), F.col("_top")[0])
    top = found.join(tops, ["_g", "_bt"]).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)
    scored = F.transform("_top", lambda r: F.struct((-F.col("sim")).alias("neg"), r.alias("row")))
    return top.groupBy(*by).agg(F.flatten(F.collect_list(scored)).alias("_found"))


def ranked(asked: DataFrame, q_key: str, fill: Column, k: int, exclude: str | None = None) -> DataFrame:
    """``q_key, row columns, sim, rank`` of ``asked(q_key, _found)``: filled with score 0 by the rows of ``fill``.

    ``exclude`` names the row column that must differ from the question's key.
    """
    asked = asked.withColumn("_zero", fill)
    none = F.array().cast(asked.schema["_found"].dataType)
    found = F.coalesce("_found", none)
    zeros = F.filter(F.coalesce("_zero", F.array().cast(asked.schema["_zero"].dataType)), lambda f: ~F.exists(found, lambda r: r["row"].eqNullSafe(f)))
    every = F.concat(found, F.transform(zeros, lambda f: F.struct(F.lit(-0.0).alias("neg"), f.alias("row"))))
    if exclude:
        every = F.filter(every, lambda r: r["row"][exclude] != F.col(q_key))
    # ties by the row's columns in order
    out = asked.select(q_key, F.posexplode(F.slice(F.array_sort(every), 1, k)).alias("_at", "r"))
    return out.select(q_key, "r.row.*", (F.lit(0.0) - F.col("r.neg")).alias("sim"), (F.col("_at") + 1).cast("long").alias("rank"))
