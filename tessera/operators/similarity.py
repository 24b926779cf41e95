"""Retrieval of solved examples: de-duplication, similarity and top-k.

Texts are scored as word bags in joins (:mod:`tessera.operators.bags`), vectors
in the block grid (:mod:`tessera.operators.blocks`), so no operator here builds
a cross join. Text similarity is cosine over counts of lower-cased words: the reference embeds text
with a neural model, which is not part of this engine; vectors supplied as a
column are scored with the dense kernel instead.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import casefold, decode_code_newlines, mask_literals, min_ngram, words
from tessera.operators import bags, blocks
from tessera.operators.blocks import Kernel, dense_strips
from tessera.session import write_stage


def bank_dedup_last(bank: DataFrame, text_col: str, seq_cols: list[str]) -> DataFrame:
    """One entry per lower-cased question: the **last** duplicate's values,
    the **first** duplicate's position (``first_<seq>`` columns), ``n_dup``.

    This is the dict-keyed-by-question behaviour of the source. The aggregation
    is keyed by a 256-bit hash of the question and carries positions only
    (combined map-side, so a question repeated a billion times is one row
    before the shuffle); the winners' rows are joined back by position, which
    must be unique.
    """
    keyed = bank.withColumn("_h", F.unhex(F.sha2(F.encode(casefold(text_col), "UTF-8"), 256)))
    seq = F.struct(*[F.col(c) for c in seq_cols])
    agg = keyed.groupBy("_h").agg(F.max(seq).alias("_last"), F.min(seq).alias("_first"), F.count("*").alias("n_dup"))
    agg = agg.select(F.col("_h").alias("_gh"), *[F.col("_last")[c].alias("_last_" + c) for c in seq_cols],
                     *[F.col("_first")[c].alias("first_" + c) for c in seq_cols], "n_dup")
    same = keyed["_h"].eqNullSafe(agg["_gh"])
    for c in seq_cols:
        same = same & keyed[c].eqNullSafe(agg["_last_" + c])
    return keyed.join(agg, same).select(casefold(text_col).alias("nl"), *bank.columns,
                                        *["first_" + c for c in seq_cols], "n_dup")


def _order(tie_cols: list[str] | None, b_key: str) -> list[str]:
    return [*(tie_cols or []), b_key]


def _first_of(rows: DataFrame, order: list[str], k: int) -> F.Column:
    """The first 2k + 1 rows by ``order``, as one value."""
    first = rows.select(F.struct(*order).alias("row")).orderBy("row").limit(2 * k + 1)
    return first.agg(F.array_sort(F.collect_list("row")).alias("rows")).scalar()


def _first_rows(bank: bags.Bags, k: int) -> F.Column:
    """The first 2k + 1 rows of the whole bank, as one value that every question reads; more are never needed as filler."""
    rows = bank.bags.select(F.explode("_top").alias("row")).orderBy("row").limit(2 * k + 1)
    return rows.agg(F.array_sort(F.collect_list("row")).alias("rows")).scalar()


def token_topk(queries: DataFrame, bank: DataFrame, *, q_key: str, b_key: str, q_text: str, b_text: str, k: int,
               tie_cols: list[str] | None = None, group: str | None = None, exclude_self: bool = False,
               sets: bool = False, direct_rows: int | None = None) -> DataFrame:
    """Top-k bank rows per question by word-count cosine (``sets``: by Jaccard), exact, in built-in operations.

    Distinct bags of words are scored (:mod:`tessera.operators.bags`), the k best
    bags per question bag are kept by a group limit, and rows with equal bags are
    expanded after it. Ordering: score rounded to 6 dp, then tie columns, then
    key. A question with fewer than k related rows is filled with score 0 from
    the first bank rows in tie order (with ``group``: of its group).
    """
    order, kk = _order(tie_cols, b_key), k + int(exclude_self)
    q = bags.index(queries, [q_key], q_text, group, sets)
    b = bags.index_best(bank, order, b_text, kk, group, sets)
    scored = bags.pairs_in_groups if group else bags.pairs
    found = bags.best_lists(scored(q, b, kk, sets, direct_rows), b, kk, ["_g", "_qt"])
    asked = q.rows.withColumnRenamed("_t", "_qt").join(found, ["_g", "_qt"], "left")
    if not group:
        return bags.ranked(asked, q_key, _first_rows(b, kk), k, b_key if exclude_self else None)
    ahead = Window.partitionBy("_g").orderBy("row")
    filler = b.bags.select("_g", F.explode("_top").alias("row")).withColumn("_r", F.row_number().over(ahead))
    filler = filler.where(F.col("_r") <= 2 * kk + 1).groupBy("_g").agg(F.array_sort(F.collect_list("row")).alias("_fill"))
    return bags.ranked(asked.join(filler, "_g"), q_key, F.col("_fill"), k, b_key if exclude_self else None)


def sparse_topk(queries: DataFrame, bank: DataFrame, *, q_key: str, b_key: str,
                q_text: str, b_text: str, k: int, tie_cols: list[str] | None = None,
                group: str | None = None, exclude_self: bool = False) -> DataFrame:
    """Top-k bank rows per question by word-count cosine (exact, pads with 0)."""
    return token_topk(queries, bank, q_key=q_key, b_key=b_key, q_text=q_text, b_text=b_text, k=k,
                      tie_cols=tie_cols, group=group, exclude_self=exclude_self)


def vector_topk(queries: DataFrame, bank: DataFrame, *, q_key: str, b_key: str,
                q_vec: str, b_vec: str, k: int, tie_cols: list[str] | None = None,
                include_self: bool = True, group: str | None = None,
                block_rows: int | None = None) -> DataFrame:
    """Top-k by cosine of supplied vectors. ``include_self=False`` drops the
    pair of a key with itself (when both sides share key values)."""
    return blocks.topk(queries, bank, q_key=q_key, b_key=b_key,
                       kernel=blocks.dense_kernel(q_vec, b_vec), k=k, tie_cols=tie_cols,
                       exclude_self=not include_self, group=group, block_rows=block_rows)


def vector_pairs_above(queries: DataFrame, bank: DataFrame, *, q_key: str, b_key: str,
                       q_vec: str, b_vec: str, threshold: float) -> DataFrame:
    """Every pair with cosine >= ``threshold`` (a similarity join), scored in
    tiles; pairs under the threshold are never materialised."""
    spark_k = 1 << 30

    def score(q, b):
        cosines = dense_strips(q[q_vec], b[b_vec])
        return {"sim": lambda rows: blocks.at_least(cosines(rows), threshold)}, {}

    kernel = Kernel([q_vec], [b_vec], score, q_weight=blocks.vector_weight(q_vec), b_weight=blocks.vector_weight(b_vec))
    tiles = blocks.grid_scores(queries, bank, q_key=q_key, b_key=b_key, kernel=kernel, k=spark_k)
    return tiles.filter(F.col("mode") == "sim").select(q_key, b_key, "sim")


# ------------------------------------------------------------ keyword gate


FEW_KEYWORDS = 1 << 18  # counted keywords that are sent to every executor


def _words_with(kws: DataFrame, vocabulary: DataFrame, few: bool = False) -> DataFrame:
    """``_kw, _tok``: the distinct words that contain each keyword's first word.

    ``few``: the keywords are sent to the words, so that no letters are shuffled.
    """
    kws = kws.withColumn("_head", F.split_part("_kw", F.lit(" "), F.lit(1))).withColumn("_gram", F.substring("_head", 1, 3))
    grams = lambda size: F.transform(F.sequence(F.lit(1), F.greatest(F.length("_tok") - size + 1, F.lit(1))),
                                     lambda at: F.substr(F.col("_tok"), at, F.lit(size)))
    vocabulary = vocabulary.select("_tok", F.explode(F.array_distinct(F.concat(grams(2), grams(3)))).alias("_gram"))
    return vocabulary.join(F.broadcast(kws) if few else kws, "_gram").filter(F.contains("_tok", "_head")).select("_kw", "_tok")


def keyword_rows(queries: DataFrame, bank: DataFrame, *, b_key: str, q_text: str, b_text: str, n: int = 1) -> DataFrame:
    """``_kw, b_key``: each distinct keyword with the bank rows whose lower-cased text contains it.

    A keyword is the alphabetically first n-gram of a question. Its first word
    lies inside a word of any text that contains it, so candidates come from
    the bank's vocabulary: distinct words are joined to keywords on the first
    two or three letters (at any place of the word) and tested there, then
    joined back to the rows that have the word.
    """
    kws = queries.select(min_ngram(q_text, n).alias("_kw")).filter("_kw is not null").distinct()
    tokens = bank.select(b_key, F.explode(F.array_distinct(words(b_text))).alias("_tok"))
    found = _words_with(kws, tokens.select("_tok").distinct()).join(tokens, "_tok").select("_kw", b_key).distinct()
    if n > 1:  # the other words, with the space between
        texts = bank.select(b_key, casefold(b_text).alias("_nl"))
        found = found.join(texts, b_key).filter(F.contains("_nl", "_kw")).select("_kw", b_key)
    return found


def keyword_gate(queries: DataFrame, bank: DataFrame, *, q_key: str, b_key: str, q_text: str, b_text: str, k: int,
                 n: int = 1, tie_cols: list[str] | None = None) -> DataFrame:
    """Top-k of the keyword strategy.

    An example keeps its score only if its lower-cased question contains the
    keyword; the others score 0. If no example of the whole bank contains it,
    every example keeps its score.

    Bags are scored once, without the bank's texts: a keyword of one word lies
    inside a word, so a bag has it or not. It is the first word of the question's
    bag. Where few postings meet, the gate is a table of (keyword, bag) that the
    scored pairs are joined to. Beyond, a tile looks for its keywords in its
    words, and only whether the bank has a keyword at all is asked before.
    """
    order = _order(tie_cols, b_key)
    if n > 1:
        queries = queries.withColumn("_kw", F.coalesce(min_ngram(q_text, n), F.lit("")))
        return _long_keyword_gate(queries, bank, order, q_key=q_key, b_key=b_key, q_text=q_text, b_text=b_text, k=k, n=n)
    q, b = bags.index(queries, [q_key], q_text), bags.index_best(bank, order, b_text, k)
    each = q.bags.select("_g", F.col("_t").alias("_qt"), bags.first_word().alias("_kw"))
    kws = write_stage(each.select("_kw").where("_kw is not null").distinct(), "gate-words")
    tokens = b.words("b").select("_bt", F.col("_w").alias("_tok"))
    having = _words_with(kws, tokens.select("_tok").distinct(), kws.count() <= FEW_KEYWORDS)
    if bags.met_rows(q.words("q"), b.words("b")) <= bags.DIRECT_MOST:
        hits = write_stage(having.join(tokens, "_tok").select("_kw", "_bt").distinct(), "gate-hits")
        open_ = each.join(hits.select("_kw").distinct(), "_kw", "left_anti")
        plain = bags.pairs(q, b, k, direct_rows=1 << 62)  # a gate may let any pair in
        let_in = plain.join(each, ["_g", "_qt"]).join(hits, ["_kw", "_bt"]).unionByName(plain.join(open_, ["_g", "_qt"]))
    else:
        let_in = bags.pairs_by_tiles(q, b, k, gate=having.select("_kw").distinct())
    found = bags.best_lists(let_in, b, k, ["_g", "_qt"])
    asked = q.rows.withColumnRenamed("_t", "_qt")
    return bags.ranked(asked.join(found, ["_g", "_qt"], "left"), q_key, _first_rows(b, k), k)


def _long_keyword_gate(queries: DataFrame, bank: DataFrame, order: list[str], *, q_key: str, b_key: str, q_text: str,
                       b_text: str, k: int, n: int) -> DataFrame:
    """Keywords of several words are tested on texts: each is a group of the rows that have it."""
    rows = write_stage(keyword_rows(queries, bank, b_key=b_key, q_text=q_text, b_text=b_text, n=n), "gate-rows")
    hit = rows.select("_kw").distinct()
    q = bags.index(queries.join(hit, "_kw", "left_semi"), [q_key], q_text, "_kw")
    b = bags.index_best(bank.join(rows, b_key), order, b_text, k, "_kw")
    found = bags.best_lists(bags.pairs(q, b, k), b, k, ["_g", "_qt"])
    asked = q.rows.withColumnRenamed("_t", "_qt").join(found, ["_g", "_qt"], "left")
    gated = bags.ranked(asked, q_key, _first_of(bank, order, k), k)
    return gated.unionByName(token_topk(queries.join(hit, "_kw", "left_anti"), bank, q_key=q_key, b_key=b_key, q_text=q_text,
                                        b_text=b_text, k=k, tie_cols=order[:-1]))


def keyword_stats(queries: DataFrame, bank: DataFrame, *, b_key: str, q_text: str, b_text: str, n: int = 1,
                  weight_col: str | None = None) -> DataFrame:
    """Total matches, average per question and number of fallbacks; duplicates
    removed by de-duplication count by ``weight_col``. Nothing is scored."""
    rows = keyword_rows(queries, bank, b_key=b_key, q_text=q_text, b_text=b_text, n=n)
    weight = F.col(weight_col) if weight_col else F.lit(1)
    hits = rows.join(bank.select(b_key, weight.alias("_weight")), b_key).groupBy("_kw").agg(F.sum("_weight").alias("hits"))
    each = queries.select(min_ngram(q_text, n).alias("_kw")).join(hits, "_kw", "left").select(F.coalesce("hits", F.lit(0)).alias("hits"))
    return each.agg(F.sum("hits").cast("long").alias("total_hits"), F.avg("hits").alias("avg_hits"),
                    F.count_if(F.col("hits") == 0).alias("fallbacks"))


# ------------------------------------------------------------ code, two-signal


def code_masked_topk(queries: DataFrame, bank: DataFrame, *, q_key: str, b_key: str,
                     q_code: str, b_code: str, k: int,
                     tie_cols: list[str] | None = None) -> DataFrame:
    """Top-k by similarity of masked predicted code to masked example code."""
    q = queries.withColumn("_mq", mask_literals(q_code))
    b = bank.withColumn("_mb", mask_literals(decode_code_newlines(b_code)))
    return sparse_topk(q, b, q_key=q_key, b_key=b_key, q_text="_mq", b_text="_mb", k=k,
                       tie_cols=tie_cols)


def threshold_rank_topk(queries: DataFrame, bank: DataFrame, *, q_key: str, b_key: str,
                        q_gate: str, b_gate: str, q_rank: str, b_rank: str, k: int,
                        threshold: float, kind: str = "dense", tie_cols: list[str] | None = None,
                        include_self: bool = True) -> DataFrame:
    """Two signals: an example whose gate similarity is **strictly greater**
    than ``threshold`` is ranked by its rank similarity, every other example
    scores 0. ``kind`` is ``dense`` (vector columns, in tiles) or ``sparse``
    (texts, in joins)."""
    if kind == "sparse":
        return _threshold_rank_texts(queries, bank, q_key=q_key, b_key=b_key, q_gate=q_gate, b_gate=b_gate, q_rank=q_rank,
                                     b_rank=b_rank, k=k, threshold=threshold, order=_order(tie_cols, b_key),
                                     exclude_self=not include_self)

    def score(q, b):
        gate, rank = dense_strips(q[q_gate], b[b_gate]), dense_strips(q[q_rank], b[b_rank])
        return {"sim": lambda rows: np.where(gate(rows) > threshold, rank(rows), 0.0)}, {}

    both = lambda x, y: lambda f: blocks.vector_weight(x)(f) + blocks.vector_weight(y)(f)
    kernel = Kernel([q_gate, q_rank], [b_gate, b_rank], score, q_weight=both(q_gate, q_rank), b_weight=both(b_gate, b_rank))
    return blocks.topk(queries, bank, q_key=q_key, b_key=b_key, kernel=kernel, k=k,
                       tie_cols=tie_cols, exclude_self=not include_self)


def _threshold_rank_texts(queries: DataFrame, bank: DataFrame, *, q_key: str, b_key: str, q_gate: str, b_gate: str,
                          q_rank: str, b_rank: str, k: int, threshold: float, order: list[str], exclude_self: bool) -> DataFrame:
    """The gate is a cosine threshold join of distinct bags; a gate bag of the bank is then a group.

    A question joins the groups that its own gate bag passes, and the rank signal
    is scored inside these groups only.
    """
    kk = k + int(exclude_self)
    gq, gb = bags.index(queries, [q_key], q_gate), bags.index(bank, [b_key], b_gate)
    passed = write_stage(bags.pairs_above(gq, gb, threshold).select("_qt", "_bt"), "gate-passed")
    asked = gq.rows.select(q_key, F.col("_t").alias("_qt")).join(passed, "_qt").select(q_key, F.hex("_bt").alias("_gate"))
    held = gb.rows.select(b_key, F.col("_t").alias("_bt")).join(passed.select("_bt").distinct(), "_bt", "left_semi")
    q = bags.index(queries.join(asked, q_key), [q_key], q_rank, "_gate")
    b = bags.index_best(bank.join(held.select(b_key, F.hex("_bt").alias("_gate")), b_key), order, b_rank, kk, "_gate")
    found = bags.best_lists(bags.pairs(q, b, kk), b, kk, ["_g", "_qt"])
    found = q.rows.withColumnRenamed("_t", "_qt").join(found, ["_g", "_qt"])
    # the best of all groups that a question passes
    best = Window.partitionBy(q_key).orderBy("r")
    found = found.select(q_key, F.explode("_found").alias("r")).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= kk)
    found = found.groupBy(q_key).agg(F.collect_list("r").alias("_found"))
    return bags.ranked(queries.select(q_key).join(found, q_key, "left"), q_key, _first_of(bank, order, kk), k,
                       b_key if exclude_self else None)


# ------------------------------------------------------------ table, then question


def head_topk(queries: DataFrame, bank: DataFrame, *, q_key: str, b_key: str, q_text: str, b_text: str, k: int) -> DataFrame:
    """Top-k of texts that share words in all rows (table heads): the same scores as ``token_topk``.

    The words of all bank texts are one constant for each question bag; only
    other words are joined.
    """
    q, b = bags.index(queries, [q_key], q_text), bags.index_best(bank, [b_key], b_text, k)
    found = bags.best_lists(bags.pairs_with_constant(q, b, k), b, k, ["_g", "_qt"])
    asked = q.rows.withColumnRenamed("_t", "_qt").join(found, ["_g", "_qt"], "left")
    return bags.ranked(asked, q_key, _first_rows(b, k), k)


def table_then_question(questions: DataFrame, bank: DataFrame, q_heads: DataFrame,
                        b_heads: DataFrame, *, q_key: str, b_key: str,
                        q_text: str, b_text: str, tie_cols: list[str] | None = None) -> DataFrame:
    """Two-stage retrieval.

    1. Each question's table head (header + first row) against the distinct
       example tables' heads -> the best example table (top-1).
    2. Among that table's examples only (pairs are formed inside the table
       group, split into tiles when a table holds many examples) -> the best
       question by similarity.

    ``questions``: ``q_key, table_id, q_text``; ``bank``: ``b_key, table_id,
    b_text, tie cols, answer``; heads: ``table_id, text``.
    Returns ``q_key, example_table, table_sim, b_key, question_sim``, one row
    per question; a question whose table has no head has nulls.
    """
    qt = (questions.select("table_id").distinct().join(q_heads, "table_id")
                   .select(F.col("table_id").alias("qtab"), F.col("text").alias("qhead")))
    bt = (bank.select("table_id").distinct().join(b_heads, "table_id")
              .select(F.col("table_id").alias("btab"), F.col("text").alias("bhead")))
    best_tab = head_topk(qt, bt, q_key="qtab", b_key="btab", q_text="qhead", b_text="bhead", k=1)
    best_tab = best_tab.select("qtab", F.col("btab").alias("example_table"),
                               F.col("sim").alias("table_sim"))
    best_tab = write_stage(best_tab, "best-tables")
    q2 = (questions.join(best_tab, questions["table_id"] == best_tab["qtab"])
                   .select(q_key, q_text, "example_table", "table_sim"))
    b2 = bank.withColumnRenamed("table_id", "example_table")
    best_q = sparse_topk(q2, b2, q_key=q_key, b_key=b_key, q_text=q_text, b_text=b_text, k=1,
                         tie_cols=tie_cols, group="example_table")
    found = (best_q.select(q_key, b_key, F.col("sim").alias("question_sim"))
                   .join(q2.select(q_key, "example_table", "table_sim"), q_key))
    return questions.select(q_key).join(found, q_key, "left")


# ------------------------------------------------------------ row selection


ROW_BUCKET = 4096  # rows of a table that meet in one place
IN_PLACE = 1 << 22  # word comparisons of a row with its question in place


def select_rows(rows: DataFrame, questions: DataFrame, *, k: int = 5) -> DataFrame:
    """The ``k`` table rows most similar to the table's question, most similar
    first, appended to the header piece with ROWSEP.

    ``rows``: ``table_id, row_idx, row_text`` (row_idx 0 is the header piece);
    ``questions``: ``table_id, question``, one per table. A row meets its
    question where both lie: rows are dealt by (table, bucket of ``ROW_BUCKET``
    rows), the question goes to every bucket of its table, and the words of both
    are compared in place (shared words first, by a hash set). The best of each
    bucket meet once more. Lines whose distinct words times the question's exceed
    ``IN_PLACE`` are scored by joined words instead. Returns ``table_id, text``.
    """
    from tessera.functions.literals import ROWSEP

    bucket = F.floor(F.col("row_idx") / F.lit(ROW_BUCKET))
    sizes = rows.groupBy("table_id").agg(F.max(bucket).alias("_last"))
    bag = lambda c: F.coalesce(F.array_sort(words(c)), F.array().cast("array<string>"))
    asked = questions.join(sizes, "table_id").withColumn("_bag", bag("question")).withColumn("_q", bags.counted(F.col("_bag")))
    asked = asked.select("table_id", "_q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))).alias("_b"))
    lines = rows.withColumn("_b", bucket).join(asked, ["table_id", "_b"], "left")
    lines = lines.withColumn("_bag", bag("row_text")).withColumn("_r", bags.counted(F.col("_bag"))).drop("_bag")
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x["n"] * x["n"]).cast("double"))
    only = lambda c: F.filter(c, lambda x: F.array_contains(F.col("_common"), x["w"]))
    lines = lines.withColumn("_common", F.array_intersect(F.transform("_q", lambda x: x["w"]), F.transform("_r", lambda x: x["w"])))
    # both are sorted by word, so the shared words stand at the same places
    in_place = F.size("_common") * F.greatest(F.size("_q"), F.size("_r")) <= F.lit(IN_PLACE)
    dot = F.aggregate(F.zip_with(only("_q"), only("_r"), lambda a, b: a["n"] * b["n"]), F.lit(0).cast("long"), lambda s, x: s + x)
    lines = lines.withColumn("_dot", F.when(in_place, dot).otherwise(bags.joined_dot(F.col("_q"), F.col("_r"))))
    sim = F.when(F.col("_dot") > 0, F.round(F.col("_dot") / norm("_q") / norm("_r"), 6)).otherwise(F.lit(0.0))
    body = lines.where((F.col("row_idx") > 0) & F.col("_q").isNotNull())
    body = body.select("table_id", "_b", F.struct((-sim).alias("neg"), "row_idx", "row_text").alias("r"))
    near = Window.partitionBy("table_id", "_b").orderBy("r")
    best = body.withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= k)
    whole = Window.partitionBy("table_id").orderBy("r")
    best = best.withColumn("_n", F.row_number().over(whole)).where(F.col("_n") <= k).select("table_id", "r", F.lit(None).cast("string").alias("head"))
    heads = rows.filter(F.col("row_idx") == 0).select("table_id", F.lit(None).cast(best.schema["r"].dataType).alias("r"),
                                                      F.struct("row_text").alias("head"))
    every = best.withColumn("head", F.lit(None).cast("struct<row_text:string>")).unionByName(heads)
    out = every.groupBy("table_id").agg(F.max("head").alias("head"), F.array_sort(F.collect_list("r")).alias("sel"))
    out = out.where("head is not null")
    sel = F.array_join(F.transform("sel", lambda s: s["row_text"]), ROWSEP)
    return out.select("table_id", F.when(F.size("sel") == 0, F.col("head.row_text"))
                      .otherwise(F.concat(F.col("head.row_text"), F.lit(ROWSEP), sel)).alias("text"))


# ------------------------------------------------------------ random few-shot


HASH_BUCKETS = 3  # hex digits of the bucket a bank key is numbered in


def bank_positions(bank: DataFrame, b_key: str) -> tuple[DataFrame, int]:
    """``b_key, pos`` and their number: rows numbered 0.. by (bucket of the key's md5, key).

    Numbers are local to a bucket plus the bucket's offset, so no task numbers
    the whole bank. The driver sees one count per bucket, 16 ** HASH_BUCKETS at most.
    """
    keys = bank.select(b_key, F.substring(F.md5(F.col(b_key).cast("string")), 1, HASH_BUCKETS).alias("_bucket"))
    sizes = sorted((r["_bucket"] or "", r["n"]) for r in keys.groupBy("_bucket").agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for name, n in sizes:
        before.append((name, total))
        total += n
    offsets = bank.sparkSession.createDataFrame(before, "_bucket string, _before long")
    own = Window.partitionBy("_bucket").orderBy(b_key)
    local = keys.withColumn("_bucket", F.coalesce("_bucket", F.lit(""))).withColumn("_n", F.row_number().over(own) - 1)
    return local.join(F.broadcast(offsets), "_bucket").select(b_key, (F.col("_n") + F.col("_before")).alias("pos")), total


def fewshot_random(queries: DataFrame, bank: DataFrame, *, q_key: str, b_key: str, k: int,
                   seed: int = 123, include_self: bool = False) -> DataFrame:
    """``k`` distinct random bank rows per question, the same on every run and engine.

    Draws are positions in the numbered bank, from a keyed hash of (seed,
    question, draw), distinct by Floyd's sampling: draw ``j`` takes a random
    place up to ``N - m + j``, or that place itself if the random one is taken.
    They are equi-joined to the bank's positions, so the work is k rows per
    question and no pair is scored. One draw more replaces the question itself,
    which is excluded by default.
    """
    numbered, size = bank_positions(bank, b_key)
    m = min(size, k + (0 if include_self else 1))
    if m == 0:
        kind = bank.schema[b_key].dataType
        return queries.limit(0).select(q_key, F.lit(None).cast(kind).alias(b_key), F.lit(1).cast("long").alias("rank"))

    def draw(taken, j):
        top = F.lit(size - m) + j
        hashed = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col(q_key).cast("string"), F.lit("|"), j.cast("string"))),
                                    1, 15), 16, 10).cast("long")
        place = F.pmod(hashed, top + 1)
        return F.concat(taken, F.array(F.when(F.array_contains(taken, place), top).otherwise(place)))

    draws = F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")), F.array().cast("array<bigint>"), draw)
    drawn = queries.select(q_key).select(q_key, F.posexplode(draws).alias("_draw", "pos")).join(numbered, "pos")
    if not include_self:
        drawn = drawn.filter(~F.col(q_key).eqNullSafe(F.col(b_key)))
    w = Window.partitionBy(q_key).orderBy("_draw")
    return (drawn.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
            .select(q_key, b_key, "rank"))


# ------------------------------------------------------------ optional strategies


def token_jaccard_topk(queries: DataFrame, bank: DataFrame, *, q_key: str, b_key: str,
                       q_text: str, b_text: str, k: int,
                       tie_cols: list[str] | None = None) -> DataFrame:
    """Top-k by Jaccard similarity of word sets (exact)."""
    return token_topk(queries, bank, q_key=q_key, b_key=b_key, q_text=q_text, b_text=b_text, k=k,
                      tie_cols=tie_cols, sets=True)


def bank_leak_antijoin(questions: DataFrame, bank: DataFrame, q_text: str, b_text: str) -> DataFrame:
    """Drop questions whose lower-cased text is already a bank question."""
    digest = lambda c: F.unhex(F.sha2(F.encode(casefold(c), "UTF-8"), 256))  # noqa: E731 - texts are not shuffled as keys
    keys = bank.select(digest(b_text).alias("_h")).distinct()
    return questions.withColumn("_h", digest(q_text)).join(keys, "_h", "left_anti").drop("_h")
