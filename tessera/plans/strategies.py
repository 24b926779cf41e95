"""End-to-end prompt plans, one per retrieval strategy of the source.

Each plan is one lazy Spark DataFrame: de-duplicated bank -> similarity
top-k -> few-shot block -> budgeted table text -> prompt. Nothing is
collected; call an action or a sink on the result.

Generic inputs (any source can provide them):

* ``questions``: ``qid, question, table_id`` [+ ``answer``] [+ ``prediction``
  for the code-based strategies]
* ``bank``: ``bid, question, code, answer, table_id`` + order columns
  (``seq_cols``) that define first/last among duplicates
* ``rows``: table rows ``table_id, row_idx, row_text, header_text`` (from
  :func:`tessera.operators.render.rows_from_cells` or ``rows_from_frame``)
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.literals import (
    CODE_SIM_THRESHOLD,
    EXAMPLE_TABLE_ROWS,
    FEW_SHOT,
    HEAD_ROWS_FOR_TABLE_SIM,
    KEYWORD_NGRAM,
    ROW_SELECT_K,
    TABLE_BUDGET,
)
from tessera.functions.text import casefold, min_ngram
from tessera.operators import prompts as P
from tessera.operators import render as R
from tessera.operators import similarity as S
from tessera.operators.select import with_keys
from tessera.plans import roles
from tessera.session import write_stage

BANK_TIES = ["first_conv_id", "first_turn"]


# ------------------------------------------------------------ generic plans

def _ties(seq_cols: list[str]) -> list[str]:
    return ["first_" + c for c in seq_cols]


def dedup(bank: DataFrame, seq_cols: list[str]) -> DataFrame:
    return S.bank_dedup_last(bank, "question", seq_cols)


def fewshot(ranked: DataFrame, dbank: DataFrame) -> DataFrame:
    """``qid, rank, bid`` + de-duplicated bank -> ``qid, block``."""
    ex = ranked.join(dbank.select("bid", F.col("nl").alias("example_question"),
                                  F.col("code").alias("example_code")), "bid")
    return P.fewshot_block(ex, "qid")


def asked_tables(questions: DataFrame, rows: DataFrame, budget: int = TABLE_BUDGET) -> DataFrame:
    """Budgeted texts of the tables that questions ask about."""
    return R.budgeted_tables(with_keys(rows, questions, ["table_id"]), budget)


def _chosen(ranked: DataFrame, dbank: DataFrame, bank: DataFrame, seq_cols: list[str], lookup=None) -> DataFrame:
    """``bid, nl, code`` of the ranked entries of the de-duplicated bank, read again by position; ``ranked`` lies in files."""
    names = ["bid", "nl", *seq_cols]
    wanted = write_stage(with_keys(dbank, ranked, ["bid"]).select(*names).distinct(), "chosen")
    found = (lookup(wanted) if lookup else bank).withColumn("nl", casefold("question"))
    w = wanted.select(*[F.col(c).alias("_" + c) for c in names])
    return found.join(w, reduce(and_, [F.col(c).eqNullSafe(F.col("_" + c)) for c in names]), "left_semi").select("bid", "nl", "code")


def _code_prompts(questions: DataFrame, ranked: DataFrame, dbank: DataFrame, rows: DataFrame,
                  budget: int) -> DataFrame:
    qt = R.join_question_table(questions, asked_tables(questions, rows, budget))
    return P.code_prompt(qt, fewshot(ranked, dbank), "qid")


def nl_plan(questions: DataFrame, bank: DataFrame, rows: DataFrame, seq_cols: list[str],
            k: int = FEW_SHOT, budget: int = TABLE_BUDGET) -> DataFrame:
    """Examples ranked by question similarity: ``qid, prompt``."""
    b = dedup(bank, seq_cols)
    ranked = S.sparse_topk(questions, b, q_key="qid", b_key="bid", q_text="question",
                           b_text="nl", k=k, tie_cols=_ties(seq_cols))
    return _code_prompts(questions, ranked, b, rows, budget)


def keyword_plan(questions: DataFrame, bank: DataFrame, rows: DataFrame, seq_cols: list[str],
                 k: int = FEW_SHOT, n: int = KEYWORD_NGRAM, budget: int = TABLE_BUDGET, lookup=None) -> DataFrame:
    """Question similarity gated by the question's keyword: ``qid, prompt, keyword``.

    Questions of the de-duplicated bank are written without codes; the codes of the ranked examples
    are read afterwards, by ``lookup(positions)`` (bank rows at ``seq_cols``) if there is one.
    """
    b = write_stage(dedup(bank, seq_cols).select("bid", "nl", *seq_cols, *_ties(seq_cols)), "bank-questions")
    ranked = S.keyword_gate(questions, b, q_key="qid", b_key="bid", q_text="question", b_text="nl", k=k, n=n,
                            tie_cols=_ties(seq_cols))
    ranked = write_stage(ranked.select("qid", "bid", "rank"), "ranked")
    out = _code_prompts(questions, ranked, _chosen(ranked, b, bank, seq_cols, lookup), rows, budget)
    kw = questions.select("qid", min_ngram("question", n).alias("keyword"))
    return out.join(kw, "qid", "left")


def code_plan(questions: DataFrame, bank: DataFrame, rows: DataFrame, seq_cols: list[str],
              k: int = FEW_SHOT, budget: int = TABLE_BUDGET) -> DataFrame:
    """Examples ranked by similarity of masked predicted code to masked
    example code: ``qid, prompt, pre_predicted``."""
    b = dedup(bank, seq_cols)
    ranked = S.code_masked_topk(questions, b, q_key="qid", b_key="bid", q_code="prediction",
                                b_code="code", k=k, tie_cols=_ties(seq_cols))
    out = _code_prompts(questions, ranked, b, rows, budget)
    return out.join(questions.select("qid", F.col("prediction").alias("pre_predicted")), "qid")


def two_signal_plan(questions: DataFrame, bank: DataFrame, rows: DataFrame, seq_cols: list[str],
                    k: int = FEW_SHOT, threshold: float = CODE_SIM_THRESHOLD,
                    budget: int = TABLE_BUDGET) -> DataFrame:
    """Code similarity above ``threshold`` gates, question similarity ranks:
    ``qid, prompt, pre_predicted``."""
    from tessera.functions.text import decode_code_newlines, mask_literals

    b = dedup(bank, seq_cols).withColumn("_mcode", mask_literals(decode_code_newlines("code")))
    q = questions.withColumn("_mpred", mask_literals("prediction"))
    ranked = S.threshold_rank_topk(q, b, q_key="qid", b_key="bid", q_gate="_mpred", b_gate="_mcode",
                                   q_rank="question", b_rank="nl", k=k, threshold=threshold,
                                   kind="sparse", tie_cols=_ties(seq_cols))
    out = _code_prompts(questions, ranked, b, rows, budget)
    return out.join(questions.select("qid", F.col("prediction").alias("pre_predicted")), "qid")


def self_check_plan(bank: DataFrame, rows: DataFrame, seq_cols: list[str], k: int = FEW_SHOT,
                    budget: int = TABLE_BUDGET) -> DataFrame:
    """Every bank example against the bank itself (self included):
    ``qid, prompt, code, answer``."""
    b = dedup(bank, seq_cols)
    q = b.select(F.col("bid").alias("qid"), F.col("nl").alias("question"), "table_id", "code", "answer")
    ranked = S.sparse_topk(q, b, q_key="qid", b_key="bid", q_text="question", b_text="nl", k=k,
                           tie_cols=_ties(seq_cols))
    out = _code_prompts(q, ranked, b, rows, budget)
    return out.join(q.select("qid", "code", "answer"), "qid")


def agent_plan(questions: DataFrame, rows: DataFrame, row_selection: bool = False,
               k_rows: int = ROW_SELECT_K) -> DataFrame:
    """Zero-shot agent prompt over the whole table (no budget), or over the
    header and the ``k_rows`` rows most similar to the question."""
    if row_selection:
        pieces = rows.select("table_id", (F.col("row_idx") + 1).alias("row_idx"), "row_text")
        heads = rows.groupBy("table_id").agg(F.min_by("header_text", "row_idx").alias("row_text"))
        pieces = pieces.unionByName(heads.select("table_id", F.lit(0).cast("long").alias("row_idx"),
                                                 "row_text"))
        qrows = questions.select("qid", "question", "table_id")
        # one row-selection per (question, table): key the pieces by question
        per_q = pieces.join(qrows.select("qid", "table_id"), "table_id").select(
            F.col("qid").alias("table_id"), "row_idx", "row_text")
        sel = S.select_rows(per_q, qrows.select(F.col("qid").alias("table_id"), "question"), k=k_rows)
        qt = questions.join(sel.select(F.col("table_id").alias("qid"), F.col("text").alias("table_text")),
                            "qid", "left")
    else:
        qt = R.join_question_table(questions, R.render_rows(rows))
    return P.agent_prompt(qt, "qid")


def table_examples(tq: DataFrame, rows: DataFrame, bank: DataFrame, n_text_rows: int, lookup=None) -> DataFrame:
    """``qid, example_table_text, example_question, example_answer`` of the examples found by ``table_then_question``.

    Texts are read of the examples and tables found; ``lookup(positions)`` gives the bank rows at ``conv_id, turn``.
    """
    tq = write_stage(tq, "table-examples")
    found = with_keys(bank, tq.where("bid is not null"), ["bid"])
    if lookup:
        found = lookup(found.select("conv_id", "turn"))
    tables = tq.select(F.col("example_table").alias("table_id"))
    heads = R.render_head(with_keys(rows, tables, ["table_id"]), n_text_rows).select(
        F.col("table_id").alias("example_table"), F.col("text").alias("example_table_text"))
    return (tq.join(found.select("bid", casefold("question").alias("example_question"), F.col("answer").alias("example_answer")), "bid")
              .join(heads, "example_table", "left").select("qid", "example_table_text", "example_question", "example_answer"))


def table_plan(questions: DataFrame, bank: DataFrame, rows: DataFrame, seq_cols: list[str],
               budget: int = TABLE_BUDGET, lookup=None) -> DataFrame:
    """Best example table by header + first row, then its best question;
    agent prompt with that example: ``qid, prompt``."""
    b = bank.withColumn("nl", F.lower("question"))
    heads = R.render_head(rows, HEAD_ROWS_FOR_TABLE_SIM)
    tq = S.table_then_question(questions, b, heads, heads, q_key="qid", b_key="bid",
                               q_text="question", b_text="nl", tie_cols=seq_cols)
    ex = table_examples(tq, rows, b, EXAMPLE_TABLE_ROWS, lookup)
    qt = R.join_question_table(questions, asked_tables(questions, rows, budget)).join(ex, "qid", "left")
    return P.table_example_prompt(qt, "qid")


PLANS = {
    "question": nl_plan,
    "keyword": keyword_plan,
    "code": code_plan,
    "two_signal": two_signal_plan,
    "table": table_plan,
}


def build_prompts(strategy: str, questions: DataFrame, bank: DataFrame, rows: DataFrame,
                  seq_cols: list[str], nfkd: bool = False, sample: int | None = None,
                  seed: int = 123, **kw) -> DataFrame:
    """Dispatch by strategy: ``question``, ``keyword``, ``code``, ``two_signal``,
    ``table``, ``self_check`` or ``agent``.

    The bank is filtered to correct examples first, as the source does.
    ``nfkd`` normalises every text column once at ingest (the source
    normalises all strings it loads); ``sample`` keeps a reproducible sample
    of that many questions (the source samples before asking).
    """
    from tessera.functions.unicode import nfkd_columns
    from tessera.operators.select import correct_bank, sample_n

    if "correct" in bank.columns:
        bank = correct_bank(bank)
    if nfkd:
        questions = nfkd_columns(questions, [c for c in ("question", "prediction") if c in questions.columns])
        bank = nfkd_columns(bank, [c for c in ("question", "code", "answer") if c in bank.columns])
        rows = nfkd_columns(rows, ["row_text", "header_text"])
    if sample is not None:
        questions = sample_n(questions, "qid", sample, seed)
    if strategy == "self_check":
        return self_check_plan(bank, rows, seq_cols, **kw)
    if strategy == "agent":
        return agent_plan(questions, rows, **kw)
    return PLANS[strategy](questions, bank, rows, seq_cols, **kw)


# ------------------------------------------------------------ the flagship on the fixtures

def dedup_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.bank_dedup_last(roles.bank(spark, sf_dir), "question", ["conv_id", "turn"])


def nl_topk(spark: SparkSession, sf_dir: str, k: int = FEW_SHOT) -> DataFrame:
    """Top-k examples per question by question-text similarity."""
    q = roles.questions(spark, sf_dir)
    b = dedup_bank(spark, sf_dir)
    return S.sparse_topk(q, b, q_key="qid", b_key="bid", q_text="question", b_text="nl",
                         k=k, tie_cols=BANK_TIES)


def tables(spark: SparkSession, sf_dir: str, budget: int = TABLE_BUDGET) -> DataFrame:
    return R.budgeted_tables(roles.conversation_rows(spark, sf_dir), budget)


def nl_prompts(spark: SparkSession, sf_dir: str, k: int = FEW_SHOT,
               budget: int = TABLE_BUDGET) -> DataFrame:
    """The nl strategy on the fixture roles: ``qid, prompt``."""
    return nl_plan(roles.questions(spark, sf_dir), roles.bank(spark, sf_dir),
                   roles.conversation_rows(spark, sf_dir), ["conv_id", "turn"], k, budget)
