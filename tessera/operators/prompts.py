"""Prompt assembly: ordered string aggregation and templates.

Templates are built with ``concat`` of literal parts, never by replacing
placeholders one after another (a table holding a placeholder word would
otherwise be rewritten). Wording is ours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import decode_code_newlines

# Template wording (ours).
FEWSHOT_LEAD = "/* Worked pandas examples for similar questions: */\n"
EXAMPLE_Q = "/* Question: "
EXAMPLE_CODE = " */\nCode: "
EXAMPLE_END = "\n\n"
TABLE_LEAD = "/* Table: */\n"
QUESTION_LEAD = "\n\n/* Question: "
CODE_CUE = " */\nCode (pandas DataFrame expression only): "

AGENT_HEAD = (
    "You answer questions about a pandas DataFrame named `df` by running Python.\n"
    "Reply in this format, repeating Thought/Action/Action Input/Observation as needed:\n"
    "Thought: what to do next\n"
    "Action: python_repl_ast\n"
    "Action Input: the code to run\n"
    "Observation: the result\n"
    "Final Answer: the short answer, names or a number only\n\n"
    "The table (every cell is text):\n"
)
AGENT_QUESTION = "\n\nBegin!\nQuestion: "

EXAMPLE_HEAD = "An example table, question and answer:\nTable: "
EXAMPLE_QUESTION = "\nQuestion: "
EXAMPLE_ANSWER = "\nAnswer: "
EXAMPLE_TAIL = "\n\nNow the table to use:\n"

POST_HEAD = "A table and a short-answer question.\n"
POST_QUESTION = "\nQuestion: "
POST_CODE = "\n***\nPandas code written for it: "
POST_RESULT = "\nIts execution result: "
POST_TAIL = "\n***\nAnswer the question in a few words, not a sentence.\nAnswer: "


def fewshot_block(ranked: DataFrame, q_key: str, q_text: str = "example_question",
                  code: str = "example_code") -> DataFrame:
    """``q_key, rank, example_question, example_code`` -> ``q_key, block``.

    One example per rank, in rank order, after a fixed lead line. Stored code
    newlines (``@@@``) are decoded. Groups are bounded by k.
    """
    ex = F.concat(F.lit(EXAMPLE_Q), F.col(q_text), F.lit(EXAMPLE_CODE),
                  decode_code_newlines(code), F.lit(EXAMPLE_END))
    return (ranked.groupBy(q_key)
                  .agg(F.array_sort(F.collect_list(F.struct(F.col("rank"), ex.alias("e")))).alias("es"))
                  .select(q_key, F.concat(F.lit(FEWSHOT_LEAD),
                                          F.array_join(F.transform("es", lambda s: s["e"]), ""))
                          .alias("block")))


def code_prompt(questions: DataFrame, blocks: DataFrame, q_key: str, question: str = "question",
                table_text: str = "table_text") -> DataFrame:
    """Few-shot block + table + question + code cue (left join: a question
    with no example still gets a zero-shot prompt)."""
    j = questions.join(blocks, q_key, "left")
    return j.select(q_key, F.concat(
        F.coalesce(F.col("block"), F.lit(FEWSHOT_LEAD)), F.lit(TABLE_LEAD),
        F.coalesce(F.col(table_text), F.lit("")), F.lit(QUESTION_LEAD), F.col(question),
        F.lit(CODE_CUE)).alias("prompt"))


def agent_prompt(questions: DataFrame, q_key: str, question: str = "question",
                 table_text: str = "table_text") -> DataFrame:
    """Zero-shot agent instructions + table + question."""
    return questions.select(q_key, F.concat(
        F.lit(AGENT_HEAD), F.coalesce(F.col(table_text), F.lit("")), F.lit(AGENT_QUESTION),
        F.col(question)).alias("prompt"))


def table_example_prompt(questions: DataFrame, q_key: str, question: str = "question",
                         table_text: str = "table_text", ex_table: str = "example_table_text",
                         ex_question: str = "example_question",
                         ex_answer: str = "example_answer") -> DataFrame:
    """Agent prompt preceded by one example table, question and answer."""
    return questions.select(q_key, F.concat(
        F.lit(EXAMPLE_HEAD), F.coalesce(F.col(ex_table), F.lit("")),
        F.lit(EXAMPLE_QUESTION), F.coalesce(F.col(ex_question), F.lit("")),
        F.lit(EXAMPLE_ANSWER), F.coalesce(F.col(ex_answer), F.lit("")),
        F.lit(EXAMPLE_TAIL), F.lit(AGENT_HEAD), F.coalesce(F.col(table_text), F.lit("")),
        F.lit(AGENT_QUESTION), F.col(question)).alias("prompt"))


def post_answer_prompt(df: DataFrame, q_key: str, question: str = "question",
                       table_text: str = "table_text", code: str = "prediction",
                       result: str = "result") -> DataFrame:
    """Table + question + code + its execution result -> short answer prompt.
    Inputs are joined by key beforehand (never zipped by position)."""
    return df.select(q_key, F.concat(
        F.lit(POST_HEAD), F.coalesce(F.col(table_text), F.lit("")), F.lit(POST_QUESTION),
        F.col(question), F.lit(POST_CODE), F.coalesce(F.col(code), F.lit("")),
        F.lit(POST_RESULT), F.coalesce(F.col(result), F.lit("")), F.lit(POST_TAIL)).alias("prompt"))


def history_fold(turns: DataFrame, item: str, turn: str, text: str,
                 chunk_turns: int = 256) -> DataFrame:
    """A growing prompt: every turn's text in turn order, one per line block.

    Two-level ordered concatenation (chunks of turns, then the item), so a
    very long history is pre-aggregated in parallel.
    """
    sep = "\n\n"
    chunks = (turns.groupBy(item, F.floor(F.col(turn) / chunk_turns).alias("_ch"))
                   .agg(F.array_join(F.transform(F.array_sort(F.collect_list(
                        F.struct(F.col(turn), F.coalesce(F.col(text), F.lit("")).alias("t")))),
                        lambda s: s["t"]), sep).alias("ct"),
                        F.count("*").alias("n")))
    return (chunks.groupBy(item)
                  .agg(F.array_join(F.transform(F.array_sort(F.collect_list(
                       F.struct(F.col("_ch"), F.col("ct")))), lambda s: s["ct"]), sep).alias("prompt"),
                       F.sum("n").alias("n_turns")))
