"""Building the bank of solved examples, and the second pass over what stays unsolved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.literals import CODE_NEWLINE
from tessera.functions.replies import action_input, drop_output_lines, strip_fence
from tessera.operators.evaluate import outcome_label
from tessera.operators.prompts import post_answer_prompt


def bank_records(questions: DataFrame, replies: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """``questions(key, table_id, question, prompt, answer)``, ``replies(key,
    reply)`` and ``results(key, prediction)`` -> one bank record per question.

    The code is what stands between the reply's markers (both with their
    trailing space), without a fence and without lines that mention the output;
    a reply without markers has no code. ``correct`` is 1, 0 or -1. A question
    without a reply or a result stays, with nulls.
    """
    code = drop_output_lines(strip_fence(action_input("reply", on_missing="null", trailing_space=True)))
    j = questions.join(replies, key, "left").join(results, key, "left")
    return j.select(key, "table_id", F.replace(code, F.lit("\n"), F.lit(CODE_NEWLINE)).alias("code"), "question", "prompt",
                    "answer", "prediction", outcome_label("answer", "prediction").alias("correct"), "reply")


def second_pass(records: DataFrame, tables: DataFrame, key: str) -> DataFrame:
    """A short-answer prompt for every record that isn't right yet: ``key, prompt``.

    ``tables(table_id, text)``; code and result of the first pass are shown.
    """
    open_ = records.filter(F.col("correct") != 1).drop("prompt")
    t = tables.select("table_id", F.col("text").alias("table_text"))
    j = open_.join(t, "table_id", "left").withColumn("code", F.replace("code", F.lit(CODE_NEWLINE), F.lit("\n")))
    return post_answer_prompt(j, key, code="code", result="prediction")
