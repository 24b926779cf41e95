"""Readers and writers of question sets, example banks, prompts and logs.

Every reader takes an explicit schema (no inference pass over the data).
Question sets are written one record per line, so they split per block. A JSON
array file is cut at the bounds of its records and splits per block as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.splits import json_records, read_pieces

QUESTION_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("utterance", T.StringType()),
    T.StructField("context", T.StringType()),
    T.StructField("targetValue", T.StringType()),
])

BANK_SCHEMA = T.StructType([
    T.StructField("table_id", T.StringType()),
    T.StructField("code", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("prompt", T.StringType()),
    T.StructField("answer", T.StringType()),
    T.StructField("prediction", T.StringType()),
    T.StructField("correct", T.IntegerType()),
    T.StructField("reply", T.StringType()),
    T.StructField("seq", T.LongType()),
])

RESULT_SCHEMA = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("prediction", T.StringType()),
])


def read_questions_tsv(spark: SparkSession, path: str, schema: T.StructType = QUESTION_SCHEMA) -> DataFrame:
    """Tab-separated question set with a header line, as written below: a record
    is a line (``\\n``, ``\\t``, ``\\r`` and ``\\\\`` are escapes), so large files split."""
    raw = (spark.read.schema(schema).option("sep", "\t").option("header", True)
           .option("quote", '"').option("escape", '"').csv(path))
    return raw.select(*[_unescape(c).alias(c) for c in raw.columns])


def read_quoted_tsv(spark: SparkSession, path: str, schema: T.StructType = QUESTION_SCHEMA) -> DataFrame:
    """A foreign file whose quoted fields hold line ends: records span lines, so
    each file is one task."""
    return (spark.read.schema(schema).option("sep", "\t").option("header", True)
            .option("multiLine", True).option("quote", '"').option("escape", '"').csv(path))


_ESCAPES = (("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r"))


def _escape(c: str) -> F.Column:
    out = F.replace(F.col(c), F.lit("\\"), F.lit("\\\\"))
    for char, mark in _ESCAPES:
        out = F.replace(out, F.lit(char), F.lit(mark))
    return out


def _unescape(c: str) -> F.Column:
    def plain(part):
        for char, mark in _ESCAPES:
            part = F.replace(part, F.lit(mark), F.lit(char))
        return part

    return F.array_join(F.transform(F.split(F.col(c), r"\\\\", -1), plain), "\\")


def write_questions_tsv(df: DataFrame, path: str) -> None:
    """One record per line; line ends, tabs and backslashes are escaped."""
    (df.select(*[_escape(c).alias(c) for c in df.columns]).write.mode("overwrite").option("sep", "\t").option("header", True)
       .option("quote", '"').option("escape", '"').csv(path))


def read_bank_json(spark: SparkSession, path: str, schema: T.StructType = BANK_SCHEMA,
                   array_file: bool = False) -> DataFrame:
    """Example bank: JSON lines, or (``array_file``) files of JSON arrays.
    Answers and predictions are read as strings, never inferred."""
    if array_file:
        records = json_records(read_pieces(spark, path, "}"))
        return records.select(F.from_json("json", schema).alias("r")).select("r.*")
    return spark.read.schema(schema).json(path)


def read_results_jsonl(spark: SparkSession, path: str, schema: T.StructType = RESULT_SCHEMA) -> DataFrame:
    """Execution log: one ``{key, prediction}`` object per line."""
    return spark.read.schema(schema).json(path)


def write_json_records(df: DataFrame, path: str) -> None:
    """Prompt/result records as JSON lines, keys in alphabetical order."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def write_exec_log(df: DataFrame, path: str) -> None:
    """The whole execution log in one job (replaces any previous log)."""
    df.write.mode("overwrite").json(path)
