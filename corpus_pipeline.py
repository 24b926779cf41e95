"""Training-data pipeline: quality, near duplicates, contamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``. All but the last return
the columns of ``documents``.

Defined cases of every stage: an empty table gives no rows; a null or empty text
has no tokens, no copies, no passages and no secrets, so it stays unless the
classifier rejects it, and has no ids at the end; rows without an id stay; rows
that repeat an id are judged by their own text, and of equal ones the near-
duplicate stage keeps one; very long texts are read whole; extra columns, whatever
their names, go through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, near_dup, pieces, quality, secrets
from tessera.llm.common import read, write_stage
from tessera.llm.queries import piece_model
from tessera.session import ensure_checkpoint_dir, ship_package


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose grade is likely good; the others go."""
    ship_package(spark)
    return quality.keep(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ship_package(spark)
    return near_dup.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    ship_package(spark)
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secret values masked."""
    ship_package(spark)
    return secrets.redact(docs, letters=secrets.letter_costs(docs))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document: count, digest of the ids, digest of the decoded text."""
    ship_package(spark)
    return pieces.encode_decode(docs, piece_model())


STAGES = [
    ("quality classifier", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secret scan", secret_stage),
    ("sentencepiece", token_stage),
]

#: The first stage is a learned model, which SQL can't express; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    ensure_checkpoint_dir(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_stage(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
