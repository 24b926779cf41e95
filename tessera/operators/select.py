"""Filters, reproducible sampling and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import write_stage

from tessera.functions.literals import BANK_FIRST_N, SAMPLE_N


def correct_bank(bank: DataFrame, col: str = "correct") -> DataFrame:
    """Keep solved examples marked correct (pushed to the scan)."""
    return bank.filter(F.col(col).isin(1))


def sample_key(key: str, seed: int) -> F.Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def sample_n(df: DataFrame, key: str, n: int = SAMPLE_N, seed: int = 123) -> DataFrame:
    """A reproducible pseudo-random sample of ``n`` rows: order by a keyed
    hash and take ``n`` (planned as a top-n per partition, then a merge of
    n rows per partition -- never a global sort)."""
    return df.orderBy(sample_key(key, seed), F.col(key)).limit(n)


def first_n(df: DataFrame, seq: str, n: int = BANK_FIRST_N) -> DataFrame:
    """The first ``n`` rows by an explicit order (top-n, no global sort)."""
    return df.orderBy(F.col(seq)).limit(n)


FEW_KEYS = 1 << 18  # counted keys that are sent to every executor


def with_keys(rows: DataFrame, keys: DataFrame, cols: list[str]) -> DataFrame:
    """Rows whose ``cols`` are among ``keys``; few keys are sent to the rows, so that no other row is shuffled."""
    keys = write_stage(keys.select(*cols).distinct(), "wanted")
    return rows.join(F.broadcast(keys) if keys.count() <= FEW_KEYS else keys, cols, "left_semi")
