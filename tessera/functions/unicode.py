"""Unicode NFKD normalisation.

Spark 4.1 has no NFKD built-in, so this is the one Python function of the
library: an Arrow UDF over ``pyarrow.compute.utf8_normalize`` (vectorised per
Arrow batch, no per-row Python). Apply it once at ingest, never per query.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.literals import NON_ASCII_RE


def _nfkd_batch(s: pa.Array) -> pa.Array:
    return pc.utf8_normalize(s, form="NFKD")


_nfkd_udf = None


def nfkd(c) -> Column:
    """NFKD of a string column (nulls stay null)."""
    global _nfkd_udf
    if _nfkd_udf is None:
        _nfkd_udf = F.arrow_udf(_nfkd_batch, "string")
    col = F.col(c) if isinstance(c, str) else c
    return _nfkd_udf(col)


def nfkd_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """NFKD every listed string column.

    ASCII-only values are unchanged by NFKD; they cross into Python as nulls,
    so the input is read once and only non-ASCII text is copied.
    """
    if not cols:
        return df
    from tessera.session import ship_package
    ship_package(df.sparkSession)
    for c in cols:
        df = df.withColumn(c, F.coalesce(nfkd(F.when(F.col(c).rlike(NON_ASCII_RE), F.col(c))), F.col(c)))
    return df
