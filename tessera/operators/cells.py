"""Normalisation of the long cell table ``cells(table_id, row_idx, col_idx,
col_name, value)`` -- one DataFrame holds every table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.literals import NA_TOKENS
from tessera.functions.text import na_to_null, numeric_value, py_strip
from tessera.functions.unicode import nfkd_columns


def header_clean(headers: DataFrame) -> DataFrame:
    """Strip header names and number duplicates ``X, X.1, X.2`` in column
    order, as a CSV reader does. ``headers(table_id, col_idx, col_name)``.

    Duplicates are numbered by the skew-safe running count keyed by
    (table, stripped name), so even a header with millions of equal names is
    spread over tasks.
    """
    from tessera.operators.sequence import positions

    h = headers.withColumn("_n", py_strip("col_name"))
    h = h.withColumn("_k", F.concat_ws("\u0001", F.col("table_id").cast("string"), F.col("_n")))
    h = positions(h, "_k", ["col_idx"], "_pos")
    dup = F.col("_pos") - 1
    return h.select("table_id", "col_idx",
                    F.when(dup > 0, F.concat(F.col("_n"), F.lit("."), dup.cast("string")))
                     .otherwise(F.col("_n")).alias("col_name"))


def cell_trim(cells: DataFrame, col: str = "value") -> DataFrame:
    """Strip every cell like Python's ``str.strip`` (Unicode spaces too)."""
    return cells.withColumn(col, py_strip(col))


def na_tokens(cells: DataFrame, col: str = "value", tokens=NA_TOKENS) -> DataFrame:
    """Missing-value tokens -> null."""
    return cells.withColumn(col, na_to_null(col, tokens))


def numeric_coerce(cells: DataFrame, col: str = "value") -> DataFrame:
    """Add ``num``: the cell as a number (commas removed) or null."""
    return cells.withColumn("num", numeric_value(col))


def nfkd_cells(cells: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Unicode NFKD of the text columns (once, at ingest)."""
    return nfkd_columns(cells, cols or ["value", "col_name"])


def column_kind(cells: DataFrame) -> DataFrame:
    """Implied type per column after coercion: ``int``, ``float`` or ``object``.

    ``object`` when a non-missing cell is not numeric; ``float`` when a value
    has a fraction, is NaN, or a column has missing cells (NaN makes a float
    column); ``int`` otherwise. Partial aggregation keeps a wide table cheap.
    """
    c = cells if "num" in cells.columns else numeric_coerce(cells)
    agg = c.groupBy("table_id", "col_idx").agg(
        F.count_if(F.col("num").isNull() & F.col("value").isNotNull()).alias("n_text"),
        F.count_if(F.col("value").isNull()).alias("n_missing"),
        F.count_if((F.col("num") != F.floor(F.col("num"))) | F.isnan(F.col("num"))).alias("n_frac"),
        F.count("*").alias("n_cells"))
    kind = (F.when(F.col("n_text") > 0, F.lit("object"))
             .when((F.col("n_frac") > 0) | (F.col("n_missing") > 0), F.lit("float"))
             .otherwise(F.lit("int")))
    return agg.select("table_id", "col_idx", kind.alias("kind"), "n_cells")


def ingest(raw: DataFrame, nfkd: bool = True) -> DataFrame:
    """``raw(table_id, raw)`` pipe texts -> clean cells with ``num``.

    Parse, number duplicate headers, missing tokens to null, strip, NFKD,
    numeric value: what every strategy reads its tables through.
    """
    from tessera.sources.tables import parse_pipe_tables

    cells = parse_pipe_tables(raw)
    heads = header_clean(cells.filter(F.col("col_name").isNotNull())
                         .groupBy("table_id", "col_idx").agg(F.min("col_name").alias("col_name")))
    named = cells.drop("col_name").join(heads, ["table_id", "col_idx"], "left")
    return normalise(named.select("table_id", "row_idx", "col_idx", "col_name", "value"), nfkd)


def normalise(cells: DataFrame, nfkd: bool = True) -> DataFrame:
    """The ingest chain after parsing: missing tokens, strip, NFKD, numeric value."""
    c = na_tokens(cells)
    c = cell_trim(c)
    if nfkd:
        c = nfkd_cells(c)
    return numeric_coerce(c)
