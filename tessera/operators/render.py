"""Table serialisation: keyed cells -> one pipe-text per table.

Text form (ours, fixed): `` | h1 | h2 | \\n | a | b | `` -- header and rows
joined by ROWSEP, a missing cell printed as ``nan``. The reference renders
through a Markdown formatter and splits on pipes, which corrupts rows holding
an empty cell or a pipe; we render from structured cells so that cannot
happen, and print numbers in Spark's string form.

Ordered string aggregation is done in two levels (rows -> chunks of
``chunk_rows`` rows -> table), so a very large table is pre-aggregated in
parallel before its final concatenation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.literals import ROWSEP, TABLE_BUDGET
from tessera.functions.text import token_budget

CELL_SEP = " | "
ROW_JOIN = " " + ROWSEP + " "     # " | \n | "
MISSING = "nan"
CHUNK_ROWS = 256


def _sorted_texts(idx: str, text: str) -> Column:
    """Texts of the group ordered by ``idx``."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(idx), F.col(text)))),
                       lambda s: s[text])


def rows_from_cells(cells: DataFrame) -> DataFrame:
    """``cells(table_id,row_idx,col_idx,col_name,value)`` -> row texts.

    Returns ``table_id, row_idx, row_text, header_text``; ``value`` is the
    printed cell (``nan`` when null).
    """
    c = cells.select(
        "table_id", "row_idx", "col_idx",
        F.coalesce(F.col("value"), F.lit(MISSING)).alias("v"),
        F.coalesce(F.col("col_name"), F.lit(MISSING)).alias("h"),
    )
    return (c.groupBy("table_id", "row_idx")
             .agg(F.array_sort(F.collect_list(F.struct("col_idx", "v", "h"))).alias("cs"))
             .select("table_id", "row_idx",
                     F.array_join(F.transform("cs", lambda s: s["v"]), CELL_SEP).alias("row_text"),
                     F.array_join(F.transform("cs", lambda s: s["h"]), CELL_SEP).alias("header_text")))


def rows_from_frame(df: DataFrame, table_col: str, row_col: str, cols: list[str]) -> DataFrame:
    """A wide frame whose rows are table rows -> row texts, no shuffle."""
    v = [F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in cols]
    return df.select(
        F.col(table_col).alias("table_id"), F.col(row_col).alias("row_idx"),
        F.concat_ws(CELL_SEP, *v).alias("row_text"),
        F.lit(CELL_SEP.join(cols)).alias("header_text"),
    )


def render_rows(rows: DataFrame, max_rows: int | None = None,
                chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Row texts -> ``table_id, n_rows, text``.

    ``max_rows`` keeps the first data rows by their rank within the table
    (``row_idx`` may have gaps or start anywhere); the limit is pushed below
    the shuffle. ``n_rows`` counts the rows rendered.
    """
    r = rows if max_rows is None else first_rows(rows, max_rows)
    chunks = (r.groupBy("table_id", F.floor(F.col("row_idx") / chunk_rows).alias("chunk"))
               .agg(F.array_join(_sorted_texts("row_idx", "row_text"), ROW_JOIN).alias("ctext"),
                    F.min_by("header_text", "row_idx").alias("header_text"),
                    F.count("*").alias("n")))
    return (chunks.groupBy("table_id")
                  .agg(F.array_join(_sorted_texts("chunk", "ctext"), ROW_JOIN).alias("body"),
                       F.min_by("header_text", "chunk").alias("header_text"),
                       F.sum("n").alias("n_rows"))
                  .select("table_id", "n_rows",
                          F.concat(F.lit(" | "), F.col("header_text"),
                                   F.lit(ROW_JOIN), F.col("body"), F.lit(" | ")).alias("text")))


def first_rows(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of each table by rank (ties by text)."""
    w = Window.partitionBy("table_id").orderBy("row_idx", "row_text")
    return rows.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def render_cells(cells: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Cell table -> ``table_id, n_rows, text`` (header + data rows)."""
    return render_rows(rows_from_cells(cells), max_rows=max_rows)


def render_head(rows: DataFrame, n_text_rows: int) -> DataFrame:
    """First ``n_text_rows`` text rows, header included (so n-1 data rows)."""
    return render_rows(rows, max_rows=n_text_rows - 1)


def render_heads(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """Heads of several sizes at once: ``table_id, n_text_rows, n_rows, text``.

    The rows of the largest head are gathered once; the others are its prefixes.
    """
    top = first_rows(rows, max(sizes) - 1).groupBy("table_id").agg(
        F.array_sort(F.collect_list(F.struct("row_idx", "row_text"))).alias("rows"),
        F.min_by("header_text", "row_idx").alias("header_text"))
    one = top.withColumn("n_text_rows", F.explode(F.array(*[F.lit(n) for n in sizes])))
    own = F.slice("rows", F.lit(1), F.col("n_text_rows") - 1)
    return one.select("table_id", "n_text_rows", F.size(own).cast("long").alias("n_rows"),
                      F.concat(F.lit(" | "), F.col("header_text"), F.lit(ROW_JOIN),
                               F.array_join(F.transform(own, lambda r: r["row_text"]), ROW_JOIN),
                               F.lit(" | ")).alias("text"))


def budgeted_tables(rows: DataFrame, budget: int = TABLE_BUDGET) -> DataFrame:
    """Table text cut to ``budget`` tokens, marker appended when cut.

    Every rendered row holds at least one token (a pipe), so rows of a rank
    above ``budget`` can never reach the first ``budget`` tokens; they are
    dropped before the collect, which bounds every group -- the result is
    identical to rendering the whole table and then cutting it.
    """
    t = render_rows(rows, max_rows=budget)
    return t.select("table_id", "n_rows", token_budget("text", budget).alias("text"))


def join_question_table(questions: DataFrame, tables: DataFrame,
                        table_col: str = "table_id") -> DataFrame:
    """Attach each question's table text (left join: missing tables -> null).

    Each table is rendered once, however many questions use it.
    """
    t = tables.select(F.col("table_id").alias(table_col), F.col("text").alias("table_text"))
    return questions.join(t, table_col, "left")
