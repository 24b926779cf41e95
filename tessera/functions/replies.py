"""Column expressions that turn a model reply into runnable code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.literals import (
    ACTION_MARK,
    FENCE_CLOSE,
    FENCE_OPEN,
    OBSERVATION_MARK,
    OUTPUT_WORD,
)
from tessera.functions.text import py_strip


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def action_input(c, on_missing: str = "keep", trailing_space: bool = False) -> Column:
    """Text between the first ``Action Input:`` and the next ``Observation:``.

    ``on_missing="keep"`` returns the whole reply (stripped) when the marker is
    absent; ``"null"`` returns null so the caller can log an error row.
    ``trailing_space`` requires a space after each marker (the bank builder's
    stricter form).
    """
    col = _c(c)
    act = ACTION_MARK + (" " if trailing_space else "")
    obs = OBSERVATION_MARK + (" " if trailing_space else "")
    after = F.split_part(col, F.lit(act), F.lit(2))
    code = py_strip(F.split_part(after, F.lit(obs), F.lit(1)))
    found = F.contains(col, F.lit(act))
    if on_missing == "keep":
        return F.when(found, code).otherwise(py_strip(col))
    return F.when(found, code)


def strip_fence(c) -> Column:
    """Remove a Markdown python fence, only when one is present."""
    col = _c(c)
    return F.when(
        F.contains(col, F.lit(FENCE_OPEN)),
        F.replace(F.replace(col, F.lit(FENCE_OPEN), F.lit("")), F.lit(FENCE_CLOSE), F.lit("")),
    ).otherwise(col)


def code_lines(c) -> Column:
    """Stripped code split into lines, lines mentioning ``Output`` removed.

    The source deletes while enumerating and so keeps a line that directly
    follows a deleted one; we drop every such line (documented fix).
    """
    lines = F.split(py_strip(_c(c)), "\n", -1)
    return F.filter(lines, lambda l: ~F.contains(l, F.lit(OUTPUT_WORD)))


def drop_output_lines(c) -> Column:
    return F.array_join(code_lines(c), "\n")


def program_shape(c) -> Column:
    """``struct(shape, result_expr)`` of a code snippet.

    ``block``: several lines, the last one is the result expression;
    ``assign``: one line with `` = ``, the name before it is the result;
    ``expr``: the single line is the expression.
    """
    col = _c(c)
    lines = code_lines(col)
    n = F.size(lines)
    shape = (
        F.when(n > 1, F.lit("block"))
        .when(F.contains(col, F.lit(" = ")), F.lit("assign"))
        .otherwise(F.lit("expr"))
    )
    expr = (
        F.when(n > 1, F.element_at(lines, -1))
        .when(F.contains(col, F.lit(" = ")), F.split_part(col, F.lit(" = "), F.lit(1)))
        .otherwise(py_strip(col))
    )
    return F.struct(shape.alias("shape"), expr.alias("result_expr"))
