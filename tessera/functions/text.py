"""Column expressions for text and code normalisation.

Every function takes and returns a ``Column`` and is built from Spark
built-ins, so it stays inside whole-stage codegen (higher-order functions
such as ``filter``/``transform`` are interpreted but still JVM-side).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.literals import (
    BUDGET_MARKER,
    CODE_NEWLINE,
    MASK,
    NA_TOKENS,
    NUM_RE,
    SPECIAL_NUM_RE,
    TOKEN_RE,
    TRIM_RE,
    NON_WORD_RE,
    WORD_RUN_RE,
)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``: also removes no-break and other Unicode spaces."""
    return F.regexp_replace(_c(c), TRIM_RE, "")


def casefold(c) -> Column:
    """Lower-case, as the example bank's questions are compared."""
    return F.lower(_c(c))


def decode_code_newlines(c) -> Column:
    """Stored code escapes newlines as ``@@@``."""
    return F.replace(_c(c), F.lit(CODE_NEWLINE), F.lit("\n"))


def mask_literals(c) -> Column:
    """Replace every closed single-quoted literal by ``'MASK'``.

    Splitting on the quote puts literal bodies at odd positions; keeping the
    even pieces and joining them with the mask reproduces a left-to-right
    scan, and an unclosed quote drops the rest of the string (its body is the
    last, odd piece). Double quotes are untouched.
    """
    parts = F.split(_c(c), "'", -1)
    return F.array_join(F.filter(parts, lambda x, i: i % 2 == 0), MASK)


def words(c, lower: bool = True) -> Column:
    """Word tokens of two or more letters, digits or underscores.

    Same tokens as extracting every ``WORD_RE`` match (maximal runs of word
    characters, runs of one character skipped), computed by one split on the
    complement class, which the JVM runs faster.
    """
    src = F.lower(_c(c)) if lower else _c(c)
    return F.filter(F.split(src, NON_WORD_RE, -1), lambda x: F.length(x) >= 2)


def min_ngram(c, n: int = 1) -> Column:
    """Alphabetically first n-gram of the lower-cased words (null if none).

    A vectoriser fitted on one sentence sorts its vocabulary, so index 0 is
    the smallest n-gram.
    """
    w = words(c)
    if n == 1:
        return F.array_min(w)
    grams = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))),
        lambda i: F.array_join(F.slice(w, i + 1, n), " "),
    )
    return F.when(F.size(w) >= n, F.array_min(grams))


def budget_tokens(c) -> Column:
    """Budget tokens: a word or one symbol, each with its leading spaces."""
    return F.regexp_extract_all(_c(c), F.lit(TOKEN_RE), 0)


def token_count(c) -> Column:
    """Number of budget tokens without building the token array: every word
    run becomes one character, whitespace is dropped, each remaining
    character is one token."""
    w = F.regexp_replace(_c(c), WORD_RUN_RE, "w")
    return F.length(F.regexp_replace(w, r"\s+", ""))


def token_budget(c, budget: int, marker: str = BUDGET_MARKER, prefix_chars: int = 16) -> Column:
    """Keep the first ``budget`` tokens and append the marker when cut.

    Only a prefix of ``prefix_chars * budget`` characters is tokenised: when
    it holds more than ``budget`` tokens, its first ``budget`` tokens are
    those of the whole text (a token cut at the prefix end comes later).
    Otherwise the whole text is tokenised. Same result either way; a long
    text never materialises all its tokens.
    """
    col = _c(c)
    pre = budget_tokens(F.substring(col, 1, prefix_chars * budget))
    cut = lambda toks: F.concat(F.array_join(F.slice(toks, 1, budget), ""), F.lit(marker))
    return (F.when(token_count(col) <= budget, col)
             .when(F.size(pre) > budget, cut(pre))
             .otherwise(cut(budget_tokens(col))))


def table_file(c) -> Column:
    """``a/b/c.csv`` -> ``a/b/c.table`` (text before the first dot)."""
    return F.concat(F.substring_index(_c(c), ".", 1), F.lit(".table"))


def csv_path(c) -> Column:
    """``x/<dir>/<file>`` -> ``csv/<dir>/<file without "_table">``."""
    col = _c(c)
    return F.concat(
        F.lit("csv/"),
        F.split_part(col, F.lit("/"), F.lit(2)),
        F.lit("/"),
        F.replace(F.split_part(col, F.lit("/"), F.lit(3)), F.lit("_table"), F.lit("")),
    )


def numeric_value(c) -> Column:
    """A cell's number after removing commas, or null when not numeric.

    Gated by a regex: Spark's cast accepts ``1d``/``2f`` suffixes, Python's
    ``float`` does not. ``inf``/``infinity``/``nan`` words (any case, signed)
    parse as in Python: to +-infinity and NaN.
    """
    nc = F.replace(_c(c), F.lit(","), F.lit(""))
    return F.when(nc.rlike(NUM_RE) | nc.rlike(SPECIAL_NUM_RE), nc.try_cast("double"))


def na_to_null(c, tokens=NA_TOKENS) -> Column:
    """Missing-value tokens become null."""
    col = _c(c)
    return F.when(~col.isin(list(tokens)), col)
