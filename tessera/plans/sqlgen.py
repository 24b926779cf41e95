"""SQL text for the DuckDB oracles of the similarity operators.

The oracle recomputes from the raw tables with a plain all-pairs join and a
full window sort: the brute-force definition the Spark tiles must equal.
"""

from __future__ import annotations

from tessera.functions.literals import WORD_RE


def tf_sql(name: str, src: str, key: str, text: str) -> str:
    return f"""{name} AS (
  SELECT k, tok, count(*)::DOUBLE AS tf FROM (
    SELECT {key} AS k, unnest(regexp_extract_all(lower({text}), '{WORD_RE}')) AS tok FROM {src})
  GROUP BY k, tok)"""


def sparse_pairs_sql(q: str, q_key: str, q_text: str, b: str, b_key: str, b_text: str,
                     extra_cols: str = "", where: str = "", join_on: str = "TRUE",
                     p: str = "", sets: bool = False) -> str:
    """CTEs ending in ``{p}pairs(qk, bk, <extra>, sim)``: cosine of word
    counts (``sets``: also ``dot``, ``qn2``, ``bn2`` over distinct words)."""
    tf = tf_sql
    qtok, btok = tf(f"{p}qtok", q, q_key, q_text), tf(f"{p}btok", b, b_key, b_text)
    if sets:
        qtok = qtok.replace("count(*)::DOUBLE AS tf", "1.0::DOUBLE AS tf")
        btok = btok.replace("count(*)::DOUBLE AS tf", "1.0::DOUBLE AS tf")
    return f""",
{qtok},
{btok},
{p}qn AS (SELECT k, sqrt(sum(tf * tf)) AS n, sum(tf * tf) AS n2 FROM {p}qtok GROUP BY k),
{p}bn AS (SELECT k, sqrt(sum(tf * tf)) AS n, sum(tf * tf) AS n2 FROM {p}btok GROUP BY k),
{p}dots AS (SELECT q.k AS qk, b.k AS bk, sum(q.tf * b.tf) AS dot
         FROM {p}qtok q JOIN {p}btok b ON q.tok = b.tok GROUP BY q.k, b.k),
{p}pairs AS (
  SELECT qq.{q_key} AS qk, bb.{b_key} AS bk{extra_cols},
         CASE WHEN qn.n > 0 AND bn.n > 0 THEN coalesce(d.dot, 0) / (qn.n * bn.n) ELSE 0 END AS sim,
         coalesce(d.dot, 0) AS dot, coalesce(qn.n2, 0) AS qn2, coalesce(bn.n2, 0) AS bn2
  FROM {q} qq JOIN {b} bb ON {join_on}
  LEFT JOIN {p}qn qn ON qn.k = qq.{q_key} LEFT JOIN {p}bn bn ON bn.k = bb.{b_key}
  LEFT JOIN {p}dots d ON d.qk = qq.{q_key} AND d.bk = bb.{b_key}
  {('WHERE ' + where) if where else ''})"""


def dense_pairs_sql(q: str, q_key: str, q_vec: str, b: str, b_key: str, b_vec: str,
                    extra_cols: str = "", where: str = "") -> str:
    return f""",
pairs AS (
  SELECT qq.{q_key} AS qk, bb.{b_key} AS bk{extra_cols},
         coalesce(list_cosine_similarity(CAST({q_vec} AS DOUBLE[]), CAST({b_vec} AS DOUBLE[])), 0) AS sim
  FROM {q} qq, {b} bb {('WHERE ' + where) if where else ''})"""


def topk_select(q_key: str, b_key: str, k: int, tie_cols: list[str] | None = None,
                sim_expr: str = "sim", src: str = "pairs") -> str:
    ties = list(tie_cols or [])
    order = ", ".join([f"round({sim_expr}, 6) DESC"] + ties + ["bk"])
    tie_sel = "".join(f", {t}" for t in ties)
    return f"""
SELECT qk AS {q_key}, bk AS {b_key}{tie_sel}, CAST(rank AS BIGINT) AS rank, round({sim_expr}, 6) AS sim
FROM (SELECT *, {sim_expr} AS _s, row_number() OVER (PARTITION BY qk ORDER BY {order}) AS rank FROM {src})
WHERE rank <= {k}"""
