"""Registered queries: one Spark plan and one DuckDB oracle per operator key.

Keys follow the operator inventory. Every query reads the provided tables
whole; fixture parameters (k, thresholds, budgets) are set once here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as TX
from tessera.functions.literals import TRIM_RE, WORD_RE
from tessera.operators import render as R
from tessera.operators import similarity as S
from tessera.operators import vector_cells
from tessera.plans import roles, strategies
from tessera.plans import sqlgen as G

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

K_NL = 2          # few-shot examples in the fixtures (reference default is 1)
TABLE_BUDGET_TOKENS = 3500  # the reference's table budget
K_VEC = 3
VEC_THRESHOLD = 0.3   # two-signal gate on random vectors (reference constant 0.9)
PAIR_THRESHOLD = 0.4  # similarity join on the embeddings


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return deco


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes)


# ====================================================================== 2.3 render

@register("tbl_render", _with(roles.NATION_CELLS_SQL) + """
SELECT table_id, count(*) AS n_rows,
       ' | ' || max(header_text) || ' | ' || chr(10) || ' | ' ||
       string_agg(row_text, ' | ' || chr(10) || ' | ' ORDER BY row_idx) || ' | ' AS text
FROM (SELECT table_id, row_idx,
             string_agg(coalesce(value, 'nan'), ' | ' ORDER BY col_idx) AS row_text,
             string_agg(col_name, ' | ' ORDER BY col_idx) AS header_text
      FROM cells GROUP BY table_id, row_idx)
GROUP BY table_id""")
def q_tbl_render(spark, d):
    return R.render_cells(roles.nation_cells(spark, d))


@register("tbl_render_head", _with(roles.ORDERS_CELLS_SQL) + """,
rows AS (SELECT table_id, row_idx,
                string_agg(coalesce(value, 'nan'), ' | ' ORDER BY col_idx) AS row_text,
                string_agg(col_name, ' | ' ORDER BY col_idx) AS header_text
         FROM cells GROUP BY table_id, row_idx),
h AS (SELECT 2 AS n UNION ALL SELECT 6)
SELECT table_id, n AS n_text_rows, count(*) AS n_rows,
       ' | ' || max(header_text) || ' | ' || chr(10) || ' | ' ||
       string_agg(row_text, ' | ' || chr(10) || ' | ' ORDER BY row_idx) || ' | ' AS text
FROM rows JOIN h ON rows.row_idx < h.n - 1  -- a rank: numbered by row_number()
GROUP BY table_id, n""")
def q_tbl_render_head(spark, d):
    rows = R.rows_from_cells(roles.orders_cells(spark, d, numbered=False))
    return R.render_heads(rows, [2, 6])


@register("txt_token_budget", """
WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '\\s*(?:[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s])') AS toks
           FROM documents)
SELECT doc_id, len(toks) AS n_tokens,
       CASE WHEN len(toks) > 3500 THEN array_to_string(toks[1:3500], '') || chr(10) || '*syncopation*' || chr(10)
            ELSE text END AS text
FROM d""")
def q_txt_token_budget(spark, d):
    docs = roles.table(spark, d, "documents")
    return docs.select("doc_id", TX.token_count("text").cast("long").alias("n_tokens"),
                       TX.token_budget("text", TABLE_BUDGET_TOKENS).alias("text"))


# ====================================================================== 2.4 retrieval

@register("bank_dedup_last", """
SELECT lower(text) AS nl, max(doc_id) AS doc_id, min(doc_id) AS first_doc_id, count(*) AS n_dup
FROM documents GROUP BY lower(text)""")
def q_bank_dedup_last(spark, d):
    b = S.bank_dedup_last(roles.doc_bank(spark, d), "question", ["doc_id"])
    return b.select("nl", "doc_id", "first_doc_id", "n_dup")


@register("txt_sparse_topk", _with(roles.QUESTIONS_SQL, roles.BANK_SQL, roles.DBANK_SQL)
          + G.sparse_pairs_sql("questions", "qid", "question", "dbank", "bid", "nl",
                               extra_cols=", bb.first_conv_id, bb.first_turn")
          + G.topk_select("qid", "bid", K_NL, ["first_conv_id", "first_turn"]))
def q_txt_sparse_topk(spark, d):
    return strategies.nl_topk(spark, d, K_NL)


def _emb(spark, d, name):
    return roles.table(spark, d, "embeddings").select(F.col("vec_id").alias(name), "embedding")


VEC_TOPK_SQL = ("""WITH e AS (SELECT vec_id, embedding FROM embeddings)"""
                + G.dense_pairs_sql("e", "vec_id", "qq.embedding", "e", "vec_id", "bb.embedding",
                                    where="qq.vec_id <> bb.vec_id")
                + G.topk_select("q_vec", "b_vec", K_VEC))


@register("vec_topk", VEC_TOPK_SQL)
def q_vec_topk(spark, d):
    return S.vector_topk(_emb(spark, d, "q_vec"), _emb(spark, d, "b_vec"), q_key="q_vec",
                         b_key="b_vec", q_vec="embedding", b_vec="embedding", k=K_VEC,
                         include_self=False)


@register("vec_topk_cells", VEC_TOPK_SQL)
def q_vec_topk_cells(spark, d):
    return vector_cells.exact_topk(_emb(spark, d, "q_vec"), _emb(spark, d, "b_vec"), q_key="q_vec", b_key="b_vec",
                                   q_vec="embedding", b_vec="embedding", k=K_VEC, include_self=False)


@register("vec_topk_probed")
def q_vec_topk_probed(spark, d):
    q = _emb(spark, d, "q_vec").filter(F.col("q_vec") % 100 == 0)  # the search's query set, against all rows
    return vector_cells.probed_topk(q, _emb(spark, d, "b_vec"), q_key="q_vec", b_key="b_vec", q_vec="embedding",
                                    b_vec="embedding", k=K_VEC, include_self=False)


@register("vec_topk_self", """WITH e AS (SELECT vec_id, embedding FROM embeddings)"""
          + G.dense_pairs_sql("e", "vec_id", "qq.embedding", "e", "vec_id", "bb.embedding")
          + G.topk_select("q_vec", "b_vec", K_VEC))
def q_vec_topk_self(spark, d):
    return S.vector_topk(_emb(spark, d, "q_vec"), _emb(spark, d, "b_vec"), q_key="q_vec",
                         b_key="b_vec", q_vec="embedding", b_vec="embedding", k=K_VEC,
                         include_self=True)


@register("vec_cosine_pairs", """WITH e AS (SELECT vec_id, embedding FROM embeddings)"""
          + G.dense_pairs_sql("e", "vec_id", "qq.embedding", "e", "vec_id", "bb.embedding")
          + f"""
SELECT qk AS q_vec, bk AS b_vec, round(sim, 6) AS sim FROM pairs WHERE round(sim, 6) >= {PAIR_THRESHOLD}""")
def q_vec_cosine_pairs(spark, d):
    return S.vector_pairs_above(_emb(spark, d, "q_vec"), _emb(spark, d, "b_vec"), q_key="q_vec",
                                b_key="b_vec", q_vec="embedding", b_vec="embedding",
                                threshold=PAIR_THRESHOLD)


@register("vec_cosine_pairs_cells", ORACLES["vec_cosine_pairs"])
def q_vec_cosine_pairs_cells(spark, d):
    return vector_cells.pairs_above(_emb(spark, d, "q_vec"), _emb(spark, d, "b_vec"), q_key="q_vec", b_key="b_vec",
                                    q_vec="embedding", b_vec="embedding", threshold=PAIR_THRESHOLD)


@register("join_question_table", _with(roles.QUESTIONS_SQL, roles.CONV_ROWS_SQL) + """,
t AS (SELECT table_id,
             ' | ' || max(header_text) || ' | ' || chr(10) || ' | ' ||
             string_agg(row_text, ' | ' || chr(10) || ' | ' ORDER BY row_idx) || ' | ' AS table_text
      FROM conv_rows GROUP BY table_id)
SELECT q.qid, q.table_id, t.table_text FROM questions q LEFT JOIN t USING (table_id)""")
def q_join_question_table(spark, d):
    q = roles.questions(spark, d)
    t = R.render_rows(roles.conversation_rows(spark, d))
    return R.join_question_table(q, t).select("qid", "table_id", "table_text")


# ====================================================================== 2.2 normalise

def _headers(spark, d):
    p = roles.table(spark, d, "part")
    return p.select(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("table_id"),
                    F.col("p_partkey").alias("col_idx"),
                    F.concat(F.lit("  "), F.col("p_type"), F.lit(" ")).alias("col_name"))


@register("tbl_header_clean", f"""
WITH h AS (SELECT concat_ws('/', p_brand, CAST(p_size AS VARCHAR)) AS table_id, p_partkey AS col_idx,
                  regexp_replace('  ' || p_type || ' ', '{TRIM_RE}', '', 'g') AS n FROM part)
SELECT table_id, col_idx,
       CASE WHEN row_number() OVER (PARTITION BY table_id, n ORDER BY col_idx) > 1
            THEN n || '.' || CAST(row_number() OVER (PARTITION BY table_id, n ORDER BY col_idx) - 1 AS VARCHAR)
            ELSE n END AS col_name
FROM h""")
def q_tbl_header_clean(spark, d):
    from tessera.operators.cells import header_clean
    return header_clean(_headers(spark, d))


@register("tbl_cell_trim", f"""
SELECT p_partkey, regexp_replace(chr(160) || ' ' || p_name || chr(9) || ' ' || chr(12288), '{TRIM_RE}', '', 'g') AS value
FROM part""")
def q_tbl_cell_trim(spark, d):
    from tessera.operators.cells import cell_trim
    p = roles.table(spark, d, "part").select(
        "p_partkey", F.concat(F.lit("  "), F.col("p_name"), F.lit("\t 　")).alias("value"))
    return cell_trim(p)


@register("txt_nfkd", r"""
SELECT doc_id, strip_accents(text) AS base_text FROM documents""")
def q_txt_nfkd(spark, d):
    from tessera.functions.unicode import nfkd_columns
    docs = roles.table(spark, d, "documents").select("doc_id", "text")
    n = nfkd_columns(docs, ["text"])
    # NFKD then dropping combining marks is what DuckDB's strip_accents computes
    return n.select("doc_id", F.regexp_replace("text", r"\p{Mn}", "").alias("base_text"))


MIXED_SQL = """mixed AS (
  SELECT o_orderkey,
         CASE WHEN o_orderkey % 7 = 0 THEN '1d'
              WHEN o_orderkey % 5 = 0 THEN o_orderstatus
              ELSE format('{:,.2f}', o_totalprice) END AS value
  FROM orders)"""


def _mixed(spark, d):
    o = roles.table(spark, d, "orders")
    v = (F.when(F.col("o_orderkey") % 7 == 0, F.lit("1d"))
          .when(F.col("o_orderkey") % 5 == 0, F.col("o_orderstatus"))
          .otherwise(F.format_number("o_totalprice", 2)))
    return o.select("o_orderkey", v.alias("value"))


@register("tbl_numeric_coerce", "WITH " + MIXED_SQL + r"""
SELECT o_orderkey, value,
       CASE WHEN (regexp_matches(replace(value, ',', ''), '^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$')
                 OR regexp_matches(replace(value, ',', ''), '^\s*[+-]?(?i:inf|infinity|nan)\s*$'))
            THEN TRY_CAST(replace(value, ',', '') AS DOUBLE) END AS num
FROM mixed""")
def q_tbl_numeric_coerce(spark, d):
    from tessera.operators.cells import numeric_coerce
    return numeric_coerce(_mixed(spark, d))


@register("tbl_na_tokens", """
WITH t AS (SELECT p_partkey, CASE WHEN p_size < 4 THEN 'NA' WHEN p_size < 8 THEN ''
                                  WHEN p_size < 10 THEN 'null' WHEN p_size < 12 THEN 'n/a'
                                  ELSE p_name END AS raw FROM part)
SELECT p_partkey, raw, CASE WHEN raw IN ('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN',
  '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')
  THEN NULL ELSE raw END AS value
FROM t""")
def q_tbl_na_tokens(spark, d):
    from tessera.operators.cells import na_tokens
    p = roles.table(spark, d, "part")
    raw = (F.when(F.col("p_size") < 4, F.lit("NA")).when(F.col("p_size") < 8, F.lit(""))
            .when(F.col("p_size") < 10, F.lit("null")).when(F.col("p_size") < 12, F.lit("n/a"))
            .otherwise(F.col("p_name")))
    t = p.select("p_partkey", raw.alias("raw"), raw.alias("value"))
    return na_tokens(t)


@register("tbl_column_kind", _with(roles.ORDERS_CELLS_SQL) + r""",
c AS (SELECT *, CASE WHEN (regexp_matches(replace(value, ',', ''), '^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$')
                 OR regexp_matches(replace(value, ',', ''), '^\s*[+-]?(?i:inf|infinity|nan)\s*$'))
                     THEN TRY_CAST(replace(value, ',', '') AS DOUBLE) END AS num FROM cells)
SELECT table_id, col_idx,
       CASE WHEN count(*) FILTER (WHERE num IS NULL AND value IS NOT NULL) > 0 THEN 'object'
            WHEN count(*) FILTER (WHERE num <> floor(num) OR isnan(num)) > 0 OR count(*) FILTER (WHERE value IS NULL) > 0 THEN 'float'
            ELSE 'int' END AS kind,
       count(*) AS n_cells
FROM c GROUP BY table_id, col_idx""")
def q_tbl_column_kind(spark, d):
    from tessera.operators.cells import column_kind
    return column_kind(roles.orders_cells(spark, d, numbered=False))


@register("code_newline_decode", "WITH " + roles.CODE_SQL + """
SELECT p_partkey, replace(code, '@@@', chr(10)) AS code FROM code""")
def q_code_newline_decode(spark, d):
    return roles.code_strings(spark, d).select("p_partkey", TX.decode_code_newlines("code").alias("code"))


@register("txt_casefold", """
SELECT conv_id, turn, lower(text) AS nl FROM conversations""")
def q_txt_casefold(spark, d):
    c = roles.table(spark, d, "conversations")
    return c.select("conv_id", "turn", TX.casefold("text").alias("nl"))


@register("code_mask_literals", "WITH " + roles.CODE_SQL + """
SELECT p_partkey,
       array_to_string(list_filter(string_split(code, ''''), lambda x, i: i % 2 = 1), '''MASK''') AS masked_code,
       array_to_string(list_filter(string_split(pred, ''''), lambda x, i: i % 2 = 1), '''MASK''') AS masked_pred
FROM code""")
def q_code_mask_literals(spark, d):
    c = roles.code_strings(spark, d)
    return c.select("p_partkey", TX.mask_literals("code").alias("masked_code"),
                    TX.mask_literals("pred").alias("masked_pred"))


@register("txt_min_ngram", f"""
WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '{WORD_RE}') AS w FROM conversations
           WHERE role = 'user')
SELECT conv_id, turn, list_min(w) AS kw1,
       CASE WHEN len(w) >= 2 THEN list_min(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS kw2
FROM w""")
def q_txt_min_ngram(spark, d):
    c = roles.table(spark, d, "conversations").filter(F.col("role") == "user")
    return c.select("conv_id", "turn", TX.min_ngram("text", 1).alias("kw1"),
                    TX.min_ngram("text", 2).alias("kw2"))


@register("key_table_path", """
SELECT page_id, split_part(url, '.', 1) || '.table' AS table_file,
       'csv/' || split_part(url, '/', 2) || '/' || replace(split_part(url, '/', 3), '_table', '') AS csv_path
FROM pages""")
def q_key_table_path(spark, d):
    p = roles.table(spark, d, "pages")
    return p.select("page_id", TX.table_file("url").alias("table_file"),
                    TX.csv_path("url").alias("csv_path"))


# ====================================================================== 2.4 strategies

KW_SQL = f"""kw AS (SELECT qid, list_min(regexp_extract_all(lower(question), '{WORD_RE}')) AS kw FROM questions)"""
HITS_SQL = """hits AS (
  SELECT k.qid, coalesce(sum(CASE WHEN contains(b.nl, k.kw) THEN b.n_dup ELSE 0 END), 0) AS hits
  FROM kw k CROSS JOIN dbank b GROUP BY k.qid)"""


@register("sim_keyword_gate", _with(roles.QUESTIONS_SQL, roles.BANK_SQL, roles.DBANK_SQL)
          + G.sparse_pairs_sql("questions", "qid", "question", "dbank", "bid", "nl",
                               extra_cols=", bb.first_conv_id, bb.first_turn, bb.nl")
          + ",\n" + KW_SQL + ",\n" + HITS_SQL + """,
gp AS (SELECT p.*, CASE WHEN h.hits = 0 OR contains(p.nl, k.kw) THEN p.sim ELSE 0 END AS gsim
       FROM pairs p JOIN hits h ON h.qid = p.qk JOIN kw k ON k.qid = p.qk)"""
          + G.topk_select("qid", "bid", K_NL, ["first_conv_id", "first_turn"], sim_expr="gsim", src="gp"))
def q_sim_keyword_gate(spark, d):
    return S.keyword_gate(roles.questions(spark, d), strategies.dedup_bank(spark, d), q_key="qid", b_key="bid",
                          q_text="question", b_text="nl", k=K_NL, tie_cols=strategies.BANK_TIES)


@register("sim_keyword_stats", _with(roles.QUESTIONS_SQL, roles.BANK_SQL, roles.DBANK_SQL, KW_SQL, HITS_SQL)
          + """
SELECT CAST(sum(hits) AS BIGINT) AS total_hits, avg(hits) AS avg_hits,
       count(*) FILTER (WHERE hits = 0) AS fallbacks FROM hits""")
def q_sim_keyword_stats(spark, d):
    return S.keyword_stats(roles.questions(spark, d), strategies.dedup_bank(spark, d), b_key="bid",
                           q_text="question", b_text="nl", weight_col="n_dup")


@register("sim_code_masked", "WITH " + roles.CODE_SQL + """,
mc AS (SELECT p_partkey,
              array_to_string(list_filter(string_split(replace(code, '@@@', chr(10)), ''''), lambda x, i: i % 2 = 1), '''MASK''') AS mcode,
              array_to_string(list_filter(string_split(pred, ''''), lambda x, i: i % 2 = 1), '''MASK''') AS mpred
       FROM code)"""
          + G.sparse_pairs_sql("mc", "p_partkey", "mpred", "mc", "p_partkey", "mcode")
          + G.topk_select("q_part", "b_part", K_NL))
def q_sim_code_masked(spark, d):
    c = roles.code_strings(spark, d)
    q = c.select(F.col("p_partkey").alias("q_part"), "pred")
    b = c.select(F.col("p_partkey").alias("b_part"), "code")
    return S.code_masked_topk(q, b, q_key="q_part", b_key="b_part", q_code="pred", b_code="code",
                              k=K_NL).select("q_part", "b_part", "rank", "sim")


@register("sim_threshold_rank", f"""
WITH e AS (SELECT vec_id, embedding FROM embeddings),
pairs AS (SELECT q.vec_id AS qk, b.vec_id AS bk,
                 CASE WHEN coalesce(list_cosine_similarity(CAST(q.embedding[1:32] AS DOUBLE[]), CAST(b.embedding[1:32] AS DOUBLE[])), 0) > {VEC_THRESHOLD}
                      THEN coalesce(list_cosine_similarity(CAST(q.embedding[33:64] AS DOUBLE[]), CAST(b.embedding[33:64] AS DOUBLE[])), 0)
                      ELSE 0 END AS sim
          FROM e q, e b WHERE q.vec_id <> b.vec_id)""" + G.topk_select("q_vec", "b_vec", K_VEC))
def q_sim_threshold_rank(spark, d):
    e = roles.table(spark, d, "embeddings")
    halves = e.select("vec_id", F.slice("embedding", 1, 32).alias("gate"),
                      F.slice("embedding", 33, 32).alias("rank_vec"))
    q = halves.withColumnRenamed("vec_id", "q_vec")
    b = halves.withColumnRenamed("vec_id", "b_vec")
    return S.threshold_rank_topk(q, b, q_key="q_vec", b_key="b_vec", q_gate="gate", b_gate="gate",
                                 q_rank="rank_vec", b_rank="rank_vec", k=K_VEC,
                                 threshold=VEC_THRESHOLD, include_self=False)


HEADS_SQL = """heads AS (
  SELECT table_id, ' | ' || max(header_text) || ' | ' || chr(10) || ' | ' ||
         string_agg(row_text, ' | ' || chr(10) || ' | ' ORDER BY row_idx) || ' | ' AS text
  FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY row_idx, row_text) AS rk FROM conv_rows)
  WHERE rk <= 1 GROUP BY table_id)"""


@register("sim_table_then_question",
          _with(roles.QUESTIONS_SQL, roles.BANK_SQL, roles.CONV_ROWS_SQL, HEADS_SQL) + """,
qh AS (SELECT DISTINCT q.table_id AS qtab, h.text AS qhead FROM questions q JOIN heads h USING (table_id)),
bh AS (SELECT DISTINCT b.table_id AS btab, h.text AS bhead FROM bank b JOIN heads h USING (table_id))"""
          + G.sparse_pairs_sql("qh", "qtab", "qhead", "bh", "btab", "bhead", p="t_") + """,
best AS (SELECT qk AS qtab, bk AS example_table, round(sim, 6) AS table_sim FROM (
           SELECT *, row_number() OVER (PARTITION BY qk ORDER BY round(sim, 6) DESC, bk) AS rn FROM t_pairs)
         WHERE rn = 1),
q2 AS (SELECT q.qid, q.question, b.example_table, b.table_sim FROM questions q JOIN best b ON q.table_id = b.qtab),
b2 AS (SELECT bid, lower(question) AS nl, table_id, conv_id, turn FROM bank)"""
          + G.sparse_pairs_sql("q2", "qid", "question", "b2", "bid", "nl",
                               extra_cols=", bb.conv_id, bb.turn", join_on="bb.table_id = qq.example_table",
                               p="s_") + """
SELECT p.qid, p.bid, p.question_sim, q2.example_table, q2.table_sim FROM (
  SELECT qk AS qid, bk AS bid, round(sim, 6) AS question_sim,
         row_number() OVER (PARTITION BY qk ORDER BY round(sim, 6) DESC, conv_id, turn, bk) AS rn
  FROM s_pairs) p JOIN q2 USING (qid) WHERE rn = 1""")
def q_sim_table_then_question(spark, d):
    q = roles.questions(spark, d)
    b = roles.bank(spark, d).withColumn("nl", F.lower("question"))
    heads = R.render_head(roles.conversation_rows(spark, d), 2)
    return S.table_then_question(q, b, heads, heads, q_key="qid", b_key="bid", q_text="question",
                                 b_text="nl", tie_cols=["conv_id", "turn"]).select(
        "qid", "bid", "question_sim", "example_table", "table_sim")


LINES_SQL = """lines AS (
  SELECT doc_id AS table_id, i - 1 AS row_idx, ls[i] AS row_text FROM (
    SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
    FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))"""


@register("sim_row_select", "WITH " + LINES_SQL + """,
qs AS (SELECT table_id, row_text AS question FROM lines WHERE row_idx = 0),
body AS (SELECT *, concat(table_id, ':', row_idx) AS rk FROM lines WHERE row_idx > 0)"""
          + G.sparse_pairs_sql("qs", "table_id", "question", "body", "rk", "row_text",
                               extra_cols=", bb.row_text, bb.row_idx", join_on="bb.table_id = qq.table_id") + """,
top AS (SELECT * FROM (SELECT qk, bk, row_text,
               row_number() OVER (PARTITION BY qk ORDER BY round(sim, 6) DESC, row_idx) AS rn FROM pairs)
        WHERE rn <= 5),
sel AS (SELECT qk AS table_id, string_agg(row_text, '| ' || chr(10) || ' |' ORDER BY rn) AS sel FROM top GROUP BY qk)
SELECT qs.table_id, CASE WHEN sel.sel IS NULL THEN qs.question ELSE qs.question || '| ' || chr(10) || ' |' || sel.sel END AS text
FROM qs LEFT JOIN sel USING (table_id)""")
def q_sim_row_select(spark, d):
    docs = roles.table(spark, d, "documents")
    rows = docs.select(F.col("doc_id").alias("table_id"),
                       F.posexplode(F.split("text", "\n", -1)).alias("row_idx", "row_text"))
    rows = rows.withColumn("row_idx", F.col("row_idx").cast("long"))
    qs = rows.filter(F.col("row_idx") == 0).select("table_id", F.col("row_text").alias("question"))
    return S.select_rows(rows, qs, k=5)


@register("fewshot_random", """
WITH bank AS (SELECT vec_id, row_number() OVER (ORDER BY substr(md5(CAST(vec_id AS VARCHAR)), 1, 3), vec_id) - 1 AS pos
              FROM embeddings),
n AS (SELECT count(*) AS n FROM embeddings),
h AS (SELECT vec_id, n - 3 AS t0, n - 2 AS t1, n - 1 AS t2,
             ('0x' || substr(md5('123|' || CAST(vec_id AS VARCHAR) || '|0'), 1, 15))::BIGINT % (n - 2) AS p0,
             ('0x' || substr(md5('123|' || CAST(vec_id AS VARCHAR) || '|1'), 1, 15))::BIGINT % (n - 1) AS p1,
             ('0x' || substr(md5('123|' || CAST(vec_id AS VARCHAR) || '|2'), 1, 15))::BIGINT % n AS p2
      FROM embeddings, n),
a AS (SELECT vec_id, p0 AS a0, CASE WHEN p1 = p0 THEN t1 ELSE p1 END AS a1, p2, t2 FROM h),
d AS (SELECT vec_id, 0 AS draw, a0 AS pos FROM a UNION ALL SELECT vec_id, 1, a1 FROM a
      UNION ALL SELECT vec_id, 2, CASE WHEN p2 IN (a0, a1) THEN t2 ELSE p2 END FROM a)
SELECT q_vec, b_vec, CAST(rank AS BIGINT) AS rank FROM (
  SELECT d.vec_id AS q_vec, bank.vec_id AS b_vec, row_number() OVER (PARTITION BY d.vec_id ORDER BY draw) AS rank
  FROM d JOIN bank USING (pos) WHERE d.vec_id <> bank.vec_id) WHERE rank <= 2""")
def q_fewshot_random(spark, d):
    e = roles.table(spark, d, "embeddings").select("vec_id")
    return S.fewshot_random(e.withColumnRenamed("vec_id", "q_vec"),
                            e.withColumnRenamed("vec_id", "b_vec"), q_key="q_vec", b_key="b_vec",
                            k=2, seed=123)


@register("sim_token_jaccard", _with(roles.QUESTIONS_SQL, roles.BANK_SQL, roles.DBANK_SQL)
          + G.sparse_pairs_sql("questions", "qid", "question", "dbank", "bid", "nl",
                               extra_cols=", bb.first_conv_id, bb.first_turn", sets=True) + """,
jp AS (SELECT *, CASE WHEN qn2 + bn2 - dot > 0 THEN dot / (qn2 + bn2 - dot) ELSE 0 END AS jac FROM pairs)"""
          + G.topk_select("qid", "bid", K_NL, ["first_conv_id", "first_turn"], sim_expr="jac", src="jp"))
def q_sim_token_jaccard(spark, d):
    q = roles.questions(spark, d)
    b = strategies.dedup_bank(spark, d)
    return S.token_jaccard_topk(q, b, q_key="qid", b_key="bid", q_text="question", b_text="nl",
                                k=K_NL, tie_cols=strategies.BANK_TIES)


@register("bank_leak_antijoin", """
SELECT d.doc_id AS qdoc FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
  AND lower(d.text) NOT IN (SELECT lower(b.text) FROM documents b JOIN labels l USING (doc_id))""")
def q_bank_leak_antijoin(spark, d):
    qs, bk = roles.doc_split(spark, d)
    return S.bank_leak_antijoin(qs, bk, "text", "text").select("qdoc")


@register("sel_correct_bank", """
SELECT d.doc_id AS bdoc FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IN (1)""")
def q_sel_correct_bank(spark, d):
    _, bk = roles.doc_split(spark, d)
    return bk.filter(F.col("quality").isin(1)).select("bdoc")


# ====================================================================== helpers for SQL text

def lit_sql(s: str) -> str:
    """A Python string as a DuckDB expression (quotes doubled, newlines chr(10))."""
    parts = s.split("\n")
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in parts)


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '{TRIM_RE}', '', 'g')"


# ====================================================================== 2.1 sources / sinks

def _scratch(spark, name):
    from tessera.session import scratch_path
    return scratch_path(spark, name)


QSET_SQL = """qset AS (
  SELECT concat(u.conv_id, ':', u.turn) AS id, u.text AS utterance, concat('conv/', u.conv_id) AS context,
         a.text AS targetValue
  FROM conversations u LEFT JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')"""


def _qset(spark, d):
    c = roles.table(spark, d, "conversations")
    u = c.filter(F.col("role") == "user")
    a = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("targetValue"))
    return u.join(a, ["conv_id", "turn"], "left").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.col("text").alias("utterance"),
        F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("context"), "targetValue")


@register("src_questions_tsv", "WITH " + QSET_SQL + " SELECT * FROM qset")
def q_src_questions_tsv(spark, d):
    from tessera.sources import files
    path = _scratch(spark, "questions-tsv")
    files.write_questions_tsv(_qset(spark, d), path)
    return files.read_questions_tsv(spark, path)


BANK_JSON_SQL = "WITH " + roles.CODE_SQL + """
SELECT p.p_brand AS table_id, c.code, p.p_name AS question, c.pred AS prompt,
       CAST(p.p_retailprice AS VARCHAR) AS answer, CAST(p.p_size AS VARCHAR) AS prediction,
       CASE WHEN p.p_size > 30 THEN 1 WHEN p.p_size > 10 THEN 0 ELSE -1 END AS correct,
       p.p_type AS reply, p.p_partkey AS seq
FROM part p JOIN code c USING (p_partkey)"""


def _bank_records(spark, d):
    p = roles.table(spark, d, "part")
    c = roles.code_strings(spark, d)
    return p.join(c, "p_partkey").select(
        F.col("p_brand").alias("table_id"), "code", F.col("p_name").alias("question"),
        F.col("pred").alias("prompt"), F.col("p_retailprice").cast("string").alias("answer"),
        F.col("p_size").cast("string").alias("prediction"),
        F.when(F.col("p_size") > 30, 1).when(F.col("p_size") > 10, 0).otherwise(-1).alias("correct"),
        F.col("p_type").alias("reply"), F.col("p_partkey").alias("seq"))


@register("src_bank_json", BANK_JSON_SQL)
def q_src_bank_json(spark, d):
    from tessera.sources import files
    path = _scratch(spark, "bank-json")
    files.write_json_records(_bank_records(spark, d), path)
    return files.read_bank_json(spark, path)


@register("src_bank_json_array", BANK_JSON_SQL)
def q_src_bank_json_array(spark, d):
    """The bank as arrays of records, one array a table, cut at the bounds of its records."""
    from tessera.sources import files
    path = _scratch(spark, "bank-array")
    recs = _bank_records(spark, d)
    arrays = recs.groupBy("table_id").agg(F.to_json(F.collect_list(F.struct(*recs.columns))).alias("array"))
    arrays.select("array").write.text(path)
    return files.read_bank_json(spark, path, array_file=True)


@register("src_results_jsonl", """
SELECT CAST(doc_id AS VARCHAR) AS key, CAST(quality AS VARCHAR) AS prediction FROM labels""")
def q_src_results_jsonl(spark, d):
    from tessera.sources import files
    lab = roles.table(spark, d, "labels")
    path = _scratch(spark, "results-jsonl")
    files.write_exec_log(lab.select(F.col("doc_id").cast("string").alias("key"),
                                    F.col("quality").cast("string").alias("prediction")), path)
    return files.read_results_jsonl(spark, path)


def _nation_pipe_text(spark, d):
    """Each region's nations as a pipe-delimited text table (header first)."""
    from tessera.operators.sequence import ordered_concat
    n = roles.table(spark, d, "nation")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("n_nationkey").cast("string"), "n_name",
                                             F.col("n_regionkey").cast("string")), F.lit(" |"))
    lines = n.select(F.concat(F.lit("region-"), F.col("n_regionkey").cast("string")).alias("table_id"),
                     F.col("n_nationkey").alias("o"), line.alias("line"))
    body = ordered_concat(lines, "table_id", "o", "line", "\n")
    return body.select("table_id", F.concat(F.lit("| n_nationkey | n_name | n_regionkey |\n"),
                                            F.col("line"), F.lit("\n")).alias("raw"))


NATION_PARSED_SQL = """
WITH n AS (SELECT *, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS BIGINT) AS row_idx
           FROM nation)
SELECT 'region-' || n_regionkey AS table_id, row_idx, 0::BIGINT AS col_idx, 'n_nationkey' AS col_name,
       CAST(n_nationkey AS VARCHAR) AS value FROM n
UNION ALL SELECT 'region-' || n_regionkey, row_idx, 1, 'n_name', n_name FROM n
UNION ALL SELECT 'region-' || n_regionkey, row_idx, 2, 'n_regionkey', CAST(n_regionkey AS VARCHAR) FROM n"""


@register("src_pipe_tables", NATION_PARSED_SQL)
def q_src_pipe_tables(spark, d):
    from tessera.sources import tables
    texts = _nation_pipe_text(spark, d)
    path = _scratch(spark, "pipe-tables")
    texts.write.mode("overwrite").partitionBy("table_id").text(path)
    return tables.read_pipe_tables(spark, path).withColumn(
        "table_id", F.regexp_extract("table_id", "table_id=([^/]+)", 1))


@register("ingest_chain", """
WITH n AS (SELECT 'region-' || n_regionkey AS table_id, n_nationkey AS k, n_name || 'e' || chr(769) AS a,
                  CASE WHEN n_nationkey % 3 <> 0 THEN n_name END AS b,
                  CASE WHEN n_nationkey % 4 <> 1 THEN n_nationkey || ',000' END AS v,
                  CASE WHEN n_nationkey % 4 <> 1 THEN n_nationkey * 1000.0 END AS num FROM nation)
SELECT table_id, count(*) AS n_rows, CAST(sum(num) AS DOUBLE) AS total,
       ' | n_name | n_name.1 | v | ' || chr(10) || ' | ' ||
       string_agg(a || ' | ' || coalesce(b, 'nan') || ' | ' || coalesce(v, 'nan'), ' | ' || chr(10) || ' | ' ORDER BY k) || ' | ' AS text
FROM n GROUP BY table_id""")
def q_ingest_chain(spark, d):
    """Pipe texts with a repeated header name, missing tokens, short rows, composed letters and
    grouped numbers, through parse -> headers -> missing -> strip -> NFKD -> numbers -> render."""
    from tessera.operators.cells import ingest
    from tessera.operators.sequence import ordered_concat
    n = roles.table(spark, d, "nation")
    k = F.col("n_nationkey")
    line = F.concat(F.lit("| "), F.col("n_name"), F.lit("\u00e9 |  "), F.when(k % 3 == 0, F.lit("NA")).otherwise(F.col("n_name")),
                    F.when(k % 4 == 1, F.lit(" |")).otherwise(F.concat(F.lit(" | "), k.cast("string"), F.lit(",000 |"))))
    lines = n.select(F.concat(F.lit("region-"), F.col("n_regionkey").cast("string")).alias("table_id"), k.alias("o"), line.alias("line"))
    raw = ordered_concat(lines, "table_id", "o", "line", "\n").select(
        "table_id", F.concat(F.lit("| n_name | n_name | v |\n"), F.col("line"), F.lit("\n")).alias("raw"))
    cells = ingest(raw)
    totals = cells.groupBy("table_id").agg(F.sum("num").alias("total"))
    return R.render_cells(cells).join(totals, "table_id")


@register("src_html_tables", NATION_PARSED_SQL)
def q_src_html_tables(spark, d):
    from tessera.operators.sequence import ordered_concat
    from tessera.sources import tables
    n = roles.table(spark, d, "nation")
    tr = F.concat(F.lit("<tr><td>"), F.col("n_nationkey").cast("string"), F.lit("</td><td>"),
                  F.replace(F.col("n_name"), F.lit("&"), F.lit("&amp;")), F.lit("</td><td>"),
                  F.col("n_regionkey").cast("string"), F.lit("</td></tr>"))
    rows = n.select(F.concat(F.lit("region-"), F.col("n_regionkey").cast("string")).alias("page_id"),
                    F.col("n_nationkey").alias("o"), tr.alias("tr"))
    body = ordered_concat(rows, "page_id", "o", "tr", "\n")
    html = body.select("page_id", F.concat(
        F.lit("<html><body><p>Nations</p><table class=\"wikitable\">\n"
              "<tr><th>n_nationkey</th><th>n_name</th><th>n_regionkey</th></tr>\n"),
        F.col("tr"), F.lit("\n</table></body></html>")).alias("html"))
    return tables.parse_html_tables(html)


SPANNED_SQL = """
WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, o_orderpriority,
                  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS row_idx
           FROM orders)
SELECT CAST(o_custkey AS VARCHAR) AS table_id, row_idx, 0::BIGINT AS col_idx, 'Customer' AS col_name,
       'Customer ' || o_custkey || chr(233) AS value FROM o
UNION ALL SELECT CAST(o_custkey AS VARCHAR), row_idx, 1, 'Key', CAST(o_orderkey AS VARCHAR) FROM o
UNION ALL SELECT CAST(o_custkey AS VARCHAR), row_idx, 2, 'Status',
       CASE WHEN o_orderstatus = 'O' THEN o_orderpriority ELSE o_orderstatus END FROM o
UNION ALL SELECT CAST(o_custkey AS VARCHAR), row_idx, 3, 'Priority', o_orderpriority FROM o"""


@register("src_html_spans", SPANNED_SQL)
def q_src_html_spans(spark, d):
    """Orders of each customer as a table with spans: the customer's cell covers all rows, a heading
    of two levels, one cell over two columns where an order is open, character references."""
    from tessera.operators.sequence import ordered_concat
    from tessera.sources import tables
    o = roles.table(spark, d, "orders").withColumn("page_id", F.col("o_custkey").cast("string"))
    first = F.row_number().over(Window.partitionBy("page_id").orderBy("o_orderkey")) == 1
    two = F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("<td colspan='2'>"), "o_orderpriority", F.lit("</td>"))).otherwise(
        F.concat(F.lit("<td>"), "o_orderstatus", F.lit("</td><td>"), "o_orderpriority", F.lit("</td>")))
    tr = F.concat(F.lit("<tr>"),
                  F.when(first, F.concat(F.lit("<td rowspan=0>Customer "), "page_id", F.lit("&#xE9;</td>"))).otherwise(""),
                  F.lit("<td>"), F.col("o_orderkey").cast("string"), F.lit("</td>"), two, F.lit("</tr>"))
    body = ordered_concat(o.withColumn("tr", tr), "page_id", "o_orderkey", "tr", "\n")
    html = body.select("page_id", F.concat(
        F.lit("<!-- <table> --><table><tr><th rowspan=2>Customer</th><th colspan=3>Order</th></tr>"
              "<tr><th>Key</th><th>Status</th><th>Priority</th></tr>\n"),
        F.col("tr"), F.lit("</table><table><tr><td>next</td></tr></table>")).alias("html"))
    return tables.parse_html_tables(html)


@register("snk_prompt_json", "WITH " + roles.QUESTIONS_SQL + " SELECT qid, question, table_id FROM questions")
def q_snk_prompt_json(spark, d):
    from tessera.sources import files
    q = roles.questions(spark, d).select("qid", "question", "table_id")
    path = _scratch(spark, "prompts-json")
    files.write_json_records(q, path)
    return spark.read.schema("qid string, question string, table_id string").json(path)


@register("snk_exec_jsonl", "WITH " + roles.REPLIES_SQL + " SELECT rid AS key, reply AS prediction FROM replies")
def q_snk_exec_jsonl(spark, d):
    from tessera.sources import files
    r = roles.replies(spark, d).select(F.col("rid").alias("key"), F.col("reply").alias("prediction"))
    path = _scratch(spark, "exec-jsonl")
    files.write_exec_log(r, path)
    files.write_exec_log(r, path)  # a second run replaces the log, never appends
    return files.read_results_jsonl(spark, path)


# ====================================================================== 2.6 selection

@register("sel_sample_n", """
SELECT doc_id FROM documents ORDER BY md5('123|' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100""")
def q_sel_sample_n(spark, d):
    from tessera.operators.select import sample_n
    return sample_n(roles.table(spark, d, "documents").select("doc_id"), "doc_id", 100, 123)


@register("sel_first_n", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 1000")
def q_sel_first_n(spark, d):
    from tessera.operators.select import first_n
    return first_n(roles.table(spark, d, "documents").select("doc_id"), "doc_id", 1000)


# ====================================================================== 2.7 replies

AI_SQL = f"""ai AS (
  SELECT rid, reply,
         CASE WHEN contains(reply, 'Action Input:')
              THEN {strip_sql("split_part(split_part(reply, 'Action Input:', 2), 'Observation:', 1)")}
              ELSE {strip_sql('reply')} END AS code_keep,
         CASE WHEN contains(reply, 'Action Input: ')
              THEN {strip_sql("split_part(split_part(reply, 'Action Input: ', 2), 'Observation: ', 1)")} END AS code_strict
  FROM replies),
sf AS (SELECT rid, code_keep,
              CASE WHEN contains(code_keep, '```python')
                   THEN replace(replace(code_keep, '```python', ''), '```', '') ELSE code_keep END AS code
       FROM ai),
ln AS (SELECT rid, code, list_filter(string_split({strip_sql('code')}, chr(10)), lambda l: NOT contains(l, 'Output')) AS lines
       FROM sf)"""


@register("reply_action_input", "WITH " + roles.REPLIES_SQL + ",\n" + AI_SQL
          + " SELECT rid, code_keep, code_strict FROM ai")
def q_reply_action_input(spark, d):
    from tessera.functions.replies import action_input
    r = roles.replies(spark, d)
    return r.select("rid", action_input("reply").alias("code_keep"),
                    action_input("reply", on_missing="null", trailing_space=True).alias("code_strict"))


def _fenced(spark, d):
    from tessera.functions.replies import action_input, strip_fence
    return roles.replies(spark, d).select("rid", strip_fence(action_input("reply")).alias("code"))


@register("reply_strip_fence", "WITH " + roles.REPLIES_SQL + ",\n" + AI_SQL + " SELECT rid, code FROM sf")
def q_reply_strip_fence(spark, d):
    return _fenced(spark, d)


@register("reply_drop_output_lines", "WITH " + roles.REPLIES_SQL + ",\n" + AI_SQL
          + " SELECT rid, array_to_string(lines, chr(10)) AS code FROM ln")
def q_reply_drop_output_lines(spark, d):
    from tessera.functions.replies import drop_output_lines
    return _fenced(spark, d).select("rid", drop_output_lines("code").alias("code"))


@register("reply_program_shape", "WITH " + roles.REPLIES_SQL + ",\n" + AI_SQL + f"""
SELECT rid,
       CASE WHEN len(lines) > 1 THEN 'block' WHEN contains(code, ' = ') THEN 'assign' ELSE 'expr' END AS shape,
       CASE WHEN len(lines) > 1 THEN lines[-1] WHEN contains(code, ' = ') THEN split_part(code, ' = ', 1)
            ELSE {strip_sql('code')} END AS result_expr
FROM ln""")
def q_reply_program_shape(spark, d):
    from tessera.functions.replies import program_shape
    return _fenced(spark, d).select("rid", program_shape("code").alias("s")).select(
        "rid", "s.shape", "s.result_expr")


# ====================================================================== 2.8 evaluation

def _event_labels(spark, d):
    from tessera.operators.evaluate import outcome_label
    e = roles.table(spark, d, "events")
    ans = F.when(F.col("value") > 10, F.lit("purchase")).otherwise(F.lit("view"))
    pred = F.when(F.col("event_type") == "error", F.concat(F.lit("Traceback (most recent call last): "),
                                                           F.col("props"))).otherwise(F.col("event_type"))
    x = e.select("user_id", "event_id", ans.alias("answer"), pred.alias("prediction"))
    return x.withColumn("label", outcome_label("answer", "prediction"))


LABEL_SQL = """lab AS (
  SELECT user_id, event_id, answer, prediction,
         CASE WHEN answer = prediction THEN 1 WHEN contains(prediction, 'Traceback') THEN -1 ELSE 0 END AS label
  FROM (SELECT user_id, event_id, CASE WHEN value > 10 THEN 'purchase' ELSE 'view' END AS answer,
               CASE WHEN event_type = 'error' THEN 'Traceback (most recent call last): ' || props
                    ELSE event_type END AS prediction FROM events))"""


@register("eval_exact_match", f"""
WITH g AS (SELECT o_orderkey, o_orderstatus AS answer,
                  CASE WHEN o_totalprice > 200000 THEN ' F' || chr(160) ELSE 'O ' END AS prediction FROM orders)
SELECT count(*) AS n, count(*) FILTER (WHERE {strip_sql('answer')} = {strip_sql('prediction')}) AS hits,
       count(*) FILTER (WHERE {strip_sql('answer')} = {strip_sql('prediction')}) / count(*) AS ratio
FROM g""")
def q_eval_exact_match(spark, d):
    from tessera.operators.evaluate import exact_match
    o = roles.table(spark, d, "orders")
    gold = o.select("o_orderkey", F.col("o_orderstatus").alias("answer"))
    pred = o.select("o_orderkey", F.when(F.col("o_totalprice") > 200000, F.lit(" F "))
                    .otherwise(F.lit("O ")).alias("prediction"))
    return exact_match(gold, pred, "o_orderkey")


@register("eval_outcome_label", "WITH " + LABEL_SQL + " SELECT label, count(*) AS n FROM lab GROUP BY label")
def q_eval_outcome_label(spark, d):
    from tessera.operators.evaluate import label_counts
    return label_counts(_event_labels(spark, d))


@register("eval_progress", "WITH " + LABEL_SQL + """,
p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM lab),
b AS (SELECT user_id, (pos - 1) // 50 AS batch, count(*) AS n, count(*) FILTER (WHERE label = 1) AS b1,
             count(*) FILTER (WHERE label = 0) AS b0, count(*) FILTER (WHERE label = -1) AS berr
      FROM p GROUP BY user_id, (pos - 1) // 50)
SELECT user_id, CAST(batch AS BIGINT) AS batch,
       CAST(sum(n) OVER w AS BIGINT) AS n_items, CAST(sum(b1) OVER w AS BIGINT) AS c1,
       CAST(sum(b0) OVER w AS BIGINT) AS c0, CAST(sum(berr) OVER w AS BIGINT) AS cerr
FROM b WINDOW w AS (PARTITION BY user_id ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def q_eval_progress(spark, d):
    from tessera.operators.evaluate import progress
    return progress(_event_labels(spark, d), "user_id", "event_id").withColumn(
        "batch", F.col("batch").cast("long"))


@register("eval_compare_runs", """
SELECT count(*) FILTER (WHERE a = p1 AND a = p2) AS both, count(*) FILTER (WHERE a = p1 AND a <> p2) AS only1,
       count(*) FILTER (WHERE a <> p1 AND a = p2) AS only2, count(*) FILTER (WHERE a <> p1 AND a <> p2) AS neither
FROM (SELECT doc_id, '1' AS a, CAST(quality AS VARCHAR) AS p1, CAST(toxic AS VARCHAR) AS p2 FROM labels)""")
def q_eval_compare_runs(spark, d):
    from tessera.operators.evaluate import compare_runs
    lab = roles.table(spark, d, "labels")
    gold = lab.select("doc_id", F.lit("1").alias("answer"))
    r1 = lab.select("doc_id", F.col("quality").cast("string").alias("p1"))
    r2 = lab.select("doc_id", F.col("toxic").cast("string").alias("p2"))
    return compare_runs(gold, r1, r2, "doc_id")


@register("eval_only_first_right", """
SELECT doc_id FROM labels WHERE CAST(quality AS VARCHAR) = '1' AND CAST(toxic AS VARCHAR) <> '1'""")
def q_eval_only_first_right(spark, d):
    from tessera.operators.evaluate import only_first_right
    lab = roles.table(spark, d, "labels")
    gold = lab.select("doc_id", F.lit("1").alias("answer"))
    r1 = lab.select("doc_id", F.col("quality").cast("string").alias("p1"))
    r2 = lab.select("doc_id", F.col("toxic").cast("string").alias("p2"))
    return only_first_right(gold, r1, r2, "doc_id")


@register("attempts_fold", """
WITH a AS (SELECT user_id, CAST(event_id AS VARCHAR) AS reply, event_type <> 'error' AS ok,
                  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
g AS (SELECT user_id, min(n) FILTER (WHERE ok AND n <= 3) AS ok_n,
             arg_min(reply, n) FILTER (WHERE ok AND n <= 3) AS ok_reply,
             arg_max(reply, n) FILTER (WHERE n <= 4) AS last_reply, count(*) AS m FROM a GROUP BY user_id)
SELECT user_id, coalesce(ok_reply, last_reply) AS reply, CAST(coalesce(ok_n, least(m, 3)) AS BIGINT) AS tries FROM g""")
def q_attempts_fold(spark, d):
    from tessera.operators.evaluate import attempts_fold
    e = roles.table(spark, d, "events").select(
        "user_id", "event_id", F.col("event_id").cast("string").alias("reply"),
        (F.col("event_type") != "error").alias("ok"))
    return attempts_fold(e, "user_id", "event_id", "reply", "ok", cap=3)


@register("attempts_until_match", """
WITH a AS (SELECT user_id, CAST(event_id AS VARCHAR) AS reply, event_type = 'purchase' AS hit,
                  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
g AS (SELECT user_id, arg_min(reply, n) FILTER (WHERE hit AND n <= 1) AS hit_reply,
             arg_max(reply, n) FILTER (WHERE n <= 1) AS cap_reply FROM a GROUP BY user_id)
SELECT user_id, coalesce(hit_reply, cap_reply) AS reply, hit_reply IS NOT NULL AS hit FROM g""")
def q_attempts_until_match(spark, d):
    from tessera.operators.evaluate import attempts_until_match
    e = roles.table(spark, d, "events").select(
        "user_id", "event_id", F.col("event_id").cast("string").alias("reply"),
        (F.col("event_type") == "purchase").alias("hit"))
    return attempts_until_match(e, "user_id", "event_id", "reply", "hit", cap=1)


@register("attempts_until_match_3", """
WITH a AS (SELECT user_id, CAST(event_id AS VARCHAR) AS reply, event_type = 'purchase' AS hit,
                  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
g AS (SELECT user_id, arg_min(reply, n) FILTER (WHERE hit AND n <= 3) AS hit_reply,
             arg_max(reply, n) FILTER (WHERE n <= 3) AS cap_reply FROM a GROUP BY user_id)
SELECT user_id, coalesce(hit_reply, cap_reply) AS reply, hit_reply IS NOT NULL AS hit FROM g""")
def q_attempts_until_match_3(spark, d):
    from tessera.operators.evaluate import attempts_until_match
    e = roles.table(spark, d, "events").select(
        "user_id", "event_id", F.col("event_id").cast("string").alias("reply"),
        (F.col("event_type") == "purchase").alias("hit"))
    return attempts_until_match(e, "user_id", "event_id", "reply", "hit", cap=3)


# ====================================================================== 2.5 prompts

from tessera.functions.literals import BUDGET_MARKER, TABLE_BUDGET, TOKEN_RE  # noqa: E402
from tessera.operators import prompts as P  # noqa: E402

RENDER_SQL = """{name} AS (
  SELECT table_id, ' | ' || max(header_text) || ' | ' || chr(10) || ' | ' ||
         string_agg(row_text, ' | ' || chr(10) || ' | ' ORDER BY row_idx) || ' | ' AS text
  FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY row_idx, row_text) AS rk FROM conv_rows)
  WHERE rk <= {rows} GROUP BY table_id)"""


def budget_sql(name: str, src: str, budget: int = TABLE_BUDGET) -> str:
    return f"""{name} AS (
  SELECT table_id, CASE WHEN len(toks) > {budget}
                        THEN array_to_string(toks[1:{budget}], '') || {lit_sql(BUDGET_MARKER)} ELSE text END AS text
  FROM (SELECT table_id, text, regexp_extract_all(text, '{TOKEN_RE}') AS toks FROM {src}))"""


def _ranked_sql() -> str:
    return "ranked AS (" + ORACLES["txt_sparse_topk"] + ")"


BLOCK_SQL = f"""blocks AS (
  SELECT r.qid, {lit_sql(P.FEWSHOT_LEAD)} || string_agg({lit_sql(P.EXAMPLE_Q)} || b.nl || {lit_sql(P.EXAMPLE_CODE)}
         || replace(b.code, '@@@', chr(10)) || {lit_sql(P.EXAMPLE_END)}, '' ORDER BY r.rank) AS block
  FROM ranked r JOIN dbank b USING (bid) GROUP BY r.qid)"""


@register("prompt_fewshot_block", _with(roles.QUESTIONS_SQL, roles.BANK_SQL, roles.DBANK_SQL, _ranked_sql(),
                                        BLOCK_SQL) + " SELECT qid, block FROM blocks")
def q_prompt_fewshot_block(spark, d):
    ranked = strategies.nl_topk(spark, d, K_NL)
    return strategies.fewshot(ranked, strategies.dedup_bank(spark, d))


@register("prompt_code_template", _with(roles.QUESTIONS_SQL, roles.BANK_SQL, roles.DBANK_SQL, _ranked_sql(),
                                        BLOCK_SQL, roles.CONV_ROWS_SQL,
                                        RENDER_SQL.format(name="fullt", rows=TABLE_BUDGET),
                                        budget_sql("tb", "fullt")) + f"""
SELECT q.qid, coalesce(bl.block, {lit_sql(P.FEWSHOT_LEAD)}) || {lit_sql(P.TABLE_LEAD)} || coalesce(tb.text, '')
       || {lit_sql(P.QUESTION_LEAD)} || q.question || {lit_sql(P.CODE_CUE)} AS prompt
FROM questions q LEFT JOIN blocks bl USING (qid) LEFT JOIN tb USING (table_id)""")
def q_prompt_code_template(spark, d):
    return strategies.nl_prompts(spark, d, K_NL)


def _code_prompt_sql(questions: str = "questions", extra: str = "") -> str:
    """CTEs and SELECT of the code prompt over ``ranked`` and the de-duplicated bank."""
    return ",\n" + ",\n".join([BLOCK_SQL, roles.CONV_ROWS_SQL, RENDER_SQL.format(name="fullt", rows=TABLE_BUDGET),
                               budget_sql("tb", "fullt")]) + f"""
SELECT q.qid, coalesce(bl.block, {lit_sql(P.FEWSHOT_LEAD)}) || {lit_sql(P.TABLE_LEAD)} || coalesce(tb.text, '')
       || {lit_sql(P.QUESTION_LEAD)} || q.question || {lit_sql(P.CODE_CUE)} AS prompt{extra}
FROM {questions} q LEFT JOIN blocks bl USING (qid) LEFT JOIN tb USING (table_id)"""


def _mask_sql(x: str) -> str:
    return f"array_to_string(list_filter(string_split({x}, ''''), lambda s, i: i % 2 = 1), '''MASK''')"


_TIE_COLS = ", bb.first_conv_id, bb.first_turn"
_BANK_SQL = _with(roles.QUESTIONS_SQL, roles.BANK_SQL, roles.DBANK_SQL)
_MASKED_SQL = f""",
qp AS (SELECT *, 'df[df[''turn'']==''' || turn || '''].text' AS prediction FROM questions),
mq AS (SELECT qid, {_mask_sql('prediction')} AS mtext FROM qp),
mb AS (SELECT bid, first_conv_id, first_turn, {_mask_sql("replace(code, '@@@', chr(10))")} AS mtext FROM dbank)"""


def _ranked_of(src: str) -> str:
    return ",\nranked AS (" + G.topk_select("qid", "bid", 1, ["first_conv_id", "first_turn"], src=src) + ")"


def _strategy(name: str, spark, d, **kw):
    q = roles.questions(spark, d).withColumn(
        "prediction", F.concat(F.lit("df[df['turn']=='"), F.col("turn").cast("string"), F.lit("'].text")))
    return strategies.build_prompts(name, q, roles.bank(spark, d), roles.conversation_rows(spark, d),
                                    ["conv_id", "turn"], **kw)


@register("strategy_keyword", _with(roles.QUESTIONS_SQL, roles.BANK_SQL, roles.DBANK_SQL,
                                    "ranked AS (SELECT * FROM (" + ORACLES["sim_keyword_gate"] + ") WHERE rank = 1)", KW_SQL)
          + _code_prompt_sql(extra=", (SELECT kw FROM kw WHERE kw.qid = q.qid) AS keyword"))
def q_strategy_keyword(spark, d):
    return _strategy("keyword", spark, d, lookup=lambda at: roles.bank(spark, d, at))


@register("strategy_code", _BANK_SQL + _MASKED_SQL
          + G.sparse_pairs_sql("mq", "qid", "mtext", "mb", "bid", "mtext", extra_cols=_TIE_COLS) + _ranked_of("pairs")
          + _code_prompt_sql("qp", ", q.prediction AS pre_predicted"))
def q_strategy_code(spark, d):
    return _strategy("code", spark, d)


@register("strategy_two_signal", _BANK_SQL + _MASKED_SQL
          + G.sparse_pairs_sql("mq", "qid", "mtext", "mb", "bid", "mtext", p="g_")
          + G.sparse_pairs_sql("questions", "qid", "question", "dbank", "bid", "nl", extra_cols=_TIE_COLS, p="r_") + """,
both_pairs AS (SELECT r.qk, r.bk, r.first_conv_id, r.first_turn, CASE WHEN g.sim > 0.9 THEN r.sim ELSE 0 END AS sim
               FROM r_pairs r JOIN g_pairs g ON g.qk = r.qk AND g.bk = r.bk)""" + _ranked_of("both_pairs")
          + _code_prompt_sql("qp", ", q.prediction AS pre_predicted"))
def q_strategy_two_signal(spark, d):
    return _strategy("two_signal", spark, d)


@register("strategy_self_check", _BANK_SQL + """,
sq AS (SELECT bid AS qid, nl AS question, table_id, code, answer FROM dbank)"""
          + G.sparse_pairs_sql("sq", "qid", "question", "dbank", "bid", "nl", extra_cols=_TIE_COLS) + _ranked_of("pairs")
          + _code_prompt_sql("sq", ", q.code, q.answer"))
def q_strategy_self_check(spark, d):
    return _strategy("self_check", spark, d)


@register("strategy_agent_rows", _with(roles.QUESTIONS_SQL, roles.CONV_ROWS_SQL) + """,
body AS (SELECT q.qid AS own, q.qid || '#' || r.row_idx AS rk, r.row_idx, r.row_text, r.header_text
         FROM questions q JOIN conv_rows r USING (table_id))"""
          + G.sparse_pairs_sql("questions", "qid", "question", "body", "rk", "row_text",
                               extra_cols=", bb.row_text, bb.row_idx, bb.header_text", join_on="bb.own = qq.qid") + f""",
top AS (SELECT *, row_number() OVER (PARTITION BY qk ORDER BY round(sim, 6) DESC, row_idx) AS rn FROM pairs),
sel AS (SELECT qk AS qid, max(header_text) || '| ' || chr(10) || ' |' ||
               string_agg(row_text, '| ' || chr(10) || ' |' ORDER BY rn) AS text FROM top WHERE rn <= 5 GROUP BY qk)
SELECT q.qid, {lit_sql(P.AGENT_HEAD)} || coalesce(sel.text, '') || {lit_sql(P.AGENT_QUESTION)} || q.question AS prompt
FROM questions q LEFT JOIN sel USING (qid)""")
def q_strategy_agent_rows(spark, d):
    return _strategy("agent", spark, d, row_selection=True)


@register("prompt_agent_template", _with(roles.QUESTIONS_SQL, roles.CONV_ROWS_SQL,
                                         RENDER_SQL.format(name="fullt", rows=1 << 30)) + f"""
SELECT q.qid, {lit_sql(P.AGENT_HEAD)} || coalesce(t.text, '') || {lit_sql(P.AGENT_QUESTION)} || q.question AS prompt
FROM questions q LEFT JOIN fullt t USING (table_id)""")
def q_prompt_agent_template(spark, d):
    q = roles.questions(spark, d)
    t = R.render_rows(roles.conversation_rows(spark, d))
    return P.agent_prompt(R.join_question_table(q, t), "qid")


@register("prompt_table_example", _with(roles.QUESTIONS_SQL, roles.BANK_SQL, roles.CONV_ROWS_SQL,
                                        "tq AS (" + ORACLES["sim_table_then_question"] + ")",
                                        RENDER_SQL.format(name="head6", rows=5),
                                        RENDER_SQL.format(name="fullt", rows=TABLE_BUDGET),
                                        budget_sql("tb", "fullt")) + f"""
SELECT q.qid, {lit_sql(P.EXAMPLE_HEAD)} || coalesce(h.text, '') || {lit_sql(P.EXAMPLE_QUESTION)}
       || coalesce(lower(b.question), '') || {lit_sql(P.EXAMPLE_ANSWER)} || coalesce(b.answer, '')
       || {lit_sql(P.EXAMPLE_TAIL)} || {lit_sql(P.AGENT_HEAD)} || coalesce(tb.text, '')
       || {lit_sql(P.AGENT_QUESTION)} || q.question AS prompt
FROM questions q LEFT JOIN tq USING (qid) LEFT JOIN bank b ON b.bid = tq.bid
     LEFT JOIN head6 h ON h.table_id = tq.example_table LEFT JOIN tb ON tb.table_id = q.table_id""")
def q_prompt_table_example(spark, d):
    q = roles.questions(spark, d)
    b = roles.bank(spark, d).withColumn("nl", F.lower("question"))
    rows = roles.conversation_rows(spark, d)
    heads = R.render_head(rows, 2)
    tq = S.table_then_question(q, b, heads, heads, q_key="qid", b_key="bid", q_text="question",
                               b_text="nl", tie_cols=["conv_id", "turn"])
    ex = strategies.table_examples(tq, rows, b, 6, lambda at: roles.bank(spark, d, at))
    qt = R.join_question_table(q, strategies.asked_tables(q, rows)).join(ex, "qid", "left")
    return P.table_example_prompt(qt, "qid")


@register("prompt_post_answer", _with(roles.BANK_SQL, roles.CONV_ROWS_SQL,
                                      RENDER_SQL.format(name="fullt", rows=TABLE_BUDGET),
                                      budget_sql("tb", "fullt")) + f"""
SELECT b.bid, {lit_sql(P.POST_HEAD)} || coalesce(tb.text, '') || {lit_sql(P.POST_QUESTION)} || b.question
       || {lit_sql(P.POST_CODE)} || coalesce(b.code, '') || {lit_sql(P.POST_RESULT)} || coalesce(b.answer, '')
       || {lit_sql(P.POST_TAIL)} AS prompt
FROM bank b LEFT JOIN tb USING (table_id)""")
def q_prompt_post_answer(spark, d):
    b = roles.bank(spark, d)
    j = R.join_question_table(b, strategies.tables(spark, d))
    return P.post_answer_prompt(j.withColumnRenamed("code", "prediction").withColumnRenamed("answer", "result"),
                                "bid")


_RESULT_SQL = "CASE conv_id % 3 WHEN 0 THEN answer WHEN 1 THEN 'Traceback (most recent call last): x' ELSE 'other' END"
_RECORDS_SQL = f"""strict AS (
  SELECT rid, CASE WHEN contains(code_strict, '```python')
                   THEN replace(replace(code_strict, '```python', ''), '```', '') ELSE code_strict END AS code FROM ai),
records AS (
  SELECT b.bid, b.table_id, replace(array_to_string(list_filter(string_split({strip_sql('s.code')}, chr(10)),
                                    lambda l: NOT contains(l, 'Output')), chr(10)), chr(10), '@@@') AS code,
         b.question, 'ask ' || b.bid AS prompt, b.answer, {_RESULT_SQL} AS prediction,
         CASE WHEN answer = ({_RESULT_SQL}) THEN 1 WHEN contains({_RESULT_SQL}, 'Traceback') THEN -1 ELSE 0 END AS correct,
         r.reply
  FROM bank b LEFT JOIN replies r ON r.rid = b.bid LEFT JOIN strict s ON s.rid = b.bid)"""


def _records(spark, d):
    from tessera.operators.bank import bank_records
    b = roles.bank(spark, d).withColumn("prompt", F.concat(F.lit("ask "), F.col("bid")))
    third = F.col("conv_id") % 3
    results = b.select("bid", F.when(third == 0, F.col("answer"))
                       .when(third == 1, "Traceback (most recent call last): x").otherwise("other").alias("prediction"))
    return bank_records(b, roles.replies(spark, d).withColumnRenamed("rid", "bid"), results, "bid")


@register("bank_builder", _with(roles.BANK_SQL, roles.REPLIES_SQL, AI_SQL, _RECORDS_SQL) + " SELECT * FROM records")
def q_bank_builder(spark, d):
    """Replies -> code -> outcome -> bank records."""
    return _records(spark, d)


@register("second_pass", _with(roles.BANK_SQL, roles.REPLIES_SQL, AI_SQL, _RECORDS_SQL, roles.CONV_ROWS_SQL,
                               RENDER_SQL.format(name="fullt", rows=TABLE_BUDGET), budget_sql("tb", "fullt")) + f"""
SELECT bid, {lit_sql(P.POST_HEAD)} || coalesce(tb.text, '') || {lit_sql(P.POST_QUESTION)} || r.question
       || {lit_sql(P.POST_CODE)} || coalesce(replace(r.code, '@@@', chr(10)), '') || {lit_sql(P.POST_RESULT)}
       || coalesce(r.prediction, '') || {lit_sql(P.POST_TAIL)} AS prompt
FROM records r LEFT JOIN tb USING (table_id) WHERE correct <> 1""")
def q_second_pass(spark, d):
    """Bank records that aren't right, asked again with their code and its result."""
    from tessera.operators.bank import second_pass
    return second_pass(_records(spark, d), strategies.tables(spark, d), "bid")


@register("prompt_history_fold", """
SELECT conv_id, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS prompt, count(*) AS n_turns
FROM conversations GROUP BY conv_id""")
def q_prompt_history_fold(spark, d):
    c = roles.table(spark, d, "conversations")
    return P.history_fold(c, "conv_id", "turn", "text")


# ====================================================================== streaming

@register("stream_progress_counts", "WITH " + LABEL_SQL + """
SELECT user_id AS run, count(*) AS n_items, count(*) FILTER (WHERE label = 1) AS c1,
       count(*) FILTER (WHERE label = 0) AS c0, count(*) FILTER (WHERE label = -1) AS cerr
FROM lab GROUP BY user_id""")
def q_stream_progress_counts(spark, d):
    """The execution log (derived from ``events``) arrives as several appended
    files; the stream folds them into per-run counts."""
    from tessera.streaming.progress import current, start_progress
    base = _scratch(spark, "stream")
    log_dir, out_dir, ckpt = f"{base}/log", f"{base}/out", f"{base}/ckpt"
    logs = _event_labels(spark, d).select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"),
                                          "answer", "prediction")
    # as many files as the log has partitions
    logs.write.mode("overwrite").json(log_dir)
    q = start_progress(spark, log_dir, out_dir, ckpt, available_now=True, max_files_per_trigger=1000)
    q.awaitTermination()
    return current(spark, out_dir)


# ====================================================================== optional (commented in the source)

@register("eval_answer_canonical", """
WITH p AS (SELECT p_partkey,
  CASE WHEN p_size < 5 THEN CASE WHEN p_partkey % 2 = 0 THEN 'True' ELSE 'false' END
       WHEN p_size < 15 THEN p_name || ', ' || p_brand || ', ' || p_type
       WHEN p_size < 25 THEN '0    ' || p_name || chr(10) || 'Name: x, dtype: object'
       WHEN p_size < 35 THEN '["' || p_name || '"]'
       WHEN p_size < 45 THEN '[''' || p_brand || ''', ''' || p_type || ''']'
       ELSE p_name END AS raw FROM part),
s1 AS (SELECT p_partkey, raw, CASE WHEN raw IN ('False', 'false') THEN 'no' WHEN raw IN ('True', 'true') THEN 'yes' ELSE raw END AS p FROM p),
s2 AS (SELECT p_partkey, raw, CASE WHEN len(string_split(p, ', ')) > 2 THEN replace(p, ', ', '|') ELSE p END AS p FROM s1),
s3 AS (SELECT p_partkey, raw, CASE WHEN contains(p, 'dtype: object')
                                   THEN array_to_string(string_split(split_part(p, chr(10), 1), ' ')[2:], ' ') ELSE p END AS p FROM s2),
s4 AS (SELECT p_partkey, raw, replace(p, '"', '') AS p FROM s3)
SELECT p_partkey, raw, CASE WHEN contains(p, '[') AND contains(p, ']')
                            THEN replace(replace(replace(p, '[', ''), ']', ''), '''', '') ELSE p END AS answer
FROM s4""")
def q_eval_answer_canonical(spark, d):
    from tessera.operators.evaluate import canonical_answer
    p = roles.table(spark, d, "part")
    raw = (F.when(F.col("p_size") < 5, F.when(F.col("p_partkey") % 2 == 0, F.lit("True")).otherwise(F.lit("false")))
            .when(F.col("p_size") < 15, F.concat_ws(", ", "p_name", "p_brand", "p_type"))
            .when(F.col("p_size") < 25, F.concat(F.lit("0    "), F.col("p_name"), F.lit("\nName: x, dtype: object")))
            .when(F.col("p_size") < 35, F.concat(F.lit('["'), F.col("p_name"), F.lit('"]')))
            .when(F.col("p_size") < 45, F.concat(F.lit("['"), F.col("p_brand"), F.lit("', '"), F.col("p_type"), F.lit("']")))
            .otherwise(F.col("p_name")))
    return p.select("p_partkey", raw.alias("raw")).withColumn("answer", canonical_answer("raw"))


@register("sim_keyword_vector", _with(roles.QUESTIONS_SQL, roles.BANK_SQL, roles.DBANK_SQL, KW_SQL)
          + G.sparse_pairs_sql("kw", "qid", "kw", "dbank", "bid", "nl",
                               extra_cols=", bb.first_conv_id, bb.first_turn")
          + G.topk_select("qid", "bid", K_NL, ["first_conv_id", "first_turn"]))
def q_sim_keyword_vector(spark, d):
    """Rank examples by similarity to the question's keyword alone."""
    q = roles.questions(spark, d).withColumn("kw", TX.min_ngram("question", 1))
    b = strategies.dedup_bank(spark, d)
    return S.sparse_topk(q, b, q_key="qid", b_key="bid", q_text="kw", b_text="nl", k=K_NL,
                         tie_cols=strategies.BANK_TIES)
