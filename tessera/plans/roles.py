"""Roles of the engine's inputs, derived from the provided tables.

Each role is defined twice, once as a Spark DataFrame and once as a DuckDB
CTE (``*_SQL``) for the oracle, from whole tables. No role takes an id
subset: questions are the user turns still waiting for an answer, the bank
is the answered ones, and so on; all of them grow with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.select import with_keys


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(*cols) -> F.Column:
    return F.concat_ws(":", *[F.col(c).cast("string") for c in cols])


# ------------------------------------------------------------ questions and bank

def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with no assistant reply at the next turn.

    ``qid, conv_id, turn, question, table_id``; table = the conversation.
    """
    c = table(spark, sf_dir, "conversations")
    u = c.filter(F.col("role") == "user")
    a = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"))
    return (u.join(a, ["conv_id", "turn"], "left_anti")
             .select(_key("conv_id", "turn").alias("qid"), "conv_id", "turn",
                     F.col("text").alias("question"),
                     F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("table_id")))


QUESTIONS_SQL = """questions AS (
  SELECT concat(u.conv_id, ':', u.turn) AS qid, u.conv_id, u.turn, u.text AS question,
         concat('conv/', u.conv_id) AS table_id
  FROM conversations u
  WHERE u.role = 'user' AND NOT EXISTS (
    SELECT 1 FROM conversations a
    WHERE a.role = 'assistant' AND a.conv_id = u.conv_id AND a.turn = u.turn + 1))"""


def bank(spark: SparkSession, sf_dir: str, at: DataFrame | None = None) -> DataFrame:
    """Solved examples: a user turn and the assistant turn after it.

    ``bid, conv_id, turn, question, code, answer, table_id``; ``at(conv_id, turn)``:
    only the examples there.
    """
    c = table(spark, sf_dir, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("code"))
    if at is not None:
        u, a = (with_keys(x, at, ["conv_id", "turn"]) for x in (u, a))
    return (u.join(a, ["conv_id", "turn"])
             .select(_key("conv_id", "turn").alias("bid"), "conv_id", "turn", "question", "code",
                     F.col("code").alias("answer"),
                     F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("table_id")))


BANK_SQL = """bank AS (
  SELECT concat(u.conv_id, ':', u.turn) AS bid, u.conv_id, u.turn, u.text AS question,
         a.text AS code, a.text AS answer, concat('conv/', u.conv_id) AS table_id
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')"""

# Deduplicated bank: last duplicate's values, first duplicate's position.
DBANK_SQL = """dbank AS (
  SELECT nl, bid, conv_id, turn, question, code, answer, table_id,
         first_conv_id, first_turn, n_dup FROM (
    SELECT lower(question) AS nl, *,
           row_number() OVER (PARTITION BY lower(question) ORDER BY conv_id DESC, turn DESC) AS rl,
           first_value(conv_id) OVER (PARTITION BY lower(question) ORDER BY conv_id, turn) AS first_conv_id,
           first_value(turn) OVER (PARTITION BY lower(question) ORDER BY conv_id, turn) AS first_turn,
           count(*) OVER (PARTITION BY lower(question)) AS n_dup
    FROM bank) WHERE rl = 1)"""


def conversation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a small table ``turn | role | text``."""
    from tessera.operators.render import rows_from_frame

    c = table(spark, sf_dir, "conversations").withColumn(
        "table_id", F.concat(F.lit("conv/"), F.col("conv_id").cast("string")))
    return rows_from_frame(c, "table_id", "turn", ["turn", "role", "text"])


CONV_ROWS_SQL = """conv_rows AS (
  SELECT concat('conv/', conv_id) AS table_id, turn AS row_idx,
         concat_ws(' | ', CAST(turn AS VARCHAR), coalesce(role, 'nan'), coalesce(text, 'nan')) AS row_text,
         'turn | role | text' AS header_text
  FROM conversations)"""


# ------------------------------------------------------------ small tables

def nation_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``nation`` grouped by region: cells of 5 small tables."""
    n = table(spark, sf_dir, "nation")
    cols = ["n_nationkey", "n_name", "n_regionkey"]
    return _cells_from_wide(n, F.concat(F.lit("region/"), F.col("n_regionkey").cast("string")),
                            "n_nationkey", cols)


def _cells_from_wide(df: DataFrame, table_id, order_col: str, cols: list[str],
                     numbered: bool = True) -> DataFrame:
    """One cell per row and column. Rows are numbered within their table by the
    skew-safe running count (a table holding a third of all rows is not one
    task); ``numbered=False`` keeps the order column itself as ``row_idx``."""
    from tessera.operators.sequence import positions

    d = df.withColumn("table_id", table_id)
    if numbered:
        d = positions(d, "table_id", [order_col], "row_idx").withColumn("row_idx", F.col("row_idx") - 1)
    else:
        d = d.withColumn("row_idx", F.col(order_col).cast("long"))
    stack = F.explode(F.array(*[
        F.struct(F.lit(i).alias("col_idx"), F.lit(c).alias("col_name"),
                 F.col(c).cast("string").alias("value")) for i, c in enumerate(cols)]))
    return d.select("table_id", "row_idx", stack.alias("c")).select(
        "table_id", "row_idx", "c.col_idx", "c.col_name", "c.value")


def orders_cells(spark: SparkSession, sf_dir: str, numbered: bool = True) -> DataFrame:
    """``orders`` grouped by customer (rows ordered by the unique order key)."""
    o = table(spark, sf_dir, "orders")
    cols = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    return _cells_from_wide(o, F.concat(F.lit("cust/"), F.col("o_custkey").cast("string")),
                            "o_orderkey", cols, numbered)


def cells_sql(name: str, src: str, table_expr: str, order_col: str, cols: list[str]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT table_id, row_idx, {i} AS col_idx, '{c}' AS col_name, CAST({c} AS VARCHAR) AS value FROM t"
        for i, c in enumerate(cols))
    return f"""{name} AS (
  WITH t AS (SELECT *, {table_expr} AS table_id,
                    row_number() OVER (PARTITION BY {table_expr} ORDER BY {order_col}) - 1 AS row_idx
             FROM {src})
  {parts})"""


NATION_CELLS_SQL = cells_sql("cells", "nation", "concat('region/', n_regionkey)", "n_nationkey",
                             ["n_nationkey", "n_name", "n_regionkey"])
ORDERS_CELLS_SQL = cells_sql("cells", "orders", "concat('cust/', o_custkey)", "o_orderkey",
                             ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"])


# ------------------------------------------------------------ derived strings

def code_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code built from ``part``; every third key leaves a quote unclosed."""
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey",
        F.concat(F.lit("x = df[df['"), F.col("p_brand"), F.lit("']=='"), F.col("p_name"),
                 F.lit("']@@@x."), F.lower(F.col("p_type")),
                 F.when(F.col("p_size") > 25, F.lit(".max()")).otherwise(F.lit(".count()")),
                 F.when(F.col("p_partkey") % 3 == 0, F.lit(" + 'open")).otherwise(F.lit("")))
         .alias("code"),
        F.concat(F.lit("df[df['p_type']=='"), F.col("p_type"), F.lit("'].p_name.str.contains('"),
                 F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)), F.lit("').sum()"))
         .alias("pred"))


CODE_SQL = """code AS (
  SELECT p_partkey,
         concat('x = df[df[''', p_brand, ''']==''', p_name, ''']@@@x.', lower(p_type),
                CASE WHEN p_size > 25 THEN '.max()' ELSE '.count()' END,
                CASE WHEN p_partkey % 3 = 0 THEN ' + ''open' ELSE '' END) AS code,
         concat('df[df[''p_type'']==''', p_type, '''].p_name.str.contains(''',
                split_part(p_name, ' ', 1), ''').sum()') AS pred
  FROM part)"""


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies around conversation texts.

    Every third turn has no markers; every other marked one is fenced and
    carries ``Output`` lines (two of them adjacent).
    """
    c = table(spark, sf_dir, "conversations")
    k = F.col("conv_id") + F.col("turn")
    body = F.when(
        k % 2 == 0,
        F.concat(F.lit("```python\n"), F.col("text"), F.lit("\nprint(Output)\nOutput: 1\n```")),
    ).otherwise(F.col("text"))
    reply = F.when(k % 3 == 0, F.col("text")).otherwise(
        F.concat(F.lit("Thought: t\nAction Input: "), body, F.lit("\nObservation: o")))
    return c.select(_key("conv_id", "turn").alias("rid"), reply.alias("reply"))


REPLIES_SQL = """replies AS (
  SELECT concat(conv_id, ':', turn) AS rid,
         CASE WHEN (conv_id + turn) % 3 = 0 THEN text
              ELSE concat('Thought: t' || chr(10) || 'Action Input: ',
                          CASE WHEN (conv_id + turn) % 2 = 0
                               THEN concat('```python' || chr(10), text,
                                           chr(10) || 'print(Output)' || chr(10) || 'Output: 1' || chr(10) || '```')
                               ELSE text END,
                          chr(10) || 'Observation: o') END AS reply
  FROM conversations)"""


def doc_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bank with duplicates: documents, question = text, seq = doc_id."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("text").alias("question"), "lang", "source")


def doc_split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents with a label are solved (bank, quality=1 kept by
    ``sel_correct_bank``); documents without one are the questions."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    qs = d.join(lab, "doc_id", "left_anti").select(F.col("doc_id").alias("qdoc"), "text")
    bk = d.join(lab, "doc_id").select(F.col("doc_id").alias("bdoc"), "text", "quality", "toxic")
    return qs, bk
