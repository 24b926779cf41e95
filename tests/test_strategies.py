"""Every retrieval strategy end to end on the smallest fixture tables."""

import pytest
from pyspark.sql import functions as F

from tessera.plans import roles, strategies

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def inputs(spark):
    q = roles.questions(spark, SF_SMALL).withColumn(
        "prediction", F.concat(F.lit("df[df['turn']=='"), F.col("turn").cast("string"), F.lit("'].text")))
    b = roles.bank(spark, SF_SMALL).withColumn("correct", F.lit(1))
    rows = roles.conversation_rows(spark, SF_SMALL)
    return q, b, rows


@pytest.mark.parametrize("strategy", ["question", "keyword", "code", "two_signal", "table",
                                      "agent"])
def test_strategy_gives_one_prompt_per_question(spark, inputs, strategy):
    q, b, rows = inputs
    out = strategies.build_prompts(strategy, q, b, rows, ["conv_id", "turn"])
    got = out.select("qid", "prompt").collect()
    assert len(got) == q.count()
    assert len({r.qid for r in got}) == len(got)
    assert all(r.prompt for r in got)


def test_self_check_and_row_selection(spark, inputs):
    q, b, rows = inputs
    sc = strategies.build_prompts("self_check", q, b, rows, ["conv_id", "turn"])
    n_distinct = b.select(F.lower("question")).distinct().count()
    assert sc.count() == n_distinct
    ag = strategies.build_prompts("agent", q, b, rows, ["conv_id", "turn"], row_selection=True)
    assert ag.count() == q.count()


def test_bank_filtered_to_correct(spark, inputs):
    q, b, rows = inputs
    none_correct = b.withColumn("correct", F.lit(0))
    out = strategies.build_prompts("question", q, none_correct, rows, ["conv_id", "turn"])
    # zero-shot: every question still gets a prompt, with no examples
    assert out.count() == q.count()
    assert out.filter(F.col("prompt").contains("/* Question: ") & F.col("prompt").contains("Code: ")).count() == 0


def test_nfkd_and_sample_options(spark, inputs):
    q, b, rows = inputs
    out = strategies.build_prompts("question", q, b, rows, ["conv_id", "turn"], nfkd=True, sample=5)
    got = out.collect()
    assert len(got) == min(5, q.count())
    import unicodedata
    assert all(unicodedata.normalize("NFKD", r.prompt) == r.prompt for r in got)


def test_only_tables_asked_for_are_rendered(spark):
    rows = spark.createDataFrame([(f"t{i}", r, f"{r} | x") for i in range(6) for r in range(3)] + [(None, 0, "0 | x")],
                                 "table_id string, row_idx long, row_text string").withColumn("header_text", F.lit("h | x"))
    q = spark.createDataFrame([("a", "t1"), ("b", "t1"), ("c", "t4"), ("d", "none"), ("e", None)], "qid string, table_id string")
    got = {r.table_id: r.text for r in strategies.asked_tables(q, rows).collect()}
    assert set(got) == {"t1", "t4"} and got["t1"] == " | h | x | \n | 0 | x | \n | 1 | x | \n | 2 | x | "


def test_examples_are_read_at_the_positions_found(spark, inputs):
    q, b, rows = inputs
    asked = []

    def lookup(at):
        asked.append(at.distinct().count())
        return roles.bank(spark, SF_SMALL, at)

    for strategy in ("keyword", "table"):
        texts = [sorted((r.qid, r.prompt) for r in strategies.build_prompts(strategy, q, b, rows, ["conv_id", "turn"], **kw).select("qid", "prompt").collect())
                 for kw in ({}, {"lookup": lookup})]
        assert texts[0] == texts[1]
    assert len(asked) == 2 and max(asked) <= q.count() < b.count()
    at = spark.createDataFrame([(r.conv_id, r.turn) for r in b.limit(3).collect()], "conv_id long, turn long")
    assert roles.bank(spark, SF_SMALL, at).join(b, ["bid", "question", "code"]).count() == roles.bank(spark, SF_SMALL, at).count() == 3


def test_examples_repeated_at_one_position_stay_repeated(spark):
    twice = [("b1", 1, 0, "Sum of x", "x.sum()")] * 2 + [("b0", 0, 0, "sum OF x", "old"), ("b2", 2, 0, None, "none"), ("b3", None, 0, "mean of y", "y.mean()")]
    bank = spark.createDataFrame(twice, "bid string, conv_id long, turn long, question string, code string")
    dbank = strategies.dedup(bank, ["conv_id", "turn"])
    ranked = spark.createDataFrame([("q", "b1", 1), ("q", "b2", 2), ("r", "b3", 1), ("r", "b1", 2)], "qid string, bid string, rank long")
    got = strategies._chosen(ranked, dbank, bank, ["conv_id", "turn"])
    kept = lambda df: sorted((r.bid, r.nl or "", r.code) for r in df.collect())
    assert kept(got) == kept(dbank.select("bid", "nl", "code")) and got.count() == 4
