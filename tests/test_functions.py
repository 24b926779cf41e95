"""Column functions on literal rows: the quirks listed in the survey."""

from pyspark.sql import functions as F

from tessera.functions import replies as RP
from tessera.functions import text as TX


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("o")).first()["o"]


def test_mask_literals_closed_unclosed_and_double_quotes(spark):
    assert one(spark, TX.mask_literals("v"), "df[df['a']=='b'].c") == "df[df['MASK']=='MASK'].c"
    # an unclosed quote drops the rest of the string
    assert one(spark, TX.mask_literals("v"), "x + 'open rest") == "x + "
    assert one(spark, TX.mask_literals("v"), 'df["a"] == 1') == 'df["a"] == 1'


def test_min_ngram_empty_vocabulary_and_bigram(spark):
    assert one(spark, TX.min_ngram("v", 1), "Zebra and apple") == "and"
    assert one(spark, TX.min_ngram("v", 1), "a ! ?") is None  # no token of 2+ chars
    assert one(spark, TX.min_ngram("v", 2), "b a c d") is None  # words of one char only
    assert one(spark, TX.min_ngram("v", 2), "red fox ran") == "fox ran"
    assert one(spark, TX.min_ngram("v", 2), "solo") is None


def test_numeric_value_gate(spark):
    cases = {"1,234": 1234.0, " 7 ": 7.0, "1e5": 1e5, "+3": 3.0, ".5": 0.5, "1d": None,
             "2f": None, "1_000": None, "inf": float("inf"), " -Infinity ": float("-inf"),
             "infx": None, "abc": None, "1,2,3": 123.0}
    for raw, want in cases.items():
        assert one(spark, TX.numeric_value("v"), raw) == want, raw
    import math
    assert math.isnan(one(spark, TX.numeric_value("v"), "NaN"))


def test_py_strip_unicode_spaces(spark):
    assert one(spark, TX.py_strip("v"), "  a b\t　") == "a b"


def test_na_tokens(spark):
    assert one(spark, TX.na_to_null("v"), "NA") is None
    assert one(spark, TX.na_to_null("v"), "") is None
    assert one(spark, TX.na_to_null("v"), "n/a") is None
    assert one(spark, TX.na_to_null("v"), "NAx") == "NAx"


def test_token_budget(spark):
    assert one(spark, TX.token_budget("v", 3), "a b c") == "a b c"
    assert one(spark, TX.token_budget("v", 2), "ab, cd ef") == "ab,\n*syncopation*\n"


def test_paths(spark):
    assert one(spark, TX.table_file("v"), "csv/204-csv/1.csv") == "csv/204-csv/1.table"
    assert one(spark, TX.csv_path("v"), "x/204-csv/475_table.table") == "csv/204-csv/475.table"


def test_action_input_missing_marker(spark):
    r = "Thought: t\nAction Input: df.x \nObservation: 3"
    assert one(spark, RP.action_input("v"), r) == "df.x"
    assert one(spark, RP.action_input("v"), "  plain reply ") == "plain reply"
    assert one(spark, RP.action_input("v", on_missing="null"), "plain reply") is None
    # only the text up to the next Observation counts
    two = "Action Input: a\nObservation: 1\nAction Input: b\nObservation: 2"
    assert one(spark, RP.action_input("v"), two) == "a"


def test_strip_fence_and_output_lines(spark):
    assert one(spark, RP.strip_fence("v"), "```python\nx = 1\n```") == "\nx = 1\n"
    assert one(spark, RP.strip_fence("v"), "x```") == "x```"
    # adjacent Output lines are both dropped (the source keeps the second)
    code = "a = 1\nOutput: 1\nOutput: 2\nb"
    assert one(spark, RP.drop_output_lines("v"), code) == "a = 1\nb"


def test_program_shape(spark):
    def shape(code):
        return tuple(one(spark, RP.program_shape("v"), code))
    assert shape("x = df.a\nx.sum()") == ("block", "x.sum()")
    assert shape("res = df.a.max()") == ("assign", "res")
    assert shape(" df.a.max() ") == ("expr", "df.a.max()")
    assert shape("df.a\nOutput: 3") == ("expr", "df.a\nOutput: 3")


def test_casefold_and_newlines(spark):
    assert one(spark, TX.casefold("v"), "ÉTÉ Abc") == "été abc"
    assert one(spark, TX.decode_code_newlines("v"), "a@@@b") == "a\nb"


def test_nfkd(spark):
    from tessera.functions.unicode import nfkd_columns
    df = spark.createDataFrame([(1, "café ﬁ"), (2, "plain")], "k int, v string")
    out = {r.k: r.v for r in nfkd_columns(df, ["v"]).collect()}
    assert out[1] == "café fi" and out[2] == "plain"


def test_token_budget_prefix_fallback_and_count(spark):
    text = "a" + " " * 100 + "b, c d"
    # the 32-character prefix holds one token only: the whole text is cut
    assert one(spark, TX.token_budget("v", 2), text) == "a" + " " * 100 + "b\n*syncopation*\n"
    assert one(spark, TX.token_count("v"), text) == 5  # a b , c d
    assert one(spark, TX.token_count("v"), "x y") == 3  # no-break space is a symbol token
