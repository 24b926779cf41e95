"""Chat formatting with a grammar round trip, in DataFrame expressions only.

Grammar of a formatted conversation, turn after turn with nothing between:

    user        [INST] text [/INST]
    assistant   <s>text</s>
    other role  <<SYS>>role<</ROLE>>text<</SYS>>

The parser reads turns from left to right; a text ends at the first closing
mark of its turn, and ``\\x`` in a text or role stands for ``x``. A conversation
is first rendered as it is, parsed again and compared with its source. If they
differ, the turns that don't come back by themselves are escaped (a backslash
before each backslash and inside each control string) and the comparison is
made again; if that differed, all turns would be escaped. What still differed
would raise an error: every row returned has been read back identical.

The loss mask covers the assistant texts: ``loss_spans`` are their (start, end)
code points in the formatted text.

Defined cases: a null text or role is empty; equal turn numbers are ordered by
role and text; a null turn comes first; repeated rows are repeated turns; a null
conversation id is one conversation; an empty table gives no rows. A
conversation is one output value, so its turns meet in one row (Spark's limit
for a value, 2 GB, holds).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings of the template.
USER_OPEN, USER_CLOSE = "[INST] ", " [/INST]"
ASSISTANT_OPEN, ASSISTANT_CLOSE = "<s>", "</s>"
OTHER_OPEN, OTHER_ROLE, OTHER_CLOSE = "<<SYS>>", "<</ROLE>>", "<</SYS>>"
CONTROLS = ("[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</ROLE>>", "<</SYS>>")

_TURN = "(?s)" + "|".join(".*?".join(map(re.escape, marks)) for marks in (
    (USER_OPEN, USER_CLOSE), (ASSISTANT_OPEN, ASSISTANT_CLOSE), (OTHER_OPEN, OTHER_ROLE, OTHER_CLOSE)))


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROLS:
        text = F.replace(text, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return text


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def render(role: Column, text: Column) -> Column:
    return (F.when(role == "user", F.concat(F.lit(USER_OPEN), text, F.lit(USER_CLOSE)))
            .when(role == "assistant", F.concat(F.lit(ASSISTANT_OPEN), text, F.lit(ASSISTANT_CLOSE)))
            .otherwise(F.concat(F.lit(OTHER_OPEN), role, F.lit(OTHER_ROLE), text, F.lit(OTHER_CLOSE))))


def render_escaped(role: Column, text: Column) -> Column:
    known = role.isin("user", "assistant")
    return render(F.when(known, role).otherwise(escape(role)), escape(text))


def parts(formatted: Column) -> Column:
    """The turns as they stand; null if they don't cover the whole text."""
    found = F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0))
    return F.when(F.array_join(found, "") == formatted, found)


def _inside(part: Column, opened: int, closed: int) -> Column:
    return F.substring(part, opened + 1, F.length(part) - F.lit(opened + closed))


def _read(part: Column) -> Column:
    """(role, text as it stands) of one part."""
    at = F.locate(OTHER_ROLE, part)
    role = (F.when(part.startswith(USER_OPEN), "user").when(part.startswith(ASSISTANT_OPEN), "assistant")
            .otherwise(unescape(F.substring(part, len(OTHER_OPEN) + 1, at - F.lit(len(OTHER_OPEN) + 1)))))
    text = (F.when(part.startswith(USER_OPEN), _inside(part, len(USER_OPEN), len(USER_CLOSE)))
            .when(part.startswith(ASSISTANT_OPEN), _inside(part, len(ASSISTANT_OPEN), len(ASSISTANT_CLOSE)))
            .otherwise(F.substring(part, at + F.lit(len(OTHER_ROLE)),
                                   F.length(part) - at - F.lit(len(OTHER_ROLE) + len(OTHER_CLOSE) - 1))))
    return F.struct(role.alias("role"), text.alias("text"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted text as array<struct<role, text>>; null if it isn't in the grammar."""
    return F.transform(F.transform(parts(formatted), _read),
                       lambda t: F.struct(t["role"].alias("role"), unescape(t["text"]).alias("text")))


def _same(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


def format_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, turns (read back), loss_spans, n_escaped."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col(id_col).alias("conv_id"), F.struct(
        F.col(turn_col).alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text")).alias("t"))
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    rows = rows.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    whole = lambda one: F.array_join(F.transform("source", one), "")
    plain = lambda t: render(t["role"], t["text"])
    alone = lambda t: _same(parse(plain(t)), F.array(t))
    careful = lambda t: F.when(alone(t), plain(t)).otherwise(render_escaped(t["role"], t["text"]))
    every = lambda t: render_escaped(t["role"], t["text"])
    rows = rows.withColumn("formatted", whole(plain)).withColumn("turns", parse(F.col("formatted")))
    for one in (careful, every):
        rows = (rows.withColumn("same", _same(F.col("turns"), F.col("source")))
                .withColumn("formatted", F.when(F.col("same"), F.col("formatted")).otherwise(whole(one)))
                .withColumn("turns", F.when(F.col("same"), F.col("turns")).otherwise(parse(F.col("formatted")))))
    rows = rows.withColumn("turns", F.when(_same(F.col("turns"), F.col("source")), F.col("turns"))
                           .otherwise(F.raise_error(F.lit("a conversation does not read back"))))
    spans = F.aggregate(parts(F.col("formatted")), F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
                        lambda acc, p: F.struct(
                            (acc["at"] + F.length(p)).alias("at"),
                            F.when(p.startswith(ASSISTANT_OPEN), F.concat(acc["spans"], F.array(F.struct(
                                (acc["at"] + F.lit(len(ASSISTANT_OPEN))).alias("start"),
                                (acc["at"] + F.length(p) - F.lit(len(ASSISTANT_CLOSE))).alias("end")))))
                            .otherwise(acc["spans"]).alias("spans")), lambda acc: acc["spans"])
    return rows.select("conv_id", "formatted", "turns", spans.alias("loss_spans"))


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of formatted conversations, all read back from them; the loss is what lies under the mask."""
    # cut by the mask out of the formatted text; four bytes a code point, so a cut costs what it takes
    wide = F.encode("formatted", "UTF-32")
    cut = lambda s: F.decode(F.substring(F.col("wide"), s["start"] * 4 + 1, (s["end"] - s["start"]) * 4), "UTF-32")
    formatted = formatted.withColumn("wide", wide)
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(cut(s))), "")
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return formatted.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), sha(lines).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), sha(loss).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
