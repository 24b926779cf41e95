"""Small semi-structured tables -> the long cell table, with Spark built-ins.

``cells(table_id, row_idx, col_idx, col_name, value)``: one DataFrame for
all tables. Parsing is ``split`` + ``posexplode`` and, in HTML, folds over the
parts of a page; rows of pipe tables are spread over tasks like any other rows.
"""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.literals import PIPE_RE, PIPE_RE2
from tessera.functions.text import py_strip
from tessera.operators.sequence import BUCKET
from tessera.sources.splits import read_pieces, running


def read_pipe_tables(spark: SparkSession, path: str) -> DataFrame:
    """Cells of every pipe-text file under ``path``; ``table_id`` is the file path.

    Files are read line by line in blocks (see ``splits``): none is one value.
    """
    lines = read_pieces(spark, path)
    return parse_pipe_lines(lines.select(F.col("file").alias("table_id"), "block", "place",
                                         F.regexp_replace("piece", "\r$", "").alias("line")))


def parse_pipe_tables(raw: DataFrame) -> DataFrame:
    """``raw(table_id, raw)``, one text a table -> cells, as ``parse_pipe_lines`` gives them."""
    lines = raw.select("table_id", F.posexplode(F.split(F.col("raw"), "\r?\n", -1)).alias("place", "line"))
    return parse_pipe_lines(lines.withColumn("block", F.floor(F.col("place") / F.lit(BUCKET))))


def parse_pipe_lines(lines: DataFrame) -> DataFrame:
    """``lines(table_id, block, place, line)``, in order of (block, place) -> cells.

    Lines split on PIPE_RE with the border columns dropped. A table where a
    row has more cells than the header (a ragged table, which the first
    reading rejects) is split on PIPE_RE2 instead, keeping every column,
    each cell stripped. A row shorter than the header ends in null cells.
    Blank lines are skipped; the first other line is the header. Rows are
    numbered by blocks, so a huge table is not one task; the header meets a
    row last, just before the row becomes cells.
    """
    def plain(line):
        parts = F.split(line, PIPE_RE, -1)
        return F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))

    def ragged(line):
        return F.transform(F.split(line, PIPE_RE2, -1), lambda x: py_strip(x))

    lines = lines.filter(F.trim(F.col("line")) != "")
    shape = (lines.groupBy("table_id")
                  .agg(F.min_by("line", F.struct("block", "place")).alias("_hline"),
                       F.max(F.size(plain(F.col("line")))).alias("_w")))
    shape = shape.withColumn("_ragged", F.col("_w") > F.size(plain(F.col("_hline"))))
    shape = shape.select("table_id", "_ragged", F.when(F.col("_ragged"), ragged(F.col("_hline")))
                         .otherwise(plain(F.col("_hline"))).alias("header"))
    data = running(lines, {"_n": F.lit(1)}, "table_id").filter(F.col("_n") > 1)
    j = data.join(shape, "table_id").withColumn(
        "cells", F.when(F.col("_ragged"), ragged(F.col("line"))).otherwise(plain(F.col("line"))))
    missing = F.greatest(F.size("header") - F.size("cells"), F.lit(0))
    cells = j.select("table_id", (F.col("_n") - 2).cast("long").alias("row_idx"), "header", F.posexplode(
        F.concat("cells", F.array_repeat(F.lit(None).cast("string"), missing))).alias("col_idx", "value"))
    return cells.select("table_id", "row_idx", F.col("col_idx").cast("long"),
                        F.get(F.col("header"), F.col("col_idx")).alias("col_name"), "value")


_HIDDEN_RE = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b[^<>]*>.*?(?:</\1\s*>|\z)"
_PART_RE = r"(?i)<(?=/?(?:table|tr|td|th)[\s/>])"
_TAG_RE = r"""(?s)^(?:[^>"']|"[^"]*+"|'[^']*+')*+>(.*)$"""
_MARKUP_RE = r"</?[A-Za-z!][^<>]*>"
_REF_RE = r"(?s)^(#[xX][0-9a-fA-F]+|#[0-9]+|[A-Za-z][A-Za-z0-9]*(?=;));?(.*)$"
FOLD = 256  # items of a list that are folded in one go
MAX_ROWSPAN, MAX_COLSPAN = 65534, 1000  # fixed values: larger spans in HTML count as these


def _references(c) -> Column:
    """Character references replaced: numbers in both bases, names closed by ``;``.

    A no-break space is a space; a number of no character is U+FFFD; unknown
    names stay as written.
    """
    names = F.from_json(F.lit(json.dumps({n: chr(v) for n, v in name2codepoint.items()} | {"apos": "'"})),
                        "map<string,string>")
    c1 = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(128, 160))

    def char(ref):
        digits = F.regexp_replace(ref, "^#[xX]?0*", "")
        code = F.when(F.length(digits) > 7, F.lit(0)).when(
            ref.rlike("^#[xX]"), F.conv(F.concat(F.lit("0"), digits), 16, 10).cast("long")).otherwise(
            F.concat(F.lit("0"), digits).try_cast("long"))
        valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
        shown = F.when(valid, code).otherwise(F.lit(0xFFFD))
        return F.when(shown.between(128, 159), F.substring(F.lit(c1), (shown - 127).cast("int"), F.lit(1))).otherwise(
            F.decode(F.unhex(F.lpad(F.hex(shown), 8, "0")), "UTF-32"))

    def piece(p, i):
        ref = F.regexp_extract(p, _REF_RE, 1)
        put = F.when(ref == "", F.lit(None)).when(ref.startswith("#"), char(ref)).otherwise(F.try_element_at(names, ref))
        return F.when(i == 0, p).when(put.isNull(), F.concat(F.lit("&"), p)).otherwise(
            F.concat(put, F.regexp_extract(p, _REF_RE, 2)))

    text = F.array_join(F.transform(F.split(c, "&", -1), piece), "")
    return F.when(F.contains(c, F.lit("&")), F.replace(text, F.lit("\u00a0"), F.lit(" "))).otherwise(c)


def _cell_text(c) -> Column:
    return py_strip(_references(F.regexp_replace(c, _MARKUP_RE, "")))


def _span(attrs, name: str, most: int) -> Column:
    n = F.regexp_extract(attrs, rf"(?i)[\s/\"']{name}\s*=\s*[\"']?\s*([0-9]{{1,9}})", 1)
    n = F.when(n != "", n).try_cast("int")  # the cast of an empty text throws inside, which takes longer than the rest
    return F.least(F.coalesce(n, F.lit(1)), F.lit(most))


def _folded(items, start, step) -> Column:
    """What ``step(carry, item)``, a struct of ``carry`` and ``out`` (a list), puts out over the items
    in order, with the last carry. Items are folded by ``FOLD``: lists grow by few copies.
    """
    def one(state, item):
        return F.aggregate(F.array(step(state["carry"], item)), state, lambda s, r: F.struct(
            r["carry"].alias("carry"), F.concat(s["out"], r["out"]).alias("out")))

    def some(state, at):
        few = F.aggregate(F.slice(items, at * FOLD + 1, F.lit(FOLD)), F.struct(
            state["carry"].alias("carry"), F.slice(F.flatten(state["out"]), 1, 0).alias("out")), one)
        return F.aggregate(F.array(few), state, lambda s, r: F.struct(
            r["carry"].alias("carry"), F.concat(s["out"], F.array(r["out"])).alias("out")))

    parts = F.sequence(F.lit(0), F.floor(F.size(items) / F.lit(FOLD)).cast("int"))
    return F.aggregate(parts, start, some, lambda s: F.struct(s["carry"].alias("carry"), F.flatten(s["out"]).alias("out")))


def _text_of(part) -> Column:
    """What follows the tag that a part begins with."""
    return F.regexp_extract(part, _TAG_RE, 1)


def _own_parts(after) -> Column:
    """The parts of a table that are its own, from the text after ``<table``: each begins with a
    tag of rows or cells, ``more`` has the texts of the tables nested behind it."""
    cut = lambda c: F.slice(F.split(F.regexp_replace(c, _PART_RE, "\u0001"), "\u0001", -1), 2, 1 << 30)
    inner = F.get(F.split(after, r"(?i)</table(?=[\s/>])", 2), F.lit(0))
    plain = F.transform(cut(inner), lambda p: F.struct(p.alias("part"), F.lit("").alias("more")))
    start = F.from_json(F.lit('{"carry": {"depth": 1, "more": []}, "out": []}'),
                        "carry struct<depth:int,part:string,more:array<string>>, out array<array<struct<part:string,more:string>>>")

    def done(c):  # the last own part, with what is nested behind it
        return F.when(c["part"].isNotNull(), F.array(F.struct(c["part"].alias("part"), F.array_join(c["more"], "").alias("more")))).otherwise(
            F.array().cast("array<struct<part:string,more:string>>"))

    def step(c, part):
        depth = c["depth"] + F.when(part.rlike("(?i)^table"), 1).when(part.rlike("(?i)^/table"), -1).otherwise(0)
        own = (c["depth"] == 1) & ~part.rlike("(?i)^/?table")
        state = lambda d, p, more: F.struct(d.cast("int").alias("depth"), p.alias("part"), more.alias("more"))
        none = F.slice(c["more"], 1, 0)
        put = lambda carry, out: F.struct(carry.alias("carry"), out.alias("out"))
        nothing = F.array().cast("array<struct<part:string,more:string>>")
        return F.when(c["depth"] <= 0, put(c, nothing)).when(own, put(state(depth, part, none), done(c))).otherwise(
            put(state(depth, c["part"], F.when(depth <= 0, c["more"]).otherwise(F.concat(c["more"], F.array(_text_of(part))))), nothing))

    nested = F.aggregate(F.array(_folded(cut(after), start, step)), F.array().cast("array<struct<part:string,more:string>>"),
                         lambda _, r: F.concat(r["out"], done(r["carry"])))
    return F.when(inner.rlike(r"(?i)<table[\s/>]"), nested).otherwise(plain)


def _cells(parts) -> Column:
    """The cells of a row as they are written, with their spans."""
    def cell(p):
        attrs = F.regexp_extract(p["part"], r"""(?s)^(?:[^>"']|"[^"]*+"|'[^']*+')*+""", 0)
        down = _span(attrs, "rowspan", MAX_ROWSPAN)
        return F.struct(p["part"].rlike("(?i)^td").alias("data"),
                        F.greatest(_span(attrs, "colspan", MAX_COLSPAN), F.lit(1)).alias("wide"),
                        F.when(down == 0, MAX_ROWSPAN).otherwise(down).alias("down"),
                        _cell_text(F.concat(_text_of(p["part"]), p["more"])).alias("v"))

    return F.transform(F.filter(parts, lambda p: p["part"].rlike("(?i)^t[dh]")), cell)


def _table_rows(pages: DataFrame, key: str) -> DataFrame:
    """``table_id, _rows`` of each page's first table: the rows that have cells, numbered among all rows.

    Rows of one key with the same page are read once.
    """
    t = pages.filter(F.col("html").rlike(r"(?i)<table[\s/>]")).groupBy(
        F.col(key).alias("table_id"), F.md5("html").alias("_h")).agg(F.any_value("html").alias("_t"))
    src = F.replace(F.regexp_replace("_t", _HIDDEN_RE, ""), F.lit("\u0001"), F.lit(""))
    t = t.select("table_id", F.get(F.split(src, r"(?i)<table(?=[\s/>])", 2), F.lit(1)).alias("_after")).filter("_after is not null")
    t = t.select("table_id", _own_parts(F.col("_after")).alias("_parts"))
    starts = F.filter(F.sequence(F.lit(0), F.size("_parts")), lambda i: F.get(F.col("_parts"), i)["part"].rlike("(?i)^tr"))
    t = t.select("table_id", "_parts", F.concat(F.array(F.lit(0)), starts, F.array(F.size("_parts"))).alias("_at"))

    def row(at, i):
        until = F.get(F.col("_at"), i + 1)
        return F.struct(i.alias("row"), _cells(F.slice("_parts", at + 1, until - at)).alias("cells"))

    rows = F.transform(F.slice("_at", 1, F.size("_at") - 1), row)
    return t.select("table_id", F.filter(rows, lambda r: F.size(r["cells"]) > 0).alias("_rows"))


def _place(carry, row) -> Column:
    """One row of the grid: its cells go to the columns that no cell above covers.

    ``carry`` has the last row that a cell reaches and, for each column, the last row
    that its cell covers and its text; a row that no cell above reaches begins anew.
    """
    at = row["row"].cast("long")

    def covered(rest):
        free = F.array_position(F.transform(rest, lambda c: c["until"] < at), F.lit(True)).cast("int")
        return F.slice(rest, F.lit(1), F.when(free > 0, free - 1).otherwise(F.size(rest)))

    def placed(above):
        def after(done):
            return F.slice(above, F.size(done) + 1, F.size(above))

        def put(done, cell):
            mine = F.struct((at + cell["down"] - 1).alias("until"), cell["v"].alias("v"))
            return F.concat(done, covered(after(done)), F.array_repeat(mine, cell["wide"]))

        return F.aggregate(F.array(F.aggregate(row["cells"], none, put)), none, lambda _, done: F.concat(done, F.transform(
            after(done), lambda c: F.struct(c["until"].alias("until"), F.when(c["until"] >= at, c["v"]).alias("v")))))

    none = F.slice(carry["cols"], 1, 0)
    above = F.when(carry["reach"] >= at, carry["cols"]).otherwise(none)
    return F.aggregate(F.array(above), none, lambda _, above: placed(above))


def parse_html_tables(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """The first ``<table>`` of each page -> cells of its grid.

    A cell with ``rowspan`` or ``colspan`` stands in every place it covers; cells
    of later rows move to the next free column; ``rowspan=0`` reaches to the end.
    Header = the last all-``th`` row before the first data row (the second
    level of a two-level header; a footer in ``th`` is no header); data rows =
    rows holding a ``td``. A nested table is text of its cell. Comments, scripts
    and styles are skipped, character references decoded. A table without an end
    reaches to the page's end. Pages without a table, or null, give no rows; rows of one
    key with the same page are read once. Other columns of ``pages`` are not read.

    A page is one value, and so are its parts, rows and grid: all is done where the
    page lies, and rows are folded in order.
    """
    carries = "struct<reach:bigint,cols:array<struct<until:bigint,v:string>>>"
    start = F.from_json(F.lit('{"carry": {"reach": -1, "cols": []}, "out": []}'),
                        f"carry {carries}, out array<array<struct<data:boolean,vals:array<string>>>>")

    def step(carry, row):
        data = F.exists(row["cells"], lambda c: c["data"])
        reach = F.greatest(carry["reach"], row["row"] + F.array_max(F.transform(row["cells"], lambda c: c["down"])).cast("long") - 1)
        return F.aggregate(F.array(_place(carry, row)), F.lit(None).cast(f"struct<carry:{carries},out:array<struct<data:boolean,vals:array<string>>>>"),
            lambda _, g: F.struct(F.struct(reach.alias("reach"), g.alias("cols")).alias("carry"), F.array(F.struct(data.alias("data"), F.transform(g, lambda c: c["v"]).alias("vals"))).alias("out")))

    t = _table_rows(pages, key)
    t = t.select("table_id", _folded(F.col("_rows"), start, step)["out"].alias("_grid"))
    first = F.array_position(F.transform("_grid", lambda r: r["data"]), F.lit(True)).cast("int")
    # outer: an inferred filter on the lists would compute them twice
    t = t.select("table_id", F.when(first > 1, F.get(F.col("_grid"), first - 2)["vals"]).alias("_head"),
                 F.filter("_grid", lambda r: r["data"]).alias("_data"))
    t = t.select("table_id", "_head", F.posexplode_outer("_data").alias("row_idx", "_row")).filter("row_idx is not null")
    c = t.select("table_id", "row_idx", "_head", F.posexplode(F.col("_row.vals")).alias("col_idx", "value"))
    return c.select("table_id", F.col("row_idx").cast("long"), F.col("col_idx").cast("long"),
                    F.get(F.col("_head"), F.col("col_idx")).alias("col_name"), "value")
