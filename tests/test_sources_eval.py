"""Sources, rendering, evaluation and the driver contract."""

import json
import os

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.operators import evaluate as EV
from tessera.operators import render as R
from tessera.session import scratch_path
from tessera.sources import files, tables

from conftest import SF_CHECK, SF_SMALL


def test_pipe_table_plain_and_ragged(spark):
    raw = spark.createDataFrame([
        ("t1", "| a | b |\n| 1 | x y |\n|  | 2 |\n"),
        ("t2", "| h1 | h2 |\n| 1 | 2 | 3 |\n"),  # a row wider than the header
    ], "table_id string, raw string")
    cells = {(r.table_id, r.row_idx, r.col_idx): (r.col_name, r.value)
             for r in tables.parse_pipe_tables(raw).collect()}
    assert cells[("t1", 0, 1)] == ("b", "x y")
    assert cells[("t1", 1, 0)] == ("a", "")
    # ragged: fallback separator keeps every piece, stripped
    assert ("t2", 0, 0) in cells and cells[("t2", 0, 0)][1] == "| 1"


def test_html_table_two_level_header(spark):
    html = ("<html><table><tr><th colspan=2>Top</th></tr><tr><th>Name</th><th>N</th></tr>"
            "<tr><td><a href='x'>A &amp; B</a></td><td> 3 </td></tr></table>"
            "<table><tr><th>ignored</th></tr></table></html>")
    pages = spark.createDataFrame([(1, html), (2, "<p>no table</p>")], "page_id long, html string")
    rows = tables.parse_html_tables(pages).collect()
    assert [(r.table_id, r.row_idx, r.col_idx, r.col_name, r.value) for r in rows] == [
        (1, 0, 0, "Name", "A & B"), (1, 0, 1, "N", "3")]


def test_bank_json_array_file(spark):
    path = scratch_path(spark, "bank-array")
    local = path[len("file:"):] if path.startswith("file:") else path
    os.makedirs(local)
    recs = [{"table_id": "csv/1.csv", "code": "df.a@@@df.b", "question": "Q", "prompt": "p",
             "answer": 12, "prediction": "12", "correct": 1, "reply": "r"},
            {"table_id": "csv/2.csv", "code": "c", "question": "Q2", "prompt": "p",
             "answer": "x", "prediction": "y", "correct": -1, "reply": "r"}]
    with open(os.path.join(local, "bank.json"), "w") as f:
        json.dump(recs, f, indent=2)
    df = files.read_bank_json(spark, path, array_file=True)
    got = sorted((r.question, r.answer, r.correct) for r in df.collect())
    assert got == [("Q", "12", 1), ("Q2", "x", -1)]  # answers stay strings


def test_bank_json_array_of_many_blocks_equals_the_whole_file_reader(spark):
    path = scratch_path(spark, "bank-blocks")
    local = path[len("file:"):] if path.startswith("file:") else path
    os.makedirs(local)
    odd = ['{"a": [1, 2}', 'quote " and \\ slash', '}\\"}{', "", "line\nend", "\u00e9\U0001f600", "[" * 40, "\\\\", None]
    recs = [{"table_id": f"csv/{i % 7}.csv", "question": odd[i % len(odd)], "prompt": odd[(i // 3) % len(odd)],
             "code": "x}" * (i % 50), "answer": i, "correct": i % 2, "seq": i, "more": {"deep": [{"q": odd[i % 4]}]}}
            for i in range(700)]
    for name, indent, part in (("a", None, recs[:400]), ("b", 1, recs[400:]), ("empty", None, [])):
        with open(os.path.join(local, name + ".json"), "w") as f:
            json.dump(part, f, indent=indent, ensure_ascii=False)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
        assert files.read_pieces(spark, path, "}").rdd.getNumPartitions() > 8
        got = sorted(files.read_bank_json(spark, path, array_file=True).collect(), key=lambda r: r.seq)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = spark.read.schema(files.BANK_SCHEMA).option("multiLine", True).json(path)
    assert got == sorted(whole.collect(), key=lambda r: r.seq) and len(got) == 700


def test_bank_json_array_odd_files(spark):
    def read(text):
        path = scratch_path(spark, "bank-odd")
        local = path[len("file:"):] if path.startswith("file:") else path
        os.makedirs(local)
        with open(os.path.join(local, "x.json"), "w") as f:
            f.write(text)
        return sorted((r.question for r in files.read_bank_json(spark, path, array_file=True).collect()), key=str)

    assert read("") == [] and read("[]") == [] and read(" [ ]\n") == []
    assert read('{"question": "one"}') == ["one"]
    assert read('[null, 3, "a{", {"question": "x"}, {}]') == [None, "x"]
    assert read('[{"question": "x"}, {"question": "cut') == ["x"]
    assert read('[{"question": "x"}, {"question": "cut"') == ["x"]
    assert read('[{"question": "x"}]\n[{"question": "y"}]\n') == ["x", "y"]


def test_pipe_file_of_many_blocks(spark):
    path = scratch_path(spark, "pipe-blocks")
    local = path[len("file:"):] if path.startswith("file:") else path
    os.makedirs(local)
    with open(os.path.join(local, "big.table"), "w") as f:
        f.write("\r\n| n | word |\r\n" + "".join(f"| {i} | w{i} |\r\n" + "\r\n" * (i % 3 == 0) for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
        cells = tables.read_pipe_tables(spark, path).toPandas()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    cells = cells.sort_values(["row_idx", "col_idx"])
    assert list(cells.row_idx) == [i for i in range(3000) for _ in (0, 1)]
    assert list(cells.value) == [v for i in range(3000) for v in (str(i), f"w{i}")]
    assert list(cells.col_name[:2]) == ["n", "word"]


def _grid(spark, html):
    rows = tables.parse_html_tables(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()
    wide = {}
    for r in rows:
        wide.setdefault(r.row_idx, {})[r.col_idx] = r.value
    names = {r.col_idx: r.col_name for r in rows}
    return ([names[c] for c in sorted(names)],
            [[wide[r].get(c) for c in range(max(wide[r]) + 1)] for r in sorted(wide)])


def test_html_spans_nested_tables_and_references(spark):
    head = "<tr><th>a</th><th>b</th><th>c</th></tr>"
    # a cell down three rows in the middle column, one across after it
    assert _grid(spark, f"<table>{head}<tr><td>1<td rowspan=3>m<td>2</tr><tr><td>3<td>4</tr><tr><td>5</td><td>6</table>") == (
        ["a", "b", "c"], [["1", "m", "2"], ["3", "m", "4"], ["5", "m", "6"]])
    assert _grid(spark, f"<table>{head}<tr><td colspan=2>w</td><td>x</td></tr><tr><td>1</td><td>2</td><td>3</td></tr></table>")[1] == [
        ["w", "w", "x"], ["1", "2", "3"]]
    # both at once; the next row starts beyond the block; a row without cells still counts
    assert _grid(spark, f"<table>{head}<tr><td rowspan='2' colspan=\"2\">q</td><td>x</td></tr><tr><td>y</td></tr></table>")[1] == [
        ["q", "q", "x"], ["q", "q", "y"]]
    assert _grid(spark, f"<table>{head}<tr><td rowspan=2>q</td><td>x</td></tr><tr></tr><tr><td>y</td></tr></table>")[1] == [["q", "x"], ["y"]]
    # a covered last column ends a short row; places that nothing covers are null
    assert _grid(spark, f"<table>{head}<tr><td>1</td><td>2</td><td rowspan=2>z</td></tr><tr><td>3</td></tr></table>")[1] == [
        ["1", "2", "z"], ["3", None, "z"]]
    # a heading cell over two levels
    assert _grid(spark, "<table><tr><th rowspan=2>k</th><th colspan=2>top</th></tr><tr><th>l</th><th>r</th></tr>"
                 "<tr><td>1</td><td>2</td><td>3</td></tr></table>") == (["k", "l", "r"], [["1", "2", "3"]])
    nested = "<table><tr><td>in</td><td>ner</td></tr></table>"
    assert _grid(spark, f"</table><TABLE>{head}<tr><td>1</td><td>x{nested}y</td><td>3</td></tr><tr><td>4</td></tr></table>")[1] == [
        ["1", "xinnery", "3"], ["4"]]
    text = "&#233;&#xe9;&eacute; &amp;lt; &#128; &#0;&#xD800;&#99999999; &nope; &#65 &AT&T &minus;"
    assert _grid(spark, f"<table><tr><th>a</th></tr><tr><td title='1 > 0'>{text}</td></tr></table>")[1] == [
        ["\u00e9\u00e9\u00e9 &lt; \u20ac \ufffd\ufffd\ufffd &nope; A &AT&T \u2212"]]
    assert _grid(spark, "<!-- <table><tr><td>no</td></tr></table> --><table><tr><td>1 < 2</td></tr>") == ([None], [["1 < 2"]])


def test_html_tables_odd_rows(spark):
    t = "<table><tr><th>a</th></tr><tr><td>1</td></tr></table>"
    pages = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, t, "x"), (3, t, "y"), (None, t, "z"), (4, "<table>", "x"),
                                   (5, "<td " * 200_000 + "<table" * 1000, "x")], "page_id long, html string, value string")
    rows = tables.parse_html_tables(pages).collect()
    assert sorted(((r.table_id, r.value) for r in rows), key=str) == [(3, "1"), (None, "1")]
    many = "<table>" + "".join(f"<tr><td>{i}</td><td>v</td></tr>" for i in range(20_000)) + "</table>"
    assert tables.parse_html_tables(spark.createDataFrame([(1, many)], "page_id long, html string")).count() == 40_000


def test_questions_tsv_round_trip_with_newlines(spark):
    q = spark.createDataFrame([("1", "a\tb\nc", "csv/1.csv", "x"), ("2", 'say "hi"', "csv/2.csv", None),
                               ("3", "back\\\\slash \\n not a line\r", "c", "\\")], files.QUESTION_SCHEMA)
    path = scratch_path(spark, "qtsv")
    files.write_questions_tsv(q, path)
    back = files.read_questions_tsv(spark, path)
    assert sorted(back.collect()) == sorted(q.collect())


def test_render_and_budget(spark):
    cells = spark.createDataFrame([
        ("t", 0, 0, "a", "1"), ("t", 0, 1, "b", None), ("t", 1, 0, "a", "2"), ("t", 1, 1, "b", "y")],
        "table_id string, row_idx long, col_idx long, col_name string, value string")
    t = R.render_cells(cells).first()
    assert t.text == " | a | b | \n | 1 | nan | \n | 2 | y | " and t.n_rows == 2
    head = R.render_head(R.rows_from_cells(cells), 2).first().text
    assert head == " | a | b | \n | 1 | nan | "
    full = R.render_rows(R.rows_from_cells(cells)).first().text
    cut = R.budgeted_tables(R.rows_from_cells(cells), 4).first().text
    assert cut == full[:len(" | a | b")] + "\n*syncopation*\n"


def test_exact_match_nulls_never_match(spark):
    gold = spark.createDataFrame([(1, "a"), (2, None), (3, " b ")], "k long, answer string")
    pred = spark.createDataFrame([(1, "a "), (2, None), (3, "b")], "k long, prediction string")
    r = EV.exact_match(gold, pred, "k").first()
    assert (r.n, r.hits) == (3, 2)


def test_progress_with_hot_run_matches_pandas(spark):
    rng = np.random.default_rng(5)
    n = 3000
    run = np.where(rng.random(n) < 0.6, 0, rng.integers(1, 20, n))  # run 0 holds most items
    lab = rng.choice([1, 0, -1], n)
    pdf = pd.DataFrame({"run": run, "seq": rng.permutation(n), "label": lab})
    df = spark.createDataFrame(pdf)
    got = EV.progress(df, "run", "seq", every=50).toPandas().sort_values(["run", "batch"])
    p = pdf.sort_values(["run", "seq"]).copy()
    p["pos"] = p.groupby("run").cumcount()
    p["batch"] = p["pos"] // 50
    b = p.groupby(["run", "batch"]).agg(n=("label", "size"), c1=("label", lambda x: (x == 1).sum()),
                                        c0=("label", lambda x: (x == 0).sum()),
                                        cerr=("label", lambda x: (x == -1).sum())).reset_index()
    for c in ["n", "c1", "c0", "cerr"]:
        b[c] = b.groupby("run")[c].cumsum()
    assert got["n_items"].tolist() == b["n"].tolist()
    assert got["c1"].tolist() == b["c1"].tolist() and got["cerr"].tolist() == b["cerr"].tolist()


def test_attempts_fold(spark):
    rows = [(1, 1, "r1", False), (1, 2, "r2", True), (1, 3, "r3", True),
            (2, 1, "s1", False), (2, 2, "s2", False), (2, 3, "s3", False), (2, 4, "s4", True),
            (3, 1, "t1", False)]
    df = spark.createDataFrame(rows, "item long, n long, reply string, ok boolean")
    got = {r.item: (r.reply, r.tries) for r in EV.attempts_fold(df, "item", "n", "reply", "ok").collect()}
    assert got == {1: ("r2", 2), 2: ("s4", 3), 3: ("t1", 1)}
    hit = EV.attempts_until_match(df.withColumnRenamed("ok", "hit"), "item", "n", "reply", "hit", cap=1)
    assert {r.item: (r.reply, r.hit) for r in hit.collect()} == {
        1: ("r1", False), 2: ("s1", False), 3: ("t1", False)}


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["qid", "prompt"]
    assert df.count() > 0
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 50


def test_oracles_agree_on_a_sample_of_queries(spark):
    import __spark_entry__ as E
    con = duckdb.connect()
    for t in ["conversations", "documents", "embeddings", "labels", "part", "orders", "nation", "events"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    for key in ["txt_sparse_topk", "vec_topk", "sim_keyword_gate", "code_mask_literals",
                "reply_program_shape", "eval_progress"]:
        sp = E.queries()[key](spark, SF_SMALL).toPandas()
        dd = con.sql(E.oracle_sql()[key]).df()
        cols = sorted(sp.columns)
        assert cols == sorted(dd.columns), key
        norm = lambda df: sorted(map(repr, df[cols].astype(str).itertuples(index=False)))
        assert norm(sp) == norm(dd), key


def test_read_pipe_table_files_and_pages_without_tables(spark):
    path = scratch_path(spark, "pipe-files")
    local = path[len("file:"):] if path.startswith("file:") else path
    os.makedirs(local)
    with open(os.path.join(local, "t1.table"), "w") as f:
        f.write("| a | b |\n| 1 | 2 |\n")
    cells = tables.read_pipe_tables(spark, path).collect()
    assert [(r.col_name, r.value) for r in sorted(cells, key=lambda r: r.col_idx)] == [("a", "1"), ("b", "2")]
    assert cells[0].table_id.endswith("t1.table")
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    assert tables.parse_html_tables(pages).count() == 0  # the provided pages hold no <table>


def test_pipe_table_rows_are_dense_after_blank_lines(spark):
    raw = spark.createDataFrame([("t", "| a |\n\n| 1 |\n   \n| 2 |\n")], "table_id string, raw string")
    rows = sorted((r.row_idx, r.value) for r in tables.parse_pipe_tables(raw).collect())
    assert rows == [(0, "1"), (1, "2")]


def test_heads_and_budget_rank_rows_whatever_their_index(spark):
    rows = spark.createDataFrame([("t", 9, "c", "h"), ("t", 5, "a", "h"), ("t", 7, "b", "h"), (None, 3, "x", "h")],
                                 "table_id string, row_idx long, row_text string, header_text string")
    two = {r.table_id: (r.n_rows, r.text) for r in R.render_head(rows, 3).collect()}
    assert two == {"t": (2, " | h | \n | a | \n | b | "), None: (1, " | h | \n | x | ")}
    both = {(r.table_id, r.n_text_rows): (r.n_rows, r.text) for r in R.render_heads(rows, [2, 3]).collect()}
    assert both[("t", 3)] == two["t"] and both[("t", 2)] == (1, " | h | \n | a | ") and len(both) == 4
    assert R.budgeted_tables(rows, 1000).filter("table_id = 't'").first().n_rows == 3


def test_positions_by_times_and_strings_with_a_hot_key(spark):
    from tessera.operators.sequence import positions
    rows = (spark.range(6000).withColumn("k", F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 > 0, F.concat(
        F.lit("k"), (F.col("id") % 40).cast("string")))).withColumn("o", F.xxhash64("id")))
    for order in (F.timestamp_micros(F.col("o") % 10**15), F.format_string("%020d", F.abs("o")), F.col("o").cast("decimal(20,0)")):
        got = positions(rows.withColumn("at", order).repartition(7), "k", ["at", "id"], "pos").toPandas().sort_values(["at", "id"])
        assert len(got) == 6000
        assert (got.pos == got.groupby("k", dropna=False).cumcount() + 1).all()


def test_positions_keep_rows_without_a_key(spark):
    from tessera.operators.sequence import BUCKET, positions, running_sum
    rows = [("a", BUCKET * k + k) for k in range(5)] + [(None, 3), (None, 10 * BUCKET)]
    out = positions(spark.createDataFrame(rows, "k string, o long"), "k", ["o"])
    assert sorted((r.o, r.pos) for r in out.filter("k is null").collect()) == [(3, 1), (10 * BUCKET, 2)]
    assert [r.pos for r in out.filter("k = 'a'").orderBy("o").collect()] == [1, 2, 3, 4, 5]
    sums = running_sum(spark.createDataFrame(rows, "k string, o long").withColumn("v", F.lit(2)), "k", ["o"], ["v"])
    assert sums.agg(F.max("cum_v")).first()[0] == 10
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Python" not in plan


def test_unanswered_and_repeated_predictions_are_counted(spark):
    gold = spark.createDataFrame([(1, "a"), (2, "b"), (3, "e\u0301")], "k long, answer string")
    pred = spark.createDataFrame([(1, "a"), (1, "a"), (3, "\u00e9"), (9, "z")], "k long, prediction string")
    r = EV.exact_match(gold, pred, "k").first()
    assert (r.n, r.hits) == (3, 2)  # composed and decomposed spellings are equal
    one = pred.withColumnRenamed("prediction", "p1")
    two = spark.createDataFrame([(2, "b")], "k long, p2 string")
    c = EV.compare_runs(gold, one, two, "k").first()
    assert (c.both, c.only1, c.only2, c.neither) == (0, 2, 1, 0)
    assert sorted(r.k for r in EV.only_first_right(gold, one, two, "k").collect()) == [1, 3]


def test_html_footer_is_no_header_and_short_pipe_rows_end_in_nulls(spark):
    html = ("<table><tr><th>Name</th><th>N</th></tr><tr><td>A</td><td>1 &ndash; 2</td></tr>"
            "<tr><th>Total</th><th>9</th></tr></table>")
    rows = tables.parse_html_tables(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()
    assert [(r.col_name, r.value) for r in rows] == [("Name", "A"), ("N", "1 – 2")]
    raw = spark.createDataFrame([("t", "| a | a | c |\n| NA | \u00e9 |\n| 1,000 | x | 2 |\n")], "table_id string, raw string")
    short = {(r.row_idx, r.col_idx): r.value for r in tables.parse_pipe_tables(raw).collect()}
    assert short[(0, 2)] is None and len(short) == 6
    from tessera.operators.cells import ingest
    clean = {(r.row_idx, r.col_idx): (r.col_name, r.value, r.num) for r in ingest(raw).collect()}
    assert clean[(0, 0)] == ("a", None, None) and clean[(0, 1)] == ("a.1", "e\u0301", None)
    assert clean[(1, 0)] == ("a", "1,000", 1000.0) and clean[(1, 2)] == ("c", "2", 2.0)


def test_a_cluster_needs_a_shared_checkpoint_folder():
    import pytest

    from tessera.session import ensure_checkpoint_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_html_tables_are_read_where_the_page_lies(spark):
    """One shuffle of pages and no windows over their parts; folds cross their blocks (``FOLD`` items)."""
    n = 2 * tables.FOLD + 7
    spanned = "<table><tr><th>k<th>v</tr><tr><td rowspan=0>all<td>0" + "".join(f"<tr><td>{i}" for i in range(1, n)) + "</table>"
    nested = "<table><tr><td>a" + "".join(f"<table><tr><td>{i}</table>" for i in range(n)) + "z</td><td>b</td></table>"
    # the first row's last cell reaches to the end under a cell that is put over it
    over = "<table><tr><td>1<td rowspan=0>2</tr><tr><td colspan=3>3</tr><tr><td>4</tr></table>"
    pages = spark.createDataFrame([("s", spanned), ("n", nested), ("o", over)], "page_id string, html string")
    cells = tables.parse_html_tables(pages)
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1
    rows = sorted((r["table_id"], r["row_idx"], r["col_idx"], r["col_name"], r["value"]) for r in cells.filter("table_id = 's'").collect())
    assert rows == [("s", i, c, name, value) for i in range(n) for c, name, value in ((0, "k", "all"), (1, "v", str(i)))]
    got = {(r["table_id"], r["row_idx"], r["col_idx"]): r["value"] for r in cells.filter("table_id <> 's'").collect()}
    assert got == {("n", 0, 0): "a" + "".join(map(str, range(n))) + "z", ("n", 0, 1): "b",
                   ("o", 0, 0): "1", ("o", 0, 1): "2", ("o", 1, 0): "3", ("o", 1, 1): "3", ("o", 1, 2): "3",
                   ("o", 2, 0): "4", ("o", 2, 1): None, ("o", 2, 2): None}
