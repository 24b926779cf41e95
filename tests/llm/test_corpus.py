"""Corpus operators: brute force, round trips, held-out accuracy and awkward rows."""

import hashlib
import html
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import (chat, decontaminate, html_extract, near_dup, pieces, quality, queries, rules, secrets,
                         token_counts, url_filter)
from tessera.llm.common import slices
from tessera.llm.shingles import shingle_sets, signature

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
ODD = [(None, "a null id with some words here"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "twin words are here twice"),
       (5, "twin words are here twice"), (6, "x" * 70_000), (7, "word " * 30_000), (8, "ünï cödé 中文 😀 \x00 end")]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, an extra column with a clashing name."""
    rows = [(*r, "x", 0) for r in ODD]
    return spark.createDataFrame(rows, DOCS + ", n_words string, kept int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_slices_keep_all_rows_and_start_at_offset_zero():
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(["ab" * k for k in range(50)])], ["i", "t"])
    parts = list(slices(batch, limit=100))
    assert sum((p.column(0).to_pylist() for p in parts), []) == list(range(50))
    assert all(p.column(1).offset == 0 for p in parts) and len(parts) > 10


# -- 1: decontamination ------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_contamination(docs, items, window=10):
    grams = {}
    for item, text in items:
        words = WORD.findall(low(text))
        for k in range(max(1, len(words) - window + 1) if words else 0):
            grams.setdefault(tuple(words[k:k + window]), set()).add(str(item))
    sizes = {len(g) for g in grams}
    out = []
    for doc, text in docs:
        words, hit, found = WORD.findall(low(text)), set(), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                if (own := grams.get(tuple(words[k:k + n]))):
                    hit.update(range(k, k + n))
                    found |= own
        out.append((doc, len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_contamination_equals_brute_force(spark, block_bytes):
    rng = random.Random(3)
    vocabulary = ["the", "of", "a", "Ünder", "x1", "zebra", "I", "no"]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(k, text(rng.randint(0, 14))) for k in range(8)] + [(8, None), (9, "zebra"), (9, "x1 x1 x1"), (10, "")]
    docs = [(k, text(rng.randint(0, 60)) + rng.choice(["", "!", "\n"]) + (rng.choice(items)[1] or "")) for k in range(60)]
    docs += [(90, None), (91, ""), (91, ""), (92, "..."), docs[0]]
    out = decontaminate.contamination(spark.createDataFrame(docs, DOCS),
                                      spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted(tuple(r[n] for n in names) for r in out.collect()) == sorted(brute_contamination(docs, items))


def test_contamination_of_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "twin words are here twice"), (None, None)], "item_id long, text string")
    out = rows_of(decontaminate.contamination(odd, items))
    assert len(out) == len(ODD) and [r["n_hit"] for r in out if r["doc_id"] == 5] == [5, 5]
    assert decontaminate.contamination(empty, items).count() == 0
    assert not any(r["contaminated"] for r in rows_of(decontaminate.contamination(odd, items.limit(0))))
    kept = decontaminate.clean(odd, items)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 2


def test_long_items_and_many_hits():
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(["aa", "b", "cc", "d" * 9]) for _ in range(n)).encode()
    items = [("long", b"z" * 70_000), ("longer", b" ".join([b"y" * 80_000] * 12)), ("i", text(300)), ("j", text(40)), ("k", b"b cc")]
    search = decontaminate.WuManber(items)
    assert [t["m"] for t in search.tables][-1] <= 1024
    docs = [b"x " + items[0][1] + b" y", items[1][1], b"y" * 80_000, text(5000), b"", b"b cc"] + [text(30) for _ in range(200)]
    got = search.search(docs)
    want = brute_contamination([(k, d.decode()) for k, d in enumerate(docs)], [(i, t.decode()) for i, t in items])
    for k, row in enumerate(want):
        spans, found = got[1].get(k, ([], []))
        assert (got[0][k], decontaminate.covered(spans), len(found)) == row[1:4]


def test_tables_stay_small():
    rng = random.Random(9)
    items = [(str(k), " ".join(f"w{rng.randrange(9000)}" for _ in range(2000)).encode()) for k in range(60)]
    search = decontaminate.WuManber(items)
    arrays = [search.off, search.len, search.n_words, search.owner, search.owner_from,
              *(v for t in search.tables for k, v in t.items() if isinstance(v, np.ndarray) and k != "shift")]
    assert sum(a.nbytes for a in arrays) <= 64 * len(search.off) and max(t["shift"].nbytes for t in search.tables) <= 8 << 20


# -- 2: quality classifier ---------------------------------------------------

def test_ordinal_model_orders_grades_on_held_out_rows(spark):
    rng, words = random.Random(5), [f"w{k}" for k in range(300)]
    texts, grades = [], []
    for _ in range(900):
        grade = rng.choice([0, 1, 2])
        own = rng.choices(words, k=60) + {0: ["idiot"], 1: ["%%%"] * 8, 2: []}[grade]
        rng.shuffle(own)
        texts.append(" ".join(own).encode())
        grades.append(grade)
    rows = [quality.tokens(t) for t in texts]
    model = quality.fit(rows[:600], np.array(grades[:600]))
    tails = model.tails(np.array([model.score(t) for t in texts[600:]]))
    assert (np.diff(model.thresholds) > 0).all() and (tails[:, 0] >= tails[:, 1]).all()
    assert ((tails >= 0.5).sum(1) == np.array(grades[600:])).mean() > 0.95


def test_classifier_on_odd_rows(spark, odd, empty, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(documents, labels)
    out = rows_of(quality.classify(odd, model))
    assert len(out) == len(ODD) and [r["score"] for r in out if r["doc_id"] == 1] == [0.0]
    assert quality.classify(empty, model).count() == 0
    assert quality.train(empty, labels) is None and quality.keep(odd, None).count() == len(ODD)
    assert quality.keep(odd, model).columns == odd.columns


# -- 3: HTML extraction ------------------------------------------------------

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<nav><ul><li><a>Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Title &amp; more</h1><p><b>First   line<br>goes on<p>A &lt; B, 3 < 4 &copy 2020 &am</p>
<aside>See also</aside><script>if (a < b) { "</p>" }</script><!-- no <p>text</p> --><form><p>Mail</p></form>
<div class="comments"><p>Nice!</p></div><ul><li>one<li>two</ul></article>
<div id="sidebar"><p>Latest</p></div><footer>&copy; site</footer>"""


def test_article_of_a_single_page(spark):
    pages = [(1, "http://a.example/1", PAGE), (2, None, None), (3, "x", ""), (4, "http://b.example", "just <b>text</b> & more"),
             (4, "http://b.example", "just <b>text</b> & more")]
    out = rows_of(html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")))
    text = {r["page_id"]: r["text"] for r in out}
    assert text[1] == "Title & more First line goes on A < B, 3 < 4 © 2020 &am one two"
    assert (text[2], text[3], text[4], len(out)) == ("", "", "just text & more", 5)
    assert all(r["n_chars"] == len(r["text"]) for r in out)


def test_tree_removes_what_a_site_repeats(spark):
    own = lambda k: f"own sentence number {k} " + " ".join(f"{k}-{j}" for j in range(9))
    page = lambda k: (f"<body><div class='top{k % 2}'>Welcome to us</div><div class=text><p>{own(k)}</p><p>{own(k + 1000)}</p></div>"  # noqa: E731
                      f"<div class=end>All rights {k % 3}</div></body>")
    pages = spark.createDataFrame([(k, "http://s.example/x", page(k)) for k in range(60)], "page_id long, url string, html string")
    out = rows_of(html_extract.extract(pages))
    assert all(r["text"] == f"{own(r['page_id'])} {own(r['page_id'] + 1000)}" for r in out)
    assert html_extract.extract(pages.limit(0)).count() == 0


def extracted(spark, rows):
    pages = spark.createDataFrame([(k, url, page) for k, (url, page, _) in enumerate(rows)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in rows_of(html_extract.extract(pages))} == {k: want for k, (_, _, want) in enumerate(rows)}


def test_a_wrapper_that_repeats_a_line_keeps_what_is_below_it(spark):
    own = lambda k: f"own sentence number {k} of its page"
    rows = []
    for k in range(8):
        rows.append(("http://wrap.example/x", f"<body><div class=post><span>Posted by Staff</span><p>{own(k)}</p></div></body>", own(k)))
        rows.append(("http://body.example/x", f"<body>Welcome to us<p>{own(k)}</p></body>", own(k)))
        rows.append(("http://part.example/x", f"<body><article><div class=lead>By Staff<div class=rest>{own(k)}</div></div></article></body>", own(k)))
        rows.append(("http://ids.example/x", f"<body><div class=post>By Staff<div id=post{k}><p>{own(k)}</p></div></div></body>", own(k)))
    extracted(spark, rows)


def test_copies_of_a_page_are_no_boilerplate(spark):
    page = lambda t: f"<body><div class=text><p>{t}</p></div></body>"
    rows = [("http://copies.example/x", page("one text in four rows"), "one text in four rows")] * 4
    rows += [("http://half.example/x", page("half of the rows"), "half of the rows")] * 20
    rows += [("http://half.example/x", page(f"own text {k}"), f"own text {k}") for k in range(20)]
    mirror = "<body><section id=only><p>mirrored</p></section></body>"
    rows += [(f"http://mirror{k}.example/x", mirror, "mirrored") for k in range(6)]
    extracted(spark, rows)


def test_a_large_host_does_not_decide_for_others_and_small_hosts_share_a_tree(spark):
    rows = [("http://big.example/x", f"<html><body><p>Terms of use</p><p>All rights</p><div>big {k}</div></body></html>", f"big {k}") for k in range(60)]
    rows += [(f"http://s{k % 15}.example/x", f"<html><body><p>article {k}</p></body></html>", f"article {k}") for k in range(30)]
    rows += [(f"http://t{k}.example/x", f"<html><body><ul class=legal><li>Imprint</ul><p>text {k}</p></body></html>", f"text {k}") for k in range(9)]
    extracted(spark, rows)


def test_markup_that_never_closes_is_read_once():
    import time

    began = time.time()
    for page in ("<b" * 200_000, '<a "' * 100_000, '<a =">"' * 50_000 + "'", '<a ="x>' * 50_001, "<p a='" * 50_000, "<div>" * 50_000,
                 "<li><div>" * 30_000, "<" * 200_000 + ">", "<!--" * 50_000):
        html_extract.main_text(page)
    assert time.time() - began < 20
    text = lambda page: html_extract.main_text(page)[0]
    assert text("a < b <b") == "a < b <b" and text('x <a href="u>v">y</a> z') == "x y z" and text('<p a="b>c') == "c"


def test_names_count_only_if_all_their_words_say_so():
    page = ("<body><article><section class='related-work'>kept</section><div class='comment-list'>gone</div><div class=reply>answer</div>"
            "<div class=related>gone</div><div class='has-sidebar'>body</div><div id='site-footer'>gone</div></article></body>")
    assert html_extract.main_text(page)[0] == "kept answer body"


def brute_importance(pages):
    """(node, importance) of one host's distinct pages, from the definition."""
    seen = [html_extract.blocks(p) for p in dict.fromkeys(pages)]
    nodes = {}
    for found, styles in seen:
        for path in {b.path for b in found}:
            node = nodes.setdefault(path, {"pages": 0, "texts": {}, "styles": {}})
            node["pages"] += 1
            for t in {b.text for b in found if b.path == path}:
                node["texts"][t] = node["texts"].get(t, 0) + 1
            if path in styles:
                node["styles"][styles[path]] = node["styles"].get(styles[path], 0) + 1
    out = {}
    for path, node in nodes.items():
        m = node["pages"]
        if m < html_extract.MIN_PAGES:
            out[path] = 1.0
            continue
        weights = list(node["texts"].values())
        content = 1 - sum(k * np.log(k) for k in weights) / sum(weights) / np.log(m)
        shares = np.array(list(node["styles"].values()) or [1.0])
        shares = shares / shares.sum()
        out[path] = html_extract.CONTENT * content + (1 - html_extract.CONTENT) * float(-(shares * np.log(shares)).sum() / np.log(m))
    return out


def test_tree_equals_its_definition_and_judges_articles(spark):
    rng = random.Random(3)
    pages = []
    for k in range(12):
        extra = "".join(f"<{t}>{rng.choice(['x', 'y', str(k)])}</{t}>" for t in rng.choices(["p", "ul", "pre"], k=rng.randint(0, 4)))
        pages.append(f"<body><article><h1>Title {k}</h1><div class=byline>By our staff</div><p>text {k}<p>more {k}{extra}</article></body>")
    pages = [p.replace(f"Title {k}", f"Title {k // 6}") for k, p in enumerate(pages)]  # titles that pages share
    pages += pages[:3]
    df = spark.createDataFrame([(k, "http://h.example/", p, "x") for k, p in enumerate(pages)], "page_id long, url string, html string, text string")
    trees = html_extract.style_trees(df.select("url", "html"))
    assert {r["path"]: round(r["importance"], 9) for r in trees.collect()} == {k: round(float(v), 9) for k, v in brute_importance(pages).items()}
    low = {k for k, v in brute_importance(pages).items() if v < html_extract.LOW}
    out = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert out == {k: " ".join(b.text for b in html_extract.blocks(p)[0] if b.prose or b.path not in low) for k, p in enumerate(pages)}
    assert all("staff" not in t and "Title" in t for t in out.values())


def test_extraction_joins_the_removed_paths_when_they_are_many(spark, monkeypatch):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    small = {r["page_id"]: r["text"] for r in rows_of(html_extract.extract(pages))}
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", -1)
    assert {r["page_id"]: r["text"] for r in rows_of(html_extract.extract(pages))} == small
    for page_id, page in pages.select("page_id", "html").collect():
        inner = re.search("<article>(.*?)</article>", page, re.S)[1]
        assert small[page_id] == " ".join(html.unescape(re.sub("<[^>]+>", " ", inner)).split())


# -- 4: quality rules --------------------------------------------------------

def brute_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    inside = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            sum(x in lines[:k] for k, x in enumerate(lines)), len(inside))


def test_statistics_equal_brute_force(spark, documents):
    rng = random.Random(2)
    rows = [(k, "".join(rng.choices(["a ", "b ", "é", "\n", "a b c ", "#", "\t", "|x ", "中 "], k=rng.randint(0, 60)))) for k in range(300)]
    rows += [(r["doc_id"], r["text"]) for r in documents.limit(40).collect()] + [(1000, None), (1001, "")]
    out = rows_of(rules.statistics(spark.createDataFrame(rows, DOCS)))
    want = [(k, *brute_statistics(t)) for k, t in rows]
    assert sorted(tuple(r[c] for c in ("doc_id", *rules.STATS)) for r in out) == sorted(want)
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in out)


def test_decision_list_finds_planted_conjunctions(spark):
    rng = np.random.default_rng(1)
    x = {"a": rng.uniform(0, 1, 3000), "b": rng.uniform(0, 1, 3000), "c": rng.uniform(0, 1, 3000)}
    bad = ((x["a"] > 0.8) & (x["b"] <= 0.5)) | (x["c"] <= 0.1)
    found = rules.learn({n: v[:2000] for n, v in x.items()}, bad[:2000], list(range(2000)))
    hit = np.zeros(1000, bool)
    for rule in found:
        hit |= rule.covers({n: v[2000:] for n, v in x.items()})
    assert found and (hit == bad[2000:]).mean() > 0.97
    assert rules.learn(x, np.zeros(3000, bool), list(range(3000))) == []


def test_rules_on_odd_rows(spark, odd, empty, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    learned = rules.train(documents, labels)
    out = rows_of(rules.statistics(odd).withColumn("kept", rules.verdict(learned)))
    assert len(out) == len(ODD) and not any(r["kept"] for r in out if r["n_words"] < 50)
    assert rules.train(empty, labels) == [] and rules.statistics(empty).count() == 0


# -- 5: near duplicates ------------------------------------------------------

def plain_shingles(text):
    """The contract's sets, by Python's own strings."""
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    return {tuple(words[k:k + 4]) for k in range(max(1, len(words) - 3))} if words else set()


def brute_links(rows):
    """Pairs of row numbers whose sets have a similarity of 0.8 or more."""
    sets = [plain_shingles(t) for _, t in rows]
    return [(k, j) for k, a in enumerate(sets) for j, b in enumerate(sets[:k])
            if a and b and rows[k][0] is not None and rows[j][0] is not None
            and 100 * len(a & b) >= 80 * len(a | b)]


def brute_components(rows):
    parent = {i: i for i, _ in rows if i is not None}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, j in brute_links(rows):
        x, y = sorted((find(rows[k][0]), find(rows[j][0])))
        parent[y] = x
    return {i: find(i) for i in parent}


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 16)  # several tasks for one family
    rng = random.Random(11)
    words = [f"w{k}" for k in range(2000)]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(1, 120)))) for k in range(60)]
    base = rng.choices(words, k=150)
    for k in range(100, 220):  # a family: copies with a share of words replaced
        share = rng.choice([0.0, 0.01, 0.03, 0.06, 0.12])
        rows.append((k, " ".join(rng.choice(words) if rng.random() < share else w for w in base)))
    passage = rng.choices(words, k=80)
    rows += [(k, " ".join(passage + rng.choices(words, k=60))) for k in range(300, 330)]
    rows += [(400, None), (401, ""), (402, "one"), (403, "one"), (404, "One two three"), (405, "one two  three\n")]
    rng.shuffle(rows)
    out = rows_of(near_dup.near_duplicates(spark.createDataFrame(rows, DOCS)))
    want = brute_components(rows)
    assert {r["doc_id"]: r["component_id"] for r in out} == want and len(out) == len(rows)
    assert all(r["kept"] == (r["doc_id"] == want[r["doc_id"]]) for r in out)


def test_near_duplicates_with_repeated_ids(spark):
    rng = random.Random(29)
    words = [f"W{k}" for k in range(500)] + ["Ünd", "x\u00a0y"]
    text = lambda n: rng.choice([" ", "\t", "\n\r "]).join(rng.choices(words, k=n))
    a, b = text(40), text(40)
    rows = [(2, a), (5, a), (5, b), (7, b)]
    for k in range(60):
        base = rng.choice([a, b, text(30)])
        rows.append((rng.randrange(10, 40), rng.choice([str.upper, str.lower, str])(base) + rng.choice(["", " end", "\n"])))
    rows += [(50, None), (50, ""), (51, a + " end of it"), (51, a + " end of it"), (None, a), (52, "x"), (52, "X "), (52, "x y")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    out = rows_of(near_dup.near_duplicates(df))
    want = brute_components(rows)
    assert len(out) == len(rows) and {r["doc_id"]: r["component_id"] for r in out} == {None: None, **want}
    assert want[7] == 2 and all(r["n_shingles"] in {len(plain_shingles(t)) for i, t in rows if i == r["doc_id"]} for r in out)
    # rows are nodes: one row stays of each group of near copies
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for k, j in brute_links(rows):
        parent[find(k)] = find(j)
    groups = {}
    for k, (i, t) in enumerate(rows):
        if i is not None and plain_shingles(t):
            groups.setdefault(find(k), []).append((i, t))
    left = [tuple(r) for r in near_dup.deduplicate(df).collect()]
    assert len(left) == len(groups) + sum(i is None or not plain_shingles(t) for i, t in rows)
    for group in groups.values():
        stays = [r for r in left if r in group and r[0] is not None]
        assert len(stays) == 1 and stays[0][0] == min(i for i, _ in group)
    four = spark.createDataFrame([(2, a), (5, a), (5, b), (7, b)], DOCS)
    assert [r["component_id"] for r in rows_of(near_dup.near_duplicates(four))] == [2, 2, 2, 2]
    assert sorted(tuple(r) for r in near_dup.deduplicate(four).collect()) == [(2, a), (5, b)]


def test_near_duplicates_of_other_id_types(spark):
    df = spark.createDataFrame([(1.5, "a b c d e"), (0.5, "A b c d e"), (7.0, "z")], "doc_id decimal(9,1), text string".replace("decimal(9,1)", "double"))
    assert sorted((r["doc_id"], r["component_id"]) for r in near_dup.near_duplicates(df).collect()) == [(0.5, 0.5), (1.5, 0.5), (7.0, 7.0)]


def test_every_signature_pair_within_the_distance_shares_a_key(spark):
    rng = np.random.default_rng(4)
    symbols = rng.integers(0, 1 << 15, (200, 64))
    near = symbols.copy()
    for k in range(200):
        near[k, rng.choice(64, near_dup.MAX_DISTANCE, replace=False)] ^= 1
    pack = lambda s: (s.reshape(-1, 16, 4).astype(np.int64) << (15 * np.arange(4))).sum(2).tolist()
    pairs = spark.createDataFrame(list(zip(pack(symbols), pack(near))), "a array<long>, b array<long>")
    assert pairs.where(F.arrays_overlap(near_dup.index_keys("a"), near_dup.index_keys("b"))).count() == 200


def test_signature_distance_of_similar_sets_stays_within_the_index():
    rng = np.random.default_rng(8)
    worst = 0
    for _ in range(200):
        common = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, 50, dtype=np.uint64)])) for _ in "ab")
        x, y = (np.stack([(signature(s) >> (15 * k)) & 0x7FFF for k in range(4)], 1) for s in (a, b))
        worst = max(worst, int((x != y).sum()))
    assert worst <= near_dup.MAX_DISTANCE


def test_near_duplicates_of_odd_rows(spark, odd, empty):
    out = rows_of(near_dup.near_duplicates(odd))
    assert len(out) == len(ODD)
    by = {r["doc_id"]: r for r in out}
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert all(by[k]["component_id"] == k and by[k]["kept"] for k in range(1, 9))
    assert near_dup.near_duplicates(empty).count() == 0
    assert near_dup.deduplicate(odd).columns == odd.columns


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_near_duplicates_of_a_table_with_one_short_text(spark, n):
    text = " ".join(["one", "two", "three", "four"][:n])
    out = rows_of(near_dup.near_duplicates(spark.createDataFrame([(1, text)], DOCS)))
    assert [(r["doc_id"], r["component_id"], r["kept"]) for r in out] == [(1, 1, True)]
    alone, among = shingle_sets(pa.array([text, None])), shingle_sets(pa.array([text, "more words in the same slice"]))
    assert len(alone[0]) == 1 and alone[0].tolist() == among[0].tolist() and len(alone[1]) == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    labels = {r["node"]: r["label"] for r in near_dup.components(links).collect()}
    assert labels == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}


# -- 6: URL filters ----------------------------------------------------------

def test_deep_paths_ask_for_the_depths_of_the_lists_only(spark):
    deep = "http://a.example/" + "s/" * 16_000
    many = "http://" + "x." * 5_000 + "b.example/p"
    captures = [(1, deep, 5, "c"), (2, many, 5, "c"), (3, "http://a.example/s", 5, "c"), (4, None, 5, "c")]
    entries = [("block", "a.example/s/s", 0, True), ("allow", "a.example", 0, True), ("block", "b.example", 0, True)]
    out = url_filter.judge(spark.createDataFrame(captures, "id long, url string, day int, host string"),
                           spark.createDataFrame(entries, "list string, pattern string, day int, listed boolean"))
    assert {r["id"]: (r["decision"], r["n_active"]) for r in out.collect()} == {1: ("block", 2), 2: ("block", 1), 3: ("allow", 1), 4: ("none", 0)}


def test_the_loss_is_what_lies_under_the_mask(spark):
    turns = [(1, 0, "user", "a</s>"), (1, 1, "assistant", "\U0001f600 x</s>[INST] \\"), (1, 2, "assistant", ""), (1, 3, "assistant", "\u00e9 end")]
    rows = chat.format_conversations(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string"))
    loss = "".join(t for _, _, r, t in turns if r == "assistant")
    one = chat.digests(rows).first()
    assert (one["loss_sha256"], one["loss_chars"]) == (sha(loss), len(loss))
    moved = rows.withColumn("loss_spans", F.transform("loss_spans", lambda s: F.struct((s["start"] + 1).alias("start"), s["end"].alias("end"))))
    assert chat.digests(moved).first()["loss_sha256"] != sha(loss)


def test_labels_that_repeat_an_id_teach_once(spark):
    docs = spark.createDataFrame([(k % 7, f"text {k} " + "word " * (k % 5 + 60)) for k in range(200)], DOCS)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(7)] * 3, "doc_id long, quality int, toxic int")
    assert quality.train(docs, labels) is not None
    assert isinstance(rules.train(docs.withColumnRenamed("doc_id", "key"), labels.withColumnRenamed("doc_id", "key"), id_col="key"), list)


def test_decisions_follow_the_day_of_the_fetch(spark):
    entries = [("block", "bad.example", 10, True), ("block", "bad.example", 20, False), ("block", "bad.example", 400, True),
               ("block", "ok.example/spam", 0, True), ("allow", "www2.bad.example", 0, True), ("block", "same.example", 5, True),
               ("block", "same.example", 5, False), (None, "x", 1, True), ("block", None, 1, True)]
    captures = [(1, "http://bad.example/", 9), (2, "http://www.bad.example/", 10), (3, "https://u@bad.example:80/a", 19),
                (4, "http://bad.example", 20), (5, "http://sub.BAD.example./x", 4000), (6, "http://ok.example/spam/1?q#f", 50),
                (7, "http://ok.example/spammy", 50), (8, "http://www2.bad.example/", 15), (9, None, 15), (10, "no url", 15),
                (11, "http://bad.example/", None), (12, "http://same.example/", 5), (2, "http://www.bad.example/", 10)]
    out = url_filter.judge(spark.createDataFrame(captures, "id long, url string, day int"),
                           spark.createDataFrame(entries, "list string, pattern string, day int, listed boolean"))
    got = sorted((r["id"], r["decision"]) for r in out.collect())
    want = {1: "none", 2: "block", 3: "block", 4: "none", 5: "block", 6: "block", 7: "none", 8: "allow", 9: "none", 10: "none",
            11: "none", 12: "block"}
    assert got == sorted([*want.items(), (2, "block")])
    none = url_filter.judge(spark.createDataFrame(captures, "id long, url string, day int"),
                            spark.createDataFrame([], "list string, pattern string, day int, listed boolean"))
    assert none.where("decision <> 'none'").count() == 0 and none.count() == len(captures)


# -- 7: pieces ---------------------------------------------------------------

def test_ids_and_decoding_equal_the_library(spark, documents):
    import sentencepiece

    path = queries.piece_model()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(1)
    bits = [" ", "  ", "▁", "a", "b", "the", "\n", "\t", "é", "😀", "́", "中", "12", "\x00", "\xa0", "aaaa", "<0x41>", "<s>", "ing",
            "ﬁ", "\U00020000", "x" * 30, " " * 40, "."]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(1500)]
    texts += ["a" * 3000, " " * 2000, "abcabd" * 400, "", "\n", *[r["text"] for r in documents.collect()]]
    model = pieces.model(path)
    for text, ids in zip(texts, model.encode_texts(pa.array(texts, pa.string()))):
        want = library.encode(text)
        assert ids.tolist() == want
        assert model.decode_bytes(ids).decode() == library.decode(want) == model.decode(want)
    for _ in range(300):
        ids = [rng.choice([*range(3, 259), 264, 28705, 259, 0, 1]) for _ in range(rng.randint(0, 8))]
        assert model.decode(ids) == library.decode(ids)


def test_long_texts_in_parts_have_the_same_ids(monkeypatch):
    model, rng = pieces.model(queries.piece_model()), random.Random(5)
    texts = ["".join(rng.choices(["a", "the", " ", "  ", "\n", "▁", " x", "é "], k=200)) for _ in range(200)]
    whole = [i.tolist() for i in model.encode_texts(pa.array(texts))]
    monkeypatch.setattr(pieces, "PART_CHARS", 7)
    assert [i.tolist() for i in model.encode_texts(pa.array(texts))] == whole
    assert max(len(pieces.parts_of(t)) for t in texts) > 5


def test_pieces_of_odd_rows(spark, odd, empty):
    out = {r["doc_id"]: r for r in rows_of(pieces.encode_decode(odd, queries.piece_model(), with_output=True))}
    assert out[1]["n_tokens"] == 0 and out[1]["ids_sha256"] == out[2]["decoded_sha256"] == sha("")
    assert all(out[i]["decoded"] == (t or "") for i, t in ODD)
    assert pieces.encode_decode(empty, queries.piece_model()).count() == 0


# -- 8: token counts ---------------------------------------------------------

def brute_sections(own, text):
    """Every byte asks for its token and its line."""
    bounds, ends = token_counts.line_bounds(text).tolist(), own.ends(text).tolist()
    held = [{} for _ in ends]
    token = line = 0
    for k in range(len(text)):
        while k >= ends[token]:
            token += 1
        while k >= bounds[line + 1]:
            line += 1
        held[token][line] = held[token].get(line, 0) + 1
    counts = [0] * max(1, len(bounds) - 1)
    for h in held:
        counts[min(h, key=lambda s: (-h[s], s))] += 1
    return counts


def test_section_tokens_equal_brute_force_and_add_up(spark, documents, odd, empty):
    import public_tokenizers as P

    path, pattern = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    own = token_counts.encoder(path, pattern)
    rows = [(r["doc_id"], r["text"]) for r in documents.limit(40).collect()]
    rows += [(-1, "a\n\n\nb \n  \n c"), (-2, "\n\n"), (-3, "é\n中\n\n😀")]
    out = rows_of(token_counts.section_tokens(spark.createDataFrame(rows, DOCS), path, pattern))
    for doc, text in rows:
        mine = sorted((r["section"], r["n_tokens"]) for r in out if r["doc_id"] == doc)
        assert [n for _, n in mine] == brute_sections(own, text.encode())
        assert sum(n for _, n in mine) == len(own.encoding.encode_ordinary(text))
        assert sum(r["n_chars"] for r in out if r["doc_id"] == doc) == len(text)
    out = rows_of(token_counts.section_tokens(odd, path, pattern))
    assert {r["doc_id"]: r["n_tokens"] for r in out}[1] == 0 and len([r for r in out if r["doc_id"] == 5]) == 2
    assert token_counts.section_tokens(empty, path, pattern).count() == 0


# -- 9: secrets --------------------------------------------------------------

def brute_base(text):
    found = []
    for k, (pattern, flags, ok) in enumerate((
            (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 12),
            (r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 18), (r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 16))):
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text, flags) if ok(m)]
    return sorted(found)


def test_base_spans_equal_plain_patterns(spark, documents):
    rng = random.Random(6)
    bits = ["password", "Token", "api_key", "apikey", ": ", "=", '"', " ", "abcdef0123456789", "AKIA", "ABCDEFGHIJKLMNOP", "secret", "K", "é", "12ab", "x.y/z=="]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(3000)] + [r["text"] for r in documents.collect()]
    for text in texts:
        assert [(s, k, e) for s, k, e, _ in secrets.scan(text) if k < 3] == brute_base(text)


def test_guess_cost_is_the_least_over_all_segmentations():
    def exhaustive(value):
        """Every way to cut, with the costs of the pieces read off single-piece programs."""
        best = {0: (0.0, None)}
        for j in range(1, len(value) + 1):
            options = []
            for i in range(j):
                part = value[i:j]
                if j - i == 1:
                    options.append((best[i][0] + secrets._char_bits(part) + (0.0 if best[i][1] == "brute" else 1.0), "brute"))
                bits = secrets._RANK.get(part.lower())
                if bits is not None and j - i > 1:
                    options.append((best[i][0] + bits + 1.0 + (part != part.lower()), "word"))
            best[j] = min(options)
        return best[len(value)][0]

    for value in ("zkdragonq", "Monkeyxmaster", "qzjv", "xloveyx"):
        assert secrets.guess_bits(value) <= exhaustive(value) + 1e-9
    weak = ("password123", "P@ssw0rd!", "qwerty2020", "hunter2", "19840312", "aaaaaaaa1", "asdfghjkl1", "monkeydragon")
    strong = ("xK9#mQ2$vL", "f7Qz!pR4wT", "Zt8kWq3nBv5x")
    assert max(map(secrets.guess_bits, weak)) < 30 < secrets.MIN_BITS < min(map(secrets.guess_bits, strong))
    assert "".join(p for _, p in secrets.segment("Summer2019!xyz")[1]) == "Summer2019!xyz"


def test_context_values_add_spans_and_base_spans_stay():
    text = 'the password is xK9#mQ2$vL, pwd: hunter2 token = "0123456789abcdef0123"'
    spans = secrets.scan(text)
    kinds = [secrets.KINDS[k] for _, k, _, _ in spans]
    assert kinds == ["guess", "assign", "hex"] and text[spans[0][0]:spans[0][2]] == "xK9#mQ2$vL"
    assert [s[:3] for s in spans if s[1] < 3] == brute_base(text)
    assert secrets.redact_text(text) == 'the password is [SECRET], pwd: hunter2 token = "[SECRET]"'
    assert secrets.scan("the password is required and the token is here") == []


@pytest.mark.parametrize("text, masked", [
    ('password = "Tr0ub4dorhorse!Xy9#Q" ok', 'password = "[SECRET]" ok'), ('password = "Tr0ub4dorhorse!" ok', 'password = "[SECRET]" ok'),
    ("password=aaaaaaaaaaaa!aa, ok", "password=[SECRET], ok"), ("pwd: 84719305627184.", "pwd: [SECRET]."),
    ("passphrase: xkqzjvwpytrb", "passphrase: [SECRET]"), ('dbPassword = "x9$Kq!2zW"', 'dbPassword = "[SECRET]"'),
    ("clientSecret: q$7Lm!x2Zr", "clientSecret: [SECRET]"), ("the password is xkqzjvwpytrb", "the password is xkqzjvwpytrb"),
    ('token = "0123456789abcdef0123"', 'token = "[SECRET]"')])
def test_every_context_value_is_scored_and_masked_to_its_end(text, masked):
    assert secrets.redact_text(text) == masked and secrets.redact_text(masked) == masked
    assert [s[:3] for s in secrets.scan(text) if s[1] < 3] == brute_base(text)


PROSE = ["The secret: everything depends on it", "credentials: administrator access required", "the password: something about it",
         "the token is straightforward", "Passphrase: Whatever you like"]


def test_prose_after_a_credential_word_stays(spark):
    for text in PROSE:
        assert secrets.scan(text) == []
    assert secrets.redact_text("password is correcthorsebatterystaple") == "password is [SECRET]"
    assert secrets.redact_text("pwd: \u4e2d\u6587\u5b57\u7b26\u4e32 ok") == "pwd: [SECRET] ok"  # five characters, 50 bits
    df = spark.createDataFrame([(k, t) for k, t in enumerate(PROSE + [None, "passphrase: xkqzjvwpytrb"])], DOCS)
    letters = secrets.letter_costs(df)
    assert letters.shape == (27, 27) and letters.max() <= np.log2(52) + 1e-9
    out = {r["doc_id"]: r["text"] for r in secrets.redact(df, letters=letters).collect()}
    assert [out[k] for k in range(5)] == PROSE and out[5] is None
    assert secrets.letter_costs(df.limit(0)).shape == (27, 27)
    counted = sum(t.lower().count("th") for t in PROSE)
    assert letters[20, 8] < secrets.letter_costs(df.limit(0))[20, 8] or counted == 0


def test_letter_costs_read_like_the_corpus(spark, documents):
    letters = secrets.letter_costs(documents)
    words = [w for r in documents.select("text").limit(50).collect() for w in re.findall(r"\b[a-z]{6,12}\b", r["text"] or "")]
    rng = random.Random(1)
    noise = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=len(w))) for w in words]
    bits = lambda ws: sum(secrets.letter_bits(w, letters) for w in ws) / sum(map(len, ws))
    assert bits(words) + 0.8 < bits(noise)


def test_secrets_of_odd_rows(spark, odd, empty):
    out = rows_of(secrets.secret_spans(odd))
    assert len(out) == len(ODD) and [r["spans"] for r in out if r["doc_id"] == 1] == [""]
    assert secrets.secret_spans(empty).count() == 0
    masked = secrets.redact(odd.withColumn("n_chars", F.lit(5).cast("long")))
    assert masked.columns == [*odd.columns, "n_chars"] and masked.count() == len(ODD)


# -- 10: chat ----------------------------------------------------------------

CHATS = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (2, 0, "system", "be \\ nice<</SYS>>"),
         (2, 1, "user", None), (2, 2, "assistant", ""), (3, 5, None, "no role"), (3, 5, None, "no role"), (3, None, "user", "\\<s>\\"),
         (4, 0, "odd<</ROLE>>\nname", "x\ny 😀"), (4, 1, "user", "ends [/INST"), (None, 0, "assistant", "<</SYS>> \\\\ [INST]"),
         (5, 0, "assistant", "plain"), (5, 1, "assistant", "twice"), (6, 0, "user", "long " * 40_000)]


def test_conversations_read_back_and_loss_covers_assistant_texts(spark):
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    for conv in {c[0] for c in CHATS}:
        turns = sorted(((t is not None, t or 0), r or "", x or "") for c, t, r, x in CHATS if c == conv)
        row = out[conv]
        assert [(t["role"], t["text"]) for t in row["turns"]] == [(r, x) for _, r, x in turns]
        inside = [row["formatted"][s["start"]:s["end"]] for s in row["loss_spans"]]
        assert [re.sub(r"(?s)\\(.)", r"\1", x) for x in inside] == [x for _, r, x in turns if r == "assistant"]
    assert out[5]["formatted"] == "<s>plain</s><s>twice</s>"  # nothing to escape
    assert chat.format_conversations(df.limit(0)).count() == 0
    digest = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(df)).collect()}
    assert digest[1]["turns_sha256"] == sha("user\n</s>[INST] ok [/INST]\nassistant\n</s>[INST] ok [/INST]\n")
    assert digest[5]["loss_sha256"] == sha("plaintwice") and digest[5]["loss_chars"] == 10


def test_chat_and_url_plans_have_no_python(spark):
    for name in ("op6_url_filters", "op10_chat_format"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)
