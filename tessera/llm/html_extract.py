"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: an element node is a path of
(tag, class, id) labels from the root. For every node the merged tree knows in
how many pages it occurs (m), the distinct contents of its text blocks, and the
distinct sequences of child elements (its presentation styles). A content that
occurs in k of m pages has the entropy ``log k / log m`` over the pages: shared
boilerplate is near 1, an article's own text 0; the content importance is one
less the mean entropy of the contents. Presentation styles with the shares p of
the pages have the importance ``-sum(p log p) / log m``: a frame that all pages
lay out alike is near 0. A node's importance is ``CONTENT`` parts of the first
and the rest of the second. From each page the own text of the nodes under
``LOW`` is removed. A node below them is judged by its own contents: a wrapper
that repeats a line does not take its article along.

Pages of a host with the same nodes and texts are copies and count once. Hosts
with fewer than ``MIN_PAGES`` distinct pages can't show what they repeat, so they
are judged by the tree of all hosts: there each host has the weight 1 and a page
that several hosts have belongs to the first of them, so neither a large host nor
mirrors decide for others.

Marks of HTML itself go first, because a single page suffices for them: an
element that says what it is (``nav``, ``footer``, ``form``, class ``ad``,
``comment-list`` ...) is removed, and where a page has an article (``article``,
``main``), what is outside goes and its plain prose stays: pages of one host may
share titles or paragraphs, and those are text of the article. The tree decides
about all else, labelled nodes of articles included. A name counts only if all
its words say so (``related``, not ``related-work``).

Scale: two passes over the pages. The first emits one row of (path, content hash)
lists per page; copies are dropped by a hash of the lists, map-side first, and
what remains is aggregated map-side by (host, path, content hash), so a host with
a third of all pages is no hot task. The second reads a page with the removed paths of its
host; they are broadcast if a count shows they are small, else joined by host.

Defined cases: null or empty html has the empty text; a null url is the host
``""``; malformed markup is read as browsers do in the cases that matter here
(unclosed and misnested elements, stray ``<``, references without ``;``); a
``<`` without a ``>`` is text, and a tag with an unclosed quote ends at the first
``>``; repeated rows each give a row; an empty table gives no rows; extra columns
are not read, whatever their names; a very long page is read whole, in time
linear in its length whatever its markup.
"""

from __future__ import annotations

import html as references
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices, str_texts, write_stage

LOW = 0.6
CONTENT = 0.9  # of a node's importance; the rest is its presentation's
MIN_PAGES = 4  # a tree of fewer pages shows nothing
BROADCAST_BYTES = 4 << 20

# Element kinds of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe object svg math select button head".split())
_BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
_NOISE_TAGS = frozenset("nav footer aside form menu dialog".split())
_CONTENT_TAGS = frozenset("article main".split())
_PROSE = frozenset(
    "p h1 h2 h3 h4 h5 h6 pre blockquote ul ol li dl dt dd table tbody thead tfoot tr td th figure figcaption header hgroup "
    "section div".split())
# Words in class, id or role that name what is not the article.
_NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar footer comment comments disqus cookie cookies consent gdpr notice popup modal "
    "newsletter subscribe subscription signup login search share sharing social related recommended pagination pager "
    "widget toolbar skip masthead alert complementary contentinfo".split())
#: Words that may stand beside them in a name.
_PLACE_WORDS = frozenset(
    "list box slot bar block wrap wrapper container area section links link items item buttons button icons posts articles "
    "site page main top bottom left right header inner outer form form".split())
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_NAME = re.compile(r"[a-zA-Z][^\s/><]*+")
_STOP = re.compile(r""">|=\s*+["']""")
_WORD = re.compile(r"[a-z]+")


def _label(tag: str, attributes: str) -> tuple[str, bool]:
    """The node's label, and whether its names say that it is not the article."""
    if not attributes:
        return tag, False
    found = sorted((m[1].lower(), sorted((m[2] or m[3] or m[4] or "").lower().split())) for m in _NAMES.finditer(attributes))
    names = " ".join(f"{kind}={' '.join(values)}" for kind, values in found)
    named = any(not _NOISE_WORDS.isdisjoint(words) and _NOISE_WORDS.union(_PLACE_WORDS).issuperset(words)
                for _, values in found for words in map(_WORD.findall, values))
    return (f"{tag}[{names}]" if names else tag), named and tag not in ("html", "body")


class Block:
    """Text of one block: its path (a hash), what its markup says, and the text with references decoded."""

    __slots__ = ("path", "noise", "content", "prose", "text")

    def __init__(self, path: int, noise: bool, content: bool, prose: bool, text: str):
        self.path, self.noise, self.content, self.prose, self.text = path, noise, content, prose, text


def markup(page: str):
    """(start, end, slash, name, attributes) of every tag; name is empty for comments and declarations.

    A ``>`` in a quoted value doesn't end a tag. Where such a quote is never
    closed, tags before it end at their first ``>``, so no place is searched
    again and again.
    """
    at, last, loose = 0, page.rfind(">"), 0
    while (start := page.find("<", at)) >= 0:
        at = start + 1
        if page.startswith("!--", at):
            end = page.find("-->", at + 3)
            end = len(page) if end < 0 else end + 3
            yield start, end, "", "", ""
            at = end
            continue
        if start > last:
            return
        if page.startswith(("!", "?"), at):
            at = page.find(">", at) + 1
            yield start, at, "", "", ""
            continue
        slash = "/" if page.startswith("/", at) else ""
        name = _NAME.match(page, at + len(slash))
        if not name:
            continue
        stop = name.end()
        while stop >= 0 and start >= loose:
            found = _STOP.search(page, stop)
            if found is None or found[0] == ">":
                loose = len(page) if found is None else loose
                stop = -1 if found is None else found.start()
                break
            closed = page.find(found[0][-1], found.end())
            loose = found.end() if closed < 0 else loose
            stop = closed + 1 if closed >= 0 else -1
        if start < loose:
            stop = page.find(">", name.end())
        if stop < 0:
            continue
        yield start, stop + 1, slash, name[0], page[name.end():stop]
        at = stop + 1


_RAW_END = {tag: re.compile(rf"</{tag}\s*+>", re.I) for tag in _RAW}


def _child(path: int, label: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(label, path & ((1 << 64) - 1)) - (1 << 63)


def blocks(page: str) -> tuple[list[Block], dict[int, str]]:
    """Text blocks in page order, and the presentation style (child labels) of each element node."""
    # (tag, path, noise, content, prose: in an article, below unlabelled prose elements only)
    stack: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]
    opened: dict[str, int] = {}  # how many elements of a tag are open
    out: list[Block] = []
    styles: dict[int, list[str]] = {}
    text: list[str] = []
    at, size = 0, len(page)

    def flush() -> None:
        if text:
            words = references.unescape("".join(text)).split()
            text.clear()
            if words:
                out.append(Block(*stack[-1][1:], " ".join(words)))

    def close(k: int) -> None:
        flush()
        for tag, *_ in stack[k:]:
            opened[tag] -= 1
        del stack[k:]

    def innermost(tag: str) -> int:
        return next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag) if opened.get(tag) else 0

    for start, end, slash, name, attributes in markup(page):
        if start < at:
            continue  # inside an element whose content is no markup
        text.append(page[at:start])
        at = end
        tag = name.lower()
        if not tag:
            continue  # a comment or a declaration
        if slash:
            if tag in _BLOCK:
                if k := innermost(tag):
                    close(k)
                else:
                    flush()
            continue
        if tag in _RAW:  # nothing in it is text of the page
            if tag != "head" and not attributes.rstrip().endswith("/"):
                found = _RAW_END[tag].search(page, at)
                at = found.end() if found else size
            continue
        if tag in _VOID:
            text.append(" ")
            if tag == "hr":
                flush()
            continue
        if tag not in _BLOCK:
            continue  # inline
        flush()
        if tag in ("html", "body") and opened.get(tag):
            continue
        if tag in _CLOSES_P and (k := innermost("p")):
            close(k)
        if tag in _SIBLINGS and any(opened.get(t) for t in _SIBLINGS[tag]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in _HOLDS[tag]:
                    break
                if stack[k][0] in _SIBLINGS[tag]:
                    close(k)
                    break
        label, named = _label(tag, attributes)
        _, path, noise, content, prose = stack[-1]
        kept = tag in _CONTENT_TAGS or "role=main" in label
        # a page's own header is noise; an article's header holds its title
        noise = noise or (tag in _NOISE_TAGS or named or (tag == "header" and not content)) and not kept
        styles.setdefault(path, []).append(label)
        prose = prose and label in _PROSE or kept and not content
        stack.append((tag, _child(path, label), noise, content or kept, prose))
        opened[tag] = opened.get(tag, 0) + 1
    text.append(page[at:])
    flush()
    return out, {p: _style(s) for p, s in styles.items()}


def _style(labels: list[str]) -> str:
    """Child labels in order, runs of one label as one."""
    return " ".join(a for k, a in enumerate(labels) if not k or labels[k - 1] != a)


def main_text(page: str, removed: frozenset[int] = frozenset()) -> tuple[str, int]:
    """The text kept and the number of blocks removed; ``removed`` are low-importance paths of the site."""
    found, _ = blocks(page)
    article = any(b.content for b in found)
    kept = [b.text for b in found if not (b.noise or (article and not b.content) or (b.path in removed and not b.prose))]
    return " ".join(kept), len(found) - len(kept)


def _site(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def style_trees(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(site, path, pages, styles, importance) of every node of every site's tree.

    ``pages`` are distinct pages. A site of fewer than MIN_PAGES has the importance of the tree of all sites.
    """
    rows = pages.select(_site(F.col(url_col)).alias("site"), F.col(html_col).cast("string").alias("html"))

    def run(batches):
        import xxhash

        name = lambda t: xxhash.xxh64_intdigest(t) - (1 << 63)
        for batch in batches:
            for part in slices(batch):
                keys, paths, kinds, values = [], [], [], []
                for page in str_texts(part.column(1)):
                    found, styles = blocks(page)
                    own = sorted({(b.path, 1, name(b.text)) for b in found} | {(b.path, 0, 0) for b in found}
                                 | {(p, 2, name(s)) for p, s in styles.items()})
                    keys.append(xxhash.xxh128_digest(repr(own)))
                    paths.append([p for p, _, _ in own])
                    kinds.append([k for _, k, _ in own])
                    values.append([v for _, _, v in own])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(keys, pa.binary()), pa.array(paths, pa.list_(pa.int64())),
                     pa.array(kinds, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.int64()))],
                    ["site", "page", "path", "kind", "value"])

    # kind 0: the node occurs in the page; 1: a content of it; 2: a style of it
    seen = rows.mapInArrow(run, "site string, page binary, path array<long>, kind array<int>, value array<long>")
    own = write_stage(seen.where(F.array_contains("kind", 0)).dropDuplicates(["site", "page"]), "site-pages")
    shared = own.groupBy("page").agg(F.min("site").alias("owner"), F.count("*").alias("sites")).where("sites > 1")
    nodes = own.join(shared, "page", "left").select(
        "site", (F.col("site") == F.coalesce("owner", "site")).cast("int").alias("owned"),
        F.inline(F.arrays_zip("path", "kind", "value")))
    counts = write_stage(nodes.groupBy("site", "path", "kind", "value")
                         .agg(F.count("*").cast("double").alias("k"), F.sum("owned").alias("owned")), "site-trees")

    # each site has the weight 1 at a node: a content that all pages of one site have counts 1
    weights = counts.where("kind = 0 and owned > 0").select("site", "path", F.col("owned").alias("m"))
    every = (counts.where("owned > 0").join(weights, ["site", "path"]).groupBy("path", "kind", "value")
             .agg(F.sum(F.when(F.col("kind") == 0, 1.0).otherwise(F.col("owned") / F.col("m"))).alias("k")))
    site = _importance(counts, "site", "path")
    whole = _importance(every, "path").select("path", F.col("importance").alias("whole"))
    few = own.groupBy("site").agg(F.count("*").alias("n")).where(F.col("n") < MIN_PAGES).select("site", F.lit(True).alias("few"))
    return site.join(few, "site", "left").join(whole, "path", "left").select(
        "site", "path", "pages", "styles",
        F.when(F.col("few"), F.coalesce("whole", F.lit(1.0))).otherwise(F.col("importance")).alias("importance"))


def _importance(counts: DataFrame, *node: str) -> DataFrame:
    """Of each node: one less the mean entropy of its contents, and the entropy of its presentation styles."""
    k, logs = F.col("k"), F.col("k") * F.log(F.greatest("k", F.lit(1.0)))
    tree = counts.groupBy(*node).agg(
        F.max(F.when(F.col("kind") == 0, k)).alias("pages"),
        F.sum(F.when(F.col("kind") == 1, logs)).alias("shared"), F.sum(F.when(F.col("kind") == 1, k)).alias("contents"),
        F.sum(F.when(F.col("kind") == 2, logs)).alias("alike"), F.sum(F.when(F.col("kind") == 2, k)).alias("styled"),
        F.count(F.when(F.col("kind") == 2, True)).alias("styles")).where("pages is not null")
    content = 1.0 - F.col("shared") / F.col("contents") / F.log("pages")
    # shares k / styled: -sum(p log p) = log(styled) - sum(k log k) / styled
    style = F.coalesce((F.log(F.greatest("styled", F.lit(1.0))) - F.col("alike") / F.col("styled")) / F.log("pages"), F.lit(0.0))
    importance = F.lit(CONTENT) * content + F.lit(1.0 - CONTENT) * style
    return tree.select(*node, F.col("pages").cast("long").alias("pages"), "styles",
                       F.when(F.col("pages") < MIN_PAGES, 1.0).otherwise(importance).alias("importance"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            low: float = LOW) -> DataFrame:
    """One row per page row: page_id, url, text, n_chars, n_removed (blocks left out)."""
    id_type = pages.schema[id_col].dataType.simpleString()
    trees = style_trees(pages, url_col, html_col)
    removed = write_stage(trees.where(F.col("importance") < low).groupBy("site")
                          .agg(F.sort_array(F.collect_set("path")).alias("paths")), "site-low")
    size = removed.agg(F.sum(F.length("site") + 8 * F.size("paths"))).first()[0] or 0
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).cast("string").alias("html"),
                        F.col(url_col).alias("url"), _site(F.col(url_col)).alias("site"))
    small = size <= BROADCAST_BYTES
    known = pages.sparkSession.sparkContext.broadcast(
        {r["site"]: frozenset(r["paths"]) for r in removed.collect()} if small else {})
    rows = rows.withColumn("paths", F.array().cast("array<long>")) if small else rows.join(removed, "site", "left")
    rows = rows.select("page_id", "html", "url", "site", "paths")

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                table = known.value
                texts, gone = [], []
                for page, site, paths in zip(str_texts(part.column(1)), part.column(3).to_pylist(), part.column(4).to_pylist()):
                    text, n = main_text(page, table.get(site) or frozenset(paths or ()))
                    texts.append(text)
                    gone.append(n)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64()), pa.array(gone, pa.int64())],
                    ["page_id", "url", "text", "n_chars", "n_removed"])

    return rows.mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars long, n_removed long")
