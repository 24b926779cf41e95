"""Near duplicates: a multi-index Hamming join of b-bit MinHash signatures.

Rows with equal shingle sets are one class, which has a number of its own and a
least id. A class has
a signature of 64 MinHash symbols of 15 bits, in 16 chunks of 4. Two signatures
that differ in at most 31 symbols have a chunk with at most one error
(31 < 16 * 2, pigeonhole), so each chunk is indexed four times with one symbol
masked out: every pair within distance 31 shares one of the 64 keys. Sets of
similarity 0.8 are further apart than 31 with a probability under 1e-7.

Pairs are never listed. In each key's bucket the most central member (the one
that shares most keys) is the hub, and all members join the hub's family, so
each candidate pair lies in some family. Then

1. every member is compared with its hub on the full sets (linear in the rows);
2. connected components of those links label the members;
3. what may be missed are pairs of different labels inside a family. Members
   outside the family's largest label meet all its members, in tasks of at most
   ``BLOCK`` x ``BLOCK`` texts, fewer if they are long; signatures further apart than 31 are skipped,
   all others are compared on the full sets;
4. the links of 1 and 3 give the components.

A hot family is spread over block tasks, exact copies are pre-aggregated to one
class, and joins are plain equi-joins that adaptive execution may split. Block
tasks carry texts (they compress, shingle hashes don't) and rebuild the sets.

Defined cases: a null or empty text has no shingles, is its own component and
kept; a null id is linked with nothing: its component is null and it is kept;
repeated rows each give a row; an empty table gives no rows; ids may be of any
type that can be ordered; extra columns are not read, whatever their names; a
very long text is one set, and a side of a block task alone. Rows that share an
id are one node of ``component_id``, so an id with several texts connects all
that is near to one of them. ``deduplicate`` looks at (id, class) instead: a row
goes only if a near copy of its own text stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.llm.common import map_slices, slices, write_stage
from tessera.llm.shingles import LANE, SYMBOLS, set_key, shingle_sets, signature

MAX_DISTANCE = 31  # symbols
BLOCK = 256  # texts on a side of a block task, on average
BLOCK_SHINGLES = 1 << 22  # shingles on a side, on average: long texts make more blocks
BROADCAST_IDS = 1 << 22  # ids that are broadcast, once counted, to pick texts; more are joined by a shuffle
_PER_LONG = 4
_MASKS = [~(((1 << LANE) - 1) << (LANE * k)) for k in range(_PER_LONG)]


def signatures(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, the 128-bit name of the set (h1, h2) and its signature (16 longs; null if empty)."""
    id_type = documents.schema[id_col].dataType.simpleString()
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(1))
        names = [set_key(s) for s in sets]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
             pa.array([a for a, _ in names], pa.int64()), pa.array([b for _, b in names], pa.int64()),
             pa.array([signature(s) if len(s) else None for s in sets], pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "h1", "h2", "sig"])

    return map_slices(docs, kernel, f"doc_id {id_type}, n_shingles long, h1 long, h2 long, sig array<long>")


def index_keys(sig) -> F.Column:
    """The 64 keys of a signature: each chunk with each one of its symbols masked out."""
    return F.flatten(F.transform(sig, lambda s, c: F.array(*[
        F.xxhash64(c * F.lit(_PER_LONG) + F.lit(k), s.bitwiseAND(F.lit(m))) for k, m in enumerate(_MASKS)])))


def families(classes: DataFrame) -> DataFrame:
    """(hub, rep, size): who shares a key with a bucket's hub, the hub itself included, and its shingles."""
    members = classes.select("rep", F.explode(index_keys("sig")).alias("key"))
    # written, so that the joins read plain tables and a hot key or hub can be split
    shared = write_stage(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "near-keys")
    multi = write_stage(members.join(shared, "key"), "near-multi")
    central = multi.groupBy("rep").agg(F.sum("n").alias("central"))
    ranked = multi.join(central, "rep").select("key", "rep", "central")
    hubs = ranked.groupBy("key").agg(F.max_by("rep", F.struct("central", F.xxhash64("rep"), "rep")).alias("hub"))
    hubs = write_stage(hubs, "near-hubs")
    return multi.join(hubs, "key").select("hub", "rep").distinct().join(classes.select("rep", "size"), "rep")


def components(links: DataFrame) -> DataFrame:
    """Connected components of (a, b) links as (node, label): label is the least node reachable.

    Large-star and small-star steps (every node's neighbours are joined to its
    least neighbour) until the edges are stars; each step is written, so nothing
    is kept by an executor alone.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, seen = write_stage(edges, "near-edges"), None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low.select("u", F.col("m").alias("v"))).where("u <> v")
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        edges = write_stage(small, "near-edges")
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    labels = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def linked(a: int, b: int, common: int) -> bool:
    """Similarity 0.8 or more, in whole numbers."""
    return 100 * common >= 80 * (a + b - common)


def _common(mine: np.ndarray, flat: np.ndarray, starts: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Intersection sizes of one set with each of the others (all as numbers below len(mark))."""
    mark[mine] = True
    out = np.add.reduceat(mark[flat], starts, dtype=np.int64)
    mark[mine] = False
    return out


def _numbered(sets: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    flat = np.concatenate(sets)
    lens = np.array([len(s) for s in sets])
    starts = np.cumsum(lens) - lens
    distinct, flat = np.unique(flat, return_inverse=True)
    return [flat[s:s + n] for s, n in zip(starts.tolist(), lens.tolist())], flat, starts, np.zeros(len(distinct), bool)


def _symbols(sets: list[np.ndarray]) -> np.ndarray:
    sig = np.array([signature(s) for s in sets]).reshape(len(sets), SYMBOLS // _PER_LONG)
    return np.stack([(sig >> (LANE * k)) & ((1 << LANE) - 1) for k in range(_PER_LONG)], 2).reshape(len(sets), -1).astype(np.int16)


def block_links(reps: list, texts: list[str], labels: list, left: list[bool], right: list[bool],
                hub_only: bool) -> list[tuple]:
    """Links between the left and the right texts of one block task."""
    sets = shingle_sets(pa.array(texts, pa.large_string()))
    ys = [k for k in range(len(sets)) if left[k] and len(sets[k])]
    xs = [k for k in range(len(sets)) if right[k] and len(sets[k])]
    if not ys or not xs:
        return []
    numbered, flat, starts, mark = _numbered([sets[k] for k in xs] + [sets[k] for k in ys])
    size = np.array([len(sets[k]) for k in xs])
    flat, starts = flat[:int(size.sum())], starts[:len(xs)]
    symbols = None if hub_only else _symbols([sets[k] for k in xs])
    mine = None if hub_only else _symbols([sets[k] for k in ys])
    names = {v: n for n, v in enumerate(dict.fromkeys(labels))}
    label = np.array([names[labels[k]] for k in xs])
    links = []
    for n, y in enumerate(ys):
        a = len(sets[y])
        try_ = 5 * np.minimum(size, a) >= 4 * np.maximum(size, a)
        if not hub_only:
            try_ &= (label != names[labels[y]]) & ((symbols != mine[n]).sum(1) <= MAX_DISTANCE)
        if not try_.any():
            continue
        common = _common(numbered[len(xs) + n], flat, starts, mark)
        good = try_ & (100 * common >= 80 * (size + a - common))
        links += [(reps[y], reps[xs[k]]) for k in np.flatnonzero(good).tolist() if reps[xs[k]] != reps[y]]
    return links


def _block_tasks(rows: DataFrame, hub_only: bool) -> DataFrame:
    """Runs ``block_links`` on the rows of each (hub, i, j); a task holds one group at a time."""
    names = ["hub", "i", "j", "rep", "label", "as_left", "as_right", "text"]

    def run(batches):
        held, key = [], None
        for batch in batches:
            for row in (r for part in slices(batch, names.index("text")) for r in part.to_pylist()):
                own = (row["hub"], row["i"], row["j"])
                if own != key and held:
                    yield from finish(held)
                    held = []
                key = own
                held.append(row)
        if held:
            yield from finish(held)

    def finish(held):
        links = block_links(*([r[c] for r in held] for c in ("rep", "text", "label", "as_left", "as_right")), hub_only)
        if links:
            a, b = zip(*links)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    ordered = rows.select(*names).repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")
    return ordered.mapInArrow(run, "a long, b long")


def _blocks(count, shingles) -> F.Column:
    return F.greatest(F.ceil(count / F.lit(BLOCK)), F.ceil(shingles / F.lit(BLOCK_SHINGLES))).cast("int")


def star_links(family: DataFrame, texts: DataFrame) -> DataFrame:
    """Links of members with their hub."""
    sizes = write_stage(family.groupBy("hub").agg(_blocks(F.count("*"), F.sum("size")).alias("blocks")), "near-sizes")
    rows = family.where("hub <> rep").join(sizes, "hub").select(
        "hub", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("i"), "rep",
        F.lit(False).alias("as_left"), F.lit(True).alias("as_right"))
    hubs = sizes.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"),
                        F.col("hub").alias("rep"), F.lit(True).alias("as_left"), F.lit(False).alias("as_right"))
    rows = rows.unionByName(hubs).withColumn("j", F.lit(0)).withColumn("label", F.col("rep"))
    return _block_tasks(rows.join(texts, "rep"), True)


def cross_links(family: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """Links inside families between members whose labels differ so far."""
    named = (family.where("hub <> rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
             .withColumn("label", F.coalesce("label", "rep")))
    by_label = named.groupBy("hub", "label").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    top = by_label.groupBy("hub").agg(F.count("*").alias("labels"), F.sum("n").alias("n"), F.sum("size").alias("size"),
                                      F.max(F.struct("n", "label", "size")).alias("main")).where("labels > 1")
    top = top.select("hub", F.col("main.label").alias("main"), _blocks(F.col("n"), F.col("size")).alias("right_blocks"),
                     _blocks(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size")).alias("left_blocks"))
    top = write_stage(top, "near-top")
    rows = named.join(top, "hub").withColumn("other", F.col("label") != F.col("main")).withColumn("h", F.xxhash64("rep"))
    i, j = (F.pmod("h", F.col(c)).cast("int") for c in ("left_blocks", "right_blocks"))
    task = lambda a, b, left, right: F.struct(a.alias("i"), b.alias("j"), F.lit(left).alias("as_left"), F.lit(right).alias("as_right"))
    as_right = F.transform(F.sequence(F.lit(0), F.col("left_blocks") - 1), lambda a: task(a, j, False, True))
    as_left = F.transform(F.sequence(F.lit(0), F.col("right_blocks") - 1), lambda b: task(i, b, True, False))
    one = (F.col("left_blocks") == 1) & (F.col("right_blocks") == 1)
    tasks = (F.when(one, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("other").alias("as_left"),
                                          F.lit(True).alias("as_right"))))
             .when(F.col("other"), F.concat(as_right, as_left)).otherwise(as_right))
    rows = rows.select("hub", "rep", "label", F.explode(tasks).alias("t")).select("hub", "rep", "label", "t.*")
    return _block_tasks(rows.join(texts, "rep"), False)


def set_names(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows as they are, with the 128-bit name of their shingle set (``_h1``, ``_h2``)."""
    field = documents.columns.index(text_col)
    names = [*documents.columns, "_h1", "_h2"]

    def run(batches):
        for batch in batches:
            for part in slices(batch, field):
                own = [set_key(s) for s in shingle_sets(part.column(field))]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([a for a, _ in own], pa.int64()), pa.array([b for _, b in own], pa.int64())], names)

    schema = StructType([*documents.schema.fields, StructField("_h1", LongType()), StructField("_h2", LongType())])
    return documents.mapInArrow(run, schema)


def class_texts(documents: DataFrame, classes: DataFrame, repeated: DataFrame, wanted: int) -> DataFrame:
    """(rep, text): one text of each class, the text of its least id."""
    own = F.broadcast(classes) if wanted <= BROADCAST_IDS else classes  # counted; else the texts are shuffled by id
    single = own.join(repeated, own["least"] == repeated["doc_id"], "left_anti").select("rep", "least")
    single = F.broadcast(single) if wanted <= BROADCAST_IDS else single
    texts = documents.join(single, documents["doc_id"] == single["least"]).select("rep", "text")
    if repeated.isEmpty():
        return texts
    # an id of several rows: the row of the class is known by its set
    several = set_names(documents.join(repeated, "doc_id", "left_semi"))
    several = several.groupBy("doc_id", "_h1", "_h2").agg(F.min("text").alias("text"))
    several = several.join(classes, (several["doc_id"] == classes["least"]) & (several["_h1"] == classes["h1"])
                           & (several["_h2"] == classes["h2"])).select("rep", "text")
    return texts.unionByName(several)


def linked_classes(documents: DataFrame, classes: DataFrame, repeated: DataFrame) -> DataFrame:
    """Connected components (node, label) of the classes that have a near copy, by links of their texts alone."""
    family = write_stage(families(classes), "near-families")
    involved = classes.join(family.select("rep").distinct(), "rep", "left_semi").select("rep", "least", "h1", "h2")
    involved = write_stage(involved, "near-involved")
    texts = write_stage(class_texts(documents, involved, repeated, involved.count()), "near-texts")
    star = write_stage(star_links(family, texts), "near-star")
    labels = write_stage(components(star), "near-labels")
    cross = cross_links(family, labels, texts)
    # links between labels: the first components stay whole
    return write_stage(joined_components(labels, cross), "near-components")


def joined_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) after further links (a, b): components of ``labels`` that they connect become one."""
    of = labels.select(F.col("node").alias("n"), F.col("label").alias("l"))
    named = links
    for c in ("a", "b"):
        named = (named.join(of, named[c] == of["n"], "left").withColumn(c, F.coalesce("l", c)).drop("n", "l"))
    more = components(named).select(F.col("node").alias("n"), F.col("label").alias("top"))
    final = labels.join(more, labels["label"] == more["n"], "left").select("node", F.coalesce("top", "label").alias("label"))
    alone = more.join(labels, more["n"] == labels["node"], "left_anti").select(F.col("n").alias("node"), F.col("top").alias("label"))
    return final.unionByName(alone)


def _least_ids(classes: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """(rep, name): the least (id, class) of each class's component, for classes that have one."""
    named = classes.select("rep", "least").join(labels, classes["rep"] == labels["node"]).select("rep", "least", "label")
    first = named.groupBy("label").agg(F.min(F.struct("least", "rep")).alias(name))
    return named.join(first, "label").select("rep", name)


def judged(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Written rows (doc_id, n_shingles, h1, h2, class_id, component_id, leader), and ids of several rows.

    ``leader`` tells whether the row's text stays when near copies go: its id is
    the least of those whose texts are connected with its own.
    """
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sigs = write_stage(signatures(docs), "near-signatures")
    real = sigs.where("n_shingles > 0 and doc_id is not null")
    classes = (real.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.min("sig").alias("sig"), F.min("n_shingles").alias("size"))
               .withColumn("rep", F.monotonically_increasing_id()))
    classes = write_stage(classes, "near-classes")  # the numbers hold, as they are read from here on
    key = F.struct("h1", "h2")
    ids = sigs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min(key).alias("a"), F.max(key).alias("b"))
    ids = write_stage(ids.where("n > 1"), "near-repeated")
    repeated, several = ids.select("doc_id"), ids.where("a <> b").select("doc_id")
    labels = linked_classes(docs, classes, repeated)
    nodes = labels
    if not several.isEmpty():  # classes of one id are one node
        own = real.join(several, "doc_id").select("doc_id", "h1", "h2").distinct()
        own = write_stage(own.join(classes, ["h1", "h2"]).select("doc_id", "rep"), "near-several")
        star = own.join(own.groupBy("doc_id").agg(F.min("rep").alias("b")), "doc_id").select(F.col("rep").alias("a"), "b")
        nodes = write_stage(joined_components(labels, star), "near-nodes")
    named = classes.select("h1", "h2", "rep", F.struct("least", "rep").alias("self"))
    named = named.join(_least_ids(classes, nodes, "node"), "rep", "left").join(_least_ids(classes, labels, "text"), "rep", "left")
    named = named.select("h1", "h2", "rep", F.col("self.least").alias("class_id"),
                         F.coalesce("node.least", "self.least").alias("component"), F.coalesce("text", "self").alias("first"))
    out = sigs.drop("sig").join(write_stage(named, "near-named"), ["h1", "h2"], "left")
    none = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    leader = none | ((F.col("first.least") == F.col("doc_id")) & (F.col("first.rep") == F.col("rep")))
    out = out.select("doc_id", "n_shingles", "h1", "h2", F.when(none, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                     F.when(none, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), leader.alias("leader"))
    return out, repeated


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id, kept, class_id."""
    rows, _ = judged(documents, id_col, text_col)
    return rows.select("doc_id", "n_shingles", "component_id",
                       (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept"), "class_id")


def deduplicate(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents kept: one row of each group of near copies, all columns as they are.

    Of equal texts with one id the row that is least by all columns stays; rows
    without an id or without words all stay.
    """
    rows, repeated = judged(documents, id_col, text_col)
    near = write_stage(rows, "near-result")
    followers = near.where("not leader")
    gone = followers.join(repeated, "doc_id", "left_anti").select(F.col("doc_id").alias("_id"))
    gone = F.broadcast(gone) if followers.count() <= BROADCAST_IDS else gone  # else by a shuffle
    left = documents.join(gone, documents[id_col] == gone["_id"], "left_anti")
    if repeated.isEmpty():
        return left
    repeated = repeated.select(F.col("doc_id").alias("_id"))
    single = left.join(repeated, left[id_col] == repeated["_id"], "left_anti")
    several = set_names(documents.join(repeated, documents[id_col] == repeated["_id"], "left_semi"), text_col)
    stay = near.where("leader").select(F.col("doc_id").alias("_id"), F.col("h1").alias("_k1"), F.col("h2").alias("_k2"),
                                       (F.col("n_shingles") == 0).alias("_none")).distinct()
    several = several.join(stay, (several[id_col] == stay["_id"]) & (several["_h1"] == stay["_k1"]) & (several["_h2"] == stay["_k2"]))
    bare = several.where("_none").select(*documents.columns)
    one = (several.where("not _none").groupBy("_id", "_h1", "_h2")
           .agg(F.min(F.struct(*documents.columns)).alias("_row")).select("_row.*"))
    return single.unionByName(bare).unionByName(one)
