"""Text files read in pieces that keep their order, one task per file block.

Spark's text reader cuts a file into blocks and each block into pieces at a
separator. ``read_pieces`` keeps where a piece came from: ``file``, ``block``
(byte offset of the block) and ``place`` (a number that rises within the block).
(block, place) is the order of the pieces of a file, so nothing needs a whole
file in one value or one task. A block is bounded by
``spark.sql.files.maxPartitionBytes``; that bounds every window here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import write_stage


def read_pieces(spark: SparkSession, path: str, sep: str = "\n") -> DataFrame:
    """``file, block, place, piece`` of all files under ``path``."""
    return (spark.read.option("lineSep", sep).text(path)
            .select(F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("place"),
                    F.col("value").alias("piece")))


def running(df: DataFrame, values: dict[str, F.Column], key: str = "file") -> DataFrame:
    """Add each value's inclusive running sum over (block, place) within ``key``.

    A window inside each block, then one row per block summed over the blocks of
    the key and joined back: no task holds more than one block.
    """
    own = Window.partitionBy(key, "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    local = df.select("*", *[F.sum(v).over(own).alias(n) for n, v in values.items()])
    # values may fall, so a block's total is a sum of its own, not the largest running sum
    totals = df.groupBy(F.col(key).alias("_k"), F.col("block").alias("_b")).agg(
        *[F.sum(v).alias("_t_" + n) for n, v in values.items()])
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_k", "_b", *[F.coalesce(F.sum("_t_" + n).over(before), F.lit(0)).alias("_o_" + n)
                                          for n in values])
    both = local.join(offsets, local[key].eqNullSafe(offsets["_k"]) & (local["block"] == offsets["_b"]))
    return both.select(*df.columns, *[(F.col(n) + F.col("_o_" + n)).alias(n) for n in values])


def _marks(part) -> F.Column:
    """Opening less closing brackets of a text outside strings."""
    return (F.length(F.regexp_replace(part, r"[^\[{]", "")) -
            F.length(F.regexp_replace(part, r"[^\]}]", ""))).cast("long")


def json_records(pieces: DataFrame) -> DataFrame:
    """``file, record, json``: the objects of files that hold a JSON array, or several.

    ``pieces`` are cut at ``}``. Two running sums find the bounds of records:
    quotation marks so far tell whether a piece starts inside a string, which
    decides which of its parts lie outside strings; brackets of those so far are
    the depth. A ``}`` outside strings that brings the depth back to the array
    ends a record. A file holding one object gives that object; elements of the
    array that are no objects are left out, and so is an object of an array that a
    cut-short file does not close. A record has to fit one value (2 GB). The pieces
    are written twice in the shared folder, so the files themselves are read once.
    """
    # an escape is a pair, and a pair never holds the separator, so none crosses pieces
    parts = F.split(F.regexp_replace(F.col("piece"), r"\\.", ""), '"', -1)
    p = pieces.withColumn("_parts", parts).withColumn("_quotes", (F.size("_parts") - 1).cast("long"))

    def outside(first):
        return F.aggregate(F.filter("_parts", lambda x, i: i % 2 == first), F.lit(0).cast("long"),
                           lambda acc, x: acc + _marks(x))

    # the bracket marks of a piece for both states at its start, and the lost "}" at its end
    p = p.select("file", "block", "place", "piece", "_quotes", outside(0).alias("_out"), outside(1).alias("_in"))
    p = write_stage(p, "json-pieces")
    first = p.groupBy("file").agg(F.min_by("piece", F.struct("block", "place")).alias("_first"),
                                  F.max(F.struct("block", "place")).alias("_last"))
    base = first.select(F.col("file").alias("_f"), "_last",
                        F.when(F.col("_first").rlike(r"^\x{FEFF}?\s*\["), 1).otherwise(0).alias("_base"))
    p = running(p, {"_q": F.col("_quotes")})
    inside_before = (F.col("_q") - F.col("_quotes")) % 2 == 1
    inside_after = F.col("_q") % 2 == 1
    p = p.select("file", "block", "place", "piece", inside_after.alias("_inside"),
                 (F.when(inside_before, F.col("_in")).otherwise(F.col("_out"))
                  - F.when(inside_after, 0).otherwise(1)).alias("_step"))
    p = running(p, {"_depth": F.col("_step")})
    p = p.join(base, F.col("file") == F.col("_f")).drop("_f")
    # the last piece of an array has no "}" after it
    whole = (F.col("_base") == 0) | (F.struct("block", "place") < F.col("_last"))
    p = p.select("file", "block", "place", "piece", (
        ~F.col("_inside") & whole & (F.col("_depth") == F.col("_base"))).cast("long").alias("_end"))
    p = write_stage(p, "json-ends")
    p = running(p, {"_ends": F.col("_end")})
    p = p.withColumn("record", F.col("_ends") - F.col("_end"))
    body = (p.groupBy("file", "record")
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "place", "piece"))),
                                           lambda s: s["piece"]), "}").alias("_text"),
                  F.max("_end").alias("_closed")))
    # before a record stand the array's bracket, commas and elements that are no objects
    return (body.filter(F.col("_closed") == 1)
                .select("file", "record", F.concat(F.regexp_replace("_text", _LEAD, ""), F.lit("}")).alias("json")))


_LEAD = r'^(?:[^{"]|"(?:[^"\\]|\\.)*+")*+'
