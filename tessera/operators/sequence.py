"""Skew-safe running sums, positions and ordered concatenation within a key.

A window partitioned by a key alone puts the whole key in one task. Here the
order column cuts each key into buckets of ``BUCKET`` consecutive values:

1. a window over (key, bucket) gives local running sums, so a hot key is
   spread over as many tasks as it has buckets;
2. the last local sum of each bucket (one row per bucket) is summed up over
   the buckets of the key, which gives each bucket's offset;
3. offsets are joined back on (key, bucket): running sum = local + offset.

All of it is built-in windows and joins, and both uses of the local sums share
one exchange. Keys are compared null-safe, so rows without a key keep theirs.

An order column that is no integer (times, strings, decimals) has no such values.
Then the rows are range-partitioned by (key, order) and written; the buckets are
the ranges, which follow the rows themselves, so a hot key spans several. Only
this case runs a job while the plan is built, as two reads must see one cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import write_stage

BUCKET = 4096


def _bucketed(df: DataFrame, key: str, order_cols: list[str]) -> DataFrame:
    """Rows with ``_b``, their bucket; buckets of a key follow its order."""
    if isinstance(df.schema[order_cols[0]].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return df.withColumn("_b", F.floor(F.col(order_cols[0]) / F.lit(BUCKET)))
    ranges = df.repartitionByRange(key, *order_cols).withColumn("_b", F.spark_partition_id().cast("long"))
    return write_stage(ranges, "ranges")


def running_sum(df: DataFrame, key: str, order_cols: list[str], value_cols: list[str],
                out_prefix: str = "cum_") -> DataFrame:
    """Add ``cum_<v>``: inclusive running sum of each value column within
    ``key``, in ``order_cols`` order (which must be unique within the key)."""
    outs = [out_prefix + v for v in value_cols]
    own = Window.partitionBy(key, "_b").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    local = _bucketed(df, key, order_cols)
    local = local.select("*", *[F.sum(v).over(own).alias(o) for v, o in zip(value_cols, outs)])
    last = F.struct(*[F.col(c) for c in order_cols])
    totals = local.groupBy(F.col(key).alias("_of_key"), F.col("_b").alias("_of_bucket")).agg(
        *[F.max_by(F.col(o), last).alias("_t_" + o) for o in outs])
    before = Window.partitionBy("_of_key").orderBy("_of_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_of_key", "_of_bucket", *[F.coalesce(F.sum("_t_" + o).over(before), F.lit(0)).alias("_o_" + o)
                                           for o in outs])
    both = local.join(offsets, local[key].eqNullSafe(offsets["_of_key"]) & local["_b"].eqNullSafe(offsets["_of_bucket"]))
    return both.select(*df.columns, *[(F.coalesce(F.col(o), F.lit(0)) + F.col("_o_" + o)).alias(o) for o in outs])


def positions(df: DataFrame, key: str, order_cols: list[str], name: str = "pos") -> DataFrame:
    """1-based position of each row within ``key`` by ``order_cols``."""
    out = running_sum(df.withColumn("_one", F.lit(1)), key, order_cols, ["_one"])
    return out.withColumn(name, F.col("cum__one").cast("long")).drop("_one", "cum__one")


def ordered_concat(df: DataFrame, key: str, order_col: str, text: str, sep: str,
                   chunk: int = 256) -> DataFrame:
    """Concatenate ``text`` per key in order, pre-aggregated in chunks of
    ``chunk`` consecutive orders (two-level), ``key, text, n``."""
    chunks = (df.groupBy(key, F.floor(F.col(order_col) / chunk).alias("_ch"))
                .agg(F.array_join(F.transform(F.array_sort(F.collect_list(
                    F.struct(F.col(order_col), F.coalesce(F.col(text), F.lit("")).alias("t")))),
                    lambda s: s["t"]), sep).alias("ct"), F.count("*").alias("n")))
    return (chunks.groupBy(key)
                  .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_ch", "ct"))),
                                                lambda s: s["ct"]), sep).alias(text),
                       F.sum("n").alias("n")))
