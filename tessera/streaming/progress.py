"""Incremental scoring of an execution log that grows by appended files.

The source appends one result line per executed prediction and prints the
1 / 0 / -1 counts as it goes. Here the log directory is a file stream:
each new file is labelled against its gold answer and folded into per-run
counts kept in Spark's state store; every micro-batch writes the runs that
changed to its own part of a table in the shared folder (``foreachBatch``). A
part is never rewritten by a later batch and a repeated batch writes the same
part again, so readers see whole batches and a restarted query resumes from
its checkpoint. ``current`` reads the latest counts of each run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.evaluate import outcome_label

LOG_SCHEMA = T.StructType([
    T.StructField("run", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("answer", T.StringType()),
    T.StructField("prediction", T.StringType()),
])


def labelled_counts(logs: DataFrame) -> DataFrame:
    """Per-run counts of the three outcomes (works on a stream or a batch)."""
    lab = logs.withColumn("label", outcome_label("answer", "prediction"))
    return lab.groupBy("run").agg(
        F.count("*").alias("n_items"),
        F.count_if(F.col("label") == 1).alias("c1"),
        F.count_if(F.col("label") == 0).alias("c0"),
        F.count_if(F.col("label") == -1).alias("cerr"))


def start_progress(spark: SparkSession, log_dir: str, out_dir: str, checkpoint: str,
                   available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the stream; with ``available_now`` it processes the files present
    and stops (``awaitTermination`` returns), else it keeps polling."""
    reader = spark.readStream.schema(LOG_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    counts = labelled_counts(reader.json(log_dir))

    def publish(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch}")

    w = (counts.writeStream.outputMode("update").foreachBatch(publish)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def current(spark: SparkSession, out_dir: str) -> DataFrame:
    """Latest counts of each run from the parts written so far."""
    cols = ["n_items", "c1", "c0", "cerr"]
    last = spark.read.parquet(out_dir).groupBy("run").agg(F.max_by(F.struct(*cols), "epoch").alias("last"))
    return last.select("run", "last.*")
