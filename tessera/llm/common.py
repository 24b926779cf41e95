"""Shared helpers of the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir

#: Text handed to a kernel at once: bounds the memory of a Python worker
#: whatever the batch size or the length of single texts.
SLICE_BYTES = 6 << 20


def read(spark: SparkSession, sf_dir: str, table: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*cols) if cols else df


def slices(batch: pa.RecordBatch, text_field: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch whose texts stay near ``limit`` bytes (one row at least).

    Each is a copy that begins at offset 0: some Arrow text kernels misread arrays with an offset.
    """
    n = batch.num_rows

    def part(start: int, count: int) -> pa.RecordBatch:
        return batch if count == n else batch.take(pa.array(range(start, start + count), pa.int64()))

    lens = batch.column(text_field).cast(pa.large_binary())
    sizes = [0 if v is None else v for v in pa.compute.binary_length(lens).to_pylist()]
    start, used = 0, 0
    for i, size in enumerate(sizes):
        if i > start and used + size > limit:
            yield part(start, i - start)
            start, used = i, 0
        used += size
    if start < n:
        yield part(start, n - start)


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes per row; null is empty."""
    return [v or b"" for v in column.cast(pa.large_binary()).to_pylist()]


def str_texts(column: pa.Array) -> list[str]:
    return [v or "" for v in column.to_pylist()]


def map_slices(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str,
               limit: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` with bounded slices; the text is the second column of ``df``.

    Runs where the rows lie: no shuffle, one pass, and a lost executor only
    costs the re-run of its own partitions.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=limit):
                yield kernel(part)

    return df.mapInArrow(run, schema)


def write_stage(df: DataFrame, name: str) -> DataFrame:
    """Write under the shared checkpoint folder and read back: cuts the lineage,
    and what an executor wrote outlives it."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sha256_hex(column) -> F.Column:
    return F.sha2(F.encode(column, "UTF-8"), 256)
