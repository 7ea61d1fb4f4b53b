"""Small helpers the operators share: reading tables, spreading rows, numbering rows, clash-free columns."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.runtime import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slim(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Only the named columns, so that an operator's working columns cannot clash with a caller's own."""
    return df.select(*columns)


# bytes of text a Python worker holds at once (a longer text is a step of its own)
STEP_BYTES = 1 << 22


def byte_steps(batch: pa.RecordBatch, text: int, rows: int = 1 << 14, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold at most ``limit`` bytes of its ``text`` column, or one row, and at most ``rows`` rows."""
    column = batch.column(text)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    at = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1] if n else np.zeros(1, dtype=np.int32)
    first = 0
    while first < n:
        last = int(np.searchsorted(at, int(at[first]) + limit, side="right")) - 1
        last = min(max(first + 1, last), first + rows, n)
        yield batch.slice(first, last - first)
        first = last


def in_steps(batches: Iterator[pa.RecordBatch], text: int, rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in slices bounded by `byte_steps`, whatever the session's batch size.

    Workers outlive their tasks, so what Arrow and the allocator hold in reserve is given back at the end.
    """
    for batch in batches:
        yield from byte_steps(batch, text, rows)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def number_rows(df: DataFrame, order: Sequence[str], out: str = "row_number") -> DataFrame:
    """Gapless global row numbers from 0 in ``order``; rows that tie in all of ``order`` get any order among themselves.

    Rows are dealt by range over ``order`` and a salt (a key that holds a third of all rows still spreads), numbered
    inside each range, written once, and shifted by the sizes of the earlier ranges: one row per range is all that
    ever meets in one task. The written table fixes the numbers, so a lost executor cannot change them.
    ``df`` is read twice (range sampling, then the shuffle): hand over something cheap, or a written table.
    """
    spark = df.sparkSession
    n = partitions(spark)
    local = (
        df.withColumn("__salt", F.xxhash64(F.monotonically_increasing_id()))
        .repartitionByRange(n, *order, "__salt")
        .sortWithinPartitions(*order, "__salt")
        .withColumn("__range", F.spark_partition_id())
        .withColumn("__pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("__salt")
    )
    local = materialize(local)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        local.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
        .select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    )
    # one row per range: the broadcast is bounded by the number of shuffle partitions
    return (
        local.join(F.broadcast(shifts), "__range")
        .withColumn(out, F.col("__shift") + F.col("__pos"))
        .drop("__range", "__pos", "__shift")
    )
