"""Streaming forms that need no state code of their own: replay, windows, repeats, ground truth and branches.

Stateful detectors are in `timed`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def replay_source(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1, glob: str = "*.parquet") -> DataFrame:
    """A folder of sample files as a stream, a few files per batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", glob).parquet(path)


def window_features(stream: DataFrame, keys: Sequence[str], ts: str, value: str, size: str, slide: str, delay: str | None = None) -> DataFrame:
    """Sliding event-time windows without own state code; late rows fall behind the watermark.

    Leave ``delay`` out if the stream has a watermark already.
    """
    x = F.col(value)
    rows = stream.withWatermark(ts, delay) if delay else stream
    g = rows.groupBy(F.window(ts, size, slide), *keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.sqrt(F.avg(x * x)).alias("rms"), (F.max(x) - F.min(x)).alias("ptp"))
    return g.select(*keys, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n", "mean", "std", "rms", "ptp")


def drop_repeats(stream: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    """Forget repeated samples that arrive within the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def with_ground_truth(stream: DataFrame, segments: DataFrame, keys: Sequence[str], at: str, width: float) -> DataFrame:
    """Enrich a stream with the labelled segment of its time. Segments are disjoint and carry g_start, g_end, truth."""
    cell = lambda c: F.floor(c / F.lit(width)).cast("bigint")
    table = segments.withColumn("_cell", F.explode(F.sequence(cell(F.col("g_start")), cell(F.col("g_end")))))
    table = table.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_cell").alias("_k_cell"), "g_start", "g_end", "truth")
    cond = (cell(F.col(at)) == F.col("_k_cell")) & (F.col(at) >= F.col("g_start")) & (F.col(at) <= F.col("g_end"))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_k_{k}"))
    out = stream.join(table, cond, "left").drop("_k_cell", "g_start", "g_end", *[f"_k_{k}" for k in keys])
    return out.withColumn("truth", F.coalesce(F.col("truth"), F.lit("UNKNOWN")))


def enabled_branches(stream: DataFrame, contracts: DataFrame, branches: Mapping[str, Sequence[str]], key: str = "session_id") -> DataFrame:
    """Rows of the control branches that a session's protocol family enables. Rows carry ``branch``."""
    allowed = F.lit(False)
    for family, names in branches.items():
        allowed = allowed | ((F.col("protocol_family") == family) & F.col("branch").isin(*names))
    return stream.join(contracts.select(key, "protocol_family"), key).filter(allowed)
