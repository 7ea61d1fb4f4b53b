"""Result tables and stream logs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from pulsegrid.timeline import spread

ROWS_A_FILE = 1 << 22
PARTITIONS = "spark.sql.shuffle.partitions"


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ("session_id",), mode: str = "overwrite") -> None:
    """One folder per session; parquet, csv or json.

    The rows of a session are brought together first, or every task would write a file for every session. A session of more
    than ``ROWS_A_FILE`` rows may be cut into several files, so that it is not written by one task.
    """
    keys = list(partition_by)
    sizes = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / ROWS_A_FILE).alias("_files")).where("_files > 1")
    cut = F.coalesce(F.pmod(F.xxhash64(*[c for c in df.columns if c not in keys]), F.col("_files")), F.lit(0))
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    near = df.alias("a").join(sizes.alias("b"), on, "left").select("a.*", cut.alias("_cut"))
    writer = spread(near, *keys, "_cut").drop("_cut").write.mode(mode).partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def start(writer: DataStreamWriter, spark: SparkSession) -> StreamingQuery:
    """Start a stream with as many state partitions as the cluster has cores, or ``spark.sql.shuffle.partitions`` if fewer.

    A stateful operator opens and commits one store a partition in every batch, whatever its rows; a cut meant for large
    shuffles would spend the batch on that. A query takes the setting when it starts and keeps it in its checkpoint.
    """
    before = spark.conf.get(PARTITIONS)
    spark.conf.set(PARTITIONS, str(min(int(before), spark.sparkContext.defaultParallelism)))
    try:
        return writer.start()
    finally:
        spark.conf.set(PARTITIONS, before)


def append_log(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append a stream to a parquet log."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return start(writer.trigger(availableNow=True) if available_now else writer, stream.sparkSession)


def split_log(stream: DataFrame, folder: str, kinds: Mapping[str, str], checkpoint: str) -> StreamingQuery:
    """Write one stream to several logs by condition (detections, traces, prompts), one batch at a time.

    A batch writes to its own folder and replaces it on replay, so a retried batch leaves no duplicates.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        for name, condition in kinds.items():
            batch.filter(condition).write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")
        batch.unpersist()

    return start(stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True), stream.sparkSession)
