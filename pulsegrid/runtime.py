"""Session-level helpers: building a session and cutting lineage safely."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def build_session(app: str = "pulsegrid", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; clusters bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a scratch folder only in local mode without that setting."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and continue from the files.

    Used between the rounds of an iterative operator and where one table feeds several branches of
    a plan: the work is done once, a lost executor costs a re-read, and the file sizes let Spark
    choose joins from facts.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/pulsegrid-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_parts(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """`materialize` for a table whose parts are made and written one after another; column ``name`` has a part's number."""
    folder = None
    for i, part in enumerate(parts):
        spark, fields = part.sparkSession, part.schema.fields
        folder = folder or f"{shared_dir(spark).rstrip('/')}/pulsegrid-{uuid.uuid4().hex}"
        part.write.parquet(f"{folder}/{name}={i}")
    return spark.read.schema(T.StructType([*fields, T.StructField(name, T.IntegerType())])).parquet(folder)
