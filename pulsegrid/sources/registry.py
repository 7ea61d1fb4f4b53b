"""File contracts: which recording is used for what."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTRACT_SCHEMA = (
    "key string, subject string, filename string, csv_path string, protocol_family string, trust_tier string, "
    "processing_family string, marker_semantics string, supported_targets array<string>"
)
# Which control branches a protocol family enables.
BRANCHES = {"HR": ("jaw",), "LR": ("hand",), "LRJ": ("jaw", "hand")}


def registry(spark: SparkSession, contracts: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(contracts), CONTRACT_SCHEMA)


def contracts_for(table: DataFrame, protocol_family: str | None = None, trust_tier: str | None = None) -> DataFrame:
    out = table
    if protocol_family is not None:
        out = out.filter(F.col("protocol_family") == protocol_family)
    if trust_tier is not None:
        out = out.filter(F.col("trust_tier") == trust_tier)
    return out


def duplicate_keys(table: DataFrame, key: str = "key") -> DataFrame:
    """Contract keys that occur more than once."""
    return table.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
