"""Reproducible global shuffle into shards: a keyed Feistel permutation with cycle walking over row numbers.

The permuted number p of a row decides everything: shard = p mod shards, slot = p div shards. No shuffle of the data
is needed to know where a row goes, and `row_at` answers the reverse question (which row sits at a shard and slot).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.tables import number_rows
from pulsegrid.runtime import materialize

ROUNDS = 6


def _keys(seed: int) -> np.ndarray:
    """Round keys from the seed (splitmix steps)."""
    with np.errstate(over="ignore"):
        z = np.uint64(seed) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return z ^ (z >> np.uint64(27))


def _round(half: np.ndarray, key: np.uint64, mask: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (half ^ key) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(29)
        return (x * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(17)) & mask


def permute(rows: np.ndarray, total: int, seed: int = 0, inverse: bool = False) -> np.ndarray:
    """A bijection of 0..total-1. The Feistel domain is the next power of four; numbers that land outside walk on."""
    if not total:
        return np.zeros(len(rows), dtype=np.int64)
    bits = max(1, ((total - 1).bit_length() + 1) // 2)
    shift, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    keys = _keys(seed)
    x = np.asarray(rows).astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> shift, x[todo] & mask
        if inverse:
            for key in keys[::-1]:
                left, right = right ^ _round(left, key, mask), left
        else:
            for key in keys:
                left, right = right, left ^ _round(right, key, mask)
        x[todo] = (left << shift) | right
        todo = todo[x[todo] >= np.uint64(total)]
    return x.astype(np.int64)


def row_at(shard: int, slot: int, total: int, shards: int, seed: int = 0) -> int:
    """The row number that sits at ``slot`` of ``shard``."""
    return int(permute(np.array([slot * shards + shard]), total, seed, inverse=True)[0])


def shard_rows(df: DataFrame, shards: int, order: Sequence[str] = ("doc_id",), seed: int = 0) -> DataFrame:
    """Add ``row_number``, ``shard`` and ``slot`` to every row; shard sizes differ by one row at most.

    Row numbers ascend in ``order``. Null keys come first, repeated rows get neighbouring numbers, an empty table
    stays empty, and every other column is carried along untouched (columns of the three names are replaced).
    Pass ids and small columns; join the texts back where they are needed.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    fixed = materialize(df.drop("row_number", "shard", "slot"))
    total = fixed.count()

    @F.pandas_udf("bigint")
    def permuted(rows: pd.Series) -> pd.Series:
        return pd.Series(permute(rows.to_numpy(), total, seed))

    return (
        number_rows(fixed, order)
        .withColumn("__p", permuted("row_number"))
        .withColumn("shard", (F.col("__p") % shards).cast("int"))
        .withColumn("slot", F.expr(f"__p div {shards}"))
        .drop("__p")
    )
