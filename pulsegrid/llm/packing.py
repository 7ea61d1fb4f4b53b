"""Packing documents into fixed windows by best-fit decreasing, decided on the histogram of piece lengths.

Overlong documents are first cut into full windows; what is left of each document is one piece shorter than a window.
Best-fit decreasing looks at lengths only, so it runs on the counts per length: at most ``window`` numbers, whatever
the size of the corpus. Windows with the same free room and the same history form runs of consecutive numbers, and a
segment tree over the free room finds the tightest room that takes a piece. The outcome is a short list of moves
(length, ranks of pieces -> run of windows, offset), and every piece looks up its own place by its rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.tables import in_steps, number_rows
from pulsegrid.llm.tokens import encoder
from pulsegrid.runtime import materialize

BATCH_ROWS = 500


class RoomTree:
    """Segment tree over remaining room 0..window: which rooms are open, and the smallest open one from a length up."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.open = [False] * (2 * self.size)

    def set(self, room: int, value: bool) -> None:
        i = room + self.size
        self.open[i] = value
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def tightest(self, length: int) -> int | None:
        i = length + self.size
        if self.open[i]:
            return length
        while i > 1:
            if not i & 1 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int]]:
    """Moves (length, first rank, last rank + 1, first window, offset) for pieces counted by length."""
    tree, runs, moves, opened = RoomTree(window), {}, [], 0
    for length in sorted(counts, reverse=True):
        if not length:
            raise ValueError("pieces must hold at least one token")
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            deep = min((room or window) // length, left)  # a window takes this many before another one is tighter
            take = left // deep
            if room is None:
                room, first = window, opened
                opened += take
            else:
                first, n = runs[room].pop()
                take = min(take, n)
                if take < n:
                    runs[room].append((first + take, n - take))
                if not runs[room]:
                    tree.set(room, False)
            for layer in range(deep):
                moves.append((length, rank, rank + take, first, window - room + layer * length))
                rank += take
            left -= deep * take
            if room > deep * length:
                runs.setdefault(room - deep * length, []).append((first, take))
                tree.set(room - deep * length, True)
    return moves


def cut_documents(df: DataFrame, window: int, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces of every document: full windows and one rest, with crc32 of their ids and, on request, the ids.

    Null texts are empty; every document ends with ``end``, so each has at least one piece.
    """
    kind = df.schema[id_col].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        for batch in in_steps(batches, 1):
            ids, bounds = code.encode(batch.column(1), end)
            sizes = np.diff(bounds)
            parts = -(-sizes // window)
            doc = np.repeat(np.arange(len(sizes)), parts)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * window
            length = np.minimum(window, sizes[doc] - start)
            at = bounds[doc] + start
            raw = memoryview(ids.astype("<u4").tobytes())
            spans = [raw[4 * a : 4 * (a + n)] for a, n in zip(at.tolist(), length.tolist())]
            columns = [batch.column(0).take(pa.array(doc)), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                       pa.array([zlib.crc32(s) for s in spans], pa.int64()), pa.array(sizes[doc], pa.int64())]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens"]
            if keep_ids:
                columns.append(pa.array([bytes(s) for s in spans], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"{id_col} {kind.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids binary" * keep_ids
    return df.select(id_col, text_col).mapInArrow(cut, schema)


def place_pieces(pieces: DataFrame, window: int, id_col: str = "doc_id") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of ``length`` 1..window. Ties in length go by id and start.

    Any further columns are carried along. An empty table gives an empty table.
    """
    spark = pieces.sparkSession
    fixed = materialize(pieces)
    ranked = number_rows(fixed, ["length", id_col, "start"], "__row")
    # at most one row per length: bounded by the window, not by the corpus
    counts = {r["length"]: r["n"] for r in fixed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, base = 0, {}
    for length in sorted(counts):
        base[length] = before
        before += counts[length]
    moves = [(n, base[n] + a, base[n] + b, w, o) for n, a, b, w, o in best_fit(counts, window)]
    plan = spark.createDataFrame(moves, "length bigint, __from bigint, __to bigint, __first bigint, offset bigint")
    on = (F.col("_p.length") == F.col("_m.length")) & (F.col("__row") >= F.col("__from")) & (F.col("__row") < F.col("__to"))
    return (
        ranked.alias("_p").join(F.broadcast(plan.alias("_m")), on)  # a few moves per length
        .withColumn("sequence_id", F.col("__first") + F.col("__row") - F.col("__from"))
        .select("_p.*", "sequence_id", "offset")
        .drop("__row")
    )


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Hand Python at most ``rows`` rows at a time in the jobs run inside; the session's own setting comes back after.

    A batch of whole texts stands in the executor's JVM and in its Python worker at once, beside the encoder.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def pack_documents(df: DataFrame, tokenizer: str, window: int = 2048, end: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Cut and place every document: one row per piece. Null texts count as empty, repeated ids as separate documents."""
    with small_batches(df.sparkSession):  # placing writes the pieces before it goes on
        return place_pieces(cut_documents(df, window, tokenizer, end, id_col, text_col, keep_ids), window, id_col)
