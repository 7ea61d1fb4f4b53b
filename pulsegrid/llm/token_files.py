"""Binary token files: concatenated ids with Elias-Fano document boundaries.

A file is a Spark table of blocks in ascending document order. One block holds the ids of consecutive documents and
its own boundaries, so blocks are written and read by independent tasks and no table of 64-bit offsets exists anywhere.

Block payload (little endian): magic "TKB1", id width in bytes (u8), low bits per boundary (u8), documents (u32),
ids (u64), lengths in bytes of the low and the high part (u64, u64), low part, high part, select samples (u64 each,
one per 256 boundaries), ids.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.tables import in_steps, partitions
from pulsegrid.llm.tokens import encoder

BLOCK_IDS = 1 << 20
SAMPLE = 256
HEADER = "<4sBBIQQQ"


class Boundaries:
    """Elias-Fano code of a non-decreasing sequence: low bits packed, high bits in unary, a select sample every 256."""

    def __init__(self, low_bits: int, count: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.low_bits, self.count, self.low, self.high, self.samples = low_bits, count, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> Boundaries:
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // max(1, n)).bit_length() - 1)
        values = values.astype(np.uint64)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        high[ones] = 1
        return cls(low_bits, n, low, np.packbits(high, bitorder="little"), ones[::SAMPLE].astype(np.uint64))

    def _low(self, first: int, last: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(last - first, dtype=np.int64)
        a, b = first * self.low_bits, last * self.low_bits
        bits = np.unpackbits(self.low[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a]
        return bits.reshape(-1, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))

    def stretch(self, sample: int) -> np.ndarray:
        """The values from one select sample to the next, decoded from there without the rest."""
        first, last = sample * SAMPLE, min((sample + 1) * SAMPLE, self.count)
        at = int(self.samples[sample])
        end = int(self.samples[sample + 1]) if sample + 1 < len(self.samples) else len(self.high) * 8
        places = at + np.flatnonzero(np.unpackbits(self.high[at // 8 : -(-end // 8)], bitorder="little")[at % 8 :])[: last - first]
        return ((places - np.arange(first, last)) << self.low_bits) | self._low(first, last)

    def select(self, i: int) -> int:
        """Value number ``i``."""
        return int(self.stretch(i // SAMPLE)[i % SAMPLE])

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.count]
        return ((ones - np.arange(self.count)) << self.low_bits) | self._low(0, self.count)


def pack_block(ids: np.ndarray, bounds: np.ndarray, width: int) -> bytes:
    """``bounds`` has one entry more than there are documents; the first, 0, is left out of the code."""
    ef = Boundaries.encode(bounds[1:])
    head = struct.pack(HEADER, b"TKB1", width, ef.low_bits, ef.count, len(ids), ef.low.nbytes, ef.high.nbytes)
    return b"".join([head, ef.low.tobytes(), ef.high.tobytes(), ef.samples.astype("<u8").tobytes(), ids.astype(f"<u{width}").tobytes()])


def open_block(payload: bytes) -> tuple[np.ndarray, Boundaries]:
    magic, width, low_bits, count, n_ids, n_low, n_high = struct.unpack_from(HEADER, payload)
    if magic != b"TKB1":
        raise ValueError("not a token block")
    at = struct.calcsize(HEADER)
    low = np.frombuffer(payload, np.uint8, n_low, at)
    high = np.frombuffer(payload, np.uint8, n_high, at + n_low)
    samples = np.frombuffer(payload, "<u8", -(-count // SAMPLE), at + n_low + n_high)
    ids = np.frombuffer(payload, f"<u{width}", n_ids, at + n_low + n_high + samples.nbytes)
    return ids, Boundaries(low_bits, count, low, high, samples)


def document_ids(payload: bytes, i: int) -> np.ndarray:
    """Ids of document ``i`` of a block, by two selects."""
    ids, ef = open_block(payload)
    return ids[ef.select(i - 1) if i else 0 : ef.select(i)]


def write_token_files(df: DataFrame, path: str, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text",
                      width: int = 2, block_ids: int = BLOCK_IDS) -> None:
    """Encode every whole text, append ``end``, and write blocks in ascending ``id_col`` order to ``path``.

    Null texts are empty; null ids come first and repeated ids stay neighbours. A block closes at ``block_ids`` ids;
    a longer document is one block of its own. An empty table writes an empty table. Other columns are not written.
    """
    kind = df.schema[id_col].dataType
    rows = (
        df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
        .withColumn("salt", F.xxhash64("text"))
        .repartitionByRange(partitions(df.sparkSession), "key", "salt")
        .sortWithinPartitions("key", "salt")
        .withColumn("part", F.spark_partition_id())
        .select("part", "key", "text")
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        held, block, part = 0, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal keep, held, block
            ids = np.concatenate([k[0] for k in keep])
            sizes = np.concatenate([np.diff(k[1]) for k in keep])
            payload = pack_block(ids, np.concatenate([[0], np.cumsum(sizes)]), width)
            keys = pa.concat_arrays([k[2] for k in keep])
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([len(ids)], pa.int64()),
                 pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([payload], pa.binary())],
                names=["part", "block", "n_ids", "keys", "payload"])
            keep, held, block = [], 0, block + 1
            return out

        code = encoder(tokenizer)
        for batch in in_steps(batches, 2):
            part = batch.column(0)[0].as_py()
            ids, bounds = code.encode(batch.column(2), end)
            if len(ids) and int(ids.max()) >> (8 * width):
                raise ValueError(f"an id does not fit into {width} bytes")
            first = 0
            while first < batch.num_rows:
                last = int(np.searchsorted(bounds, bounds[first] + block_ids - held, side="right")) - 1
                last = min(max(last, first + (not keep)), batch.num_rows)
                if last > first:
                    keep.append((ids[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first], batch.column(1).slice(first, last - first)))
                    held += int(bounds[last] - bounds[first])
                if last < batch.num_rows or held >= block_ids:
                    yield close()
                first = last
        if keep:
            yield close()

    schema = f"part int, block int, n_ids bigint, keys array<{kind.simpleString()}>, payload binary"
    rows.mapInArrow(encode, schema).write.parquet(path)


def read_token_files(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the written blocks: its id, first position, number of ids and their crc32.

    The position of a block is the sum of the blocks before it; only block sizes meet in one task for that.
    """
    order = Window.orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1)
    # one row per about a million ids, so it goes to the blocks; otherwise every payload would be shuffled to meet its shift
    shifts = blocks.select("part", "block", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("shift"))
    kind = blocks.schema["keys"].dataType.elementType

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys = batch.column(0).slice(i, 1).flatten()
                ids, ef = open_block(batch.column(1)[i].as_py())
                bounds = np.concatenate([[0], *[ef.stretch(k) for k in range(len(ef.samples))]])
                whole = ids.astype("<u4")
                crc = [zlib.crc32(whole[a:b].tobytes()) for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(bounds[:-1] + batch.column(2)[i].as_py(), pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(crc, pa.int64())],
                    names=[id_col, "start", "n_tokens", "ids_crc32"])

    placed = blocks.select("part", "block", "keys", "payload").join(F.broadcast(shifts), ["part", "block"])
    return placed.select("keys", "payload", "shift").mapInArrow(decode, f"{id_col} {kind.simpleString()}, start bigint, n_tokens bigint, ids_crc32 bigint")
