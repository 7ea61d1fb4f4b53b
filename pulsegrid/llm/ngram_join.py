"""Similarity join of documents on word n-grams (Jaccard) with Bayesian candidate pruning.

1. Each text becomes a set of hashed n-grams; texts with equal sets are one class from the start, with a count.
2. MinHash bands propose candidates. Within a band group, signatures are compared a few values at a time, and a pair is
   dropped as soon as the posterior probability of reaching the threshold falls below the tolerance.
3. What survives is only used to form families (components). Inside a family every pair is verified exactly on its full
   sets, block by block: counts of links and one spanning edge per merge leave a block, never its pairs.

Groups larger than a block are split into pairs of blocks, so no task holds more than two blocks of any group.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, log, log1p

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.components import components
from pulsegrid.llm.decontaminate import _split_words
from pulsegrid.llm.tables import in_steps, partitions
from pulsegrid.runtime import materialize

STEP = 32  # signature values compared at a time
MISSED, MOST_HASHES = 4e-6, 1024
BAND_BLOCK, VERIFY_BLOCK = 1024, 256


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def band_plan(threshold: float, missed: float = MISSED) -> tuple[int, int]:
    """Bands and rows a band, so that a pair at the threshold shares no band with probability ``missed`` at most.

    The most rows a band, five at most, that `MOST_HASHES` values allow: (32, 5) at 0.8.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    for rows in range(5, 0, -1):
        share = threshold**rows
        bands = 1 if share >= 1 else ceil(log(missed) / log1p(-share))
        while bands * rows % STEP:  # whole comparison steps
            bands += 1
        if bands * rows <= MOST_HASHES:
            return bands, rows
    raise ValueError(f"a threshold of {threshold} needs more than {MOST_HASHES} values a signature")


def shingle_sets(texts: pa.Array, n: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit n-gram hashes per text.

    Words are as in decontamination: runs of letters and digits, A-Z lower-cased. A text of fewer than ``n`` words is
    one n-gram of them all; a text without words but not empty is one n-gram by itself; empty and null have none.
    """
    coded, at = _split_words(texts)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    words = hashes[coded.indices.to_numpy()] if len(coded) else np.zeros(0, dtype=np.uint64)
    odd = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    with np.errstate(over="ignore"):
        if len(words) >= n:
            grams = _mix(sum(words[k : len(words) - n + 1 + k] * odd[k] for k in range(n)))
        out = []
        for i, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist())):
            if b - a >= n:
                out.append(np.unique(grams[a : b - n + 1]))
            elif b > a:
                out.append(_mix(np.array([(words[a:b] * odd[: b - a]).sum() + np.uint64(b - a)], dtype=np.uint64)))
            else:
                text = texts[i].as_py()
                out.append(np.array([xxhash.xxh64_intdigest(text, seed=7)] if text else [], dtype=np.uint64))
    return out


def signatures(sets: list[np.ndarray], plan: tuple[int, int] = (32, 5)) -> np.ndarray:
    """MinHash signatures of a `band_plan`, eight bits a value: one row per set (empty sets give zeros)."""
    rng = np.random.default_rng(20)
    hashes = plan[0] * plan[1]
    factors = rng.integers(1, 1 << 32, hashes, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    out = np.zeros((len(sets), hashes), dtype=np.uint8)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    x = (np.concatenate([sets[i] for i in full]) >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
    with np.errstate(over="ignore"):
        for k in range(hashes):
            least = np.minimum.reduceat(x * factors[k], starts)
            least = (least ^ (least >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            out[full, k] = (least >> np.uint32(24)).astype(np.uint8)
    return out


def least_matches(compared: int, threshold: float, tolerance: float) -> int:
    """Fewest equal values among ``compared`` for which P(similarity >= threshold | data) reaches the tolerance.

    Prior: uniform. Equal eight-bit values of unequal n-grams (1 in 256) are counted into the threshold. The tail of
    the Beta posterior is a binomial sum.
    """
    t = threshold + (1 - threshold) / 256
    tail = 0.0
    for m in range(compared + 1):
        tail += comb(compared + 1, m) * t**m * (1 - t) ** (compared + 1 - m)
        if tail >= tolerance:
            return m
    return compared


def _forest(label: np.ndarray, a: int, others: np.ndarray) -> np.ndarray:
    """Merge a's tree with those of ``others``; returns one of ``others`` per merged tree."""
    trees, first = np.unique(label[others], return_index=True)
    label[np.isin(label, trees)] = label[a]
    return others[first]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.RecordBatch]]:
    """Runs of rows with equal first ``keys`` columns, from sorted batches."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        for lo, hi in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
            key = tuple(c[lo] for c in cols)
            if key != last and held:
                yield held
                held = []
            last = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield held


def _in_block_pairs(df: DataFrame, key: list[str], size: Column, block: int, node: str = "node") -> DataFrame:
    """Deal the rows of each group to blocks and repeat them for every pair of blocks: columns ``_i, _j, _mine``."""
    n = F.ceil(size / block).cast("int")
    dealt = df.withColumn("_n", n).withColumn("_mine", F.pmod(F.xxhash64(node), F.col("_n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    paired = dealt.select("*", other.alias("_o")).withColumn("_i", F.least("_mine", "_o")).withColumn("_j", F.greatest("_mine", "_o")).drop("_n", "_o")
    order = [*key, "_i", "_j", "_mine"]
    return paired.repartition(partitions(df.sparkSession), *key, "_i", "_j").sortWithinPartitions(*order)


def join_ngrams(df: DataFrame, threshold: float = 0.8, n: int = 5, tolerance: float = 1e-6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col, class, class_id, first, n_links, n_text_links, n_grams``.

    Two rows are linked if the Jaccard similarity of their n-gram sets is at least ``threshold``; the bands follow from it (`band_plan`). ``class`` is the same
    number for all rows joined by links, directly or through others; ``first`` marks the row of each class with the
    lowest id (ties: any one), and ``class_id`` is its id. ``n_links`` counts linked rows, ``n_text_links`` linked different sets. Rows without
    n-grams (empty, null) are a class each. Null ids and repeated rows are rows like any other.
    """
    kind = df.schema[id_col].dataType.simpleString()
    bands = band_plan(threshold)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in in_steps(batches, 2, 500):
            sets = shingle_sets(rows.column(2), n)
            sig = signatures(sets, bands)
            sizes = [len(s) for s in sets]
            with np.errstate(over="ignore"):
                lo64 = [int(_mix(s).sum(dtype=np.uint64)) if len(s) else 0 for s in sets]
                hi64 = [int(_mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)) if len(s) else 0 for s in sets]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(np.array(lo64, dtype=np.uint64).view(np.int64)), pa.array(np.array(hi64, dtype=np.uint64).view(np.int64)),
                 pa.array(sizes, pa.int32()), pa.array([r.tobytes() for r in sig], pa.binary())],
                names=["id", "hash", "lo", "hi", "n", "sig"])

    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    signed = materialize(docs.mapInArrow(sign, f"id {kind}, hash bigint, lo bigint, hi bigint, n int, sig binary").withColumn("row", F.monotonically_increasing_id()))
    reps = (
        signed.where(F.col("n") > 0).groupBy("lo", "hi", "n")
        .agg(F.min(F.struct("id", "hash")).alias("text"), F.count(F.lit(1)).alias("copies"), F.min("row").alias("node"), F.first("sig").alias("sig"))
        .select("node", "lo", "hi", "n", "copies", "text.id", "text.hash", "sig")
    )
    reps = materialize(reps)
    families = components(_candidate_edges(reps, threshold, tolerance, bands))
    links, edges = _verify(docs, reps, materialize(families), threshold, n)
    classes = components(edges).select("node", F.col("component").alias("class"))
    per_set = (
        reps.select("lo", "hi", "n", "node", "copies").join(classes, "node", "left").join(links, "node", "left")
        .select("lo", "hi", "n", F.coalesce("class", "node").alias("class"), (F.coalesce("n_rows", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("n_sets", F.lit(0)).alias("n_text_links"))
    )
    rows = materialize(signed.select("id", "row", "lo", "hi", "n").join(per_set, ["lo", "hi", "n"], "left").select(
        "id", "row", F.coalesce("class", "row").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_text_links", F.lit(0)).alias("n_text_links"), F.col("n").alias("n_grams")))
    least = rows.groupBy("class").agg(F.min(F.struct("id", "row")).alias("m"))
    return rows.join(least, "class").select(
        F.col("id").alias(id_col), "class", F.col("m.id").alias("class_id"), (F.col("row") == F.col("m.row")).alias("first"), "n_links", "n_text_links", "n_grams")


def _candidate_edges(reps: DataFrame, threshold: float, tolerance: float, plan: tuple[int, int]) -> DataFrame:
    """Edges ``a, b`` that connect whatever survives the Bayesian comparison inside band groups."""
    n_bands, n_rows = plan
    hashes = n_bands * n_rows

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(-1, n_bands, n_rows).astype(np.int64)
                key = (sig << (8 * np.arange(n_rows))).sum(2) | (np.arange(n_bands, dtype=np.int64) << (8 * n_rows))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), n_bands))], names=["band", "node"])

    keyed = materialize(reps.select("node", "sig").mapInArrow(bands, "band bigint, node bigint"))
    shared = keyed.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    members = keyed.join(shared, "band").join(reps.select("node", "n", "sig"), "node")
    least = [least_matches(k, threshold, tolerance) for k in range(STEP, hashes + 1, STEP)]

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            rows = pa.Table.from_batches(group).combine_chunks()
            node, mine, size = (rows[c].to_numpy() for c in ("node", "_mine", "n"))
            sig = np.frombuffer(b"".join(rows["sig"].to_pylist()), dtype=np.uint8).reshape(-1, hashes)
            split = int((mine == mine[0]).sum())
            if split == len(node) and rows["_i"][0] != rows["_j"][0]:
                continue  # the other block of this pair holds no rows
            label, found = np.arange(len(node)), []
            for a in range(split if split < len(node) else len(node) - 1):
                b = np.arange(split if split < len(node) else a + 1, len(node))
                b = b[label[b] != label[a]]
                b = b[np.minimum(size[b], size[a]) >= threshold * np.maximum(size[b], size[a]) - 1e-9]
                same = np.zeros(len(b), dtype=np.int64)
                for s, most in enumerate(least):  # a few values at a time
                    same += (sig[b, s * STEP : (s + 1) * STEP] == sig[a, s * STEP : (s + 1) * STEP]).sum(1)
                    alive = same >= most
                    b, same = b[alive], same[alive]
                if len(b):
                    found += [(node[a], node[k]) for k in _forest(label, a, b)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])

    dealt = _in_block_pairs(members, ["band"], F.col("size"), BAND_BLOCK)
    return dealt.select("band", "_i", "_j", "_mine", "node", "n", "sig").mapInArrow(prune, "a bigint, b bigint")


def _verify(docs: DataFrame, reps: DataFrame, families: DataFrame, threshold: float, n: int) -> tuple[DataFrame, DataFrame]:
    """Exact verification of all pairs inside families: links per node (``n_rows, n_sets``) and spanning edges."""
    sizes = families.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    wanted = families.join(sizes, "component").join(reps.select("node", "id", "hash", "copies"), "node")
    texts = docs.alias("d").join(wanted.alias("w"), F.col("d.id").eqNullSafe(F.col("w.id")) & (F.col("d.hash") == F.col("w.hash"))).select(
        "w.node", "w.component", "w.size", "w.copies", "d.text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in in_steps(batches, 4, 500):
            yield pa.RecordBatch.from_arrays([*rows.columns[:4], pa.array([s.tobytes() for s in shingle_sets(rows.column(4), n)], pa.binary())],
                                             names=["node", "component", "size", "copies", "grams"])

    loaded = texts.mapInArrow(sets, "node bigint, component bigint, size bigint, copies bigint, grams binary").dropDuplicates(["node"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            rows = pa.Table.from_batches(group).combine_chunks()
            node, mine, copies = (rows[c].to_numpy() for c in ("node", "_mine", "copies"))
            grams = [np.frombuffer(g, dtype=np.uint64) for g in rows["grams"].to_pylist()]
            m, split = len(node), int((mine == mine[0]).sum())
            if split == m and rows["_i"][0] != rows["_j"][0]:
                continue
            linked = _linked(grams, threshold)
            if split < m:  # two blocks: only the pairs across
                linked[:split, :split] = False
                linked[split:, split:] = False
            n_rows, n_sets = linked @ copies, linked.sum(1)
            label, a_side, b_side = np.arange(m), [], []
            for a in range(m):
                b = np.flatnonzero(linked[a])
                b = b[label[b] != label[a]]
                if len(b):
                    b = _forest(label, a, b)
                    a_side += [node[a]] * len(b)
                    b_side += node[b].tolist()
            some = np.flatnonzero(n_sets)
            k, e = len(some), len(a_side)
            if k:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([node[some], np.array(a_side, dtype=np.int64)])), pa.array([None] * k + b_side, pa.int64()),
                     pa.array(np.concatenate([n_rows[some], np.zeros(e, dtype=np.int64)]), pa.int64()), pa.array(np.concatenate([n_sets[some], np.zeros(e, dtype=np.int64)]), pa.int64())],
                    names=["a", "b", "n_rows", "n_sets"])

    dealt = _in_block_pairs(loaded, ["component"], F.col("size"), VERIFY_BLOCK)
    found = materialize(dealt.select("component", "_i", "_j", "_mine", "node", "copies", "grams").mapInArrow(check, "a bigint, b bigint, n_rows bigint, n_sets bigint"))
    links = found.where(F.col("b").isNull()).groupBy(F.col("a").alias("node")).agg(F.sum("n_rows").alias("n_rows"), F.sum("n_sets").alias("n_sets"))
    return links, found.where(F.col("b").isNotNull()).select("a", "b")


def _linked(sets: list[np.ndarray], threshold: float, width: int = 2048) -> np.ndarray:
    """Boolean matrix of the pairs whose exact Jaccard similarity reaches the threshold; intersections by slices."""
    m = len(sets)
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=m)
    if m == 2:
        common = np.array([[0, len(np.intersect1d(*sets, assume_unique=True))]] * 2)
        common[1] = common[1][::-1]
    else:
        grams = np.concatenate(sets)
        owner = np.repeat(np.arange(m), sizes)
        order = np.argsort(grams, kind="stable")
        grams, owner = grams[order], owner[order]
        new = np.concatenate([[True], grams[1:] != grams[:-1]])
        column = np.cumsum(new) - 1
        often = np.bincount(column)
        keep = often[column] > 1  # an n-gram of one set meets nothing
        owner, column = owner[keep], np.cumsum(new[keep]) - 1 if keep.any() else column[keep]
        common = np.zeros((m, m), dtype=np.float32)
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, [lo, lo + width])
            part = np.zeros((m, width), dtype=np.float32)
            part[owner[a:b], column[a:b] - lo] = 1
            common += part @ part.T
        common = np.rint(common).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - common
    linked = common >= threshold * union - 1e-9
    np.fill_diagonal(linked, False)
    return linked
