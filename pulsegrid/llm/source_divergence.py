"""How far the sources of a language differ in their vocabulary, term by term and source by source, in exact integers.

A term of a language is kept if enough of its documents hold it. Every source and the language as a whole give every kept
term a smoothed share ``p`` in units of ``1 / SCALE``. Two reports follow: the total difference of every two sources of a
language, and for every source its ``top`` terms of largest surplus over the language.

The surplus of a term never falls when its count in the source is higher or its count in the language lower. So a term
that ``top`` or more others of its source dominate (count there no lower, count in the language no higher, earlier in
UTF-8 order) cannot be among the first ``top``. Each partition keeps only its dominance skyband, the skybands of a source
are merged by the same rule, and what remains is ranked exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.tables import in_steps, partitions
from pulsegrid.runtime import materialize

SCALE = 1_000_000_000
SMOOTHING = 5
BYTE = np.arange(256)
LETTER = ((BYTE | 32) >= 97) & ((BYTE | 32) <= 122) & (BYTE < 128) | (BYTE >= 128)
BROADCAST_TERMS = 500_000  # kept terms handed to every task at most; beyond it Spark shuffles both sides
# one block of the source-by-source report: sources a side, and terms
BLOCK_SOURCES, BLOCK_TERMS = 32, 4096
KEPT_ROWS = 4096  # rows of a skyband compared with a block of candidates at once


def _coded_terms(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All terms of the texts, A-Z lower-cased and dictionary-coded, and the text that each stands in."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]].copy()
    at = at - at[0]
    data[(data >= 65) & (data <= 90)] += 32
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = LETTER[data]
    step = inside[1:] != inside[:-1]
    step[at[1:-1]] |= inside[at[1:-1] + 1] & inside[at[1:-1]]  # a term ends with its text
    begin = np.flatnonzero(step & inside[1:])
    close = np.append(begin[1:], len(data))
    ends = np.flatnonzero(step & inside[:-1])
    close = ends[np.searchsorted(ends, begin, side="right")] if len(begin) else close[:0]
    cut = np.concatenate([np.column_stack([begin, close]).ravel(), [len(data)]])
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(cut), pa.py_buffer(data)])
    return pieces.take(pa.array(np.arange(0, len(cut) - 1, 2))).dictionary_encode(), np.searchsorted(at, begin, side="right") - 1


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, source, term, n, docs`` of a few megabytes of text at a time."""
    for rows in in_steps(batches, 2):
        terms, doc = _coded_terms(rows.column(2))
        if not len(terms):
            continue
        size = len(terms.dictionary)
        pair, times = np.unique(doc * size + terms.indices.to_numpy(), return_counts=True)
        lang, source = (pc.fill_null(rows.column(i), "").dictionary_encode() for i in (0, 1))
        group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        cell, where = np.unique(group[pair // size] * size + pair % size, return_inverse=True)
        group = cell // size
        yield pa.RecordBatch.from_arrays(
            [lang.dictionary.take(pa.array(group // len(source.dictionary))), source.dictionary.take(pa.array(group % len(source.dictionary))),
             terms.dictionary.take(pa.array(cell % size)).cast(pa.binary()).cast(pa.string()),
             pa.array(np.bincount(where, times).astype(np.int64)), pa.array(np.bincount(where))], names=["lang", "source", "term", "n", "docs"])


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + s) / (total + s * terms)), in decimals so that no count overflows."""
    top = (count + SMOOTHING).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return (F.call_function("div", top, (total + SMOOTHING * terms).cast("decimal(20,0)")) + 1).cast("bigint")


def term_counts(docs: DataFrame, min_docs: int = 30) -> tuple[DataFrame, DataFrame]:
    """Written tables ``counts`` (lang, source, term, n, all: its count in the language) and ``groups``.

    ``groups`` has every occurring lang and source with ``total`` (kept terms there), ``lang_total`` and ``terms`` (kept
    terms of the language). A null text, lang or source reads as ''. Every row is a document, repeated rows too.
    """
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")], "text")
    each = rows.mapInArrow(_count_terms, "lang string, source string, term string, n bigint, docs bigint")
    each = materialize(each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = materialize(each.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all")).where(F.col("docs") >= min_docs).select("lang", "term", "all"))
    few = F.broadcast(kept) if kept.count() <= BROADCAST_TERMS else kept
    counts = materialize(each.join(few, ["lang", "term"]).select("lang", "source", "term", "n", "all"))
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    totals = own.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    groups = (
        rows.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left").join(totals, "lang", "left")
        .select("lang", "source", zero("total"), zero("lang_total"), zero("terms"))
    )
    return counts, materialize(groups)


def skyband(high: np.ndarray, low: np.ndarray, k: int, held: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Which rows fewer than ``k`` earlier rows dominate (``high`` no lower, ``low`` no higher), ``held`` rows being earlier still.

    It is enough to count dominating rows that are kept themselves: a row with ``k`` dominating rows has ``k`` kept ones.
    """
    n = len(high)
    beaten = np.zeros(n, dtype=np.int64)
    if held is not None:
        for a in range(0, len(held[0]), KEPT_ROWS):
            h, l = held[0][a : a + KEPT_ROWS], held[1][a : a + KEPT_ROWS]
            beaten += ((h[None, :] >= high[:, None]) & (l[None, :] <= low[:, None])).sum(1)
    keep = beaten < k
    for i in np.flatnonzero(keep):
        if beaten[i] >= k:
            keep[i] = False
            continue
        beaten[i + 1 :] += (high[i] >= high[i + 1 :]) & (low[i] <= low[i + 1 :])
    return keep


def _prune(frames: Iterator[pd.DataFrame], k: int, block: int = 512) -> Iterator[pd.DataFrame]:
    """Rows sorted by lang, source and term, cut to the skyband of each source; holds the skyband of one source."""
    now, high, low = None, [], []
    for frame in frames:
        place = frame["lang"].ne(frame["lang"].shift()) | frame["source"].ne(frame["source"].shift())
        borders = [*np.flatnonzero(place.to_numpy()), len(frame)]
        for a, b in zip(borders, borders[1:]):
            key = (frame["lang"].iat[a], frame["source"].iat[a])
            if key != now:
                now, high, low = key, [], []
            for c in range(a, b, block):
                part = frame.iloc[c : min(c + block, b)]
                g, l = part["n"].to_numpy(), part["all"].to_numpy()
                keep = skyband(g, l, k, (np.concatenate(high), np.concatenate(low)) if high else None)
                if keep.any():
                    high.append(g[keep])
                    low.append(l[keep])
                    yield part[keep]


def surplus_terms(counts: DataFrame, groups: DataFrame, top: int = 50) -> DataFrame:
    """``lang, source, item, value, rank``: the ``top`` terms of each source with the largest surplus over its language."""
    schema = "lang string, source string, term string, n bigint, `all` bigint"
    order = ["lang", "source", "term"]
    prune = lambda df: df.sortWithinPartitions(*order).mapInPandas(lambda frames: _prune(frames, top), schema)
    local = prune(counts.select("lang", "source", "term", "n", "all").repartition(partitions(counts.sparkSession), *order))
    merged = prune(local.repartition(partitions(counts.sparkSession), "lang", "source"))
    both = merged.join(groups, ["lang", "source"])
    p, q = _share(F.col("n"), F.col("total"), F.col("terms")), _share(F.col("all"), F.col("lang_total"), F.col("terms"))
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = both.select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where(F.col("value") > 0).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= top)


def source_distances(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value, rank``: every other source of the language by its total difference over the kept terms.

    A block holds up to `BLOCK_SOURCES` sources a side and one hash bucket of terms, so no task sees all sources or all
    terms of a language. Blocks give what two sources differ by above their shares without any count; the rest is those
    two shares' difference times the number of terms. Without kept terms every value is 0.
    """
    own = F.when(F.col("terms") > 0, _share(F.lit(0), F.col("total"), F.greatest("terms", F.lit(1)))).otherwise(0)
    # one row per source and language
    numbered = materialize(groups.select("lang", "source", "total", "terms", own.alias("base"), (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("at")))
    buckets = F.greatest(F.ceil(F.col("terms") / BLOCK_TERMS), F.lit(1)).cast("int")
    sides = numbered.groupBy("lang").agg((F.max("at") / BLOCK_SOURCES).cast("int").alias("last"))
    cells = counts.join(numbered, ["lang", "source"]).select(
        "lang", "at", "base", "term", _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), F.pmod(F.xxhash64("term"), buckets).cast("int").alias("bucket"))
    every = numbered.select("lang", "at", "base", F.lit(None).cast("string").alias("term"), F.lit(None).cast("bigint").alias("p"), F.explode(F.sequence(F.lit(0), buckets - 1)).alias("bucket"))
    side = (F.col("at") / BLOCK_SOURCES).cast("int")
    placed = cells.unionByName(every).join(sides, "lang").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    placed = placed.select("lang", "bucket", F.least(side, "other").alias("lo"), F.greatest(side, "other").alias("hi"), "at", "base", "term", "p")

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        sources, at = np.unique(rows["at"].to_numpy(), return_inverse=True)
        own = np.zeros(len(sources), dtype=np.int64)
        own[at] = rows["base"].to_numpy()
        held = rows["term"].notna().to_numpy()
        where, terms = pd.factorize(rows["term"][held])
        p = np.repeat(own[:, None], len(terms), axis=1)
        p[at[held], where] = rows["p"][held].to_numpy(dtype=np.int64)
        right = np.flatnonzero(sources // BLOCK_SOURCES == rows["hi"].iat[0])
        out = [np.zeros((0, 3), dtype=np.int64)]
        for x in np.flatnonzero(sources // BLOCK_SOURCES == rows["lo"].iat[0]):
            y = right[right > x]
            d = np.abs(p[y] - p[x]).sum(1) - np.abs(own[y] - own[x]) * len(terms)
            out.append(np.column_stack([np.full(len(y), sources[x]), sources[y], d]))
        out = np.concatenate(out)
        return pd.DataFrame({"lang": rows["lang"].iat[0], "a": out[:, 0], "b": out[:, 1], "d": out[:, 2]})

    extra = placed.groupBy("lang", "bucket", "lo", "hi").applyInPandas(block, "lang string, a bigint, b bigint, d bigint").groupBy("lang", "a", "b").agg(F.sum("d").alias("d"))
    both = F.explode(F.array(F.struct(F.col("a").alias("at"), F.col("b").alias("to")), F.struct(F.col("b").alias("at"), F.col("a").alias("to"))))
    pairs = extra.select("lang", "d", both.alias("x")).select("lang", "d", "x.at", "x.to")
    one = numbered.select("lang", "at", "source", "terms", F.col("base").alias("base_a"))
    two = numbered.select("lang", F.col("at").alias("to"), F.col("source").alias("item"), F.col("base").alias("base_b"))
    valued = pairs.join(one, ["lang", "at"]).join(two, ["lang", "to"]).select(
        "lang", "source", "item", (F.col("d") + F.col("terms") * F.abs(F.col("base_a") - F.col("base_b"))).alias("value"))
    return valued.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """Both reports in one table: ``lang, source, part`` (`pair` or `term`), ``item, value, rank``.

    Null lang, source and text read as ''; an empty table gives no rows; a language of one source has no pairs, one
    without kept terms only pairs of value 0. Ties go to the item that comes first in UTF-8. Columns other than lang,
    source and text are not looked at.
    """
    counts, groups = term_counts(docs, min_docs)
    pairs = source_distances(counts, groups).withColumn("part", F.lit("pair"))
    terms = surplus_terms(counts, groups, top).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
