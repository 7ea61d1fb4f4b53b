"""Benchmark decontamination with a positional inverted index.

The index stores one posting (term, document, position) for every training word that occurs in some test item, and
one end posting per document that holds its number of words. A window of test words is looked up from its rarest
term: each posting of that term, shifted back by the term's offset, proposes a start; the shifted postings of the
other terms are intersected with it. All terms at their offsets make an exact phrase; within a tolerance, a proximity
match. Everything is a join of postings; window tables are broadcast by Spark only while they are small.

A document is known by its id and a hash of its text, so repeated rows get equal results and null ids work.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.tables import in_steps
from pulsegrid.runtime import materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
END = "\x00"  # cannot be a word
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DOC = ["_doc", "_hash"]


def words(text: str | Column) -> Column:
    """Words of a text, A-Z lower-cased; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


@dataclass(frozen=True)
class TestWindows:
    """``windows``: window, n; ``terms``: window, term, offset; ``items``: window, item; ``vocabulary``: word, term."""

    windows: DataFrame
    terms: DataFrame
    items: DataFrame
    vocabulary: DataFrame


def test_windows(items: DataFrame, width: int = 10, id_col: str = "item_id", text_col: str = "text") -> TestWindows:
    """Distinct windows of ``width`` consecutive words; an item of fewer words is one window, one without words none."""
    split = items.select(F.col(id_col).cast("string").alias("item"), words(text_col).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    cut = materialize(split.select("item", "w", F.explode(starts).alias("s")).select("item", F.expr(f"slice(w, s, {width})").alias("words")))
    windows = materialize(cut.select("words").distinct().withColumn("window", F.monotonically_increasing_id()))
    vocabulary = windows.select(F.explode("words").alias("word")).union(windows.sparkSession.createDataFrame([(END,)], "word string")).distinct()
    vocabulary = materialize(vocabulary.withColumn("term", F.when(F.col("word") == END, F.lit(-1)).otherwise(F.monotonically_increasing_id())))
    terms = windows.select("window", F.posexplode("words").alias("offset", "word")).join(vocabulary, "word").select("window", "term", "offset")
    return TestWindows(windows.select("window", F.size("words").alias("n")), materialize(terms), materialize(cut.join(windows, "words").select("window", "item").distinct()), vocabulary)


def _split_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of the texts, dictionary-coded, and the n+1 places where texts begin among them (same rule as `words`)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]].copy()
    at = at - at[0]
    data[(data >= 65) & (data <= 90)] += 32
    inside = (data >= 128) | ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57))
    begins, closes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]  # a word ends with its text
    begins[edges] |= inside[edges]
    closes[edges - 1] |= inside[edges - 1]
    begin, close = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    # pieces alternate: what stands before a word, the word
    cut = np.concatenate([np.column_stack([begin, close]).ravel(), [len(data)]])
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(cut), pa.py_buffer(data)])
    coded = pieces.take(pa.array(np.arange(0, len(cut) - 1, 2))).dictionary_encode()
    return coded, np.searchsorted(begin, at)


def build_index(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 1_000_000) -> DataFrame:
    """Postings ``term, _doc, _hash, pos`` of the words of ``vocabulary``; term -1 marks the end of each document.

    The vocabulary travels to the tasks in blocks of at most ``block`` words; more blocks mean more passes.
    """
    listed = docs.select(F.col(id_col).alias("_doc"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("_text"))
    kind = listed.schema["_doc"].dataType.simpleString()
    known = [(r["word"], r["term"]) for r in vocabulary.where(F.col("term") >= 0).collect()]  # the words of the test items

    def one_pass(part: list[tuple[str, int]], first: bool) -> DataFrame:
        names, numbers = [w.encode() for w, _ in part], np.array([t for _, t in part], dtype=np.int64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            value_set = pa.array(names, pa.large_binary())
            for rows in in_steps(batches, 2, 1000):
                coded, at = _split_words(rows.column(2))
                place = pc.index_in(coded.dictionary, value_set=value_set).fill_null(-1).to_numpy()
                found = place[coded.indices.to_numpy()] if len(coded) else np.zeros(0, dtype=np.int32)
                where = np.flatnonzero(found >= 0)
                doc = np.searchsorted(at, where, side="right") - 1
                term, pos = numbers[found[where]], where - at[doc]
                if first:
                    doc = np.concatenate([doc, np.arange(rows.num_rows)])
                    term = np.concatenate([term, np.full(rows.num_rows, -1)])
                    pos = np.concatenate([pos, np.diff(at)])
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), rows.column(0).take(take), rows.column(1).take(take), pa.array(pos, pa.int32())],
                                                 names=["term", "_doc", "_hash", "pos"])

        return listed.mapInArrow(run, f"term bigint, _doc {kind}, _hash bigint, pos int")

    passes = [one_pass(known[i : i + block], i == 0) for i in range(0, max(1, len(known)), block)]
    return reduce(DataFrame.unionByName, passes)


def _same_doc(left: str, right: str) -> Column:
    return F.col(f"{left}._doc").eqNullSafe(F.col(f"{right}._doc")) & (F.col(f"{left}._hash") == F.col(f"{right}._hash"))


def _candidates(index: DataFrame, tests: TestWindows) -> tuple[DataFrame, DataFrame]:
    """Starts proposed by each window's rarest term, and the remaining terms of each window."""
    counts = index.where(F.col("term") >= 0).groupBy("term").count()
    rank = F.row_number().over(Window.partitionBy("window").orderBy("count", "offset"))
    ranked = materialize(tests.terms.join(counts, "term", "left").withColumn("count", F.coalesce("count", F.lit(0))).withColumn("rank", rank))
    # a window with a term that the corpus lacks has no match at all
    alive = ranked.groupBy("window").agg(F.min("count").alias("least")).where(F.col("least") > 0).select("window")
    ranked = ranked.join(alive, "window")
    rarest = ranked.where(F.col("rank") == 1).select("window", "term", F.col("offset").alias("_at"))
    found = index.join(rarest, "term").select("_doc", "_hash", "window", (F.col("pos") - F.col("_at")).alias("start"), F.col("_at").alias("anchor"))
    return found, ranked.where(F.col("rank") > 1).select("window", "term", "offset", "rank")


def _meet(index: DataFrame, found: DataFrame, others: DataFrame) -> DataFrame:
    """For each proposed start, the offsets of ``others`` whose shifted postings agree with it."""
    needs = found.join(others, "window").select(*DOC, "window", "start", "term", "offset", (F.col("start") + F.col("offset")).alias("pos"))
    useful = index.join(others.select("term").distinct(), "term", "left_semi")
    on = _same_doc("n", "p") & (F.col("n.term") == F.col("p.term")) & (F.col("n.pos") == F.col("p.pos"))
    return needs.alias("n").join(useful.alias("p"), on).select("n._doc", "n._hash", "n.window", "n.start", "n.offset").distinct()


def phrase_matches(index: DataFrame, tests: TestWindows) -> DataFrame:
    """Every exact occurrence of every window: ``_doc, _hash, window, start, n``."""
    key = [*DOC, "window", "start"]
    found, others = _candidates(index, tests)
    found = materialize(found.where(F.col("start") >= 0).select(*key).distinct().join(tests.windows, "window").select(*key, "n"))
    second = _meet(index, found.where(F.col("n") > 1), others.where(F.col("rank") == 2)).select(*key)
    left = materialize(second.join(tests.windows, "window").select(*key, "n"))
    docs = materialize(left.where(F.col("n") > 2).select(*DOC).distinct())
    near = index.alias("p").join(docs.alias("d"), _same_doc("p", "d"), "left_semi")
    rest = _meet(near, left.where(F.col("n") > 2), others.where(F.col("rank") > 2))
    whole = rest.groupBy(*key).count().join(tests.windows, "window").where(F.col("count") == F.col("n") - 2).select(*key, "n")
    return whole.unionByName(found.where(F.col("n") == 1)).unionByName(left.where(F.col("n") == 2))


def proximity_matches(index: DataFrame, tests: TestWindows, slop: int) -> DataFrame:
    """Occurrences of a window's rarest term that have every other term within ``slop`` positions of its offset."""
    found, others = _candidates(index, tests)
    found = materialize(found.distinct())
    near = index.alias("p").join(found.select(*DOC).distinct().alias("d"), _same_doc("p", "d"), "left_semi")
    needs = found.join(others, "window").select(*DOC, "window", "start", "anchor", "term", "offset")
    on = _same_doc("n", "p") & (F.col("n.term") == F.col("p.term")) & (F.abs(F.col("n.start") + F.col("n.offset") - F.col("p.pos")) <= slop)
    met = needs.alias("n").join(near.select("term", *DOC, "pos").distinct().alias("p"), on).select("n._doc", "n._hash", "n.window", "n.start", "n.offset").distinct()
    single = found.join(tests.windows.where(F.col("n") == 1), "window").select(*DOC, "window", "start", "n")
    several = met.groupBy(*DOC, "window", "start").count().join(tests.windows, "window").where(F.col("count") == F.col("n") - 1)
    return several.select(*DOC, "window", "start", "n").unionByName(single)


def report(index: DataFrame, matches: DataFrame, tests: TestWindows, id_col: str = "doc_id") -> DataFrame:
    """One row per document row: words, hit words, items found, and the digest of their sorted ids."""
    matches = materialize(matches)
    spans = matches.select(*DOC, F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("at"))
    hit = spans.distinct().groupBy(*DOC).agg(F.count(F.lit(1)).alias("n_hit"))
    items = (
        matches.select(*DOC, "window").distinct().join(tests.items, "window").select(*DOC, "item").distinct()
        .groupBy(*DOC).agg(F.sort_array(F.collect_list("item")).alias("items"))  # bounded by the test items
    )
    found = hit.alias("h").join(items.alias("i"), _same_doc("h", "i")).select("h._doc", "h._hash", "n_hit", "items")
    ends = index.where(F.col("term") == -1).select(*DOC, F.col("pos").cast("bigint").alias("n_words"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("bigint")
    items_of = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return ends.alias("e").join(found.alias("f"), _same_doc("e", "f"), "left").select(
        F.col("e._doc").alias(id_col), F.col("e._hash").alias("text_hash"), "n_words", n_hit.alias("n_hit"), F.size(items_of).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items_of, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def find_contamination(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`report` of exact phrase matches for all documents. Without items or words nothing is contaminated."""
    tests = test_windows(items, width)
    index = materialize(build_index(docs, tests.vocabulary, id_col, text_col))
    return report(index, phrase_matches(index, tests), tests, id_col)
