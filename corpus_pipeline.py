"""A corpus pipeline of the training-data operators; each stage is written and read again by the next.

quality classifier -> line dedup -> n-gram join -> benchmark decontamination -> packing. All stages but the last return
the columns of documents; packing returns one row per piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import decontaminate, line_dedup, ngram_join, packing, quality
from pulsegrid.llm.queries import fold_of
from pulsegrid.llm.tables import table
from pulsegrid.llm.tokens import default_path
from pulsegrid.runtime import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
ID, HASH = "__doc_id", "__text_hash"
BROADCAST_KEYS = 1_000_000  # keys (two numbers each) handed to every task at most; beyond it Spark shuffles both sides


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(ID, F.col("doc_id")).withColumn(HASH, F.xxhash64("text"))


def _pick(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` whose (id, text hash) is in ``keys`` (left_semi) or not (left_anti); null ids compare as equal."""
    keys = materialize(keys.toDF(ID, HASH).distinct())
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    same = F.col(f"d.{ID}").eqNullSafe(F.col(f"x.{ID}")) & F.col(f"d.{HASH}").eqNullSafe(F.col(f"x.{HASH}"))
    return _keyed(docs).alias("d").join(keys.alias("x"), same, how).select(*docs.columns)


def _once(docs: DataFrame) -> DataFrame:
    """Rows equal in id and text reduced to one of them."""
    repeated = materialize(_keyed(docs).groupBy(ID, HASH).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(ID, HASH))
    if repeated.isEmpty():
        return docs
    return _pick(docs, repeated, "left_anti").unionByName(_pick(docs, repeated, "left_semi").dropDuplicates(["doc_id", "text"]))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled rows outside fold 1 of 3.

    Null and empty texts are scored like any other. Without labels of both classes nothing is rejected.
    """
    labels = table(spark, sf_dir, "labels").where(F.col("quality").isNotNull() & (fold_of("doc_id", 3) != 1)).select("doc_id", F.col("quality").alias("label"))
    rows = materialize(quality.add_statistics(_keyed(docs).select(F.struct(ID, HASH).alias("key"), "text"), id_col="key"))
    known = rows.join(labels, F.col(f"key.{ID}") == F.col("doc_id"))
    seen = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if min(seen.get(0, 0), seen.get(1, 0)) < 2:
        return docs
    scored = quality.score_rows(rows, quality.fit(known), id_col="key")
    return _pick(docs, scored.where(F.col("predicted") == 0).select("key.*"), "left_anti")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat, or nearly repeat, an earlier line; texts that lose everything go.

    ``n_chars`` follows the new text. Null and empty texts stay.
    """
    cut = line_dedup.remove_lines(docs, line_dedup.find_repeats(docs, edits=2, min_chars=20, exact_chars=1))
    return cut.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the lowest id.

    Rows are told apart by (id, text hash): rows equal in both are one document, of which one row stays.
    """
    once = _once(docs)
    keyed = _keyed(once).select(F.struct(ID, HASH).alias("key"), "text")
    joined = ngram_join.join_ngrams(keyed, threshold=0.8, n=5, tolerance=1e-6, id_col="key")
    return _pick(once, joined.where(~F.col("first")).select("key.*"), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word phrase of the benchmark."""
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), width=10)
    return _pick(docs, found.where("contaminated").select("doc_id", "text_hash"), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 ids."""
    return packing.pack_documents(docs, default_path(), window=2048, end=1)


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]
# model fits, edit-distance classes and tokenising are not SQL; tests/llm holds the stages against brute force
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
