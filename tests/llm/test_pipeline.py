"""Pipeline stages on a small corpus, each against a plain version on its own input; odd rows; empty tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from pulsegrid.llm import queries

WORDS = [f"w{i}" for i in range(900)]
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, at int, label string, _hash string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(5)
    say = lambda n: " ".join(r.choice(WORDS) for _ in range(n)) + "."
    phrase = say(14)
    good = ["\n".join(say(r.randint(8, 30)) for _ in range(r.randint(1, 5))) for _ in range(60)]
    near = good[3].replace("\n", " ").split()
    bad = ["%%% &&& *** " * r.randint(5, 30) + str(i) for i in range(25)]
    texts = good + bad + [" ".join(near), " ".join(near + ["more"]), good[7], good[8] + "\n" + good[9].split("\n")[0], say(20) + " " + phrase + " " + say(5), "", None, "w1 " * 30_000]
    rows = [(i, t, "en", "s", len(t or ""), i, "x", "h") for i, t in enumerate(texts)]
    rows += [(None, say(40), None, None, None, None, None, None), (5, good[5], "en", "s", 1, 1, "x", "h"), (5, good[5], "en", "s", 1, 1, "x", "h")]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    path = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(60)] + [(60 + i, 0, 0) for i in range(25)] + [(60, None, None), (9999, 1, 1)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, phrase), (2, None), (3, "")], "item_id int, text string").write.parquet(f"{path}/benchmark.parquet")
    return spark.read.parquet(f"{path}/documents.parquet"), str(path), texts, phrase


def ids(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=str)


def test_quality_stage_rejects_the_junk(spark, tables):
    docs, path, texts, _ = tables
    kept = cp.keep_quality(spark, docs, path)
    assert kept.columns == docs.columns
    left = ids(kept)
    assert set(range(60)) <= set(left) and not set(range(60, 85)) & set(left) and None in left


def test_line_stage_keeps_first_places(spark, tables):
    docs, path, texts, _ = tables
    got = {}
    for r in cp.drop_repeated_lines(spark, docs, path).collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
        assert r["text"] is None or r["n_chars"] == len(r["text"])
    assert got[8] == [texts[8]] and 87 not in got  # a whole copy loses every line and goes
    assert 88 not in got and got[90] == [""] and got[91] == [None]
    assert got[86] == [texts[86]] and got[5] == [texts[5]] * 3  # rows equal in id and text are one document


def test_join_stage_leaves_one_of_each(spark, tables):
    docs, path, texts, _ = tables
    grams = [tuple(re.findall(r"[a-z0-9]+", (t or "").lower())) for t in texts]
    sets = [{g[k : k + 5] for k in range(max(1, len(g) - 4))} if g else ({t} if t else set()) for g, t in zip(grams, texts)]
    drop = {i for i in range(len(sets)) for j in range(i) if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    kept = cp.keep_one_of_each(spark, docs, path)
    assert kept.columns == docs.columns
    assert ids(kept) == sorted([i for i in range(len(texts)) if i not in drop] + [None], key=str)


def test_contaminated_go_and_pieces_cover_the_rest(spark, tables):
    docs, path, texts, phrase = tables
    kept = cp.drop_contaminated(spark, docs, path)
    assert set(range(len(texts))) - set(ids(kept)) == {i for i, t in enumerate(texts) if phrase.rstrip(".") in (t or "")}
    pieces = cp.pack(spark, kept, path)
    assert {r["doc_id"] for r in pieces.collect()} == set(ids(kept))


def test_run_and_empty_tables(spark, tables):
    docs, path, _, _ = tables
    assert [n for n, _ in cp.STAGES] == ["quality", "line_dedup", "ngram_join", "decontamination", "packing"]
    out = cp.run(spark, path)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0 and out.count() > 50
    none = docs.limit(0)
    for name, stage in cp.STAGES:
        assert stage(spark, none, path).collect() == [], name


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
