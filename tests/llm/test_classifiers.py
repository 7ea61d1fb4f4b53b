"""Quality and toxicity: exact parts against plain formulas, held-out accuracy on the test tables, odd rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import quality, queries, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(1, ""), (2, None), (None, "x"), (4, "\n\n"), (5, "word " * 40_000), (5, "word " * 40_000), (6, "a\x00b"), (7, "é" * 3000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 0.5) for i, t in ODD], "doc_id bigint, text string, score double")


def test_discriminant_equals_the_density_formula():
    rng = np.random.default_rng(1)
    x = {k: rng.normal(k, 1 + k, (60, 3)) @ rng.normal(size=(3, 3)) for k in (0, 1)}
    m = quality.from_moments(np.array([60.0, 60.0]), np.array([x[k].sum(0) for k in (0, 1)]), np.array([x[k].T @ x[k] for k in (0, 1)]), shrinkage=0.2)
    cov = [np.cov(x[k].T, bias=True) for k in (0, 1)]
    pooled = np.diag(np.diag((cov[0] + cov[1]) / 2))
    point = rng.normal(size=(5, 3))
    dens = []
    for k in (0, 1):
        c, d = 0.8 * cov[k] + 0.2 * pooled, point - x[k].mean(0)
        dens.append(np.log(0.5) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))
    assert np.allclose(m.log_odds(point), dens[1] - dens[0])


def test_fit_over_partitions_equals_one_fit(spark):
    texts = [("Good words make a text. " * (i % 7 + 1) if i % 2 else "### $$$ %%% " * (i % 5 + 1)) + str(i) for i in range(60)]
    df = spark.createDataFrame([(i, t, i % 2 if i else None) for i, t in enumerate(texts)], "doc_id int, text string, label int").repartition(7)
    m = quality.fit(quality.add_statistics(df).join(df.select("doc_id", "label"), "doc_id"))
    x = quality.statistics(pa.array(texts[1:]))
    y = np.arange(1, 60) % 2
    own = [x[y == k] for k in (0, 1)]
    want = quality.from_moments(np.array([float(len(v)) for v in own]), np.array([v.sum(0) for v in own]), np.array([v.T @ v for v in own]), 0.05)
    assert np.allclose(m.log_odds(x), want.log_odds(x), rtol=1e-6)
    assert ((m.log_odds(x) > 0) == (y == 1)).all()


@pytest.mark.parametrize("labels, want", [([1] * 11, 12 / 13), ([0] * 11, 1 / 13), ([None] * 11, 0.5), ([1] + [0] * 10, 2 / 13)])
def test_too_few_labels_give_the_prior(spark, odd, labels, want):
    rows = quality.add_statistics(odd)
    known = rows.limit(0).withColumn("label", F.lit(None).cast("int"))
    for x in labels:
        known = known.unionByName(rows.limit(1).withColumn("label", F.lit(x).cast("int")))
    got = {round(r["score"], 9) for r in quality.score(odd, quality.fit(known)).collect()}
    assert got == {round(want, 9)}


def test_queries_on_empty_and_one_class_tables(spark, tmp_path):
    docs = spark.createDataFrame([(i, "some words here") for i in range(6)], "doc_id bigint, text string")
    for name, documents, label in (("a", docs.limit(0), None), ("b", docs, 1)):
        documents.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        docs.limit(6).select("doc_id", F.lit(label).cast("int").alias("quality"), F.lit(label).cast("int").alias("toxic")).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        for query in ("op10_quality", "op6_toxic_lexicon"):
            rows = queries.QUERIES[query](spark, f"{tmp_path}/{name}").collect()
            assert len(rows) == documents.count() and all(r["predicted"] == 1 for r in rows)


def test_odd_rows_get_finite_scores(spark, odd):
    x = np.random.default_rng(0).normal(size=(2, 40, len(quality.FEATURES)))
    m = quality.from_moments(np.array([40.0, 40.0]), x.sum(1), np.einsum("kni,knj->kij", x, x))
    lx = toxicity.Lexicon({" idiot ": 5.0, " tra": 4.0}, frozenset({("trash", "can")}))
    for rows in (quality.score(odd, m).collect(), quality.score_rows(quality.add_statistics(odd), m).collect(), toxicity.score(odd, lx).collect()):
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score(odd.limit(0), m).collect() == toxicity.score(odd.limit(0), lx).collect() == []
    assert toxicity.fit(odd, odd.select("doc_id", F.lit(None).cast("int").alias("label"))).weights == {}


def test_folding_undoes_disguises():
    lx = toxicity.Lexicon({" idiot ": 5.0, " tras": 4.0}, frozenset({("trash", "can")}))
    for text in ("an IDIOT.", "1d10t!", "ｉｄｉｏｔ", "іdіоt", "id1ot"):
        assert [h[0] for h in lx.hits(text)[0]] == ["idiot"], text
    assert lx.hits("idiots non-idiotic")[0] == []
    assert [h[0] for h in lx.hits("trash can, trashy trash")[0]] == ["trashy", "trash"]
    assert toxicity.fold("in 1984, 3.5 kg at 10:30") == "in 1984, 3.5 kg at 10:30"
    assert toxicity.fold("a55 a$$ i.d.i.o.t ІDІОТ МОRОN e-mail x_y 3.5.2") == "ass ass idiot idiot moron e-mail x_y 3.5.2"


def test_toxic_recall_and_precision(spark):
    rows = queries.op6_toxic_lexicon(spark, SF.replace("sf0.01", "sf0.1"))
    held = rows.where("held_out").join(spark.read.parquet(f"{SF.replace('sf0.01', 'sf0.1')}/labels.parquet"), "doc_id")
    hit, said, toxic = held.select(F.count_if((F.col("predicted") == 1) & (F.col("toxic") == 1)), F.count_if(F.col("predicted") == 1), F.count_if(F.col("toxic") == 1)).first()
    assert hit >= 0.9 * toxic and hit >= 0.9 * said


def test_hits_equal_a_plain_search():
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("ab"), rng.integers(1, 6))) for _ in range(300)]
    weights = {" ab": 1.0, " aba ": 3.0, " bb": 2.0}
    got = [(w, x) for w, x, _, _ in toxicity.Lexicon(weights).hits(" ".join(words))[0]]
    want = [(w, max(x for k, x in weights.items() if f" {w} ".startswith(k))) for w in words if any(f" {w} ".startswith(k) for k in weights)]
    assert got == want


@pytest.mark.parametrize("name, label, least", [("op10_quality", "quality", 0.97), ("op6_toxic_lexicon", "toxic", 0.88)])
def test_held_out_accuracy(spark, name, label, least):
    rows = queries.QUERIES[name](spark, SF)
    assert rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = rows.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    assert held.select(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0] >= least


def test_nested_keys_leave_one():
    counts = {" mor": (0, 40), " moro": (0, 40), " moron": (0, 40), " moron ": (0, 40), " ach": (1, 60), " achl": (1, 30), " achk": (0, 30), " rare": (0, 2)}
    chosen = toxicity.choose_weights(counts, clean=1000, toxic=100)
    assert set(chosen) == {" moron ", " ach", " achk"} or set(chosen) == {" moron ", " ach"}
