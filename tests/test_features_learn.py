import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import features as ft
from pulsegrid.operators import learn as ln
from pulsegrid.operators import peaks as pk
from pulsegrid.operators import signal as sg
from pulsegrid.operators import splits as sp
from pulsegrid.plans import experiments as ex
from pulsegrid.timeline import Timeline

TL = Timeline(chunk_rows=3)


def one(spark, values):
    return spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(values)], "session_id string, sample_idx bigint, x double")


def test_centred_mean_of_even_width(spark):
    out = sg.rolling_smooth(one(spark, [1, 2, 4, 8, 16, 32]), TL, {"m": F.col("x")}, 4).orderBy("sample_idx")
    assert [r.m for r in out.collect()] == pytest.approx([1.5, 7 / 3, 3.75, 7.5, 15, 56 / 3])


def test_zero_crossings_and_turns(spark):
    rows = ft.with_steps(one(spark, [1, -1, 1, -1]), TL, ["x"]).withColumn("window_start", F.lit(0))
    r = ft.emg_features(rows, TL, ["session_id", "window_start"], ["x"]).first()
    assert (r.x_ZC, r.x_SSC, r.x_WL) == (3, 2, 6.0)


def test_sine_in_band(spark):
    x = np.sin(2 * np.pi * 10 * np.arange(250) / 250)
    r = ft.band_power_sum(one(spark, x), ["session_id"], ["x"], F.col("sample_idx"), 250, 250.0).first()
    assert r.x_mu_power > 1000 * r.x_beta_power


def test_asymmetry_ratio(spark):
    df = spark.createDataFrame([(3.0, 1.0, 0.0, 0.0)], "l_mu_power double, r_mu_power double, l_beta_power double, r_beta_power double")
    assert df.select(ft.c3c4_asymmetry("l", "r")["Mu_Asymmetry_Ratio"].alias("v")).first().v == pytest.approx(2 / (4 + 1e-6))


def test_constrained_top_k(spark):
    c = spark.createDataFrame([("s", 1, 10, 1.0, 3.0, True), ("s", 1, 20, 1.0, 1.0, True), ("s", 1, 30, 1.0, 2.0, True)],
                              "session_id string, trial_id int, sample_idx bigint, peak_value double, peak_prominence double, kept_for_count boolean")
    t = spark.createDataFrame([("s", 1, 2)], "session_id string, trial_id int, expected_count int")
    got = pk.constrained_decode(t, c, Timeline(), "trial_id").orderBy("peak_order").collect()
    assert [(r.peak_order, r.sample_idx) for r in got] == [(1, 10), (2, 30)]


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(4)
    parts = [pd.DataFrame({"label": k, "a": rng.normal(m, 1, 120), "b": rng.normal(-m, 2, 120)}) for k, m in (("L", 0.0), ("R", 2.0), ("X", 4.0))]
    df = pd.concat(parts).reset_index(drop=True)
    df["g"] = np.arange(len(df)) // 6
    return df, spark.createDataFrame(df)


def test_discriminant_closed_form(cloud):
    pdf, df = cloud
    m = ln.fit_discriminant(df, ["a", "b"], "label", ["L", "R", "X"])
    x = pdf[["a", "b"]].to_numpy()
    means = np.array([x[pdf.label == k].mean(axis=0) for k in "LRX"])
    cov = sum((x[pdf.label == k] - mu).T @ (x[pdf.label == k] - mu) for k, mu in zip("LRX", means)) / len(x)
    g = x @ np.linalg.solve(cov, means.T) - 0.5 * np.einsum("kd,dk->k", means, np.linalg.solve(cov, means.T)) + np.log(1 / 3)
    want = np.exp(g - g.max(axis=1, keepdims=True))
    want /= want.sum(axis=1, keepdims=True)
    out = m.score(df).toPandas()
    assert out[["prob_L", "prob_R", "prob_X"]].to_numpy() == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("kind", [m for m in ln.MODELS if m != "svm"])
def test_models_learn(cloud, kind):
    _, df = cloud
    m = ln.fit_model(kind, df, ["a", "b"], "label", ["L", "R", "X"], trees=10)
    assert ln.evaluate(m.score(df), "label", ["L", "R", "X"]).first().accuracy > 0.6


def test_svm_learns_one_against_rest(cloud):
    _, df = cloud
    m = ln.fit_model("svm", df.filter("label <> 'X'").coalesce(1), ["a", "b"], "label", ["L", "R"])
    assert ln.evaluate(m.score(df.filter("label <> 'X'")), "label", ["L", "R"]).first().accuracy > 0.6


def test_group_splits_keep_groups_whole(cloud):
    _, df = cloud
    folds = sp.stratified_group_folds(df, ["g"], "label", 5).groupBy("g").agg(F.count_distinct("fold").alias("n"), F.min("fold").alias("fold"), F.min("label").alias("l")).toPandas()
    assert (folds.n == 1).all()
    assert folds.groupby(["l", "fold"]).size().groupby("l").agg(lambda s: s.max() - s.min()).max() <= 1
    held = sp.stratified_group_holdout(df, ["g"], "label", 0.25).groupBy("g").agg(F.min("split_role").alias("r"), F.count_distinct("split_role").alias("n")).toPandas()
    assert (held.n == 1).all() and (held.r == "test").sum() == 15


def test_permuting_a_column_keeps_its_values(cloud):
    pdf, df = cloud
    out = ln.permute_column(df, "a").toPandas()
    assert sorted(out.a) == pytest.approx(sorted(pdf.a)) and not np.allclose(out.sort_values("b").a, pdf.sort_values("b").a)


def macro_f1(truth, found, labels):
    f1 = [2 * sum((truth == k) & (found == k)) / max(1, sum(truth == k) + sum(found == k)) for k in labels]
    return sum(f1) / len(f1)


@pytest.mark.parametrize("kind", ["lda", "tree"])
def test_importance_equals_shuffling_one_feature_after_another(spark, cloud, kind):
    pdf, df = cloud
    labels = ["L", "R", "X"]
    m = ln.fit_model(kind, df, ["a", "b"], "label", labels)
    # rows that lack a feature score NULL until another row's value takes its place
    df = df.withColumn("a", F.when(F.col("g") == 7, None).otherwise(F.col("a")))
    got = {r.feature: r for r in ln.permutation_importance(m, df, ["b", "a"], "label", labels, repeats=3).collect()}
    dealt = ln.permuted(df, ["b", "a"], 3).toPandas()
    assert (dealt.groupby("_repeat").size() == len(pdf)).all()
    orders = [tuple(x[0] for x in part.sort_values(["g", "label", "b"])["_other"]) for _, part in dealt.groupby("_repeat")]
    assert len(set(orders)) == 3 and len({tuple(sorted(o)) for o in orders}) == 1

    def score(frame):
        rows = spark.createDataFrame(frame, "label string, a double, b double")
        out = m.score(rows).where("predicted IS NOT NULL").toPandas()
        return macro_f1(out.label, out.predicted, labels)

    plain = lambda frame: [(r.label, None if r.a != r.a else r.a, r.b) for r in frame.itertuples()]
    base = score(plain(df.toPandas()))
    for at, f in enumerate(["b", "a"]):
        losses = [base - score(plain(part.assign(**{f: [np.nan if x[at] is None else x[at] for x in part["_other"]]}))) for _, part in dealt.groupby("_repeat")]
        assert got[f].repeats == 3 and got[f].importance == pytest.approx(np.mean(losses)) and got[f].importance_std == pytest.approx(np.std(losses))


def test_importance_query_covers_every_feature(spark):
    from workload import learn_q

    out = learn_q.permutation_importance(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.feature for r in out) == sorted(learn_q.VF) and {r.repeats for r in out} == {10}


def test_folds_by_subtraction_equal_single_fits(spark):
    rng = np.random.default_rng(2)
    rows = [(f"s{k % 4}", "LEFT" if y else "RIGHT", *(rng.normal(size=3) + y * np.array([1.0, 0.5, 0.0])).tolist()) for k, y in enumerate(rng.integers(0, 2, 400))]
    rows[5] = (*rows[5][:2], None, *rows[5][3:])
    df = spark.createDataFrame(rows, "session_id string, label string, a double, b double, c double")
    names, labels = ["s0", "s1", "s2"], ["LEFT", "RIGHT"]
    got = {(r.scope, r.fold): r for r in ex.leave_one_session_out(df.where("session_id <> 's3'"), names, ["a", "b", "c"], "label", labels, ["lda"], stress=df.where("session_id = 's3'")).collect()}
    for s in names:
        m = ln.fit_model("lda", df.where(F.col("session_id").isin(*names) & (F.col("session_id") != s)), ["a", "b", "c"], "label", labels)
        want = ln.evaluate(m.score(df.where(F.col("session_id") == s)), "label", labels).first()
        assert (got["fold", s].n, got["fold", s].unscored) == (want.n, want.unscored) and got["fold", s].macro_f1 == pytest.approx(want.macro_f1)
    assert got["pooled", ""].n == sum(got["fold", s].n for s in names) and got["stress", ""].n == 100
    pairs = ex.cross_session_pairs(df, [("s0", "s1"), ("s2", "s1")], ["a", "b", "c"], "label", labels, "lda").collect()
    for r in pairs:
        m = ln.fit_model("lda", df.where(F.col("session_id") == r.train_session), ["a", "b", "c"], "label", labels)
        assert r.accuracy == pytest.approx(ln.evaluate(m.score(df.where(F.col("session_id") == r.test_session)), "label", labels).first().accuracy)


def test_collinear_features_leave_a_usable_discriminant(spark):
    rng = np.random.default_rng(3)
    rows = [("A" if y else "B", x + 2 * y, 3 * (x + 2 * y), 1.0) for x, y in zip(rng.normal(size=200).tolist(), rng.integers(0, 2, 200).tolist())]
    df = spark.createDataFrame(rows, "label string, a double, b double, c double")
    m = ln.fit_model("lda", df, ["a", "b", "c"], "label", ["A", "B"])
    assert np.isfinite(m.weights).all() and ln.evaluate(m.score(df), "label", ["A", "B"]).first().accuracy > 0.75
    with pytest.raises(ValueError, match="no complete"):
        ln.fit_model("lda", df.limit(0), ["a", "b", "c"], "label", ["A", "B"])
