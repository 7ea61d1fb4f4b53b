"""Split, normalisation and model queries over window features of the lineitem recordings."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pulsegrid.functions import labels as lb
from pulsegrid.operators import events as evt
from pulsegrid.operators import features as ft
from pulsegrid.operators import learn as ln
from pulsegrid.operators import metrics as mt
from pulsegrid.operators import splits as sp
from pulsegrid.operators import windows as wn
from pulsegrid.plans import experiments as ex
from pulsegrid.runtime import materialize
from pulsegrid.timeline import Timeline
from workload import windows_q as wq
from workload.base import CHANNELS, LI, r, rounded, table
from workload.registry import query

FEATS = [f"{c}_rms" for c in CHANNELS]
SUP = "cat AS (SELECT s_suppkey AS session_id, n_regionkey AS family, row_number() OVER (PARTITION BY n_regionkey ORDER BY s_suppkey) AS session_rank FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def catalog(spark, sf):
    c = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("s_suppkey").alias("session_id"), F.col("n_regionkey").alias("family")).withColumn(
        "session_rank", F.row_number().over(Window.partitionBy("family").orderBy("session_id")))


KEY = "session_id, segment_index, window_start, label"


@query(f"""{wq.FWALL}, {SUP}, ro AS (SELECT session_id, CASE WHEN session_rank = max(session_rank) OVER (PARTITION BY family) THEN 'test' WHEN session_rank <= 3 THEN 'train' END AS split_role FROM cat)
SELECT {KEY}, split_role FROM fw JOIN ro USING (session_id) WHERE split_role IS NOT NULL""")
def session_order_split(spark, sf):
    out = sp.session_order_split(wq.feature_windows(spark, sf), catalog(spark, sf), 3)
    return out.select("session_id", "segment_index", "window_start", "label", "split_role")


@query(f"""{wq.FWALL}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY window_start) AS rn, count(*) OVER (PARTITION BY session_id) AS n FROM fw)
SELECT {KEY}, CASE WHEN rn <= greatest(1, least(n - 1, round_even(n * 0.7, 0))) THEN 'train' ELSE 'test' END AS split_role FROM n""")
def chronological_split(spark, sf):
    out = sp.chronological_split(materialize(wq.feature_windows(spark, sf)), Timeline(pos="window_start", chunk_rows=128), 0.7)
    return out.select("session_id", "segment_index", "window_start", "label", "split_role")


@query(f"""{wq.FWALL}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id, label ORDER BY window_start) AS rn, count(*) OVER (PARTITION BY session_id, label) AS n FROM fw)
SELECT {KEY}, CASE WHEN rn <= floor(n * (1 - 0.3::DOUBLE)) THEN 'train' ELSE 'test' END AS split_role FROM n""")
def class_time_split(spark, sf):
    out = sp.class_time_split(materialize(wq.feature_windows(spark, sf)), Timeline(pos="window_start", chunk_rows=128), "label")
    return out.select("session_id", "segment_index", "window_start", "label", "split_role")


GRP = "md5(concat_ws('|', session_id, segment_index, '7'))"


@query(f"""{wq.FWALL}, g AS (SELECT session_id, segment_index, min(label) AS c FROM fw GROUP BY 1, 2), d AS (SELECT *, (row_number() OVER (PARTITION BY c ORDER BY {GRP}) - 1) % 5 AS fold FROM g)
SELECT {KEY}, fold FROM fw JOIN d USING (session_id, segment_index)""")
def stratified_group_folds(spark, sf):
    out = sp.stratified_group_folds(materialize(wq.feature_windows(spark, sf)), ["session_id", "segment_index"], "label", 5, 7)
    return out.select("session_id", "segment_index", "window_start", "label", "fold")


@query(f"""{wq.FWALL}, g AS (SELECT session_id, segment_index, min(label) AS c, {GRP} AS h FROM fw GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY h) AS rc, count(*) OVER (PARTITION BY c) AS nc, count(*) OVER () AS n FROM g),
  q AS (SELECT *, least(nc, CASE WHEN round_even(nc * 0.25, 0) = 0 AND nc > 1 THEN 1 ELSE round_even(nc * 0.25, 0) END) AS quota FROM n), p AS (SELECT *, rc <= quota AS i FROM q),
  o AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY h) AS ro, count(*) FILTER (i) OVER () AS ch, greatest(1, least(n - 1, round_even(n * 0.25, 0))) AS want FROM p)
SELECT {KEY}, CASE WHEN CASE WHEN i THEN ro <= want ELSE ro <= want - ch END THEN 'test' ELSE 'train' END AS split_role FROM fw JOIN o USING (session_id, segment_index)""")
def stratified_group_holdout(spark, sf):
    out = sp.stratified_group_holdout(materialize(wq.feature_windows(spark, sf)), ["session_id", "segment_index"], "label", 0.25, 7)
    return out.select("session_id", "segment_index", "window_start", "label", "split_role")


@query(f"""{wq.FWALL}, c AS (SELECT session_id, {', '.join(f'avg({f}) AS m_{f}, coalesce(nullif(stddev_pop({f}), 0), 1) AS s_{f}' for f in FEATS)} FROM fw WHERE label = 'REST' AND end_time_sec <= 200 GROUP BY 1)
SELECT {KEY}, {', '.join(r(f'({f} - m_{f}) / s_{f}') + f' AS {f}' for f in FEATS)} FROM fw JOIN c USING (session_id)""")
def calibration_zscore(spark, sf):
    w = materialize(wq.feature_windows(spark, sf))
    out = sp.calibration_zscore(w, wn.calibration_subset(w, 200.0), Timeline(pos="window_start", chunk_rows=128), FEATS)
    return rounded(out.select("session_id", "segment_index", "window_start", "label", *FEATS), FEATS)


@query(f"""{wq.FWALL}, s AS (SELECT *, CASE WHEN session_id % 4 = 0 THEN 'test' ELSE 'train' END AS split_role FROM fw), m AS (SELECT {', '.join(f'avg({f}) AS m_{f}, coalesce(nullif(stddev_pop({f}), 0), 1) AS s_{f}' for f in FEATS)} FROM s WHERE split_role = 'train' AND label = 'REST')
SELECT {KEY}, split_role, {', '.join(r(f'({f} - m_{f}) / s_{f}') + f' AS {f}' for f in FEATS)} FROM s, m""")
def rest_baseline_scale(spark, sf):
    w = wq.feature_windows(spark, sf).withColumn("split_role", F.when(F.col("session_id") % 4 == 0, "test").otherwise("train"))
    out = sp.rest_baseline_scale(materialize(w), FEATS)
    return rounded(out.select("session_id", "segment_index", "window_start", "label", "split_role", *FEATS), FEATS)


@query("""WITH g AS (SELECT user_id AS session_id, event_type AS trial_id, count(*) AS window_count, avg(value / 500.0) AS a, avg(value / (value + 30.0)) AS b, avg(30.0 / (value + 30.0)) AS c FROM events GROUP BY 1, 2)
SELECT session_id, trial_id, window_count, {a} AS p_left, {b} AS p_right, {c} AS p_jaw, CASE greatest(a, b, c) WHEN a THEN 'LEFT' WHEN b THEN 'RIGHT' ELSE 'JAW' END AS predicted_label FROM g""".format(a=r("a"), b=r("b"), c=r("c")))
def interval_vote(spark, sf):
    v = F.col("value")
    w = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("trial_id"), (v / 500.0).alias("p_left"), (v / (v + 30.0)).alias("p_right"), (30.0 / (v + 30.0)).alias("p_jaw"))
    return rounded(sp.interval_vote(w, ["session_id", "trial_id"], {"LEFT": "p_left", "RIGHT": "p_right", "JAW": "p_jaw"}), ["p_left", "p_right", "p_jaw"])


# --- models: fitted on the data at hand, so no SQL form ---------------------------------------------

N_VALUES = 64


def vectors(spark, sf):
    """Embedding rows as labelled windows, one feature per value; every session holds all classes."""
    e = table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 5).alias("session_id"), F.element_at(F.array(*[F.lit(x) for x in lb.JAW_STATES]), (F.col("label") % 4 + 1).cast("int")).alias("event_label"),
                                              F.when(F.col("label") < 4, "REST").when(F.col("label") < 7, "LEFT").otherwise("RIGHT").alias("label"), "embedding")
    cols = {f"f{i}": F.col("embedding")[i].cast("double") for i in range(N_VALUES)}
    return e.withColumns(cols).drop("embedding").withColumn("split_role", F.when(F.col("vec_id") % 4 == 0, "test").otherwise("train"))


VF = [f"f{i}" for i in range(N_VALUES)]
L3 = ["REST", "LEFT", "RIGHT"]


def split(rows):
    return rows.filter("split_role = 'train'"), rows.filter("split_role = 'test'")


@query()
def model_bank(spark, sf):
    return ln.model_bank(*split(materialize(vectors(spark, sf))), VF, "label", L3, trees=100)


@query()
def score_frame(spark, sf):
    rows = materialize(vectors(spark, sf))
    return ln.fit_model("lda", rows.filter("split_role = 'train'"), VF, "label", L3).score(rows)


@query()
def two_stage_pipeline(spark, sf):
    return ex.two_stage_pipeline(*split(materialize(vectors(spark, sf))), VF, 0.5)


@query()
def window_size_sweep(spark, sf):
    samples, segments = wq.blocks(spark, sf)
    segments = materialize(segments)

    def build(size):
        n = int(size * 9)
        rows = wn.assign_segment_windows(samples, segments, wq.TL, n, max(1, n // 2)).groupBy(*wq.WKEYS).agg(*ft.rms_features(CHANNELS))
        rows = materialize(rows)
        return rows.filter("session_id % 4 <> 0"), rows.filter("session_id % 4 = 0")

    return ex.window_size_sweep(build, [0.5, 1.0, 2.0], FEATS, 0.5)


@query()
def mixed_window_pipeline(spark, sf):
    samples, segments = wq.blocks(spark, sf)
    segments = materialize(segments)

    def build(n):
        rows = wn.assign_segment_windows(samples, segments, wq.TL, n, n // 2).groupBy(*wq.WKEYS).agg(*ft.rms_features(CHANNELS))
        rows = materialize(rows.select("session_id", "label", *FEATS, F.col("window_start").alias("window_id"), F.col("window_start").cast("double").alias("w_start"),
                                       (F.col("window_start") + n - 1).cast("double").alias("w_end"), (F.col("window_start") + n / 2).alias("center")))
        return rows.filter("session_id % 4 <> 0"), rows.filter("session_id % 4 = 0")

    return ex.mixed_window_pipeline(build(18), build(9), FEATS, Timeline(chunk_rows=256), "window_id", 0.5, 32.0).select(
        "session_id", "window_id", "label", "projected_p_active", "direction", "predicted")


@query()
def leave_one_session_out(spark, sf):
    rows = materialize(vectors(spark, sf))
    return ex.leave_one_session_out(rows.filter("session_id < 4"), [0, 1, 2, 3], VF, "label", L3, ["lda"], stress=rows.filter("session_id = 4"))


@query()
def cross_session_pairs(spark, sf):
    rows = materialize(vectors(spark, sf))
    return ex.cross_session_pairs(rows, list(permutations(range(5), 2)), VF, "label", L3, "lda")


@query()
def transfer_scores(spark, sf):
    rows = materialize(vectors(spark, sf).withColumnsRenamed({f"f{i}": f"ch{i}_rms" for i in range(N_VALUES)}))
    return ex.transfer_scores(rows.filter("session_id < 4"), rows.filter("session_id = 4"), [f"ch{i}" for i in range(N_VALUES)], ["rms"], 0.5)


@query()
def experiment_grid(spark, sf):
    rows = materialize(vectors(spark, sf))
    tasks = {"left_right_3class": (lambda d: lb.coarse_task(d, "left_right_3class"), L3), "active_vs_rest": (lambda d: lb.coarse_task(d, "active_vs_rest"), ["REST", "ACTIVE"])}
    return ex.experiment_grid({"all": split(rows)}, tasks, {"low": VF[: N_VALUES // 2], "all": VF}, ["lda", "tree"])


def channel_windows(spark, sf, length):
    """The last ``length`` of 32 samples of two channels (even and odd values of an embedding) with time and spectral features."""
    x = table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("p", "x"))
    two = x.groupBy("vec_id", "label", F.floor(F.col("p") / 2).alias("j")).agg(*[F.max(F.when(F.col("p") % 2 == k, F.col("x").cast("double"))).alias(f"c{k + 1}") for k in (0, 1)])
    rows = materialize(two.where(F.col("j") >= 32 - length).withColumn("j", F.col("j") - (32 - length)))
    power = ft.band_power_sum(rows, ["vec_id"], ["c1", "c2"], F.col("j"), length, 32.0)
    shape = rows.groupBy("vec_id", "label").agg(*[f(c).alias(f"{c}_{n}") for c in ("c1", "c2") for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("rms", lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))), ("ptp", lambda c: F.max(c) - F.min(c)))])
    out = shape.join(power.withColumns(ft.pairwise_asymmetry(["c1", "c2"])), "vec_id")
    return materialize(out.withColumn("label", F.when(F.col("label") < 4, "REST").when(F.col("label") < 7, "LEFT").otherwise("RIGHT")).withColumn("split_role", F.when(F.col("vec_id") % 4 == 0, "test").otherwise("train")))


@query()
def feature_configs(spark, sf):
    """Windows of 0.50 and 0.75 s under every feature configuration."""
    return ex.feature_configurations({n / 32.0: split(channel_windows(spark, sf, n)) for n in (16, 24)}, "label", L3, ["lda"])


@query()
def event_state_tasks(spark, sf):
    return ex.event_state_tasks(materialize(vectors(spark, sf)), VF, ["lda", "tree"])


@query()
def hold_vs_repeated(spark, sf):
    rows = materialize(vectors(spark, sf).withColumn("label", F.when(F.col("label") == "LEFT", "HOLD").otherwise("REPEATED")).withColumn("detected_event_count", F.when(F.col("f0") > 0, 2).otherwise(1)))
    return ex.hold_vs_repeated(rows, VF, ["lda", "tree"], evt.jaw_type_heuristic())


@query()
def out_of_fold(spark, sf):
    rows = sp.stratified_group_folds(vectors(spark, sf), ["vec_id"], "label", 5)
    scored = ln.out_of_fold(materialize(rows), VF, "label", L3, [0, 1, 2, 3, 4], "lda")
    return mt.classification_metrics(scored, ["fold"], "label", "predicted", L3)


@query()
def feature_importance(spark, sf):
    rows = materialize(vectors(spark, sf))
    m = ln.fit_model("forest", rows.filter("split_role = 'train'"), VF, "label", L3, trees=100)
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(v).alias("importance")) for f, v in m.importances().items()])
    return rows.groupBy().agg(F.count(F.lit(1)).alias("rows")).select("rows", F.inline(pairs))


@query()
def permutation_importance(spark, sf):
    train, test = split(materialize(vectors(spark, sf)))
    return ln.permutation_importance(ln.fit_model("lda", train, VF, "label", L3), test, VF, "label", L3, repeats=10)
