"""Metric and reporting queries over predictions derived from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import labels as lb
from pulsegrid.operators import audit as au
from pulsegrid.operators import joins as jn
from pulsegrid.operators import metrics as mt
from pulsegrid.operators import splits as sp
from pulsegrid.runtime import materialize
from pulsegrid.timeline import Timeline
from workload import audit_q as aq
from workload import intervals_q as iq
from workload import joins_q as jq
from workload.base import EV, EVENTS_TL as TL, event_samples, r, rounded, table
from workload.registry import query

LABELS = ["REST", "LEFT", "RIGHT"]
PR = """pr AS (SELECT user_id AS session_id, user_id % 5 AS fold, event_id, CASE event_type WHEN 'click' THEN 'LEFT' WHEN 'signup' THEN 'RIGHT' ELSE 'REST' END AS y,
    CASE WHEN value < 15 THEN 'REST' WHEN value < 40 THEN 'LEFT' ELSE 'RIGHT' END AS p, value / (value + 30.0) AS score, (value - 30.0) / 50.0 AS x,
    CASE event_type WHEN 'click' THEN 'Jleft' WHEN 'signup' THEN 'Jright' WHEN 'view' THEN 'norm' WHEN 'purchase' THEN 'Jaws' END AS jl FROM events)"""


def predictions(spark, sf):
    e, v = F.col("event_type"), F.col("value")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("session_id"), (F.col("user_id") % 5).alias("fold"), "event_id",
        F.when(e == "click", "LEFT").when(e == "signup", "RIGHT").otherwise("REST").alias("y"),
        F.when(v < 15, "REST").when(v < 40, "LEFT").otherwise("RIGHT").alias("p"), (v / (v + 30.0)).alias("score"), ((v - 30.0) / 50.0).alias("x"),
        F.when(e == "click", "Jleft").when(e == "signup", "Jright").when(e == "view", "norm").when(e == "purchase", "Jaws").alias("jl"))


@query(f"""WITH {PR} SELECT fold, i AS label_order, a AS actual, count(*) FILTER (y = a AND p = 'REST') AS "pred_REST", count(*) FILTER (y = a AND p = 'LEFT') AS "pred_LEFT",
  count(*) FILTER (y = a AND p = 'RIGHT') AS "pred_RIGHT", count(*) FILTER (y = a AND p = 'OTHER') AS "pred_OTHER"
FROM pr, (VALUES (0, 'REST'), (1, 'LEFT'), (2, 'RIGHT'), (3, 'OTHER')) v(i, a) GROUP BY 1, 2, 3""")
def confusion_matrix(spark, sf):
    return mt.confusion_matrix(predictions(spark, sf), ["fold"], "y", "p", [*LABELS, "OTHER"])


def metrics_sql(src, key, name, labels=LABELS):
    parts = [f"""SELECT {key}, '{a}' AS l, coalesce(count(*) FILTER (y = '{a}' AND p = '{a}') / nullif(count(*) FILTER (p = '{a}'), 0)::DOUBLE, 0) AS pre,
    coalesce(count(*) FILTER (y = '{a}' AND p = '{a}') / nullif(count(*) FILTER (y = '{a}'), 0)::DOUBLE, 0) AS rec,
    coalesce(2 * count(*) FILTER (y = '{a}' AND p = '{a}') / nullif(count(*) FILTER (y = '{a}') + count(*) FILTER (p = '{a}'), 0)::DOUBLE, 0) AS f FROM {src} GROUP BY 1""" for a in labels]
    recs = ", ".join(f"{r(f'''max(rec) FILTER (l = '{a}')''')} AS \"recall_{a}\"" for a in labels)
    return f"""{name}_l AS ({' UNION ALL '.join(parts)}), {name} AS (SELECT {key}, any_value(n) AS n, {r('any_value(acc)')} AS accuracy, {r('avg(pre)')} AS macro_precision,
    {r('avg(rec)')} AS macro_recall, {r('avg(f)')} AS macro_f1, {recs} FROM {name}_l JOIN (SELECT {key}, count(*) AS n, avg((y = p)::INT) AS acc FROM {src} GROUP BY 1) USING ({key}) GROUP BY 1)"""


MCOLS = ["accuracy", "macro_precision", "macro_recall", "macro_f1"] + [f"recall_{a}" for a in LABELS]


@query(f"WITH {PR}, {metrics_sql('pr', 'fold', 'm')} SELECT * FROM m")
def classification_metrics(spark, sf):
    return rounded(mt.classification_metrics(predictions(spark, sf), ["fold"], "y", "p", LABELS), MCOLS)


@query(f"""WITH {PR}, two AS (SELECT * FROM pr WHERE y <> 'RIGHT' AND p <> 'RIGHT'), {metrics_sql('two', 'fold', 'm', ['REST', 'LEFT'])} SELECT *, 0.0::DOUBLE AS "recall_RIGHT" FROM m""")
def classification_metrics_present(spark, sf):
    rows = predictions(spark, sf).filter("y <> 'RIGHT' AND p <> 'RIGHT'")
    return rounded(mt.classification_metrics(rows, ["fold"], "y", "p", LABELS, present_only=True), MCOLS)


@query(f"WITH {PR} SELECT fold, {r('''avg((p <> 'REST')::INT) FILTER (y = 'REST')''')} AS rest_fpr FROM pr GROUP BY 1")
def rest_false_positive_rate(spark, sf):
    return rounded(mt.rest_false_positive_rate(predictions(spark, sf), ["fold"], "y", "p"), ["rest_fpr"])


TAUS = [0.2, 0.3, 0.4, 0.5, 0.6, 0.7]
SWEEP = ", ".join(f"({t}::DOUBLE)" for t in TAUS)
SCOLS = ["accuracy", "macro_f1", "active_precision", "active_recall"]


@query(f"""WITH {PR}, c AS (SELECT fold, t, count(*) FILTER (y <> 'REST' AND score >= t) AS tp, count(*) FILTER (y = 'REST' AND score >= t) AS fp, count(*) FILTER (y <> 'REST' AND score < t) AS fn,
    count(*) FILTER (y = 'REST' AND score < t) AS tn FROM pr, (VALUES {SWEEP}) v(t) GROUP BY 1, 2)
SELECT fold, t AS threshold, {r('(tp + tn) / (tp + tn + fp + fn)::DOUBLE')} AS accuracy,
  {r('(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0)::DOUBLE, 0)) / 2')} AS macro_f1,
  {r('coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0)')} AS active_precision, {r('coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0)')} AS active_recall, fn AS misses, fp AS false_triggers FROM c""")
def threshold_sweep(spark, sf):
    out = mt.threshold_sweep(predictions(spark, sf), ["fold"], "score", F.col("y") != "REST", TAUS)
    return rounded(out, SCOLS)


DTH = [i / 100 for i in range(101)]
DSQL = ", ".join(f"({t}::DOUBLE)" for t in DTH)


@query(f"""WITH {PR}, c AS (SELECT fold, t, count(*) AS n, count(*) FILTER (abs(x) > t) AS dec, count(*) FILTER (jl = 'Jleft' AND x < -t) AS ll, count(*) FILTER (jl = 'Jright' AND x > t) AS rr,
    count(*) FILTER (jl = 'Jleft') AS nl, count(*) FILTER (jl = 'Jright') AS nr, count(*) FILTER (x < -t) AS pl, count(*) FILTER (x > t) AS pq FROM pr, (VALUES {DSQL}) v(t) WHERE jl IN ('Jleft', 'Jright') GROUP BY 1, 2)
SELECT fold, t AS threshold, {r('dec / n::DOUBLE')} AS coverage, {r('(ll + rr) / n::DOUBLE')} AS accuracy_all, {r('coalesce((ll + rr) / nullif(dec, 0)::DOUBLE, 0)')} AS accuracy_decided,
  {r('(coalesce(2 * ll / nullif(nl + pl, 0)::DOUBLE, 0) + coalesce(2 * rr / nullif(nr + pq, 0)::DOUBLE, 0)) / 2')} AS macro_f1 FROM c""")
def direction_scan(spark, sf):
    return rounded(mt.direction_scan(predictions(spark, sf), ["fold"], "x", "jl", DTH), ["coverage", "accuracy_all", "accuracy_decided", "macro_f1"])


ATH = [i / 200 for i in range(201)]
ASQL = ", ".join(f"({t}::DOUBLE)" for t in ATH)


@query(f"""WITH {PR}, c AS (SELECT fold, t, count(*) FILTER (jl <> 'norm' AND score > t) AS tp, count(*) FILTER (jl = 'norm' AND score > t) AS fp, count(*) FILTER (jl <> 'norm' AND score <= t) AS fn,
    count(*) FILTER (jl = 'norm' AND score <= t) AS tn FROM pr, (VALUES {ASQL}) v(t) WHERE jl IS NOT NULL GROUP BY 1, 2), s AS (
  SELECT fold, t AS threshold, {r('(tp + tn) / (tp + tn + fp + fn)::DOUBLE')} AS accuracy, {r('(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0)::DOUBLE, 0)) / 2')} AS macro_f1 FROM c)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY fold ORDER BY macro_f1 DESC, threshold) = 1""")
def activation_scan_best(spark, sf):
    scan = mt.activation_scan(predictions(spark, sf).filter("jl IS NOT NULL"), ["fold"], "score", "jl", ATH)
    return mt.first_best(rounded(scan, ["accuracy", "macro_f1"]), ["fold"], F.desc("macro_f1"), F.asc("threshold"))


@query(f"""WITH {PR}, g AS (SELECT fold, count(*) FILTER (jl = 'Jleft') AS a, count(*) FILTER (jl = 'Jright') AS b, avg(x) FILTER (jl = 'Jleft') AS ma, avg(x) FILTER (jl = 'Jright') AS mb,
    var_samp(x) FILTER (jl = 'Jleft') AS va, var_samp(x) FILTER (jl = 'Jright') AS vb FROM pr GROUP BY 1)
SELECT fold, {r('ma')} AS left_mean, {r('mb')} AS right_mean, {r('(mb - ma) / sqrt(((a - 1) * va + (b - 1) * vb) / (a + b - 2))')} AS cohens_d FROM g""")
def cohens_d(spark, sf):
    return rounded(mt.cohens_d(predictions(spark, sf), ["fold"], "x", "jl", "Jleft", "Jright"), ["left_mean", "right_mean", "cohens_d"])


@query(f"""WITH {PR}, q AS (SELECT fold, x, jl, min(x) OVER w AS lo, max(x) OVER w AS hi, count(*) FILTER (jl = 'Jleft') OVER w AS a, count(*) FILTER (jl = 'Jright') OVER w AS b FROM pr WHERE jl IN ('Jleft', 'Jright') WINDOW w AS (PARTITION BY fold)),
  h AS (SELECT fold, least(99, floor((x - lo) * 100 / (hi - lo))) AS bin, count(*) FILTER (jl = 'Jleft') / any_value(a)::DOUBLE AS p, count(*) FILTER (jl = 'Jright') / any_value(b)::DOUBLE AS q FROM q GROUP BY 1, 2)
SELECT fold, {r('sum(least(p, q))')} AS overlap FROM h GROUP BY 1""")
def empirical_overlap(spark, sf):
    return rounded(mt.empirical_overlap(predictions(spark, sf), ["fold"], "x", "jl", "Jleft", "Jright"), ["overlap"])


@query(f"""WITH {PR}, k AS (SELECT fold, y, rank() OVER (PARTITION BY fold ORDER BY score) + (count(*) OVER (PARTITION BY fold, score) - 1) / 2.0 AS rk FROM pr)
SELECT fold, count(*) FILTER (y <> 'REST') AS positives, count(*) FILTER (y = 'REST') AS negatives,
  {r("(sum(rk) FILTER (y <> 'REST') - count(*) FILTER (y <> 'REST') * (count(*) FILTER (y <> 'REST') + 1) / 2.0) / (count(*) FILTER (y <> 'REST') * count(*) FILTER (y = 'REST'))")} AS roc_auc FROM k GROUP BY 1""")
def roc_auc(spark, sf):
    return rounded(mt.roc_auc(predictions(spark, sf), Timeline(("fold",), "score"), "score", F.col("y") != "REST"), ["roc_auc"])


@query(f"WITH {PR} SELECT jl, count(*) AS n, {r('avg(x)')} AS x_mean, {r('stddev_samp(x)')} AS x_std, {r('avg(score)')} AS score_mean, {r('stddev_samp(score)')} AS score_std FROM pr GROUP BY 1")
def label_summary(spark, sf):
    return rounded(mt.label_summary(predictions(spark, sf), ["jl"], ["x", "score"]), ["x_mean", "x_std", "score_mean", "score_std"])


@query(f"""WITH {EV} SELECT session_id % 5 AS fold, {r('avg((value >= 200)::INT)')} AS clip_fraction, {r('avg((value / 200 <= 0.05)::INT)')} AS low_fraction, {r('avg((value / 200 >= 0.95)::INT)')} AS high_fraction,
  {r('1 - avg((value / 200 <= 0.05)::INT) - avg((value / 200 >= 0.95)::INT)')} AS mid_fraction, {r('quantile_cont(value - value / 4, 0.5)')} AS median_threshold_gap FROM ev GROUP BY 1""")
def processor_behavior(spark, sf):
    v = F.col("value")
    rows = table(spark, sf, "events").select((F.col("user_id") % 5).alias("fold"), v.alias("c_average"), (v / 200).alias("c_output"), (v / 4).alias("c_lower"), v.alias("c_upper"))
    return rounded(mt.processor_behavior(rows, ["fold"], ["c"], 200.0), ["clip_fraction", "low_fraction", "high_fraction", "mid_fraction", "median_threshold_gap"])


JAW = """ja AS (SELECT fold, avg(score) FILTER (jl = 'Jaws') AS a, avg(score) FILTER (jl = 'norm') AS b, avg(abs(x)) FILTER (jl = 'Jaws') AS c, avg(abs(x)) FILTER (jl IN ('Jleft', 'Jright')) AS d FROM pr GROUP BY 1)"""


@query(f"""WITH {PR}, {JAW} SELECT fold, {r('a')} AS jaw_activation, {r('b')} AS rest_activation, {r('c')} AS jaw_direction, {r('d')} AS side_direction, {r('a / greatest(b, 1e-9)')} AS activation_ratio,
  {r('c / greatest(d, 1e-3)')} AS direction_ratio, {r('a / greatest(b, 1e-9) - c / greatest(d, 1e-3)')} AS center_score FROM ja""")
def jaw_summary(spark, sf):
    out = mt.jaw_summary(predictions(spark, sf).withColumn("ax", F.abs("x")), ["fold"], "jl", "score", "ax")
    return rounded(out, [c for c in out.columns if c != "fold"])


@query(f"""WITH {PR}, {JAW}, {EV}, cl AS (SELECT session_id % 5 AS fold, avg((value >= 200)::INT) AS clip, avg((value / 200 <= 0.05)::INT) AS lo, avg((value / 200 >= 0.95)::INT) AS hi FROM ev GROUP BY 1),
  t AS (SELECT 'm' || ja.fold AS mode, 'mean' AS method, {r('clip')} AS clip_fraction, {r('1 - lo - hi')} AS mid_fraction, {r('b')} AS direction_macro_f1, {r('c')} AS roc_auc, {r('a / b - c / d')} AS center_score, {r('a / b')} AS activation_ratio FROM ja JOIN cl USING (fold))
(SELECT *, 'direction' AS winner FROM t ORDER BY direction_macro_f1 DESC, roc_auc DESC, mode LIMIT 1) UNION ALL
(SELECT *, 'sensible' FROM t ORDER BY clip_fraction, mid_fraction DESC, direction_macro_f1 DESC, mode LIMIT 1) UNION ALL
(SELECT *, 'jaw_center' FROM t WHERE (clip_fraction < 0.5 AND mid_fraction > 0.1) OR NOT EXISTS (SELECT 1 FROM t WHERE clip_fraction < 0.5 AND mid_fraction > 0.1) ORDER BY center_score DESC, activation_ratio DESC, mode LIMIT 1)""")
def mode_winners(spark, sf):
    v = F.col("value")
    clip = mt.processor_behavior(table(spark, sf, "events").select((F.col("user_id") % 5).alias("fold"), v.alias("c_average"), (v / 200).alias("c_output"), (v / 4).alias("c_lower"), v.alias("c_upper")), ["fold"], ["c"], 200.0)
    jaw = mt.jaw_summary(predictions(spark, sf).withColumn("ax", F.abs("x")), ["fold"], "jl", "score", "ax")
    t = jaw.join(clip, "fold").select(
        F.concat(F.lit("m"), F.col("fold").cast("string")).alias("mode"), F.lit("mean").alias("method"), "clip_fraction", "mid_fraction",
        F.col("rest_activation").alias("direction_macro_f1"), F.col("jaw_direction").alias("roc_auc"), "center_score", "activation_ratio")
    return mt.mode_winners(materialize(rounded(t, ["clip_fraction", "mid_fraction", "direction_macro_f1", "roc_auc", "center_score", "activation_ratio"])))


SC = """sc AS (SELECT user_id AS session_id, CASE WHEN user_id % 3 = 0 THEN 'test' ELSE 'train' END AS split_role, event_type AS config, count(*) AS reference_onsets, count(*) FILTER (value > 20) AS detected_clicks,
    count(*) FILTER (value > 60) AS extra_clicks, avg((value > 10)::INT) AS precision, avg((value > 20)::INT) AS recall, avg((value > 30)::INT) AS event_f1 FROM events GROUP BY 1, 2, 3),
  ss AS (SELECT config, split_role, {p} AS weighted_precision, {q} AS weighted_recall, {f} AS weighted_event_f1, sum(reference_onsets)::BIGINT AS total_references, sum(detected_clicks)::BIGINT AS total_clicks,
    sum(extra_clicks)::BIGINT AS total_extra_clicks FROM sc GROUP BY 1, 2)""".format(
    p=r("sum(precision * reference_onsets) / sum(reference_onsets)"), q=r("sum(recall * reference_onsets) / sum(reference_onsets)"), f=r("sum(event_f1 * reference_onsets) / sum(reference_onsets)"))


def session_scores(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").groupBy(
        F.col("user_id").alias("session_id"), F.when(F.col("user_id") % 3 == 0, "test").otherwise("train").alias("split_role"), F.col("event_type").alias("config")).agg(
        F.count(F.lit(1)).alias("reference_onsets"), F.count_if(v > 20).alias("detected_clicks"), F.count_if(v > 60).alias("extra_clicks"),
        F.avg((v > 10).cast("double")).alias("precision"), F.avg((v > 20).cast("double")).alias("recall"), F.avg((v > 30).cast("double")).alias("event_f1"))


def summary(spark, sf):
    return rounded(mt.strategy_summary(session_scores(spark, sf), ["config"]), ["weighted_precision", "weighted_recall", "weighted_event_f1"])


@query(f"WITH {SC} SELECT * FROM ss")
def strategy_summary(spark, sf):
    return summary(spark, sf)


@query(f"WITH {SC} SELECT * FROM ss QUALIFY row_number() OVER (PARTITION BY split_role ORDER BY weighted_event_f1 DESC, weighted_precision DESC, total_extra_clicks, config) = 1")
def best_config(spark, sf):
    return mt.best_config(summary(spark, sf), ["split_role"], "config")


SEEDS = """sd AS (SELECT event_type AS config, user_id % 5 AS seed, avg((value > 60)::INT) AS false_triggers_per_min, avg((value > 80)::INT) AS repeated_triggers_per_min, avg((value > 20)::INT) AS direction_accuracy,
    avg((value < 10)::INT) AS wrong_rate, avg((value < 5)::INT) AS miss_rate, avg(value) AS avg_latency_s, count(*) FILTER (value < 10) AS wrong, count(*) FILTER (value < 5) AS missed, count(*) AS direction_trials FROM events GROUP BY 1, 2),
  sm AS (SELECT config, {m}, {w}, {s1} AS direction_accuracy_std, {s2} AS avg_latency_s_std, sum(wrong)::BIGINT AS wrong_total, sum(missed)::BIGINT AS missed_total, sum(direction_trials)::BIGINT AS direction_trials_total FROM sd GROUP BY 1)""".format(
    m=", ".join(f"{r(f'avg({c})')} AS {c}_mean" for c in ("false_triggers_per_min", "repeated_triggers_per_min", "direction_accuracy", "wrong_rate", "miss_rate", "avg_latency_s")),
    w=", ".join(f"{r(f'max({c})')} AS {c}_worst" for c in ("false_triggers_per_min", "repeated_triggers_per_min", "wrong_rate", "miss_rate")), s1=r("stddev_pop(direction_accuracy)"), s2=r("stddev_pop(avg_latency_s)"))


def seeds(spark, sf):
    v = F.col("value")
    avg = lambda c: F.avg(c.cast("double"))
    runs = table(spark, sf, "events").groupBy(F.col("event_type").alias("config"), (F.col("user_id") % 5).alias("seed")).agg(
        avg(v > 60).alias("false_triggers_per_min"), avg(v > 80).alias("repeated_triggers_per_min"), avg(v > 20).alias("direction_accuracy"), avg(v < 10).alias("wrong_rate"),
        avg(v < 5).alias("miss_rate"), F.avg(v).alias("avg_latency_s"), F.count_if(v < 10).alias("wrong"), F.count_if(v < 5).alias("missed"), F.count(F.lit(1)).alias("direction_trials"))
    out = mt.seed_summary(runs, ["config"])
    return rounded(out, [c for c in out.columns if c.endswith(("_mean", "_worst", "_std"))])


@query(f"WITH {SEEDS} SELECT * FROM sm")
def seed_summary(spark, sf):
    return seeds(spark, sf)


@query(f"WITH {SEEDS} SELECT *, row_number() OVER (ORDER BY false_triggers_per_min_mean, false_triggers_per_min_worst, wrong_total, avg_latency_s_mean, direction_accuracy_mean DESC, config) AS rank FROM sm")
def rank_safety_first(spark, sf):
    return mt.rank_safety_first(seeds(spark, sf), "config")


@query(f"""WITH {SEEDS}, k AS (SELECT *, false_triggers_per_min_worst <= 0.17 AND repeated_triggers_per_min_worst <= 0.5 AS meets_constraints FROM sm)
SELECT *, row_number() OVER (ORDER BY miss_rate_mean, wrong_rate_mean, avg_latency_s_mean, direction_accuracy_mean DESC, config) AS rank FROM k WHERE meets_constraints OR NOT EXISTS (SELECT 1 FROM k WHERE meets_constraints)""")
def rank_constrained(spark, sf):
    return mt.rank_constrained(materialize(seeds(spark, sf)), "config", 0.17, 0.5)


@query(f"""WITH d AS (SELECT user_id AS session_id, event_type AS label, value < 30 AS unconstrained_exact, value < 60 AS constrained_exact, event_id % 3 - 1 AS unconstrained_error, event_id % 2 AS constrained_error FROM events)
SELECT session_id, label, count(*) AS trial_count, {r('avg(unconstrained_exact::INT)')} AS unconstrained_exact_accuracy, {r('avg(constrained_exact::INT)')} AS constrained_exact_accuracy,
  {r('avg(abs(unconstrained_error))')} AS unconstrained_mae, {r('avg(abs(constrained_error))')} AS constrained_mae, grouping(session_id) = 1 AS pooled FROM d GROUP BY GROUPING SETS ((session_id, label), (label))""")
def decode_summary(spark, sf):
    v = F.col("value")
    d = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("label"), (v < 30).alias("unconstrained_exact"), (v < 60).alias("constrained_exact"),
                                          (F.col("event_id") % 3 - 1).alias("unconstrained_error"), (F.col("event_id") % 2).alias("constrained_error"))
    return rounded(mt.decode_summary(d), ["unconstrained_exact_accuracy", "constrained_exact_accuracy", "unconstrained_mae", "constrained_mae"])


@query(f"WITH {PR}, {metrics_sql('pr', 'session_id', 'm')} SELECT session_id % 5 AS task, count(*) AS n_results, {r('avg(accuracy)')} AS mean_accuracy, {r('var_pop(accuracy)')} AS var_accuracy, {r('avg(macro_f1)')} AS mean_macro_f1, {r('var_pop(macro_f1)')} AS var_macro_f1 FROM m GROUP BY 1")
def task_summary(spark, sf):
    m = rounded(mt.classification_metrics(predictions(spark, sf), ["session_id"], "y", "p", LABELS), MCOLS).withColumn("task", F.col("session_id") % 5)
    return rounded(mt.task_summary(m, ["task"]), ["mean_accuracy", "var_accuracy", "mean_macro_f1", "var_macro_f1"])


@query(f"""WITH {PR}, {metrics_sql('pr', 'session_id', 'm')}, g AS (SELECT (session_id % 4 + 1) / 4.0::DOUBLE AS keep_fraction, 'm' || session_id AS model_name, accuracy, macro_f1, "recall_LEFT" AS active_recall FROM m),
  b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY keep_fraction ORDER BY macro_f1 DESC, accuracy DESC, model_name) = 1)
SELECT b.*, {r('b.macro_f1 - z.macro_f1')} AS delta_macro_f1, {r('b.active_recall - z.active_recall')} AS delta_active_recall FROM b, (SELECT * FROM b WHERE keep_fraction = 1.0) z""")
def best_vs_baseline(spark, sf):
    m = rounded(mt.classification_metrics(predictions(spark, sf), ["session_id"], "y", "p", LABELS), MCOLS)
    g = m.select(((F.col("session_id") % 4 + 1) / 4.0).alias("keep_fraction"), F.concat(F.lit("m"), F.col("session_id").cast("string")).alias("model_name"), "accuracy", "macro_f1", F.col("recall_LEFT").alias("active_recall"))
    return rounded(mt.best_vs_baseline(materialize(g), "keep_fraction", 1.0), ["delta_macro_f1", "delta_active_recall"])


GATES = ", ".join(f"('{s}', '{m}', {v}::DOUBLE, '{d}')" for s, m, v, d in mt.STAGE_GATES)


@query(f"""WITH g AS (SELECT * FROM (VALUES {GATES}) t(stage, metric, lim, dir)), m AS (SELECT 'jaw_stage1' AS stage, unnest(['event_f1', 'precision', 'recall']) AS metric, unnest([avg((value > 5)::INT), avg((value > 10)::INT), avg((value > 40)::INT)]) AS value FROM events
    UNION ALL SELECT 'jaw_stage2', 'macro_f1', avg((value > 5)::INT) FROM events),
  j AS (SELECT stage, metric, coalesce(CASE WHEN dir = 'min' THEN value >= lim ELSE value <= lim END, false) AS ok FROM g LEFT JOIN m USING (stage, metric))
SELECT stage, bool_and(ok) AS gate_pass, coalesce(string_agg(metric, ', ' ORDER BY metric) FILTER (NOT ok), '') AS failing_metrics FROM j GROUP BY 1""")
def stage_gates(spark, sf):
    v = F.col("value")
    share = lambda c: F.avg(c.cast("double"))
    a = table(spark, sf, "events").agg(share(v > 5).alias("a"), share(v > 10).alias("b"), share(v > 40).alias("c"))
    row = lambda s, m, c: F.struct(F.lit(s).alias("stage"), F.lit(m).alias("metric"), F.col(c).alias("value"))
    m = a.select(F.inline(F.array(row("jaw_stage1", "event_f1", "a"), row("jaw_stage1", "precision", "b"), row("jaw_stage1", "recall", "c"), row("jaw_stage2", "macro_f1", "a"))))
    return mt.stage_gates(m)


@query("""SELECT user_id % 5 AS fold, to_json(map_from_entries(list((event_type, n) ORDER BY event_type)))::VARCHAR AS class_counts FROM (SELECT user_id % 5 AS user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""")
def class_counts(spark, sf):
    rows = table(spark, sf, "events").select((F.col("user_id") % 5).alias("fold"), "event_type")
    return mt.class_counts(rows, ["fold"], "event_type").withColumn("class_counts", F.to_json("class_counts"))


ADAPT = f"""st AS (SELECT session_id, event_id AS step_id, t AS s, t + 30.0 AS e, CASE label WHEN 'view' THEN 'BASELINE' WHEN 'click' THEN 'JAW_TAP' WHEN 'signup' THEN 'HOLD' WHEN 'purchase' THEN 'LEFT' ELSE 'RIGHT' END AS lab FROM tm),
  us AS (SELECT * FROM st WHERE lab <> 'BASELINE' OR step_id = (SELECT min(step_id) FROM st z WHERE z.session_id = st.session_id AND z.lab = 'BASELINE')),
  rw AS (SELECT tr.session_id, lab, value / (value + 20.0) AS jaw, value / (value + 30.0) AS ja, value / (value + 10.0) AS hl, value / (value + 60.0) AS hr FROM tm tr JOIN us ON us.session_id = tr.session_id AND tr.t BETWEEN s AND e),
  q AS (SELECT session_id, quantile_cont(jaw, 0.40) FILTER (lab = 'JAW_TAP') AS tap_q40, quantile_cont(ja, 0.5) FILTER (lab = 'HOLD') AS hold_q50, quantile_cont(ja, 0.75) FILTER (lab = 'HOLD') AS hold_q75,
    quantile_cont(jaw, 0.98) FILTER (lab = 'BASELINE') AS base_jaw_q98, quantile_cont(ja, 0.98) FILTER (lab = 'BASELINE') AS base_active_q98,
    quantile_cont(CASE lab WHEN 'LEFT' THEN hl WHEN 'RIGHT' THEN hr END, 0.35) AS target_q35, quantile_cont(CASE lab WHEN 'LEFT' THEN hl WHEN 'RIGHT' THEN hr END, 0.65) AS target_q65,
    quantile_cont(CASE lab WHEN 'LEFT' THEN hl - hr WHEN 'RIGHT' THEN hr - hl END, 0.35) AS margin_q35 FROM rw GROUP BY 1),
  bq AS (SELECT session_id, quantile_cont(h, 0.98) AS base_lr_q98 FROM (SELECT session_id, unnest([hl, hr]) AS h FROM rw WHERE lab = 'BASELINE') GROUP BY 1),
  f AS (SELECT *, coalesce(tap_q40 > base_jaw_q98 + 0.04, false) AS tap, coalesce(hold_q50 > base_active_q98 + 0.03, false) AS hold, coalesce(target_q35 > base_lr_q98 + 0.03 AND margin_q35 > 0.05, false) AS hand FROM q LEFT JOIN bq USING (session_id)),
  c AS (SELECT *, CASE WHEN tap THEN greatest(0.58, least(0.88, (tap_q40 + base_jaw_q98) / 2)) ELSE 0.80 END AS click_threshold FROM f)"""
ACOLS = ["tap_q40", "hold_q50", "hold_q75", "base_jaw_q98", "base_active_q98", "target_q35", "target_q65", "margin_q35", "base_lr_q98", "click_threshold", "rearm_threshold", "hold_probability_threshold", "direction_min_confidence", "direction_margin"]


@query(f"""WITH {jq.TM}, {ADAPT}, o AS (SELECT session_id, tap_q40, hold_q50, hold_q75, base_jaw_q98, base_active_q98, target_q35, target_q65, margin_q35, base_lr_q98, click_threshold::DOUBLE AS click_threshold,
  (CASE WHEN tap THEN greatest(0.25, least(click_threshold - 0.06, click_threshold - 0.20)) ELSE 0.5 END)::DOUBLE AS rearm_threshold, (CASE WHEN hold THEN greatest(0.55, least(0.88, (hold_q50 + base_active_q98) / 2)) ELSE 0.7 END)::DOUBLE AS hold_probability_threshold,
  (CASE WHEN hold THEN CASE WHEN hold_q75 >= 0.78 THEN 0.40 ELSE 0.48 END ELSE 0.45 END)::DOUBLE AS hold_onset_sec, CASE WHEN tap OR hold THEN 'session_quantile_shift' ELSE 'fallback_to_base' END AS jaw_reason,
  (CASE WHEN hand THEN greatest(0.5, least(0.78, target_q35 - 0.02)) ELSE 0.6 END)::DOUBLE AS direction_min_confidence, (CASE WHEN hand THEN greatest(0.05, least(0.22, margin_q35 * 0.85)) ELSE 0.1 END)::DOUBLE AS direction_margin,
  (CASE WHEN hand AND target_q65 < 0.72 THEN 0.55 ELSE 0.45 END)::DOUBLE AS hand_action_latch_sec, (CASE WHEN hand AND margin_q35 < 0.10 THEN 0.26 ELSE 0.20 END)::DOUBLE AS hand_switch_cooldown_sec,
  CASE WHEN hand THEN 'session_confidence_separation' ELSE 'fallback_to_base' END AS hand_reason FROM c) SELECT * REPLACE ({', '.join(f'{r(c)} AS {c}' for c in ACOLS)}) FROM o""")
def session_adaptation(spark, sf):
    rows = jq.timed(spark, sf)
    v = F.col("value")
    trace = rows.select("session_id", "t", (v / (v + 20.0)).alias("jaw"), (v / (v + 30.0)).alias("jaw_active"), (v / (v + 10.0)).alias("hand_left"), (v / (v + 60.0)).alias("hand_right"))
    lab = lb.lookup(F.col("label"), {"view": "BASELINE", "click": "JAW_TAP", "signup": "HOLD", "purchase": "LEFT"}, F.lit("RIGHT"))
    steps = rows.select("session_id", F.col("event_id").alias("step_id"), lab.alias("step_label"), F.col("t").alias("step_start"), (F.col("t") + 30.0).alias("step_end"))
    return rounded(mt.session_adaptation(trace, steps, ["session_id"], "t", 30.0), ACOLS)


@query(f"""WITH {PR}, iv AS (SELECT fold, session_id, arg_max(y, event_id) AS y, arg_max(p, event_id) AS p FROM pr GROUP BY 1, 2), wa AS (SELECT 1 AS z, y, p FROM pr), ia AS (SELECT 1 AS z, y, p FROM iv),
  {metrics_sql('pr', 'fold', 'a')}, {metrics_sql('iv', 'fold', 'b')}, {metrics_sql('wa', 'z', 'c')}, {metrics_sql('ia', 'z', 'd')}
SELECT *, 'window' AS grain, 'fold' AS scope FROM a UNION ALL SELECT *, 'interval', 'fold' FROM b UNION ALL SELECT NULL, * EXCLUDE (z), 'window', 'pooled' FROM c UNION ALL SELECT NULL, * EXCLUDE (z), 'interval', 'pooled' FROM d""")
def two_grain_metrics(spark, sf):
    pr = predictions(spark, sf)
    last = pr.groupBy("fold", "session_id").agg(F.max_by("y", "event_id").alias("y"), F.max_by("p", "event_id").alias("p"))
    return rounded(mt.two_grain_metrics(pr, last, ["fold"], "y", "p", LABELS), MCOLS)


@query(f"""WITH {EV}, {iq.MK}, {jq.BL}, ei AS (SELECT e.session_id, event_id, any_value(value) > 10 AS k, count(block_id) > 0 AS i FROM ev e LEFT JOIN bl ON e.session_id = bl.session_id AND sample_idx BETWEEN block_start AND block_end WHERE e.label = 'error' GROUP BY 1, 2)
SELECT session_id, count(*) FILTER (k AND i) AS kept_inside, count(*) FILTER (k AND NOT i) AS kept_outside, grouping(session_id) = 1 AS overall, {r('count(*) FILTER (k AND i) / nullif(count(*) FILTER (k), 0)::DOUBLE')} AS inside_block_fraction,
  CASE WHEN count(*) FILTER (k) = 0 THEN 'no kept events' WHEN count(*) FILTER (k AND i) / count(*) FILTER (k)::DOUBLE >= 0.9 AND count(*) FILTER (k AND NOT i) <= 2 THEN 'strong'
    WHEN count(*) FILTER (k AND i) / count(*) FILTER (k)::DOUBLE >= 0.75 THEN 'usable, review outside events' ELSE 'weak, diagnostic only' END AS note FROM ei GROUP BY ROLLUP (session_id)""")
def alignment_summary(spark, sf):
    events = event_samples(spark, sf).filter("label = 'error'").select("session_id", "event_id", "sample_idx", (F.col("value") > 10).alias("kept_for_count"))
    joined = jn.events_to_blocks(events, jq.sides(spark, sf), ["session_id"], "event_id", "sample_idx", 32)
    return rounded(mt.alignment_summary(joined), ["inside_block_fraction"])


@query(f"""WITH {EV}, {iq.MK}, {iq.TRIALS}, {aq.EVQ}, t AS (SELECT session_id, count(*) AS trials, count(*) FILTER (label = 'LEFT') AS trials_left, count(*) FILTER (label = 'RIGHT') AS trials_right, count(*) FILTER (label = 'JAW') AS trials_jaw,
    count(*) FILTER (duration_sec = expected_count) AS count_matches, count(*) FILTER (duration_sec <> expected_count) AS count_mismatches, count(*) FILTER (overlaps_previous) AS o, count(*) FILTER (duration_sec > 15) AS l FROM tr GROUP BY 1)
SELECT session_id, trials, trials_left, trials_right, trials_jaw, count_matches, count_mismatches, (o > 0)::BIGINT AS hard_issues, (l > 0)::BIGINT AS soft_warnings, (status <> 'safe')::BIGINT AS not_safe_channels, o = 0 AS structural_pass FROM t JOIN q USING (session_id)""")
def trial_review(spark, sf):
    trials = materialize(iq.trials(spark, sf)).withColumn("count_match", F.col("duration_sec") == F.col("expected_count"))
    row = lambda sev, c: F.struct(F.lit(sev).alias("severity"), F.count_if(c).alias("hits"))
    checks = trials.groupBy("session_id").agg(F.array(row("hard", F.col("overlaps_previous")), row("soft", F.col("duration_sec") > 15)).alias("a")).select("session_id", F.inline("a")).filter("hits > 0")
    quality = au.channel_quality(event_samples(spark, sf), TL, ["value"], 200.0, 5.0)
    return mt.trial_review(trials, checks, quality, ["session_id"])


CHAIN = {"jaw_stage2": ["jaw_stage1"], "jaw_stage3": ["jaw_stage2"], "eeg_stage12": [], "eeg_stage3": ["eeg_stage12", "jaw_stage3"], "report": ["eeg_stage3", "eeg_stage12"]}
EDGES = ", ".join(f"('{s}', '{a}')" for s, needs in CHAIN.items() for a in needs)


@query(f"""WITH RECURSIVE v AS (SELECT * FROM (SELECT unnest(['jaw_stage1', 'jaw_stage2', 'jaw_stage3', 'eeg_stage12', 'eeg_stage3', 'report']) AS stage, unnest([avg((value > 5)::INT) > 0.5, avg((value > 40)::INT) > 0.5, avg((value > 5)::INT) > 0.5, avg((value > 10)::INT) > 0.5, true, true]) AS ok FROM events)),
  e AS (SELECT * FROM (VALUES {EDGES}) t(stage, needs)), c AS (SELECT stage, needs FROM e UNION SELECT c.stage, e.needs FROM c JOIN e ON e.stage = c.needs),
  s AS (SELECT v.stage, CASE WHEN count(*) FILTER (NOT a.ok) > 0 THEN 'skipped' WHEN v.ok THEN 'passed' ELSE 'failed' END AS status FROM v LEFT JOIN c ON c.stage = v.stage LEFT JOIN v a ON a.stage = c.needs GROUP BY v.stage, v.ok)
SELECT s.stage, s.status, CASE WHEN s.status = 'skipped' THEN string_agg(d.stage || ' ' || d.status, '; ' ORDER BY d.stage) FILTER (d.status <> 'passed') END AS reason
FROM s LEFT JOIN e ON e.stage = s.stage LEFT JOIN s d ON d.stage = e.needs GROUP BY 1, 2""")
def stage_chain(spark, sf):
    """A chain of stages whose second one misses its gate."""
    v = F.col("value")
    share = lambda c: F.avg(c.cast("double")) > 0.5
    a = table(spark, sf, "events").agg(share(v > 5).alias("a"), share(v > 40).alias("b"), share(v > 10).alias("c"))
    row = lambda s, c: F.struct(F.lit(s).alias("stage"), c.alias("gate_pass"))
    stages = [("jaw_stage1", F.col("a")), ("jaw_stage2", F.col("b")), ("jaw_stage3", F.col("a")), ("eeg_stage12", F.col("c")), ("eeg_stage3", F.lit(True)), ("report", F.lit(True))]
    return mt.stage_chain(a.select(F.inline(F.array(*[row(*s) for s in stages]))), CHAIN)


@query(f"""WITH d AS (SELECT user_id AS session_id, event_type AS label, value < 60 AS x, event_id % 2 AS e FROM events WHERE event_type IN ('click', 'signup'))
SELECT session_id, count(*) AS trial_count, {r('avg(x::INT)')} AS constrained_exact_accuracy, {r('avg(abs(e))')} AS constrained_mae, grouping(session_id) = 1 AS pooled, avg(x::INT) >= 0.55 AND avg(abs(e)) <= 1.0 AS gate_pass FROM d GROUP BY GROUPING SETS ((session_id), ())""")
def decode_by_file(spark, sf):
    d = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("label"), (F.col("value") < 60).alias("constrained_exact"), (F.col("event_id") % 2).alias("constrained_error"))
    return rounded(mt.decode_by_file(d, ["click", "signup"]), ["constrained_exact_accuracy", "constrained_mae"])


COUNTS = ["1", "2", "3"]
JW = """jw AS (SELECT user_id % 5 AS fold, user_id, event_type, CASE event_type WHEN 'click' THEN 'LEFT' WHEN 'signup' THEN 'RIGHT' ELSE 'REST' END AS y, (user_id % 3 + 1)::VARCHAR AS yc,
    value / (value + 30.0) AS m_left, 30.0 / (value + 30.0) AS m_right, 0.45::DOUBLE AS m_rest, ((event_id * 7) % 10) / 10.0::DOUBLE AS c1, ((event_id * 3 + user_id) % 10) / 10.0::DOUBLE AS c2, 0.55::DOUBLE AS c3 FROM events)"""
PICK = """CASE greatest(m_rest, m_left, m_right) WHEN m_rest THEN 'REST' WHEN m_left THEN 'LEFT' ELSE 'RIGHT' END AS p, CASE greatest(c1, c2, c3) WHEN c1 THEN '1' WHEN c2 THEN '2' ELSE '3' END AS pc"""
MEANS = ", ".join(f"avg({c}) AS {c}" for c in ("m_left", "m_right", "m_rest", "c1", "c2", "c3"))


def joint_sql(src, grain):
    count = f"{src}c AS (SELECT * REPLACE (yc AS y, pc AS p) FROM {src})"
    return f"""{metrics_sql(src, 'fold', f'{src}m')}, {count}, {metrics_sql(f'{src}c', 'fold', f'{src}k', COUNTS)}, {src}j AS (SELECT fold, m.n AS {grain}s, m.accuracy AS movement_{grain}_accuracy, m.macro_f1 AS movement_{grain}_macro_f1, k.accuracy AS count_{grain}_accuracy,
    k.macro_f1 AS count_{grain}_macro_f1, joint_{grain}_exact FROM {src}m m JOIN {src}k k USING (fold) JOIN (SELECT fold, {r('avg((y = p AND yc = pc)::INT)')} AS joint_{grain}_exact FROM {src} GROUP BY 1) USING (fold))"""


@query(f"""WITH {JW}, w AS (SELECT *, {PICK} FROM jw), g AS (SELECT fold, user_id, event_type, min(y) AS y, min(yc) AS yc, {MEANS} FROM jw GROUP BY 1, 2, 3), i AS (SELECT *, {PICK} FROM g),
  {joint_sql('w', 'window')}, {joint_sql('i', 'interval')} SELECT * FROM wj JOIN ij USING (fold)""")
def joint_metrics(spark, sf):
    """Movement and count of windows and of the intervals that they vote for, and how often both are right."""
    e, v, u = F.col("event_id"), F.col("value"), F.col("user_id")
    windows = table(spark, sf, "events").select(
        (u % 5).alias("fold"), "user_id", "event_type", F.when(F.col("event_type") == "click", "LEFT").when(F.col("event_type") == "signup", "RIGHT").otherwise("REST").alias("y"), (u % 3 + 1).cast("string").alias("yc"),
        (v / (v + 30.0)).alias("m_left"), (30.0 / (v + 30.0)).alias("m_right"), F.lit(0.45).alias("m_rest"), ((e * 7) % 10 / 10.0).alias("c1"), ((e * 3 + u) % 10 / 10.0).alias("c2"), F.lit(0.55).alias("c3"))
    movement, counts = {"REST": "m_rest", "LEFT": "m_left", "RIGHT": "m_right"}, {"1": "c1", "2": "c2", "3": "c3"}
    intervals = sp.joint_vote(windows, ["fold", "user_id", "event_type"], movement, counts, "y", "yc")
    out = mt.joint_metrics(sp.joint_match(windows, movement, counts, "y", "yc"), intervals, ["fold"], "y", "yc", LABELS, COUNTS)
    return rounded(out, [c for c in out.columns if c not in ("fold", "windows", "intervals")])
