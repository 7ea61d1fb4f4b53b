"""Temporal join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.operators import joins as jn
from pulsegrid.operators import windows as wn
from pulsegrid.runtime import materialize
from pulsegrid.timeline import Timeline, config_rows
from workload import intervals_q as iq
from workload import signal_q as sq
from workload import windows_q as wq
from workload.base import EV, EVENTS_TL as TL, ITEMS_TL, LI, event_samples, hours, r, rounded, table
from workload.registry import query

HOURS = Timeline(chunk_rows=96)
K = ["session_id"]


def timed(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").alias("session_id"), "event_id", hours().alias("t"), "value", F.col("event_type").alias("label"))


TM = "tm AS (SELECT user_id AS session_id, event_id, round((epoch_us(ts) - 1704067200000000) / 3600000000.0, 6) AS t, value, event_type AS label FROM events)"
BL = f"{iq.SEGMENTS}, bl AS (SELECT session_id, segment_index AS block_id, label AS side, start_sample AS block_start, end_sample AS block_end FROM sg WHERE label IN ('LEFT', 'RIGHT'))"


def sides(spark, sf):
    return iq.segments(spark, sf).filter("label IN ('LEFT', 'RIGHT')").select(
        "session_id", F.col("segment_index").alias("block_id"), F.col("label").alias("side"),
        F.col("start_sample").alias("block_start"), F.col("end_sample").alias("block_end"))


@query(f"""WITH {EV}, {iq.MK}, {BL} SELECT e.session_id, event_id, sample_idx, block_id, side, block_start, block_end, block_id IS NOT NULL AS inside_marker_block
FROM ev e LEFT JOIN bl ON e.session_id = bl.session_id AND sample_idx BETWEEN block_start AND block_end WHERE e.label = 'error'
QUALIFY row_number() OVER (PARTITION BY e.session_id, event_id ORDER BY block_id NULLS LAST) = 1""")
def events_to_blocks(spark, sf):
    events = event_samples(spark, sf).filter("label = 'error'").select("session_id", "event_id", "sample_idx")
    return jn.events_to_blocks(events, sides(spark, sf), K, "event_id", "sample_idx", 32)


@query(f"""WITH {EV}, {iq.MK}, {BL} SELECT e.session_id, event_id, sample_idx, coalesce(side, 'UNKNOWN') AS state
FROM ev e LEFT JOIN bl ON e.session_id = bl.session_id AND sample_idx BETWEEN block_start AND block_end
QUALIFY row_number() OVER (PARTITION BY e.session_id, event_id ORDER BY block_id NULLS LAST) = 1""")
def ground_truth_at(spark, sf):
    points = event_samples(spark, sf).select("session_id", "event_id", "sample_idx")
    segs = sides(spark, sf).withColumnRenamed("side", "state")
    return jn.ground_truth_at(points, segs, K, "event_id", "sample_idx", "block_start", "block_end", "block_id", "state", 32)


TRW = f"""{wq.SEGL}, n AS (SELECT session_id, count(*) AS n FROM li GROUP BY 1), w0 AS (
  SELECT session_id, k * 4 AS w_start, k * 4 + 8 AS w_end FROM n, LATERAL (SELECT unnest(range((n - 9) // 4 + 1)) AS k) WHERE n >= 9), ww AS (
  SELECT w0.*, avg(ch1) / 50.0 AS p_active, avg(ch1) / 50.0 >= 0.5 AS gate_active, CASE WHEN sum(ch3) < 45 THEN 'LEFT' ELSE 'RIGHT' END AS lr_pred
  FROM w0 JOIN li ON li.session_id = w0.session_id AND sample_idx BETWEEN w_start AND w_end GROUP BY ALL)"""


def model_windows(spark, sf):
    rows = wn.assign_session_windows(sq.raw(spark, sf), ITEMS_TL, 9, 4)
    agg = rows.groupBy("session_id", F.col("window_start").alias("w_start")).agg(
        F.count(F.lit(1)).alias("n_samples"), (F.avg("ch1") / 50.0).alias("p_active"),
        F.when(F.sum("ch3") < 45, "LEFT").otherwise("RIGHT").alias("lr_pred"))
    return wn.full_windows(agg, 9).drop("n_samples").withColumns({"w_end": F.col("w_start") + 8, "gate_active": F.col("p_active") >= 0.5})


@query(f"""WITH {LI}, {TRW}, ins AS (SELECT sl.session_id, segment_index AS trial_id, label, w_start, p_active, gate_active, lr_pred
    FROM sl JOIN ww ON sl.session_id = ww.session_id AND w_start >= start_sample AND w_end <= end_sample WHERE label <> 'REST'),
  v AS (SELECT session_id, trial_id, lr_pred, count(*) AS c, min(w_start) AS f FROM ins GROUP BY 1, 2, 3),
  mj AS (SELECT session_id, trial_id, lr_pred AS majority_pred, c FROM v QUALIFY row_number() OVER (PARTITION BY session_id, trial_id ORDER BY c DESC, f) = 1),
  ag AS (SELECT session_id, trial_id, count(*) AS windows, avg(p_active) AS m, avg(gate_active::INT) AS g FROM ins GROUP BY 1, 2)
SELECT sl.session_id, segment_index AS trial_id, label AS hand, start_sample AS t_start, end_sample AS t_end, coalesce(windows, 0) AS windows, {r('m')} AS mean_p_active,
  {r('g')} AS active_window_fraction, coalesce(majority_pred, 'unknown') AS majority_pred, {r('c / windows::DOUBLE')} AS majority_vote_fraction, coalesce(majority_pred <> label, false) AS hand_mismatch
FROM sl LEFT JOIN ag ON sl.session_id = ag.session_id AND segment_index = ag.trial_id LEFT JOIN mj ON sl.session_id = mj.session_id AND segment_index = mj.trial_id WHERE label <> 'REST'""")
def windows_in_trial(spark, sf):
    trials = wq.blocks(spark, sf)[1].filter("label <> 'REST'").select(
        "session_id", F.col("segment_index").alias("trial_id"), F.col("label").alias("hand"), F.col("start_sample").alias("t_start"), F.col("end_sample").alias("t_end"))
    out = jn.windows_in_trial(materialize(model_windows(spark, sf)), trials, K, 64).drop("_lo", "_hi")
    return rounded(out, ["mean_p_active", "active_window_fraction", "majority_vote_fraction"])


NEAR = """nr AS (SELECT p.session_id, p.event_id, p.t, m.t AS nearest_at, p.t - m.t AS nearest_delta, m.event_id AS mark_id FROM (SELECT * FROM tm WHERE label = 'click') p
    LEFT JOIN (SELECT * FROM tm WHERE label = 'signup') m USING (session_id) QUALIFY row_number() OVER (PARTITION BY p.session_id, p.event_id ORDER BY abs(p.t - m.t), m.t, m.event_id DESC) = 1)"""


@query(f"WITH {TM}, {NEAR} SELECT session_id, event_id, t, nearest_at, {r('nearest_delta')} AS nearest_delta, mark_id FROM nr")
def nearest_marker(spark, sf):
    rows = timed(spark, sf)
    points = rows.filter("label = 'click'").select("session_id", "event_id", "t")
    marks = rows.filter("label = 'signup'").select("session_id", F.col("t").alias("m_t"), F.col("event_id").alias("mark_id"))
    return rounded(jn.nearest(points, marks, HOURS, "event_id", "t", "m_t", ["mark_id"]), ["nearest_delta"])


@query(f"""WITH {TM}, p AS (SELECT session_id, event_id, t AS center FROM tm WHERE label = 'click'), g AS (SELECT session_id, t, value / 500.0 AS pa FROM tm WHERE label = 'purchase'),
  i AS (SELECT p.session_id, event_id, max(pa) AS m FROM p JOIN g ON p.session_id = g.session_id AND center BETWEEN t - 6.0 AND t + 6.0 GROUP BY 1, 2),
  n AS (SELECT p.session_id, event_id, center, pa FROM p LEFT JOIN g USING (session_id) QUALIFY row_number() OVER (PARTITION BY p.session_id, event_id ORDER BY abs(center - t), t) = 1)
SELECT session_id, event_id, center, coalesce(m, pa) AS projected_p_active, m IS NULL AS used_nearest FROM n LEFT JOIN i USING (session_id, event_id)""")
def project_scores(spark, sf):
    rows = timed(spark, sf)
    wins = rows.filter("label = 'click'").select("session_id", "event_id", F.col("t").alias("center"))
    gates = rows.filter("label = 'purchase'").select(
        "session_id", (F.col("t") - 6.0).alias("g_start"), (F.col("t") + 6.0).alias("g_end"), F.col("t").alias("g_center"), (F.col("value") / 500.0).alias("p_active"))
    return jn.project_scores(wins, gates, HOURS, "event_id", 24.0)


CLS = f"""{iq.CLUSTERS}, cx AS (SELECT session_id, cluster_id, any_value(block_id) AS block_id, min(start_sample)::DOUBLE AS c_start, max(start_sample)::DOUBLE AS c_end FROM cl GROUP BY 1, 2)"""


def cluster_spans(spark, sf):
    return materialize(iq.clusters(spark, sf).groupBy("session_id", "cluster_id").agg(
        F.min("block_id").alias("block_id"), F.min("start_sample").cast("double").alias("c_start"), F.max("start_sample").cast("double").alias("c_end")))


@query(f"""WITH {EV}, {iq.MK}, {CLS}, p AS (SELECT session_id, event_id, sample_idx::DOUBLE AS p_at FROM ev WHERE label = 'view'),
  d AS (SELECT p.session_id, event_id, p_at, cluster_id, block_id, CASE WHEN p_at BETWEEN c_start - 0.25 AND c_end + 0.25 THEN 0.0 WHEN p_at < c_start - 0.25 THEN c_start - 0.25 - p_at ELSE p_at - c_end - 0.25 END AS dist,
    max(c_end) OVER (PARTITION BY p.session_id, event_id) AS last FROM p LEFT JOIN cx USING (session_id)),
  b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY session_id, event_id ORDER BY dist, cluster_id) = 1)
SELECT session_id, event_id, p_at, CASE WHEN dist = 0 THEN cluster_id END AS cluster_id, CASE WHEN dist = 0 THEN block_id END AS block_id,
  CASE WHEN dist = 0 THEN 'cluster_aligned' WHEN p_at > last + 0.25 THEN 'post_marker_tail' ELSE 'unanchored' END AS cluster_anchor_status, dist::DOUBLE AS cluster_distance FROM b""")
def assign_clusters(spark, sf):
    peaks = materialize(event_samples(spark, sf).filter("label = 'view'").select("session_id", "event_id", F.col("sample_idx").cast("double").alias("p_at")))
    return jn.assign_clusters(peaks, cluster_spans(spark, sf), TL, "event_id", "p_at", 0.25, 32.0)


@query(f"""WITH {TM}, p AS (SELECT session_id, event_id, t FROM tm WHERE label = 'signup'), c AS (SELECT session_id, t AS ct FROM tm WHERE label = 'click')
SELECT p.session_id, event_id, t, count(ct) AS trigger_count_nearby, CASE WHEN count(ct) > 0 THEN to_json(list(round(ct, 6) ORDER BY ct))::VARCHAR ELSE '[]' END AS trigger_times, count(ct) > 0 AS trigger_nearby
FROM p LEFT JOIN c ON p.session_id = c.session_id AND abs(ct - t) <= 12 GROUP BY 1, 2, 3""")
def nearby_triggers(spark, sf):
    rows = timed(spark, sf)
    peaks = rows.filter("label = 'signup'").select("session_id", "event_id", "t")
    clicks = rows.filter("label = 'click'").select("session_id", F.col("t").alias("ct"))
    out = jn.nearby_triggers(peaks, clicks, K, "event_id", "t", "ct", 12.0)
    return out.withColumn("trigger_nearby", F.col("trigger_count_nearby") > 0)


@query(f"""WITH {EV}, {iq.MK}, {CLS} SELECT cx.*, max(value / 500.0) AS max_score, arg_max(sample_idx, (value, -sample_idx)) AS best_at, count(*) FILTER (label = 'click') AS trigger_click_count
FROM cx JOIN ev ON ev.session_id = cx.session_id AND sample_idx BETWEEN c_start - 1 AND c_end + 1 GROUP BY ALL""")
def support_window(spark, sf):
    scores = event_samples(spark, sf).select("session_id", F.col("sample_idx").alias("s_at"), (F.col("value") / 500.0).alias("score"), (F.col("label") == "click").alias("clicked"))
    out = jn.support_window(cluster_spans(spark, sf), scores, K, 1.0, 32.0)
    return out


@query(f"""WITH {TM}, p AS (SELECT session_id, event_id AS step_id, label AS step_label, t, t + 4.0 AS e FROM tm WHERE label IN ('purchase', 'signup'))
SELECT tm.session_id, tm.event_id, tm.t, tm.value, step_id, step_label FROM tm JOIN p ON p.session_id = tm.session_id AND tm.t BETWEEN p.t AND e""")
def phase_rows(spark, sf):
    rows = timed(spark, sf)
    steps = rows.filter("label IN ('purchase', 'signup')").select(
        "session_id", F.col("event_id").alias("step_id"), F.col("label").alias("step_label"), F.col("t").alias("step_start"), (F.col("t") + 4.0).alias("step_end"))
    return jn.phase_rows(rows.select("session_id", "event_id", "t", "value"), steps, K, "t", 4.0)


@query(f"""WITH {TM}, p AS (SELECT session_id, event_id AS prompt_id, CASE WHEN event_id % 2 = 0 THEN 'click' ELSE 'signup' END AS target, t AS p_start FROM tm WHERE label = 'purchase'),
  h AS (SELECT p.*, d.t AS d_at, d.label AS d_class, min(CASE WHEN d.label = target THEN d.t END) OVER (PARTITION BY p.session_id, prompt_id) AS f
    FROM p LEFT JOIN tm d ON d.session_id = p.session_id AND d.label IN ('click', 'signup') AND d.t BETWEEN p_start AND p_start + 20)
SELECT session_id, prompt_id, target, p_start, max(f) AS success_time, count(*) FILTER (d_class <> target AND (f IS NULL OR d_at < f)) AS wrong_detections_count,
  max(f) IS NOT NULL AS success, {r('max(f) - p_start')} AS latency, {r('coalesce(max(f), p_start + 20)')} AS end_time, max(f) IS NULL AS timeout_flag FROM h GROUP BY 1, 2, 3, 4""")
def prompt_outcomes(spark, sf):
    rows = timed(spark, sf)
    prompts = rows.filter("label = 'purchase'").select(
        "session_id", F.col("event_id").alias("prompt_id"), F.when(F.col("event_id") % 2 == 0, "click").otherwise("signup").alias("target"), F.col("t").alias("p_start"))
    det = rows.filter("label IN ('click', 'signup')").select("session_id", F.col("t").alias("d_at"), F.col("label").alias("d_class"))
    return rounded(jn.prompt_outcomes(prompts, det, K, 20.0), ["latency", "end_time"])


@query("SELECT a.s_suppkey AS train_session, b.s_suppkey AS test_session FROM supplier a, supplier b WHERE a.s_suppkey IN (1, 2, 3, 5) AND b.s_suppkey IN (1, 2, 3, 5) AND a.s_suppkey <> b.s_suppkey")
def ordered_session_pairs(spark, sf):
    return jn.ordered_pairs(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("session_id")), [1, 2, 3, 5])


@query(f"""WITH {EV}, c AS (SELECT * FROM (VALUES (10.0), (50.0), (200.0)) v(th)) SELECT session_id, th::DOUBLE AS threshold, count(*) FILTER (value >= th) AS hits, count(*) AS samples
FROM ev, c GROUP BY 1, 2""")
def config_rows_counts(spark, sf):
    grid = [{"threshold": 10.0}, {"threshold": 50.0}, {"threshold": 200.0}]
    rows = config_rows(event_samples(spark, sf).select("session_id", "value"), grid)
    return rows.groupBy("session_id", "threshold").agg(F.count_if(F.col("value") >= F.col("threshold")).alias("hits"), F.count(F.lit(1)).alias("samples"))
