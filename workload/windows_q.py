"""Window and window-feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.operators import features as ft
from pulsegrid.operators import intervals as iv
from pulsegrid.operators import signal as sg
from pulsegrid.operators import windows as wn
from pulsegrid.runtime import materialize
from pulsegrid.timeline import Running, Timeline, carry, range_join
from workload import intervals_q as iq
from workload import signal_q as sq
from workload.base import CHANNELS, EV, EVENTS_TL, ITEMS_TL as TL, LI, event_samples, item_samples, r, rounded, table
from workload.registry import query

LEN, HOP = 9, 4

# a repeating REST / LEFT / RIGHT protocol by sample position cuts each recording into segments
BLOCK = "CASE WHEN sample_idx % 97 < 20 THEN 'REST' WHEN sample_idx % 97 < 60 THEN 'LEFT' ELSE 'RIGHT' END"
SEGL = f"""sl AS (SELECT session_id, {BLOCK} AS label, min(sample_idx) AS start_sample, max(sample_idx) AS end_sample,
    row_number() OVER (PARTITION BY session_id ORDER BY min(sample_idx)) - 1 AS segment_index
  FROM li GROUP BY session_id, {BLOCK}, sample_idx // 97)"""
WINL = f"""wl AS (SELECT sl.*, k AS window_index, start_sample + k * {HOP} AS window_start, start_sample + k * {HOP} + {LEN - 1} AS window_end
  FROM sl, LATERAL (SELECT unnest(range((end_sample - start_sample + 1 - {LEN}) // {HOP} + 1)) AS k) WHERE end_sample - start_sample + 1 >= {LEN})"""
AWL = """aw AS (SELECT wl.session_id, wl.label, segment_index, window_index, window_start, window_end, sample_idx, ch1, ch2, ch3, ch4
  FROM wl JOIN li ON li.session_id = wl.session_id AND li.sample_idx BETWEEN window_start AND window_end)"""
WKEYS = ["session_id", "segment_index", "label", "window_start"]


def blocks(spark, sf):
    """Recordings cut into a repeating REST / LEFT / RIGHT protocol by sample position."""
    part = F.col("sample_idx") % 97
    label = F.when(part < 20, "REST").when(part < 60, "LEFT").otherwise("RIGHT")
    samples = materialize(item_samples(spark, sf).select("session_id", "sample_idx", *CHANNELS))
    segments = iv.rle_segments(samples.withColumn("label", label), TL, "label", 1.0).select(
        "session_id", "label", F.col("start_idx").alias("start_sample"), F.col("end_idx").alias("end_sample"))
    numbered = carry(segments, TL.at("start_sample"), _n=Running("sum", F.lit(1)))
    return samples, numbered.withColumn("segment_index", F.col("_n") - 1).drop("_n")


@query(f"WITH {LI}, {SEGL}, {WINL} SELECT session_id, label, segment_index, start_sample, end_sample, window_start, window_end FROM wl")
def segment_windows(spark, sf):
    return wn.segment_windows(blocks(spark, sf)[1], LEN, HOP)


@query(f"""WITH {LI}, {SEGL} SELECT session_id, label, segment_index, start_sample, end_sample, w AS window_start, w + {LEN} AS window_end
FROM sl, LATERAL (SELECT unnest(range(start_sample, end_sample - {LEN} + 1, {HOP})) AS w)""")
def segment_windows_half_open(spark, sf):
    return wn.segment_windows(blocks(spark, sf)[1], LEN, HOP, "half_open")


@query(f"""WITH {LI}, {SEGL} SELECT session_id, label, segment_index, start_sample, end_sample, w AS window_start, least(w + 29, end_sample) AS window_end,
  end_sample - start_sample + 1 < 30 AS full_interval_fallback
FROM sl, LATERAL (SELECT unnest(CASE WHEN end_sample - start_sample + 1 < 30 THEN [start_sample] ELSE range(start_sample, end_sample - 28, 10) END) AS w)""")
def interval_windows_fallback(spark, sf):
    return wn.segment_windows(blocks(spark, sf)[1], 30, 10, "fallback")


@query(f"""WITH {LI}, {SEGL}, {WINL}, g AS (SELECT session_id, segment_index, row_number() OVER (PARTITION BY session_id ORDER BY start_sample) - 1 AS group_id,
    row_number() OVER (PARTITION BY session_id, label ORDER BY start_sample) - 1 AS trial_index_within_class FROM sl)
SELECT wl.session_id, label, segment_index, start_sample, end_sample, window_start, window_end, group_id, trial_index_within_class,
  CASE WHEN label = 'REST' THEN 'REST' ELSE 'Active' END AS intent_label FROM wl JOIN g USING (session_id, segment_index) WHERE window_start - start_sample <= 16""")
def trial_windows(spark, sf):
    trials = wn.trial_groups(materialize(blocks(spark, sf)[1]), TL, rest="REST")
    return wn.onset_windows(wn.segment_windows(trials, LEN, HOP), 16)


@query(f"""WITH {LI}, n AS (SELECT session_id, count(*) AS n FROM li GROUP BY 1), w AS (
  SELECT session_id, k * 10 AS window_start FROM n, LATERAL (SELECT unnest(range((n - 21) // 10 + 1)) AS k) WHERE n >= 21)
SELECT w.session_id, window_start, count(*) AS n_samples, max(label) FILTER (sample_idx = window_start + 10) AS label_center,
  {', '.join(f"{r(f'sqrt(avg({c} * {c}))')} AS {c}_rms" for c in CHANNELS)},
  {r('(sqrt(avg(ch1 * ch1)) + sqrt(avg(ch2 * ch2)) + sqrt(avg(ch3 * ch3)) + sqrt(avg(ch4 * ch4))) / 4')} AS aggregate_rms
FROM w JOIN li ON li.session_id = w.session_id AND sample_idx BETWEEN window_start AND window_start + 20 GROUP BY 1, 2""")
def session_windows(spark, sf):
    rows = wn.assign_session_windows(sq.raw(spark, sf), TL, 21, 10)
    agg = rows.groupBy("session_id", "window_start").agg(
        F.count(F.lit(1)).alias("n_samples"), wn.center_value("label", 21, "sample_idx").alias("label_center"), *ft.rms_features(CHANNELS))
    return rounded(wn.full_windows(agg, 21), [f"{c}_rms" for c in CHANNELS] + ["aggregate_rms"])


@query(f"""WITH {EV}, {iq.MK}, {iq.SEGMENTS}, p AS (SELECT session_id, start_sample AS block_start_sample, end_sample AS block_end_sample, (start_sample + end_sample) // 2 AS peak_sample FROM sg)
SELECT *, least(greatest(peak_sample - 4, block_start_sample), greatest(block_start_sample, block_end_sample - 8)) AS window_start,
  least(block_end_sample, least(greatest(peak_sample - 4, block_start_sample), greatest(block_start_sample, block_end_sample - 8)) + 8) AS window_end FROM p""")
def event_window_bounds(spark, sf):
    segs = iq.segments(spark, sf).select(
        "session_id", F.col("start_sample").alias("block_start_sample"), F.col("end_sample").alias("block_end_sample"),
        F.floor((F.col("start_sample") + F.col("end_sample")) / 2).alias("peak_sample"))
    return segs.withColumns(wn.event_window_bounds(9))


@query(f"""WITH {EV}, {iq.MK}, {iq.SEGMENTS} SELECT session_id, segment_index, t AS tile_start, t + 4 AS tile_end FROM sg,
  LATERAL (SELECT unnest(range(start_sample, end_sample - 5 + 1, 5)) AS t) WHERE label = 'REST' AND end_sample - start_sample >= 5""")
def tile_intervals(spark, sf):
    rest = iq.segments(spark, sf).filter("label = 'REST'").select("session_id", "segment_index", "start_sample", "end_sample")
    return wn.tile_intervals(rest, 5).drop("start_sample", "end_sample")


TIME_COLS = [f"{c}_{s}" for c in CHANNELS for s in ("mean", "std", "rms", "ptp", "var", "energy")]
TIME_SQL = ", ".join(
    f"{r(f'avg({c})')} AS {c}_mean, {r(f'stddev_pop({c})')} AS {c}_std, {r(f'sqrt(avg({c} * {c}))')} AS {c}_rms, {r(f'max({c}) - min({c})')} AS {c}_ptp, "
    f"{r(f'var_pop({c})')} AS {c}_var, {r(f'avg({c} * {c})')} AS {c}_energy" for c in CHANNELS)


def assigned(spark, sf):
    samples, segments = blocks(spark, sf)
    return wn.assign_segment_windows(samples, segments, TL, LEN, HOP)


@query(f"WITH {LI}, {SEGL}, {WINL}, {AWL} SELECT session_id, segment_index, label, window_start, {TIME_SQL} FROM aw GROUP BY 1, 2, 3, 4")
def time_features(spark, sf):
    return rounded(assigned(spark, sf).groupBy(*WKEYS).agg(*ft.time_features(CHANNELS)), TIME_COLS)


EMG_SQL = ", ".join(
    f"{r(f'sqrt(avg({c} * {c}))')} AS {c}_RMS, {r(f'avg(abs({c}))')} AS {c}_MAV, {r(f'var_pop({c})')} AS {c}_VAR, {r(f'coalesce(sum(abs(d_{c})), 0)')} AS {c}_WL, "
    f"count(*) FILTER (zs_{c} <> zp_{c}) AS {c}_ZC, count(*) FILTER (s_{c} <> sp_{c}) AS {c}_SSC" for c in CHANNELS)
WIN = "PARTITION BY session_id, segment_index, window_start"


@query(f"""WITH {LI}, {SEGL}, {WINL}, {AWL},
 a1 AS (SELECT *, {', '.join(f"{c} - lag({c}) OVER ({WIN} ORDER BY sample_idx) AS d_{c}, sign({c} - avg({c}) OVER ({WIN})) AS zs_{c}" for c in CHANNELS)} FROM aw),
 a2 AS (SELECT *, {', '.join(f"lag(zs_{c}) OVER ({WIN} ORDER BY sample_idx) AS zp_{c}, sign(d_{c}) AS s_{c}, lag(sign(d_{c})) OVER ({WIN} ORDER BY sample_idx) AS sp_{c}" for c in CHANNELS)} FROM a1)
SELECT session_id, segment_index, label, window_start, count(*) AS n_samples, {EMG_SQL} FROM a2 GROUP BY 1, 2, 3, 4""")
def emg_features(spark, sf):
    samples, segments = blocks(spark, sf)
    rows = wn.assign_segment_windows(ft.with_steps(samples, TL, CHANNELS), segments, TL, LEN, HOP)
    out = ft.emg_features(rows, TL, WKEYS, CHANNELS)
    return rounded(out, [f"{c}_{s}" for c in CHANNELS for s in ("RMS", "MAV", "VAR", "WL")])


ENVS = ["aggregate_rms", "aggregate_rms_smooth"]
EVENT_SQL = TIME_SQL + ", " + ", ".join(
    f"{r(f'avg(abs({c}))')} AS {c}_abs_mean, {r(f'coalesce(regr_slope({c}, sample_idx), 0)')} AS {c}_slope" for c in CHANNELS) + ", " + ", ".join(
    f"{r(f'avg({e})')} AS {e}_mean, {r(f'stddev_pop({e})')} AS {e}_std, {r(f'max({e})')} AS {e}_max, {r(f'arg_max({e}, sample_idx) - arg_min({e}, sample_idx)')} AS {e}_delta, "
    f"{r(f'coalesce(regr_slope({e}, sample_idx), 0)')} AS {e}_slope" for e in ENVS)


@query(f"""WITH {LI}, {sq.ENV}, n AS (SELECT session_id, count(*) AS n FROM li GROUP BY 1), w AS (
  SELECT session_id, k * 10 AS window_start FROM n, LATERAL (SELECT unnest(range((n - 21) // 10 + 1)) AS k) WHERE n >= 21)
SELECT w.session_id, window_start, count(*) AS n_samples, max(label) FILTER (sample_idx = window_start + 10) AS event_label, {EVENT_SQL}
FROM w JOIN en ON en.session_id = w.session_id AND sample_idx BETWEEN window_start AND window_start + 20 GROUP BY 1, 2""")
def event_features(spark, sf):
    rows = wn.assign_session_windows(sg.with_envelope(sq.raw(spark, sf), TL, CHANNELS, 8), TL, 21, 10)
    agg = rows.groupBy("session_id", "window_start").agg(
        F.count(F.lit(1)).alias("n_samples"), wn.center_value("label", 21, "sample_idx").alias("event_label"),
        *ft.event_features(CHANNELS, "sample_idx"))
    out = wn.full_windows(agg, 21)
    return rounded(out, [c for c in out.columns if c not in ("session_id", "window_start", "n_samples", "event_label")])


PEAK_SQL = ", ".join(
    f"{r(f'max(rms_{c})')} AS {c}_rms, {r(f'max(mav_{c})')} AS {c}_mav, {r(f'max(var_{c})')} AS {c}_variance, {r(f'max(pk_{c})')} AS {c}_peak_abs, {r(f'max(wl_{c})')} AS {c}_waveform_length, "
    f"{r(f'max(rms_{c}) - (max(rms_ch1) + max(rms_ch2) + max(rms_ch3) + max(rms_ch4)) / 4')} AS {c}_rms_asym, "
    f"{r(f'max(mav_{c}) - (max(mav_ch1) + max(mav_ch2) + max(mav_ch3) + max(mav_ch4)) / 4')} AS {c}_mav_asym" for c in CHANNELS)


@query(f"""WITH {LI}, {SEGL}, {WINL}, {AWL}, a1 AS (SELECT *, {sq.RMS} AS aggregate_rms FROM aw), a2 AS (SELECT *,
    {', '.join(f"{c} - lag({c}) OVER ({WIN} ORDER BY sample_idx) AS d_{c}" for c in CHANNELS + ['aggregate_rms'])} FROM a1), a3 AS (
  SELECT session_id, segment_index, label, window_start, {', '.join(f"sqrt(avg({c} * {c})) AS rms_{c}, avg(abs({c})) AS mav_{c}, var_pop({c}) AS var_{c}, max(abs({c})) AS pk_{c}, coalesce(sum(abs(d_{c})), 0) AS wl_{c}" for c in CHANNELS)},
    avg(aggregate_rms) AS m, stddev_pop(aggregate_rms) AS s, max(aggregate_rms) AS x, coalesce(sum(abs(d_aggregate_rms)), 0) AS wl FROM a2 GROUP BY 1, 2, 3, 4)
SELECT session_id, segment_index, label, window_start, {PEAK_SQL}, {r('max(m)')} AS aggregate_rms_mean, {r('max(s)')} AS aggregate_rms_std,
  {r('max(x)')} AS aggregate_rms_max, {r('max(wl)')} AS aggregate_rms_waveform_length FROM a3 GROUP BY 1, 2, 3, 4""")
def peak_event_features(spark, sf):
    samples, segments = blocks(spark, sf)
    rows = samples.withColumn("aggregate_rms", sg.aggregate_rms(CHANNELS))
    rows = wn.assign_segment_windows(ft.with_steps(rows, TL, [*CHANNELS, "aggregate_rms"]), segments, TL, LEN, HOP)
    out = ft.peak_event_features(rows, WKEYS, CHANNELS, "sample_idx")
    return rounded(out, [c for c in out.columns if c not in WKEYS])


SEGF = ", ".join(
    f"{r(f'avg({e})')} AS {e}_mean, {r(f'stddev_pop({e})')} AS {e}_std, {r(f'max({e})')} AS {e}_max, {r(f'arg_max({e}, sample_idx) - arg_min({e}, sample_idx)')} AS {e}_delta, "
    f"{r(f'max({e}) - min({e})')} AS {e}_ptp, {r(f'CASE WHEN count(*) < 2 THEN 0 ELSE regr_slope({e}, sample_idx) END')} AS {e}_slope" for e in ENVS)


@query(f"""WITH {LI}, {sq.ENV}, {SEGL}, j AS (SELECT sl.segment_index, sl.label AS coarse_label, en.session_id, sample_idx, aggregate_rms, aggregate_rms_smooth,
    CASE WHEN en.label = 'R' THEN 'ACTIVE' WHEN en.label = 'A' THEN 'ONSET' ELSE 'INACTIVE' END AS st
  FROM en JOIN sl ON en.session_id = sl.session_id AND sample_idx BETWEEN start_sample AND end_sample WHERE sl.label <> 'REST')
SELECT session_id, segment_index, coarse_label, {', '.join(f"{r(f'''avg((st = '{s}')::INT)''')} AS {s.lower()}_fraction" for s in ['ONSET', 'ACTIVE', 'OFFSET', 'INACTIVE'])}, {SEGF} FROM j GROUP BY 1, 2, 3""")
def segment_features(spark, sf):
    env = sg.with_envelope(sq.raw(spark, sf), TL, CHANNELS, 8)
    state = F.when(F.col("label") == "R", "ACTIVE").when(F.col("label") == "A", "ONSET").otherwise("INACTIVE")
    spans = blocks(spark, sf)[1].withColumnRenamed("label", "coarse_label").filter("coarse_label <> 'REST'")
    inside = range_join(env.withColumn("event_label", state), spans, ["session_id"], "sample_idx", "start_sample", "end_sample", TL.cell)
    out = ft.segment_features(inside, ["session_id", "segment_index", "coarse_label"], "sample_idx")
    return rounded(out, [c for c in out.columns if c not in ("session_id", "segment_index", "coarse_label")])


# --- spectra on the embeddings table: one row is one 64-sample window at 64 Hz ---------------------

N = 64
EMB = "em AS (SELECT vec_id, unnest(range(64)) AS j, unnest(embedding)::DOUBLE AS x FROM embeddings), mu AS (SELECT vec_id, avg(x) AS m FROM em GROUP BY 1)"
PSD = f"""ps AS (SELECT vec_id, k, (pow(sum((x - m) * h * cos(2 * pi() * k * j / 64.0)), 2) + pow(sum((x - m) * h * sin(2 * pi() * k * j / 64.0)), 2))
    * (CASE WHEN k IN (0, 32) THEN 1.0 ELSE 2.0 END) / (64.0 * 24.0) AS power
  FROM (SELECT em.*, m, 0.5 - 0.5 * cos(2 * pi() * j / 64.0) AS h FROM em JOIN mu USING (vec_id)), range(33) t(k) GROUP BY 1, 2)"""
PSD = PSD.replace("range(33) t(k)", "(SELECT unnest(range(33))::DOUBLE AS k) t")


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("j", "x")).withColumn("x", F.col("x").cast("double"))


@query(f"""WITH {EMB}, {PSD} SELECT vec_id, {r('sum(power) FILTER (k BETWEEN 8 AND 12)', 8)} AS x_mu_power, {r('sum(power) FILTER (k BETWEEN 13 AND 30)', 8)} AS x_beta_power FROM ps GROUP BY 1""")
def band_power(spark, sf):
    out = ft.band_power_sum(vectors(spark, sf), ["vec_id"], ["x"], F.col("j"), N, 64.0)
    return rounded(out, ["x_mu_power", "x_beta_power"], 8)


SEG32 = """sgm AS (SELECT vec_id, s, j - s * 16 AS j, x FROM em, (SELECT unnest(range(3)) AS s) WHERE j BETWEEN s * 16 AND s * 16 + 31),
  m32 AS (SELECT vec_id, s, avg(x) AS m FROM sgm GROUP BY 1, 2), p32 AS (
  SELECT vec_id, s, k, (pow(sum((x - m) * h * cos(2 * pi() * k * j / 32.0)), 2) + pow(sum((x - m) * h * sin(2 * pi() * k * j / 32.0)), 2)) * 2.0 / (32.0 * 12.0) AS power
  FROM (SELECT sgm.*, m, 0.5 - 0.5 * cos(2 * pi() * j / 32.0) AS h FROM sgm JOIN m32 USING (vec_id, s)), (SELECT unnest(range(1, 16))::DOUBLE AS k) GROUP BY 1, 2, 3)"""


@query(f"""WITH {EMB}, {SEG32} SELECT vec_id, {r('avg(a)', 8)} AS x_mu_power, {r('avg(b)', 8)} AS x_beta_power FROM (
  SELECT vec_id, s, sum(power) FILTER (k BETWEEN 8 AND 12) AS a, sum(power) FILTER (k BETWEEN 13 AND 15) AS b FROM p32 GROUP BY 1, 2) GROUP BY 1""")
def band_power_welch(spark, sf):
    """Windows longer than one Welch segment: three half-overlapping segments are averaged."""
    bands = {"mu": (8.0, 12.0), "beta": (13.0, 15.0)}
    return rounded(ft.band_power_sum(vectors(spark, sf), ["vec_id"], ["x"], F.col("j"), N, 32.0, bands), ["x_mu_power", "x_beta_power"], 8)


@query(f"WITH {EMB}, {PSD} SELECT vec_id, 'x' AS channel, k AS freq, {r('power', 8)} AS power FROM ps")
def psd_rows(spark, sf):
    return rounded(ft.psd_rows(vectors(spark, sf), ["vec_id"], ["x"], F.col("j"), N, 64.0), ["power"], 8)


@query(f"""WITH {EMB}, {PSD}, c AS (SELECT *, sum(power) OVER (PARTITION BY vec_id ORDER BY k) AS cum, sum(power) OVER (PARTITION BY vec_id) AS tot,
    lead(k) OVER (PARTITION BY vec_id ORDER BY k) AS nk, lead(power) OVER (PARTITION BY vec_id ORDER BY k) AS np FROM ps)
SELECT vec_id, 'x' AS channel, {r('sum((power + np) / 2 * (nk - k)) FILTER (k >= 5 AND nk <= 15)', 8)} AS low_band, {r('sum((power + np) / 2 * (nk - k)) FILTER (k >= 15 AND nk <= 30)', 8)} AS high_band,
  {r('sum(k * power) / max(tot)')} AS mean_freq, min(k) FILTER (cum >= tot / 2) AS median_freq FROM c GROUP BY 1""")
def spectral_summary(spark, sf):
    psd = ft.psd_rows(vectors(spark, sf), ["vec_id"], ["x"], F.col("j"), N, 64.0)
    out = ft.spectral_summary(psd, ["vec_id"], {"low_band": (5.0, 15.0), "high_band": (15.0, 30.0)})
    return rounded(rounded(out, ["low_band", "high_band"], 8), ["mean_freq"])


HALF = """hf AS (SELECT vec_id, j // 2 AS j, max(x) FILTER (j % 2 = 0) AS c1, max(x) FILTER (j % 2 = 1) AS c2 FROM em GROUP BY 1, 2),
  lf AS (SELECT vec_id, j, unnest(['c1', 'c2']) AS c, unnest([c1, c2]) AS x FROM hf), ml AS (SELECT vec_id, c, avg(x) AS m FROM lf GROUP BY 1, 2),
  pw AS (SELECT vec_id, c, k, (pow(sum((x - m) * h * cos(2 * pi() * k * j / 32.0)), 2) + pow(sum((x - m) * h * sin(2 * pi() * k * j / 32.0)), 2)) * 2.0 / (64.0 * 12.0) AS power
    FROM (SELECT lf.*, m, 0.5 - 0.5 * cos(2 * pi() * j / 32.0) AS h FROM lf JOIN ml USING (vec_id, c)), (SELECT unnest(range(4, 16))::DOUBLE AS k) GROUP BY 1, 2, 3),
  bp AS (SELECT vec_id, sum(power) FILTER (c = 'c1' AND k * 2 BETWEEN 8 AND 12) AS m1, sum(power) FILTER (c = 'c2' AND k * 2 BETWEEN 8 AND 12) AS m2,
    sum(power) FILTER (c = 'c1' AND k * 2 BETWEEN 13 AND 30) AS b1, sum(power) FILTER (c = 'c2' AND k * 2 BETWEEN 13 AND 30) AS b2 FROM pw GROUP BY 1)"""


@query(f"""WITH {EMB}, {HALF} SELECT vec_id, {r('m1', 8)} AS c1_mu_power, {r('b1', 8)} AS c1_beta_power, {r('m2', 8)} AS c2_mu_power, {r('b2', 8)} AS c2_beta_power,
  {r('m1 - m2', 8)} AS mu_asym_c1__c2, {r('b1 - b2', 8)} AS beta_asym_c1__c2, {r('m1 - m2', 8)} AS "C3_C4_Mu_Diff", {r('m2 - m1', 8)} AS "C4_C3_Mu_Diff",
  {r('(m1 - m2) / (m1 + m2 + 1e-6)')} AS "Mu_Asymmetry_Ratio", {r('b1 - b2', 8)} AS "C3_C4_Beta_Diff", {r('b2 - b1', 8)} AS "C4_C3_Beta_Diff" FROM bp""")
def asymmetry_features(spark, sf):
    """Each vector read as two interleaved 32-sample channels at 64 Hz."""
    two = vectors(spark, sf).groupBy("vec_id", F.floor(F.col("j") / 2).alias("j")).agg(
        F.max(F.when(F.col("j") % 2 == 0, F.col("x"))).alias("c1"), F.max(F.when(F.col("j") % 2 == 1, F.col("x"))).alias("c2"))
    power = ft.band_power_sum(two, ["vec_id"], ["c1", "c2"], F.col("j"), 32, 64.0)
    out = power.withColumns({**ft.pairwise_asymmetry(["c1", "c2"]), **ft.c3c4_asymmetry("c1", "c2")})
    return rounded(rounded(out, [c for c in out.columns if c not in ("vec_id", "Mu_Asymmetry_Ratio")], 8), ["Mu_Asymmetry_Ratio"])


MOTOR = "mo AS (SELECT vec_id, var_pop(x) AS v, sqrt(avg(x * x)) AS rm, sum(abs(d)) AS wl FROM (SELECT *, x - lag(x) OVER (PARTITION BY vec_id ORDER BY j) AS d FROM em) GROUP BY 1)"


@query(f"""WITH {EMB}, {PSD}, {MOTOR}, b AS (SELECT vec_id, sum(power) FILTER (k BETWEEN 8 AND 12) AS m, sum(power) FILTER (k BETWEEN 13 AND 30) AS b FROM ps GROUP BY 1)
SELECT vec_id, {r('v', 8)} AS "x_Var", {r('rm', 8)} AS "x_RMS", {r('wl', 8)} AS "x_WL", {r('m', 8)} AS x_mu_power, {r('b', 8)} AS x_beta_power FROM mo JOIN b USING (vec_id)""")
def motor_features(spark, sf):
    rows = vectors(spark, sf)
    steps = ft.with_steps(rows, Timeline(keys=("vec_id",), pos="j"), ["x"]).withColumn("window_start", F.lit(0))
    shape = steps.groupBy("vec_id").agg(F.var_pop("x").alias("x_Var"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("x_RMS"), ft.waveform_length("x", "j").alias("x_WL"))
    out = shape.join(ft.band_power_sum(rows, ["vec_id"], ["x"], F.col("j"), N, 64.0), "vec_id")
    return rounded(out, [c for c in out.columns if c != "vec_id"], 8)


# --- window selection and refinement ----------------------------------------------------------------

def feature_windows(spark, sf):
    rows = assigned(spark, sf).groupBy(*WKEYS).agg(*[c for c in ft.rms_features(CHANNELS)])
    return rows.withColumns({"start_time_sec": F.col("window_start") / 1.0, "end_time_sec": (F.col("window_start") + LEN - 1) / 1.0})


FW = f"""fw AS (SELECT session_id, segment_index, label, window_start, {', '.join(f'sqrt(avg({c} * {c})) AS {c}_rms' for c in CHANNELS)},
    (sqrt(avg(ch1 * ch1)) + sqrt(avg(ch2 * ch2)) + sqrt(avg(ch3 * ch3)) + sqrt(avg(ch4 * ch4))) / 4 AS aggregate_rms,
    window_start / 1.0::DOUBLE AS start_time_sec, (window_start + {LEN - 1}) / 1.0::DOUBLE AS end_time_sec FROM aw GROUP BY 1, 2, 3, 4)"""
FWALL = f"WITH {LI}, {SEGL}, {WINL}, {AWL}, {FW}"


@query(f"""{FWALL}, rk AS (SELECT *, label IN ('LEFT', 'RIGHT') AS mv, row_number() OVER (PARTITION BY session_id, segment_index ORDER BY aggregate_rms DESC, window_start) AS rn,
    count(*) OVER (PARTITION BY session_id, segment_index) AS n FROM fw)
SELECT session_id, segment_index, window_start, label AS original_label, CASE WHEN mv AND rn <= greatest(1, ceil(n * 0.5)) THEN 'ACTIVE' ELSE 'REST' END AS label, {r('aggregate_rms')} AS aggregate_rms FROM rk""")
def rms_refine(spark, sf):
    out = wn.rms_refine(feature_windows(spark, sf).drop("aggregate_rms"), ["session_id", "segment_index"], CHANNELS, 0.5)
    return rounded(out.select("session_id", "segment_index", "window_start", "original_label", "label", "aggregate_rms"), ["aggregate_rms"])


@query(f"""{FWALL}, ar AS (SELECT session_id, CASE WHEN label = 'REST' THEN 'REST' ELSE 'ACTIVE' END AS label, aggregate_rms FROM fw),
  t AS (SELECT session_id, quantile_cont(aggregate_rms, 0.8) AS th FROM ar GROUP BY 1)
SELECT session_id, {r('max(th)')} AS threshold, {r("avg((label = 'ACTIVE')::INT)")} AS overall_active_fraction, count(*) FILTER (aggregate_rms >= th) AS top_windows,
  {r("avg((label = 'ACTIVE')::INT) FILTER (aggregate_rms >= th)")} AS top_active_fraction FROM ar JOIN t USING (session_id) GROUP BY 1""")
def top_window_shares(spark, sf):
    rows = materialize(feature_windows(spark, sf).withColumn("label", F.when(F.col("label") == "REST", "REST").otherwise("ACTIVE")))
    return rounded(wn.top_window_shares(rows, TL.at("window_start"), 0.2), ["threshold", "overall_active_fraction", "top_active_fraction"])


@query(f"{FWALL} SELECT session_id, segment_index, label, window_start, {r('aggregate_rms')} AS aggregate_rms FROM fw WHERE label IN ('BASELINE', 'REST') AND start_time_sec >= 0 AND end_time_sec <= 200")
def calibration_subset(spark, sf):
    out = wn.calibration_subset(feature_windows(spark, sf), 200.0)
    return rounded(out.select(*WKEYS, "aggregate_rms"), ["aggregate_rms"])


@query(f"{FWALL} SELECT session_id, segment_index, label, window_start, {r('aggregate_rms')} AS aggregate_rms FROM fw WHERE start_time_sec >= 200 AND label <> 'BASELINE'")
def post_calibration(spark, sf):
    out = wn.post_calibration(feature_windows(spark, sf), 200.0)
    return rounded(out.select(*WKEYS, "aggregate_rms"), ["aggregate_rms"])


@query(f"{FWALL} SELECT label, count(*) AS windows FROM fw GROUP BY 1")
def window_counts(spark, sf):
    return feature_windows(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("windows"))


@query(f"""WITH {EV}, {iq.MK}, {iq.SEGMENTS}, w AS (SELECT sg.session_id, label, segment_index, start_sample + k * 2 AS ws
    FROM sg, LATERAL (SELECT unnest(range((end_sample - start_sample + 1 - 3) // 2 + 1)) AS k) WHERE end_sample - start_sample + 1 >= 3), f AS (
  SELECT w.session_id, w.label, segment_index, ws, avg(value) AS m, stddev_pop(value) AS s, sqrt(avg(value * value)) AS rm, max(value) - min(value) AS p
  FROM w JOIN ev ON ev.session_id = w.session_id AND sample_idx BETWEEN ws AND ws + 2 GROUP BY 1, 2, 3, 4)
SELECT label, count(*) AS windows, {r('avg(m)')} AS mean_value_mean, {r('avg(s)')} AS mean_value_std, {r('avg(rm)')} AS mean_value_rms, {r('avg(p)')} AS mean_value_ptp FROM f GROUP BY 1""")
def segment_window_label_means(spark, sf):
    """Markers to paired segments to windows to features to per-label means: the whole chain in one query."""
    samples = event_samples(spark, sf).select("session_id", "sample_idx", "value")
    rows = wn.assign_segment_windows(samples, iq.segments(spark, sf), EVENTS_TL, 3, 2)
    feats = rows.groupBy("session_id", "label", "segment_index", "window_start").agg(*ft.time_features(["value"]))
    out = feats.groupBy("label").agg(F.count(F.lit(1)).alias("windows"), *[F.avg(f"value_{s}").alias(f"mean_value_{s}") for s in ("mean", "std", "rms", "ptp")])
    return rounded(out, [c for c in out.columns if c.startswith("mean_")])
