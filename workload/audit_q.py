"""Sampling, channel-quality and session-audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.operators import audit as au
from pulsegrid.operators import intervals as iv
from pulsegrid.runtime import materialize
from pulsegrid.timeline import exact_quantiles
from workload import intervals_q as iq
from workload.base import CHANNELS, EV, EVENTS_TL as TL, ITEMS_TL, LI, event_samples, item_samples, r, rounded, table
from workload.registry import query

RAIL, TOL = 50.0, 2.0


def day_samples(spark, sf):
    """Event samples with the timestamp in days, so that usual steps are below one unit."""
    days = F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 86400000000.0
    return event_samples(spark, sf).withColumn("t", days)


SAMPLING = """dt AS (SELECT session_id, sample_idx, epoch_us(ts)::DOUBLE / 86400000000.0 AS t,
    epoch_us(ts)::DOUBLE / 86400000000.0 - lag(epoch_us(ts)::DOUBLE / 86400000000.0) OVER (PARTITION BY session_id ORDER BY sample_idx) AS d FROM ev),
  md AS (SELECT session_id, quantile_cont(d, 0.5) AS median_dt FROM dt WHERE d > 0 AND d < 1 GROUP BY 1),
  smp AS (SELECT session_id, count(*) AS rows, avg((t IS NULL)::INT::DOUBLE) AS timestamp_missing_fraction, max(median_dt) AS median_dt,
    count(*) FILTER (d > median_dt * 5.0) AS timestamp_jump_count, count(*) FILTER (d < 0) AS timestamp_negative_count,
    count(*) FILTER (d = 0) AS timestamp_zero_count, arg_max(t, sample_idx) - arg_min(t, sample_idx) AS duration_from_timestamp_sec
    FROM dt LEFT JOIN md USING (session_id) GROUP BY 1),
  sam AS (SELECT *, 1.0 / median_dt AS fs_median_hz, CASE WHEN duration_from_timestamp_sec > 0 THEN (rows - 1) / duration_from_timestamp_sec END AS fs_overall_hz,
    coalesce(1.0 / median_dt, 250.0) AS fs_used_hz, rows / coalesce(1.0 / median_dt, 250.0) AS duration_from_samples_sec,
    coalesce(abs((rows - 1) / duration_from_timestamp_sec - 1.0 / median_dt) / greatest(1.0 / median_dt, 1e-9) > 0.10, false) AS rates_disagree FROM smp)"""
SAMPLING_COLS = ["median_dt", "fs_median_hz", "fs_overall_hz", "fs_used_hz", "duration_from_samples_sec", "duration_from_timestamp_sec"]


@query(f"""WITH {EV}, {SAMPLING} SELECT * REPLACE ({', '.join(f'{r(c)} AS {c}' for c in SAMPLING_COLS)}) FROM sam""")
def estimate_sampling(spark, sf):
    return rounded(au.estimate_sampling(day_samples(spark, sf), TL, "t"), SAMPLING_COLS)


LONG = "lg AS (SELECT session_id, sample_idx, label, unnest(['ch1', 'ch2', 'ch3', 'ch4']) AS channel, unnest([ch1, ch2, ch3, ch4]) AS x FROM li)"
QUALITY = f"""{LONG}, qb AS (SELECT session_id, channel, count(*) AS n, 0.0::DOUBLE AS missing_fraction,
    avg((abs(abs(x) - {RAIL}) <= {TOL})::INT::DOUBLE) AS rail_fraction, stddev_samp(x) AS centered_std, min(x) AS min_value, max(x) AS max_value,
    max(abs(x)) AS max_abs_value FROM lg GROUP BY 1, 2), qd AS (
  SELECT session_id, channel, max(c) AS top FROM (SELECT session_id, channel, x, count(*) AS c FROM lg GROUP BY 1, 2, 3) GROUP BY 1, 2), q0 AS (
  SELECT qb.*, top / n::DOUBLE AS dominant_value_fraction,
    top / n::DOUBLE >= 0.999 OR coalesce(centered_std = 0, false) OR rail_fraction >= 0.05 AS unsafe,
    rail_fraction >= 0.005 AS some_rail, max_abs_value >= {RAIL} - {TOL} AS touched
  FROM qb JOIN qd USING (session_id, channel)), q AS (
  SELECT session_id, channel, missing_fraction, rail_fraction, centered_std, min_value, max_value, max_abs_value, dominant_value_fraction,
    CASE WHEN unsafe THEN 'unsafe' WHEN some_rail OR touched THEN 'questionable' ELSE 'safe' END AS status,
    concat_ws('; ', CASE WHEN dominant_value_fraction >= 0.999 THEN printf('dominant exact value fraction %.4f', dominant_value_fraction) END,
      CASE WHEN centered_std = 0 THEN 'centered standard deviation is 0' END,
      CASE WHEN rail_fraction >= 0.05 OR (some_rail AND NOT unsafe) THEN printf('rail fraction %.4f', rail_fraction)
        WHEN touched AND NOT unsafe AND NOT some_rail THEN 'a sample touched the nominal rail' END) AS reasons
  FROM q0)"""


def quality(spark, sf):
    return au.channel_quality(item_samples(spark, sf), ITEMS_TL, CHANNELS, RAIL, TOL)


QCOLS = ["rail_fraction", "centered_std", "dominant_value_fraction"]


@query(f"WITH {LI}, {QUALITY} SELECT * REPLACE ({', '.join(f'{r(c)} AS {c}' for c in QCOLS)}) FROM q")
def channel_quality(spark, sf):
    return rounded(quality(spark, sf), QCOLS)


@query(f"""WITH {LI}, {LONG} SELECT session_id, channel, {r('stddev_samp(x)')} AS std, min(x) AS min, max(x) AS max,
  coalesce(stddev_samp(x) = 0, false) AS is_flat, max(x) >= 100 OR min(x) <= -100 AS is_railed FROM lg GROUP BY 1, 2""")
def flat_or_railed(spark, sf):
    return rounded(au.flat_or_railed(item_samples(spark, sf), ITEMS_TL, CHANNELS, 100.0), ["std"])


@query(f"""WITH {LI}, {QUALITY} SELECT session_id,
  coalesce(string_agg(channel, ', ' ORDER BY channel) FILTER (status = 'safe'), '') AS safe,
  coalesce(string_agg(channel, ', ' ORDER BY channel) FILTER (status = 'questionable'), '') AS questionable,
  coalesce(string_agg(channel, ', ' ORDER BY channel) FILTER (status = 'unsafe'), '') AS unsafe FROM q GROUP BY 1""")
def channel_status_sets(spark, sf):
    return au.channel_status_sets(quality(spark, sf), ITEMS_TL)


@query(f"""WITH {LI}, {QUALITY} SELECT channel, count(*) FILTER (status = 'unsafe') AS unsafe_sessions,
  min(session_id) FILTER (status = 'unsafe') AS first_unsafe_session, NOT bool_or(status = 'unsafe') AS selected
FROM q WHERE session_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1""")
def select_channels(spark, sf):
    train = table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("session_id"))
    return au.select_channels(quality(spark, sf), train)


@query(f"""WITH {LI}, {QUALITY} SELECT session_id, channel, row_number() OVER (PARTITION BY session_id ORDER BY channel) AS channel_order
FROM q WHERE status <> 'unsafe' QUALIFY count(*) OVER (PARTITION BY session_id) >= 2""")
def usable_channels(spark, sf):
    return au.usable_channels(quality(spark, sf), ITEMS_TL, 2)


@query(f"""WITH {LI}, {QUALITY} SELECT channel FROM q WHERE status <> 'unsafe' GROUP BY 1
HAVING count(DISTINCT session_id) = (SELECT count(DISTINCT l_suppkey) FROM lineitem)""")
def common_channels(spark, sf):
    sessions = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("session_id"))
    return au.common_channels(au.usable_channels(quality(spark, sf), ITEMS_TL), sessions)


EVQ = f"""qb AS (SELECT session_id, count(*) AS n, avg((abs(abs(value) - 200.0) <= 5.0)::INT::DOUBLE) AS rf, stddev_samp(value) AS sd, max(abs(value)) AS mx FROM ev GROUP BY 1),
  qd AS (SELECT session_id, max(c) AS top FROM (SELECT session_id, value, count(*) AS c FROM ev GROUP BY 1, 2) GROUP BY 1),
  q AS (SELECT session_id, CASE WHEN top / n::DOUBLE >= 0.999 OR coalesce(sd = 0, false) OR rf >= 0.05 THEN 'unsafe'
    WHEN rf >= 0.005 OR mx >= 195.0 THEN 'questionable' ELSE 'safe' END AS status FROM qb JOIN qd USING (session_id))"""

AUDIT = f"""{SAMPLING}, {EVQ}, au AS (
  SELECT tot.session_id, tot.total_samples, {r('sam.fs_used_hz')} AS fs_used_hz, timestamp_jump_count, rates_disagree,
    (SELECT count(*) FROM sg WHERE sg.session_id = tot.session_id AND segment_kind = 'movement1') AS movement1_count,
    (SELECT count(*) FROM sg WHERE sg.session_id = tot.session_id AND segment_kind = 'movement2') AS movement2_count,
    (SELECT count(*) FROM sg WHERE sg.session_id = tot.session_id) AS segments,
    (status = 'safe')::BIGINT AS channel_safe_count, (status = 'questionable')::BIGINT AS channel_questionable_count,
    (status = 'unsafe')::BIGINT AS channel_unsafe_count,
    (SELECT count(*) FROM mk WHERE mk.session_id = tot.session_id) AS marker_events,
    coalesce((SELECT bool_or(run_length_samples > 1) FROM mk WHERE mk.session_id = tot.session_id), false) AS persisted_markers,
    false AS unexpected_codes,
    (SELECT count(*) FROM (SELECT session_id, lag(code) OVER (PARTITION BY session_id ORDER BY start_sample) AS p, code AS c FROM mk) t
      WHERE t.session_id = tot.session_id AND p IS NOT NULL AND NOT ((p = 1 AND c = 2) OR (p = 2 AND c IN (1, 3)) OR (p = 3 AND c = 4) OR (p = 4 AND c IN (1, 3)))) AS transition_issues
  FROM tot JOIN sam USING (session_id) JOIN q USING (session_id)), audit AS (
  SELECT *, movement1_count > 0 AND movement2_count > 0 AS usable_for_audit,
    movement1_count > 0 AND movement2_count > 0 AND channel_safe_count + channel_questionable_count >= 2 AS usable_for_modeling FROM au)"""


def audit(spark, sf):
    samples = materialize(day_samples(spark, sf))
    events = iq.markers(spark, sf)
    totals = iq.totals(spark, sf)
    moves = materialize(iv.movement_intervals(events, TL))
    return au.session_audit(
        totals, au.estimate_sampling(samples, TL, "t"), au.channel_quality(samples, TL, ["value"], 200.0, 5.0),
        iv.build_segments(moves, totals, TL), events, iv.transition_issues(events, TL), TL)


@query(f"WITH {EV}, {iq.MK}, {iq.SEGMENTS}, {AUDIT} SELECT * FROM audit")
def session_audit(spark, sf):
    return rounded(audit(spark, sf), ["fs_used_hz"])


@query(f"""WITH {EV}, {iq.MK}, {iq.SEGMENTS}, {AUDIT} SELECT audit.*, c_name AS name, 6 AS columns, total_samples || 'x6' AS shape,
  CASE WHEN transition_issues > 0 THEN 'unexpected marker transitions'
    WHEN movement1_count <> 10 OR movement2_count <> 10 THEN 'movement count differs from the protocol'
    WHEN rates_disagree THEN 'sampling rates disagree' WHEN unexpected_codes THEN 'unexpected marker values'
    WHEN persisted_markers THEN 'markers persisted for several samples' ELSE '' END AS top_issue
FROM audit JOIN customer ON session_id = c_custkey""")
def inventory(spark, sf):
    catalog = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("session_id"), F.col("c_name").alias("name"), F.lit(6).alias("columns"))
    return rounded(au.inventory(audit(spark, sf), catalog, TL), ["fs_used_hz"])


DIAG_SQL = f"""WITH {LI}, {LONG}, md AS (SELECT session_id, channel, quantile_cont(x, 0.5) AS med, count(*) AS n,
    max(sample_idx) AS last FROM lg GROUP BY 1, 2), b AS (
  SELECT session_id, channel, n, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min, max(x) AS max,
    skewness(x) AS skew, coalesce(regr_slope(x, sample_idx / 250.0), 0) AS trend_slope,
    avg((abs(abs(x) - 500) < 500)::INT::DOUBLE) AS fraction_near_rail, max(abs(x)) AS ma,
    any_value(med) AS median, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr,
    quantile_cont(abs(x), 0.95) AS abs_p95, quantile_cont(abs(x), 0.99) AS abs_p99, quantile_cont(abs(x - med), 0.5) AS mad,
    quantile_cont(x, 0.5) FILTER (sample_idx < greatest(10, n // 10)) AS median_first_decile,
    quantile_cont(x, 0.5) FILTER (sample_idx > last - greatest(10, n // 10)) AS median_last_decile
  FROM lg JOIN md USING (session_id, channel) GROUP BY session_id, channel, n), ms AS (
  SELECT session_id, quantile_cont(std, 0.5) AS m FROM b GROUP BY 1)
SELECT session_id, 'raw' AS mode, channel, n, {r('mean')} AS mean, {r('std')} AS std, min, max, {r('skew')} AS skew, {r('trend_slope')} AS trend_slope,
  {r('fraction_near_rail')} AS fraction_near_rail, {r('median')} AS median, {r('iqr')} AS iqr, {r('abs_p95')} AS abs_p95, {r('abs_p99')} AS abs_p99,
  {r('mad')} AS mad, {r('median_first_decile')} AS median_first_decile, {r('median_last_decile')} AS median_last_decile,
  {r('median_last_decile - median_first_decile')} AS median_drift, ma >= 90 OR fraction_near_rail > 0.01 AS flag_suspicious_saturation,
  std < greatest(1e-6, m * 0.05) AS flag_near_constant, std > greatest(1e-6, m * 2.5) AS flag_unusually_noisy,
  abs(skew) > 2 AS flag_extreme_skew, abs(median_last_decile - median_first_decile) > greatest(std * 0.5, 1e-6) AS flag_large_drift
FROM b JOIN ms USING (session_id)"""


@query(DIAG_SQL)
def channel_diagnostics(spark, sf):
    samples = materialize(item_samples(spark, sf)).withColumn("mode", F.lit("raw"))
    out = au.channel_diagnostics(samples, ITEMS_TL, CHANNELS, "mode", F.col("sample_idx") / 250.0, rail=500.0, suspicious=90.0)
    return rounded(out, ["mean", "std", "skew", "trend_slope", "fraction_near_rail", "median", "iqr", "abs_p95", "abs_p99", "mad",
                         "median_first_decile", "median_last_decile", "median_drift"])


@query(f"""WITH {EV}, {iq.MK}, {iq.TOTALS}, g AS (SELECT *, start_sample - lag(start_sample) OVER (PARTITION BY session_id, code ORDER BY start_sample) AS gap FROM mk)
SELECT session_id, code, count(*) AS events, max(run_length_samples) AS longest_run, sum(run_length_samples)::BIGINT AS samples,
  quantile_cont(gap, 0.5) AS median_gap_samples, any_value(total_samples) AS total_samples FROM g JOIN tot USING (session_id) GROUP BY 1, 2""")
def marker_rows(spark, sf):
    return au.marker_rows(iq.markers(spark, sf), iq.totals(spark, sf), TL)


@query(f"""WITH {EV}, s AS (SELECT session_id, label, count(*) * 1000.0::DOUBLE AS d FROM (
    SELECT *, sample_idx - row_number() OVER (PARTITION BY session_id, label ORDER BY sample_idx) AS g FROM ev) GROUP BY session_id, label, g)
SELECT label, count(*) AS segments, {r('avg(d)')} AS mean_duration_ms, count(*) FILTER (d < 2000) AS shorter_than_window FROM s GROUP BY 1""")
def segment_window_check(spark, sf):
    segs = iv.rle_segments(event_samples(spark, sf), TL, "label", 1.0)
    return rounded(au.segment_window_check(segs, 2000.0), ["mean_duration_ms"])


KEYED = "SELECT CASE WHEN user_id % 10 = 3 THEN NULL WHEN user_id % 2 = 0 THEN 0 ELSE user_id END AS k, CASE WHEN user_id % 10 <> 5 THEN value END AS v FROM events"


@query(f"SELECT k, {r('quantile_cont(v, 0.5)')} AS median, {r('quantile_cont(v, 0.98)')} AS q98, {r('quantile_cont(v, 0.0)')} AS least FROM ({KEYED}) GROUP BY 1")
def quantiles_odd_keys(spark, sf):
    """Quantiles with a key that holds half of all rows, a NULL key, and keys without values."""
    u = F.col("user_id")
    key = F.when(u % 10 == 3, None).when(u % 2 == 0, 0).otherwise(u)
    rows = table(spark, sf, "events").select(key.alias("k"), F.when(u % 10 != 5, F.col("value")).alias("v"))
    return rounded(exact_quantiles(rows, ["k"], {"median": (F.col("v"), 0.5), "q98": (F.col("v"), 0.98), "least": (F.col("v"), 0.0)}), ["median", "q98", "least"])
