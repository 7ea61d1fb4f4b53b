"""Peak, event-label and evidence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.operators import events as ev
from pulsegrid.operators import filters as fl
from pulsegrid.operators import intervals as iv
from pulsegrid.operators import peaks as pk
from pulsegrid.operators import signal as sg
from pulsegrid.runtime import materialize
from pulsegrid.timeline import Timeline, range_join
from workload import intervals_q as iq
from workload import signal_q as sq
from workload import windows_q as wq
from workload.base import CHANNELS, EV, EVENTS_TL, ITEMS_TL, LI, event_samples, item_samples, peaks_sql, r, rounded, table
from workload.registry import query

BIG = Timeline()

# runs of equal values, their neighbours, and the middle of each run that is higher than both
LM = """rn AS (SELECT session_id, value, min(sample_idx) AS s, max(sample_idx) AS e FROM (SELECT *, sum(ch) OVER (PARTITION BY session_id ORDER BY sample_idx) AS g FROM (
    SELECT *, (value IS DISTINCT FROM lag(value) OVER (PARTITION BY session_id ORDER BY sample_idx))::INT AS ch FROM ev)) GROUP BY session_id, value, g),
  lm AS (SELECT session_id, (s + e) // 2 AS sample_idx, value AS peak_value FROM (SELECT *, lag(value) OVER w AS pv, lead(value) OVER w AS nv FROM rn WINDOW w AS (PARTITION BY session_id ORDER BY s)) WHERE value > pv AND value > nv)"""


@query(f"WITH {EV}, {LM} SELECT * FROM lm")
def local_maxima(spark, sf):
    return pk.local_maxima(event_samples(spark, sf), EVENTS_TL, "value")


PROM = """lo AS (SELECT lm.session_id, lm.sample_idx, peak_value, coalesce(max(CASE WHEN e.sample_idx < lm.sample_idx AND e.value > peak_value THEN e.sample_idx END), -1) AS l,
    coalesce(min(CASE WHEN e.sample_idx > lm.sample_idx AND e.value > peak_value THEN e.sample_idx END), 1e9::BIGINT) AS rr FROM lm JOIN ev e USING (session_id) GROUP BY 1, 2, 3),
  pm AS (SELECT lo.session_id, lo.sample_idx, peak_value, peak_value - greatest(min(e.value) FILTER (e.sample_idx > l AND e.sample_idx <= lo.sample_idx), min(e.value) FILTER (e.sample_idx < rr AND e.sample_idx >= lo.sample_idx)) AS prominence
    FROM lo JOIN ev e USING (session_id) GROUP BY 1, 2, 3)"""
PROM = PROM.replace("lm JOIN ev e USING (session_id)", "lm JOIN ev e ON e.session_id = lm.session_id").replace("lo JOIN ev e USING (session_id)", "lo JOIN ev e ON e.session_id = lo.session_id")


@query(f"WITH {EV}, {LM}, {PROM} SELECT session_id, sample_idx, peak_value, {r('prominence')} AS peak_prominence FROM pm WHERE peak_value >= 20 AND prominence >= 15")
def find_peaks(spark, sf):
    samples = materialize(event_samples(spark, sf).select("session_id", "sample_idx", "value"))
    return rounded(pk.find_peaks(samples, BIG, "value", height=20.0, prominence=15.0), ["peak_prominence"])


@query(f"""WITH RECURSIVE {EV}, {peaks_sql('pk', 'ev', 'session_id', 'sample_idx', 'value', '10.0', 4)} SELECT session_id, sample_idx, v AS peak_value, {r('prom')} AS peak_prominence FROM pk WHERE prom >= 5.0""")
def find_peaks_apart(spark, sf):
    """Peaks with a minimum distance; also checked against a brute-force greedy in the tests."""
    samples = materialize(event_samples(spark, sf).select("session_id", "sample_idx", "value"))
    return rounded(pk.find_peaks(samples, BIG, "value", height=10.0, distance=4, prominence=5.0), ["peak_prominence"])


def envelope(spark, sf):
    return sg.with_envelope(item_samples(spark, sf).select("session_id", "sample_idx", *CHANNELS), ITEMS_TL, CHANNELS, 8)


THR = f"""pt AS (SELECT en.session_id, sample_idx, aggregate_rms_smooth, sl.label AS coarse_label FROM en JOIN sl ON en.session_id = sl.session_id AND sample_idx BETWEEN start_sample AND end_sample),
  q AS (SELECT session_id, quantile_cont(aggregate_rms_smooth, 0.9) FILTER (coarse_label = 'REST') AS i, quantile_cont(aggregate_rms_smooth, 0.75) FILTER (coarse_label <> 'REST') AS a FROM pt GROUP BY 1),
  g AS (SELECT *, greatest(a - i, 0.05) AS gap FROM q)"""
TCOLS = ["inactive_reference", "active_reference", "reference_gap", "active_threshold", "release_threshold", "peak_prominence_threshold"]


@query(f"""WITH {LI}, {sq.ENV}, {wq.SEGL}, {THR} SELECT session_id, {r('i')} AS inactive_reference, {r('a')} AS active_reference, {r('gap')} AS reference_gap, {r('i + 0.35 * gap')} AS active_threshold,
  {r('i + 0.15 * gap')} AS release_threshold, {r('greatest(0.05, 0.25 * gap)')} AS peak_prominence_threshold FROM g""")
def event_thresholds(spark, sf):
    samples, segments = wq.blocks(spark, sf)
    env = sg.with_envelope(samples, ITEMS_TL, CHANNELS, 8)
    spans = materialize(segments).withColumnRenamed("label", "coarse_label")
    painted = iv.paint_labels(env, spans, ITEMS_TL, ["coarse_label", "segment_index"], "segment_index")
    return rounded(ev.event_thresholds(materialize(painted), ITEMS_TL, "aggregate_rms_smooth", F.col("coarse_label") == "REST"), TCOLS)


def jaw_bundle(spark, sf):
    samples, segments = wq.blocks(spark, sf)
    jaw = F.when(F.col("label") == "LEFT", "HOLD").when(F.col("label") == "RIGHT", "REPEATED").otherwise("REST")
    env = materialize(sg.with_envelope(samples, ITEMS_TL, CHANNELS, 8))
    return ev.label_jaw_events(env, materialize(segments.withColumn("label", jaw)), BIG, "aggregate_rms_smooth", 20.0)


@query()
def label_jaw_events(spark, sf):
    return jaw_bundle(spark, sf)["intervals"]


@query()
def jaw_event_samples(spark, sf):
    return jaw_bundle(spark, sf)["samples"]


@query()
def event_label_summary(spark, sf):
    b = jaw_bundle(spark, sf)
    return ev.event_label_summary(b["samples"], b["segments"], BIG)


@query()
def reference_onsets(spark, sf):
    return ev.reference_onsets(jaw_bundle(spark, sf)["intervals"], 20.0)


@query(f"""WITH RECURSIVE {EV}, {iq.MK}, {iq.SEGMENTS}, b AS (SELECT session_id, segment_index, start_sample AS s, end_sample AS e, end_sample - start_sample + 1 AS n,
    least(4, greatest(1, (end_sample - start_sample + 1) // 3)) AS o0, least(3, greatest(1, (end_sample - start_sample + 1) // 3)) AS f0 FROM sg),
  sh AS (SELECT session_id, segment_index, n, o0 AS o, f0 AS f FROM b UNION ALL
    SELECT session_id, segment_index, n, CASE WHEN o >= f AND o > 1 THEN o - 1 ELSE o END, CASE WHEN NOT (o >= f AND o > 1) AND f > 1 THEN f - 1 ELSE f END FROM sh WHERE o + f + 2 > n AND (o > 1 OR f > 1)),
  fi AS (SELECT session_id, segment_index, arg_min(o, o + f) AS o, arg_min(f, o + f) AS f FROM sh GROUP BY 1, 2),
  z AS (SELECT b.session_id, b.segment_index, s, e, n, CASE WHEN n - o - f <= 0 AND n >= 2 THEN greatest(1, n // 2) ELSE o END AS o, CASE WHEN n - o - f <= 0 AND n >= 2 THEN n - greatest(1, n // 2) ELSE f END AS f FROM b JOIN fi USING (session_id, segment_index)),
  p AS (SELECT session_id, segment_index, 'ONSET' AS state_label, s AS state_start, s + o - 1 AS state_end FROM z
    UNION ALL SELECT session_id, segment_index, 'ACTIVE', s + o, e - f FROM z WHERE e - f + 1 > s + o - 1 + 1 UNION ALL SELECT session_id, segment_index, 'OFFSET', e - f + 1, e FROM z WHERE e - f + 1 <= e)
SELECT * FROM p WHERE state_end >= state_start""")
def split_states(spark, sf):
    return ev.split_states(iq.segments(spark, sf), 4, 3, 2, "start_sample", "end_sample").select("session_id", "segment_index", "state_label", "state_start", "state_end")


def counted(spark, sf):
    samples, segments = wq.blocks(spark, sf)
    env = materialize(sg.with_envelope(samples, ITEMS_TL, CHANNELS, 8).select("session_id", "sample_idx", "aggregate_rms"))
    trials = materialize(segments.filter("label <> 'REST'").withColumn("trial_id", F.col("segment_index")).withColumn("expected_count", F.col("segment_index") % 4 + 1))
    return env, trials, pk.count_peaks_in_spans(env, trials, BIG, "trial_id", "aggregate_rms", 10.0, smoothing=5, distance_sec=0.5)


# candidates of every trial in SQL: the trace is smoothed inside the trial, then searched there
SMOOTH5 = "avg(aggregate_rms) OVER (PARTITION BY {k} ORDER BY sample_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
CANDS = f"""{LI}, {sq.ENV}, {wq.SEGL}, tl AS (SELECT session_id, label, start_sample, end_sample, segment_index, segment_index AS trial_id, segment_index % 4 + 1 AS expected_count FROM sl WHERE label <> 'REST'),
  ts AS (SELECT tl.session_id, trial_id, sample_idx, {SMOOTH5.format(k='tl.session_id, trial_id')} AS x FROM tl JOIN en ON en.session_id = tl.session_id AND sample_idx BETWEEN start_sample AND end_sample),
  {peaks_sql('tp', 'ts', 'session_id, trial_id', 'sample_idx', 'x', None, 5)},
  nd AS (SELECT session_id, trial_id, greatest(stddev_pop(x) * 0.6, 0.02) AS need FROM ts GROUP BY 1, 2),
  cd AS (SELECT tp.*, need, tl.start_sample, sample_idx / 10.0 AS at_sec, (sample_idx - tl.start_sample) / 10.0 AS rel, (sample_idx - tl.start_sample) / 10.0 >= 0.1 AS kept FROM tp JOIN nd USING (session_id, trial_id) JOIN tl USING (session_id, trial_id) WHERE prom >= need),
  tc AS (SELECT tl.*, coalesce(o, 0) AS observed_count, coalesce(n, 0) AS candidates FROM tl LEFT JOIN (SELECT session_id, trial_id, count(*) FILTER (kept) AS o, count(*) AS n FROM cd GROUP BY 1, 2) USING (session_id, trial_id))"""
TRIAL = "session_id, label, start_sample, end_sample, segment_index, trial_id, expected_count, observed_count, candidates, observed_count - expected_count AS count_error, observed_count = expected_count AS count_match"


@query(f"""WITH RECURSIVE {CANDS} SELECT session_id, trial_id, sample_idx, {r('v')} AS peak_value, {r('prom')} AS peak_prominence, {r('need')} AS prominence_threshold, start_sample, {r('at_sec')} AS peak_time_sec,
  {r('rel')} AS peak_time_relative_sec, kept AS kept_for_count FROM cd""")
def trial_peak_candidates(spark, sf):
    return rounded(counted(spark, sf)[2], ["peak_value", "peak_prominence", "prominence_threshold", "peak_time_sec", "peak_time_relative_sec"])


@query(f"WITH RECURSIVE {CANDS} SELECT {TRIAL} FROM tc")
def trial_counts(spark, sf):
    _, trials, cands = counted(spark, sf)
    return pk.trial_counts(trials, cands, BIG, "trial_id")


@query(f"""WITH RECURSIVE {CANDS}, bs AS (SELECT session_id, trial_id, least(expected_count, o) AS constrained_count FROM (SELECT session_id, trial_id, count(*) AS o FROM cd WHERE kept GROUP BY 1, 2) JOIN tl USING (session_id, trial_id))
SELECT {TRIAL}, coalesce(constrained_count, 0) AS constrained_count, observed_count AS unconstrained_count, observed_count - expected_count AS unconstrained_error, observed_count = expected_count AS unconstrained_exact,
  coalesce(constrained_count, 0) - expected_count AS constrained_error, coalesce(constrained_count, 0) = expected_count AS constrained_exact FROM tc LEFT JOIN bs USING (session_id, trial_id)""")
def constrained_decode(spark, sf):
    _, trials, cands = counted(spark, sf)
    cands = materialize(cands)
    return pk.decode_rows(pk.trial_counts(trials, cands, BIG, "trial_id"), pk.constrained_decode(trials, cands, BIG, "trial_id"), BIG, "trial_id")


@query(f"""WITH RECURSIVE {CANDS}, os AS (SELECT session_id, sample_idx, {SMOOTH5.format(k='session_id')} AS x FROM en), {peaks_sql('op', 'os', 'session_id', 'sample_idx', 'x', None, 5)},
  od AS (SELECT session_id, greatest(stddev_pop(x) * 0.6, 0.02) AS need, min(sample_idx) AS s FROM os GROUP BY 1),
  bo AS (SELECT session_id, sample_idx, trial_id AS block_id, v, prom, kept, at_sec, true AS inside FROM cd UNION ALL
    SELECT op.session_id, sample_idx, NULL, v, prom, (sample_idx - s) / 10.0 >= 0.1, sample_idx / 10.0, false FROM op JOIN od USING (session_id) WHERE prom >= need
      AND NOT EXISTS (SELECT 1 FROM tl WHERE tl.session_id = op.session_id AND op.sample_idx BETWEEN tl.start_sample AND tl.end_sample))
SELECT session_id, sample_idx, block_id, {r('v')} AS peak_value, {r('prom')} AS peak_prominence, kept AS kept_for_count, {r('at_sec')} AS peak_time_sec, inside AS inside_marker_block,
  row_number() OVER (PARTITION BY session_id ORDER BY sample_idx, block_id NULLS FIRST) AS event_id FROM bo""")
def detect_in_blocks(spark, sf):
    env, trials, _ = counted(spark, sf)
    blocks = trials.select("session_id", F.col("trial_id").alias("block_id"), "start_sample", "end_sample")
    return rounded(pk.detect_in_blocks(env, blocks, BIG, "aggregate_rms", 10.0, 5, 0.5), ["peak_value", "peak_prominence", "peak_time_sec"])


@query(f"""WITH RECURSIVE {CANDS}, tr AS (SELECT tl.session_id, trial_id, max(aggregate_rms) AS mx, avg(aggregate_rms) AS mn FROM tl JOIN en ON en.session_id = tl.session_id AND sample_idx BETWEEN start_sample AND end_sample GROUP BY 1, 2)
SELECT session_id, label, start_sample, end_sample, segment_index, trial_id, expected_count, {r('mx')} AS max_trace_value, {r('mn')} AS mean_trace_value, observed_count AS detected_event_count FROM tc JOIN tr USING (session_id, trial_id)""")
def block_counts(spark, sf):
    env, trials, cands = counted(spark, sf)
    return rounded(pk.block_counts(trials, cands, env, BIG, "trial_id", "aggregate_rms"), ["max_trace_value", "mean_trace_value"])


@query(f"""WITH RECURSIVE {EV}, sc AS (SELECT session_id, sample_idx, value / (value + 5.0) AS p FROM ev), {peaks_sql('pk', 'sc', 'session_id', 'sample_idx', 'p', '0.8::DOUBLE - 0.1::DOUBLE', 4)}
SELECT session_id, sample_idx, {r('v')} AS peak_value, {r('prom')} AS peak_prominence FROM pk WHERE prom >= 0.05::DOUBLE""")
def probability_peaks(spark, sf):
    scores = event_samples(spark, sf).select("session_id", "sample_idx", (F.col("value") / (F.col("value") + 5.0)).alias("p"))
    return rounded(ev.probability_peaks(materialize(scores), BIG, "p", 0.80, 450.0, 0.1), ["peak_value", "peak_prominence"])


@query(f"""{sq.PROFILE.replace('WITH ', 'WITH RECURSIVE ', 1)}, sm AS (SELECT 0 AS session_id, point, avg(m) OVER (ORDER BY point ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS x FROM pr), {peaks_sql('pk', 'sm', 'session_id', 'point', 'x')}
SELECT session_id, point, {r('v')} AS peak_value, {r('prom')} AS peak_prominence FROM pk WHERE prom >= (SELECT (max(x) - min(x)) * 0.15 FROM sm)""")
def profile_peaks(spark, sf):
    prof = materialize(sq.profile(spark, sf)).withColumn("session_id", F.lit(0))
    return rounded(ev.profile_peaks(prof, BIG.at("point"), "aggregate_rms_mean"), ["peak_value", "peak_prominence"])


SUP = f"""{iq.CLUSTERS}, cx AS (SELECT cl.session_id, cluster_id, any_value(block_id) AS block_id, min(start_sample) AS c_start, count(*) AS marker_count, max(value / (value + 30.0)) AS max_score,
    max(CASE WHEN label IN ('click', 'error') THEN value / (value + 30.0) END) AS best_peak, max(value) > 300 AS best_peak_clicked
  FROM cl JOIN ev ON ev.session_id = cl.session_id AND ev.sample_idx BETWEEN start_sample AND end_sample GROUP BY 1, 2),
  lv AS (SELECT *, CASE WHEN coalesce(best_peak >= 0.75, false) OR coalesce(best_peak IS NOT NULL AND best_peak_clicked, false) OR coalesce(max_score >= 0.75, false) THEN 'strong'
    WHEN best_peak IS NOT NULL THEN 'moderate' WHEN coalesce(max_score < 0.45, false) THEN 'low' ELSE 'ambiguous' END AS jaw_support_level FROM cx)"""


def supported(spark, sf):
    spans = iq.clusters(spark, sf).select("session_id", "cluster_id", "block_id", F.col("start_sample").alias("m_start"), F.col("end_sample").alias("m_end"))
    score = F.col("value") / (F.col("value") + 30.0)
    rows = range_join(event_samples(spark, sf), spans, ["session_id"], "sample_idx", "m_start", "m_end", 32)
    c = rows.groupBy("session_id", "cluster_id").agg(
        F.min("block_id").alias("block_id"), F.min("m_start").alias("c_start"), F.count_distinct("m_start").alias("marker_count"), F.max(score).alias("max_score"),
        F.max(F.when(F.col("label").isin("click", "error"), score)).alias("best_peak"), (F.max("value") > 300).alias("best_peak_clicked"))
    return materialize(ev.cluster_support(c, 0.75))


@query(f"WITH {EV}, {iq.MK}, {SUP} SELECT session_id, cluster_id, block_id, c_start, max_score, best_peak, best_peak_clicked, jaw_support_level FROM lv")
def cluster_support(spark, sf):
    return supported(spark, sf).drop("marker_count")


def fit_sql(level, jaw_best, table_):
    jaw = " ".join(f"WHEN lev = '{n}' THEN CASE WHEN jw THEN {a} ELSE {b} END" for n, (a, b) in table_.items())
    return f"""sl0 AS (SELECT *, (row_number() OVER (PARTITION BY session_id, grp ORDER BY c_start, cluster_id) - 1) AS slot, {level} AS lev FROM src),
  rt AS (SELECT sl0.*, off, ((slot + off) % 6) IN (2, 5) AS jw FROM sl0, (SELECT unnest(range(6)) AS off)),
  sc AS (SELECT session_id, grp, off, sum(CASE {jaw} ELSE 0.0 END)::DOUBLE AS score, count(*) FILTER (jw AND lev = '{jaw_best}') AS sj FROM rt GROUP BY 1, 2, 3),
  tp AS (SELECT *, lead(score) OVER (PARTITION BY session_id, grp ORDER BY score DESC, off) AS runner_up, row_number() OVER (PARTITION BY session_id, grp ORDER BY score DESC, off) AS rn FROM sc)"""


@query(f"""WITH {EV}, {iq.MK}, {SUP}, src AS (SELECT session_id, 1 AS grp, cluster_id, c_start, jaw_support_level FROM lv), {fit_sql('jaw_support_level', 'strong', ev.CLUSTER_SCORES)},
  f AS (SELECT session_id, off AS best_offset, score AS best_score, runner_up, score > 0 AND score >= runner_up + 3 AND sj >= 1 AS phase_fit_accepted FROM tp WHERE rn = 1),
  o AS (SELECT sl0.session_id, cluster_id, c_start, jaw_support_level, best_offset, best_score, runner_up, phase_fit_accepted,
    CASE WHEN phase_fit_accepted THEN ['L1', 'R1', 'J1', 'L2', 'R2', 'J2'][((slot + best_offset) % 6) + 1] END AS phase_suggestion FROM sl0 JOIN f USING (session_id))
SELECT *, CASE WHEN jaw_support_level = 'strong' AND coalesce(phase_suggestion IN ('J1', 'J2'), false) THEN 'likely ' || phase_suggestion WHEN jaw_support_level IN ('strong', 'moderate') THEN 'likely jaw'
  WHEN jaw_support_level = 'low' AND coalesce(phase_suggestion NOT IN ('J1', 'J2'), false) THEN 'likely non-jaw' ELSE 'unknown' END AS suggested_label FROM o""")
def cyclic_phase_fit(spark, sf):
    c = supported(spark, sf).select("session_id", "cluster_id", "c_start", "jaw_support_level")
    return ev.suggest_cluster_label(ev.phase_fit(c, ["session_id"], ["c_start", "cluster_id"], "jaw_support_level"))


LIKELY = "CASE jaw_support_level WHEN 'strong' THEN 'likely jaw' WHEN 'low' THEN 'likely non-jaw' ELSE 'unknown' END"


@query(f"""WITH {EV}, {iq.MK}, {SUP}, src AS (SELECT session_id, block_id AS grp, cluster_id, c_start, {LIKELY} AS jaw_vs_nonjaw_label FROM lv), {fit_sql('jaw_vs_nonjaw_label', 'likely jaw', ev.TRIAL_SCORES)},
  cs AS (SELECT session_id, grp, off, count(*) AS n, bool_and(lev = 'unknown' OR (lev = 'likely jaw') = jw) AS fits FROM rt GROUP BY 1, 2, 3),
  f AS (SELECT tp.session_id, tp.grp, tp.off AS best_offset, tp.score AS best_score, runner_up, n >= 4 AND tp.score >= runner_up + 3 AND fits AS ok FROM tp JOIN cs ON cs.session_id = tp.session_id AND cs.grp IS NOT DISTINCT FROM tp.grp AND cs.off = tp.off WHERE rn = 1)
SELECT sl0.session_id, cluster_id, sl0.grp AS block_id, c_start, jaw_vs_nonjaw_label, best_offset, best_score, runner_up, ok AS phase_fit_accepted, CASE WHEN ok THEN ['L1', 'R1', 'J1', 'L2', 'R2', 'J2'][((slot + best_offset) % 6) + 1] END AS phase_suggestion
FROM sl0 JOIN f ON f.session_id = sl0.session_id AND f.grp IS NOT DISTINCT FROM sl0.grp""")
def cyclic_phase_fit_strict(spark, sf):
    label = F.when(F.col("jaw_support_level") == "strong", "likely jaw").when(F.col("jaw_support_level") == "low", "likely non-jaw").otherwise("unknown")
    c = supported(spark, sf).select("session_id", "cluster_id", "block_id", "c_start", label.alias("jaw_vs_nonjaw_label"))
    return ev.phase_fit(c, ["session_id", "block_id"], ["c_start", "cluster_id"], "jaw_vs_nonjaw_label", ev.TRIAL_SCORES, strict=True)


@query(f"""WITH {EV}, {iq.MK}, {SUP}, src AS (SELECT session_id, 1 AS grp, cluster_id, c_start, jaw_support_level FROM lv), {fit_sql('jaw_support_level', 'strong', ev.CLUSTER_SCORES)},
  f AS (SELECT session_id, off AS o, score > 0 AND score >= runner_up + 3 AND sj >= 1 AS ok FROM tp WHERE rn = 1)
SELECT sl0.session_id, cluster_id, c_start, CASE WHEN ok AND ((slot + o) % 6) IN (2, 5) THEN ['L1', 'R1', 'J1', 'L2', 'R2', 'J2'][((slot + o) % 6) + 1] END AS suggested_sequence_position FROM sl0 JOIN f USING (session_id)""")
def sequence_positions(spark, sf):
    c = supported(spark, sf).select("session_id", "cluster_id", "c_start", "jaw_support_level")
    fit = ev.phase_fit(c, ["session_id"], ["c_start", "cluster_id"], "jaw_support_level")
    return ev.attach_sequence(c.drop("jaw_support_level"), fit, ["session_id"])


@query("""WITH t AS (SELECT user_id AS session_id, event_type AS trial_id, count(*) FILTER (value > 120) AS peak_count, max(value / (value + 60.0)) AS max_score FROM events GROUP BY 1, 2)
SELECT *, CASE WHEN peak_count >= 1 OR max_score >= 0.8 THEN 'likely jaw' WHEN max_score < 0.45 THEN 'non-jaw' ELSE 'unknown' END AS jaw_label FROM t""")
def trial_evidence(spark, sf):
    t = table(spark, sf, "events").groupBy(F.col("user_id").alias("session_id"), F.col("event_type").alias("trial_id")).agg(
        F.count_if(F.col("value") > 120).alias("peak_count"), F.max(F.col("value") / (F.col("value") + 60.0)).alias("max_score"))
    return ev.trial_evidence(t)


@query("""WITH t AS (SELECT user_id AS session_id, event_type AS cluster_id, count(*) AS marker_count, count(*) FILTER (value > 90) AS peak_count, count(*) FILTER (value > 130) AS jaw_like_peaks, count(*) FILTER (value > 110) AS qualifying_peaks,
    min(value) AS min_peak_gap_sec, max(value / (value + 60.0)) AS max_score FROM events GROUP BY 1, 2)
SELECT *, marker_count >= 2 OR peak_count >= 1 OR max_score >= 0.7 AS likely_real_cluster, CASE WHEN jaw_like_peaks >= 1 OR max_score >= 0.8 THEN 'likely jaw'
  WHEN (marker_count >= 2 OR peak_count >= 1 OR max_score >= 0.7) AND peak_count = 0 AND max_score < 0.45 THEN 'likely non-jaw' ELSE 'unknown' END AS jaw_vs_nonjaw_label,
  CASE WHEN NOT min_peak_gap_sec < 0.35 AND qualifying_peaks IN (1, 2) THEN qualifying_peaks::VARCHAR ELSE 'unknown' END AS clench_count_guess FROM t""")
def cluster_interpretation(spark, sf):
    v = F.col("value")
    t = table(spark, sf, "events").groupBy(F.col("user_id").alias("session_id"), F.col("event_type").alias("cluster_id")).agg(
        F.count(F.lit(1)).alias("marker_count"), F.count_if(v > 90).alias("peak_count"), F.count_if(v > 130).alias("jaw_like_peaks"),
        F.count_if(v > 110).alias("qualifying_peaks"), F.min(v).alias("min_peak_gap_sec"), F.max(v / (v + 60.0)).alias("max_score"))
    return ev.cluster_interpretation(t)


@query("SELECT user_id AS session_id, count(*) AS n, CASE WHEN count(*) FILTER (value > 150) > 1 THEN 'REPEATED' ELSE 'HOLD' END AS predicted FROM events GROUP BY 1")
def jaw_type_heuristic(spark, sf):
    t = table(spark, sf, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 150).alias("detected_event_count"))
    return t.select("session_id", "n", ev.jaw_type_heuristic().alias("predicted"))


# --- recursive filters: no SQL form, checked against a plain recursion in the tests ------------------

def centred(spark, sf):
    return sg.center_and_scale(materialize(item_samples(spark, sf).select("session_id", "sample_idx", *CHANNELS)), ITEMS_TL, CHANNELS)


@query()
def bandpass_left_right(spark, sf):
    return fl.zero_phase_filter(centred(spark, sf), BIG, CHANNELS, fl.family_filter("left_right", 250.0))


@query()
def bandpass_jaw_sections(spark, sf):
    return fl.zero_phase_filter(centred(spark, sf), BIG, CHANNELS, fl.FilterSpec(20.0, 100.0, 250.0, order=4, sections=True))


@query()
def bandpass_per_trial(spark, sf):
    samples, segments = wq.blocks(spark, sf)
    inside, at = pk.signal_in_spans(samples, segments, ITEMS_TL, "segment_index", CHANNELS)
    return fl.zero_phase_filter(inside.drop("start_sample"), Timeline(at.keys), CHANNELS, fl.trial_filter(250.0))


@query()
def count_signals(spark, sf):
    """Filtered, aggregated and smoothed envelopes of both recording families."""
    base = materialize(centred(spark, sf))
    out = None
    for family in ("left_right", "jaw"):
        filtered = fl.zero_phase_filter(base, BIG, CHANNELS, fl.family_filter(family, 250.0))
        env = sg.with_envelope(filtered, BIG, CHANNELS, 75).select("session_id", "sample_idx", F.lit(family).alias("family"), "aggregate_rms", "aggregate_rms_smooth")
        out = env if out is None else out.unionByName(env)
    return out
