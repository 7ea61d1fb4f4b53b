"""Marker, run and interval queries over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.operators import intervals as iv
from pulsegrid.runtime import materialize
from workload.base import EV, EVENTS_TL as TL, FS, MK, event_samples, r, rounded
from workload.registry import query

WITH = f"WITH {EV}, {MK}"
TOTALS = "tot AS (SELECT session_id, count(*) AS total_samples, 1.0::DOUBLE AS fs_hz FROM ev GROUP BY 1)"


def markers(spark, sf):
    return materialize(iv.collapse_markers(event_samples(spark, sf), TL))


def totals(spark, sf):
    return event_samples(spark, sf).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("total_samples"), F.lit(FS).alias("fs_hz")
    )


def paired_sql(name, a, b):
    """SQL CTE: intervals from the last start code to the start of the next end code."""
    return f"""{name} AS (
  SELECT session_id, ps AS start_sample, start_sample AS end_sample, pe AS start_event_end_sample,
    end_sample AS end_event_end_sample
  FROM (SELECT *, lag(code) OVER w AS pc, lag(start_sample) OVER w AS ps, lag(end_sample) OVER w AS pe
        FROM mk WHERE code IN ({a}, {b}) WINDOW w AS (PARTITION BY session_id ORDER BY start_sample))
  WHERE code = {b} AND pc = {a})"""


MOVES = (
    paired_sql("p12", 1, 2) + ", " + paired_sql("p34", 3, 4) + """, mv AS (
  SELECT session_id, 'LEFT' AS label, 'movement1' AS segment_kind, 'marker_1_to_2' AS segment_source,
    start_sample, end_sample FROM p12
  UNION ALL SELECT session_id, 'RIGHT', 'movement2', 'marker_3_to_4', start_sample, end_sample FROM p34)"""
)

SEGMENTS = f"""{MOVES}, {TOTALS}, lk AS (
  SELECT mv.*, total_samples, fs_hz, lead(start_sample) OVER w AS ns, lead(segment_kind) OVER w AS nk,
    row_number() OVER w AS rn
  FROM mv JOIN tot USING (session_id)
  WINDOW w AS (PARTITION BY session_id ORDER BY start_sample, end_sample, segment_kind)), raw AS (
  SELECT session_id, fs_hz, 'BASELINE' AS label, 'baseline' AS segment_kind,
    'inferred_pre_first_active_gap' AS segment_source, 'start_to_first_active' AS segment_context,
    0 AS start_sample, start_sample - 1 AS end_sample, 45.0::DOUBLE AS expected_duration_sec
  FROM lk WHERE rn = 1 AND start_sample > 0
  UNION ALL SELECT session_id, fs_hz, label, segment_kind, segment_source, NULL, start_sample, end_sample, 8.0 FROM lk
  UNION ALL SELECT session_id, fs_hz, 'REST', 'rest', 'inferred_between_active_gaps',
    segment_kind || '_to_' || coalesce(nk, 'end_of_recording'), end_sample + 1,
    coalesce(ns, total_samples) - 1,
    CASE WHEN segment_kind = 'movement1' AND nk = 'movement2' THEN 5.0
         WHEN segment_kind = 'movement2' AND nk = 'movement1' THEN 15.0 END
  FROM lk WHERE coalesce(ns, total_samples) - 1 >= end_sample + 1
  UNION ALL SELECT session_id, fs_hz, 'BASELINE', 'baseline', 'inferred_no_active_markers', 'full_recording',
    0, total_samples - 1, NULL FROM tot WHERE session_id NOT IN (SELECT session_id FROM mv)), sg AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY start_sample, end_sample, segment_kind) - 1 AS segment_index,
    start_sample / fs_hz AS start_time_sec, end_sample / fs_hz AS end_time_sec,
    (end_sample - start_sample + 1) / fs_hz AS duration_sec,
    (end_sample - start_sample + 1) / fs_hz - expected_duration_sec AS duration_error_sec
  FROM raw)"""


def segments(spark, sf):
    moves = materialize(iv.movement_intervals(markers(spark, sf), TL))
    return materialize(iv.build_segments(moves, totals(spark, sf), TL))


@query(f"{WITH} SELECT * FROM mk")
def collapse_markers(spark, sf):
    return iv.collapse_markers(event_samples(spark, sf), TL)


@query(f"""WITH {EV} SELECT session_id, label, min(sample_idx) AS start_idx, max(sample_idx) AS end_idx,
  count(*) / 1.0 * 1000 AS duration_ms
FROM (SELECT *, sample_idx - row_number() OVER (PARTITION BY session_id, label ORDER BY sample_idx) AS g FROM ev)
GROUP BY session_id, label, g""")
def rle_segments(spark, sf):
    return iv.rle_segments(event_samples(spark, sf), TL, "label", FS)


@query(f"""WITH {EV}, lab AS (SELECT session_id, sample_idx, CASE label WHEN 'view' THEN 'REST' WHEN 'error' THEN 'UNKNOWN'
    ELSE 'MOVE' END AS label FROM ev), seg AS (
  SELECT session_id, label, min(sample_idx) AS s, max(sample_idx) AS e, count(*) * 1000.0 AS d
  FROM (SELECT *, sample_idx - row_number() OVER (PARTITION BY session_id, label ORDER BY sample_idx) AS g FROM lab)
  GROUP BY session_id, label, g)
SELECT session_id, label, s AS start_idx, e AS end_idx, d::DOUBLE AS duration_ms, s AS orig_start, e AS orig_end
FROM seg WHERE label = 'REST' AND d >= 2000
UNION ALL SELECT session_id, label, s + 1, e - 1, ((e - 1 - (s + 1) + 1) * 1000.0)::DOUBLE, s, e
FROM seg WHERE label = 'MOVE' AND e - 1 > s + 1""")
def trim_segments(spark, sf):
    lab = F.when(F.col("label") == "view", "REST").when(F.col("label") == "error", "UNKNOWN").otherwise("MOVE")
    samples = event_samples(spark, sf).withColumn("label", lab)
    segs = iv.rle_segments(samples, TL, "label", FS)
    return iv.trim_segments(segs, FS, trim_start_ms=1000, trim_end_ms=1000, min_rest_ms=2000)


@query(f"{WITH}, {paired_sql('p', 1, 2)} SELECT * FROM p")
def pair_start_end(spark, sf):
    return iv.pair_start_end(markers(spark, sf), TL, 1, 2)


@query(f"""{WITH}, st AS (
  SELECT *, lag(code) OVER w AS pc, lag(start_sample) OVER w AS ps, lead(code) OVER w AS nc FROM mk WHERE code IN (1, 2)
  WINDOW w AS (PARTITION BY session_id ORDER BY start_sample))
SELECT session_id, 1 AS start_code, 2 AS end_code, 'reappeared' AS issue, ps AS at_sample FROM st WHERE code = 1 AND pc = 1
UNION ALL SELECT session_id, 1, 2, 'unmatched_end', start_sample FROM st WHERE code = 2 AND pc IS DISTINCT FROM 1
UNION ALL SELECT session_id, 1, 2, 'never_closed', start_sample FROM st WHERE code = 1 AND nc IS NULL""")
def pairing_issues(spark, sf):
    return iv.pairing_issues(markers(spark, sf), TL, 1, 2)


@query(f"""WITH {EV}, t AS (
  SELECT session_id, sample_idx, marker, sum((marker = 2)::INT) OVER (PARTITION BY session_id ORDER BY sample_idx)
    - (marker = 2)::INT AS island FROM ev WHERE marker IN (1, 2))
SELECT session_id, min(sample_idx) FILTER (marker = 1) AS start_sample, max(sample_idx) FILTER (marker = 2) AS end_sample
FROM t GROUP BY session_id, island
HAVING start_sample IS NOT NULL AND end_sample IS NOT NULL""")
def pair_first_start(spark, sf):
    return iv.pair_first_start(event_samples(spark, sf), TL, 1, 2)


@query(f"""{WITH}, o AS (SELECT *, row_number() OVER (PARTITION BY session_id, code ORDER BY start_sample) AS rn FROM mk)
SELECT session_id, code, CAST(ceil(rn / 2.0) AS BIGINT) AS pair_index, min(start_sample) AS start_sample,
  max(start_sample) AS end_sample FROM o GROUP BY 1, 2, 3 HAVING count(*) = 2""")
def pair_same_code(spark, sf):
    return iv.pair_same_code(markers(spark, sf), TL)


@query(f"""{WITH} SELECT session_id, code, start_sample, end_sample, run_length_samples,
  row_number() OVER (PARTITION BY session_id ORDER BY start_sample) AS event_id,
  (start_sample - lag(start_sample) OVER (PARTITION BY session_id ORDER BY start_sample)) / 1.0::DOUBLE AS gap_from_previous_sec,
  row_number() OVER (PARTITION BY session_id, code ORDER BY start_sample) AS occurrence_index,
  CAST(ceil(row_number() OVER (PARTITION BY session_id, code ORDER BY start_sample) / 2.0) AS BIGINT) AS pair_index,
  CASE WHEN row_number() OVER (PARTITION BY session_id, code ORDER BY start_sample) % 2 = 1 THEN 'start' ELSE 'end' END AS pair_role
FROM mk""")
def code_occurrences(spark, sf):
    return iv.code_occurrences(markers(spark, sf), TL, FS)


@query(f"{WITH} SELECT session_id, code, count(*) AS pulses FROM mk GROUP BY 1, 2 HAVING count(*) % 2 = 1")
def odd_code_counts(spark, sf):
    return iv.odd_code_counts(markers(spark, sf), TL)


CONSECUTIVE = """pc AS (
  SELECT session_id, start_sample, lead(start_sample) OVER w AS end_sample,
    (lead(start_sample) OVER w - start_sample) / 1.0::DOUBLE AS duration_sec,
    code || '->' || lead(code) OVER w AS marker_pair_type,
    (lead(start_sample) OVER w - start_sample) BETWEEN 1.5 AND 3.5 AS accepted
  FROM mk WINDOW w AS (PARTITION BY session_id ORDER BY start_sample)
  QUALIFY lead(start_sample) OVER w IS NOT NULL)"""


@query(f"{WITH}, {CONSECUTIVE} SELECT * FROM pc")
def pair_consecutive(spark, sf):
    return iv.pair_consecutive(markers(spark, sf), TL, FS)


@query(f"""{WITH}, {CONSECUTIVE} SELECT session_id, count(*) AS candidate_pairs, count(*) FILTER (accepted) AS valid_trials,
  count(*) FILTER (NOT accepted) AS duration_rejected_pairs FROM pc GROUP BY 1""")
def pair_consecutive_stats(spark, sf):
    return iv.pair_consecutive_stats(iv.pair_consecutive(markers(spark, sf), TL, FS), TL)


@query(f"""{WITH}, {MOVES}, {TOTALS}, lk AS (
  SELECT mv.session_id, start_sample, end_sample, total_samples, lag(end_sample) OVER w AS pe, lead(start_sample) OVER w AS ns
  FROM mv JOIN tot USING (session_id)
  WINDOW w AS (PARTITION BY session_id ORDER BY start_sample, end_sample))
SELECT session_id, CASE WHEN pe IS NULL THEN 0 ELSE least(total_samples - 1, pe + 1) + 1 END AS start_sample, greatest(0, start_sample - 1) - 1 AS end_sample
FROM lk WHERE greatest(0, start_sample - 1) > CASE WHEN pe IS NULL THEN 0 ELSE least(total_samples - 1, pe + 1) + 1 END
UNION ALL SELECT session_id, least(total_samples - 1, end_sample + 1) + 1, total_samples - 1
FROM lk WHERE ns IS NULL AND least(total_samples - 1, end_sample + 1) + 1 < total_samples
UNION ALL SELECT session_id, 0, total_samples - 1 FROM tot WHERE session_id NOT IN (SELECT session_id FROM mv)""")
def complement_intervals(spark, sf):
    moves = iv.movement_intervals(markers(spark, sf), TL)
    return iv.complement_intervals(moves, totals(spark, sf), TL, buffer=1)


@query(f"""{WITH}, {MOVES}, {TOTALS}, lk AS (
  SELECT mv.session_id, start_sample, end_sample, total_samples, lag(end_sample) OVER w AS pe, lead(start_sample) OVER w AS ns
  FROM mv JOIN tot USING (session_id)
  WINDOW w AS (PARTITION BY session_id ORDER BY start_sample, end_sample))
SELECT session_id, coalesce(pe + 1, 0) AS start_sample, start_sample - 1 AS end_sample
FROM lk WHERE start_sample - 1 > coalesce(pe + 1, 0)
UNION ALL SELECT session_id, end_sample + 1, total_samples - 1 FROM lk WHERE ns IS NULL AND end_sample + 1 < total_samples
UNION ALL SELECT session_id, 0, total_samples - 1 FROM tot WHERE session_id NOT IN (SELECT session_id FROM mv)""")
def complement_intervals_notebook(spark, sf):
    moves = iv.movement_intervals(markers(spark, sf), TL)
    return iv.complement_intervals(moves, totals(spark, sf), TL, buffer=1, style="notebook")


@query(f"{WITH}, {SEGMENTS} SELECT * FROM sg")
def build_segments(spark, sf):
    return segments(spark, sf)


@query(f"""{WITH}, {MOVES} SELECT * FROM (
  SELECT session_id, lag(segment_kind) OVER w AS previous_kind, lag(end_sample) OVER w AS previous_end, segment_kind, start_sample
  FROM mv WINDOW w AS (PARTITION BY session_id ORDER BY start_sample, end_sample, segment_kind))
WHERE start_sample <= previous_end""")
def overlap_issues(spark, sf):
    return iv.overlap_issues(iv.movement_intervals(markers(spark, sf), TL), TL)


@query(f"""{WITH}, s AS (SELECT session_id, lag(code) OVER w AS from_code, code AS to_code, row_number() OVER w - 1 AS from_event
  FROM mk WINDOW w AS (PARTITION BY session_id ORDER BY start_sample))
SELECT session_id, from_event, from_code, to_code FROM s WHERE from_code IS NOT NULL AND NOT (
  (from_code = 1 AND to_code = 2) OR (from_code = 2 AND to_code IN (1, 3)) OR (from_code = 3 AND to_code = 4)
  OR (from_code = 4 AND to_code IN (1, 3)))""")
def transition_issues(spark, sf):
    return iv.transition_issues(markers(spark, sf), TL)


@query(f"""{WITH}, {SEGMENTS} SELECT session_id, segment_kind, count(*) AS count, min(duration_sec) AS min_duration_sec,
  max(duration_sec) AS max_duration_sec, quantile_cont(duration_sec, 0.5) AS median_duration_sec FROM sg GROUP BY 1, 2""")
def protocol_summary(spark, sf):
    return iv.protocol_summary(segments(spark, sf), TL)


@query(f"""{WITH}, {SEGMENTS}, g AS (SELECT session_id, CASE WHEN segment_kind = 'rest' THEN segment_context ELSE segment_kind END AS grp,
    quantile_cont(duration_sec, 0.5) AS m FROM sg GROUP BY 1, 2)
SELECT session_id, grp || '_duration' AS issue, m AS observed FROM g WHERE
  (grp = 'baseline' AND abs(m - 45) > 10) OR (grp IN ('movement1', 'movement2') AND abs(m - 8) > 2)
  OR (grp = 'movement1_to_movement2' AND abs(m - 5) > 3) OR (grp = 'movement2_to_movement1' AND abs(m - 15) > 3)
UNION ALL SELECT session_id, k || '_count', n FROM (
  SELECT session_id, k, (SELECT count(*) FROM sg WHERE sg.session_id = tot.session_id AND sg.segment_kind = k)::DOUBLE AS n
  FROM tot CROSS JOIN (VALUES ('movement1'), ('movement2')) v(k)) WHERE n <> 10""")
def protocol_issues(spark, sf):
    return iv.protocol_issues(segments(spark, sf), totals(spark, sf), TL)


@query(f"WITH {EV} SELECT session_id, marker AS code, count(*) AS samples FROM ev GROUP BY 1, 2")
def marker_counts(spark, sf):
    return iv.marker_counts(event_samples(spark, sf), TL)


TRIALS = """pr AS (
  SELECT session_id, code, CAST(ceil(rn / 2.0) AS BIGINT) AS k, min(start_sample) AS start_sample, max(start_sample) AS end_sample
  FROM (SELECT *, row_number() OVER (PARTITION BY session_id, code ORDER BY start_sample) AS rn FROM mk WHERE code IN (1, 2, 3))
  GROUP BY 1, 2, 3 HAVING count(*) = 2), tr AS (
  SELECT session_id, code, k AS trial_index_within_label, start_sample, end_sample,
    row_number() OVER w AS trial_index_overall,
    CASE code WHEN 1 THEN 'LEFT' WHEN 2 THEN 'RIGHT' ELSE 'JAW' END AS label, k AS expected_count,
    start_sample / 1.0::DOUBLE AS start_time_sec, end_sample / 1.0::DOUBLE AS end_time_sec,
    (end_sample - start_sample) / 1.0::DOUBLE AS duration_sec,
    (start_sample - lag(end_sample) OVER w) / 1.0::DOUBLE AS gap_from_previous_trial_sec,
    coalesce(start_sample <= lag(end_sample) OVER w, false) AS overlaps_previous
  FROM pr WINDOW w AS (PARTITION BY session_id ORDER BY start_sample, end_sample, code))"""


def trials(spark, sf):
    return iv.reconstruct_trials(markers(spark, sf), TL, FS)


@query(f"{WITH}, {TRIALS} SELECT * FROM tr")
def reconstruct_trials(spark, sf):
    return trials(spark, sf)


@query(f"""{WITH}, {TRIALS}, b AS (SELECT *, lag(code) OVER (PARTITION BY session_id ORDER BY start_sample) AS pc FROM mk WHERE code IN (1, 2, 3)), f AS (
  SELECT session_id, 'hard' AS severity, 'block_order' AS rule, count(*) FILTER (pc IS DISTINCT FROM code
    AND NOT coalesce(code = pc + 1, code = 1)) + 3 - count(DISTINCT code) AS hits FROM b GROUP BY 1
  UNION ALL SELECT session_id, 'hard', 'pulse_count_left', abs(count(*) FILTER (code = 1) - 12) FROM b GROUP BY 1
  UNION ALL SELECT session_id, 'hard', 'pulse_count_right', abs(count(*) FILTER (code = 2) - 12) FROM b GROUP BY 1
  UNION ALL SELECT session_id, 'hard', 'pulse_count_jaw', abs(count(*) FILTER (code = 3) - 12) FROM b GROUP BY 1
  UNION ALL SELECT session_id, 'hard', 'odd_pulses_left', count(*) FILTER (code = 1) % 2 FROM b GROUP BY 1
  UNION ALL SELECT session_id, 'hard', 'odd_pulses_right', count(*) FILTER (code = 2) % 2 FROM b GROUP BY 1
  UNION ALL SELECT session_id, 'hard', 'odd_pulses_jaw', count(*) FILTER (code = 3) % 2 FROM b GROUP BY 1
  UNION ALL SELECT session_id, 'hard', 'overlap', count(*) FILTER (overlaps_previous) FROM tr GROUP BY 1
  UNION ALL SELECT session_id, 'hard', 'interval_count_left', abs(count(*) FILTER (label = 'LEFT') - 6) FROM tr GROUP BY 1
  UNION ALL SELECT session_id, 'hard', 'interval_count_right', abs(count(*) FILTER (label = 'RIGHT') - 6) FROM tr GROUP BY 1
  UNION ALL SELECT session_id, 'hard', 'interval_count_jaw', abs(count(*) FILTER (label = 'JAW') - 6) FROM tr GROUP BY 1
  UNION ALL SELECT session_id, 'soft', 'short_trial', count(*) FILTER (duration_sec < 1) FROM tr GROUP BY 1
  UNION ALL SELECT session_id, 'soft', 'long_trial', count(*) FILTER (duration_sec > 15) FROM tr GROUP BY 1
  UNION ALL SELECT session_id, 'soft', 'unusual_gap', count(*) FILTER (gap_from_previous_trial_sec < 0.25 OR gap_from_previous_trial_sec > 20) FROM tr GROUP BY 1
  UNION ALL SELECT session_id, 'hard', 'unexpected_code', count(*) FILTER (code NOT IN (1, 2, 3)) FROM mk GROUP BY 1
  UNION ALL SELECT session_id, 'soft', 'persisted_marker', count(*) FILTER (run_length_samples > 1) FROM mk GROUP BY 1)
SELECT * FROM f WHERE hits > 0""")
def trial_checks(spark, sf):
    events = markers(spark, sf)
    return iv.trial_checks(events, iv.reconstruct_trials(events, TL, FS), TL)


CLUSTERS = """g AS (SELECT *, start_sample / 1.0::DOUBLE AS time_sec, row_number() OVER w AS event_id,
    (start_sample - lag(start_sample) OVER w) / 1.0::DOUBLE AS gap_from_previous_sec
  FROM mk WINDOW w AS (PARTITION BY session_id ORDER BY start_sample)), cl AS (
  SELECT *, 1 + sum(coalesce((gap_from_previous_sec > 1.5)::INT, 0)) OVER (PARTITION BY session_id ORDER BY start_sample)::BIGINT AS cluster_id,
    1 + sum(coalesce((gap_from_previous_sec > 2.5)::INT, 0)) OVER (PARTITION BY session_id ORDER BY start_sample)::BIGINT AS block_id
  FROM g)"""


def clusters(spark, sf):
    return materialize(iv.gap_clusters(markers(spark, sf), TL, FS, 1.5, 2.5))


@query(f"{WITH}, {CLUSTERS} SELECT * FROM cl")
def gap_clusters(spark, sf):
    return clusters(spark, sf)


@query(f"""{WITH}, {CLUSTERS} SELECT session_id, cluster_id, block_id, min(start_sample) AS cluster_start_sample,
  max(start_sample) AS cluster_end_sample, min(time_sec) AS cluster_start_time_sec, max(time_sec) AS cluster_end_time_sec,
  count(*) AS marker_count FROM cl GROUP BY 1, 2, 3""")
def cluster_index(spark, sf):
    return iv.cluster_index(clusters(spark, sf), TL)


@query(f"""{WITH}, {CLUSTERS} SELECT session_id, cluster_id, block_id, code,
  row_number() OVER (PARTITION BY session_id, cluster_id, block_id ORDER BY start_sample) AS ordinal FROM cl""")
def cluster_codes(spark, sf):
    return iv.cluster_codes(clusters(spark, sf), TL)


@query(f"""{WITH}, {SEGMENTS} SELECT ev.session_id, ev.sample_idx, ev.value, sg.label AS segment_label, sg.segment_index
FROM ev LEFT JOIN sg ON ev.session_id = sg.session_id AND ev.sample_idx BETWEEN sg.start_sample AND sg.end_sample
QUALIFY row_number() OVER (PARTITION BY ev.session_id, ev.sample_idx ORDER BY sg.segment_index DESC) = 1""")
def paint_labels(spark, sf):
    spans = segments(spark, sf).select(
        "session_id", "start_sample", "end_sample", F.col("label").alias("segment_label"), "segment_index"
    )
    samples = event_samples(spark, sf).select("session_id", "sample_idx", "value")
    return iv.paint_labels(samples, spans, TL, ["segment_label", "segment_index"], "segment_index")


@query(f"""{WITH}, {SEGMENTS} SELECT label, segment_kind, count(*) AS segments, sum(duration_sec) AS total_duration_sec
FROM sg GROUP BY 1, 2""")
def segment_totals(spark, sf):
    return iv.segment_totals(segments(spark, sf), ["label", "segment_kind"])
