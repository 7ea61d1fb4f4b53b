"""Jaw event labels, evidence ladders and sequence fitting."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.intervals import paint_labels
from pulsegrid.operators.peaks import find_peaks, signal_in_spans
from pulsegrid.operators.signal import rolling_smooth
from pulsegrid.runtime import materialize
from pulsegrid.timeline import Running, Timeline, carry, exact_quantiles, in_one_chunk

# Event-label settings and the phase scores of the sequence fit.
EVENT_CONFIG = dict(
    inactive_quantile=0.90, active_quantile=0.75, min_gap=0.05, active_mix=0.35, release_mix=0.15, min_prominence=0.05,
    prominence_scale=0.25, min_distance_sec=0.35, min_active_sec=0.15, onset_sec=0.20, offset_sec=0.20,
)
PHASES = ("L1", "R1", "J1", "L2", "R2", "J2")
CLUSTER_SCORES = {"strong": (3.0, -2.5), "moderate": (1.5, -1.0), "low": (-2.0, 0.75)}
TRIAL_SCORES = {"likely jaw": (3.0, -3.0), "likely non-jaw": (-3.0, 2.0)}


def event_thresholds(
    samples: DataFrame, tl: Timeline, envelope: str, resting: Column, cfg: Mapping = EVENT_CONFIG,
    manual_active: float | None = None, manual_release: float | None = None,
) -> DataFrame:
    """Activation, release and prominence thresholds per session from resting and moving envelope quantiles."""
    q = exact_quantiles(samples, list(tl.keys), {
        "inactive_reference": (F.when(resting, F.col(envelope)), cfg["inactive_quantile"]),
        "active_reference": (F.when(~resting, F.col(envelope)), cfg["active_quantile"])})
    ref = F.col("inactive_reference")
    gap = F.greatest(F.col("active_reference") - ref, F.lit(cfg["min_gap"]))
    active = F.lit(manual_active) if manual_active is not None else ref + gap * cfg["active_mix"]
    release = F.lit(manual_release) if manual_release is not None else ref + gap * cfg["release_mix"]
    return q.withColumns({
        "reference_gap": gap, "active_threshold": active,
        "release_threshold": F.when(release >= active, ref + (active - ref) * 0.5).otherwise(release),
        "peak_prominence_threshold": F.greatest(F.lit(cfg["min_prominence"]), gap * cfg["prominence_scale"])})


def expand_peaks(peaks: DataFrame, signal: DataFrame, tl: Timeline, value: str, release: str, min_active: int) -> DataFrame:
    """Grow each peak while the envelope stays at or above release, up to the midpoints to its neighbours.

    The nearest sample below release on either side is a running window, not a walk. Short bouts are
    padded; those still too short are dropped. ``signal`` carries the release threshold.
    """
    keys, pos = list(tl.keys), tl.pos
    below = F.when(F.col(value) < F.col(release), F.col(pos))
    short = in_one_chunk(signal, tl)
    reach = carry(signal.select(*keys, pos, value, release), tl, short=short, _down=Running("last", below), _drop=Running("next", below))
    bounds = signal.groupBy(*keys).agg(F.min(pos).alias("_lo"), F.max(pos).alias("_hi"))
    linked = carry(peaks, tl, short=short, _prev=Running("lag", F.col(pos)), _next=Running("lead", F.col(pos)))
    p = linked.join(reach.select(*keys, pos, "_down", "_drop"), [*keys, pos]).join(bounds, keys)
    mid = lambda a, b, base: base + F.floor((a - base + b - base) / 2)
    left = F.coalesce(mid(F.col("_prev"), F.col(pos), F.col("_lo")) + 1, F.col("_lo"))
    right = F.coalesce(mid(F.col(pos), F.col("_next"), F.col("_lo")) - 1, F.col("_hi"))
    p = p.withColumns({"_left": left, "_right": right})
    start = F.greatest(F.col("_left"), F.least(F.col(pos), F.coalesce(F.col("_down") + 1, F.col("_left"))))
    end = F.least(F.col("_right"), F.greatest(F.col(pos), F.coalesce(F.col("_drop") - 1, F.col("_right"))))
    p = p.withColumns({"_s": F.least(start, F.col(pos)), "_e": F.greatest(end, F.col(pos))})
    size = F.col("_e") - F.col("_s") + 1
    pad = F.floor((min_active - size) / 2) + 1
    p = p.withColumns({
        "bout_start": F.when(size < min_active, F.greatest(F.col("_left"), F.col("_s") - pad)).otherwise(F.col("_s")).cast("bigint"),
        "bout_end": F.when(size < min_active, F.least(F.col("_right"), F.col("_e") + pad)).otherwise(F.col("_e")).cast("bigint")})
    return p.filter(F.col("bout_end") - F.col("bout_start") + 1 >= min_active).drop("_prev", "_next", "_down", "_drop", "_lo", "_hi", "_left", "_right", "_s", "_e")


def split_states(intervals: DataFrame, onset: int, offset: int, min_active: int, start: str = "bout_start", end: str = "bout_end") -> DataFrame:
    """Split intervals into ONSET, ACTIVE and OFFSET rows.

    Edge lengths start at their targets (at most a third of the interval) and shrink alternately, the longer
    first, until the middle has its minimum; this has a closed form. Without a middle the interval is halved. An interval
    of one sample is its own onset and its own offset: there the two rows overlap.
    """
    total = F.col(end) - F.col(start) + 1
    third = F.greatest(F.lit(1), F.floor(total / 3))
    on0, off0 = F.least(F.lit(max(1, onset)), third), F.least(F.lit(max(1, offset)), third)
    excess = F.greatest(F.lit(0), on0 + off0 + min_active - total)
    # shrinking the longer edge first levels them; the onset gives way on ties, and neither goes below 1
    diff = F.abs(on0 - off0)
    level = F.least(excess, diff)
    rest = excess - level
    on = F.greatest(F.lit(1), F.when(on0 >= off0, on0 - level).otherwise(on0) - F.ceil(rest / 2))
    off = F.greatest(F.lit(1), F.when(off0 > on0, off0 - level).otherwise(off0) - F.floor(rest / 2))
    rows = intervals.filter(total > 0).withColumns({"_on": on.cast("bigint"), "_off": off.cast("bigint"), "_n": total})
    middle = F.greatest(F.lit(0), F.col("_n") - F.col("_on") - F.col("_off"))
    halved = (middle == 0) & (F.col("_n") >= 2)
    on2 = F.when(halved, F.greatest(F.lit(1), F.floor(F.col("_n") / 2))).otherwise(F.col("_on"))
    off2 = F.when(halved, F.col("_n") - on2).otherwise(F.col("_off"))
    rows = rows.withColumns({"_a": F.col(start) + on2 - 1, "_b": F.col(end) - off2 + 1})
    piece = lambda name, lo, hi: F.struct(F.lit(name).alias("state_label"), lo.cast("bigint").alias("state_start"), hi.cast("bigint").alias("state_end"))
    pieces = F.array_compact(F.array(
        piece("ONSET", F.col(start), F.col("_a")),
        F.when(F.col("_b") > F.col("_a") + 1, piece("ACTIVE", F.col("_a") + 1, F.col("_b") - 1)),
        F.when(F.col("_b") <= F.col(end), piece("OFFSET", F.col("_b"), F.col(end)))))
    return rows.select(*intervals.columns, F.inline(pieces)).filter("state_end >= state_start")


def label_jaw_events(samples: DataFrame, segments: DataFrame, tl: Timeline, envelope: str, fs: float, cfg: Mapping = EVENT_CONFIG) -> dict[str, DataFrame]:
    """Four-state labels: holds are whole segments, repeated segments are split at their peaks.

    ``segments`` carry segment_index, label, start_sample, end_sample. Returns thresholds, intervals,
    segments and samples. A repeated segment without peaks is used as one event and marked as a fallback.
    """
    keys, pos = list(tl.keys), tl.pos
    seg = segments.select(*keys, "segment_index", F.col("label").alias("coarse_label"), "start_sample", "end_sample")
    painted = materialize(paint_labels(samples.select(*keys, pos, envelope), seg, tl, ["coarse_label", "segment_index"], "segment_index"))
    resting = F.col("coarse_label").isin("BASELINE", "REST")
    thresholds = materialize(event_thresholds(painted, tl, envelope, resting, cfg))
    length = lambda sec: max(1, round(sec * fs))
    min_active, onset, offset = length(cfg["min_active_sec"]), length(cfg["onset_sec"]), length(cfg["offset_sec"])

    # the few spans take the limits of their session to the samples
    limits = ["active_threshold", "release_threshold", "peak_prominence_threshold"]
    repeated = seg.filter("coarse_label = 'REPEATED'").join(thresholds.select(*keys, *limits), keys, "left")
    inside, at = signal_in_spans(samples.select(*keys, pos, envelope), repeated, tl, "segment_index", [envelope], limits)
    inside = materialize(inside)
    peaks = find_peaks(inside, at, envelope, F.col("active_threshold"), length(cfg["min_distance_sec"]), F.col("peak_prominence_threshold"))
    bouts = expand_peaks(materialize(peaks), inside, at, envelope, "release_threshold", min_active)
    source = lambda name: F.lit(name).alias("event_source")
    found = materialize(bouts.select(*at.keys, "bout_start", "bout_end", F.col(pos).alias("peak_sample"), "peak_value", "peak_prominence", source("repeated_peaks")))
    empty = {"peak_sample": "bigint", "peak_value": "double", "peak_prominence": "double"}
    blank = [F.lit(None).cast(t).alias(n) for n, t in empty.items()]
    whole = lambda df, name: df.select(*at.keys, F.col("start_sample").alias("bout_start"), F.col("end_sample").alias("bout_end"), *blank, source(name))
    holds = whole(seg.filter("coarse_label = 'HOLD'"), "hold_marker_edges")
    fallback = whole(seg.filter("coarse_label = 'REPEATED'").join(found, list(at.keys), "left_anti"), "repeated_coarse_fallback")
    events = holds.unionByName(found).unionByName(fallback)
    numbered = materialize(carry(events, tl.at("bout_start"), order=("segment_index",), _n=Running("sum", F.lit(1))).withColumn("event_id", F.col("_n") - 1).drop("_n"))
    intervals = split_states(numbered, onset, offset, min_active).withColumn("duration_sec", (F.col("state_end") - F.col("state_start") + 1) / fs)

    per_segment = numbered.groupBy(*at.keys).agg(
        F.count(F.lit(1)).alias("detected_event_count"), F.count("peak_sample").alias("detected_peak_count"), F.first("event_source").alias("detection_mode"))
    coarse = seg.join(per_segment, list(at.keys), "left").fillna(0, ["detected_event_count", "detected_peak_count"]).withColumns({
        "detection_mode": F.coalesce(F.col("detection_mode"), F.lit("inactive_coarse_segment")),
        "fallback_used": F.coalesce(F.col("detection_mode") == "repeated_coarse_fallback", F.lit(False))})
    spans = intervals.select(*keys, F.col("state_start").alias("start_sample"), F.col("state_end").alias("end_sample"), F.col("state_label").alias("event_label"), "event_id")
    labelled = paint_labels(painted, materialize(spans), tl, ["event_label", "event_id"], "event_id").withColumns({
        "event_label": F.coalesce(F.col("event_label"), F.lit("INACTIVE")), "event_id": F.coalesce(F.col("event_id"), F.lit(-1))})
    return {"thresholds": thresholds, "intervals": intervals, "segments": coarse, "samples": labelled}


def event_label_summary(samples: DataFrame, segments: DataFrame, tl: Timeline) -> DataFrame:
    """Samples per state, and events and fallbacks of repeated segments, per session."""
    keys = list(tl.keys)
    states = samples.groupBy(*keys).agg(*[F.count_if(F.col("event_label") == s).alias(f"samples_{s.lower()}") for s in ("INACTIVE", "ONSET", "ACTIVE", "OFFSET")])
    repeated = segments.filter("coarse_label = 'REPEATED'")
    seg = repeated.groupBy(*keys).agg(F.count(F.lit(1)).alias("repeated_segments"), F.count_if("fallback_used").alias("fallback_segments"), F.sum("detected_event_count").alias("repeated_events"))
    median = exact_quantiles(repeated, keys, {"median_events": (F.col("detected_event_count"), 0.5)})
    return states.join(seg, keys, "left").join(median, keys, "left").fillna(0, ["repeated_segments", "fallback_segments", "repeated_events"])


def reference_onsets(intervals: DataFrame, fs: float) -> DataFrame:
    """Onset rows as click references."""
    return intervals.filter("state_label = 'ONSET'").withColumns({
        "reference_onset_time_sec": F.col("state_start") / fs, "reference_interval_end_sec": F.col("state_end") / fs}).drop("state_label")


# --- evidence and sequence fits ---------------------------------------------------------------------

def probability_peaks(scores: DataFrame, tl: Timeline, probability: str, click_threshold: float, separation_ms: float, step_sec: float) -> DataFrame:
    """Peaks of the clench probability: high enough, prominent, and apart."""
    distance = max(1, round(max(separation_ms / 1000.0, 0.35) / max(step_sec, 1e-6)))
    return find_peaks(scores, tl, probability, max(0.70, click_threshold - 0.10), distance, 0.05)


def profile_peaks(profile: DataFrame, tl: Timeline, value: str) -> DataFrame:
    """Broad peaks of an average profile: 3-point smoothing, prominence of 15 % of the range."""
    smooth = materialize(rolling_smooth(profile, tl, {"_p": F.col(value)}, 3))
    span = smooth.groupBy(*tl.keys).agg(((F.max("_p") - F.min("_p")) * 0.15).alias("_need"))
    return find_peaks(smooth.join(span, list(tl.keys)), tl, "_p", prominence=F.col("_need"))


def cluster_support(clusters: DataFrame, threshold: float, ceiling: float = 0.45) -> DataFrame:
    """Evidence level per marker cluster from its best peak and its highest trace probability.

    Reads best_peak, best_peak_clicked and max_score (null when nothing was found).
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    strong = yes(F.col("best_peak") >= threshold) | yes(F.col("best_peak").isNotNull() & F.col("best_peak_clicked")) | yes(F.col("max_score") >= threshold)
    level = F.when(strong, "strong").when(F.col("best_peak").isNotNull(), "moderate").when(yes(F.col("max_score") < ceiling), "low").otherwise("ambiguous")
    return clusters.withColumn("jaw_support_level", level)


def phase_fit(clusters: DataFrame, keys: list[str], order: list[str], level: str, scores: Mapping[str, tuple[float, float]] = CLUSTER_SCORES, strict: bool = False) -> DataFrame:
    """Fit a cyclic L1 R1 J1 L2 R2 J2 sequence to the ordered clusters of each block.

    A cluster's place within its block decides its phase under each of the six rotations, so a block is
    scored by counts per place modulo six: six numbers per level, whatever its length. Accepted if the best
    score is positive, leads by 3 and has a strong jaw slot; ``strict`` asks for four clusters, a lead of 3
    and full agreement instead.
    """
    at = Timeline(tuple(keys), order[0])
    placed = carry(clusters, at, order=tuple(order[1:]), _n=Running("sum", F.lit(1))).withColumn("_slot", (F.col("_n") - 1) % 6)
    tally = placed.groupBy(*keys, "_slot", level).agg(F.count(F.lit(1)).alias("_c"))
    rotated = tally.select("*", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("offset")).withColumn("_jaw", ((F.col("_slot") + F.col("offset")) % 6).isin(2, 5))
    worth, agrees = F.lit(0.0), F.lit(False)
    for name, (jaw, other) in scores.items():
        worth = F.when(F.col(level) == name, F.when(F.col("_jaw"), jaw).otherwise(other)).otherwise(worth)
        agrees = agrees | ((F.col(level) == name) & (F.lit(jaw > 0) == F.col("_jaw")))
    best_level = next(iter(scores))
    total = rotated.groupBy(*keys, "offset").agg(
        F.sum(worth * F.col("_c")).alias("score"), F.sum(F.when(F.col("_jaw") & (F.col(level) == best_level), F.col("_c")).otherwise(0)).alias("strong_jaw_slots"),
        F.bool_and(agrees).alias("_consistent"), F.sum("_c").alias("_clusters"))
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "offset")
    top = total.withColumns({"runner_up": F.lead("score").over(w), "_rn": F.row_number().over(w)}).filter("_rn = 1")
    lead = F.col("score") >= F.col("runner_up") + 3.0
    if strict:
        ok = (F.col("_clusters") >= 4) & lead & F.col("_consistent")
    else:
        ok = (F.col("score") > 0) & lead & (F.col("strong_jaw_slots") >= 1)
    fit = top.select(*keys, F.col("offset").alias("best_offset"), F.col("score").alias("best_score"), "runner_up", ok.alias("phase_fit_accepted"))
    names = F.array(*[F.lit(p) for p in PHASES])
    phase = F.get(names, ((F.col("_slot") + F.col("best_offset")) % 6).cast("int"))
    return placed.join(fit, keys).withColumn("phase_suggestion", F.when(F.col("phase_fit_accepted"), phase)).drop("_n", "_slot")


def suggest_cluster_label(clusters: DataFrame) -> DataFrame:
    """Conservative label per cluster from evidence and an accepted phase."""
    level, phase = F.col("jaw_support_level"), F.col("phase_suggestion")
    jaw = phase.isin("J1", "J2")
    label = (
        F.when((level == "strong") & F.coalesce(jaw, F.lit(False)), F.concat(F.lit("likely "), phase))
        .when(level.isin("strong", "moderate"), "likely jaw")
        .when((level == "low") & F.coalesce(~jaw, F.lit(False)), "likely non-jaw").otherwise("unknown"))
    return clusters.withColumn("suggested_label", label)


def trial_evidence(trials: DataFrame, jaw_trace: float = 0.80, ceiling: float = 0.45) -> DataFrame:
    """Jaw, non-jaw or unknown per trial. Reads peak_count and max_score."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    jaw = (F.col("peak_count") >= 1) | yes(F.col("max_score") >= jaw_trace)
    return trials.withColumn("jaw_label", F.when(jaw, "likely jaw").when(yes(F.col("max_score") < ceiling), "non-jaw").otherwise("unknown"))


def cluster_interpretation(
    clusters: DataFrame, real_score: float = 0.70, jaw_trace: float = 0.80, ceiling: float = 0.45, min_gap_sec: float = 0.35
) -> DataFrame:
    """Is a cluster real, is it jaw, and how many clenches does it hold?

    Reads marker_count, peak_count, jaw_like_peaks, qualifying_peaks, min_peak_gap_sec and max_score.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    real = (F.col("marker_count") >= 2) | (F.col("peak_count") >= 1) | yes(F.col("max_score") >= real_score)
    jaw = (F.col("jaw_like_peaks") >= 1) | yes(F.col("max_score") >= jaw_trace)
    quiet = real & (F.col("peak_count") == 0) & yes(F.col("max_score") < ceiling)
    close = yes(F.col("min_peak_gap_sec") < min_gap_sec)
    sure = ~close & F.col("qualifying_peaks").isin(1, 2)
    return clusters.withColumns({
        "likely_real_cluster": real, "jaw_vs_nonjaw_label": F.when(jaw, "likely jaw").when(quiet, "likely non-jaw").otherwise("unknown"),
        "clench_count_guess": F.when(sure, F.col("qualifying_peaks").cast("string")).otherwise("unknown")})


def attach_sequence(events: DataFrame, clusters: DataFrame, keys: list[str]) -> DataFrame:
    """Give peaks the accepted jaw phase of their cluster."""
    accepted = clusters.filter(F.col("phase_fit_accepted") & F.col("phase_suggestion").isin("J1", "J2")).select(
        *keys, "cluster_id", F.col("phase_suggestion").alias("suggested_sequence_position"))
    return events.join(accepted, [*keys, "cluster_id"], "left")


def jaw_type_heuristic(count: str = "detected_event_count") -> Column:
    """More than one detected event means a repeated clench."""
    return F.when(F.col(count) > 1, "REPEATED").otherwise("HOLD")
