"""Joins of events, intervals and windows in time."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.timeline import Running, Timeline, carry, range_join


def first_span(points: DataFrame, spans: DataFrame, keys: Sequence[str], point_id: str, at: str, start: str, end: str,
               order: str, width: float) -> DataFrame:
    """Attach to each point the first span (by ``order``) that contains it, or nulls."""
    hits = range_join(points, spans, keys, at, start, end, width, "left")
    w = Window.partitionBy(*keys, point_id).orderBy(F.col(order).asc_nulls_last())
    return hits.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def events_to_blocks(events: DataFrame, blocks: DataFrame, keys: Sequence[str], event_id: str, at: str, width: float) -> DataFrame:
    """Assign events to marker blocks and say whether they fall inside one."""
    out = first_span(events, blocks, keys, event_id, at, "block_start", "block_end", "block_id", width)
    return out.withColumn("inside_marker_block", F.col("block_id").isNotNull())


def ground_truth_at(points: DataFrame, segments: DataFrame, keys: Sequence[str], point_id: str, at: str, start: str, end: str,
                    order: str, label: str, width: float) -> DataFrame:
    """State at a time from labelled segments, UNKNOWN outside; the first segment wins."""
    out = first_span(points, segments, keys, point_id, at, start, end, order, width)
    return out.withColumn(label, F.coalesce(F.col(label), F.lit("UNKNOWN"))).drop(start, end, order)


def windows_in_trial(windows: DataFrame, trials: DataFrame, keys: Sequence[str], width: float, eps: float = 1e-9) -> DataFrame:
    """Summarise the model windows that lie wholly inside each trial.

    Windows carry w_start, w_end, p_active, gate_active, lr_pred; trials carry trial_id, t_start, t_end, hand.
    The majority label breaks ties by first appearance.
    """
    padded = trials.withColumns({"_lo": F.col("t_start") - eps, "_hi": F.col("t_end") + eps})
    inside = range_join(windows, padded, keys, "w_start", "_lo", "_hi", width).filter(F.col("w_end") <= F.col("_hi"))
    per_label = inside.groupBy(*keys, "trial_id", "lr_pred").agg(
        F.count(F.lit(1)).alias("_votes"), F.min("w_start").alias("_first"),
        F.sum("p_active").alias("_p"), F.sum(F.col("gate_active").cast("double")).alias("_g"))
    rank = F.struct("_votes", -F.col("_first"))
    trial = per_label.groupBy(*keys, "trial_id").agg(
        F.sum("_votes").alias("windows"), (F.sum("_p") / F.sum("_votes")).alias("mean_p_active"),
        (F.sum("_g") / F.sum("_votes")).alias("active_window_fraction"),
        F.max_by("lr_pred", rank).alias("majority_pred"), (F.max("_votes") / F.sum("_votes")).alias("majority_vote_fraction"))
    out = trials.join(trial, [*keys, "trial_id"], "left")
    return out.withColumns({
        "windows": F.coalesce(F.col("windows"), F.lit(0)), "majority_pred": F.coalesce(F.col("majority_pred"), F.lit("unknown")),
        "hand_mismatch": F.coalesce(F.col("majority_pred") != F.col("hand"), F.lit(False))})


def nearest(points: DataFrame, marks: DataFrame, tl: Timeline, point_id: str, at: str, mark_at: str, values: Sequence[str]) -> DataFrame:
    """As-of join in both directions: the nearest mark of the same key, the earlier one on ties.

    Adds ``values``, ``nearest_at`` and the signed ``nearest_delta`` (point minus mark). Points and marks
    are merged into one timeline, so no point ever meets every mark.
    """
    keys = list(tl.keys)
    payload = F.struct(F.col(mark_at).cast("double").alias("at"), *values)
    rows = points.select(*keys, F.col(at).cast("double").alias("_pos"), F.lit(1).alias("_kind"), F.col(point_id).alias("_id"),
                         F.lit(None).cast(marks.select(payload.alias("p")).schema["p"].dataType).alias("_mark"))
    from_marks = marks.select(*keys, F.col(mark_at).cast("double").alias("_pos"), F.lit(0).alias("_kind"),
                              F.lit(None).cast(points.schema[point_id].dataType).alias("_id"), payload.alias("_mark"))
    both = carry(rows.unionByName(from_marks), tl.at("_pos"), order=("_kind", "_id"),
                 _before=Running("last", F.col("_mark")), _after=Running("next", F.col("_mark"))).filter("_kind = 1")
    to_before, to_after = F.col("_pos") - F.col("_before.at"), F.col("_after.at") - F.col("_pos")
    pick = F.when(F.col("_after").isNull() | (to_before <= to_after), F.col("_before")).otherwise(F.col("_after"))
    chosen = both.withColumn("_pick", pick).select(
        *keys, F.col("_id").alias(point_id), F.col("_pick.at").alias("nearest_at"),
        (F.col("_pos") - F.col("_pick.at")).alias("nearest_delta"), *[F.col(f"_pick.{v}").alias(v) for v in values])
    return points.join(chosen, [*keys, point_id], "left")


def project_scores(windows: DataFrame, gates: DataFrame, tl: Timeline, window_id: str, width: float) -> DataFrame:
    """Gate score per direction window: the largest of the gate windows that hold its centre, else the nearest gate's.

    Windows carry ``center``; gates carry g_start, g_end, g_center, p_active.
    """
    keys = list(tl.keys)
    inside = range_join(windows.select(*keys, window_id, "center"), gates, keys, "center", "g_start", "g_end", width)
    best = inside.groupBy(*keys, window_id).agg(F.max("p_active").alias("_inside"))
    near = nearest(windows, gates.select(*keys, "g_center", F.col("p_active").alias("_near")), tl, window_id, "center", "g_center", ["_near"])
    return near.join(best, [*keys, window_id], "left").withColumns({
        "projected_p_active": F.coalesce(F.col("_inside"), F.col("_near")), "used_nearest": F.col("_inside").isNull(),
    }).drop("_inside", "_near", "nearest_at", "nearest_delta")


def assign_clusters(peaks: DataFrame, clusters: DataFrame, tl: Timeline, peak_id: str, at: str, padding: float, width: float) -> DataFrame:
    """Relate peaks to padded marker clusters: aligned, after the last marker, or unanchored.

    Clusters carry cluster_id, block_id, c_start, c_end, are disjoint and numbered in time order.
    """
    keys = list(tl.keys)
    padded = clusters.withColumns({"_lo": F.col("c_start") - padding, "_hi": F.col("c_end") + padding})
    spans = padded.select(*keys, "cluster_id", "block_id", "_lo", "_hi")
    hit = first_span(peaks, spans, keys, peak_id, at, "_lo", "_hi", "cluster_id", width).drop("_lo", "_hi")
    starts = nearest(peaks.select(*keys, peak_id, at), padded.select(*keys, "_lo"), tl, peak_id, at, "_lo", [])
    ends = nearest(peaks.select(*keys, peak_id, at), padded.select(*keys, "_hi"), tl, peak_id, at, "_hi", [])
    gap = starts.select(*keys, peak_id, F.abs("nearest_delta").alias("_a")).join(
        ends.select(*keys, peak_id, F.abs("nearest_delta").alias("_b")), [*keys, peak_id])
    last = clusters.groupBy(*keys).agg(F.max("c_end").alias("_last"))
    out = hit.join(gap, [*keys, peak_id]).join(last, keys, "left")
    aligned = F.col("cluster_id").isNotNull()
    return out.withColumns({
        "cluster_anchor_status": F.when(aligned, "cluster_aligned").when(F.col(at) > F.col("_last") + padding, "post_marker_tail").otherwise("unanchored"),
        "cluster_distance": F.when(aligned, F.lit(0.0)).otherwise(F.least("_a", "_b")),
    }).drop("_a", "_b", "_last")


def nearby_triggers(peaks: DataFrame, clicks: DataFrame, keys: Sequence[str], peak_id: str, at: str, click_at: str, radius: float) -> DataFrame:
    """Clicks within ``radius`` of each peak: whether, how many, and their times in order."""
    # the spans are a little wider, the distance decides: at - radius is rounded and may pass a click that is exactly that far
    reach = F.lit(radius) * (1 + 1e-6) + F.abs(at) * 1e-15
    spans = peaks.select(*keys, peak_id, F.col(at).alias("_peak"), (F.col(at) - reach).alias("_lo"), (F.col(at) + reach).alias("_hi"))
    hits = range_join(clicks.select(*keys, click_at), spans, keys, click_at, "_lo", "_hi", 2 * radius).where(F.abs(F.col(click_at) - F.col("_peak")) <= radius)
    agg = hits.groupBy(*keys, peak_id).agg(
        F.count(F.lit(1)).alias("trigger_count_nearby"), F.sort_array(F.collect_list(F.round(F.col(click_at) * 1e6) / 1e6)).alias("_times"))
    out = peaks.join(agg, [*keys, peak_id], "left")
    # plain digits, also below a thousandth and above ten millions, where Spark would write an exponent
    plain = lambda t: F.regexp_replace(t.cast("decimal(38,6)").cast("string"), r"(\.\d)(\d*?)0*$", "$1$2")
    times = F.concat(F.lit("["), F.array_join(F.transform("_times", plain), ","), F.lit("]"))
    return out.withColumns({
        "trigger_count_nearby": F.coalesce(F.col("trigger_count_nearby"), F.lit(0)),
        "trigger_nearby": F.col("trigger_count_nearby").isNotNull(),
        "trigger_times": F.coalesce(times, F.lit("[]"))}).drop("_times")


def support_window(clusters: DataFrame, scores: DataFrame, keys: Sequence[str], padding: float, width: float) -> DataFrame:
    """Best score and click count inside each padded cluster. Scores carry s_at, score, clicked."""
    padded = clusters.withColumns({"_lo": F.col("c_start") - padding, "_hi": F.col("c_end") + padding})
    inside = range_join(scores, padded, keys, "s_at", "_lo", "_hi", width)
    agg = inside.groupBy(*keys, "cluster_id").agg(
        F.max("score").alias("max_score"), F.max_by("s_at", F.struct("score", -F.col("s_at"))).alias("best_at"),
        F.sum(F.col("clicked").cast("bigint")).alias("trigger_click_count"))
    return clusters.join(agg, [*keys, "cluster_id"], "left").fillna(0, ["trigger_click_count"])


def phase_rows(trace: DataFrame, steps: DataFrame, keys: Sequence[str], at: str, width: float) -> DataFrame:
    """Control-trace rows inside each protocol step (steps carry step_id, step_label, step_start, step_end)."""
    return range_join(trace, steps, keys, at, "step_start", "step_end", width).drop("step_start", "step_end")


def prompt_outcomes(prompts: DataFrame, detections: DataFrame, keys: Sequence[str], timeout: float) -> DataFrame:
    """First correct detection within each prompt, wrong detections before it, and the timeout flag.

    Prompts carry prompt_id, target, p_start; detections carry d_at, d_class.
    """
    spans = prompts.withColumn("_end", F.col("p_start") + timeout)
    hits = range_join(detections, spans, keys, "d_at", "p_start", "_end", timeout)
    ok = F.col("d_class") == F.col("target")
    first = F.min(F.when(ok, F.col("d_at"))).over(Window.partitionBy(*keys, "prompt_id"))
    agg = hits.withColumn("_first", first).groupBy(*keys, "prompt_id").agg(
        F.max("_first").alias("success_time"),
        F.count_if(~ok & (F.col("_first").isNull() | (F.col("d_at") < F.col("_first")))).alias("wrong_detections_count"))
    out = prompts.join(agg, [*keys, "prompt_id"], "left").fillna(0, ["wrong_detections_count"])
    return out.withColumns({
        "success": F.col("success_time").isNotNull(), "latency": F.col("success_time") - F.col("p_start"),
        "end_time": F.coalesce(F.col("success_time"), F.col("p_start") + timeout), "timeout_flag": F.col("success_time").isNull()})


def ordered_pairs(catalog: DataFrame, names: Sequence, key: str = "session_id") -> DataFrame:
    """All train/test permutations of a short, caller-given list of sessions that exist in the catalog."""
    others = {a: [b for x, b in permutations(names, 2) if x == a] for a in names}
    partner = None
    for a, bs in others.items():
        arr = F.array(*[F.lit(b) for b in bs])
        partner = F.when(F.col(key) == a, arr) if partner is None else partner.when(F.col(key) == a, arr)
    known = catalog.select(key).filter(F.col(key).isin(*names)).distinct()
    return known.select(F.col(key).alias("train_session"), F.explode(partner).alias("test_session")).join(
        known.select(F.col(key).alias("test_session")), "test_session", "left_semi").select("train_session", "test_session")
