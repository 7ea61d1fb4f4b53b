"""Sliding, tiled and event-centred windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.timeline import Running, Timeline, attach, carry, exact_quantiles, range_join


def window_samples(seconds: float, fs: float) -> int:
    return max(1, round(seconds * fs))


def hop_samples(length: int, overlap: float) -> int:
    return max(1, round(length * (1.0 - overlap)))


def _starts(length: int, hop: int, style: str) -> Column:
    """Array of window starts inside [start_sample, end_sample]."""
    start, end = F.col("start_sample"), F.col("end_sample")
    last = {"closed": end - length + 1, "half_open": end - length, "fallback": end - length + 1}[style]
    full = F.when(last >= start, F.sequence(start, F.greatest(start, last), F.lit(hop).cast("bigint")))
    if style == "fallback":
        return F.coalesce(full, F.array(start))
    return full


def segment_windows(segments: DataFrame, length: int, hop: int, style: str = "closed") -> DataFrame:
    """Windows of each segment as rows with ``window_start`` and ``window_end``.

    ``closed``: windows inside inclusive bounds. ``half_open``: starts while start + length <= end and an
    exclusive end. ``fallback``: like closed, but a segment shorter than one window yields itself.
    """
    exploded = segments.withColumn("window_start", F.explode(_starts(length, hop, style)))
    if style == "half_open":
        return exploded.withColumn("window_end", F.col("window_start") + length)
    end = F.col("window_start") + length - 1
    out = exploded.withColumn("window_end", F.least(end, F.col("end_sample")))
    if style == "fallback":
        return out.withColumn("full_interval_fallback", F.col("end_sample") - F.col("start_sample") + 1 < length)
    return out


def onset_windows(windows: DataFrame, limit_samples: int) -> DataFrame:
    """Windows that start within the first samples of their segment."""
    return windows.filter(F.col("window_start") - F.col("start_sample") <= limit_samples)


def assign_segment_windows(
    samples: DataFrame, segments: DataFrame, tl: Timeline, length: int, hop: int, style: str = "closed"
) -> DataFrame:
    """Give every sample the windows of its segment by arithmetic (at most ceil(length/hop) copies).

    Only windows that fit into the segment are produced; with ``fallback`` a short segment is one window.
    """
    inside = range_join(samples, segments, list(tl.keys), tl.pos, "start_sample", "end_sample", tl.cell)
    off = F.col(tl.pos) - F.col("start_sample")
    size = F.col("end_sample") - F.col("start_sample") + (0 if style == "half_open" else 1)
    top = F.floor((size - length) / hop)
    if style == "fallback":
        top = F.greatest(top, F.lit(0))
    first = F.greatest(F.lit(0), F.ceil((off - length + 1) / hop)).cast("bigint")
    last = F.least(top, F.floor(off / hop)).cast("bigint")
    ok = (size >= length) | F.lit(style == "fallback")
    k = F.when(ok & (first <= last), F.sequence(first, F.greatest(first, last)))
    out = inside.withColumn("window_index", F.explode(k))
    start = F.col("start_sample") + F.col("window_index") * hop
    out = out.withColumn("window_start", start)
    end = F.least(start + length - 1, F.col("end_sample")) if style == "fallback" else start + length - 1
    return out.withColumn("window_end", end)


def assign_session_windows(samples: DataFrame, tl: Timeline, length: int, hop: int) -> DataFrame:
    """Windows over whole sessions; incomplete last windows are removed by ``full_windows`` after aggregation."""
    pos = F.col(tl.pos)
    first = F.greatest(F.lit(0), F.ceil((pos - length + 1) / hop)).cast("bigint")
    last = F.floor(pos / hop).cast("bigint")
    out = samples.filter(first <= last).withColumn("window_index", F.explode(F.sequence(first, last)))
    start = F.col("window_index") * hop
    return out.withColumns({"window_start": start, "window_end": start + length - 1})


def center_value(column: str, length: int, pos: str) -> Column:
    """Aggregate that reads ``column`` at a window's centre sample."""
    return F.max(F.when(F.col(pos) == F.col("window_start") + length // 2, F.col(column)))


def full_windows(windows: DataFrame, length: int, count: str = "n_samples") -> DataFrame:
    return windows.filter(F.col(count) == length)


def event_window_bounds(length: int) -> dict[str, Column]:
    """Peak-centred window shifted into its block; a block shorter than the window is used whole.

    Reads peak_sample, block_start_sample and block_end_sample.
    """
    lo, hi = F.col("block_start_sample"), F.col("block_end_sample")
    centred = F.col("peak_sample") - length // 2
    start = F.least(F.greatest(centred, lo), F.greatest(lo, hi - length + 1))
    return {"window_start": start, "window_end": F.least(hi, start + length - 1)}


def tile_intervals(intervals: DataFrame, size: int = 2000) -> DataFrame:
    """Non-overlapping tiles of intervals whose span (end - start) holds at least one tile."""
    span = F.col("end_sample") - F.col("start_sample")
    starts = F.when(span >= size, F.sequence("start_sample", F.greatest(F.col("start_sample"), F.col("end_sample") - size), F.lit(size).cast("bigint")))
    return intervals.withColumn("tile_start", F.explode(starts)).withColumn("tile_end", F.col("tile_start") + size - 1)


def rms_refine(
    windows: DataFrame, segment: Sequence[str], channels: Sequence[str], fraction: float, weak: str = "rest",
    moves: Sequence[str] = ("LEFT", "RIGHT"), cell: float = 1.0,
) -> DataFrame:
    """Keep the strongest windows of each movement segment as ACTIVE; weaker ones become REST or are dropped.

    Ranks are running counts over cells of ``cell`` RMS units, so a long segment is ranked in parallel.
    """
    rms = sum((F.col(f"{c}_rms") for c in channels[1:]), F.col(f"{channels[0]}_rms")) / len(channels)
    rows = windows.filter(F.col("label").isin("REST", *moves)).withColumns({"aggregate_rms": rms, "original_label": F.col("label")})
    moving = rows.filter(F.col("label").isin(*moves)).withColumn("_down", -F.col("aggregate_rms"))
    ranked = carry(moving, Timeline(tuple(segment), "_down", cell), order=("window_start",), _rank=Running("sum", F.lit(1)))
    total = moving.groupBy(*segment).agg(F.count(F.lit(1)).alias("_n"))
    keep = F.col("_rank") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(fraction)))
    kept = ranked.join(total, list(segment)).withColumn("label", F.when(keep, "ACTIVE").otherwise("REST")).drop("_down", "_rank", "_n")
    if weak == "drop":
        kept = kept.filter("label = 'ACTIVE'")
    return kept.unionByName(rows.filter("label = 'REST'"))


def top_window_shares(windows: DataFrame, tl: Timeline, fraction: float, rms: str = "aggregate_rms") -> DataFrame:
    """ACTIVE share among all ACTIVE/REST windows and among those at or above the (1 - fraction) RMS quantile."""
    rows = windows.filter(F.col("label").isin("ACTIVE", "REST"))
    keys = list(tl.keys)
    cut = exact_quantiles(rows, keys, {"threshold": (F.col(rms), 1.0 - fraction)})
    active = (F.col("label") == "ACTIVE").cast("double")
    top = F.col(rms) >= F.col("threshold")
    return attach(rows, tl, cut).groupBy(*keys).agg(
        F.max("threshold").alias("threshold"), F.avg(active).alias("overall_active_fraction"),
        F.count_if(top).alias("top_windows"), F.avg(F.when(top, active)).alias("top_active_fraction"))


def calibration_subset(windows: DataFrame, seconds: float, labels: Sequence[str] = ("BASELINE", "REST")) -> DataFrame:
    """Resting windows that lie wholly inside the first seconds of their session."""
    return windows.filter(F.col("label").isin(*labels) & (F.col("start_time_sec") >= 0) & (F.col("end_time_sec") <= seconds))


def post_calibration(windows: DataFrame, seconds: float) -> DataFrame:
    """Windows after the calibration period, without baseline."""
    return windows.filter((F.col("start_time_sec") >= seconds) & (F.col("label") != "BASELINE"))


def trial_groups(trials: DataFrame, tl: Timeline, label: str = "label", rest: str = "Norm") -> DataFrame:
    """Number trials across a session and within their class, and add the intent label."""
    at = tl.at("start_sample")
    out = carry(trials, at, order=("end_sample", label), _g=Running("sum", F.lit(1)))
    out = carry(out, at.by(label), order=("end_sample",), _k=Running("sum", F.lit(1)))
    return out.withColumns({
        "group_id": F.col("_g") - 1, "trial_index_within_class": F.col("_k") - 1,
        "intent_label": F.when(F.col(label) == rest, rest).otherwise("Active")}).drop("_g", "_k")
