"""Sampling-rate and channel-quality audits."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.labels import channel_number
from pulsegrid.runtime import materialize
from pulsegrid.timeline import Running, Timeline, attach, carry, exact_quantiles, framed

# Amplifier rail and the quality limits results must use.
NOMINAL_RAIL, RAIL_TOLERANCE = 187500.022352, 5.0
QUESTIONABLE_RAIL_FRACTION, UNSAFE_RAIL_FRACTION, DOMINANT_FRACTION = 0.005, 0.05, 0.999
FALLBACK_FS = 250.0


def unpivot_channels(samples: DataFrame, keep: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """One row per sample and channel: keep columns, channel, x."""
    cells = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("x")) for c in channels])
    return samples.select(*keep, F.inline(cells))


def estimate_sampling(samples: DataFrame, tl: Timeline, ts: str) -> DataFrame:
    """Sampling rate per session from the median positive step, with jump and disorder counts."""
    keys = list(tl.keys)
    steps = framed(
        samples.select(*keys, tl.pos, F.col(ts).cast("double").alias("_t")), tl, 1, 0,
        lambda w: {"_d": F.col("_t") - F.lag("_t").over(w)},
    )
    median = exact_quantiles(steps.filter("_d > 0 AND _d < 1"), keys, {"median_dt": (F.col("_d"), 0.5)})
    stats = attach(steps, tl, median).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.col("_t").isNull().cast("double")).alias("timestamp_missing_fraction"),
        F.max("median_dt").alias("median_dt"),
        F.count_if(F.col("_d") > F.col("median_dt") * 5.0).alias("timestamp_jump_count"),
        F.count_if(F.col("_d") < 0).alias("timestamp_negative_count"),
        F.count_if(F.col("_d") == 0).alias("timestamp_zero_count"),
        (F.max_by("_t", tl.pos) - F.min_by("_t", tl.pos)).alias("duration_from_timestamp_sec"),
    )
    fs_median = 1.0 / F.col("median_dt")
    fs_overall = F.when(F.col("duration_from_timestamp_sec") > 0, (F.col("rows") - 1) / F.col("duration_from_timestamp_sec"))
    fs_used = F.coalesce(fs_median, F.lit(FALLBACK_FS))
    disagree = F.abs(fs_overall - fs_median) / F.greatest(fs_median, F.lit(1e-9)) > 0.10
    return stats.withColumns(
        {
            "fs_median_hz": fs_median,
            "fs_overall_hz": fs_overall,
            "fs_used_hz": fs_used,
            "duration_from_samples_sec": F.col("rows") / fs_used,
            "rates_disagree": F.coalesce(disagree, F.lit(False)),
        }
    )


def _four_digits(share: Column) -> Column:
    """A share from 0 to 1 as printf's %.4f has it: its binary value counts, so 0.00625 is 0.0063 and 0.03125 is 0.0312.

    Spark rounds the shortest decimal that reads as the number. Here the number times 2**90 is a whole number, made in two
    exact steps, so what is left over is compared with one half exactly.
    """
    high = F.floor(share * float(2**40))
    low = (share * float(2**40) - high) * float(2**50)
    n = (high.cast("decimal(13,0)") * F.lit(Decimal(2**50)) + low.cast("decimal(16,0)")) * F.lit(Decimal(10_000))
    q, rest, half = F.call_function("div", n, F.lit(Decimal(2**90))), n % F.lit(Decimal(2**90)), F.lit(Decimal(2**89))
    q = q + F.when((rest > half) | ((rest == half) & (q % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(q / 10_000).cast("string"), F.lit("."), F.lpad((q % 10_000).cast("string"), 4, "0"))


def channel_quality(
    samples: DataFrame, tl: Timeline, channels: Sequence[str], rail: float = NOMINAL_RAIL, tolerance: float = RAIL_TOLERANCE
) -> DataFrame:
    """Status per channel (safe, questionable, unsafe) with the measurements behind it."""
    keys = [*tl.keys, "channel"]
    long = unpivot_channels(samples, tl.keys, channels)
    base = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg(F.col("x").isNull().cast("double")).alias("missing_fraction"),
        F.avg(F.coalesce((F.abs(F.abs("x") - rail) <= tolerance).cast("double"), F.lit(0.0))).alias("rail_fraction"),
        F.stddev_samp("x").alias("centered_std"),
        F.min("x").alias("min_value"), F.max("x").alias("max_value"), F.max(F.abs("x")).alias("max_abs_value"),
    )
    # counting equal values first spreads a hot channel over its distinct values
    dominant = long.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("_c")).groupBy(*keys).agg(F.max("_c").alias("_top"))
    q = base.join(dominant, keys).withColumn("dominant_value_fraction", F.col("_top") / F.col("_n"))
    missing = F.col("missing_fraction") > 0
    unsafe = (
        (F.col("dominant_value_fraction") >= DOMINANT_FRACTION)
        | F.coalesce(F.col("centered_std") == 0, F.lit(False))
        | (F.col("rail_fraction") >= UNSAFE_RAIL_FRACTION)
    )
    touched = F.coalesce(F.col("max_abs_value") >= rail - tolerance, F.lit(False))
    some_rail = F.col("rail_fraction") >= QUESTIONABLE_RAIL_FRACTION
    fraction = lambda text, c: F.concat(F.lit(text + " "), _four_digits(F.col(c)))
    reasons = F.concat_ws(
        "; ",
        F.when(missing, fraction("missing fraction", "missing_fraction")),
        F.when(F.col("dominant_value_fraction") >= DOMINANT_FRACTION, fraction("dominant exact value fraction", "dominant_value_fraction")),
        F.when(F.col("centered_std") == 0, F.lit("centered standard deviation is 0")),
        F.when((F.col("rail_fraction") >= UNSAFE_RAIL_FRACTION) | (some_rail & ~unsafe), fraction("rail fraction", "rail_fraction"))
        .when(touched & ~unsafe & ~some_rail, F.lit("a sample touched the nominal rail")),
    )
    status = F.when(unsafe, "unsafe").when(some_rail | touched | missing, "questionable").otherwise("safe")
    return q.withColumns({"status": status, "reasons": reasons}).drop("_n", "_top")


def flat_or_railed(samples: DataFrame, tl: Timeline, channels: Sequence[str], rail: float = 187000.0) -> DataFrame:
    """Channels without spread or beyond the rail limit."""
    long = unpivot_channels(samples, tl.keys, channels)
    return long.groupBy(*tl.keys, "channel").agg(
        F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max")
    ).withColumns(
        {"is_flat": F.coalesce(F.col("std") == 0, F.lit(False)), "is_railed": (F.col("max") >= rail) | (F.col("min") <= -rail)}
    )


def channel_status_sets(quality: DataFrame, tl: Timeline) -> DataFrame:
    """Channel names per status as text lists (the channel count of a device bounds them)."""
    names = lambda s: F.array_join(F.sort_array(F.collect_set(F.when(F.col("status") == s, F.col("channel")))), ", ")
    return quality.groupBy(*tl.keys).agg(*[names(s).alias(s) for s in ("safe", "questionable", "unsafe")])


def select_channels(quality: DataFrame, train: DataFrame, key: str = "session_id") -> DataFrame:
    """Channels that are never unsafe in the training sessions, with the count of unsafe hits."""
    unsafe = F.col("status") == "unsafe"
    return quality.join(train.select(key).distinct(), key, "left_semi").groupBy("channel").agg(
        F.count_if(unsafe).alias("unsafe_sessions"),
        F.min(F.when(unsafe, F.col(key))).alias("first_unsafe_session"),
        (~F.bool_or(unsafe)).alias("selected"),
    )


def usable_channels(quality: DataFrame, tl: Timeline, minimum: int = 1) -> DataFrame:
    """Channels that are not unsafe, ordered by number; sessions below ``minimum`` are left out."""
    per_session = Window.partitionBy(*tl.keys)
    return (
        quality.filter("status <> 'unsafe'")
        .withColumns({
            "channel_order": F.row_number().over(per_session.orderBy(channel_number("channel"))),
            "_n": F.count(F.lit(1)).over(per_session),
        })
        .filter(F.col("_n") >= minimum)
        .select(*tl.keys, "channel", "channel_order")
    )


def common_channels(usable: DataFrame, sessions: DataFrame, key: str = "session_id") -> DataFrame:
    """Channels usable in every session."""
    hits = usable.groupBy("channel").agg(F.count_distinct(key).alias("sessions"))
    total = sessions.agg(F.count_distinct(key).alias("sessions"))
    return hits.join(F.broadcast(total), "sessions", "left_semi").select("channel")


def session_audit(
    totals: DataFrame, sampling: DataFrame, quality: DataFrame, segments: DataFrame, events: DataFrame,
    transitions: DataFrame, tl: Timeline,
) -> DataFrame:
    """One row per session combining the audit tables, with the two usability verdicts."""
    keys = list(tl.keys)
    movement = lambda k: F.count_if(F.col("segment_kind") == k).alias(f"{k}_count")
    seg = segments.groupBy(*keys).agg(movement("movement1"), movement("movement2"), F.count(F.lit(1)).alias("segments"))
    status = lambda s: F.count_if(F.col("status") == s).alias(f"channel_{s}_count")
    chan = quality.groupBy(*keys).agg(status("safe"), status("questionable"), status("unsafe"))
    mark = events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("marker_events"), F.bool_or(F.col("run_length_samples") > 1).alias("persisted_markers"),
        F.bool_or(~F.col("code").isin(0, 1, 2, 3, 4)).alias("unexpected_codes"),
    )
    trans = transitions.groupBy(*keys).agg(F.count(F.lit(1)).alias("transition_issues"))
    out = totals.select(*keys, "total_samples").join(sampling.select(*keys, "fs_used_hz", "timestamp_jump_count", "rates_disagree"), keys, "left")
    for part in (seg, chan, mark, trans):
        out = out.join(part, keys, "left")
    out = out.fillna(0, ["marker_events", "transition_issues"]).fillna(False, ["persisted_markers", "unexpected_codes"])
    audit_ok = (F.col("movement1_count") > 0) & (F.col("movement2_count") > 0)
    usable = F.col("channel_safe_count") + F.col("channel_questionable_count")
    return out.withColumns({"usable_for_audit": audit_ok, "usable_for_modeling": audit_ok & (usable >= 2)})


def inventory(audit: DataFrame, catalog: DataFrame, tl: Timeline) -> DataFrame:
    """Catalog rows with shape, verdicts and the first finding of each session."""
    first = (
        F.when(F.col("transition_issues") > 0, F.lit("unexpected marker transitions"))
        .when((F.col("movement1_count") != 10) | (F.col("movement2_count") != 10), F.lit("movement count differs from the protocol"))
        .when(F.col("rates_disagree"), F.lit("sampling rates disagree"))
        .when(F.col("unexpected_codes"), F.lit("unexpected marker values"))
        .when(F.col("persisted_markers"), F.lit("markers persisted for several samples"))
        .otherwise("")
    )
    return catalog.join(audit, list(tl.keys)).withColumns(
        {"shape": F.concat_ws("x", F.col("total_samples").cast("string"), F.col("columns").cast("string")), "top_issue": first}
    )


def channel_diagnostics(
    samples: DataFrame, tl: Timeline, channels: Sequence[str], mode: str, time: str | Column,
    rail: float = NOMINAL_RAIL, suspicious: float = 187000.0,
) -> DataFrame:
    """Distribution, spread, trend and drift of every channel in one signal mode.

    ``mode`` names the column that tells the signal modes apart. Deciles at both ends hold at least
    ten rows. Flags compare a channel with the median spread of its mode.
    """
    keys = [*tl.keys, mode, "channel"]
    t = F.col(time) if isinstance(time, str) else time
    long = unpivot_channels(samples.withColumn("_t", t), [*tl.keys, mode, tl.pos, "_t"], channels)
    base = long.groupBy(*keys).agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"),
        F.max("x").alias("max"), F.skewness("x").alias("_skew"), F.coalesce(F.regr_slope("x", "_t"), F.lit(0.0)).alias("trend_slope"),
        F.max(tl.pos).alias("_last"),
        F.avg((F.abs(F.abs("x") - rail) < 500.0).cast("double")).alias("fraction_near_rail"),
        F.max(F.abs("x")).alias("_max_abs"),
    )
    x, size = F.col("x"), F.abs("x")
    quant = exact_quantiles(long, keys, {
        "median": (x, 0.5), "_q25": (x, 0.25), "_q75": (x, 0.75), "abs_p95": (size, 0.95), "abs_p99": (size, 0.99)})
    stats = materialize(base.join(quant, keys))
    rows = long.join(stats.select(*keys, "median", "_last", "n"), keys)
    tail = F.greatest(F.lit(10), F.floor(F.col("n") / 10))
    second = exact_quantiles(rows, keys, {
        "mad": (F.abs(x - F.col("median")), 0.5),
        "median_first_decile": (F.when(F.col(tl.pos) < tail, x), 0.5),
        "median_last_decile": (F.when(F.col(tl.pos) > F.col("_last") - tail, x), 0.5)})
    n = F.col("n")
    full = materialize(stats.join(second, keys)).withColumns({
        "iqr": F.col("_q75") - F.col("_q25"),
        "skew": F.when(n > 2, F.col("_skew") * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(0.0),
        "median_drift": F.col("median_last_decile") - F.col("median_first_decile"),
        "flag_suspicious_saturation": (F.col("_max_abs") >= suspicious) | (F.col("fraction_near_rail") > 0.01),
    })
    per_mode = [*tl.keys, mode]
    mode_std = exact_quantiles(full, per_mode, {"_mode_std": (F.col("std"), 0.5)})
    floor = F.lit(1e-6)
    return full.join(mode_std, per_mode).withColumns({
        "flag_near_constant": F.col("std") < F.greatest(floor, F.col("_mode_std") * 0.05),
        "flag_unusually_noisy": F.col("std") > F.greatest(floor, F.col("_mode_std") * 2.5),
        "flag_extreme_skew": F.abs("skew") > 2.0,
        "flag_large_drift": F.abs("median_drift") > F.greatest(F.col("std") * 0.5, floor),
    }).drop("_skew", "_last", "_max_abs", "_q25", "_q75", "_mode_std")


def marker_rows(events: DataFrame, totals: DataFrame, tl: Timeline) -> DataFrame:
    """Marker statistics per session and code."""
    keys = [*tl.keys, "code"]
    base = events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events"), F.max("run_length_samples").alias("longest_run"),
        F.sum("run_length_samples").alias("samples"))
    gaps = carry(events, tl.at("start_sample").by("code"), _prev=Running("lag", F.col("start_sample")))
    median = exact_quantiles(gaps, keys, {"median_gap_samples": (F.col("start_sample") - F.col("_prev"), 0.5)})
    return base.join(median, keys, "left").join(totals.select(*tl.keys, "total_samples"), list(tl.keys))


def segment_window_check(segments: DataFrame, window_ms: float, label: str = "label") -> DataFrame:
    """Segments per label and how many are shorter than one window."""
    return segments.groupBy(label).agg(
        F.count(F.lit(1)).alias("segments"), F.avg("duration_ms").alias("mean_duration_ms"),
        F.count_if(F.col("duration_ms") < window_ms).alias("shorter_than_window"))
