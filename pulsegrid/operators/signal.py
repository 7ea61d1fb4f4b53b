"""Native signal transforms: centring, scaling, smoothing, profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.audit import unpivot_channels
from pulsegrid.timeline import Timeline, attach, exact_quantiles, framed, range_join, with_halo

# Microvolts per count and the limits of the unit guess.
COUNT_TO_UV = 0.02235
COUNTS_MEDIAN_TRIGGER, COUNTS_MAX_TRIGGER, UV_LIMIT = 1000.0, 10000.0, 200.0


def channel_medians(samples: DataFrame, tl: Timeline, channels: Sequence[str]) -> DataFrame:
    return exact_quantiles(samples, list(tl.keys), {f"_med_{c}": (F.col(c), 0.5) for c in channels})


def center_and_scale(samples: DataFrame, tl: Timeline, channels: Sequence[str], scale: float = COUNT_TO_UV) -> DataFrame:
    """Subtract each channel's session median and convert counts to microvolts."""
    joined = attach(samples, tl, channel_medians(samples, tl, channels))
    out = joined.withColumns({c: (F.col(c) - F.col(f"_med_{c}")) * scale for c in channels})
    return out.drop(*[f"_med_{c}" for c in channels])


def _middle(cols: Sequence[Column]) -> Column:
    """Median of a few columns of one row."""
    s, n = F.sort_array(F.array(*cols)), len(cols)
    return (s[(n - 1) // 2] + s[n // 2]) / 2


def scale_verdict(
    samples: DataFrame, tl: Timeline, channels: Sequence[str],
    median_trigger: float = COUNTS_MEDIAN_TRIGGER, max_trigger: float = COUNTS_MAX_TRIGGER,
) -> DataFrame:
    """Per session: do the values look like raw counts or like microvolts?"""
    med = channel_medians(samples, tl, channels)
    top = samples.groupBy(*tl.keys).agg(F.max(F.greatest(*[F.abs(c) for c in channels])).alias("raw_abs_max"))
    out = med.join(top, list(tl.keys)).withColumn("raw_abs_median", _middle([F.abs(f"_med_{c}") for c in channels]))
    counts = (F.col("raw_abs_median") > median_trigger) | (F.col("raw_abs_max") > max_trigger)
    return out.withColumn("mode_applied", F.when(counts, "counts_centered").otherwise("raw_uv"))


def infer_scale(
    samples: DataFrame, tl: Timeline, channels: Sequence[str], scale: float = COUNT_TO_UV, **triggers: float
) -> DataFrame:
    """Convert sessions that look like counts; leave microvolt sessions as they are."""
    joined = attach(samples, tl, scale_verdict(samples, tl, channels, **triggers))
    counts = F.col("mode_applied") == "counts_centered"
    out = joined.withColumns({c: F.when(counts, (F.col(c) - F.col(f"_med_{c}")) * scale).otherwise(F.col(c)) for c in channels})
    return out.drop("raw_abs_max", "raw_abs_median", *[f"_med_{c}" for c in channels])


def assess_signal_scale(
    samples: DataFrame, tl: Timeline, channels: Sequence[str], rail: float, scale: float = COUNT_TO_UV, uv_limit: float = UV_LIMIT
) -> DataFrame:
    """Raw overview per session and whether centred, scaled values fit the microvolt limit."""
    keys = list(tl.keys)
    scaled = center_and_scale(samples, tl, channels, scale)
    p99 = exact_quantiles(scaled, keys, {f"_p99_{c}": (F.abs(c), 0.99) for c in channels})
    near = lambda c: F.avg((F.abs(F.abs(c) - rail) < 500.0).cast("double"))
    rails = samples.groupBy(*keys).agg(*[((F.max(F.abs(c)) >= rail - 500) | (near(c) > 0.01)).cast("int").alias(f"_r_{c}") for c in channels])
    rail_count = sum((F.col(f"_r_{c}") for c in channels), F.lit(0))
    return p99.join(rails, keys).join(scale_verdict(samples, tl, channels), keys).select(
        *keys, "raw_abs_median", "raw_abs_max",
        F.when(F.col("mode_applied") == "counts_centered", "raw_counts").otherwise("unknown").alias("likely_signal_kind"),
        _middle([F.col(f"_p99_{c}") for c in channels]).alias("median_abs_p99"),
        (_middle([F.col(f"_p99_{c}") for c in channels]) <= uv_limit * 1.25).alias("plausible_scale"),
        rail_count.alias("channels_near_rail"),
    )


def centered_frame(w: Window, width: int) -> Window:
    """Centred frame of ``width`` rows; an even width takes one more row before than after."""
    return w.rowsBetween(-(width // 2), (width - 1) // 2)


def rolling_smooth(samples: DataFrame, tl: Timeline, columns: Mapping[str, Column], width: int) -> DataFrame:
    """Centred rolling mean that shrinks at the ends of a session."""
    rows = samples.withColumns({f"_in_{n}": e for n, e in columns.items()})
    out = framed(rows, tl, width // 2, (width - 1) // 2,
                 lambda w: {n: F.avg(f"_in_{n}").over(centered_frame(w, width)) for n in columns})
    return out.drop(*[f"_in_{n}" for n in columns])


def aggregate_rms(channels: Sequence[str]) -> Column:
    """Root mean square over the channels of one sample."""
    return F.sqrt(sum((F.col(c) * F.col(c) for c in channels[1:]), F.col(channels[0]) * F.col(channels[0])) / len(channels))


def with_envelope(samples: DataFrame, tl: Timeline, channels: Sequence[str], width: int) -> DataFrame:
    """Add ``aggregate_rms`` and its centred mean ``aggregate_rms_smooth``."""
    rows = samples.withColumn("aggregate_rms", aggregate_rms(channels))
    return rolling_smooth(rows, tl, {"aggregate_rms_smooth": F.col("aggregate_rms")}, width)


def detrend_smooth(samples: DataFrame, tl: Timeline, channels: Sequence[str], detrend_width: int, smooth_width: int = 3) -> DataFrame:
    """Subtract a centred rolling mean, then smooth; both frames share one shuffle."""
    before = detrend_width // 2 + smooth_width // 2
    after = (detrend_width - 1) // 2 + (smooth_width - 1) // 2
    w = Window.partitionBy(*tl.keys, "_chunk").orderBy(tl.pos)
    rows = with_halo(samples, tl, before, after)
    high = rows.withColumns({c: F.col(c) - F.avg(c).over(centered_frame(w, detrend_width)) for c in channels})
    low = high.withColumns({c: F.avg(c).over(centered_frame(w, smooth_width)) for c in channels})
    return low.filter("_core").drop("_chunk", "_core")


def signal_modes(samples: DataFrame, tl: Timeline, channels: Sequence[str], detrend_width: int, scale: float = COUNT_TO_UV) -> DataFrame:
    """The same samples in four stages: raw, centered, scaled, filtered (column ``mode``)."""
    joined = attach(samples, tl, channel_medians(samples, tl, channels))
    scaled = {f"_s_{c}": (F.col(c) - F.col(f"_med_{c}")) * scale for c in channels}
    filtered = detrend_smooth(
        joined.withColumns(scaled).withColumns({f"_f_{c}": F.col(f"_s_{c}") for c in channels}),
        tl, [f"_f_{c}" for c in channels], detrend_width)
    stage = lambda mode, exprs: F.struct(F.lit(mode).alias("mode"), *[e.alias(c) for c, e in exprs.items()])
    stages = F.array(
        stage("raw", {c: F.col(c).cast("double") for c in channels}),
        stage("centered", {c: F.col(c) - F.col(f"_med_{c}") for c in channels}),
        stage("scaled", {c: F.col(f"_s_{c}") for c in channels}),
        stage("filtered", {c: F.col(f"_f_{c}") for c in channels}),
    )
    others = [c for c in samples.columns if c not in channels]
    return filtered.select(*others, F.inline(stages))


def sanity_slice(modes: DataFrame, tl: Timeline, label: str, active: Sequence[str], channel: str, rows: int = 40) -> DataFrame:
    """The first ``rows`` samples from each session's first active label, one column per mode."""
    keys = list(tl.keys)
    first = modes.groupBy(*keys).agg(F.min(F.when(F.col(label).isin(*active), F.col(tl.pos))).alias("_first"))
    cut = attach(modes, tl, first).filter((F.col(tl.pos) >= F.col("_first")) & (F.col(tl.pos) < F.col("_first") + rows))
    names = ["raw", "centered", "scaled", "filtered"]
    return cut.groupBy(*keys, tl.pos, label).agg(*[F.max(F.when(F.col("mode") == m, F.col(channel))).alias(f"{channel}_{m}") for m in names])


def moving_mav(samples: DataFrame, tl: Timeline, channels: Sequence[str], width: int, limit: float = UV_LIMIT) -> DataFrame:
    """Mean of the clipped absolute value over the last ``width`` samples, per channel (``*_average``)."""
    clipped = samples.withColumns({f"_c_{c}": F.least(F.abs(c), F.lit(limit)) for c in channels})
    out = framed(clipped, tl, width - 1, 0,
                 lambda w: {f"{c}_average": F.avg(f"_c_{c}").over(w.rowsBetween(-(width - 1), 0)) for c in channels})
    return out.drop(*[f"_c_{c}" for c in channels])


def activity_profile(samples: DataFrame, segments: DataFrame, tl: Timeline, channels: Sequence[str], points: int = 300) -> DataFrame:
    """Resample every segment of at least four samples to ``points`` and average over segments.

    Each sample pair emits the grid points that fall between them, so no grid join is needed.
    Columns: point, segments, then mean/std of the aggregate RMS and of each channel's absolute value.
    """
    keys = list(tl.keys)
    names = ["aggregate_rms", *[f"{c}_abs" for c in channels]]
    exprs = [aggregate_rms(channels), *[F.abs(c) for c in channels]]
    rows = samples.select(*keys, tl.pos, *[e.alias(n) for n, e in zip(names, exprs)])
    nexts = framed(rows, tl, 0, 1, lambda w: {f"_n_{n}": F.lead(n).over(w) for n in names})
    spans = segments.select(*keys, "start_sample", "end_sample").filter(F.col("end_sample") - F.col("start_sample") >= 3)
    inside = range_join(nexts, spans, keys, tl.pos, "start_sample", "end_sample", tl.cell)
    last = F.col("end_sample") - F.col("start_sample")
    off = F.col(tl.pos) - F.col("start_sample")
    grid = points - 1
    lo = F.ceil(off * grid / last)
    hi = F.when(off == last - 1, F.lit(grid).cast("bigint")).otherwise(F.ceil((off + 1) * grid / last) - 1)
    hit = inside.filter(off < last).filter(lo <= hi).withColumn("point", F.explode(F.sequence(lo, hi)))
    frac = F.col("point") * last / grid - off
    value = lambda n: F.col(n) + (F.col(f"_n_{n}") - F.col(n)) * frac
    stats = [f for n in names for f in (F.avg(value(n)).alias(f"{n}_mean"), F.stddev_pop(value(n)).alias(f"{n}_std"))]
    return hit.groupBy("point").agg(F.count(F.lit(1)).alias("segments"), *stats)


def top_channels(profile: DataFrame, channels: Sequence[str], k: int = 2) -> DataFrame:
    """The ``k`` channels with the largest mean absolute activity in a profile."""
    means = profile.agg(*[F.avg(f"{c}_abs_mean").alias(c) for c in channels])
    return unpivot_channels(means, [], channels).withColumnRenamed("x", "energy").orderBy(F.desc("energy"), "channel").limit(k)
