"""Per-window features as plain aggregates over (window, sample) rows; spectra by one FFT a window."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.timeline import Timeline, framed

# The frequency bands in Hz.
MU_BAND, BETA_BAND = (8.0, 12.0), (13.0, 30.0)


def time_features(channels: Sequence[str]) -> list[Column]:
    """mean, std, rms, ptp, var, energy per channel (population moments)."""
    out = []
    for c in channels:
        x = F.col(c)
        energy = F.avg(x * x)
        out += [
            F.avg(x).alias(f"{c}_mean"), F.stddev_pop(x).alias(f"{c}_std"), F.sqrt(energy).alias(f"{c}_rms"),
            (F.max(x) - F.min(x)).alias(f"{c}_ptp"), F.var_pop(x).alias(f"{c}_var"), energy.alias(f"{c}_energy"),
        ]
    return out


def with_steps(samples: DataFrame, tl: Timeline, channels: Sequence[str]) -> DataFrame:
    """Add each sample's step from the previous one and whether the slope sign changed there.

    Computed once per sample; a window then only skips the steps that cross its left border.
    """
    def build(w):
        cols = {}
        for c in channels:
            step = F.col(c) - F.lag(c).over(w)
            before = F.lag(c).over(w) - F.lag(c, 2).over(w)
            cols[f"_d_{c}"] = step
            cols[f"_turn_{c}"] = (F.signum(step) != F.signum(before)).cast("int")
        return cols
    return framed(samples, tl, 2, 0, build)


def waveform_length(c: str, pos: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col(pos) > F.col("window_start"), F.abs(f"_d_{c}"))), F.lit(0.0))


def emg_features(assigned: DataFrame, tl: Timeline, keys: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """RMS, MAV, VAR, WL, ZC, SSC per channel; input needs ``with_steps``.

    Zero crossings are counted after the window mean is removed, and a zero counts as a sign of its own.
    """
    w = Window.partitionBy(*keys)
    signs = assigned.withColumns({f"_sg_{c}": F.signum(F.col(c) - F.avg(c).over(w)) for c in channels})
    ordered = w.orderBy(tl.pos)
    flips = signs.withColumns({f"_zc_{c}": (F.col(f"_sg_{c}") != F.lag(f"_sg_{c}").over(ordered)).cast("int") for c in channels})
    aggs = [F.count(F.lit(1)).alias("n_samples")]
    for c in channels:
        aggs += [
            F.sqrt(F.avg(F.col(c) * F.col(c))).alias(f"{c}_RMS"), F.avg(F.abs(c)).alias(f"{c}_MAV"),
            F.var_pop(c).alias(f"{c}_VAR"), waveform_length(c, tl.pos).alias(f"{c}_WL"),
            F.coalesce(F.sum(f"_zc_{c}"), F.lit(0)).alias(f"{c}_ZC"),
            F.coalesce(F.sum(F.when(F.col(tl.pos) > F.col("window_start") + 1, F.col(f"_turn_{c}"))), F.lit(0)).alias(f"{c}_SSC"),
        ]
    return flips.groupBy(*keys).agg(*aggs)


def slope(x: str, pos: str) -> Column:
    """Least-squares slope per sample, 0 for a single sample."""
    return F.coalesce(F.regr_slope(F.col(x), F.col(pos).cast("double")), F.lit(0.0))


def delta(x: str, pos: str) -> Column:
    return F.max_by(x, pos) - F.min_by(x, pos)


def event_features(channels: Sequence[str], pos: str, envelopes: Sequence[str] = ("aggregate_rms", "aggregate_rms_smooth")) -> list[Column]:
    """Time features plus mean absolute value and slope, and the envelope's level, spread and trend."""
    out = time_features(channels)
    for c in channels:
        out += [F.avg(F.abs(c)).alias(f"{c}_abs_mean"), slope(c, pos).alias(f"{c}_slope")]
    for e in envelopes:
        out += [
            F.avg(e).alias(f"{e}_mean"), F.stddev_pop(e).alias(f"{e}_std"), F.max(e).alias(f"{e}_max"),
            delta(e, pos).alias(f"{e}_delta"), slope(e, pos).alias(f"{e}_slope"),
        ]
    return out


def peak_event_features(assigned: DataFrame, keys: Sequence[str], channels: Sequence[str], pos: str, aggregate: str = "aggregate_rms") -> DataFrame:
    """Features of a peak-centred window; each channel is also compared with the channel mean.

    Needs ``with_steps`` over the channels and the aggregate.
    """
    aggs = []
    for c in channels:
        aggs += [
            F.sqrt(F.avg(F.col(c) * F.col(c))).alias(f"{c}_rms"), F.avg(F.abs(c)).alias(f"{c}_mav"), F.var_pop(c).alias(f"{c}_variance"),
            F.max(F.abs(c)).alias(f"{c}_peak_abs"), waveform_length(c, pos).alias(f"{c}_waveform_length"),
        ]
    a = aggregate
    aggs += [F.avg(a).alias(f"{a}_mean"), F.stddev_pop(a).alias(f"{a}_std"), F.max(a).alias(f"{a}_max"), waveform_length(a, pos).alias(f"{a}_waveform_length")]
    out = assigned.groupBy(*keys).agg(*aggs)
    for stat in ("rms", "mav"):
        mean = sum((F.col(f"{c}_{stat}") for c in channels[1:]), F.col(f"{channels[0]}_{stat}")) / len(channels)
        out = out.withColumns({f"{c}_{stat}_asym": F.col(f"{c}_{stat}") - mean for c in channels})
    return out


def segment_features(inside: DataFrame, keys: Sequence[str], pos: str, state: str = "event_label",
                     envelopes: Sequence[str] = ("aggregate_rms", "aggregate_rms_smooth")) -> DataFrame:
    """State fractions and envelope statistics of whole segments."""
    aggs = [F.avg((F.col(state) == s).cast("double")).alias(f"{s.lower()}_fraction") for s in ("ONSET", "ACTIVE", "OFFSET", "INACTIVE")]
    for e in envelopes:
        aggs += [
            F.avg(e).alias(f"{e}_mean"), F.stddev_pop(e).alias(f"{e}_std"), F.max(e).alias(f"{e}_max"),
            delta(e, pos).alias(f"{e}_delta"), (F.max(e) - F.min(e)).alias(f"{e}_ptp"), slope(e, pos).alias(f"{e}_slope"),
        ]
    return inside.groupBy(*keys).agg(*aggs)


def rms_features(channels: Sequence[str]) -> list[Column]:
    each = [F.sqrt(F.avg(F.col(c) * F.col(c))) for c in channels]
    return [*[e.alias(f"{c}_rms") for e, c in zip(each, channels)], (sum(each[1:], each[0]) / len(channels)).alias("aggregate_rms")]


# --- spectrum -------------------------------------------------------------------------------------

def welch_plan(length: int, fs: float, nperseg: int | None = None) -> tuple[int, int, int]:
    """Segment length, step and number of half-overlapping segments of a window."""
    nper = min(length, nperseg or max(8, round(fs)))
    step = nper - nper // 2
    return nper, step, 1 + (length - nper) // step


def power_spectrum(rows: DataFrame, keys: Sequence[str], n: int, fs: float) -> DataFrame:
    """``_power``: densities of bins 0 to n // 2 of one mean-removed, Hann-weighted segment of ``n`` samples per key.

    Rows carry the place ``_j`` (0 to n - 1) and ``_x``; a segment is one array, and a batch of arrays goes through one
    real FFT. A missing sample counts as nothing, in the mean too.
    """
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    level, scale = np.fft.rfft(hann), np.where((np.arange(n // 2 + 1) == 0) | (2 * np.arange(n // 2 + 1) == n), 1.0, 2.0) / (fs * (hann**2).sum())

    @F.pandas_udf("array<double>")
    def spectrum(place: pd.Series, value: pd.Series) -> pd.Series:
        sizes = place.map(len).to_numpy()
        x = np.zeros((len(place), n))
        x[np.repeat(np.arange(len(place)), sizes), np.concatenate([*place.to_numpy(), np.zeros(0)]).astype(int)] = np.concatenate([*value.to_numpy(), np.zeros(0)])
        mean = x.sum(1) / np.maximum(sizes, 1)
        power = np.abs(np.fft.rfft(x * hann, axis=1) - mean[:, None] * level) ** 2 * scale
        return pd.Series(list(power))

    held = rows.where(F.col("_x").isNotNull()).groupBy(*keys).agg(F.collect_list("_j").alias("_js"), F.collect_list("_x").alias("_xs"))  # one segment
    return held.select(*keys, spectrum("_js", "_xs").alias("_power"))


def spectrum_segments(assigned: DataFrame, offset: Column, nper: int, step: int, count: int) -> DataFrame:
    """Copy each windowed sample to the Welch segments that contain it (``_seg``, position ``_j``)."""
    first = F.greatest(F.lit(0), F.ceil((offset - nper + 1) / step)).cast("bigint")
    last = F.least(F.lit(count - 1), F.floor(offset / step)).cast("bigint")
    rows = assigned.withColumn("_off", offset).filter(first <= last)
    return rows.withColumn("_seg", F.explode(F.sequence(first, last))).withColumn("_j", F.col("_off") - F.col("_seg") * step)


def band_power_sum(
    assigned: DataFrame, keys: Sequence[str], channels: Sequence[str], offset: Column, length: int, fs: float,
    bands: Mapping[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """Sum of power-density bins per band and channel (``{channel}_{band}_power``), averaged over Welch segments."""
    bands = dict(bands or {"mu": MU_BAND, "beta": BETA_BAND})
    nper, step, count = welch_plan(length, fs)
    cells = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("_x")) for c in channels])
    rows = spectrum_segments(assigned, offset, nper, step, count).select(*keys, "_seg", "_j", F.inline(cells))
    per_segment = power_spectrum(rows, [*keys, "_seg", "channel"], nper, fs)
    for name, (lo, hi) in bands.items():
        bins = [F.col("_power")[k] for k in range(nper // 2 + 1) if lo <= k * fs / nper <= hi]
        per_segment = per_segment.withColumn(name, sum(bins[1:], bins[0]) if bins else F.lit(0.0))
    return per_segment.groupBy(*keys).agg(*[
        F.avg(F.when(F.col("channel") == c, F.col(b))).alias(f"{c}_{b}_power") for c in channels for b in bands])


def psd_rows(assigned: DataFrame, keys: Sequence[str], channels: Sequence[str], offset: Column, length: int, fs: float) -> DataFrame:
    """One-segment spectrum as rows (keys, channel, freq, power) over the whole window."""
    cells = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("_x")) for c in channels])
    rows = assigned.select(*keys, offset.alias("_j"), F.inline(cells))
    powers = power_spectrum(rows, [*keys, "channel"], length, fs)
    return powers.select(*keys, "channel", F.posexplode("_power").alias("_k", "power")).select(*keys, "channel", (F.col("_k") * F.lit(fs) / F.lit(length)).alias("freq"), "power")


def spectral_summary(psd: DataFrame, keys: Sequence[str], bands: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Mean and median frequency and trapezoid band powers from spectrum rows."""
    group = [*keys, "channel"]
    w = Window.partitionBy(*group).orderBy("freq")
    rows = psd.withColumns({
        "_cum": F.sum("power").over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "_total": F.sum("power").over(Window.partitionBy(*group)),
        "_nf": F.lead("freq").over(w), "_np": F.lead("power").over(w)})
    area = (F.col("power") + F.col("_np")) / 2 * (F.col("_nf") - F.col("freq"))
    inside = lambda lo, hi: (F.col("freq") >= lo) & (F.col("_nf") <= hi)
    out = rows.groupBy(*group).agg(
        F.max("_total").alias("_total"), F.sum(F.col("freq") * F.col("power")).alias("_fp"),
        F.min(F.when(F.col("_cum") >= F.col("_total") / 2, F.col("freq"))).alias("_mdf"),
        *[F.coalesce(F.sum(F.when(inside(lo, hi), area)), F.lit(0.0)).alias(n) for n, (lo, hi) in bands.items()])
    silent = F.col("_total") == 0
    return out.withColumns({
        "mean_freq": F.when(silent, 0.0).otherwise(F.col("_fp") / F.col("_total")),
        "median_freq": F.when(silent, 0.0).otherwise(F.col("_mdf"))}).drop("_total", "_fp", "_mdf")


def pairwise_asymmetry(channels: Sequence[str], bands: Sequence[str] = ("mu", "beta")) -> dict[str, Column]:
    """Band-power differences of every channel pair."""
    return {f"{b}_asym_{a}__{c}": F.col(f"{a}_{b}_power") - F.col(f"{c}_{b}_power") for a, c in combinations(channels, 2) for b in bands}


def c3c4_asymmetry(left: str, right: str) -> dict[str, Column]:
    """Signed differences both ways and the normalised mu ratio of the two motor channels."""
    mu_l, mu_r = F.col(f"{left}_mu_power"), F.col(f"{right}_mu_power")
    be_l, be_r = F.col(f"{left}_beta_power"), F.col(f"{right}_beta_power")
    return {
        "C3_C4_Mu_Diff": mu_l - mu_r, "C4_C3_Mu_Diff": mu_r - mu_l, "Mu_Asymmetry_Ratio": (mu_l - mu_r) / (mu_l + mu_r + 1e-6),
        "C3_C4_Beta_Diff": be_l - be_r, "C4_C3_Beta_Diff": be_r - be_l,
    }
