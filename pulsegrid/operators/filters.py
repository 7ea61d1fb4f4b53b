"""Zero-phase band-pass and notch filtering, chunk-parallel."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from pulsegrid.timeline import Timeline, in_groups, with_halo

NOTCH_HZ, NOTCH_Q = 60.0, 30.0


@dataclass(frozen=True)
class FilterSpec:
    """Notch followed by a Butterworth band-pass; ``sections`` filters as a cascade of second-order parts."""

    low_hz: float
    high_hz: float
    fs_hz: float
    order: int = 2
    sections: bool = False


def family_filter(family: str, fs_hz: float) -> FilterSpec:
    """The band of a recording family: slow for left/right, fast for jaw."""
    low, high = (1.0, 40.0) if family == "left_right" else (20.0, 100.0)
    return FilterSpec(low, min(high, fs_hz * 0.45), fs_hz)


def trial_filter(fs_hz: float) -> FilterSpec:
    return FilterSpec(0.5, 50.0, fs_hz)


def notch_coefficients(fs_hz: float) -> tuple[np.ndarray, np.ndarray]:
    w0 = 2 * math.pi * NOTCH_HZ / fs_hz
    gain = 1.0 / (1.0 + math.tan(w0 / NOTCH_Q / 2))
    b = gain * np.array([1.0, -2.0 * math.cos(w0), 1.0])
    return b, np.array([1.0, -2.0 * gain * math.cos(w0), 2.0 * gain - 1.0])


def bandpass_sections(spec: FilterSpec) -> list[tuple[np.ndarray, np.ndarray]]:
    """Butterworth band-pass as second-order parts, one conjugate pole pair each."""
    nyquist = spec.fs_hz / 2
    low, high = max(spec.low_hz / nyquist, 1e-5), min(spec.high_hz / nyquist, 0.99)
    if low >= high:
        raise ValueError(f"empty band {spec.low_hz}..{spec.high_hz} Hz at {spec.fs_hz} Hz")
    warp = lambda f: 4.0 * math.tan(math.pi * f / 2)
    w1, w2 = warp(low), warp(high)
    width, centre = w2 - w1, math.sqrt(w1 * w2)
    n = spec.order
    poles = []
    for k in range(n):
        p = np.exp(1j * math.pi * (2 * k + n + 1) / (2 * n)) * width / 2
        root = np.sqrt(p * p - centre * centre + 0j)
        poles += [p + root, p - root]
    z = np.array([(4.0 + p) / (4.0 - p) for p in poles])
    upper = sorted((p for p in z if p.imag > 0), key=lambda p: abs(p))
    sections = [(np.array([1.0, 0.0, -1.0]), np.array([1.0, -2 * p.real, abs(p) ** 2])) for p in upper]
    at = np.exp(1j * 2 * math.atan(centre / 4.0))
    gain = 1.0
    for b, a in sections:
        gain *= abs(np.polyval(b, at) / np.polyval(a, at))
    sections[0] = (sections[0][0] / gain, sections[0][1])
    return sections


def stages(spec: FilterSpec) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """Filter passes in order; each pass is a cascade that is run forward and backward on its own."""
    band = bandpass_sections(spec)
    if not spec.sections:
        b, a = np.array([1.0]), np.array([1.0])
        for sb, sa in band:
            b, a = np.convolve(b, sb), np.convolve(a, sa)
        band = [(b, a)]
    return [[notch_coefficients(spec.fs_hz)], band]


def settle_samples(spec: FilterSpec, tail: float = 1e-20) -> int:
    """Samples after which the memory of an unknown start has decayed below ``tail`` in every pass."""
    radius = max(abs(p) for cascade in stages(spec) for _, a in cascade for p in np.roots(a))
    return math.ceil(math.log(tail) / math.log(radius)) * 2


BLOCK = 128


def _operators(b: np.ndarray, a: np.ndarray) -> dict[str, np.ndarray]:
    """Matrices that advance a filter by a whole block of samples."""
    order = max(len(a), len(b)) - 1
    b = np.pad(b, (0, order + 1 - len(b))) / a[0]
    a = np.pad(a, (0, order + 1 - len(a))) / a[0]
    move = np.zeros((order, order))
    move[:, 0] = -a[1:]
    move[:-1, 1:] += np.eye(order - 1)
    feed = b[1:] - a[1:] * b[0]
    power = [np.eye(order)]
    for _ in range(BLOCK):
        power.append(move @ power[-1])
    see = np.array([p[0] for p in power[:BLOCK]])
    impulse = np.concatenate([[b[0]], see[: BLOCK - 1] @ feed])
    lag = np.subtract.outer(np.arange(BLOCK), np.arange(BLOCK))
    return {
        "power": np.array(power), "see": see, "toeplitz": np.where(lag >= 0, impulse[np.clip(lag, 0, None)], 0.0),
        "drive": np.array([power[BLOCK - 1 - i] @ feed for i in range(BLOCK)]).T,
        "steady": np.linalg.solve(np.eye(order) - move, feed), "gain": b.sum() / a.sum(),
    }


def _run(ops: dict[str, np.ndarray], x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Causal filter of the rows of ``x`` (channels by samples), a block of samples per matrix product."""
    out = np.empty_like(x)
    for at in range(0, x.shape[1], BLOCK):
        u = x[:, at: at + BLOCK]
        m = u.shape[1]
        out[:, at: at + m] = u @ ops["toeplitz"][:m, :m].T + state @ ops["see"][:m].T
        state = state @ ops["power"][m].T + u @ ops["drive"][:, BLOCK - m:].T
    return out


@dataclass(frozen=True)
class Pass:
    """A cascade that is run forward and backward, with its padding length."""

    parts: tuple[dict, ...]
    pad: int


def passes(spec: FilterSpec) -> list[Pass]:
    """Everything the tasks need, computed once on the driver."""
    out = []
    for parts in stages(spec):
        taps = max(max(len(a), len(b)) for b, a in parts)
        if len(parts) > 1:
            taps = 2 * len(parts) + 1 - min(sum(b[2] == 0 for b, _ in parts), sum(a[2] == 0 for _, a in parts))
        out.append(Pass(tuple(_operators(b, a) for b, a in parts), 3 * taps))
    return out


def zero_phase(x: np.ndarray, plan: Sequence[Pass]) -> np.ndarray:
    """Forward-backward filtering with odd extension at both ends; rows are channels."""
    for p in plan:
        pad = min(p.pad, x.shape[1] - 1)
        if pad > 0:
            head = 2 * x[:, :1] - x[:, pad:0:-1]
            tail = 2 * x[:, -1:] - x[:, -2: -pad - 2: -1]
            x = np.concatenate([head, x, tail], axis=1)
        x = _one_way(p.parts, x)
        x = _one_way(p.parts, x[:, ::-1])[:, ::-1]
        x = x[:, pad: x.shape[1] - pad] if pad > 0 else x
    return x


def _one_way(parts: Sequence[dict], x: np.ndarray) -> np.ndarray:
    level = x[:, :1].copy()
    for ops in parts:
        x = _run(ops, np.ascontiguousarray(x), level * ops["steady"][None, :])
        level = level * ops["gain"]
    return x


def zero_phase_filter(samples: DataFrame, tl: Timeline, channels: Sequence[str], spec: FilterSpec) -> DataFrame:
    """Filter channels per series; missing values count as 0, the median of centred signals.

    A chunk is filtered together with enough rows on both sides for the filters to forget where they
    started, so chunks are independent; only true series ends are extended. With trial keys in the
    timeline every trial is filtered on its own.
    """
    halo, plan = settle_samples(spec), passes(spec)
    keep = [c for c in samples.columns if c not in channels]
    chans, pos = list(channels), tl.pos
    rows = with_halo(samples.fillna(0.0, chans), tl, halo, halo)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.schema if f.name in keep)
    schema += "".join(f", `{c}` double" for c in chans)

    def run(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        core = pdf["_core"].to_numpy(dtype=bool)
        x = pdf[chans].to_numpy(dtype=float).T
        y = np.empty(x.shape)
        for a, b in zip(starts, [*starts[1:], len(pdf)]):
            if core[a:b].any():
                y[:, a:b] = zero_phase(x[:, a:b], plan)
        out = pdf.loc[core, keep].copy()
        for i, c in enumerate(chans):
            out[c] = y[i, core]
        return out

    return in_groups(rows, [*tl.keys, "_chunk"], pos, run, schema)
