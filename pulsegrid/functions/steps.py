"""Step rules of the sequential detectors.

Each rule takes a small JSON-able state and the next ordered values and returns the new state, so the
batch runner (per chunk) and the streams (per micro-batch) share one definition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np

NEVER = float("-inf")

# Default settings of the detectors.
ADAPTIVE = {
    "limit": 200.0, "creep_up": 0.9, "creep_down": 0.99999, "min_delta": 10.0, "lower_min": 6.0,
    "lower_start": 6.0, "upper_start": 16.0, "smoothing": 0.9,
}
HOLD = {"threshold": 0.70, "onset_sec": 0.45, "release_sec": 0.18}
LATCH = {"latch_sec": 0.45, "cooldown_sec": 0.20}
DECODER = {
    "enter": 0.7, "exit": 0.55, "k": 3, "cooldown": 4, "majority": 3, "votes": 2, "min_confidence": 0.6, "margin": 0.1, "streak": 1,
}


def click_step(state: Mapping, at: float, pos: float, rearmed_pos: float | None, block_ms: float, suppress: bool) -> tuple[dict, bool]:
    """Accept a candidate click unless it is too soon or the trigger has not re-armed since the last click."""
    last_at, last_pos = state.get("at", NEVER), state.get("pos", NEVER)
    cooling = (at - last_at) * 1000.0 < block_ms
    waiting = suppress and last_pos != NEVER and not (rearmed_pos is not None and rearmed_pos > last_pos)
    if cooling or waiting:
        return dict(state), False
    return {"at": at, "pos": pos}, True


def hold_step(state: Mapping, at: float, engaged: bool, clicked: bool, cfg: Mapping = HOLD) -> tuple[dict, list[str]]:
    """Sustained engagement starts a hold, sustained release ends it; clicks count only outside a hold."""
    held, since, released = state.get("held", False), state.get("since"), state.get("released")
    actions = ["CLICK"] if clicked and not held else []
    if engaged:
        since, released = (at if since is None else since), None
        if not held and at - since >= cfg["onset_sec"]:
            held = True
            actions.append("HOLD_START")
    else:
        since = None
        if not held:
            released = None
        elif released is None:
            released = at
        elif at - released >= cfg["release_sec"]:
            held, released = False, None
            actions.append("HOLD_END")
    return {"held": held, "since": since, "released": released}, actions


def latch_step(state: Mapping, at: float, label: str | None, cfg: Mapping = LATCH) -> tuple[dict, bool, str]:
    """Show a detected direction for the latch time; a quick change of direction is refused.

    Returns the state, whether a detection was taken, and the direction shown at this time.
    """
    side, until, switched = state.get("side", "NEUTRAL"), state.get("until", NEVER), state.get("switched", NEVER)
    taken = False
    if label in ("LEFT", "RIGHT"):
        opposite = side in ("LEFT", "RIGHT") and side != label
        if not (opposite and at - switched < cfg["cooldown_sec"]):
            side, until, switched, taken = label, at + cfg["latch_sec"], at, True
    if at > until:
        side = "NEUTRAL"
    return {"side": side, "until": until, "switched": switched}, taken, side


def _since(last_false: np.ndarray, carried: int) -> np.ndarray:
    """Lengths of runs of true values; a run open at the start already counts ``carried``."""
    i = np.arange(len(last_false))
    last = np.maximum.accumulate(np.where(last_false, i, -1))
    return np.where(last < 0, i + 1 + carried, i - last)


def decode(p_active: np.ndarray, directions: np.ndarray, cfg: Mapping = DECODER, state: Mapping | None = None, block: int = 256) -> tuple[list[str | None], dict]:
    """Commands of a decoder over consecutive windows, and the state to go on from.

    Between commands the rule is a few array expressions over the free windows: the gate is the last decisive window
    (entered or left), a streak is a run of one direction under the open gate, and a command falls on the first window
    where the gate has been open for ``k`` windows and enough of the last ``majority`` votes stand (the commonest one,
    by name on ties). Only the rest of ``cooldown`` windows after a command, in which nothing counts, is sequential.
    """
    s = {"rest": 0, "gate": False, "open": 0, "last": None, "streak": 0, "votes": []} | dict(state or {})
    n, at = len(p_active), 0
    commands: list[str | None] = [None] * n
    names = sorted({d for d in directions if isinstance(d, str)} | {v for v in s["votes"] if v})
    code = {d: k for k, d in enumerate(names)}
    calls = np.array([code.get(d, -1) if isinstance(d, str) else -1 for d in directions], dtype=int)
    memory = cfg["majority"] - 1
    past = [code[v] if v else -1 for v in s["votes"]][-memory:] if memory else []
    past = np.array([-1] * (memory - len(past)) + past, dtype=int)
    while at < n:
        if s["rest"]:
            skip = min(s["rest"], n - at)
            past = np.concatenate([past, np.full(skip, -1)])[len(past) + skip - memory:]
            at, s = at + skip, s | {"rest": s["rest"] - skip, "gate": False, "open": 0, "last": None, "streak": 0}
            continue
        p, call = p_active[at : at + block], calls[at : at + block]
        decisive = np.where(p >= cfg["enter"], 1, np.where(p < cfg["exit"], -1, 0))
        latest = np.maximum.accumulate(np.where(decisive != 0, np.arange(len(p)), -1))
        gate = np.where(latest < 0, s["gate"], decisive[latest] == 1)
        opened = _since(~gate, s["open"]) * gate
        heard = gate & (call >= 0)
        before = np.concatenate([[code.get(s["last"], -1)], np.where(heard, call, -1)[:-1]])
        fresh = ~heard | (call != before)
        # a fresh direction starts a run of its own, so count from the window before it
        streak = np.where(heard, _since(fresh, s["streak"]) + np.where(np.maximum.accumulate(fresh), 1, 0), 0)
        votes = np.where(heard & (streak >= cfg["streak"]), call, -1)
        recent = np.lib.stride_tricks.sliding_window_view(np.concatenate([past, votes]), cfg["majority"])
        hits = np.flatnonzero((opened >= cfg["k"]) & ((recent >= 0).sum(1) >= cfg["votes"]) & (recent >= 0).any(1))
        end = int(hits[0]) if len(hits) else len(p) - 1
        past = np.concatenate([past, votes[: end + 1]])[len(past) + end + 1 - memory:]
        if len(hits):
            commands[at + end] = names[int(np.bincount(recent[end][recent[end] >= 0]).argmax())]
            s |= {"rest": cfg["cooldown"], "gate": False, "open": int(opened[end]), "last": None, "streak": 0}
        else:
            last = names[call[end]] if heard[end] else None
            s |= {"gate": bool(gate[end]), "open": int(opened[end]), "last": last, "streak": int(streak[end])}
        at += end + 1
    return commands, s | {"votes": [names[v] if v >= 0 else None for v in past]}


def decode_many(p_active: np.ndarray, calls: np.ndarray, starts: np.ndarray, configs: Sequence[Mapping], which: Sequence[int], names: int,
                state: Mapping | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
    """`decode` for many series and settings in step: window by window, all series that still have one, all settings.

    Series stand one after another, each from ``starts`` on. ``calls`` holds one column of direction codes (-1: none) per
    pair of confidence settings, ``which`` the column of each setting. Returns row, setting and direction of every command
    and the state after the last series; ``state`` is the one before the first.
    """
    setting = {k: np.array([c[k] for c in configs]) for k in ("enter", "exit", "k", "cooldown", "votes", "streak", "majority")}
    sizes = np.diff(np.append(starts, len(p_active)))
    order = np.argsort(-sizes, kind="stable")
    n, c, depth = len(sizes), len(configs), max(int(setting["majority"].max()), 2)
    counted = np.arange(depth)[None, :] >= depth - setting["majority"][:, None]  # how far back a setting looks
    blank = {"rest": 0, "gate": False, "open": 0, "last": -1, "streak": 0}
    s = {k: np.full((n, c), v, dtype=bool if k == "gate" else np.int32) for k, v in blank.items()}
    past = np.full((n, c, depth), -1, dtype=np.int8)
    if state:
        first = int(np.flatnonzero(order == 0)[0])
        for k in s:
            s[k][first] = state[k]
        past[first] = np.array(state["past"], dtype=np.int8)
    hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    alive = np.searchsorted(-sizes[order], -np.arange(int(sizes.max())), side="left") if n else []
    for t, m in enumerate(alive):  # the m longest series have a window t
        row = starts[order[:m]] + t
        p, call = p_active[row][:, None], calls[row][:, which]
        resting = s["rest"][:m] > 0
        gate = np.where(p >= setting["enter"], True, np.where(p < setting["exit"], False, s["gate"][:m])) & ~resting
        opened = np.where(gate, s["open"][:m] + 1, 0)
        heard = gate & (call >= 0)
        streak = np.where(heard, np.where(call == s["last"][:m], s["streak"][:m] + 1, 1), 0)
        vote = np.where(heard & (streak >= setting["streak"]), call, -1)
        past[:m, :, :-1] = past[:m, :, 1:]
        past[:m, :, -1] = vote
        stands = (past[:m] >= 0) & counted
        votes = stands.sum(2)
        fires = (opened >= setting["k"]) & (votes >= setting["votes"]) & (votes > 0)
        if fires.any():
            a, b = np.nonzero(fires)
            held = np.where(stands[a, b], past[a, b], -1)
            hits.append((row[a], b, np.argmax(np.stack([(held == x).sum(1) for x in range(names)], 1), 1)))
        s["rest"][:m] = np.where(fires, setting["cooldown"], np.maximum(s["rest"][:m] - 1, 0))
        s["gate"][:m] = gate & ~fires
        s["open"][:m] = opened
        s["last"][:m] = np.where(heard & ~fires, call, -1)
        s["streak"][:m] = np.where(fires, 0, streak)
    found = [np.concatenate(x) for x in zip(*hits)] if hits else [np.zeros(0, dtype=np.int64)] * 3
    end = int(np.flatnonzero(order == n - 1)[0]) if n else 0
    after = {**{k: v[end].tolist() for k, v in s.items()}, "past": past[end].tolist()} if n else dict(state or {})
    by = np.lexsort((found[1], found[0]))
    return found[0][by], found[1][by], found[2][by], after


def threshold_step(lower: float, upper: float, average: float, cfg: Mapping = ADAPTIVE) -> tuple[float, float, float]:
    """Creeping lower and upper thresholds around a moving average, and the normalised output."""
    if upper <= average <= cfg["limit"]:
        upper = average
    lower = min(lower, average)
    if average + cfg["min_delta"] <= upper:
        upper *= cfg["creep_up"]
    lower = max(lower, 1.0)
    if lower <= average:
        lower /= cfg["creep_down"]
    lower = max(lower, cfg["lower_min"])
    upper = max(upper, lower + cfg["min_delta"])
    return lower, upper, max(0.0, (average - lower) / (upper - lower))


def match_step(used: Sequence[float], reference: float, clicks: Sequence[float], pre: float) -> tuple[list[float], float | None]:
    """Nearest unused click of one reference (the earlier on ties); remembers only clicks later references can reach."""
    taken = set(used)
    best = min((c for c in clicks if c not in taken), key=lambda c: (abs(c - reference), c), default=None)
    if best is not None:
        taken.add(best)
    return sorted(c for c in taken if c >= reference - pre), best
