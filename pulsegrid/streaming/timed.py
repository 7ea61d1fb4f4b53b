"""Event-time state: rows handled in time order, timers that fire without a later row, and a watermark.

``run_timed`` puts one machine per session on a stream. A row waits in list state until the watermark has passed its
time; then the rows of the session are handled in the order of time and position, so rows that arrive late but inside the
watermark count like any other, however the input is cut into files. Repeated rows are handled once. A machine keeps its
memory as typed state and may name the next time at which something is due: that is an event-time timer, which fires as
soon as the watermark passes it, also if the session never sends another row. Rows behind the watermark are dropped by
Spark and counted in the query's progress (`dropped_rows`).

The output carries the event time, so these operators can follow one another in one query.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from pulsegrid.functions import steps as st
from pulsegrid.operators import machines as mc

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MICROS = 1_000_000
Row = dict[str, object]
PLACE = [T.StructField(n, T.LongType()) for n in ("at", "pos", "last")]
TIMER = T.StructType([T.StructField("timer", T.LongType())])


class Machine:
    """A rule over ordered rows. ``memory`` names its saved fields, ``start`` their first values, ``out`` its output columns.

    Times (``at``) are whole microseconds. Output rows are dicts with ``at`` and the columns of ``out``.
    """

    memory: str
    start: tuple
    out: str

    def row(self, memory: tuple, row: Row) -> tuple[tuple, list[Row]]:
        """Handle one row."""
        raise NotImplementedError

    def due(self, memory: tuple) -> int | None:
        """When `ring` is to be called unless a row comes first; a row at that very time comes first."""
        return None

    def ring(self, memory: tuple, at: int) -> tuple[tuple, list[Row]]:
        raise NotImplementedError

    def block(self, memory: tuple, rows: list[Row], upto: int) -> tuple[tuple, list[Row]]:
        """Handle ordered rows and whatever is due between them and before ``upto``."""
        out: list[Row] = []
        for row in rows:
            memory = self._rings(memory, row["at"], out)
            memory, more = self.row(memory, row)
            out += more
        return self._rings(memory, upto, out), out

    def _rings(self, memory: tuple, before: int, out: list[Row]) -> tuple:
        while (at := self.due(memory)) is not None and at < before:
            memory, more = self.ring(memory, at)
            out += more
        return memory


def _plain(kind: T.DataType, value: object) -> object:
    """A value read from state as tuples and lists: Spark reads structs as ``Row`` and cannot write one that lies in a list back."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(_plain(f.dataType, v) for f, v in zip(kind, value))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        return [_plain(kind.elementType, v) for v in value]
    return value


class _Processor(StatefulProcessor):
    """The sessions of one bucket: their waiting rows, what each remembers, and the earliest time at which one is due."""

    def __init__(self, machine: Machine, keys: Sequence[str], pos: str, fields: T.StructType, names: Sequence[str], idle: int | None):
        self.machine, self.keys, self.pos, self.fields, self.names, self.idle = machine, list(keys), pos, fields, list(names), idle
        # a session: its key, the last handled (time, position), when its last row came, the machine's memory
        key = T.StructType([f for f in fields if f.name in self.keys])
        self.memory = T._parse_datatype_string(machine.memory)  # needs the driver's session
        session = T.StructType([T.StructField("key", key), *PLACE, T.StructField("memory", self.memory)])
        self.shape = T.StructType([T.StructField("sessions", T.ArrayType(session))])

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.fields)
        self.sessions = handle.getValueState("sessions", self.shape)
        self.timer = handle.getValueState("timer", TIMER)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        columns = [frame[f.name].tolist() for f in self.fields]
        new = [tuple(None if v != v else v for v in r) for r in zip(*columns)]
        self.waiting.appendList(new)
        first, old = int(frame["at"].min()) // 1000, self.timer.get()
        if old is None or first < old[0]:
            if old is not None:
                self.handle.deleteTimer(old[0])
            self.handle.registerTimer(first)
            self.timer.update((first,))
        return iter(())

    def _session(self, at: int | None, pos: int | None, last: int | None, memory: tuple, rows: list[Row], reached: int) -> tuple[tuple, list[Row]]:
        """Handle the rows of a session up to ``reached``, each once, and whatever is due by then."""
        order = lambda r: (r["at"], r[self.pos])
        ready, seen = [], None if at is None else (at, pos)
        for r in sorted(rows, key=order):
            if seen is None or order(r) > seen:
                ready.append(r)
                seen = order(r)
        if rows:
            last = max(r["at"] for r in rows) if last is None else max(last, max(r["at"] for r in rows))
        memory, out = self.machine.block(memory, ready, reached + 1)
        return (*(seen or (None, None)), last, memory), out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        reached = timerValues.getCurrentWatermarkInMs() * 1000 + 999  # a millisecond is handled whole
        names = self.fields.fieldNames()
        which, when = [names.index(k) for k in self.keys], names.index("at")
        ready, later = {}, []
        for r in self.waiting.get() if self.waiting.exists() else ():
            if r[when] <= reached:
                ready.setdefault(tuple(r[i] for i in which), []).append(dict(zip(names, r)))
            else:
                later.append(tuple(r))
        waits = {tuple(r[i] for i in which) for r in later}
        saved = self.sessions.get()
        known = {tuple(s[0]): (*s[1:4], _plain(self.memory, s[4])) for s in (saved[0] if saved else ())}
        out, owners, marks, keep = [], [], [r[when] for r in later], []
        for session in {**known, **ready}:
            state = known.get(session, (None, None, None, self.machine.start))
            rows, due = ready.get(session, []), self.machine.due(state[3])
            if rows or (due is not None and due <= reached):
                state, more = self._session(*state, rows, reached)
                out += more
                owners += [session] * len(more)
                due = self.machine.due(state[3])
            forget = state[2] + self.idle if self.idle is not None and session not in waits else None
            if due is None and forget is not None and forget <= reached:
                continue
            marks += [t for t in (due, forget) if t is not None]
            keep.append((session, *state))
        if keep:
            self.sessions.update((keep,))
        else:
            self.sessions.clear()
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        if marks:
            wake = max(min(marks) // 1000, reached // 1000 + 1)
            self.handle.registerTimer(wake)
            self.timer.update((wake,))
        else:
            self.timer.clear()
        if out:
            at = pd.Series([r["at"] for r in out])
            keys = {k: pd.Series([o[i] for o in owners], dtype=object) for i, k in enumerate(self.keys)}
            rest = [n for n in self.names if n not in (*keys, "ts", "at")]
            columns = {"ts": pd.to_datetime(at, unit="us", utc=True), "at": at, **keys, **{n: pd.Series([r.get(n) for r in out], dtype=object) for n in rest}}
            yield pd.DataFrame({n: columns[n] for n in self.names})

    def close(self) -> None:
        pass


def micros(ts: str | Column) -> Column:
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def run_timed(stream: DataFrame, keys: Sequence[str], pos: str, machine: Machine, delay: str | None = None, ts: str = "ts", idle_sec: float | None = None, buckets: int = 1024) -> DataFrame:
    """Keys, ``ts``, ``at`` and the machine's columns. ``pos`` orders rows of equal time and, with it, tells repeated rows.

    Sessions share state in ``buckets`` by their hash, because a call of the state store and a frame cost far more than a row.
    Take more buckets for more sessions than some thousand each.

    ``delay`` sets the watermark; leave it out if the stream already has one (after another timed operator). A session
    without rows for ``idle_sec`` of event time, and with nothing due, is forgotten. Rows without a time or a position
    are left out.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = stream.withWatermark(ts, delay) if delay else stream
    rows = rows.where(F.col(ts).isNotNull() & F.col(pos).isNotNull()).withColumn("at", micros(ts)).withColumn(pos, F.col(pos).cast("bigint"))
    fields = T.StructType([f for f in rows.schema if f.name != ts])
    out = T.StructType([*[f for f in rows.schema if f.name in keys], T.StructField("ts", T.TimestampType()), T.StructField("at", T.LongType()), *T._parse_datatype_string(machine.out)])
    processor = _Processor(machine, keys, pos, fields, out.fieldNames(), None if idle_sec is None else round(idle_sec * MICROS))
    # keys with a NULL have buckets of their own: a frame would turn whole numbers beside a NULL into floats
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets))
    nulls = sum((F.col(k).isNull().cast("bigint") * (1 << i) for i, k in enumerate(keys)), F.lit(0).cast("bigint"))
    return rows.withColumn("_bucket", bucket + nulls * buckets).groupBy("_bucket").transformWithStateInPandas(processor, out, "append", "EventTime", None, "ts")


def dropped_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark, over the batches that the query remembers."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def _micros_of(cfg: Mapping) -> dict:
    """Settings in seconds as whole microseconds."""
    return {k: round(v * MICROS) if k.endswith("_sec") else v for k, v in cfg.items()}


class Hold(Machine):
    """Clicks and holds of rows that carry engaged and clicked."""

    memory = "held boolean, since bigint, released bigint"
    start = (False, None, None)
    out = "pos bigint, action string"

    def __init__(self, pos: str, cfg: Mapping = st.HOLD):
        self.pos, self.cfg = pos, _micros_of(cfg)

    def row(self, memory, row):
        state, actions = st.hold_step(dict(zip(("held", "since", "released"), memory)), row["at"], bool(row["engaged"]), bool(row["clicked"]), self.cfg)
        return (state["held"], state["since"], state["released"]), [{"at": row["at"], "pos": row[self.pos], "action": a} for a in actions]


def latch(memory: tuple, at: int, label: str | None, cfg: Mapping) -> tuple[tuple, bool, str]:
    """`steps.latch_step` over saved fields (side, until, switched), where null stands for never."""
    side, until, switched = memory
    state = {"side": side, "until": st.NEVER if until is None else until, "switched": st.NEVER if switched is None else switched}
    state, taken, shown = st.latch_step(state, at, label, cfg)
    saved = lambda x: None if x == st.NEVER else x
    return (state["side"], saved(state["until"]), saved(state["switched"])), taken, shown


class Latch(Machine):
    """Directions shown for a while. Every row gives a row; the end of a latch gives one of its own (``expired``)."""

    memory = "side string, until bigint, switched bigint"
    start = ("NEUTRAL", None, None)
    out = "pos bigint, label string, taken boolean, shown string, expired boolean"

    def __init__(self, pos: str, cfg: Mapping = st.LATCH):
        self.pos, self.cfg = pos, _micros_of(cfg)

    def row(self, memory, row):
        memory, taken, shown = latch(memory, row["at"], row["label"], self.cfg)
        return memory, [{"at": row["at"], "pos": row[self.pos], "label": row["label"], "taken": taken, "shown": shown, "expired": False}]

    def due(self, memory):
        return memory[1] if memory[0] != "NEUTRAL" else None

    def ring(self, memory, at):
        return ("NEUTRAL", memory[1], memory[2]), [{"at": at, "pos": None, "label": None, "taken": False, "shown": "NEUTRAL", "expired": True}]


class Stale(Machine):
    """A flag when a session has sent nothing for ``gap_sec``, and one when it sends again."""

    memory = "last bigint, stale boolean"
    start = (None, False)
    out = "stale boolean, silent_us bigint"

    def __init__(self, gap_sec: float):
        self.gap = round(gap_sec * MICROS)

    def row(self, memory, row):
        last, stale = memory
        back = [{"at": row["at"], "stale": False, "silent_us": row["at"] - last}] if stale else []
        return (row["at"], False), back

    def due(self, memory):
        return memory[0] + self.gap if memory[0] is not None and not memory[1] else None

    def ring(self, memory, at):
        return (memory[0], True), [{"at": at, "stale": True, "silent_us": self.gap}]


class Warmup(Machine):
    """Rows from ``warmup_sec`` after the session's first row on; no decisions before the buffers are filled."""

    memory = "first bigint"
    start = (None,)
    out = "pos bigint, since_us bigint"

    def __init__(self, pos: str, window_sec: float, smoothing_sec: float):
        self.pos, self.least = pos, round(max(1.0, window_sec, smoothing_sec) * MICROS)

    def row(self, memory, row):
        first = row["at"] if memory[0] is None else memory[0]
        since = row["at"] - first
        return (first,), [{"at": row["at"], "pos": row[self.pos], "since_us": since}] if since >= self.least else []


class Peaks(Machine):
    """Peaks of at least ``prominence``, each as soon as it is sure and ``confirm`` later samples have come.

    The falling staircase of earlier samples is a stack: a new sample takes off the lower steps, so a sample costs
    constant time on average. A step knows the lowest sample since the last higher one. A top whose left ground is low
    enough stays open until the ground on its right has fallen by the prominence too; open tops fall in height, so the
    first ones become sure first, and a top that is taken off the stack before is none. That is the batch rule, where
    ground ends at a higher sample or at the end of the series.
    """

    memory = ("heights array<double>, lows array<double>, tops array<struct<step:bigint,place:bigint,count:bigint>>, "
              "sure array<struct<place:bigint,value:double,count:bigint>>, last double, flat_from bigint, flat_to bigint, rising boolean, n bigint")
    start = ([], [], [], [], None, None, None, False, 0)
    out = "peak_pos bigint, peak_value double, emitted_pos bigint"

    def __init__(self, pos: str, value: str, prominence: float, confirm: int = 0):
        self.pos, self.value, self.prominence, self.confirm = pos, value, prominence, confirm

    def block(self, memory, rows, upto):
        heights, lows, tops, sure, last, flat_from, flat_to, rising, n = memory
        heights, lows, tops, sure = list(heights), list(lows), deque(tuple(t) for t in tops), [tuple(x) for x in sure]
        out = []
        for row in rows:
            place, v = row[self.pos], float(row[self.value])
            n += 1
            if last is not None and v < last and rising and last - lows[-1] >= self.prominence:
                tops.append((len(heights) - 1, (flat_from + flat_to) // 2, n - 1))
            if v == last:
                flat_from, flat_to = min(flat_from, place), max(flat_to, place)  # a plateau is one step; positions may not rise with time
            else:
                rising, flat_from, flat_to, low = last is not None and v > last, place, place, v
                while heights and heights[-1] < v:
                    low = min(low, lows.pop())
                    heights.pop()
                    if tops and tops[-1][0] == len(heights):
                        tops.pop()
                if heights and heights[-1] == v:
                    low = min(low, lows[-1])
                heights.append(v)
                lows.append(low)
            last = v
            while tops and heights[tops[0][0]] - v >= self.prominence:
                step, at, count = tops.popleft()
                sure.append((at, heights[step], count))
            ready = [p for p in sure if n - p[2] >= self.confirm]
            if ready:
                sure = [p for p in sure if n - p[2] < self.confirm]
                out += [{"at": row["at"], "peak_pos": p[0], "peak_value": p[1], "emitted_pos": place} for p in ready]
        return (heights, lows, list(tops), sure, last, flat_from, flat_to, rising, n), out


class Clicks(Machine):
    """The click trigger of one setting, by the candidate rule of the batch form. Rows carry state and the score columns.

    Smoothing runs over the carried tail and the new rows at once; only the candidates go through the cooldown one by one.
    Whether the trigger has re-armed since the last click is told by the number of a row, since positions may not rise with time.
    """

    memory = "tail array<array<double>>, label string, n bigint, rearmed bigint, at bigint, clicked bigint"
    start = ([], "INACTIVE", 0, None, None, None)
    out = "pos bigint, reason string"

    def __init__(self, pos: str, cfg: Mapping):
        self.pos, self.cfg = pos, dict(cfg)

    def block(self, memory, rows, upto):
        if not rows:
            return memory, []
        tail, label, n, rearmed, last_at, clicked = memory
        k, old = self.cfg["k"], len(tail)
        scores = np.array([*[list(t) for t in tail], *[[float(r[s]) for s in mc.SCORES] for r in rows]])
        upto_row = np.arange(old, len(scores))
        mean = lambda end: np.array([scores[max(0, e - k + 1) : e + 1].mean(axis=0) if e >= 0 else np.zeros(scores.shape[1]) for e in end])
        now, before = mean(upto_row), mean(upto_row - 1)
        state = np.array([r["state"] for r in rows], dtype=object)
        calm = np.isin(state, mc.CALM)
        calm_before = np.concatenate([[label in mc.CALM], calm[:-1]])
        at = {s: i for i, s in enumerate(mc.SCORES)}
        rules = mc.candidate_rules(self.cfg, lambda s: now[:, at[s]], lambda s: before[:, at[s]], np.isin(state, mc.LIVELY), calm_before)
        reason = np.full(len(rows), None, dtype=object)
        for name, fires in reversed(rules):
            reason[fires] = name
        low = (now[:, at["clench"]] <= self.cfg["rearm"]) & (calm if self.cfg["from_rest"] else True)
        trigger = {} if last_at is None else {"at": last_at / MICROS, "pos": clicked}
        out = []
        for i, row in enumerate(rows):
            if low[i]:
                rearmed = n + i
            if reason[i] is not None:
                trigger, taken = st.click_step(trigger, row["at"] / MICROS, n + i, rearmed, float(self.cfg["block_ms"]), True)
                if taken:
                    last_at, clicked = row["at"], n + i
                    out.append({"at": row["at"], "pos": row[self.pos], "reason": reason[i]})
        return (scores[-k:].tolist(), state[-1], n + len(rows), rearmed, last_at, clicked), out


class Tail(Machine):
    """Features of the newest ``length`` samples every ``hop`` samples, of signals filtered as they come.

    ``sections`` are second-order parts of a causal filter; what they remember of the past is two numbers a section and
    channel, kept as state, so the filtered signal does not depend on how the input is cut. Features per channel: mean,
    std, rms, and the power of each band over one Hann-weighted segment, as the batch spectrum has it.
    """

    memory = "seen bigint, tail array<array<double>>, delays array<double>"
    start = (0, [], [])

    def __init__(self, pos: str, channels: Sequence[str], length: int, hop: int, fs: float = 1.0, sections: Sequence = (), bands: Mapping[str, tuple[float, float]] | None = None):
        self.pos, self.channels, self.length, self.hop, self.fs = pos, list(channels), length, hop, fs
        self.sections, self.bands = [(np.asarray(b, float) / a[0], np.asarray(a, float) / a[0]) for b, a in sections], dict(bands or {})
        names = [f"{c}_{s}" for s in ("mean", "std", "rms", *[f"{b}_power" for b in self.bands]) for c in self.channels]
        self.names = [*names, "aggregate_rms"]
        self.out = "window_start bigint, last_pos bigint, " + ", ".join(f"`{n}` double" for n in self.names)

    def _features(self, x: np.ndarray) -> list[float]:
        energy = np.sqrt((x * x).mean(axis=0))
        out = [*x.mean(axis=0), *x.std(axis=0), *energy]
        if self.bands:
            n = len(x)
            hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
            power = np.abs(np.fft.rfft((x - x.mean(axis=0)) * hann[:, None], axis=0)) ** 2 / (self.fs * (hann**2).sum())
            power[1 : (n + 1) // 2] *= 2
            freq = np.arange(n // 2 + 1) * self.fs / n
            out += [v for lo, hi in self.bands.values() for v in power[(freq >= lo) & (freq <= hi)].sum(axis=0)]
        return [float(v) for v in (*out, energy.mean())]

    def block(self, memory, rows, upto):
        if not rows:
            return memory, []
        seen, tail, delays = memory
        x = np.array([[float(r[c]) if r[c] is not None else 0.0 for c in self.channels] for r in rows])
        z = np.array(delays, dtype=float).reshape(len(self.sections), 2, -1) if delays else np.zeros((len(self.sections), 2, x.shape[1]))
        z = [[a.copy() for a in pair] for pair in z]
        for t in range(len(x)):
            v = x[t]
            for (b, a), memo in zip(self.sections, z):
                y = b[0] * v + memo[0]
                memo[0], memo[1] = b[1] * v - a[1] * y + memo[1], b[2] * v - a[2] * y
                v = y
            x[t] = v
        whole = np.concatenate([np.array([list(t) for t in tail], dtype=float).reshape(-1, x.shape[1]), x])
        first, out = seen - len(tail), []
        start = -(-max(seen - self.length + 1, 0) // self.hop) * self.hop
        while start + self.length <= seen + len(x):
            end = rows[start + self.length - 1 - seen]
            values = self._features(whole[start - first : start - first + self.length])
            out.append({"at": end["at"], "window_start": start, "last_pos": end[self.pos], **dict(zip(self.names, values))})
            start += self.hop
        return (seen + len(x), whole[-(self.length - 1):].tolist() if self.length > 1 else [], np.array(z).ravel().tolist()), out


class Calibrate(Machine):
    """Mean and spread of the features over the first ``seconds`` of a session, then standardised rows.

    Rows of the calibration time come out as not ready, with null features. ``uncalibrated`` marks the rows of a session
    that sent no feature row in that time: they stay not ready. ``keep`` names double columns to carry along. Time counts from ``session_start_us`` of the row if it has
    one, else from the session's first row here.
    """

    start = (None, 0, [], [])
    memory = "first bigint, n bigint, sums array<double>, squares array<double>"

    def __init__(self, pos: str, features: Sequence[str], seconds: float, keep: Sequence[str] = ()):
        self.pos, self.features, self.span, self.keep = pos, list(features), round(seconds * MICROS), list(keep)
        self.out = "pos bigint, ready boolean, uncalibrated boolean, " + ", ".join(f"`{f}` double" for f in [*[f"{f}_z" for f in self.features], *self.keep])

    def row(self, memory, row):
        first, n, sums, squares = memory
        first = row.get("session_start_us", row["at"]) if first is None else first
        x = [row[f] for f in self.features]
        early = row["at"] - first < self.span
        if early and None not in x:
            n, sums = n + 1, [a + b for a, b in zip(sums or [0.0] * len(x), x)]
            squares = [a + b * b for a, b in zip(squares or [0.0] * len(x), x)]
        ready = not early and n > 0
        z = [None] * len(x)
        if ready:
            mean = [s / n for s in sums]
            spread = [np.sqrt(max(q / n - m * m, 0.0)) or 1.0 for q, m in zip(squares, mean)]
            z = [None if v is None else float((v - m) / d) for v, m, d in zip(x, mean, spread)]
        out = {"at": row["at"], "pos": row[self.pos], "ready": ready, "uncalibrated": not early and n == 0, **{f"{f}_z": v for f, v in zip(self.features, z)}, **{c: row[c] for c in self.keep}}
        return (first, n, sums, squares), [out]


class Control(Machine):
    """The decoder's last step: holds of the jaw, latched directions of the hand, and the state that they show together.

    Rows carry ready, engaged, clicked, event (a hand event was confirmed here), label (LEFT or RIGHT), agreed (confident
    and clear of the runner-up) and confidence. Every row gives one row with its actions; a latch that ends gives one too.
    """

    memory = "held boolean, since bigint, released bigint, side string, until bigint, switched bigint"
    start = (False, None, None, "NEUTRAL", None, None)
    out = "pos bigint, actions string, accepted boolean, hand string, decoded string, confidence double"

    def __init__(self, pos: str, hold: Mapping = st.HOLD, hand: Mapping = st.LATCH):
        self.pos, self.hold, self.hand = pos, _micros_of(hold), _micros_of(hand)

    def row(self, memory, row):
        jaw, actions = st.hold_step(dict(zip(("held", "since", "released"), memory[:3])), row["at"], bool(row["engaged"]), bool(row["clicked"]), self.hold)
        wanted = row["label"] if row["ready"] and row["event"] and row["agreed"] else None
        hand, taken, shown = latch(memory[3:], row["at"], wanted, self.hand)
        if row["ready"] and row["event"]:
            actions = [*actions, row["label"]]
        out = {"at": row["at"], "pos": row[self.pos], "actions": " ".join(actions) or None, "accepted": taken, "hand": shown,
               "decoded": decoded_state(jaw["held"], "CLICK" in actions, shown), "confidence": row["confidence"]}
        return (jaw["held"], jaw["since"], jaw["released"], *hand), [out]

    def due(self, memory):
        return memory[4] if memory[3] != "NEUTRAL" else None

    def ring(self, memory, at):
        out = {"at": at, "pos": None, "actions": "EXPIRED", "accepted": False, "hand": "NEUTRAL", "decoded": decoded_state(memory[0], False, "NEUTRAL"), "confidence": None}
        return (*memory[:3], "NEUTRAL", *memory[4:]), [out]


def decoded_state(held: bool, clicked: bool, hand: str) -> str:
    """What the decoder shows: the jaw before the hand, NEUTRAL for neither."""
    parts = ["CLICK_HOLD"] if held else ["CLICK"] if clicked else []
    return " | ".join([*parts, *([hand] if hand in ("LEFT", "RIGHT") else [])]) or "NEUTRAL"


class Adaptive(Machine):
    """Moving averages, creeping thresholds and normalised output per channel, and the smoothed direction."""

    def __init__(self, pos: str, channels: Sequence[str], width: int, cfg: Mapping = st.ADAPTIVE, left: Sequence[str] = (), right: Sequence[str] = ()):
        self.pos, self.channels, self.width, self.cfg, self.left, self.right = pos, list(channels), width, dict(cfg), list(left), list(right)
        self.memory = "tails array<array<double>>, lower array<double>, upper array<double>, x double"
        self.start = ([[] for _ in channels], [cfg["lower_start"]] * len(self.channels), [cfg["upper_start"]] * len(self.channels), 0.0)
        self.out = "pos bigint, " + ", ".join(f"`{c}_{s}` double" for c in self.channels for s in ("average", "lower", "upper", "output")) + ", x_smooth double"

    def row(self, memory, row):
        tails, lower, upper, x = [list(t) for t in memory[0]], list(memory[1]), list(memory[2]), memory[3]
        out, norms = {"at": row["at"], "pos": row[self.pos]}, {}
        for i, c in enumerate(self.channels):
            tails[i] = [*tails[i], min(abs(float(row[c])), self.cfg["limit"])][-self.width:]
            average = reduce(add, tails[i]) / len(tails[i])  # one by one, as Spark and SQL add: another order may miss a threshold that is met exactly
            lower[i], upper[i], norms[c] = st.threshold_step(lower[i], upper[i], average, self.cfg)
            out |= {f"{c}_average": average, f"{c}_lower": lower[i], f"{c}_upper": upper[i], f"{c}_output": norms[c]}
        side = lambda names: sum(norms[c] for c in names) / len(names) if names else 0.0
        x += (1.0 - self.cfg["smoothing"]) * (side(self.right) - side(self.left) - x)
        return (tails, lower, upper, x), [out | {"x_smooth": x}]


def prompt_outcomes(prompts: DataFrame, detections: DataFrame, keys: Sequence[str], timeout_sec: float, delay: str | None = None) -> DataFrame:
    """Outcome of every prompt, as a watermarked left outer interval join of two streams; no state code of its own.

    Prompts carry ``ts``, prompt_id and target, detections ``ts`` and detected. A prompt closes when the watermark has
    passed its timeout, whether or not a row of its session follows. It succeeds at its first correct detection; wrong
    ones before that are counted. Leave ``delay`` out if both streams have a watermark already.
    """
    spark = prompts.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    p = prompts.select(*[F.col(k).alias(f"_p_{k}") for k in keys], F.col("ts").alias("prompt_ts"), "prompt_id", "target")
    d = detections.select(*[F.col(k).alias(f"_d_{k}") for k in keys], F.col("ts").alias("detected_ts"), "detected")
    if delay:
        p, d = p.withWatermark("prompt_ts", delay), d.withWatermark("detected_ts", delay)
    on = (F.col("detected_ts") >= F.col("prompt_ts")) & (F.col("detected_ts") <= F.col("prompt_ts") + F.expr(f"INTERVAL {round(timeout_sec * 1000)} MILLISECONDS"))
    for k in keys:
        on = on & (F.col(f"_p_{k}") == F.col(f"_d_{k}"))
    near = p.join(d, on, "leftOuter")
    seen = F.collect_list(F.when(F.col("detected_ts").isNotNull(), F.struct(micros("detected_ts").alias("at"), (F.col("detected") == F.col("target")).alias("right"))))  # one prompt's detections
    g = near.groupBy(*[F.col(f"_p_{k}").alias(k) for k in keys], "prompt_ts", "prompt_id", "target").agg(seen.alias("_seen"))
    right = F.array_min(F.transform(F.filter("_seen", lambda x: x["right"]), lambda x: x["at"]))
    wrong = F.size(F.filter("_seen", lambda x: ~x["right"] & (F.col("_right").isNull() | (x["at"] < F.col("_right")))))
    out = g.withColumn("_right", right).withColumn("wrong_detections_count", wrong.cast("bigint"))
    return out.select(*keys, "prompt_id", "target", micros("prompt_ts").alias("start_us"), F.coalesce("_right", micros("prompt_ts") + round(timeout_sec * MICROS)).alias("end_us"),
                      F.col("_right").isNotNull().alias("success"), (F.col("_right") - micros("prompt_ts")).alias("latency_us"), "wrong_detections_count", F.col("_right").isNull().alias("timeout_flag"))
