"""Peak detection over long series: plateaus, height, distance, prominence."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.signal import centered_frame
from pulsegrid.runtime import materialize
from pulsegrid.timeline import Running, Timeline, carry, framed, in_groups, in_one_chunk, range_join


def local_maxima(signal: DataFrame, tl: Timeline, value: str, keep: Column | None = None, carried: Mapping[str, Column] | None = None) -> DataFrame:
    """Samples (plateau middles) that are higher than what comes before and after; ends never count.

    One pass finds single-sample peaks and the edges of plateaus; only the few plateau edges are paired. ``carried`` are
    columns that are constant per series and stay with its peaks; ``keep`` (over ``peak_value`` and them) drops peaks early.
    """
    more = dict(carried or {})
    rows = signal.select(*tl.keys, tl.pos, F.col(value).cast("double").alias("_v"), *[c.alias(n) for n, c in more.items()])
    near = framed(rows, tl, 1, 1, lambda w: {"_a": F.lag("_v").over(w), "_b": F.lead("_v").over(w)})
    v, a, b = F.col("_v"), F.col("_a"), F.col("_b")
    kind = (F.when((v > a) & (v > b), "peak").when((v > a) & (v == b), "rise")
            .when((v == a) & (v > b), "fall").when((v == a) & (v != b), "leave"))
    edges = near.withColumns({"_kind": kind, "peak_value": v}).filter("_kind IS NOT NULL")
    if keep is not None:
        edges = edges.filter(keep)  # the edges of a plateau have one height: both stay or none
    edges = materialize(edges.select(*tl.keys, tl.pos, "_v", "_kind", *more))
    flat = carry(edges.filter("_kind <> 'peak'"), tl, _then=Running("lead", F.struct("_kind", tl.pos)))
    tops = flat.filter((F.col("_kind") == "rise") & (F.col("_then._kind") == "fall"))
    middle = F.floor((F.col(tl.pos) + F.col(f"_then.{tl.pos}")) / 2).cast("bigint")
    single = edges.filter("_kind = 'peak'").select(*tl.keys, tl.pos, F.col("_v").alias("peak_value"), *more)
    return single.unionByName(tops.select(*tl.keys, middle.alias(tl.pos), F.col("_v").alias("peak_value"), *more))


def _thin(pos: np.ndarray, val: np.ndarray, known: np.ndarray, lo: float, hi: float, distance: int) -> np.ndarray:
    """Highest-first thinning inside a visible stretch: 1 kept, 0 removed, -1 not decidable from here.

    Equal heights favour the later peak. A peak is decidable if no undecidable higher peak is within
    ``distance`` and the stretch shows all of its neighbourhood.
    """
    status = known.copy()
    for i in np.lexsort((pos, val))[::-1]:
        if status[i] != -1:
            continue
        a, b = np.searchsorted(pos, [pos[i] - distance + 1, pos[i] + distance])
        near = slice(a, b)
        higher = (val[near] > val[i]) | ((val[near] == val[i]) & (pos[near] > pos[i]))
        seen = status[near][higher]
        if (seen == 1).any():
            status[i] = 0
        elif not (seen == -1).any() and pos[i] - distance >= lo and pos[i] + distance <= hi:
            status[i] = 1
    return status


def thin_by_distance(peaks: DataFrame, tl: Timeline, distance: int) -> DataFrame:
    """Keep peaks at least ``distance`` apart, the highest first, exactly and chunk by chunk.

    Every chunk sees some neighbours and decides what it can; only chains of rising peaks that cross a
    chunk border need another round.
    """
    if distance <= 1:
        return peaks
    keys, cols = list(tl.keys), peaks.columns
    reach, size, pos = 8 * distance, tl.chunk_rows, tl.pos
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in peaks.select(*cols).schema) + ", _status int"
    first, last = tl.chunk_of(F.col(pos) - reach), tl.chunk_of(F.col(pos) + reach)

    def decide(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        at, value, known, chunk = (pdf[c].to_numpy() for c in (pos, "peak_value", "_status", "_chunk"))
        status = np.empty(len(pdf), dtype="int32")
        for a, b in zip(starts, [*starts[1:], len(pdf)]):
            lo, hi = chunk[a] * size - reach, (chunk[a] + 1) * size + reach
            status[a:b] = _thin(at[a:b], value[a:b], known[a:b], -np.inf if lo <= 0 else lo, hi, distance)
        return pdf.assign(_status=status).loc[pdf["_core"], cols + ["_status"]]

    def one_round(table: DataFrame) -> DataFrame:
        seen = table.withColumn("_chunk", F.explode(F.sequence(first, last))).withColumn("_core", F.col("_chunk") == tl.chunk_of(pos))
        return in_groups(seen, [*keys, "_chunk"], pos, decide, schema)

    table = materialize(one_round(peaks.select(*cols).withColumn("_status", F.lit(-1))))
    while not table.filter("_status = -1").isEmpty():
        table = materialize(one_round(table))
    return table.filter("_status = 1").drop("_status")


def _lows(x: np.ndarray, stack: list[list[float]]) -> tuple[np.ndarray, list[list[float]]]:
    """For every sample the minimum since the previous higher sample, given what came before.

    The stack holds the falling staircase of earlier samples as [height, lowest value since the step before].
    """
    stack = [list(s) for s in stack]
    out = np.empty(len(x))
    for i, v in enumerate(x.tolist()):
        low = v
        while stack and stack[-1][0] <= v:
            low = min(low, stack.pop()[1])
        out[i] = low
        stack.append([v, low])
    return out, stack


def _fold(stacks: list[list[list[float]]]) -> list[list[list[float]]]:
    """Entry staircase of each chunk from the chunks' own staircases, trimmed to what the chunk can reach."""
    entry: list[list[float]] = []
    out = []
    for own in stacks:
        top = own[0][0]
        need = next((i for i in range(len(entry) - 1, -1, -1) if entry[i][0] > top), 0)
        out.append([list(s) for s in entry[need:]])
        low = own[0][1]
        while entry and entry[-1][0] <= top:
            low = min(low, entry.pop()[1])
        entry = entry + [[top, low]] + own[1:]
    return out


def with_prominence(peaks: DataFrame, signal: DataFrame, tl: Timeline, value: str) -> DataFrame:
    """Add each peak's prominence: its height over the higher of the two lowest points towards higher ground.

    Chunks are summarised to their falling staircases, the staircases are folded per series, and each
    chunk is then finished with the staircases of both sides.
    """
    keys, part, pos = list(tl.keys), [*tl.keys, "_chunk"], tl.pos
    marks = peaks.select(*keys, pos, F.lit(True).alias("_peak"))
    rows = (
        signal.select(*keys, pos, F.col(value).cast("double").alias("_v")).withColumn("_chunk", tl.chunk_of(pos))
        .join(marks.withColumn("_chunk", tl.chunk_of(pos)), [*part, pos], "left")
    )
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*part).schema)
    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys, pos).schema) + ", peak_prominence double"

    def finish(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        hit = pdf["_peak"].eq(True).to_numpy()
        x, before, after = pdf["_v"].to_numpy(), pdf["_from_left"].to_numpy(), pdf["_from_right"].to_numpy()
        prominence = np.empty(len(x))
        for a, b in zip(starts, [*starts[1:], len(x)]):
            left, _ = _lows(x[a:b], json.loads(before[a]))
            right, _ = _lows(x[a:b][::-1], json.loads(after[a]))
            prominence[a:b] = x[a:b] - np.maximum(left, right[::-1])
        return pdf.loc[hit, keys + [pos]].assign(peak_prominence=prominence[hit])

    if in_one_chunk(signal, tl):
        ready = rows.withColumns({"_from_left": F.lit("[]"), "_from_right": F.lit("[]")})
    else:
        rows = materialize(rows)

        def outline(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
            chunks = np.split(pdf["_v"].to_numpy(), starts[1:])
            return pdf[part].iloc[starts].assign(_l=[json.dumps(_lows(x, [])[1]) for x in chunks], _r=[json.dumps(_lows(x[::-1], [])[1]) for x in chunks])

        def fold(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_chunk", kind="stable")
            left = _fold([json.loads(s) for s in pdf["_l"]])
            right = _fold([json.loads(s) for s in pdf["_r"][::-1]])[::-1]
            return pdf[part].assign(_from_left=[json.dumps(s) for s in left], _from_right=[json.dumps(s) for s in right])

        outlines = in_groups(rows, part, pos, outline, f"{key_schema}, _l string, _r string")
        entries = outlines.groupBy(*keys).applyInPandas(fold, f"{key_schema}, _from_left string, _from_right string")
        ready = rows.join(entries, part)
    found = in_groups(ready, part, pos, finish, out_schema)
    return peaks.join(found, [*keys, pos])


def find_peaks(
    signal: DataFrame, tl: Timeline, value: str, height: Column | float | None = None, distance: int = 1,
    prominence: Column | float | None = None,
) -> DataFrame:
    """Peaks by height, then distance (highest first), then prominence.

    ``height`` and ``prominence`` may be column expressions over columns that are constant per series of
    the timeline and present in ``signal``. Output: keys, position, peak_value, peak_prominence.
    """
    limits = {"_least": height, "_need": prominence}
    carried = {n: c if isinstance(c, Column) else F.lit(float(c)) for n, c in limits.items() if c is not None}
    high = F.col("peak_value") >= F.col("_least") if height is not None else None
    peaks = thin_by_distance(local_maxima(signal, tl, value, high, carried), tl, distance)
    peaks = with_prominence(peaks, signal, tl, value)
    if prominence is not None:
        peaks = peaks.filter(F.col("peak_prominence") >= F.col("_need"))
    return peaks.drop(*carried)


def signal_in_spans(signal: DataFrame, spans: DataFrame, tl: Timeline, span_id: str, columns: list[str], span_columns: Sequence[str] = ()) -> tuple[DataFrame, Timeline]:
    """Samples inside each span as series of their own (keys plus the span id), with ``span_columns`` of their span."""
    inside = range_join(signal, spans.select(*tl.keys, span_id, "start_sample", "end_sample", *span_columns), list(tl.keys), tl.pos, "start_sample", "end_sample", tl.cell)
    return inside.select(*tl.keys, span_id, tl.pos, "start_sample", *columns, *span_columns), tl.by(span_id)


# Counting of repetitions inside trials.
COUNT_SMOOTHING, COUNT_DISTANCE_SEC, COUNT_STD_SCALE, COUNT_MIN_PROMINENCE, COUNT_EARLY_SEC = 75, 0.75, 0.6, 0.02, 0.10


def count_peaks_in_spans(
    signal: DataFrame, spans: DataFrame, tl: Timeline, span_id: str, value: str, fs: float, smoothing: int = COUNT_SMOOTHING,
    distance_sec: float = COUNT_DISTANCE_SEC, early_sec: float = COUNT_EARLY_SEC, min_prominence: float = COUNT_MIN_PROMINENCE,
) -> DataFrame:
    """Peak candidates of every trial or block, smoothed inside it, with the early ones marked as not counted."""
    inside, at = signal_in_spans(signal, spans, tl, span_id, [value])
    smooth = materialize(framed(inside, at, smoothing // 2, (smoothing - 1) // 2, lambda w: {"_smooth": F.avg(value).over(centered_frame(w, smoothing))}))
    need = smooth.groupBy(*at.keys).agg(F.greatest(F.stddev_pop("_smooth") * COUNT_STD_SCALE, F.lit(min_prominence)).alias("prominence_threshold"))
    peaks = find_peaks(smooth, at, "_smooth", distance=max(1, round(distance_sec * fs)))
    kept = peaks.join(need, list(at.keys)).filter(F.col("peak_prominence") >= F.col("prominence_threshold"))
    starts = spans.select(*tl.keys, span_id, "start_sample")
    relative = (F.col(tl.pos) - F.col("start_sample")) / fs
    return kept.join(starts, [*tl.keys, span_id]).withColumns({
        "peak_time_sec": F.col(tl.pos) / fs, "peak_time_relative_sec": relative, "kept_for_count": relative >= early_sec})


def trial_counts(trials: DataFrame, candidates: DataFrame, tl: Timeline, trial_id: str) -> DataFrame:
    """Observed versus expected repetitions per trial."""
    seen = candidates.groupBy(*tl.keys, trial_id).agg(F.count_if("kept_for_count").alias("observed_count"), F.count(F.lit(1)).alias("candidates"))
    out = trials.join(seen, [*tl.keys, trial_id], "left").fillna(0, ["observed_count", "candidates"])
    error = F.col("observed_count") - F.col("expected_count")
    return out.withColumns({"count_error": error, "count_match": error == 0})


def constrained_decode(trials: DataFrame, candidates: DataFrame, tl: Timeline, trial_id: str) -> DataFrame:
    """The ``expected_count`` most prominent counted peaks of each trial, in time order ranks."""
    pool = candidates.filter("kept_for_count").join(trials.select(*tl.keys, trial_id, "expected_count"), [*tl.keys, trial_id])
    by = Window.partitionBy(*tl.keys, trial_id)
    rank = F.row_number().over(by.orderBy(F.desc("peak_prominence"), F.desc("peak_value"), tl.pos))
    best = pool.withColumn("_rank", rank).filter(F.col("_rank") <= F.col("expected_count")).drop("_rank")
    return best.withColumn("peak_order", F.row_number().over(by.orderBy(tl.pos)))


def decode_rows(counted: DataFrame, selected: DataFrame, tl: Timeline, trial_id: str) -> DataFrame:
    """Errors and exactness of the free count and of the constrained one."""
    chosen = selected.groupBy(*tl.keys, trial_id).agg(F.count(F.lit(1)).alias("constrained_count"))
    out = counted.join(chosen, [*tl.keys, trial_id], "left").fillna(0, ["constrained_count"])
    return out.withColumns({
        "unconstrained_count": F.col("observed_count"), "unconstrained_error": F.col("count_error"), "unconstrained_exact": F.col("count_match"),
        "constrained_error": F.col("constrained_count") - F.col("expected_count"), "constrained_exact": F.col("constrained_count") == F.col("expected_count")})


def block_counts(blocks: DataFrame, candidates: DataFrame, signal: DataFrame, tl: Timeline, block_id: str, value: str) -> DataFrame:
    """Counted peaks per block with the block's highest and mean trace value."""
    seen = candidates.groupBy(*tl.keys, block_id).agg(F.count_if("kept_for_count").alias("detected_event_count"))
    inside, at = signal_in_spans(signal, blocks, tl, block_id, [value])
    trace = inside.groupBy(*at.keys).agg(F.max(value).alias("max_trace_value"), F.avg(value).alias("mean_trace_value"))
    return blocks.join(trace, list(at.keys), "left").join(seen, list(at.keys), "left").fillna(0, ["detected_event_count"])


def detect_in_blocks(signal: DataFrame, blocks: DataFrame, tl: Timeline, value: str, fs: float, smoothing: int, distance_sec: float) -> DataFrame:
    """Peaks inside marker blocks, plus peaks of the whole recording that lie outside every block.

    Blocks carry block_id, start_sample, end_sample. Numbered per session in time order.
    """
    keys = list(tl.keys)
    inner = count_peaks_in_spans(signal, blocks, tl, "block_id", value, fs, smoothing, distance_sec)
    whole = signal.groupBy(*keys).agg(F.min(tl.pos).alias("start_sample"), F.max(tl.pos).alias("end_sample")).withColumn("block_id", F.lit(-1).cast("bigint"))
    outer = count_peaks_in_spans(signal, whole, tl, "block_id", value, fs, smoothing, distance_sec).drop("block_id", "start_sample")
    spans = blocks.select(*keys, "block_id", F.col("start_sample").alias("_lo"), F.col("end_sample").alias("_hi"))
    outside = range_join(outer, spans, keys, tl.pos, "_lo", "_hi", tl.cell, "left").filter("block_id IS NULL").drop("_lo", "_hi")
    cols = [*keys, tl.pos, "block_id", "peak_value", "peak_prominence", "kept_for_count", "peak_time_sec"]
    both = inner.select(*cols).withColumn("inside_marker_block", F.lit(True)).unionByName(
        outside.select(*cols).withColumn("inside_marker_block", F.lit(False)))
    return carry(materialize(both), tl, order=("block_id",), event_id=Running("sum", F.lit(1)))
