"""Markers, runs and intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.runtime import materialize
from pulsegrid.timeline import Running, Timeline, carry, exact_quantiles, range_join, runs

# The marker protocol (codes, expected seconds, tolerances).
MOVEMENT_CODES = {"movement1": (1, 2), "movement2": (3, 4)}
EXPECTED_BASELINE_SEC, EXPECTED_ACTIVE_SEC = 45.0, 8.0
EXPECTED_REST_SEC = {"movement1_to_movement2": 5.0, "movement2_to_movement1": 15.0}
ALLOWED_NEXT = {1: (2,), 2: (1, 3), 3: (4,), 4: (1, 3)}
TRIAL_CODES = {1: "LEFT", 2: "RIGHT", 3: "JAW"}
EXPECTED_PULSES, EXPECTED_INTERVALS = 12, 6


def marker_code(marker: str | Column) -> Column:
    """Marker as an integer code: text is coerced, null is 0, halves round to even."""
    c = F.col(marker) if isinstance(marker, str) else marker
    return F.coalesce(F.bround(c.try_cast("double")), F.lit(0.0)).cast("int")


def collapse_markers(samples: DataFrame, tl: Timeline, marker: str = "marker") -> DataFrame:
    """One row per maximal run of one nonzero code."""
    coded = samples.select(*tl.keys, tl.pos, marker_code(marker).alias("code"))
    return (
        runs(coded, tl, "code")
        .filter("code <> 0")
        .select(
            *tl.keys, "code", F.col("start_idx").alias("start_sample"),
            F.col("end_idx").alias("end_sample"), F.col("run_length").alias("run_length_samples"),
        )
    )


def rle_segments(samples: DataFrame, tl: Timeline, label: str, fs: float) -> DataFrame:
    """Runs of equal label with an inclusive end."""
    return runs(samples.select(*tl.keys, tl.pos, label), tl, label).select(
        *tl.keys, label, "start_idx", "end_idx", (F.col("run_length") / fs * 1000).alias("duration_ms")
    )


def trim_segments(
    segments: DataFrame, fs: float, trim_start_ms: float = 1000, trim_end_ms: float = 500,
    min_rest_ms: float = 2000, label: str = "label",
) -> DataFrame:
    """Drop UNKNOWN, keep long enough REST, and cut both ends of the other segments."""
    lead_in, lead_out = int(trim_start_ms / 1000 * fs), int(trim_end_ms / 1000 * fs)
    rest = F.col(label) == "REST"
    start = F.when(rest, F.col("start_idx")).otherwise(F.col("start_idx") + lead_in)
    end = F.when(rest, F.col("end_idx")).otherwise(F.col("end_idx") - lead_out)
    return (
        segments.filter(F.col(label) != "UNKNOWN")
        .filter(~rest | (F.col("duration_ms") >= min_rest_ms))
        .withColumns({"orig_start": F.col("start_idx"), "orig_end": F.col("end_idx"), "start_idx": start, "end_idx": end})
        .filter(rest | (F.col("end_idx") > F.col("start_idx")))
        .withColumn(
            "duration_ms",
            F.when(rest, F.col("duration_ms")).otherwise((F.col("end_idx") - F.col("start_idx") + 1) / fs * 1000),
        )
    )


def _code_steps(events: DataFrame, tl: Timeline, start_code: int, end_code: int) -> DataFrame:
    two = events.filter(F.col("code").isin(start_code, end_code))
    here = F.struct("code", "start_sample", "end_sample")
    return carry(
        two, tl.at("start_sample"), _prev=Running("lag", here), _next=Running("lead", F.col("code"))
    )


def pair_start_end(events: DataFrame, tl: Timeline, start_code: int, end_code: int) -> DataFrame:
    """Intervals from the latest start marker to the start of the next end marker."""
    steps = _code_steps(events, tl, start_code, end_code)
    return steps.filter((F.col("code") == end_code) & (F.col("_prev.code") == start_code)).select(
        *tl.keys,
        F.col("_prev.start_sample").alias("start_sample"),
        F.col("start_sample").alias("end_sample"),
        F.col("_prev.end_sample").alias("start_event_end_sample"),
        F.col("end_sample").alias("end_event_end_sample"),
    )


def pairing_issues(events: DataFrame, tl: Timeline, start_code: int, end_code: int) -> DataFrame:
    """Start markers that were replaced or never closed, end markers without a start."""
    steps = _code_steps(events, tl, start_code, end_code)
    is_start, prev = F.col("code") == start_code, F.col("_prev.code")
    issue = lambda name, at: F.struct(F.lit(name).alias("issue"), at.alias("at_sample"))
    found = F.array_compact(
        F.array(
            F.when(is_start & (prev == start_code), issue("reappeared", F.col("_prev.start_sample"))),
            F.when(~is_start & ~prev.eqNullSafe(F.lit(start_code)), issue("unmatched_end", F.col("start_sample"))),
            F.when(is_start & F.col("_next").isNull(), issue("never_closed", F.col("start_sample"))),
        )
    )
    return steps.select(*tl.keys, F.lit(start_code).alias("start_code"), F.lit(end_code).alias("end_code"), F.inline(found))


def pair_first_start(samples: DataFrame, tl: Timeline, start_code: int, end_code: int, marker: str = "marker") -> DataFrame:
    """Per-sample pairing where the first start wins until an end closes it."""
    two = samples.filter(F.col(marker).isin(start_code, end_code)).select(*tl.keys, tl.pos, marker)
    is_end = (F.col(marker) == end_code).cast("int")
    counted = carry(two, tl, _ends=Running("sum", is_end)).withColumn("_island", F.col("_ends") - is_end)
    return (
        counted.groupBy(*tl.keys, "_island")
        .agg(
            F.min(F.when(is_end == 0, F.col(tl.pos))).alias("start_sample"),
            F.max(F.when(is_end == 1, F.col(tl.pos))).alias("end_sample"),
        )
        .filter("start_sample IS NOT NULL AND end_sample IS NOT NULL")
        .drop("_island")
    )


def code_occurrences(events: DataFrame, tl: Timeline, fs: float) -> DataFrame:
    """Marker audit for same-code pairing: occurrence and pair number per code, role, gap to the previous marker."""
    at = tl.at("start_sample")
    gaps = carry(
        events, at, event_id=Running("sum", F.lit(1)), _prev=Running("lag", F.col("start_sample"))
    ).withColumn("gap_from_previous_sec", (F.col("start_sample") - F.col("_prev")) / fs)
    numbered = carry(gaps.drop("_prev"), at.by("code"), occurrence_index=Running("sum", F.lit(1)))
    return numbered.withColumns(
        {
            "pair_index": F.ceil(F.col("occurrence_index") / 2),
            "pair_role": F.when(F.col("occurrence_index") % 2 == 1, "start").otherwise("end"),
        }
    )


def pair_same_code(events: DataFrame, tl: Timeline) -> DataFrame:
    """Occurrences 1-2, 3-4, ... of each code form intervals; a trailing odd one is left out."""
    at = tl.at("start_sample").by("code")
    numbered = carry(events, at, _rn=Running("sum", F.lit(1))).withColumn("pair_index", F.ceil(F.col("_rn") / 2))
    return (
        numbered.groupBy(*at.keys, "pair_index")
        .agg(
            F.min("start_sample").alias("start_sample"),
            F.max("start_sample").alias("end_sample"),
            F.count(F.lit(1)).alias("_n"),
        )
        .filter("_n = 2")
        .drop("_n")
    )


def odd_code_counts(events: DataFrame, tl: Timeline) -> DataFrame:
    return events.groupBy(*tl.keys, "code").agg(F.count(F.lit(1)).alias("pulses")).filter("pulses % 2 = 1")


def pair_consecutive(events: DataFrame, tl: Timeline, fs: float, min_sec: float = 1.5, max_sec: float = 3.5) -> DataFrame:
    """Every adjacent marker pair, flagged by whether its duration is accepted."""
    nxt = F.struct("start_sample", "code")
    pairs = carry(events, tl.at("start_sample"), _next=Running("lead", nxt)).filter("_next IS NOT NULL")
    duration = (F.col("_next.start_sample") - F.col("start_sample")) / fs
    return pairs.select(
        *tl.keys, "start_sample", F.col("_next.start_sample").alias("end_sample"), duration.alias("duration_sec"),
        F.concat_ws("->", F.col("code").cast("string"), F.col("_next.code").cast("string")).alias("marker_pair_type"),
        duration.between(min_sec, max_sec).alias("accepted"),
    )


def pair_consecutive_stats(pairs: DataFrame, tl: Timeline) -> DataFrame:
    return pairs.groupBy(*tl.keys).agg(
        F.count(F.lit(1)).alias("candidate_pairs"),
        F.count_if("accepted").alias("valid_trials"),
        F.count_if(~F.col("accepted")).alias("duration_rejected_pairs"),
    )


def complement_intervals(
    occupied: DataFrame, totals: DataFrame, tl: Timeline, buffer: int = 500, style: str = "package"
) -> DataFrame:
    """Gaps around occupied intervals, kept ``buffer`` samples away from them.

    Each gap is measured from the previous interval in start order, not from the furthest end so far.
    ``totals`` has one row per key with ``total_samples``. style ``package`` leaves the buffer free on
    both sides; ``notebook`` ends a gap at ``start - buffer`` and starts the next at ``end + buffer``.
    """
    keys = list(tl.keys)
    at = tl.at("start_sample")
    linked = carry(
        occupied.select(*keys, "start_sample", "end_sample"), at, order=("end_sample",),
        _prev=Running("lag", F.col("end_sample")), _next=Running("lead", F.col("start_sample")),
    ).join(totals.select(*keys, "total_samples"), keys)
    total = F.col("total_samples")
    span = lambda a, b: F.struct(a.cast("bigint").alias("start_sample"), b.cast("bigint").alias("end_sample"))
    if style == "package":
        after = lambda e: F.least(total - 1, e + buffer) + 1
        left = F.greatest(F.lit(0), F.col("start_sample") - buffer)
        # least() skips nulls, so the first interval is handled apart
        cursor = F.when(F.col("_prev").isNull(), F.lit(0)).otherwise(after(F.col("_prev")))
        before = F.when(left > cursor, span(cursor, left - 1))
        tail_start = after(F.col("end_sample"))
        tail = F.when(F.col("_next").isNull() & (tail_start < total), span(tail_start, total - 1))
    else:
        cursor = F.coalesce(F.col("_prev") + buffer, F.lit(0))
        left = F.col("start_sample") - buffer
        before = F.when(left > cursor, span(cursor, left))
        tail_start = F.col("end_sample") + buffer
        tail = F.when(F.col("_next").isNull() & (tail_start < total), span(tail_start, total - 1))
    gaps = linked.select(*keys, F.inline(F.array_compact(F.array(before, tail))))
    whole = (
        totals.filter("total_samples > 0").join(occupied, keys, "left_anti")
        .select(*keys, F.inline(F.array(span(F.lit(0), total - 1))))
    )
    return gaps.unionByName(whole)


def movement_intervals(events: DataFrame, tl: Timeline, labels: tuple[str, str] = ("LEFT", "RIGHT")) -> DataFrame:
    """Intervals of both movements with kind, label and source."""
    parts = []
    for (kind, (a, b)), label in zip(MOVEMENT_CODES.items(), labels):
        parts.append(
            pair_start_end(events, tl, a, b).select(
                *tl.keys, F.lit(label).alias("label"), F.lit(kind).alias("segment_kind"),
                F.lit(f"marker_{a}_to_{b}").alias("segment_source"), "start_sample", "end_sample",
            )
        )
    return parts[0].unionByName(parts[1])


def build_segments(movements: DataFrame, totals: DataFrame, tl: Timeline) -> DataFrame:
    """Active segments plus the baseline before the first and the rests after each.

    ``totals``: one row per key with ``total_samples`` and ``fs_hz``. Bounds are inclusive.
    """
    keys = list(tl.keys)
    at = tl.at("start_sample")
    linked = carry(
        movements, at, order=("end_sample", "segment_kind"),
        _prev=Running("lag", F.lit(1)),
        _next=Running("lead", F.struct("start_sample", "segment_kind")),
    ).join(totals, keys)

    def seg(label, kind, source, context, a, b, expected):
        return F.struct(
            label.alias("label"), kind.alias("segment_kind"), source.alias("segment_source"),
            context.alias("segment_context"), a.cast("bigint").alias("start_sample"),
            b.cast("bigint").alias("end_sample"), expected.cast("double").alias("expected_duration_sec"),
        )

    none = F.lit(None).cast("string")
    first = F.col("_prev").isNull() & (F.col("start_sample") > 0)
    next_kind = F.coalesce(F.col("_next.segment_kind"), F.lit("end_of_recording"))
    context = F.concat_ws("_to_", F.col("segment_kind"), next_kind)
    rest_start = F.col("end_sample") + 1
    rest_end = F.coalesce(F.col("_next.start_sample"), F.col("total_samples")) - 1
    expected_rest = F.lit(None).cast("double")
    for name, sec in EXPECTED_REST_SEC.items():
        expected_rest = F.when(context == name, F.lit(sec)).otherwise(expected_rest)
    pieces = F.array_compact(
        F.array(
            F.when(first, seg(F.lit("BASELINE"), F.lit("baseline"), F.lit("inferred_pre_first_active_gap"),
                              F.lit("start_to_first_active"), F.lit(0), F.col("start_sample") - 1,
                              F.lit(EXPECTED_BASELINE_SEC))),
            seg(F.col("label"), F.col("segment_kind"), F.col("segment_source"), none, F.col("start_sample"),
                F.col("end_sample"), F.lit(EXPECTED_ACTIVE_SEC)),
            F.when(rest_end >= rest_start, seg(F.lit("REST"), F.lit("rest"), F.lit("inferred_between_active_gaps"),
                                               context, rest_start, rest_end, expected_rest)),
        )
    )
    found = linked.select(*keys, "fs_hz", F.inline(pieces))
    empty = totals.join(movements, keys, "left_anti").select(
        *keys, "fs_hz",
        F.inline(F.array(seg(F.lit("BASELINE"), F.lit("baseline"), F.lit("inferred_no_active_markers"),
                             F.lit("full_recording"), F.lit(0), F.col("total_samples") - 1, F.lit(None)))),
    )
    indexed = carry(
        found.unionByName(empty), at, order=("end_sample", "segment_kind"), _n=Running("sum", F.lit(1))
    )
    fs = F.col("fs_hz")
    duration = (F.col("end_sample") - F.col("start_sample") + 1) / fs
    return indexed.withColumns(
        {
            "segment_index": (F.col("_n") - 1).cast("bigint"),
            "start_time_sec": F.col("start_sample") / fs,
            "end_time_sec": F.col("end_sample") / fs,
            "duration_sec": duration,
            "duration_error_sec": duration - F.col("expected_duration_sec"),
        }
    ).drop("_n")


def overlap_issues(movements: DataFrame, tl: Timeline) -> DataFrame:
    """Active segments that start before the previous one has ended."""
    linked = carry(
        movements, tl.at("start_sample"), order=("end_sample", "segment_kind"),
        _prev=Running("lag", F.struct("segment_kind", "end_sample")),
    )
    return linked.filter(F.col("start_sample") <= F.col("_prev.end_sample")).select(
        *tl.keys, F.col("_prev.segment_kind").alias("previous_kind"), F.col("_prev.end_sample").alias("previous_end"),
        "segment_kind", "start_sample",
    )


def transition_issues(events: DataFrame, tl: Timeline) -> DataFrame:
    """Marker pairs the protocol does not allow."""
    steps = carry(
        events, tl.at("start_sample"), _prev=Running("lag", F.col("code")), event_number=Running("sum", F.lit(1))
    ).filter("_prev IS NOT NULL")
    ok = F.lit(False)
    for prev, nexts in ALLOWED_NEXT.items():
        ok = ok | ((F.col("_prev") == prev) & F.col("code").isin(*nexts))
    ok = ok | (~F.col("_prev").isin(*ALLOWED_NEXT) & F.col("code").isin(*ALLOWED_NEXT))
    return steps.filter(~ok).select(
        *tl.keys, (F.col("event_number") - 1).alias("from_event"), F.col("_prev").alias("from_code"),
        F.col("code").alias("to_code"),
    )


def marker_counts(samples: DataFrame, tl: Timeline, marker: str = "marker") -> DataFrame:
    return samples.groupBy(*tl.keys, marker_code(marker).alias("code")).agg(F.count(F.lit(1)).alias("samples"))


def protocol_summary(segments: DataFrame, tl: Timeline) -> DataFrame:
    """Count and duration statistics per segment kind."""
    keys = [*tl.keys, "segment_kind"]
    base = segments.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"), F.min("duration_sec").alias("min_duration_sec"),
        F.max("duration_sec").alias("max_duration_sec"),
    )
    medians = exact_quantiles(segments, keys, {"median_duration_sec": (F.col("duration_sec"), 0.5)})
    return base.join(medians, keys)


def protocol_issues(segments: DataFrame, totals: DataFrame, tl: Timeline, expected_movements: int = 10) -> DataFrame:
    """Deviations from the recording protocol: movement counts and median durations."""
    keys = list(tl.keys)
    group = F.when(F.col("segment_kind") == "rest", F.col("segment_context")).otherwise(F.col("segment_kind"))
    tagged = segments.select(*keys, group.alias("_group"), "duration_sec")
    stats = exact_quantiles(tagged, [*keys, "_group"], {"median_sec": (F.col("duration_sec"), 0.5)})
    off = F.lit(False)
    limits = {"baseline": (EXPECTED_BASELINE_SEC, 10.0), "movement1": (EXPECTED_ACTIVE_SEC, 2.0), "movement2": (EXPECTED_ACTIVE_SEC, 2.0)}
    limits |= {name: (sec, 3.0) for name, sec in EXPECTED_REST_SEC.items()}
    for name, (want, tol) in limits.items():
        off = off | ((F.col("_group") == name) & (F.abs(F.col("median_sec") - want) > tol))
    durations = stats.filter(off).select(
        *keys, F.concat(F.col("_group"), F.lit("_duration")).alias("issue"), F.col("median_sec").alias("observed")
    )
    kinds = segments.groupBy(*keys).agg(
        *[F.count_if(F.col("segment_kind") == k).cast("double").alias(k) for k in MOVEMENT_CODES]
    )
    counts = (
        totals.select(*keys).join(kinds, keys, "left")
        .select(*keys, F.inline(F.array(*[
            F.struct(F.lit(f"{k}_count").alias("issue"), F.coalesce(F.col(k), F.lit(0.0)).alias("observed"))
            for k in MOVEMENT_CODES])))
        .filter(F.col("observed") != expected_movements)
    )
    return durations.unionByName(counts)


def reconstruct_trials(events: DataFrame, tl: Timeline, fs: float) -> DataFrame:
    """Count-ramp trials from same-code pairs; the n-th trial of a label expects n repetitions."""
    known = events.filter(F.col("code").isin(*TRIAL_CODES))
    label = F.lit(None).cast("string")
    for code, name in TRIAL_CODES.items():
        label = F.when(F.col("code") == code, name).otherwise(label)
    pairs = pair_same_code(known, tl)
    linked = carry(
        pairs, tl.at("start_sample"), order=("end_sample", "code"),
        trial_index_overall=Running("sum", F.lit(1)), _prev_end=Running("lag", F.col("end_sample")),
    )
    return linked.withColumns(
        {
            "label": label,
            "expected_count": F.col("pair_index"),
            "start_time_sec": F.col("start_sample") / fs,
            "end_time_sec": F.col("end_sample") / fs,
            "duration_sec": (F.col("end_sample") - F.col("start_sample")) / fs,
            "gap_from_previous_trial_sec": (F.col("start_sample") - F.col("_prev_end")) / fs,
            "overlaps_previous": F.coalesce(F.col("start_sample") <= F.col("_prev_end"), F.lit(False)),
        }
    ).withColumnRenamed("pair_index", "trial_index_within_label").drop("_prev_end")


def trial_checks(events: DataFrame, trials: DataFrame, tl: Timeline) -> DataFrame:
    """Structural findings per session: (severity, rule, hits)."""
    keys = list(tl.keys)
    known = events.filter(F.col("code").isin(*TRIAL_CODES))
    block_change = carry(known, tl.at("start_sample"), _prev=Running("lag", F.col("code")))
    order_ok = F.coalesce(F.col("code") == F.col("_prev") + 1, F.col("code") == 1)
    from_events = block_change.groupBy(*keys).agg(
        (
            F.count_if(~F.coalesce(F.col("code") == F.col("_prev"), F.lit(False)) & ~order_ok)
            + F.lit(len(TRIAL_CODES)) - F.count_distinct("code")
        ).alias("block_order"),
        *[F.abs(F.count_if(F.col("code") == c) - EXPECTED_PULSES).alias(f"pulse_count_{n.lower()}") for c, n in TRIAL_CODES.items()],
        *[(F.count_if(F.col("code") == c) % 2).alias(f"odd_pulses_{n.lower()}") for c, n in TRIAL_CODES.items()],
    )
    from_trials = trials.groupBy(*keys).agg(
        F.count_if("overlaps_previous").alias("overlap"),
        *[F.abs(F.count_if(F.col("label") == n) - EXPECTED_INTERVALS).alias(f"interval_count_{n.lower()}") for n in TRIAL_CODES.values()],
        F.count_if(F.col("duration_sec") < 1.0).alias("short_trial"),
        F.count_if(F.col("duration_sec") > 15.0).alias("long_trial"),
        F.count_if((F.col("gap_from_previous_trial_sec") < 0.25) | (F.col("gap_from_previous_trial_sec") > 20.0)).alias("unusual_gap"),
    )
    other = events.filter(~F.col("code").isin(*TRIAL_CODES)).groupBy(*keys).agg(F.count(F.lit(1)).alias("unexpected_code"))
    long_runs = events.filter("run_length_samples > 1").groupBy(*keys).agg(F.count(F.lit(1)).alias("persisted_marker"))
    soft = {"short_trial", "long_trial", "unusual_gap", "persisted_marker"}
    out = None
    for table in (from_events, from_trials, other, long_runs):
        rules = [c for c in table.columns if c not in keys]
        part = table.select(*keys, F.inline(F.array(*[
            F.struct(F.lit("soft" if r in soft else "hard").alias("severity"), F.lit(r).alias("rule"),
                     F.col(r).cast("bigint").alias("hits")) for r in rules]))).filter("hits > 0")
        out = part if out is None else out.unionByName(part)
    return out


def gap_clusters(events: DataFrame, tl: Timeline, fs: float, cluster_gap_sec: float, block_gap_sec: float) -> DataFrame:
    """Number clusters and blocks of markers separated by long gaps."""
    at = tl.at("start_sample")
    gaps = carry(events, at, _prev=Running("lag", F.col("start_sample")), event_id=Running("sum", F.lit(1)))
    gaps = gaps.withColumns(
        {"time_sec": F.col("start_sample") / fs, "gap_from_previous_sec": (F.col("start_sample") - F.col("_prev")) / fs}
    ).drop("_prev")
    over = lambda th: F.coalesce((F.col("gap_from_previous_sec") > th).cast("int"), F.lit(0))
    numbered = carry(
        gaps, at, cluster_id=Running("sum", over(cluster_gap_sec)), block_id=Running("sum", over(block_gap_sec))
    )
    return numbered.withColumns({"cluster_id": F.col("cluster_id") + 1, "block_id": F.col("block_id") + 1})


def cluster_index(clustered: DataFrame, tl: Timeline) -> DataFrame:
    """Bounds and size per cluster; ``cluster_codes`` lists the codes."""
    return clustered.groupBy(*tl.keys, "cluster_id", "block_id").agg(
        F.min("start_sample").alias("cluster_start_sample"), F.max("start_sample").alias("cluster_end_sample"),
        F.min("time_sec").alias("cluster_start_time_sec"), F.max("time_sec").alias("cluster_end_time_sec"),
        F.count(F.lit(1)).alias("marker_count"),
    )


def cluster_codes(clustered: DataFrame, tl: Timeline) -> DataFrame:
    """The codes of each cluster in order, one row per marker."""
    at = tl.at("start_sample").by("cluster_id", "block_id")
    return carry(clustered, at, ordinal=Running("sum", F.lit(1))).select(*at.keys, "ordinal", "code")


def flatten_spans(spans: DataFrame, tl: Timeline, values: Sequence[str], order: str) -> DataFrame:
    """Disjoint spans where the largest ``order`` wins, as when later writes overwrite earlier ones."""
    keys = list(tl.keys)
    cuts = (
        spans.select(*keys, F.explode(F.array(F.col("start_sample"), F.col("end_sample") + 1)).alias("start_sample"))
        .distinct()
    )
    cuts = materialize(cuts)
    pieces = (
        carry(cuts, tl.at("start_sample"), _next=Running("lead", F.col("start_sample")))
        .filter("_next IS NOT NULL")
        .select(*keys, F.col("start_sample").alias("piece_start"), (F.col("_next") - 1).alias("piece_end"))
    )
    covered = range_join(pieces, spans, keys, "piece_start", "start_sample", "end_sample", tl.cell)
    return covered.groupBy(*keys, "piece_start", "piece_end").agg(
        *[F.max_by(v, order).alias(v) for v in values]
    )


def paint_labels(samples: DataFrame, spans: DataFrame, tl: Timeline, values: Sequence[str], order: str) -> DataFrame:
    """Give every sample the attributes of the last-written span that covers it (null outside)."""
    flat = flatten_spans(spans, tl, values, order)
    return range_join(samples, flat, list(tl.keys), tl.pos, "piece_start", "piece_end", tl.cell, "left").drop(
        "piece_start", "piece_end"
    )


def segment_totals(segments: DataFrame, by: Sequence[str]) -> DataFrame:
    """Segment count and total seconds per group (family and label)."""
    return segments.groupBy(*by).agg(
        F.count(F.lit(1)).alias("segments"), F.sum("duration_sec").alias("total_duration_sec")
    )
