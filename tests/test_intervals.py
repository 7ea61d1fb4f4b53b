"""Small cases with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import intervals as iv
from pulsegrid.operators import windows as wn
from pulsegrid.timeline import Timeline

TL = Timeline(chunk_rows=4)


def markers(spark, codes):
    return spark.createDataFrame([("s", i, c) for i, c in enumerate(codes)], "session_id string, sample_idx bigint, marker string")


def events(spark, at):
    return spark.createDataFrame([("s", c, p, p, 1) for c, p in at], "session_id string, code int, start_sample bigint, end_sample bigint, run_length_samples bigint")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_collapse_markers(spark):
    got = rows(iv.collapse_markers(markers(spark, "0 1 1 0 3 4 0 0 2".split()), TL), "start_sample", "code", "end_sample", "run_length_samples")
    assert got == [(1, 1, 2, 2), (4, 3, 4, 1), (5, 4, 5, 1), (8, 2, 8, 1)]


def test_marker_code_rounds_half_to_even_and_coerces(spark):
    got = [r.c for r in markers(spark, ["0.5", "1.5", "2.5", "x", None]).orderBy("sample_idx").select(iv.marker_code("marker").alias("c")).collect()]
    assert got == [0, 2, 2, 0, 0]


STEPS = [(1, 10), (1, 20), (2, 30), (2, 40), (1, 50)]


def test_last_start_wins(spark):
    e = events(spark, STEPS)
    assert rows(iv.pair_start_end(e, TL, 1, 2), "start_sample", "end_sample") == [(20, 30)]
    assert rows(iv.pairing_issues(e, TL, 1, 2), "issue", "at_sample") == [("never_closed", 50), ("reappeared", 10), ("unmatched_end", 40)]


def test_first_start_wins(spark):
    code = dict((p, c) for c, p in STEPS)
    samples = spark.createDataFrame([("s", i, code.get(i, 0)) for i in range(60)], "session_id string, sample_idx bigint, marker int")
    assert rows(iv.pair_first_start(samples, TL, 1, 2), "start_sample", "end_sample") == [(10, 30)]


def test_same_code_pairs(spark):
    e = events(spark, [(1, 5), (1, 15), (1, 20), (1, 40), (1, 60)])
    assert rows(iv.pair_same_code(e, TL), "start_sample", "end_sample") == [(5, 15), (20, 40)]
    assert rows(iv.odd_code_counts(e, TL), "code", "pulses") == [(1, 5)]


def test_complement(spark):
    occ = spark.createDataFrame([("s", 20, 30)], "session_id string, start_sample bigint, end_sample bigint")
    tot = spark.createDataFrame([("s", 100), ("t", 10)], "session_id string, total_samples bigint")
    got = rows(iv.complement_intervals(occ, tot, TL, 5), "session_id", "start_sample", "end_sample")
    assert got == [("s", 0, 14), ("s", 36, 99), ("t", 0, 9)]


def test_window_starts(spark):
    seg = spark.createDataFrame([("s", 0, 9)], "session_id string, start_sample bigint, end_sample bigint")
    assert [s for s, in rows(wn.segment_windows(seg, 4, 2), "window_start")] == [0, 2, 4, 6]
    seg9 = seg.withColumn("end_sample", F.lit(9).cast("bigint"))
    assert [s for s, in rows(wn.segment_windows(seg9, 4, 2, "half_open"), "window_start")] == [0, 2, 4]
    short = spark.createDataFrame([("s", 5, 7)], "session_id string, start_sample bigint, end_sample bigint")
    assert rows(wn.segment_windows(short, 4, 2, "fallback"), "window_start", "window_end", "full_interval_fallback") == [(5, 7, True)]
    assert wn.segment_windows(short, 4, 2).count() == 0


def test_assigned_samples_agree_with_window_rows(spark):
    seg = spark.createDataFrame([("s", 3, 30), ("s", 31, 33), ("s", 40, 52)], "session_id string, start_sample bigint, end_sample bigint")
    samples = spark.range(60).select(F.lit("s").alias("session_id"), F.col("id").alias("sample_idx"))
    for style in ("closed", "half_open", "fallback"):
        got = wn.assign_segment_windows(samples, seg, TL, 6, 4, style).groupBy("window_start").count()
        want = wn.segment_windows(seg, 6, 4, style)
        size = F.col("window_end") - F.col("window_start") + (0 if style == "half_open" else 1)
        assert rows(got, "window_start", "count") == rows(want.select("window_start", size.alias("count")), "window_start", "count")


@pytest.mark.parametrize("peak,lo,hi,want", [(50, 0, 100, (46, 54)), (2, 0, 100, (0, 8)), (99, 0, 100, (92, 100)), (4, 3, 7, (3, 7))])
def test_event_window_bounds(spark, peak, lo, hi, want):
    df = spark.createDataFrame([(peak, lo, hi)], "peak_sample bigint, block_start_sample bigint, block_end_sample bigint")
    assert tuple(df.select(*[c.alias(n) for n, c in wn.event_window_bounds(9).items()]).first()) == want


def test_later_spans_overwrite_earlier(spark):
    samples = spark.range(12).select(F.lit("s").alias("session_id"), F.col("id").alias("sample_idx"))
    spans = spark.createDataFrame([("s", 1, 8, "a", 0), ("s", 3, 5, "b", 1), ("s", 5, 9, "c", 2)], "session_id string, start_sample bigint, end_sample bigint, lab string, o int")
    got = [r.lab for r in iv.paint_labels(samples, spans, TL, ["lab"], "o").orderBy("sample_idx").collect()]
    assert got == [None, "a", "a", "b", "b", "c", "c", "c", "c", "c", None, None]
