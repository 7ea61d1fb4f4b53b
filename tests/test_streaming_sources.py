import itertools
import random
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import steps as st
from pulsegrid.operators import filters as fl
from pulsegrid.operators import machines as mc
from pulsegrid.operators import signal as sg
from pulsegrid.plans import jaw
from pulsegrid.sources import recordings as rec
from pulsegrid.sources.sinks import append_log
from pulsegrid.streaming import live, timed
from pulsegrid.timeline import Timeline

K, BIG = ["session_id"], Timeline()
START = pd.Timestamp("2024-01-01")


@pytest.fixture(scope="module")
def ticks():
    rng = np.random.default_rng(8)
    rows = []
    for s, n in (("a", 90), ("b", 40)):
        x = rng.random(n)
        rows.append(pd.DataFrame({"session_id": s, "sample_idx": np.arange(n), "ts": START + pd.to_timedelta(np.arange(n) * 100, unit="ms"), "at": np.arange(n) * 0.1, "x": x, "y": rng.random(n) * 30,
                                  "clench": x, "onset": rng.random(n), "active": x, "inactive": 1 - x, "envelope": x * 5, "state": rng.choice(["INACTIVE", "ONSET", "ACTIVE", "OFFSET"], n),
                                  "engaged": x > 0.3, "clicked": x > 0.9, "label": np.where(x > 0.8, "LEFT", np.where(x < 0.2, "RIGHT", None))}))
    return pd.concat(rows).reset_index(drop=True)


CLOCK = pd.DataFrame({"session_id": ["clock"], "sample_idx": [0], "ts": [START + pd.Timedelta("1h")], "x": [0.0], "y": [0.0], "clench": [0.0], "onset": [0.0], "active": [0.0], "inactive": [0.0],
                      "envelope": [0.0], "state": ["INACTIVE"], "engaged": [False], "clicked": [False], "label": [None]})


@pytest.fixture
def played(spark, ticks, tmp_path):
    """The ticks as files out of order within two seconds, some rows twice; a session of its own moves the clock on."""
    rng = np.random.default_rng(3)
    rows = ticks.drop(columns="at")
    shuffled = rows.iloc[np.argsort(rows["ts"].astype("int64").to_numpy() / 1e9 + rng.random(len(rows)) * 1.5)]
    shuffled = pd.concat([shuffled, CLOCK])
    cuts = [shuffled.iloc[:50], shuffled.iloc[40:90], shuffled.iloc[90:-1], shuffled.iloc[-1:]]
    schema = spark.createDataFrame(rows).schema
    for i, part in enumerate(cuts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i:02d}")

    def run(build):
        stream = build(live.replay_source(spark, f"{tmp_path}/in/*", schema))
        out = tmp_path / uuid.uuid4().hex
        q = append_log(stream, str(out / "out"), str(out / "ck"))
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(str(out / "out")).where("session_id <> 'clock'"), q
    return run


def same(got, want, cols):
    a = got.select(*cols).toPandas().sort_values(cols).reset_index(drop=True)
    b = want.select(*cols).toPandas().sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b)


def test_hold_stream_equals_batch(spark, ticks, played):
    df = spark.createDataFrame(ticks)
    batch = df.select("session_id", "sample_idx", "at", F.lit(0.0).alias("jaw"), F.lit(0.0).alias("jaw_active"), F.when(F.col("engaged"), "ACTIVE").otherwise("INACTIVE").alias("state"), "clicked")
    got, q = played(lambda s: timed.run_timed(s.select("session_id", "sample_idx", "ts", "engaged", "clicked"), K, "sample_idx", timed.Hold("sample_idx"), "2 seconds"))
    same(got.withColumnRenamed("pos", "sample_idx"), mc.hold_detector(batch, BIG), ["session_id", "sample_idx", "action"])
    assert timed.dropped_rows(q) == 0


def test_latch_stream_equals_batch_and_ends_by_itself(spark, ticks, played):
    got, _ = played(lambda s: timed.run_timed(s.select("session_id", "sample_idx", "ts", "label"), K, "sample_idx", timed.Latch("sample_idx"), "2 seconds"))
    same(got.where("not expired").withColumnRenamed("pos", "sample_idx"), mc.hand_latch(spark.createDataFrame(ticks), BIG), ["session_id", "sample_idx", "taken", "shown"])
    ends = got.where("expired").toPandas()
    taken = got.where("taken").toPandas().sort_values("at")
    for session, rows in taken.groupby("session_id"):
        at = rows["at"].tolist()
        want = [t + 450_000 for t, n in zip(at, [*at[1:], 1 << 62]) if n > t + 450_000]
        assert sorted(ends[ends.session_id == session]["at"]) == want and want


@pytest.mark.parametrize("i", [4, 24, 40])
def test_click_machine_equals_batch_for_any_cut(spark, ticks, i):
    cfg, rng = mc.trigger_grid()[i], random.Random(i)
    want = mc.click_trigger(spark.createDataFrame(ticks), BIG, [cfg]).toPandas()
    for session, rows in ticks.groupby("session_id"):
        records = [{**r, "at": round(r["at"] * 1e6)} for r in rows.to_dict("records")]
        for _ in range(3):
            machine = timed.Clicks("sample_idx", cfg)
            memory, out = machine.start, []
            for part in cut(records, rng):
                memory, more = machine.block(memory, part, 0)
                out += more
            mine = want[want.session_id == session].sort_values("sample_idx")
            assert [(o["pos"], o["reason"]) for o in out] == list(zip(mine["sample_idx"], mine["reason"]))


def cut(rows, rng):
    places = sorted({0, len(rows), *[rng.randrange(len(rows) + 1) for _ in range(rng.randrange(6))]})
    return [rows[a:b] for a, b in itertools.pairwise(places)]


def test_adaptive_machine_equals_batch(spark, ticks):
    want = mc.adaptive_thresholds(sg.moving_mav(spark.createDataFrame(ticks), BIG, ["y"], 10), BIG, ["y"]).toPandas().sort_values(["session_id", "sample_idx"])
    for session, rows in ticks.groupby("session_id"):
        machine = timed.Adaptive("sample_idx", ["y"], 10)
        _, out = machine.block(machine.start, [{**r, "at": 0} for r in rows.to_dict("records")], 0)
        mine = want[want.session_id == session]
        for c in ("y_average", "y_lower", "y_upper", "y_output"):
            assert np.allclose([o[c] for o in out], mine[c])


def plain_peaks(x, prominence):
    out = []
    i = 1
    while i < len(x) - 1:
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j + 1 < len(x) and x[j + 1] < x[i]:
            left = next((k for k in range(i - 1, -1, -1) if x[k] > x[i]), -1)
            right = next((k for k in range(j + 1, len(x)) if x[k] > x[i]), len(x))
            if x[i] - max(min(x[left + 1 : i + 1]), min(x[i:right])) >= prominence:
                out.append(((i + j) // 2, j))
        i = j + 1
    return out


@pytest.mark.parametrize("confirm", [0, 3])
def test_peaks_equal_the_batch_rule_for_any_cut(confirm):
    rng = random.Random(confirm)
    for _ in range(300):
        x = [float(rng.randrange(rng.choice([3, 8, 40]))) for _ in range(rng.randrange(1, 70))]
        machine, rows = timed.Peaks("p", "v", 2.0, confirm), [{"at": i, "p": i, "v": v} for i, v in enumerate(x)]
        memory, out = machine.start, []
        for part in cut(rows, rng):
            memory, more = machine.block(memory, part, 0)
            out += more
        assert sorted(o["peak_pos"] for o in out) == [m for m, end in plain_peaks(x, 2.0) if end + confirm < len(x)]
        assert all(o["emitted_pos"] - o["peak_pos"] >= confirm for o in out)


def test_tail_features_equal_a_whole_filter_for_any_cut():
    rng, values = random.Random(1), np.random.default_rng(1).normal(size=(150, 2))
    sections = fl.bandpass_sections(fl.FilterSpec(1.0, 40.0, 250.0))
    y = values.copy()
    for b, a in sections:
        x, y = y, np.zeros_like(y)
        for t in range(len(x)):
            y[t] = sum(b[k] * x[t - k] for k in range(3) if t >= k) - sum(a[k] * y[t - k] for k in (1, 2) if t >= k)
    rows = [{"at": i, "p": i, "a": float(u), "b": float(v)} for i, (u, v) in enumerate(values)]
    for _ in range(5):
        machine = timed.Tail("p", ["a", "b"], 40, 15, 250.0, sections, {"mu": (8.0, 30.0)})
        memory, out = machine.start, []
        for part in cut(rows, rng):
            memory, more = machine.block(memory, part, 0)
            out += more
        assert [o["window_start"] for o in out] == list(range(0, 111, 15))
        for o in out:
            w = y[o["window_start"] : o["window_start"] + 40]
            hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(40) / 40)
            freq = np.arange(21) * 250.0 / 40
            power = np.abs(np.fft.rfft((w - w.mean(0)) * hann[:, None], axis=0)) ** 2 / (250.0 * (hann**2).sum()) * np.where((np.arange(21) % 20) == 0, 1, 2)[:, None]
            band = power[(freq >= 8) & (freq <= 30)].sum(0)
            assert np.allclose([o["a_mean"], o["b_std"], o["a_rms"], o["a_mu_power"], o["b_mu_power"]], [w[:, 0].mean(), w[:, 1].std(), np.sqrt((w[:, 0] ** 2).mean()), *band], rtol=1e-9, atol=1e-12)


def test_calibration_needs_rows_in_its_time():
    machine = timed.Calibrate("p", ["x"], 1.0)
    rows = [{"at": i * 250_000, "p": i, "x": float(i)} for i in range(8)]
    _, out = machine.block(machine.start, rows, 0)
    assert [o["ready"] for o in out] == [False] * 4 + [True] * 4 and not any(o["uncalibrated"] for o in out)
    assert out[5]["x_z"] == pytest.approx((5 - 1.5) / np.std([0, 1, 2, 3]))
    _, out = machine.block(machine.start, [{**r, "session_start_us": -2_000_000} for r in rows], 0)
    assert all(o["uncalibrated"] and o["x_z"] is None for o in out)


def test_late_repeated_and_dropped_rows(spark, tmp_path):
    at = lambda s: START + pd.Timedelta(seconds=s)
    files = [[("a", 0, 0, "LEFT"), ("a", 2, 4, None)], [("a", 1, 3, "RIGHT"), ("a", 2, 4, None), ("b", 0, 20, None)], [("b", 1, 21, None)], [("a", 9, 1, "RIGHT"), ("b", 2, 60, None)], [("b", 3, 90, None)]]
    for i, rows in enumerate(files):
        part = pd.DataFrame([(k, p, at(s), label) for k, p, s, label in rows], columns=["session_id", "sample_idx", "ts", "label"])
        spark.createDataFrame(part, "session_id string, sample_idx bigint, ts timestamp, label string").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = live.replay_source(spark, f"{tmp_path}/in/*", spark.read.parquet(f"{tmp_path}/in/0").schema)
    both = timed.run_timed(source, K, "sample_idx", timed.Stale(10.0), "5 seconds", idle_sec=1000.0)
    q = append_log(both, f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination()
    flags = sorted((r.session_id, r.stale, r.silent_us // 1_000_000) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    # a's row of second 1 comes behind the watermark of second 15; a's silence is seen without another row of a
    assert flags == [("a", True, 10), ("b", False, 39), ("b", True, 10), ("b", True, 10)]
    assert timed.dropped_rows(q) == 1


def test_composed_states_and_replay_in_chunks(spark):
    rng = random.Random(4)
    rows, at = [], 0
    for i in range(300):
        at += rng.choice([50_000, 100_000, 900_000])
        rows.append({"session_id": "s", "step": i, "at": at, "pos": i, "ready": i > 20, "label": rng.choice(["LEFT", "RIGHT"]), "confidence": 0.9, "agreed": rng.random() < 0.7,
                     "event": rng.random() < 0.3, "engaged": rng.random() < 0.8, "clicked": rng.random() < 0.2})
    machine = timed.Control("pos")
    _, want = machine.block(machine.start, rows, 1 << 60)
    df = spark.createDataFrame(rows)
    for size in (7, 1000):
        got = jaw.replay_control(df, Timeline(pos="step", chunk_rows=size), machine).collect()
        key = lambda r: (r["at"], r["pos"] is not None, r["pos"] or 0)
        assert [tuple(r[c] for c in ("at", "pos", "actions", "accepted", "hand", "decoded")) for r in sorted(got, key=key)] == [
            tuple(r[c] for c in ("at", "pos", "actions", "accepted", "hand", "decoded")) for r in sorted(want, key=key)]
    assert {r["decoded"] for r in want} >= {"NEUTRAL", "CLICK", "CLICK_HOLD", "LEFT", "CLICK_HOLD | RIGHT"}


def line(n, i, marker="0"):
    return "\t".join([str(i)] + [str(i + 0.5)] * (n - 2) + [marker])


@pytest.mark.parametrize("n,has", [(10, set()), (11, {"ts_raw"}), (12, {"ts_raw", "Accel_0"}), (24, {"ts_raw", "Accel_0", "Accel_2", "Aux_1", "Aux_10"})])
def test_recording_layouts(spark, tmp_path, n, has):
    (tmp_path / "LR-2-27-26-(01).csv").write_text("\n".join([line(n, 0), line(n, 1, "junk"), line(n, 2, "3")]))
    out = rec.read_recordings(spark, str(tmp_path)).orderBy("sample_idx").collect()
    assert [r.sample_idx for r in out] == [0, 1, 2] and [r.Marker for r in out] == [0.0, None, 3.0]
    assert out[0].session_id.startswith("LR-2-27-26")
    for c in ("ts_raw", "Accel_0", "Accel_2", "Aux_1", "Aux_10"):
        assert (out[0][c] is not None) == (c in has)


def test_short_lines_keep_the_layout_of_their_file(spark, tmp_path):
    """A line cut off at 13 of 24 columns has no marker and no timestamp, whatever its last cell says."""
    (tmp_path / "x.csv").write_text("\n".join([line(24, 0, "7"), line(13, 1, "9"), "2\t5", line(24, 3, "8")]))
    out = rec.read_recordings(spark, str(tmp_path)).orderBy("sample_idx").collect()
    assert [(r.columns, r.short, r.Marker, r.ts_raw) for r in out] == [(24, False, 7.0, 0.5), (24, True, None, None), (24, True, None, None), (24, False, 8.0, 3.5)]
    assert [r.Channel_8 for r in out] == [0.5, 1.5, None, 3.5] and out[1].Accel_0 == 1.5


def test_equal_names_in_two_folders_are_two_sessions(spark, tmp_path):
    for d in ("a", "b c"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "x.csv").write_text(line(10, 0))
    got = {r.session_id: r.sample_idx for r in rec.read_recordings(spark, str(tmp_path / "*")).collect()}
    assert len(got) == 2 and set(got.values()) == {0} and "a/x.csv" in got


def test_other_header_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ch1,ch2,label\n1,2,x\n")
    (tmp_path / "b.csv").write_text("ch2,ch1,label\n20,10,x\n")
    with pytest.raises(Exception, match="header"):
        rec.read_labelled(spark, str(tmp_path)).collect()


def test_narrow_file_is_an_error(spark, tmp_path):
    (tmp_path / "x.csv").write_text(line(9, 0))
    with pytest.raises(Exception, match="at least 10 columns"):
        rec.read_recordings(spark, str(tmp_path)).collect()


def test_large_file_keeps_its_order(spark, tmp_path):
    (tmp_path / "x.csv").write_text("\n".join(line(10, i) for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        out = rec.read_recordings(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 1 and out.filter("sample_idx = sample_index_raw").count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_labelled_and_catalog(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Timestamp,ch1,Label\n0,1.5,norm\n1,x,Jaws\n")
    out = rec.read_labelled(spark, str(tmp_path), ["ch1"]).orderBy("sample_idx").collect()
    assert [(r.label, r.ch1) for r in out] == [("norm", 1.5), ("Jaws", None)]
    with pytest.raises(ValueError, match="missing columns"):
        rec.read_labelled(spark, str(tmp_path), ["ch9"])
    names = ["LR-2-27-26-(02).csv", "LR-2-27-26-(01).csv", "oddname.csv", "LR-1-5-26-(09).csv"]
    cat = rec.session_catalog(spark.createDataFrame([(n, "lr") for n in names], "filename string, family string")).orderBy("session_rank").collect()
    assert [r.filename for r in cat] == ["oddname.csv", "LR-1-5-26-(09).csv", "LR-2-27-26-(01).csv", "LR-2-27-26-(02).csv"]
