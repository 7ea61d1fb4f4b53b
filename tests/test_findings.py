"""Cases found by running the queries on larger tables."""

import glob
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pulsegrid import timeline
from pulsegrid.operators import audit as au
from pulsegrid.operators import joins as jn
from pulsegrid.operators import machines as mc
from pulsegrid.sources import recordings as rec
from pulsegrid.sources import sinks
from pulsegrid.streaming import live, timed
from pulsegrid.timeline import in_groups
from workload.check import TABLES, canonical

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def many_files(spark, tmp_path_factory):
    """The smallest tables, the events cut into four files without order."""
    folder = tmp_path_factory.mktemp("sf")
    for t in TABLES:
        if t != "events":
            (folder / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    spark.read.parquet(f"{SF}/events.parquet").repartition(4).write.parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["split_log", "stream_stale", "stream_adaptive"])
def test_stream_queries_on_events_in_several_files(spark, many_files, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    got = entry.queries()[name](spark, many_files).toPandas()
    want = con.execute(entry.oracle_sql()[name]).fetch_df()
    assert canonical(got) == canonical(want[list(got.columns)])


def test_trigger_times_have_plain_digits(spark):
    peaks = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 2e7), ("a", 3, 500.0)], "session_id string, event_id int, t double")
    clicks = spark.createDataFrame([("a", 0.000512), ("a", 0.0), ("a", 1.5), ("a", 2e7)], "session_id string, ct double")
    out = {r.event_id: r.trigger_times for r in jn.nearby_triggers(peaks, clicks, ["session_id"], "event_id", "t", "ct", 12.0).collect()}
    assert out == {1: "[0.0,0.000512,1.5]", 2: "[20000000.0]", 3: "[]"}


def test_shares_are_rounded_by_their_binary_value(spark):
    shares = sorted({k / n for n in (1, 3, 80, 160, 800, 1600, 20000) for k in range(0, n + 1, max(1, n // 160))} | {0.00625, 0.03125, 0.00015, 1.0})
    rows = spark.createDataFrame([(s,) for s in shares], "s double").select("s", au._four_digits(F.col("s")).alias("t")).collect()
    assert [r.t for r in rows if r.t != "%.4f" % r.s] == []


def test_equal_file_names_are_ranked_by_session(spark):
    rows = [(s, "x", "LR-1-2-26-(1).csv") for s in (5, 3, 9, 1)]
    files = spark.createDataFrame(rows, "session_id bigint, family string, filename string").repartition(3)
    assert [r.session_id for r in rec.session_catalog(files).orderBy("session_rank").collect()] == [1, 3, 5, 9]


def test_one_file_a_session(spark, tmp_path):
    rows = spark.range(400).select((F.col("id") % 5).alias("session_id"), "id").repartition(8)
    sinks.write_table(rows, str(tmp_path / "t"), "json")
    assert len(glob.glob(str(tmp_path / "t" / "*" / "*.json"))) == 5
    assert spark.read.json(str(tmp_path / "t")).count() == 400


def test_a_long_session_is_cut_into_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "ROWS_A_FILE", 50)
    rows = spark.range(400).select(F.when(F.col("id") < 390, "long").when(F.col("id") < 395, "short").alias("session_id"), "id")
    sinks.write_table(rows, str(tmp_path / "t"), "json")
    assert len(glob.glob(str(tmp_path / "t" / "session_id=long" / "*.json"))) > 1
    assert spark.read.json(str(tmp_path / "t")).select("id").distinct().count() == 400


def test_groups_stay_whole_across_batches(spark):
    rows = [(k, i, float(i * (len(k or "") + 1))) for k, n in (("a", 7), ("bb", 1), (None, 5), ("ccc", 12)) for i in range(n)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        def step(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
            ends = [*starts[1:], len(pdf)]
            return pd.DataFrame({"k": pdf["k"].iloc[starts].to_numpy(), "n": [b - a for a, b in zip(starts, ends)], "s": [pdf["x"].iloc[a:b].sum() for a, b in zip(starts, ends)]})

        got = in_groups(spark.createDataFrame(rows, "k string, i int, x double"), ["k"], "i", step, "k string, n bigint, s double").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.k, r.n, r.s) for r in got} == {("a", 7, 42.0), ("bb", 1, 0.0), (None, 5, 10.0), ("ccc", 12, 264.0)} and len(got) == 4


def test_holdout_counts_trials_without_commands_and_broadcasts_no_commands(spark):
    windows = spark.createDataFrame([("t1", 0, "Left"), ("t1", 1, "Left"), ("t2", 0, "Right"), ("t3", 0, "Norm")], "trial string, pos int, label string")
    commands = spark.createDataFrame([("t1", 1, 0, "Left"), ("t3", 0, 0, "Left")], "trial string, pos int, config_id int, command string")
    out = mc.simulate_holdout(windows, commands, ["trial"], "pos", [{"config_id": 0}, {"config_id": 1}], 0.25, 1.0)
    rows = {r.config_id: r for r in out.collect()}
    assert (rows[0].direction_trials, rows[0].correct, rows[0].missed, rows[0].wrong, rows[0].false_triggers, rows[0].avg_latency_s) == (2, 1, 1, 0, 1, 1.25)
    assert (rows[1].correct, rows[1].missed, rows[1].false_triggers, rows[1].avg_latency_s, rows[1].false_triggers_per_min) == (0, 2, 0, None, 0.0)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [trial" in plan and "BroadcastHashJoin [trial" not in plan


def test_many_series_are_filtered_in_few_calls(spark):
    from pulsegrid.operators import filters as fl
    from pulsegrid.timeline import Timeline

    rng = np.random.default_rng(3)
    series = {k: rng.normal(size=n) for k, n in (("a", 40), ("b", 1), ("c", 17))}
    rows = spark.createDataFrame([(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)], "session_id string, sample_idx bigint, x double")
    spec = fl.family_filter("jaw", 250.0)
    out = fl.zero_phase_filter(rows.repartition(3), Timeline(), ["x"], spec)
    assert "MapInPandas" in out._jdf.queryExecution().toString()  # not one call per series
    got = out.toPandas().sort_values(["session_id", "sample_idx"])
    for k, x in series.items():
        assert np.allclose(got[got.session_id == k]["x"], fl.zero_phase(x[None, :], fl.passes(spec))[0])


def test_plateau_middle_does_not_depend_on_the_order_of_positions():
    from pulsegrid.streaming import timed

    machine = timed.Peaks("pos", "v", 1.0)
    rows = [{"at": i, "pos": p, "v": v} for i, (p, v) in enumerate([(50, 0.0), (30, 5.0), (10, 5.0), (20, 5.0), (60, 0.0)])]
    _, out = machine.block(machine.start, rows, 99)
    assert [r["peak_pos"] for r in out] == [20]


def test_rearming_does_not_depend_on_the_order_of_positions():
    from pulsegrid.streaming import timed

    cfg = {**next(c for c in mc.trigger_grid() if c["strategy"] == "binary" and c["k"] == 1 and not c["from_rest"]), "block_ms": 1000.0}
    machine = timed.Clicks("pos", cfg)
    high = [False, True, False, True]
    for places in ([0, 1, 2, 3], [40, 30, 20, 10]):
        rows = [{"at": i * 10_000_000, "pos": p, "clench": float(h), "onset": 0.0, "active": 0.0, "inactive": 0.0, "envelope": 0.0, "state": "INACTIVE"} for i, (p, h) in enumerate(zip(places, high))]
        whole = machine.block(machine.start, rows, 99)[1]
        memory, cut = machine.start, []
        for row in rows:
            memory, out = machine.block(memory, [row], 99)
            cut += out
        assert [r["pos"] for r in whole] == [r["pos"] for r in cut] == [places[1], places[3]]


@pytest.mark.parametrize("block", [1 << 17, 120])
def test_a_forest_keeps_its_trees_off_the_driver(spark, monkeypatch, block):
    """In parts of one block or of several, whole trees: training rows are told apart, and only the first feature matters."""
    from pulsegrid.operators import forest
    from pulsegrid.operators import learn as ln

    monkeypatch.setattr(forest, "BLOCK", block)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4))
    label = np.where(x[:, 0] > 0.5, "B", "A")
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(label=label, key=range(400))
    pdf.loc[7, "b"] = None
    rows = spark.createDataFrame(pdf).repartition(3)
    m = ln.fit_model("forest", rows, list("abcd"), "label", ["A", "B"], trees=8)
    assert isinstance(m, forest.Forest) and m.parts.select("tree").distinct().count() == 8
    assert (m.parts.count() == 8) == (block > 400)
    got = m.score(rows).toPandas().sort_values("key")
    whole = got["key"] != 7
    assert len(got) == 400 and got.loc[~whole, ["prob_A", "prob_B", "predicted"]].isna().all().all()
    assert np.allclose(got[whole]["prob_A"] + got[whole]["prob_B"], 1)
    assert (got[whole]["predicted"].to_numpy() == label[got[whole]["key"]]).mean() > 0.95
    gains = m.importances()
    assert max(gains, key=gains.get) == "a" and abs(sum(gains.values()) - 1) < 1e-9


def test_forest_splits_by_gini():
    from pulsegrid.operators import forest

    codes = np.array([[0, 5], [1, 5], [2, 5], [3, 5]], dtype=np.uint8)
    f, c, left, share, gains = forest.grow(codes, np.array([0, 0, 1, 1]), np.ones(4), 2, 30, 0, 0, 0)
    assert f.tolist() == [0, -1, -1] and c[0] == 1 and left[0] == 1 and share.tolist() == [[0.5, 0.5], [1, 0], [0, 1]]
    assert gains.tolist() == [2.0, 0.0] and forest.route(codes, f, c, left).tolist() == [1, 1, 2, 2]


def test_recordings_are_placed_in_one_pass_over_the_files(spark, tmp_path):
    """Rows carry no file names and no cells through a sort: they only look up the first place of their block."""
    lines = [[f"{i}\t" + "\t".join(str(k) for k in range(8)) + "\t0.5\t0\t0\t1000\t7" for i in range(first, first + 700)] for first in (0, 700)]
    for name, part in zip(("a.txt", "b.txt"), lines):
        (tmp_path / name).write_text("\n".join(part) + "\n")
    (tmp_path / "c.csv").write_text("ch1,label\n" + "\n".join(f"{i},x" for i in range(900)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")  # blocks of one file in several tasks
    try:
        joined = rec.read_recordings(spark, str(tmp_path / "*.txt"), F.lit("s"))
        rows = joined.select("session_id", "sample_idx", "sample_index_raw", "Marker", "ts_raw").orderBy("sample_idx").collect()
        labelled = rec.read_labelled(spark, str(tmp_path / "c.csv"), ["ch1"])
        assert [(r.sample_idx, r.ch1) for r in labelled.orderBy("sample_idx").collect()] == [(i, float(i)) for i in range(900)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.session_id, r.sample_idx, r.sample_index_raw, r.Marker, r.ts_raw) for r in rows] == [("s", i, float(i), 7.0, 1000.0) for i in range(1400)]
    for df in (joined, labelled):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Sort" not in plan and "Window" not in plan and "Scan text" not in plan and "Scan csv" not in plan


def test_quantiles_of_short_and_long_keys(spark, monkeypatch):
    """Short keys are sorted whole without sketch or join, long ones are bracketed; both give the interpolated quantile."""
    rng = np.random.default_rng(3)
    values = {k: np.round(rng.normal(size=n), 1) for k, n in {"a": 500, "b": 7, None: 9, "c": 1}.items()}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("d", None), ("b", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    v = F.col("v")
    for whole in (timeline.WHOLE_ROWS, 20, 0):
        monkeypatch.setattr(timeline, "WHOLE_ROWS", whole)
        out = timeline.exact_quantiles(df, ["k"], {"q": (v, 0.3), "m": (v, 0.5), "s": (F.abs(v), 0.95)})
        got = {r.k: (r.q, r.m, r.s) for r in out.collect()}
        assert set(got) == {"a", "b", None, "c", "d"} and got["d"] == (None, None, None)
        for k, vs in values.items():
            assert got[k] == pytest.approx((np.quantile(vs, 0.3), np.quantile(vs, 0.5), np.quantile(abs(vs), 0.95)), abs=1e-12)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert ("percentile_approx" in plan or "approx_percentile" in plan) == (whole < 500)
        assert "Join" not in plan or whole < 500


def test_references_count_under_every_setting_and_components_share_a_call(spark):
    """References without the setting's key give what references repeated per setting give, in one chunk and in several."""
    from pulsegrid.timeline import Timeline

    rng = np.random.default_rng(2)
    refs = spark.createDataFrame([(s, i, round(float(a), 2)) for s in ("a", "b") for i, a in enumerate(np.sort(rng.uniform(0, 30, 40)))], "session_id string, ref_id int, ref_at double")
    clicks = spark.createDataFrame([(s, c, round(float(a), 2)) for s in ("a", "b") for c in (0, 1) for a in rng.uniform(0, 30, 30)], "session_id string, config_id int, click_at double")
    repeated = refs.withColumn("config_id", F.explode(F.array(F.lit(0), F.lit(1))))
    out = []
    for table, size in ((refs, 1 << 18), (refs, 5), (repeated, 1 << 18), (repeated, 5)):
        got = mc.match_events(table, clicks, Timeline(("session_id", "config_id"), chunk_rows=size), 0.25, 0.5)
        out.append(sorted((r.session_id, r.config_id, r.ref_id, r.click_at) for r in got.collect()))
    assert out[0] and out[1:] == out[:1] * 3


def test_short_series_are_ranked_without_a_join(spark, monkeypatch):
    rows = spark.createDataFrame([(k, t) for k, n in (("a", 30), ("b", 4), (None, 3)) for t in range(n)], "k string, t int").repartition(3)
    for limit in (timeline.RANKED_ROWS, 10, 0):
        monkeypatch.setattr(timeline, "RANKED_ROWS", limit)
        out = timeline.number_rows(rows, ["k"], ["t"], F.floor(F.col("t") / 7), "i")
        assert len(got := out.collect()) == 37 and all(r.i == r.t for r in got)
        assert ("Join" in out._jdf.queryExecution().optimizedPlan().toString()) == (limit < 30)


def test_what_lies_ahead_is_read_once(spark):
    """A frame that ends with the last row is gone through again for every row; frames end at their own row instead."""
    from pulsegrid.timeline import Running, Timeline, carry

    rows = spark.range(60_000).select(F.lit("a").alias("session_id"), F.col("id").alias("sample_idx"))
    spec = {"_next": Running("next", F.when(F.col("sample_idx") % 50_000 == 49_999, F.col("sample_idx")))}
    for short in (False, True):
        out = carry(rows, Timeline(), short=short, **spec)
        assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
        assert out.agg(F.count("_next"), F.max("_next")).first() == (50_000, 49_999)


def test_samples_meet_only_the_spans_near_them():
    from pulsegrid.timeline import Timeline

    assert Timeline().cell == 64 and Timeline(chunk_rows=7).cell == 7


def test_windows_for_the_jaw_benchmark_hash_their_labels(spark):
    from pulsegrid.plans import jaw
    from pulsegrid.timeline import Timeline

    labels = ["INACTIVE", "ONSET", "ACTIVE", "ACTIVE", "OFFSET", "INACTIVE"]
    rows = spark.createDataFrame([("a", i, float(i), float(i), float(i), s) for i, s in enumerate(labels)], "session_id string, sample_idx bigint, ch1 double, aggregate_rms double, aggregate_rms_smooth double, event_label string")
    out = jaw.event_windows(rows, Timeline(), ["ch1"], 4, 2, 20.0).select("window_start", "event_label", "ch1_rms")
    assert [(r.window_start, r.event_label) for r in out.orderBy("window_start").collect()] == [(0, "ACTIVE"), (2, "OFFSET")]
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_waiting_session_keeps_its_peaks_while_another_of_its_bucket_goes_on(spark, tmp_path):
    """Structs in a session's memory are written back although none of its rows were handled since they were read."""
    minute = lambda s, m, x: (s, m, datetime(2024, 1, 1) + timedelta(minutes=m), float(x))
    files = [[minute("a", 0, 0), minute("a", 1, 9), minute("a", 2, 1), minute("b", 0, 0)], [minute("b", m, 0) for m in (60, 61)], [minute("b", 120, 0)], [minute("a", 180, 0)], [minute("clock", 9999, 0)]]
    schema = "session_id string, pos long, ts timestamp, x double"
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = timed.run_timed(live.replay_source(spark, f"{tmp_path}/in/*", spark.createDataFrame([], schema).schema), ["session_id"], "pos", timed.Peaks("pos", "x", 3.0, 2), "1 minute", buckets=1)
    sinks.append_log(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert [(r.session_id, r.peak_pos, r.peak_value, r.emitted_pos) for r in got] == [("a", 1, 9.0, 180)]


def test_moving_averages_add_in_order():
    """The average after the last value, 68.294, is 10 below the upper threshold, 78.294: met exactly if values are added one by one."""
    x = [116.2, 93.62, 178.01, 82.63, 3.63, 8.97, 130.3, 32.48, 7.35, 129.75, 16.2]
    machine = timed.Adaptive("pos", ["y"], 10)
    _, out = machine.block(machine.start, [{"at": i, "pos": i, "y": v} for i, v in enumerate(x)], 0)
    assert [round(r["y_upper"], 4) for r in out[-2:]] == [78.294, 70.4646]


def test_positions_do_not_depend_on_the_number_of_rows(spark, monkeypatch):
    """Positions go by bucket first, also where the order alone would mix the buckets."""
    rows = spark.createDataFrame([(k, b, t) for k in ("a", None) for b in (2, 0, None, 1) for t in range(5)], "k string, b int, t int").repartition(3)
    out = []
    for limit in (timeline.RANKED_ROWS, 10):
        monkeypatch.setattr(timeline, "RANKED_ROWS", limit)
        out.append({(r.k, r.b, r.t): r.i for r in timeline.number_rows(rows, ["k"], ["t"], F.col("b"), "i").collect()})
    assert out[0] == out[1] == {(k, b, t): 5 * n + t for k in ("a", None) for n, b in enumerate((None, 0, 1, 2)) for t in range(5)}


def test_a_later_date_ranks_after_an_earlier_one_of_a_higher_run(spark):
    files = spark.createDataFrame([(i, "x", n) for i, n in enumerate(["LR-2-1-26-(1).csv", "LR-1-1-26-(2).csv", "odd.csv", "LR-1-1-26-(1).csv"])], "session_id int, family string, filename string")
    assert [r.session_id for r in rec.session_catalog(files).orderBy("session_rank").collect()] == [2, 3, 1, 0]


def test_hours_are_rounded_as_the_sql_does(spark, tmp_path):
    """Half a millionth of an hour is 1.8 ms: such times fall on the same side as in the SQL."""
    from workload import joins_q, streaming_q

    rows = spark.range(4000).select(F.col("id").alias("event_id"), F.timestamp_micros(1704067200000000 + 3600 * (1 + F.col("id") * 647891) + 1800).cast("timestamp_ntz").alias("ts"),
                                    F.lit(1).cast("long").alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = dict(con.execute(f"WITH {joins_q.TM} SELECT event_id, t FROM tm").fetchall())
    assert {r.event_id: r.t for r in joins_q.timed(spark, str(tmp_path)).collect()} == want
    assert {r.event_id: r.hour for r in rows.select("event_id", streaming_q.hours().alias("hour")).collect()} == want


def test_a_click_exactly_at_the_radius_is_near(spark):
    """12.3 - 12 is a little more than 0.3 in binary, the distance of 0.3 and 12.3 is 12."""
    peaks = spark.createDataFrame([("a", 1, 12.3), ("a", 2, 100.0)], "session_id string, event_id int, t double")
    clicks = spark.createDataFrame([("a", 0.3), ("a", 0.299999), ("a", 112.0), ("a", 112.000001)], "session_id string, ct double")
    out = {r.event_id: r.trigger_times for r in jn.nearby_triggers(peaks, clicks, ["session_id"], "event_id", "t", "ct", 12.0).collect()}
    assert out == {1: "[0.3]", 2: "[112.0]"}


def test_a_stream_has_no_more_stores_than_cores(spark, tmp_path):
    """A store costs every batch an opening and a commit; the setting of the session stays as it was."""
    rows = spark.range(100).select("id", F.timestamp_seconds(F.col("id") + 10**9).alias("ts"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in/0")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        stream = live.drop_repeats(live.replay_source(spark, f"{tmp_path}/in/*", rows.schema), ["id"], "ts", "1 day")
        sinks.append_log(stream, f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination()
        sinks.split_log(stream, f"{tmp_path}/split", {"all": "true"}, f"{tmp_path}/logs").awaitTermination()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert spark.read.parquet(f"{tmp_path}/out").count() == spark.read.parquet(f"{tmp_path}/split/all").count() == 100
    assert [len(glob.glob(f"{tmp_path}/{log}/state/0/[0-9]*")) for log in ("log", "logs")] == [spark.sparkContext.defaultParallelism] * 2


@pytest.mark.parametrize("name", ["read_labelled", "read_narrow"])
def test_sessions_are_written_and_read_folder_by_folder(spark, tmp_path, monkeypatch, name):
    """No job of the driver knows the files of all sessions; the rows are those of the SQL."""
    from pyspark.sql import DataFrameReader

    from workload import sources_q

    for t in ("events", "lineitem"):
        keep = {"events": F.col("user_id") < 9, "lineitem": F.col("l_suppkey") < 9}[t]
        spark.read.parquet(f"{SF}/{t}.parquet").where(keep).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    monkeypatch.setattr(sources_q, "SESSIONS_A_FOLDER", 2)
    seen = []
    kind = "csv" if name == "read_labelled" else "text"
    old = getattr(DataFrameReader, kind)
    monkeypatch.setattr(DataFrameReader, kind, lambda self, path, *a, **k: seen.append(path) or old(self, path, *a, **k))
    settings = ("spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(s) for s in settings]
    got = entry.queries()[name](spark, str(tmp_path)).toPandas()
    assert [spark.conf.get(s) for s in settings] == before
    con = duckdb.connect()
    for t in ("events", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()[name]).fetch_df()
    assert canonical(got) == canonical(want[list(got.columns)])
    sessions = [glob.glob(f"{p.split('/session=')[0]}/session=*".removeprefix("file:")) for p in seen]
    assert len(seen) > 2 and sum(map(len, sessions)) == got["session_id"].nunique() and all(len(s) < 7 for s in sessions)


def test_paths_read_in_turn_are_one_table(spark, tmp_path):
    """A session of two paths goes on; another header in a later path is an error."""
    for i, (head, first) in enumerate((("ch1,label", 0), ("ch1,label", 300), ("label,ch1", 600))):
        (tmp_path / str(i)).mkdir()
        (tmp_path / str(i) / f"{i}.csv").write_text(head + "\n" + "\n".join(f"{k},x" for k in range(first, first + 300)) + "\n")
    paths = [str(tmp_path / str(i)) for i in range(3)]
    out = rec.read_labelled(spark, paths[:2], ["ch1"], session=F.lit("s"))
    assert out.columns == ["label", "ch1", "session_id", "sample_idx", "time_sec"]
    assert [(r.sample_idx, r.ch1) for r in out.orderBy("sample_idx").collect()] == [(i, float(i)) for i in range(600)]
    with pytest.raises(Exception, match="header"):
        rec.read_labelled(spark, paths, ["ch1"], session=F.lit("s")).collect()
