"""Source and sink queries: tables are written as recordings, read back and compared with the originals."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pulsegrid.operators import events as evt
from pulsegrid.operators import features as ft
from pulsegrid.operators import learn as ln
from pulsegrid.operators import machines as mc
from pulsegrid.operators import signal as sg
from pulsegrid.operators import windows as wn
from pulsegrid.plans import jaw
from pulsegrid.runtime import materialize, shared_dir
from pulsegrid.sources import recordings as rec
from pulsegrid.sources import sinks
from pulsegrid.timeline import Timeline
from workload import streaming_q as stq
from workload import windows_q as wq
from workload.base import CHANNELS, EV, ITEMS_TL, LI, event_samples, item_samples, r, rounded
from workload.registry import query

BIG = Timeline()
ROWS_A_TASK = 1 << 20
SESSIONS_A_FOLDER = 1 << 14


def session_of():
    return F.regexp_extract(F.col("_metadata.file_path"), r"session=(\d+)", 1).cast("bigint")


def folder(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def in_folders(rows, path, write):
    """Sessions written as files of their own into folders of about ``SESSIONS_A_FOLDER`` sessions, one folder after another.

    The driver holds the names of all that one job writes or reads, so a job sees the sessions of one folder. Rows go by
    range of session and position in tasks of about a million; the range is sampled from the table. Returns the folders.
    """
    spark, rows = rows.sparkSession, materialize(rows)
    n = max(1, -(-rows.select("session_id").distinct().count() // SESSIONS_A_FOLDER))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")) // n, -(-rows.count() // (n * ROWS_A_TASK)), 1)
    dealt = folder(spark, "dealt")
    used = [0]  # by a hash a folder may stay empty
    if n > 1:
        rows.withColumn("folder", F.pmod(F.xxhash64("session_id"), F.lit(n))).write.partitionBy("folder").parquet(dealt)
        used = [r["folder"] for r in spark.read.parquet(dealt).select("folder").distinct().orderBy("folder").collect()]
    for i in used:
        part = rows if n == 1 else spark.read.schema(rows.schema).parquet(f"{dealt}/folder={i}")
        write(part.repartitionByRange(parts, "session_id", "sample_idx").sortWithinPartitions("session_id", "sample_idx"), f"{path}/{i}")
    return [f"{path}/{i}" for i in used]


def written(spark, sf):
    """Items as headerless tab-separated recordings of 13 columns; long sessions spread over several files."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("n/a"))
    cells = [text("sample_idx"), *[text(c) for c in CHANNELS], *[F.lit("x")] * 4, F.lit("0.5"), F.lit("0.25"), text("t"), text("m")]
    rows = item_samples(spark, sf).withColumns({"t": F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).cast("double"), "m": F.col("l_linenumber").cast("double")})
    write = lambda part, into: part.select(F.col("session_id").alias("session"), F.concat_ws("\t", *cells).alias("value")).write.partitionBy("session").text(into)
    return in_folders(rows.select("session_id", "sample_idx", *CHANNELS, "t", "m"), folder(spark, "recordings"), write)


@query(f"""WITH {LI} SELECT session_id, sample_idx, sample_idx::DOUBLE AS sample_index_raw, ch1 AS "Channel_1", ch2 AS "Channel_2", ch3 AS "Channel_3", ch4 AS "Channel_4", NULL::DOUBLE AS "Channel_8", 0.5::DOUBLE AS "Accel_0", 0.25::DOUBLE AS "Accel_1", 13 AS columns FROM li""")
def read_recordings(spark, sf):
    out = rec.read_recordings(spark, written(spark, sf), session_of())
    return out.select("session_id", "sample_idx", "sample_index_raw", "Channel_1", "Channel_2", "Channel_3", "Channel_4", "Channel_8", "Accel_0", "Accel_1", "columns")


@query(f"""WITH li2 AS (SELECT l_suppkey AS session_id, l_quantity AS ch1, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS sample_idx FROM lineitem)
SELECT session_id, sample_idx, sample_idx::DOUBLE AS "Sample_Index", ch1 AS "Channel_1", l_linenumber::DOUBLE AS "Marker" FROM li2""")
def read_narrow(spark, sf):
    return rec.read_narrow(spark, written(spark, sf), session_of()).select("session_id", "sample_idx", "Sample_Index", "Channel_1", "Marker")


@query(f"WITH {EV} SELECT session_id, sample_idx, label, value AS ch1, sample_idx / 250.0::DOUBLE AS time_sec FROM ev")
def read_labelled(spark, sf):
    write = lambda part, into: part.select(F.col("session_id").alias("session"), F.col("value").alias("ch1"), "label").write.partitionBy("session").option("header", True).csv(into)
    folders = in_folders(event_samples(spark, sf).select("session_id", "sample_idx", "value", "label"), folder(spark, "labelled"), write)
    # the folder name already gives the session, so only the files' own columns are read
    return rec.read_labelled(spark, [f"{f}/session=*" for f in folders], ["ch1", "label"], 250.0, session_of()).select("session_id", "sample_idx", "label", "ch1", "time_sec")


@query("SELECT user_id AS session_id, event_id, value FROM events")
def write_table(spark, sf):
    path = folder(spark, "table")
    sinks.write_table(event_samples(spark, sf).select("session_id", "event_id", "value"), path, "json")
    return spark.read.schema("event_id bigint, value double, session_id bigint").json(path).select("session_id", "event_id", "value")


@query("SELECT 'detections' AS log, event_id FROM events WHERE event_type IN ('click', 'signup') UNION ALL SELECT 'prompts', event_id FROM events WHERE event_type = 'purchase' UNION ALL SELECT 'trace', event_id FROM events")
def split_log(spark, sf):
    path = folder(spark, "logs")
    kinds = {"detections": "label IN ('click', 'signup')", "prompts": "label = 'purchase'", "trace": "true"}
    once = stq.live.drop_repeats(stq.event_stream(spark, sf).select("session_id", "event_id", "label", "ts"), ["session_id", "event_id"], "ts", stq.DELAY)
    sinks.split_log(once.where(F.col("session_id") != stq.CLOCK).select("event_id", "label"), path, kinds, f"{path}-state").awaitTermination()
    parts = [spark.read.parquet(f"{path}/{k}").select(F.lit(k).alias("log"), "event_id") for k in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query()
def jaw_click_benchmark(spark, sf):
    """Labels to windows to models to tuned clicks to gate, in one run."""
    samples, segments = wq.blocks(spark, sf)
    kind = F.when(F.col("label") == "LEFT", "HOLD").when(F.col("label") == "RIGHT", "REPEATED").otherwise("REST")
    env = materialize(sg.with_envelope(samples, ITEMS_TL, CHANNELS, 8))
    bundle = evt.label_jaw_events(env, materialize(segments.withColumn("label", kind)), BIG, "aggregate_rms_smooth", 20.0)
    labelled = materialize(env.join(bundle["samples"].select("session_id", "sample_idx", "event_label"), ["session_id", "sample_idx"]))
    onsets = evt.reference_onsets(bundle["intervals"], 20.0).select("session_id", F.col("event_id").alias("ref_id"), F.col("reference_onset_time_sec").alias("ref_at"))
    roles = materialize(samples.select("session_id").distinct().withColumn("split_role", F.when(F.col("session_id") % 4 == 0, "test").otherwise("train")))
    feats = [f"{c}_rms" for c in CHANNELS] + ["aggregate_rms_mean", "aggregate_rms_smooth_mean", "aggregate_rms_smooth_slope"]
    # only the features of the models are computed
    windows = materialize(jaw.event_windows(labelled, BIG, CHANNELS, 4, 2, 20.0).select("session_id", "window_start", "event_label", "at", *feats))
    grid = mc.trigger_grid()
    return jaw.jaw_click_benchmark(windows, onsets, roles, feats, BIG, grid)["summary"]


@query()
def replay_rows(spark, sf):
    samples, segments = wq.blocks(spark, sf)
    rows = wn.assign_session_windows(samples, ITEMS_TL, 9, 4).groupBy("session_id", "window_start").agg(F.count(F.lit(1)).alias("n_samples"), *ft.rms_features(CHANNELS))
    steps = materialize(wn.full_windows(rows, 9).withColumns({"step_id": F.col("window_start"), "at": (F.col("window_start") + 4).cast("double")}))
    segs = materialize(segments.select("session_id", F.col("start_sample").cast("double").alias("g_start"), F.col("end_sample").cast("double").alias("g_end"), F.col("segment_index").alias("order"), F.col("label").alias("truth")))
    feats = [f"{c}_rms" for c in CHANNELS]
    train = jaw.jn.ground_truth_at(steps, segs, ["session_id"], "step_id", "at", "g_start", "g_end", "order", "truth", 64.0)
    model = ln.fit_model("lda", train, feats, "truth", ["REST", "LEFT", "RIGHT"])
    return jaw.replay_rows(steps, model, segs, BIG, 64.0)
