"""Streaming queries: the events table is replayed as a stream of many files, and the result is read back from the sink.

The replay cuts the table by time; some rows at the end of a cut come one file later, some come twice, and a last file
holds one row of a session of its own far in the future, as the clock of a live system would.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from pulsegrid.functions import steps as st
from pulsegrid.operators import filters as fl
from pulsegrid.operators import machines as mc
from pulsegrid.plans import jaw
from pulsegrid.runtime import materialize, shared_dir
from pulsegrid.sources.registry import BRANCHES
from pulsegrid.sources.sinks import append_log
from pulsegrid.streaming import live, timed
from pulsegrid.timeline import Timeline
from workload import joins_q as jq
from workload import machines_q as mq
from workload.base import EV, NUDGE, hours, r, rounded, table
from workload.registry import query

K = ["session_id"]
FILES, DELAY, CLOCK = 4, "1 day", -1
ROWS_A_FILE = 1 << 19
HOUR = 3_600_000_000
_replays: dict[tuple[str, str, int], tuple[str, int]] = {}


def replay_folder(spark, sf, rows_a_file=ROWS_A_FILE):
    """The events as folders in time order with late and repeated rows, and a last one that moves the clock on.

    Returns the folder and how many files each cut has, which is how many a batch must take: a batch of half a cut would
    move the watermark past the other half.
    """
    key = (spark.sparkContext.applicationId, sf, rows_a_file)
    if key not in _replays:
        events = table(spark, sf, "events")
        lo, hi = events.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
        at = F.unix_micros(F.col("ts").cast("timestamp"))
        part = F.least(F.floor((at - lo) * FILES / (hi - lo)), F.lit(FILES - 1)).cast("int")
        near_end = (lo + (part + 1) * ((hi - lo) / FILES) - at < 12 * HOUR) & (part < FILES - 1)
        late = near_end & (F.col("event_id") % 3 == 0)
        twice = near_end & (F.col("event_id") % 5 == 0)
        rows = events.withColumn("_part", F.explode(F.when(late, F.array(part + 1)).when(twice, F.array(part, part + 1)).otherwise(F.array(part))))
        sizes = {x["_part"]: x["count"] for x in rows.groupBy("_part").count().collect()}
        least, most = min(sizes.get(i, 0) for i in range(FILES)), max(sizes.values(), default=0)
        files = max(1, min(-(-most // rows_a_file), least // 100))  # no file of a cut may stay empty, empty ones are not written
        folder = f"{shared_dir(spark).rstrip('/')}/replay-{uuid.uuid4().hex}"
        for i in range(FILES):
            rows.where(F.col("_part") == i).drop("_part").repartition(files).write.parquet(f"{folder}/{i:02d}")
        clock = events.limit(1).withColumns({"user_id": F.lit(CLOCK).cast(events.schema["user_id"].dataType), "ts": F.timestamp_micros(F.lit(hi) + 90 * 24 * HOUR).cast(events.schema["ts"].dataType)})
        clock.coalesce(1).write.parquet(f"{folder}/{FILES:02d}")
        _replays[key] = folder, files
    return _replays[key]


def event_stream(spark, sf):
    """The replayed events as a stream of ticks: event_id orders the rows of a user in time."""
    folder, files = replay_folder(spark, sf)
    s = live.replay_source(spark, f"{folder}/*", table(spark, sf, "events").schema, files)
    v, l = F.col("value"), F.col("event_type")
    state = F.when(l == "click", "ONSET").when(l == "signup", "ACTIVE").when(l == "view", "OFFSET").otherwise("INACTIVE")
    return s.select(
        F.col("user_id").alias("session_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "value", F.col("event_type").alias("label"), hours().alias("hour"),
        (v / (v + 20.0)).alias("clench"), (v / (v + 30.0)).alias("onset"), (v / (v + 25.0)).alias("active"), (20.0 / (v + 20.0)).alias("inactive"), v.alias("envelope"), state.alias("state"))


def sql(text):
    """Quotes the column ``at``, which is a keyword of the SQL engine."""
    return re.sub(r'\bat\b', '"at"', text)


def run(spark, stream, pos, machine):
    """A timed machine over the sessions of a stream, drained; the clock's own session is left out."""
    return drain(spark, timed.run_timed(stream, K, pos, machine, DELAY)).where(F.col("session_id") != CLOCK).drop("ts")


ES = """es AS (SELECT user_id AS session_id, event_id, epoch_us(ts) AS at, value, event_type AS label, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)"""
ONE = "(SELECT DISTINCT session_id FROM es)"


def drain(spark, stream):
    """Run a stream over everything available and return what it appended."""
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = stream.schema
    append_log(stream, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/out")


@query(f"""WITH {EV}, n AS (SELECT session_id, count(*) AS n FROM ev GROUP BY 1), w AS (SELECT session_id, k * 4 AS window_start FROM n, LATERAL (SELECT unnest(range((n - 9) // 4 + 1)) AS k) WHERE n >= 9)
SELECT w.session_id, window_start, {r('avg(value)')} AS value_mean, {r('stddev_pop(value)')} AS value_std, {r('sqrt(avg(value * value))')} AS value_rms, {r('sqrt(avg(value * value))')} AS aggregate_rms
FROM w JOIN ev ON ev.session_id = w.session_id AND sample_idx BETWEEN window_start AND window_start + 8 GROUP BY 1, 2""")
def stream_tail_windows(spark, sf):
    out = run(spark, event_stream(spark, sf).select("session_id", "event_id", "ts", "value"), "event_id", timed.Tail("event_id", ["value"], 9, 4)).drop("at", "last_pos")
    return rounded(out, ["value_mean", "value_std", "value_rms", "aggregate_rms"])


SECTIONS = fl.bandpass_sections(fl.FilterSpec(0.05, 0.4, 1.0))
(B1, A1), (B2, A2) = [([float(v) for v in b], [float(v) for v in a]) for b, a in SECTIONS]
BANDS = {"slow": (0.1, 0.2), "fast": (0.25, 0.45)}


@query(f"""WITH RECURSIVE {ES}, f AS (SELECT session_id, -1::BIGINT AS i, 0::DOUBLE AS z1, 0::DOUBLE AS z2, 0::DOUBLE AS u1, 0::DOUBLE AS u2, 0::DOUBLE AS y FROM {ONE}
    UNION ALL SELECT session_id, i, {B1[1]!r} * x - ({A1[1]!r}) * y1 + z2, {B1[2]!r} * x - ({A1[2]!r}) * y1, {B2[1]!r} * y1 - ({A2[1]!r}) * y2 + u2, {B2[2]!r} * y1 - ({A2[2]!r}) * y2, y2 FROM (
      SELECT *, {B2[0]!r} * y1 + u1 AS y2 FROM (SELECT es.session_id, es.i, es.value AS x, z1, z2, u1, u2, {B1[0]!r} * es.value + z1 AS y1 FROM f JOIN es ON es.session_id = f.session_id AND es.i = f.i + 1))),
  w AS (SELECT session_id, i AS e, i - 15 AS s FROM f WHERE i >= 15 AND (i - 15) % 8 = 0),
  x AS (SELECT w.session_id, s, f.i - s AS j, y FROM w JOIN f ON f.session_id = w.session_id AND f.i BETWEEN s AND e),
  m AS (SELECT session_id, s, avg(y) AS m, stddev_pop(y) AS sd, sqrt(avg(y * y)) AS rm FROM x GROUP BY 1, 2),
  p AS (SELECT session_id, s, k, pow(sum((y - m) * h * cos(2 * pi() * k * j / 16.0)), 2) + pow(sum((y - m) * h * sin(2 * pi() * k * j / 16.0)), 2) AS q
    FROM (SELECT x.*, m, 0.5 - 0.5 * cos(2 * pi() * j / 16.0) AS h FROM x JOIN m USING (session_id, s)), (SELECT unnest(range(2, 8))::DOUBLE AS k) GROUP BY 1, 2, 3),
  b AS (SELECT session_id, s, sum(q) FILTER (k BETWEEN 2 AND 3) / 3.0 AS slow, sum(q) FILTER (k BETWEEN 4 AND 7) / 3.0 AS fast FROM p GROUP BY 1, 2)
SELECT session_id, s AS window_start, event_id AS last_pos, {r('m')} AS value_mean, {r('sd')} AS value_std, {r('rm')} AS value_rms, {r('slow', 5)} AS value_slow_power, {r('fast', 5)} AS value_fast_power
FROM m JOIN b USING (session_id, s) JOIN es ON es.session_id = m.session_id AND es.i = s + 15""")
def stream_filtered_tail(spark, sf):
    """Causally filtered tail with band powers; the filter's memory is state."""
    out = run(spark, event_stream(spark, sf).select("session_id", "event_id", "ts", "value"), "event_id", timed.Tail("event_id", ["value"], 16, 8, 1.0, SECTIONS, BANDS))
    return rounded(rounded(out.drop("at", "aggregate_rms"), ["value_mean", "value_std", "value_rms"]), ["value_slow_power", "value_fast_power"], 5)


@query(f"""WITH w AS (SELECT user_id AS session_id, value, time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2024-01-01') AS b, ts FROM events),
  a AS (SELECT session_id, unnest([b, b - INTERVAL 12 HOUR]) AS s, value FROM w)
SELECT session_id, s AS window_start, s + INTERVAL 24 HOUR AS window_end, count(*) AS n, {r('avg(value)')} AS mean, {r('stddev_pop(value)')} AS std, {r('sqrt(avg(value * value))')} AS rms, {r('max(value) - min(value)')} AS ptp
FROM a GROUP BY 1, 2""")
def stream_window_features(spark, sf):
    out = drain(spark, live.window_features(live.drop_repeats(event_stream(spark, sf), ["session_id", "event_id"], "ts", DELAY), K, "ts", "value", "24 hours", "12 hours")).where(F.col("session_id") != CLOCK)
    return rounded(out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}), ["mean", "std", "rms", "ptp"])


@query("SELECT user_id AS session_id, event_id, event_type AS label FROM events")
def stream_drop_repeats(spark, sf):
    s = event_stream(spark, sf).select("session_id", "event_id", "label", "ts")
    return drain(spark, live.drop_repeats(s, ["session_id", "event_id"], "ts", DELAY)).where(F.col("session_id") != CLOCK).drop("ts")


PEAK, CONFIRM = 10.0, 2


@query(f"""WITH {ES}, g AS (SELECT *, i - row_number() OVER (PARTITION BY session_id, value ORDER BY i) AS run FROM es),
  t AS (SELECT session_id, value AS v, min(i) AS s, max(i) AS e, min(event_id) AS es_, max(event_id) AS ee FROM g GROUP BY session_id, value, run),
  k AS (SELECT * FROM (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM t WINDOW w AS (PARTITION BY session_id ORDER BY s)) WHERE a < v AND b < v),
  h AS (SELECT k.session_id, v, s, e, (es_ + ee) // 2 AS peak_pos, coalesce(max(x.i) FILTER (x.i < s AND x.value > v), -1) AS lo, coalesce(min(x.i) FILTER (x.i > e AND x.value > v), 1000000000000) AS hi FROM k JOIN es x ON x.session_id = k.session_id GROUP BY 1, 2, 3, 4, 5),
  c AS (SELECT h.session_id, v, e, peak_pos, min(x.i) FILTER (x.i > e AND v - x.value >= {PEAK}) AS sure FROM h JOIN es x ON x.session_id = h.session_id AND x.i > lo AND x.i < hi
    GROUP BY h.session_id, v, s, e, peak_pos HAVING v - min(x.value) FILTER (x.i < s) >= {PEAK})
SELECT c.session_id, peak_pos, v AS peak_value, event_id AS emitted_pos FROM c JOIN es ON es.session_id = c.session_id AND es.i = greatest(sure, e + {CONFIRM}) WHERE sure IS NOT NULL""")
def stream_peaks(spark, sf):
    return run(spark, event_stream(spark, sf).select("session_id", "event_id", "ts", "value"), "event_id", timed.Peaks("event_id", "value", PEAK, CONFIRM)).drop("at")


ONE_TRIGGER = {**mc.trigger_grid()[24], "block_ms": 6 * HOUR / 1000.0}
TRIGGER_SQL = "({config_id}, '{strategy}', {clench}, {onset}, {active}, {rearm}, {block_ms}::DOUBLE, {k}, {from_rest}, {rise})".format(**ONE_TRIGGER)


@query(sql(f"""WITH RECURSIVE {EV}, {mq.SCO.replace('sample_idx * 0.1::DOUBLE AS t', 'epoch_us(ts) / 1000000.0::DOUBLE AS t')}, {mq.CAND.replace(mq.GSQL, TRIGGER_SQL)}
SELECT wk.session_id, ev.event_id AS pos, epoch_us(ev.ts) AS at, reason FROM wk JOIN cn USING (config_id, session_id, i) JOIN ev ON ev.session_id = wk.session_id AND ev.sample_idx = cn.sample_idx WHERE click"""))
def stream_clicks(spark, sf):
    return run(spark, event_stream(spark, sf), "event_id", timed.Clicks("event_id", ONE_TRIGGER))


HOLDS = {**st.HOLD, "onset_sec": 8 * 3600.0, "release_sec": 3 * 3600.0}
LATCHES = {"latch_sec": 6 * 3600.0, "cooldown_sec": 4 * 3600.0}


def hold_sql(onset, release):
    """Walks rows (session_id, i, at, eng, clk) of ``hs`` one by one."""
    up, down = f"eng AND NOT held AND hs.at - coalesce(since, hs.at) >= {onset}", f"NOT eng AND held AND rel IS NOT NULL AND hs.at - rel >= {release}"
    return f"""hw AS (SELECT session_id, -1::BIGINT AS i, NULL::BIGINT AS at, false AS held, NULL::BIGINT AS since, NULL::BIGINT AS rel, false AS c, false AS up, false AS down FROM (SELECT DISTINCT session_id FROM hs)
    UNION ALL SELECT hs.session_id, hs.i, hs.at, CASE WHEN {up} THEN true WHEN {down} THEN false ELSE held END, CASE WHEN eng THEN coalesce(since, hs.at) END,
      CASE WHEN eng OR NOT held THEN NULL WHEN rel IS NULL THEN hs.at WHEN hs.at - rel >= {release} THEN NULL ELSE rel END, clk AND NOT held, coalesce({up}, false), coalesce({down}, false)
    FROM hw JOIN hs ON hs.session_id = hw.session_id AND hs.i = hw.i + 1)"""


def latch_sql(latch, cooldown):
    """Walks rows (session_id, i, at, lab) of ``ls`` one by one; a latch that has ended by then is neutral before the row."""
    return f"""lw AS (SELECT session_id, -1::BIGINT AS i, NULL::BIGINT AS at, 'NEUTRAL' AS side, NULL::BIGINT AS till, NULL::BIGINT AS sw, NULL::VARCHAR AS lab, false AS tk FROM (SELECT DISTINCT session_id FROM ls)
    UNION ALL SELECT session_id, i, at, CASE WHEN ok THEN nl ELSE side END, CASE WHEN ok THEN at + {latch} ELSE till END, CASE WHEN ok THEN at ELSE sw END, nl, ok FROM (
      SELECT *, nl IS NOT NULL AND NOT (side <> 'NEUTRAL' AND side <> nl AND at - sw < {cooldown}) AS ok FROM (
        SELECT ls.session_id, ls.i, ls.at, CASE WHEN ls.at > till THEN 'NEUTRAL' ELSE side END AS side, till, sw, ls.lab AS nl FROM lw JOIN ls ON ls.session_id = lw.session_id AND ls.i = lw.i + 1)))"""


ENDS = "en AS (SELECT session_id, i, till AS at FROM (SELECT *, lead(at) OVER (PARTITION BY session_id ORDER BY i) AS nx FROM lw WHERE tk) WHERE nx IS NULL OR nx > till)"
FIRED = "unnest(list_filter([CASE WHEN c THEN 'CLICK' END, CASE WHEN up THEN 'HOLD_START' END, CASE WHEN down THEN 'HOLD_END' END], lambda x: x IS NOT NULL))"


@query(sql(f"""WITH RECURSIVE {ES}, hs AS (SELECT *, value / (value + 25.0) >= 0.7 OR value / (value + 20.0) >= 0.7 OR label IN ('click', 'signup') AS eng, value > 60 AS clk FROM es), {hold_sql(8 * HOUR, 3 * HOUR)}
SELECT hw.session_id, es.event_id AS pos, hw.at, {FIRED} AS action FROM hw JOIN es USING (session_id, i) WHERE c OR up OR down"""))
def stream_holds(spark, sf):
    s = event_stream(spark, sf)
    engaged = (F.col("active") >= 0.7) | (F.col("clench") >= 0.7) | F.col("state").isin("ONSET", "ACTIVE")
    return run(spark, s.select("session_id", "event_id", "ts", engaged.alias("engaged"), (F.col("value") > 60).alias("clicked")), "event_id", timed.Hold("event_id", HOLDS))


@query(sql(f"""WITH RECURSIVE {ES}, ls AS (SELECT *, CASE label WHEN 'click' THEN 'LEFT' WHEN 'signup' THEN 'RIGHT' END AS lab FROM es), {latch_sql(6 * HOUR, 4 * HOUR)}, {ENDS}
SELECT lw.session_id, lw.at, es.event_id AS pos, lab AS label, tk AS taken, side AS shown, false AS expired FROM lw JOIN es USING (session_id, i)
UNION ALL SELECT session_id, at, NULL, NULL, false, 'NEUTRAL', true FROM en"""))
def stream_latch(spark, sf):
    """Latched directions; a latch ends by a timer, with or without a later row."""
    lab = F.when(F.col("label") == "click", "LEFT").when(F.col("label") == "signup", "RIGHT")
    return run(spark, event_stream(spark, sf).select("session_id", "event_id", "ts", lab.alias("label")), "event_id", timed.Latch("event_id", LATCHES))


@query(sql(f"""WITH {ES}, n AS (SELECT *, lead(at) OVER (PARTITION BY session_id ORDER BY i) AS nx FROM es)
SELECT session_id, at + {48 * HOUR} AS at, true AS stale, {48 * HOUR}::BIGINT AS silent_us FROM n WHERE nx IS NULL OR nx > at + {48 * HOUR} UNION ALL SELECT session_id, nx, false, nx - at FROM n WHERE nx > at + {48 * HOUR}"""))
def stream_stale(spark, sf):
    """Sessions that fall silent for two days, and come back."""
    return run(spark, event_stream(spark, sf).select("session_id", "event_id", "ts"), "event_id", timed.Stale(48 * 3600.0))


@query(sql(f"""WITH {ES}, f AS (SELECT *, min(at) OVER (PARTITION BY session_id) AS first FROM es), s AS (SELECT session_id, avg(value) AS m, coalesce(nullif(stddev_pop(value), 0), 1) AS d FROM f WHERE at - first < {240 * HOUR} GROUP BY 1)
SELECT session_id, event_id AS pos, at - first >= {240 * HOUR} AS ready, false AS uncalibrated, CASE WHEN at - first >= {240 * HOUR} THEN {r('(value - m) / d')} END AS value_z FROM f JOIN s USING (session_id)"""))
def stream_calibrated(spark, sf):
    out = run(spark, event_stream(spark, sf).select("session_id", "event_id", "ts", "value"), "event_id", timed.Calibrate("event_id", ["value"], 240 * 3600.0)).drop("at")
    return rounded(out, ["value_z"])


@query(f"""WITH RECURSIVE {ES}, av AS (SELECT session_id, event_id, i, avg(least(abs(value), 200.0)) OVER (PARTITION BY session_id ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS a FROM es),
  wk AS (SELECT session_id, -1::BIGINT AS i, 6.0::DOUBLE AS lo, 16.0::DOUBLE AS up, 0.0::DOUBLE AS a, 0.0::DOUBLE AS o, 0.0::DOUBLE AS x FROM {ONE}
    UNION ALL SELECT session_id, j, l4, u4, a2, greatest(0, (a2 - l4) / (u4 - l4)), x + (1.0 - 0.9)::DOUBLE * (greatest(0, (a2 - l4) / (u4 - l4)) - x) FROM (SELECT *, greatest(u2, l4 + 10.0) AS u4 FROM (
      SELECT *, greatest(CASE WHEN l2 <= a2 THEN l2 / 0.99999 ELSE l2 END, 6.0) AS l4 FROM (
        SELECT *, greatest(least(lo, a2), 1.0) AS l2, CASE WHEN a2 + 10.0 <= u1 THEN u1 * 0.9::DOUBLE ELSE u1 END AS u2 FROM (
          SELECT av.session_id, av.i AS j, av.a AS a2, lo, x, CASE WHEN up <= av.a AND av.a <= 200.0 THEN av.a ELSE up END AS u1 FROM wk JOIN av ON av.session_id = wk.session_id AND av.i = wk.i + 1)))))
SELECT wk.session_id, event_id AS pos, {r('wk.a')} AS value_average, {r('lo')} AS value_lower, {r('up')} AS value_upper, {r('o')} AS value_output, {r('x')} AS x_smooth FROM wk JOIN av USING (session_id, i)""")
def stream_adaptive(spark, sf):
    out = run(spark, event_stream(spark, sf).select("session_id", "event_id", "ts", "value"), "event_id", timed.Adaptive("event_id", ["value"], 10, right=["value"])).drop("at")
    return rounded(out, ["value_average", "value_lower", "value_upper", "value_output", "x_smooth"])


CONTROL = {"hold": {**st.HOLD, "onset_sec": 24 * 3600.0, "release_sec": 12 * 3600.0}, "hand": {"latch_sec": 48 * 3600.0, "cooldown_sec": 24 * 3600.0}}
STEPS = Timeline(chunk_rows=64, pos="step")


def ticks(rows):
    """Calibrated features of the tail as ticks of the control step."""
    score = F.col("value_mean_z") + 0.5 * F.col("value_std_z")
    return jaw.decoder_ticks(rows, 1 / (1 + F.exp(-score)), F.abs("value_std_z") > 0.5, F.col("value_rms") > 25, F.col("value_mean") > 45)


DECODED = f"""n AS (SELECT session_id, count(*) AS n FROM es GROUP BY 1), w AS (SELECT session_id, s, s // 4 AS i FROM (SELECT session_id, unnest(range((n - 9) // 4 + 1)) * 4 AS s FROM n WHERE n >= 9)),
  f AS (SELECT w.session_id, w.i, max(at) AS at, max(event_id) AS pos, avg(value) AS m, stddev_pop(value) AS d, sqrt(avg(value * value)) AS e FROM w JOIN es ON es.session_id = w.session_id AND es.i BETWEEN s AND s + 8 GROUP BY 1, 2),
  g AS (SELECT *, at - min(at) OVER (PARTITION BY session_id) >= {240 * HOUR} AS ready FROM f),
  c AS (SELECT session_id, avg(m) AS mm, coalesce(nullif(stddev_pop(m), 0), 1) AS ms, avg(d) AS dm, coalesce(nullif(stddev_pop(d), 0), 1) AS ds FROM g WHERE NOT ready GROUP BY 1),
  z AS (SELECT g.*, CASE WHEN ready THEN (d - dm) / ds END AS dz, CASE WHEN ready THEN 1 / (1 + exp(-((m - mm) / ms + 0.5 * (d - dm) / ds))) END AS p FROM g JOIN c USING (session_id)),
  tk AS (SELECT *, coalesce(abs(dz) > 0.5, false) AS event, CASE WHEN p > 0.5 THEN 'LEFT' ELSE 'RIGHT' END AS side, greatest(p, 1 - p) AS best, coalesce(greatest(p, 1 - p) >= 0.6 AND abs(2 * p - 1) >= 0.1, false) AS agreed FROM z),
  hs AS (SELECT session_id, i, at, e > 25 AS eng, m > 45 AS clk FROM tk), {hold_sql(24 * HOUR, 12 * HOUR)},
  ls AS (SELECT session_id, i, at, CASE WHEN event AND agreed THEN side END AS lab FROM tk), {latch_sql(48 * HOUR, 24 * HOUR)}, {ENDS},
  o AS (SELECT tk.session_id, tk.i, tk.at, pos, nullif(array_to_string(list_filter([CASE WHEN c THEN 'CLICK' END, CASE WHEN up THEN 'HOLD_START' END, CASE WHEN down THEN 'HOLD_END' END, CASE WHEN event THEN tk.side END], lambda x: x IS NOT NULL), ' '), '') AS actions,
    lw.tk AS accepted, lw.side AS hand, held, c, best FROM tk JOIN hw USING (session_id, i) JOIN lw USING (session_id, i)),
  fin AS (SELECT session_id, at, pos, actions, accepted, hand, CASE WHEN held AND hand <> 'NEUTRAL' THEN 'CLICK_HOLD | ' || hand WHEN held THEN 'CLICK_HOLD' WHEN c AND hand <> 'NEUTRAL' THEN 'CLICK | ' || hand WHEN c THEN 'CLICK' ELSE hand END AS decoded, best AS confidence FROM o
    UNION ALL SELECT en.session_id, en.at, NULL, 'EXPIRED', false, 'NEUTRAL', CASE WHEN arg_max(held, o.i) FILTER (o.at <= en.at) THEN 'CLICK_HOLD' ELSE 'NEUTRAL' END, NULL FROM en JOIN o ON o.session_id = en.session_id GROUP BY en.session_id, en.i, en.at)"""
DECODER_SQL = sql(f"WITH RECURSIVE {ES}, {DECODED} SELECT session_id, at, pos, actions, accepted, hand, decoded, {r('confidence')} AS confidence FROM fin")


@query(DECODER_SQL)
def stream_control_events(spark, sf):
    """The whole live decoder in one query: tail features, calibration, scores, then holds, latches and decoded states."""
    tail = timed.run_timed(event_stream(spark, sf).select("session_id", "event_id", "ts", "value"), K, "event_id", timed.Tail("event_id", ["value"], 9, 4), DELAY)
    feats = tail.select("session_id", "ts", "last_pos", "value_mean", "value_std", "value_rms")
    calibrated = timed.run_timed(feats, K, "last_pos", timed.Calibrate("last_pos", ["value_mean", "value_std"], 240 * 3600.0, keep=["value_mean", "value_rms"]))
    control = timed.run_timed(ticks(calibrated).select("session_id", "ts", "pos", "ready", "label", "confidence", "agreed", "event", "engaged", "clicked"), K, "pos", timed.Control("pos", **CONTROL))
    return rounded(drain(spark, control).where(F.col("session_id") != CLOCK).drop("ts"), ["confidence"])


@query(DECODER_SQL)
def replay_decoder(spark, sf):
    """The same decoder over the recorded table: batch windows, calibration by aggregation, and the control step in chunks."""
    tl = Timeline(chunk_rows=96)
    samples = mq.event_samples(spark, sf).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    first = F.floor((F.col("sample_idx") - 8 + 3) / 4).cast("bigint")
    windows = samples.withColumn("step", F.explode(F.sequence(F.greatest(first, F.lit(0)), F.floor(F.col("sample_idx") / 4).cast("bigint"))))
    feats = materialize(windows.groupBy("session_id", "step").agg(
        F.count(F.lit(1)).alias("_n"), F.max("at").alias("at"), F.max("event_id").alias("pos"), F.avg("value").alias("value_mean"), F.stddev_pop("value").alias("value_std"),
        F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("value_rms")).where(F.col("_n") == 9).drop("_n"))
    first_at = feats.groupBy("session_id").agg(F.min("at").alias("_first"))
    timed_feats = feats.join(first_at, "session_id").withColumn("ready", F.col("at") - F.col("_first") >= 240 * HOUR)
    names = ["value_mean", "value_std"]
    spread = timed_feats.where(~F.col("ready")).groupBy("session_id").agg(*[F.avg(c).alias(f"_m_{c}") for c in names], *[F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(f"_d_{c}") for c in names])
    z = timed_feats.join(spread, "session_id").withColumns({f"{c}_z": F.when(F.col("ready"), (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_d_{c}")) for c in names})
    rows = ticks(z).select("session_id", "step", "at", "pos", "ready", "label", "confidence", "agreed", "event", "engaged", "clicked")
    return rounded(jaw.replay_control(rows, STEPS, timed.Control("pos", **CONTROL)), ["confidence"])


@query(sql(f"""WITH {ES}, p AS (SELECT session_id, event_id AS prompt_id, CASE WHEN event_id % 2 = 0 THEN 'click' ELSE 'signup' END AS target, at AS start_us FROM es WHERE label = 'purchase'),
  h AS (SELECT p.*, d.at AS d_at, d.label AS d_class, min(CASE WHEN d.label = target THEN d.at END) OVER (PARTITION BY p.session_id, prompt_id) AS f
    FROM p LEFT JOIN es d ON d.session_id = p.session_id AND d.label IN ('click', 'signup') AND d.at BETWEEN start_us AND start_us + {20 * HOUR})
SELECT session_id, prompt_id, target, start_us, coalesce(max(f), start_us + {20 * HOUR}) AS end_us, max(f) IS NOT NULL AS success, max(f) - start_us AS latency_us, count(*) FILTER (d_class <> target AND (f IS NULL OR d_at < f)) AS wrong_detections_count,
  max(f) IS NULL AS timeout_flag FROM h GROUP BY 1, 2, 3, 4"""))
def stream_prompts(spark, sf):
    """Every prompt closes at its first right detection or its timeout; repeated rows are dropped first."""
    s = live.drop_repeats(event_stream(spark, sf).select("session_id", "event_id", "ts", "label"), ["session_id", "event_id"], "ts", DELAY)
    again = live.drop_repeats(event_stream(spark, sf).select("session_id", "event_id", "ts", "label"), ["session_id", "event_id"], "ts", DELAY)
    prompts = s.where((F.col("label") == "purchase") | (F.col("session_id") == CLOCK)).select(
        "session_id", "ts", F.col("event_id").alias("prompt_id"), F.when(F.col("event_id") % 2 == 0, "click").otherwise("signup").alias("target"))
    detections = again.where(F.col("label").isin("click", "signup") | (F.col("session_id") == CLOCK)).select("session_id", "ts", F.col("label").alias("detected"))
    return drain(spark, timed.prompt_outcomes(prompts, detections, K, 20 * 3600.0)).where(F.col("session_id") != CLOCK)


@query(f"""WITH {jq.TM}, g AS (SELECT DISTINCT session_id, floor(t / 48) * 48 + 6.0 AS s, floor(t / 48) * 48 + 30.0 AS e FROM tm WHERE label = 'error')
SELECT tm.session_id, event_id, t AS hour, CASE WHEN s IS NULL THEN 'UNKNOWN' ELSE 'BUSY' END AS truth FROM tm LEFT JOIN g ON g.session_id = tm.session_id AND t BETWEEN s AND e""")
def stream_ground_truth(spark, sf):
    base = F.floor(F.col("t") / 48) * 48
    segs = jq.timed(spark, sf).filter("label = 'error'").select("session_id", (base + 6.0).alias("g_start"), (base + 30.0).alias("g_end"), F.lit("BUSY").alias("truth")).distinct()
    s = event_stream(spark, sf).select("session_id", "event_id", "hour")
    return drain(spark, live.with_ground_truth(s, segs, K, "hour", 24.0)).where(F.col("session_id") != CLOCK).distinct()


@query("""SELECT user_id AS session_id, event_id, branch, protocol_family FROM (SELECT user_id, event_id, CASE WHEN event_type IN ('click', 'error') THEN 'jaw' ELSE 'hand' END AS branch,
    CASE n_regionkey % 3 WHEN 0 THEN 'HR' WHEN 1 THEN 'LR' ELSE 'LRJ' END AS protocol_family FROM events JOIN supplier ON user_id = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
WHERE protocol_family = 'LRJ' OR (protocol_family = 'HR' AND branch = 'jaw') OR (protocol_family = 'LR' AND branch = 'hand')""")
def stream_enabled_branches(spark, sf):
    fam = F.element_at(F.array(F.lit("HR"), F.lit("LR"), F.lit("LRJ")), (F.col("n_regionkey") % 3 + 1).cast("int"))
    c = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("session_id"), fam.alias("protocol_family"))
    s = event_stream(spark, sf).select("session_id", "event_id", F.when(F.col("label").isin("click", "error"), "jaw").otherwise("hand").alias("branch"))
    return drain(spark, live.enabled_branches(s, c, BRANCHES)).distinct()


@query(sql(f"""WITH {ES}, f AS (SELECT *, min(at) OVER (PARTITION BY session_id) AS first FROM es) SELECT session_id, event_id AS pos, at - first AS since_us FROM f WHERE at - first >= {3 * HOUR}"""))
def stream_after_warmup(spark, sf):
    """No decisions in the first hours of a session."""
    return run(spark, event_stream(spark, sf).select("session_id", "event_id", "ts"), "event_id", timed.Warmup("event_id", 3 * 3600.0, 2 * 3600.0)).drop("at")
