"""Trigger, decoder, hold, latch and adaptive-threshold queries.

Machines with scalar state are checked against recursive SQL that walks the rows one by one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import steps as st
from pulsegrid.operators import machines as mc
from pulsegrid.operators import metrics as mt
from pulsegrid.operators import signal as sg
from pulsegrid.runtime import materialize
from pulsegrid.timeline import Timeline
from workload import joins_q as jq
from workload.base import EV, EVENTS_TL, event_samples, r, rounded, table
from workload.registry import query

BIG = Timeline()
STATE = "CASE label WHEN 'click' THEN 'ONSET' WHEN 'signup' THEN 'ACTIVE' WHEN 'view' THEN 'OFFSET' ELSE 'INACTIVE' END"
SCO = f"""so AS (SELECT session_id, sample_idx, sample_idx * 0.1::DOUBLE AS t, value / (value + 20.0) AS clench, value / (value + 30.0) AS onset, value / (value + 25.0) AS active, 20.0 / (value + 20.0) AS inactive, value AS envelope, {STATE} AS state FROM ev)"""


def scores(spark, sf):
    v, l = F.col("value"), F.col("label")
    state = F.when(l == "click", "ONSET").when(l == "signup", "ACTIVE").when(l == "view", "OFFSET").otherwise("INACTIVE")
    return event_samples(spark, sf).select(
        "session_id", "sample_idx", (F.col("sample_idx") * 0.1).alias("at"), (v / (v + 20.0)).alias("clench"), (v / (v + 30.0)).alias("onset"),
        (v / (v + 25.0)).alias("active"), (20.0 / (v + 20.0)).alias("inactive"), v.alias("envelope"), state.alias("state"))


GRID = mc.trigger_grid()
GSQL = ", ".join(f"({c['config_id']}, '{c['strategy']}', {c['clench']}, {c['onset']}, {c['active']}, {c['rearm']}, {c['block_ms']}::DOUBLE, {c['k']}, {c['from_rest']}, {c['rise']})" for c in GRID)
W3 = "(PARTITION BY session_id ORDER BY sample_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
P3 = "(PARTITION BY session_id ORDER BY sample_idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"
L1 = "(PARTITION BY session_id ORDER BY sample_idx)"
CAND = f"""cf AS (SELECT * FROM (VALUES {GSQL}) t(config_id, strategy, th_c, th_o, th_a, rearm, block, k, fr, rise)),
  sm AS (SELECT *, {', '.join(f'avg({s}) OVER {W3} AS {s}3' for s in ('clench', 'onset', 'active', 'inactive'))}, {', '.join(f'coalesce(lag({s}) OVER {L1}, 0) AS {s}p1, coalesce(avg({s}) OVER {P3}, 0) AS {s}p3' for s in ('clench', 'onset'))},
    lag(state, 1, 'INACTIVE') OVER {L1} AS s0 FROM so),
  xx AS (SELECT session_id, sample_idx, t, state, s0, cf.*, {', '.join(f'CASE WHEN k = 1 THEN {s} ELSE {s}3 END AS n_{s}' for s in ('clench', 'onset', 'active', 'inactive'))}, CASE WHEN k = 1 THEN clenchp1 ELSE clenchp3 END AS w_clench, CASE WHEN k = 1 THEN onsetp1 ELSE onsetp3 END AS w_onset FROM sm, cf),
  rr AS (SELECT *, max(CASE WHEN n_clench <= rearm AND (NOT fr OR state IN ('INACTIVE', 'OFFSET')) THEN sample_idx END) OVER (PARTITION BY config_id, session_id ORDER BY sample_idx) AS rp FROM xx),
  cd AS (SELECT config_id, session_id, sample_idx, t, block, rp, n_clench, n_onset, CASE WHEN strategy = 'binary' AND w_clench < th_c AND n_clench >= th_c THEN 'binary_crossing'
      WHEN strategy = 'onset' AND w_onset < th_o AND n_onset >= th_o AND state IN ('ONSET', 'ACTIVE') THEN 'onset_crossing'
      WHEN strategy = 'hybrid' AND w_onset < th_o AND n_onset >= th_o AND state IN ('ONSET', 'ACTIVE') THEN 'hybrid_onset_crossing'
      WHEN strategy = 'hybrid' AND n_clench >= th_c AND n_active >= th_a AND n_clench - w_clench >= rise AND (NOT fr OR s0 IN ('INACTIVE', 'OFFSET')) AND state IN ('ONSET', 'ACTIVE') AND n_inactive < 0.6 THEN 'hybrid_inactive_to_active' END AS reason FROM rr),
  cn AS (SELECT *, row_number() OVER (PARTITION BY config_id, session_id ORDER BY sample_idx) AS i FROM cd WHERE reason IS NOT NULL),
  wk AS (SELECT config_id, session_id, i, true AS click, t AS lt, sample_idx AS lp FROM cn WHERE i = 1
    UNION ALL SELECT cn.config_id, cn.session_id, cn.i, NOT ((cn.t - lt) * 1000.0 < block) AND coalesce(rp > lp, false),
      CASE WHEN NOT ((cn.t - lt) * 1000.0 < block) AND coalesce(rp > lp, false) THEN cn.t ELSE lt END, CASE WHEN NOT ((cn.t - lt) * 1000.0 < block) AND coalesce(rp > lp, false) THEN cn.sample_idx ELSE lp END
    FROM wk JOIN cn ON cn.config_id = wk.config_id AND cn.session_id = wk.session_id AND cn.i = wk.i + 1)"""


@query(f"""WITH RECURSIVE {EV}, {SCO}, {CAND} SELECT config_id, session_id, sample_idx, {r('t')} AS at, reason, {r('n_clench')} AS now_clench, {r('n_onset')} AS now_onset
FROM wk JOIN cn USING (config_id, session_id, i) WHERE click""")
def click_trigger(spark, sf):
    out = mc.click_trigger(materialize(scores(spark, sf)), BIG, GRID)
    return rounded(out, ["at", "now_clench", "now_onset"])


MATCH = f"""{jq.TM}, rf AS (SELECT session_id, event_id AS ref_id, t AS ref_at FROM tm WHERE label = 'signup'), ck AS (SELECT DISTINCT session_id, t AS click_at FROM tm WHERE label IN ('click', 'view')),
  op AS (SELECT rf.session_id, ref_id, ref_at, list(click_at ORDER BY abs(click_at - ref_at), click_at) AS opts, row_number() OVER (PARTITION BY rf.session_id ORDER BY ref_at, ref_id) AS i
    FROM rf JOIN ck ON ck.session_id = rf.session_id AND click_at BETWEEN ref_at - 4.0 AND ref_at + 12.0 GROUP BY 1, 2, 3),
  wk AS (SELECT session_id, 0::BIGINT AS i, [0.0::DOUBLE] AS used, NULL::DOUBLE AS best FROM (SELECT DISTINCT session_id FROM op)
    UNION ALL SELECT session_id, i, CASE WHEN best IS NULL THEN used ELSE list_append(used, best) END, best FROM (
      SELECT op.session_id, op.i, used, list_filter(opts, lambda c: NOT list_contains(used, c))[1] AS best FROM wk JOIN op ON op.session_id = wk.session_id AND op.i = wk.i + 1)),
  mm AS (SELECT op.session_id, ref_id, ref_at, best AS click_at, best - ref_at AS lag_sec FROM wk JOIN op USING (session_id, i) WHERE best IS NOT NULL)"""


@query(f"WITH RECURSIVE {MATCH} SELECT session_id, ref_id, ref_at, click_at, {r('lag_sec')} AS lag_sec FROM mm")
def match_events(spark, sf):
    rows = jq.timed(spark, sf)
    refs = rows.filter("label = 'signup'").select("session_id", F.col("event_id").alias("ref_id"), F.col("t").alias("ref_at"))
    clicks = rows.filter("label IN ('click', 'view')").select("session_id", F.col("t").alias("click_at"))
    return rounded(mc.match_events(refs, clicks, BIG, 4.0, 12.0), ["lag_sec"])


@query(f"""WITH RECURSIVE {MATCH}, a AS (SELECT rf.session_id, count(*) AS reference_onsets FROM rf GROUP BY 1), b AS (SELECT session_id, count(*) AS c FROM tm WHERE label IN ('click', 'view') GROUP BY 1),
  m AS (SELECT session_id, count(*) AS k, quantile_cont(lag_sec * 1000.0, 0.5) AS lag FROM mm GROUP BY 1),
  o AS (SELECT session_id, reference_onsets, coalesce(c, 0) AS detected_clicks, coalesce(k, 0) AS matched_clicks, lag, coalesce(k / nullif(c, 0)::DOUBLE, 0) AS pr, coalesce(k / reference_onsets::DOUBLE, 0) AS rc FROM a LEFT JOIN b USING (session_id) LEFT JOIN m USING (session_id))
SELECT session_id, reference_onsets, detected_clicks, matched_clicks, {r('lag')} AS median_lag_ms, reference_onsets - matched_clicks AS missed_onsets, detected_clicks - matched_clicks AS extra_clicks, {r('pr')} AS precision, {r('rc')} AS recall,
  {r('coalesce(2.0 * pr * rc / nullif(pr + rc, 0), 0)')} AS event_f1 FROM o""")
def event_scores(spark, sf):
    rows = jq.timed(spark, sf)
    refs = rows.filter("label = 'signup'").select("session_id", F.col("event_id").alias("ref_id"), F.col("t").alias("ref_at"))
    clicks = rows.filter("label IN ('click', 'view')").select("session_id", F.col("t").alias("click_at"))
    out = mt.event_scores(refs, clicks, materialize(mc.match_events(refs, clicks, BIG, 4.0, 12.0)), ["session_id"])
    return rounded(out, ["median_lag_ms", "precision", "recall", "event_f1"])


PROBS = {"Left": "p_left", "Right": "p_right"}


def decoder_windows(spark, sf):
    """Event rows as decoder windows; 16 consecutive rows of a user form one trial."""
    v = F.col("value")
    return event_samples(spark, sf).select(
        "session_id", F.floor(F.col("sample_idx") / 16).alias("trial"), (F.col("sample_idx") % 16).alias("window_pos"), (v / (v + 10.0)).alias("p_active"),
        ((F.col("event_id") % 10) / 9.0).alias("p_left"), (1 - (F.col("event_id") % 10) / 9.0).alias("p_right"),
        F.element_at(F.array(*[F.lit(x) for x in ("Left", "Right", "Norm", "Repeated")]), (F.floor(F.col("sample_idx") / 16) % 4 + 1).cast("int")).alias("label"))


DECODERS = mc.decoder_grid(enter=(0.6, 0.7), exit=(0.55, 0.65), k=(1, 2), cooldown=(2, 4), votes=(1, 2), majority=(2, 3), min_confidence=(0.55, 0.65), margin=(0.05, 0.15))
TRIAL = Timeline(("session_id", "trial"), "window_pos")


DSQL = ", ".join(f"({c['config_id']}, {c['enter']}, {c['exit']}, {c['k']}, {c['cooldown']}, {c['votes']}, {c['majority']}, {c['min_confidence']}, {c['margin']}, {c['streak']})" for c in DECODERS)
WINDOWS = """dw AS (SELECT session_id, sample_idx // 16 AS trial, sample_idx % 16 AS window_pos, value / (value + 10.0) AS p, (event_id % 10) / 9.0::DOUBLE AS pl, 1 - (event_id % 10) / 9.0::DOUBLE AS pr,
    ['Left', 'Right', 'Norm', 'Repeated'][(sample_idx // 16) % 4 + 1] AS label FROM ev)"""
# walks the windows of all trials and settings in step; v1 and v2 are the last two votes
DECODE = f"""dc AS (SELECT * FROM (VALUES {DSQL}) t(config_id, enter_, exit_, k, cooldown, votes, majority, mc, margin, need)),
  wk AS (SELECT session_id, trial, config_id, -1::BIGINT AS w, 0 AS rest, false AS gate, 0 AS opened, NULL::VARCHAR AS last, 0 AS streak, NULL::VARCHAR AS v1, NULL::VARCHAR AS v2, NULL::VARCHAR AS command FROM (SELECT DISTINCT session_id, trial FROM dw), dc
    UNION ALL SELECT session_id, trial, config_id, w, CASE WHEN fires THEN cooldown ELSE greatest(rest - 1, 0) END, g AND NOT fires, o, CASE WHEN heard AND NOT fires THEN call END, CASE WHEN fires THEN 0 ELSE s END, vote, v1,
      CASE WHEN fires THEN CASE WHEN coalesce((vote = 'Left')::INT, 0) + coalesce((majority >= 2 AND v1 = 'Left')::INT, 0) + coalesce((majority >= 3 AND v2 = 'Left')::INT, 0) >= n / 2.0 THEN 'Left' ELSE 'Right' END END FROM (
      SELECT *, o >= k AND n >= votes AND n > 0 AS fires FROM (
        SELECT *, (vote IS NOT NULL)::INT + (majority >= 2 AND v1 IS NOT NULL)::INT + (majority >= 3 AND v2 IS NOT NULL)::INT AS n FROM (
          SELECT *, CASE WHEN heard AND s >= need THEN call END AS vote FROM (
            SELECT *, CASE WHEN heard THEN CASE WHEN call = last THEN streak + 1 ELSE 1 END ELSE 0 END AS s FROM (
              SELECT *, CASE WHEN g THEN opened + 1 ELSE 0 END AS o, g AND call IS NOT NULL AS heard FROM (
                SELECT wk.session_id, wk.trial, dc.*, dw.window_pos AS w, rest, opened, last, streak, v1, v2, rest = 0 AND CASE WHEN p >= enter_ THEN true WHEN p < exit_ THEN false ELSE gate END AS g,
                  CASE WHEN greatest(pl, pr) >= mc AND greatest(pl, pr) - least(pl, pr) >= margin THEN CASE WHEN pl > pr THEN 'Left' ELSE 'Right' END END AS call
                FROM wk JOIN dw ON dw.session_id = wk.session_id AND dw.trial = wk.trial AND dw.window_pos = wk.w + 1 JOIN dc ON dc.config_id = wk.config_id)))))))"""


@query(f"WITH RECURSIVE {EV}, {WINDOWS}, {DECODE} SELECT session_id, trial, w AS window_pos, config_id, command FROM wk WHERE command IS NOT NULL")
def discrete_decoder(spark, sf):
    return mc.discrete_decoder(decoder_windows(spark, sf), TRIAL, DECODERS, PROBS)


@query(f"""WITH RECURSIVE {EV}, {WINDOWS}, {DECODE}, f AS (SELECT session_id, trial, config_id, count(*) AS fired, min(w) AS first, arg_min(command, w) AS cmd FROM wk WHERE command IS NOT NULL GROUP BY 1, 2, 3),
  t AS (SELECT x.*, dc.config_id, coalesce(fired, 0) AS fired, first, cmd, label IN ('Left', 'Right') AS dir FROM (SELECT session_id, trial, arg_min(label, window_pos) AS label, count(*) AS n FROM dw GROUP BY 1, 2) x CROSS JOIN dc LEFT JOIN f ON f.session_id = x.session_id AND f.trial = x.trial AND f.config_id = dc.config_id),
  g AS (SELECT config_id, count(*) FILTER (dir) AS direction_trials, count(*) FILTER (dir AND cmd = label) AS correct, count(*) FILTER (dir AND cmd IS NULL) AS missed, avg(first * 0.25 + 1.0) FILTER (dir) AS al, stddev_pop(first * 0.25 + 1.0) FILTER (dir) AS sl,
    coalesce(sum(fired) FILTER (label = 'Norm'), 0)::BIGINT AS ft, coalesce(sum(fired) FILTER (label = 'Repeated'), 0)::BIGINT AS rt, sum(n) FILTER (label = 'Norm') AS nn, sum(n) FILTER (label = 'Repeated') AS nr FROM t GROUP BY 1)
SELECT config_id, direction_trials, correct, missed, {r('al')} AS avg_latency_s, {r('sl')} AS std_latency_s, ft AS false_triggers, rt AS repeated_triggers, {r('coalesce(ft / (nn * 0.25 / 60.0), 0)')} AS false_triggers_per_min, {r('coalesce(rt / (nr * 0.25 / 60.0), 0)')} AS repeated_triggers_per_min,
  direction_trials - correct - missed AS wrong, {r('coalesce(correct / nullif(direction_trials, 0)::DOUBLE, 0)')} AS direction_accuracy, {r('coalesce((direction_trials - correct - missed) / nullif(direction_trials, 0)::DOUBLE, 0)')} AS wrong_rate, {r('coalesce(missed / nullif(direction_trials, 0)::DOUBLE, 0)')} AS miss_rate FROM g""")
def simulate_holdout(spark, sf):
    w = materialize(decoder_windows(spark, sf))
    out = mc.simulate_holdout(w, materialize(mc.discrete_decoder(w, TRIAL, DECODERS, PROBS)), ["session_id", "trial"], "window_pos", DECODERS, 0.25, 1.0)
    return rounded(out, ["avg_latency_s", "std_latency_s", "false_triggers_per_min", "repeated_triggers_per_min", "direction_accuracy", "wrong_rate", "miss_rate"])


@query(f"""WITH {EV}, w AS (SELECT session_id, sample_idx // 16 AS trial, sample_idx % 16 AS window_pos, sample_idx * 10 AS s, sample_idx * 10 + 19 AS e, CASE WHEN (sample_idx // 16) % 3 = 0 THEN 'REST' ELSE 'L' END AS y, CASE WHEN value < 25 THEN 'REST' ELSE 'L' END AS p FROM ev),
  m AS (SELECT *, avg((p <> 'REST')::INT) OVER (PARTITION BY session_id, trial ORDER BY window_pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS sh FROM w WHERE y <> 'REST')
SELECT session_id, trial, {r('(arg_min(e, window_pos) FILTER (sh > 0.5) - min(s)) / 250.0 * 1000')} AS latency_ms FROM m GROUP BY 1, 2""")
def majority_latency(spark, sf):
    i = F.col("sample_idx")
    w = event_samples(spark, sf).select(
        "session_id", F.floor(i / 16).alias("trial"), (i % 16).alias("window_pos"), (i * 10).alias("start_sample"), (i * 10 + 19).alias("end_sample"),
        F.when(F.floor(i / 16) % 3 == 0, "REST").otherwise("L").alias("y"), F.when(F.col("value") < 25, "REST").otherwise("L").alias("p"))
    return rounded(mc.majority_latency(w, TRIAL, "y", "p", 250.0), ["latency_ms"])


@query(f"""WITH RECURSIVE {EV}, {SCO}, st AS (SELECT *, active >= 0.7 OR clench >= 0.7 OR state IN ('ONSET', 'ACTIVE') AS eng, value > 60 AS clk FROM so JOIN (SELECT session_id, sample_idx, value FROM ev) USING (session_id, sample_idx)),
  wk AS (SELECT session_id, -1::BIGINT AS i, false AS held, NULL::DOUBLE AS since, NULL::DOUBLE AS rel, false AS c, false AS hs, false AS he FROM (SELECT DISTINCT session_id FROM ev)
    UNION ALL SELECT st.session_id, st.sample_idx,
      CASE WHEN eng AND NOT held AND t - coalesce(since, t) >= 0.25 THEN true WHEN NOT eng AND held AND rel IS NOT NULL AND t - rel >= 0.18 THEN false ELSE held END,
      CASE WHEN eng THEN coalesce(since, t) END, CASE WHEN eng OR NOT held THEN NULL WHEN rel IS NULL THEN t WHEN t - rel >= 0.18 THEN NULL ELSE rel END,
      clk AND NOT held, eng AND NOT held AND t - coalesce(since, t) >= 0.25, NOT eng AND held AND rel IS NOT NULL AND t - rel >= 0.18
    FROM wk JOIN st ON st.session_id = wk.session_id AND st.sample_idx = wk.i + 1)
SELECT session_id, i AS sample_idx, {r('i * 0.1::DOUBLE')} AS at, unnest(list_filter([CASE WHEN c THEN 'CLICK' END, CASE WHEN hs THEN 'HOLD_START' END, CASE WHEN he THEN 'HOLD_END' END], lambda x: x IS NOT NULL)) AS action FROM wk WHERE c OR hs OR he""")
def hold_detector(spark, sf):
    s = scores(spark, sf).select("session_id", "sample_idx", "at", F.col("clench").alias("jaw"), F.col("active").alias("jaw_active"), "state", (F.col("envelope") > 60).alias("clicked"))
    return rounded(mc.hold_detector(s, BIG, {**st.HOLD, "onset_sec": 0.25}), ["at"])


@query(f"""WITH RECURSIVE {EV}, dt AS (SELECT session_id, sample_idx, sample_idx * 0.1::DOUBLE AS t, CASE label WHEN 'click' THEN 'LEFT' WHEN 'signup' THEN 'RIGHT' END AS lab FROM ev),
  wk AS (SELECT session_id, -1::BIGINT AS i, 'NEUTRAL' AS side, -1e18::DOUBLE AS until_, -1e18::DOUBLE AS sw, NULL::VARCHAR AS lab, false AS tk FROM (SELECT DISTINCT session_id FROM ev)
    UNION ALL SELECT session_id, j, CASE WHEN t > CASE WHEN ok THEN t + 0.45::DOUBLE ELSE until_ END THEN 'NEUTRAL' WHEN ok THEN nl ELSE side END, CASE WHEN ok THEN t + 0.45::DOUBLE ELSE until_ END, CASE WHEN ok THEN t ELSE sw END, nl, ok FROM (
      SELECT dt.session_id, dt.sample_idx AS j, dt.t, dt.lab AS nl, side, until_, sw, dt.lab IS NOT NULL AND NOT (side IN ('LEFT', 'RIGHT') AND side <> dt.lab AND dt.t - sw < 0.2) AS ok
      FROM wk JOIN dt ON dt.session_id = wk.session_id AND dt.sample_idx = wk.i + 1))
SELECT session_id, i AS sample_idx, {r('i * 0.1::DOUBLE')} AS at, lab AS label, tk AS taken, side AS shown FROM wk WHERE i >= 0""")
def hand_latch(spark, sf):
    lab = F.when(F.col("label") == "click", "LEFT").when(F.col("label") == "signup", "RIGHT")
    d = event_samples(spark, sf).select("session_id", "sample_idx", (F.col("sample_idx") * 0.1).alias("at"), lab.alias("label"))
    return rounded(mc.hand_latch(d, BIG), ["at"])


@query("""SELECT user_id AS session_id, event_id, CASE WHEN value / (value + 30.0) >= 0.4 THEN CASE WHEN event_type IN ('click', 'view') THEN 'LEFT' ELSE 'RIGHT' END ELSE 'REST' END AS predicted FROM events""")
def gate_then_classify(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), "event_id", (F.col("value") / (F.col("value") + 30.0)).alias("p"),
                                             F.when(F.col("event_type").isin("click", "view"), "LEFT").otherwise("RIGHT").alias("d"))
    return rows.select("session_id", "event_id", mc.gate_then_classify("p", "d", 0.4).alias("predicted"))


def adaptive_sql(up="0.9"):
    return f"""av AS (SELECT session_id, sample_idx, avg(least(abs(value), 200.0)) OVER (PARTITION BY session_id ORDER BY sample_idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS a FROM ev),
  wk AS (SELECT session_id, -1::BIGINT AS i, 6.0::DOUBLE AS lo, 16.0::DOUBLE AS up, 0.0::DOUBLE AS a FROM (SELECT DISTINCT session_id FROM ev)
    UNION ALL SELECT session_id, j, l4, greatest(u2, l4 + 10.0), a2 FROM (SELECT *, greatest(CASE WHEN l2 <= a2 THEN l2 / 0.99999 ELSE l2 END, 6.0) AS l4 FROM (
      SELECT *, greatest(least(lo, a2), 1.0) AS l2, CASE WHEN a2 + 10.0 <= u1 THEN u1 * {up}::DOUBLE ELSE u1 END AS u2 FROM (
        SELECT av.session_id, av.sample_idx AS j, av.a AS a2, lo, CASE WHEN up <= av.a AND av.a <= 200.0 THEN av.a ELSE up END AS u1 FROM wk JOIN av ON av.session_id = wk.session_id AND av.sample_idx = wk.i + 1))))"""


def averages(spark, sf):
    return sg.moving_mav(event_samples(spark, sf).select("session_id", "sample_idx", "value"), EVENTS_TL, ["value"], 10)


@query(f"""WITH RECURSIVE {EV}, {adaptive_sql()} SELECT session_id, i AS sample_idx, {r('a')} AS value_average, {r('lo')} AS value_lower, {r('up')} AS value_upper, {r('greatest(0, (a - lo) / (up - lo))')} AS value_output FROM wk WHERE i >= 0""")
def adaptive_thresholds(spark, sf):
    out = mc.adaptive_thresholds(averages(spark, sf), BIG, ["value"])
    return rounded(out, ["value_average", "value_lower", "value_upper", "value_output"])


@query(f"""WITH RECURSIVE {EV}, nx AS (SELECT session_id, sample_idx, value / (value + 30.0) AS lf, 30.0 / (value + 30.0) AS rg FROM ev),
  wk AS (SELECT session_id, -1::BIGINT AS i, 0.0::DOUBLE AS x, 0.0::DOUBLE AS lf, 0.0::DOUBLE AS rg FROM (SELECT DISTINCT session_id FROM ev)
    UNION ALL SELECT nx.session_id, nx.sample_idx, x + (1.0 - 0.9)::DOUBLE * (nx.rg - nx.lf - x), nx.lf, nx.rg FROM wk JOIN nx ON nx.session_id = wk.session_id AND nx.sample_idx = wk.i + 1)
SELECT session_id, i AS sample_idx, {r('lf')} AS left_aggregate, {r('rg')} AS right_aggregate, {r('rg - lf')} AS x_raw, {r('lf + rg')} AS total_activation, {r('x')} AS x_smooth, {r('abs(x)')} AS abs_direction FROM wk WHERE i >= 0""")
def joystick(spark, sf):
    v = F.col("value")
    rows = event_samples(spark, sf).select("session_id", "sample_idx", (v / (v + 30.0)).alias("a_output"), (30.0 / (v + 30.0)).alias("b_output"))
    out = mc.joystick(rows, BIG, ["a"], ["b"])
    return rounded(out, ["left_aggregate", "right_aggregate", "x_raw", "total_activation", "x_smooth", "abs_direction"])
