"""Centring, scaling, smoothing and profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.operators import signal as sg
from pulsegrid.runtime import materialize
from workload import intervals_q as iq
from workload.base import CHANNELS, EV, EVENTS_TL, ITEMS_TL as TL, LI, event_samples, item_samples, r, rounded
from workload.registry import query

MED = "med AS (SELECT session_id, " + ", ".join(f"quantile_cont({c}, 0.5) AS m{c}" for c in CHANNELS) + " FROM li GROUP BY 1)"


def raw(spark, sf):
    return item_samples(spark, sf).select("session_id", "sample_idx", "label", *CHANNELS)


@query(f"""WITH {LI}, {MED} SELECT session_id, sample_idx, label, {', '.join(r(f'({c} - m{c}) * 0.02235') + f' AS {c}' for c in CHANNELS)}
FROM li JOIN med USING (session_id)""")
def center_and_scale(spark, sf):
    return rounded(sg.center_and_scale(materialize(raw(spark, sf)), TL, CHANNELS), CHANNELS)


VERDICT = f"""{MED}, vd AS (SELECT session_id, {', '.join('m' + c for c in CHANNELS)}, max(greatest(abs(ch1), abs(ch2), abs(ch3), abs(ch4))) AS raw_abs_max,
    list_sort([{', '.join(f'abs(m{c})' for c in CHANNELS)}]) AS s FROM li JOIN med USING (session_id) GROUP BY ALL), v AS (
  SELECT *, (s[2] + s[3]) / 2 AS raw_abs_median FROM vd)"""


@query(f"""WITH {LI}, {VERDICT} SELECT session_id, sample_idx, label, CASE WHEN raw_abs_median > 15.2 OR raw_abs_max > 1000 THEN 'counts_centered' ELSE 'raw_uv' END AS mode_applied,
  {', '.join(r(f'CASE WHEN raw_abs_median > 15.2 OR raw_abs_max > 1000 THEN ({c} - m{c}) * 0.02235 ELSE {c} END') + f' AS {c}' for c in CHANNELS)}
FROM li JOIN v USING (session_id)""")
def infer_scale(spark, sf):
    out = sg.infer_scale(materialize(raw(spark, sf)), TL, CHANNELS, median_trigger=15.2, max_trigger=1000.0)
    return rounded(out, CHANNELS)


@query(f"""WITH {LI}, {VERDICT}, p AS (SELECT session_id, {', '.join(f'quantile_cont(abs(({c} - m{c}) * 0.02235), 0.99) AS p{c}' for c in CHANNELS)},
    {', '.join(f'(max(abs({c})) >= 100 OR avg((abs(abs({c}) - 600) < 500)::INT) > 0.01)::INT AS r{c}' for c in CHANNELS)}
  FROM li JOIN med USING (session_id) GROUP BY 1), z AS (SELECT *, list_sort([pch1, pch2, pch3, pch4]) AS ps FROM p JOIN v USING (session_id))
SELECT session_id, {r('raw_abs_median')} AS raw_abs_median, {r('raw_abs_max')} AS raw_abs_max,
  CASE WHEN raw_abs_median > 1000 OR raw_abs_max > 10000 THEN 'raw_counts' ELSE 'unknown' END AS likely_signal_kind,
  {r('(ps[2] + ps[3]) / 2')} AS median_abs_p99, (ps[2] + ps[3]) / 2 <= 0.35 * 1.25 AS plausible_scale, rch1 + rch2 + rch3 + rch4 AS channels_near_rail FROM z""")
def assess_signal_scale(spark, sf):
    out = sg.assess_signal_scale(materialize(raw(spark, sf)), TL, CHANNELS, rail=600.0, uv_limit=0.35)
    return rounded(out, ["raw_abs_median", "raw_abs_max", "median_abs_p99"])


def centered(w):
    return f"ROWS BETWEEN {w // 2} PRECEDING AND {(w - 1) // 2} FOLLOWING"


RMS = "sqrt((ch1 * ch1 + ch2 * ch2 + ch3 * ch3 + ch4 * ch4) / 4)"
ENV = f"""en AS (SELECT *, avg(aggregate_rms) OVER (PARTITION BY session_id ORDER BY sample_idx {centered(8)}) AS aggregate_rms_smooth
  FROM (SELECT *, {RMS} AS aggregate_rms FROM li))"""


@query(f"WITH {LI}, {ENV} SELECT * REPLACE ({r('aggregate_rms')} AS aggregate_rms, {r('aggregate_rms_smooth')} AS aggregate_rms_smooth) FROM en")
def envelope(spark, sf):
    return rounded(sg.with_envelope(raw(spark, sf), TL, CHANNELS, 8), ["aggregate_rms", "aggregate_rms_smooth"])


def detrend_sql(source, width, cols):
    hp = ", ".join(f"{c} - avg({c}) OVER (PARTITION BY session_id ORDER BY sample_idx {centered(width)}) AS h{c}" for c in cols)
    lp = ", ".join(f"avg(h{c}) OVER (PARTITION BY session_id ORDER BY sample_idx {centered(3)}) AS f{c}" for c in cols)
    return f"hp AS (SELECT *, {hp} FROM {source}), lp AS (SELECT *, {lp} FROM hp)"


@query(f"""WITH {LI}, {detrend_sql('li', 11, CHANNELS)} SELECT session_id, sample_idx, label, {', '.join(r('f' + c) + f' AS {c}' for c in CHANNELS)} FROM lp""")
def detrend_smooth(spark, sf):
    return rounded(sg.detrend_smooth(raw(spark, sf), TL, CHANNELS, 11), CHANNELS)


SC = f"sc AS (SELECT session_id, sample_idx, label, {', '.join(CHANNELS)}, {', '.join(f'm{c}, ({c} - m{c}) * 0.02235 AS s{c}' for c in CHANNELS)} FROM li JOIN med USING (session_id))"
SCN = [f"s{c}" for c in CHANNELS]
MODES = f"""{MED}, {SC}, {detrend_sql('sc', 11, SCN)}, modes AS (
  SELECT session_id, sample_idx, label, 'raw' AS mode, {', '.join(CHANNELS)} FROM lp
  UNION ALL SELECT session_id, sample_idx, label, 'centered', {', '.join(f'{c} - m{c}' for c in CHANNELS)} FROM lp
  UNION ALL SELECT session_id, sample_idx, label, 'scaled', {', '.join('s' + c for c in CHANNELS)} FROM lp
  UNION ALL SELECT session_id, sample_idx, label, 'filtered', {', '.join('fs' + c for c in CHANNELS)} FROM lp)"""


@query(f"WITH {LI}, {MODES} SELECT session_id, sample_idx, label, mode, {', '.join(r(c) + f' AS {c}' for c in CHANNELS)} FROM modes")
def signal_modes(spark, sf):
    return rounded(sg.signal_modes(materialize(raw(spark, sf)), TL, CHANNELS, 11), CHANNELS)


@query(f"""WITH {LI}, {MODES}, f AS (SELECT session_id, min(sample_idx) AS first FROM li WHERE label = 'R' GROUP BY 1)
SELECT session_id, sample_idx, label, {', '.join(f"{r(f'''max(ch1) FILTER (mode = '{m}')''')} AS ch1_{m}" for m in ['raw', 'centered', 'scaled', 'filtered'])}
FROM modes JOIN f USING (session_id) WHERE sample_idx >= first AND sample_idx < first + 40 GROUP BY 1, 2, 3""")
def sanity_slice(spark, sf):
    modes = materialize(sg.signal_modes(materialize(raw(spark, sf)), TL, CHANNELS, 11))
    out = sg.sanity_slice(modes, TL, "label", ["R"], "ch1")
    return rounded(out, [c for c in out.columns if c.startswith("ch1_")])


@query(f"""WITH {LI} SELECT session_id, sample_idx, label, {', '.join(CHANNELS)},
  {', '.join(r(f'avg(least(abs({c}), 40.0)) OVER (PARTITION BY session_id ORDER BY sample_idx ROWS BETWEEN 24 PRECEDING AND CURRENT ROW)') + f' AS {c}_average' for c in CHANNELS)} FROM li""")
def moving_mav(spark, sf):
    return rounded(sg.moving_mav(raw(spark, sf), TL, CHANNELS, 25, 40.0), [f"{c}_average" for c in CHANNELS])


PROFILE = f"""WITH {EV}, {iq.MK}, {iq.SEGMENTS}, nx AS (SELECT session_id, sample_idx, abs(value) AS v, lead(abs(value)) OVER (PARTITION BY session_id ORDER BY sample_idx) AS n FROM ev),
  sp AS (SELECT session_id, start_sample, end_sample, end_sample - start_sample AS last FROM sg WHERE label IN ('LEFT', 'RIGHT') AND end_sample - start_sample >= 3),
  gr AS (SELECT sp.*, j, start_sample + least(floor(j * last / 299.0)::BIGINT, last - 1) AS at, j * last / 299.0::DOUBLE - least(floor(j * last / 299.0)::BIGINT, last - 1) AS frac
    FROM sp, range(300) t(j)), pt AS (SELECT gr.j AS point, v + (n - v) * frac AS x FROM gr JOIN nx ON gr.session_id = nx.session_id AND nx.sample_idx = gr.at), pr AS (
  SELECT point, count(*) AS segments, avg(x) AS m, stddev_pop(x) AS s FROM pt GROUP BY 1)"""


def profile(spark, sf):
    segs = iq.segments(spark, sf).filter("label IN ('LEFT', 'RIGHT')")
    return sg.activity_profile(event_samples(spark, sf), segs, EVENTS_TL, ["value"], points=300)


@query(f"{PROFILE} SELECT point, segments, {r('m')} AS aggregate_rms_mean, {r('s')} AS aggregate_rms_std, {r('m')} AS value_abs_mean, {r('s')} AS value_abs_std FROM pr")
def activity_profile(spark, sf):
    return rounded(profile(spark, sf), ["aggregate_rms_mean", "aggregate_rms_std", "value_abs_mean", "value_abs_std"])


@query(f"WITH {LI} SELECT channel, {r('avg(abs(x))')} AS energy FROM (SELECT unnest(['ch1', 'ch2', 'ch3', 'ch4']) AS channel, unnest([ch1, ch2, ch3, ch4]) AS x FROM li) GROUP BY 1 ORDER BY energy DESC, channel LIMIT 2")
def top_channels(spark, sf):
    means = raw(spark, sf).agg(*[F.avg(F.abs(c)).alias(f"{c}_abs_mean") for c in CHANNELS])
    return rounded(sg.top_channels(means, CHANNELS), ["energy"])
