"""The jaw-click benchmark from labelled samples to stage gates, and full-session replay rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import labels as lb
from pulsegrid.operators import features as ft
from pulsegrid.operators import joins as jn
from pulsegrid.operators import learn as ln
from pulsegrid.operators import machines as mc
from pulsegrid.operators import metrics as mt
from pulsegrid.operators import windows as wn
from pulsegrid.runtime import materialize
from pulsegrid.streaming import timed
from pulsegrid.timeline import Timeline


def event_windows(samples: DataFrame, tl: Timeline, channels: Sequence[str], length: int, hop: int, fs: float, states: Sequence[str] = lb.JAW_STATES) -> DataFrame:
    """Sliding windows of labelled samples with event features and the label (one of ``states``) of the centre sample."""
    # strings would keep the aggregate from hashing, so labels go through it as places in the list
    names = F.array(*[F.lit(s) for s in states])
    rows = wn.assign_session_windows(samples, tl, length, hop).withColumn("_state", F.array_position(names, F.col("event_label")))
    agg = rows.groupBy(*tl.keys, "window_start").agg(
        F.count(F.lit(1)).alias("n_samples"), wn.center_value("_state", length, tl.pos).alias("_state"),
        *ft.event_features(channels, tl.pos))
    agg = agg.withColumn("event_label", F.get(names, F.col("_state").cast("int") - 1)).drop("_state")
    return wn.full_windows(agg, length).drop("n_samples").withColumn("at", (F.col("window_start") + length // 2) / fs)


def replay_scores(windows: DataFrame, train_rows: DataFrame, features: Sequence[str], kind: str = "logistic") -> DataFrame:
    """Class probabilities per window from a four-state and a clench model."""
    four = ln.fit_model(kind, train_rows, features, "event_label", lb.JAW_STATES)
    names = lb.EVENT_TASK_LABELS["clench_vs_nonclench"]
    two = ln.fit_model(kind, train_rows.withColumn("_clench", lb.event_task_label("event_label", "clench_vs_nonclench")), features, "_clench", names)
    scored = four.score(windows, "p4_").withColumnRenamed("predicted", "state")
    scored = two.score(scored, "p2_").drop("predicted")
    return scored.select(
        *[c for c in windows.columns if c not in features], "state", F.col("p2_CLENCH").alias("clench"), F.col("p4_ONSET").alias("onset"),
        F.col("p4_ACTIVE").alias("active"), F.col("p4_INACTIVE").alias("inactive"), F.col("aggregate_rms_smooth_mean").alias("envelope"))


def jaw_click_benchmark(windows: DataFrame, onsets: DataFrame, roles: DataFrame, features: Sequence[str], tl: Timeline, configs: Sequence[Mapping], kind: str = "logistic") -> dict[str, DataFrame]:
    """Train, tune the trigger on training sessions, and judge the best setting on the test sessions.

    ``onsets`` carry ref_id and ref_at, ``roles`` give split_role per session. Returns per-session scores, the
    strategy summary, the best setting by training score and the gate verdict on the test sessions.
    """
    keys = list(tl.keys)
    tagged = windows.join(roles, keys)
    # the fits go over their rows many times: they read nothing but what they use
    train = materialize(tagged.filter("split_role = 'train'").select("event_label", *features))
    scores = materialize(replay_scores(tagged, train, features, kind))
    at = tl.at("window_start")
    clicks = materialize(mc.click_trigger(scores, at, configs))
    ids = F.array(*[F.lit(c["config_id"]) for c in configs])
    refs = materialize(onsets.join(roles, keys).select(*keys, "ref_id", "ref_at"))
    by = tl.by("config_id")
    hits = clicks.select(*by.keys, F.col("at").alias("click_at"))
    matches = materialize(mc.match_events(refs, hits, by))  # the references count under every setting
    counts = refs.groupBy(*keys).agg(F.count(F.lit(1)).alias("reference_onsets")).withColumn("config_id", F.explode(ids))
    per_session = mt.event_scores_of(counts, hits, matches, by.keys).join(roles, keys)
    summary = materialize(mt.strategy_summary(per_session, ["config_id"]))
    best = mt.best_config(summary.filter("split_role = 'train'"), ["split_role"], "config_id")
    chosen = summary.filter("split_role = 'test'").join(best.select("config_id"), "config_id", "left_semi")
    row = lambda metric, c: F.struct(F.lit("jaw_stage1").alias("stage"), F.lit(metric).alias("metric"), F.col(c).alias("value"))
    values = chosen.select(F.inline(F.array(row("event_f1", "weighted_event_f1"), row("precision", "weighted_precision"), row("recall", "weighted_recall"))))
    gates = mt.stage_gates(values, [g for g in mt.STAGE_GATES if g[0] == "jaw_stage1"])
    return {"scores": per_session, "summary": summary, "best": best, "gates": gates}


def replay_rows(windows: DataFrame, model, segments: DataFrame, tl: Timeline, width: float) -> DataFrame:
    """One row per replay step: model probabilities, prediction and the true segment at that time.

    Windows carry step_id and at; segments carry g_start, g_end, order and truth.
    """
    scored = model.score(windows)
    out = jn.ground_truth_at(scored, segments, list(tl.keys), "step_id", "at", "g_start", "g_end", "order", "truth", width)
    return out.withColumn("agrees", F.col("predicted") == F.col("truth"))


def decoder_ticks(rows: DataFrame, p_left: Column, event: Column, engaged: Column, clicked: Column, confidence: float = 0.6, margin: float = 0.1) -> DataFrame:
    """Rows of calibrated features (batch or stream) as ticks for the control step: direction, agreement and jaw flags."""
    best = F.greatest(p_left, 1 - p_left)
    agreed = (best >= confidence) & (F.abs(2 * p_left - 1) >= margin)
    yes = lambda c: F.coalesce(c, F.lit(False))
    return rows.withColumns({
        "label": F.when(p_left > 0.5, "LEFT").otherwise("RIGHT"), "confidence": best, "agreed": yes(agreed), "event": yes(event), "engaged": yes(engaged), "clicked": yes(clicked)})


def replay_control(ticks: DataFrame, tl: Timeline, machine: timed.Control) -> DataFrame:
    """The control step over recorded ticks: the rows that the live decoder appends, ends of latches included.

    ``ticks`` carry at (microseconds) and the columns of `timed.Control`; a series ends with its last due latch.
    """
    names = ["held", "since", "released", "side", "until", "switched"]
    columns = [*tl.keys, "at", *[c.split(" ")[0] for c in machine.out.split(", ")]]

    def step(state, pdf):
        memory, out = tuple(state[n] for n in names) if state else machine.start, []
        for row in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
            more: list = []
            memory = machine._rings(memory, row["at"], more)
            memory, here = machine.row(memory, row)
            out += [{**r, **{k: row[k] for k in tl.keys}} for r in [*more, *here]]
        return dict(zip(names, memory)), mc.pd.DataFrame(out, columns=columns)

    series = ", ".join(f"`{k}` {ticks.schema[k].dataType.simpleString()}" for k in tl.keys)
    done = mc.run_machine(ticks, tl, step, f"{series}, at bigint, {machine.out}")
    # after the last tick only the latch can still end
    last = done.groupBy(*tl.keys).agg(F.max_by(F.struct("hand", "decoded"), F.struct("at", "pos")).alias("_end"), F.max(F.when(F.col("accepted"), F.col("at"))).alias("_taken"))
    ends = last.where("_end.hand <> 'NEUTRAL'").select(
        *tl.keys, (F.col("_taken") + machine.hand["latch_sec"]).alias("at"), F.lit(None).cast("bigint").alias("pos"), F.lit("EXPIRED").alias("actions"), F.lit(False).alias("accepted"),
        F.lit("NEUTRAL").alias("hand"), F.when(F.col("_end.decoded").startswith("CLICK_HOLD"), "CLICK_HOLD").otherwise("NEUTRAL").alias("decoded"), F.lit(None).cast("double").alias("confidence"))
    return done.unionByName(ends)
