"""Classification, event and tuning metrics, all as aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.timeline import Running, Timeline, carry, config_rows, exact_quantiles, range_join

# Stage gates of the staged benchmark (metric, limit, direction).
STAGE_GATES = (
    ("jaw_stage1", "event_f1", 0.72, "min"), ("jaw_stage1", "precision", 0.68, "min"), ("jaw_stage1", "recall", 0.68, "min"),
    ("jaw_stage2", "macro_f1", 0.75, "min"),
    ("jaw_stage3", "exact_accuracy", 0.60, "min"), ("jaw_stage3", "per_file_floor", 0.45, "min"), ("jaw_stage3", "mae", 1.0, "max"),
    ("eeg_stage12", "per_file_inside_fraction", 0.94, "min"), ("eeg_stage12", "overall_inside_fraction", 0.90, "min"),
    ("eeg_stage12", "lrj_exact_accuracy", 0.55, "min"), ("eeg_stage12", "lrj_mae", 1.0, "max"),
    ("eeg_stage3", "macro_f1", 0.58, "min"), ("eeg_stage3", "class_recall", 0.50, "min"),
)


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or missing."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def mean_of(cols: Sequence[Column]) -> Column:
    return sum(cols[1:], cols[0]) / len(cols)


def confusion_counts(df: DataFrame, keys: Sequence[str], y: str, p: str) -> DataFrame:
    """Long confusion counts (keys, actual, predicted, n)."""
    return df.groupBy(*keys, F.col(y).alias("actual"), F.col(p).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, keys: Sequence[str], y: str, p: str, labels: Sequence[str]) -> DataFrame:
    """One row per key and actual label in the given order, one column per predicted label, absent pairs 0."""
    counts = df.groupBy(*keys).agg(*[
        F.count_if((F.col(y) == a) & (F.col(p) == b)).alias(f"_{i}_{j}") for i, a in enumerate(labels) for j, b in enumerate(labels)])
    rows = F.array(*[
        F.struct(F.lit(i).alias("label_order"), F.lit(a).alias("actual"), *[F.col(f"_{i}_{j}").alias(f"pred_{b}") for j, b in enumerate(labels)])
        for i, a in enumerate(labels)])
    return counts.select(*keys, F.inline(rows))


def classification_metrics(df: DataFrame, keys: Sequence[str], y: str, p: str, labels: Sequence[str], present_only: bool = False) -> DataFrame:
    """Accuracy and macro precision, recall and F1 with zero for undefined ratios, plus recall per label.

    ``present_only`` averages over labels that occur in truth or prediction instead of over all given labels.
    """
    aggs = [F.count(F.lit(1)).alias("n"), F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy")]
    for i, a in enumerate(labels):
        t, q = F.col(y) == a, F.col(p) == a
        aggs += [F.count_if(t & q).alias(f"_tp{i}"), F.count_if(t).alias(f"_t{i}"), F.count_if(q).alias(f"_p{i}")]
    g = df.groupBy(*keys).agg(*aggs)
    idx = range(len(labels))
    tp, t, q = (lambda i: F.col(f"_tp{i}")), (lambda i: F.col(f"_t{i}")), (lambda i: F.col(f"_p{i}"))
    precision = [ratio(tp(i), q(i)) for i in idx]
    recall = [ratio(tp(i), t(i)) for i in idx]
    f1 = [ratio(2 * tp(i), t(i) + q(i)) for i in idx]
    if present_only:
        present = [((t(i) + q(i)) > 0).cast("double") for i in idx]
        total = sum(present[1:], present[0])
        macro = lambda xs: ratio(sum((x * w for x, w in zip(xs[1:], present[1:])), xs[0] * present[0]), total)
    else:
        macro = mean_of
    out = g.withColumns({"macro_precision": macro(precision), "macro_recall": macro(recall), "macro_f1": macro(f1),
                         **{f"recall_{a}": recall[i] for i, a in enumerate(labels)}})
    return out.drop(*[f"_{k}{i}" for i in idx for k in ("tp", "t", "p")])


def rest_false_positive_rate(df: DataFrame, keys: Sequence[str], y: str, p: str, rest: str = "REST") -> DataFrame:
    """Share of resting rows that were predicted as something else."""
    return df.groupBy(*keys).agg(F.coalesce(F.avg(F.when(F.col(y) == rest, (F.col(p) != rest).cast("double"))), F.lit(0.0)).alias("rest_fpr"))


def _binned(df: DataFrame, keys: Sequence[str], score: Column, truth: Column, thresholds: Sequence[float], strict: bool) -> DataFrame:
    """Rows counted by (truth, number of thresholds passed): the only pass over the data a sweep needs."""
    ts = sorted(thresholds)
    level = F.lit(0)
    for th in ts:
        level = level + ((score > th) if strict else (score >= th)).cast("int")
    return df.groupBy(*keys, truth.alias("_y"), level.alias("_lv")).agg(F.count(F.lit(1)).alias("_n"))


def threshold_sweep(df: DataFrame, keys: Sequence[str], score: str, active: Column, thresholds: Sequence[float], strict: bool = False) -> DataFrame:
    """Binary metrics per threshold (positive at ``score >= threshold``) from one counted histogram."""
    ts = sorted(thresholds)
    bins = _binned(df, keys, F.col(score), active.cast("int"), ts, strict)
    sums = []
    for i in range(len(ts)):
        over = F.col("_lv") > i
        sums += [F.coalesce(F.sum(F.when(over & (F.col("_y") == 1), F.col("_n"))), F.lit(0)).alias(f"_tp{i}"),
                 F.coalesce(F.sum(F.when(over & (F.col("_y") == 0), F.col("_n"))), F.lit(0)).alias(f"_fp{i}")]
    g = bins.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("_y") == 1, F.col("_n"))), F.lit(0)).alias("_pos"),
        F.coalesce(F.sum(F.when(F.col("_y") == 0, F.col("_n"))), F.lit(0)).alias("_neg"), *sums)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_tp{i}").alias("_tp"), F.col(f"_fp{i}").alias("_fp")) for i, t in enumerate(ts)])
    s = g.select(*keys, "_pos", "_neg", F.inline(rows))
    tp, fp, pos, neg = F.col("_tp"), F.col("_fp"), F.col("_pos"), F.col("_neg")
    fn, tn = pos - tp, neg - fp
    return s.select(
        *keys, "threshold", ratio(tp + tn, pos + neg).alias("accuracy"),
        ((ratio(2 * tp, 2 * tp + fp + fn) + ratio(2 * tn, 2 * tn + fp + fn)) / 2).alias("macro_f1"),
        ratio(tp, tp + fp).alias("active_precision"), ratio(tp, pos).alias("active_recall"), fn.alias("misses"), fp.alias("false_triggers"))


def direction_scan(df: DataFrame, keys: Sequence[str], x: str, label: str, thresholds: Sequence[float], left: str = "Jleft", right: str = "Jright") -> DataFrame:
    """Sign threshold with an undecided middle: coverage, accuracies and macro F1 per threshold."""
    rows = df.filter(F.col(label).isin(left, right))
    ts = sorted(thresholds)
    side = F.when(F.col(x) > 0, 1).otherwise(0)
    bins = _binned(rows.withColumn("_side", side), [*keys, "_side"], F.abs(x), (F.col(label) == right).cast("int"), ts, True)
    pick = lambda i, s, y: F.coalesce(F.sum(F.when((F.col("_lv") > i) & (F.col("_side") == s) & (F.col("_y") == y), F.col("_n"))), F.lit(0))
    cells = [pick(i, s, y).alias(f"_{i}{s}{y}") for i in range(len(ts)) for s in (0, 1) for y in (0, 1)]
    total = lambda y: F.coalesce(F.sum(F.when(F.col("_y") == y, F.col("_n"))), F.lit(0)).alias(f"_t{y}")
    g = bins.groupBy(*keys).agg(total(0), total(1), *cells)
    long = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), *[F.col(f"_{i}{s}{y}").alias(f"_c{s}{y}") for s in (0, 1) for y in (0, 1)]) for i, t in enumerate(ts)])
    r = g.select(*keys, "_t0", "_t1", F.inline(long))
    decided = F.col("_c00") + F.col("_c01") + F.col("_c10") + F.col("_c11")
    correct, n = F.col("_c00") + F.col("_c11"), F.col("_t0") + F.col("_t1")
    f_left = ratio(2 * F.col("_c00"), F.col("_t0") + F.col("_c00") + F.col("_c01"))
    f_right = ratio(2 * F.col("_c11"), F.col("_t1") + F.col("_c10") + F.col("_c11"))
    return r.select(*keys, "threshold", ratio(decided, n).alias("coverage"), ratio(correct, n).alias("accuracy_all"),
                    ratio(correct, decided).alias("accuracy_decided"), ((f_left + f_right) / 2).alias("macro_f1"))


def activation_scan(df: DataFrame, keys: Sequence[str], score: str, label: str, thresholds: Sequence[float], rest: str = "norm") -> DataFrame:
    """Accuracy and macro F1 of active-versus-rest per threshold (active above it)."""
    out = threshold_sweep(df, keys, score, F.col(label) != rest, thresholds, strict=True)
    return out.select(*keys, "threshold", "accuracy", "macro_f1")


def first_best(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """First row per key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def cohens_d(df: DataFrame, keys: Sequence[str], x: str, label: str, left: str, right: str) -> DataFrame:
    """Effect size (right minus left) over the pooled sample variance, 0 without spread."""
    l, q = F.when(F.col(label) == left, F.col(x)), F.when(F.col(label) == right, F.col(x))
    g = df.groupBy(*keys).agg(F.count(l).alias("_a"), F.count(q).alias("_b"), F.avg(l).alias("left_mean"), F.avg(q).alias("right_mean"),
                              F.var_samp(l).alias("_va"), F.var_samp(q).alias("_vb"))
    pooled = F.sqrt(((F.col("_a") - 1) * F.col("_va") + (F.col("_b") - 1) * F.col("_vb")) / F.greatest(F.col("_a") + F.col("_b") - 2, F.lit(1)))
    return g.withColumn("cohens_d", ratio(F.col("right_mean") - F.col("left_mean"), pooled)).drop("_a", "_b", "_va", "_vb")


def empirical_overlap(df: DataFrame, keys: Sequence[str], x: str, label: str, left: str, right: str, bins: int = 100) -> DataFrame:
    """Shared area of two density histograms over the common range; the last bin is closed."""
    rows = df.filter(F.col(label).isin(left, right)).select(*keys, F.col(x).alias("_x"), (F.col(label) == right).cast("int").alias("_y"))
    lim = rows.groupBy(*keys).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count_if(F.col("_y") == 0).alias("_n0"), F.count_if(F.col("_y") == 1).alias("_n1"))
    values = rows.groupBy(*keys, "_x", "_y").agg(F.count(F.lit(1)).alias("_c"))
    joined = values.join(lim, list(keys))
    b = F.least(F.lit(bins - 1), F.floor((F.col("_x") - F.col("_lo")) * bins / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))))
    hist = joined.groupBy(*keys, "_lo", "_hi", "_n0", "_n1", b.alias("_b")).agg(
        F.sum(F.when(F.col("_y") == 0, F.col("_c")).otherwise(0)).alias("_h0"), F.sum(F.when(F.col("_y") == 1, F.col("_c")).otherwise(0)).alias("_h1"))
    share = F.least(ratio(F.col("_h0"), F.col("_n0")), ratio(F.col("_h1"), F.col("_n1")))
    return hist.groupBy(*keys).agg(F.when(F.max("_lo") == F.max("_hi"), F.lit(1.0)).otherwise(F.sum(share)).alias("overlap"))


def roc_auc(df: DataFrame, tl: Timeline, score: str, positive: Column, cell: float = 0.001) -> DataFrame:
    """Tie-aware area under the ROC curve per key, from counts per distinct score.

    The running count of negatives is taken over score cells, so no task sorts all scores of a key.
    """
    keys = list(tl.keys)
    counts = df.select(*keys, F.col(score).cast("double").alias("_s"), positive.cast("bigint").alias("_y")).groupBy(*keys, "_s").agg(
        F.sum("_y").alias("_p"), F.sum(1 - F.col("_y")).alias("_q"))
    cum = carry(counts, Timeline(tl.keys, "_s", cell), _below=Running("sum", F.col("_q")))
    wins = F.col("_p") * (F.col("_below") - F.col("_q") + F.col("_q") / 2.0)
    g = cum.groupBy(*keys).agg(F.sum(wins).alias("_w"), F.sum("_p").alias("positives"), F.sum("_q").alias("negatives"))
    return g.withColumn("roc_auc", F.try_divide(F.col("_w"), (F.col("positives") * F.col("negatives")).cast("double"))).drop("_w")


def label_summary(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean and sample deviation of columns per label (null labels included), with counts."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[a for c in columns for a in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"))])


def processor_behavior(df: DataFrame, keys: Sequence[str], channels: Sequence[str], limit: float, near_zero: float = 0.05, near_one: float = 0.95) -> DataFrame:
    """How often channels clip, rest near zero or near one, and the typical threshold gap.

    Reads {channel}_average, {channel}_lower, {channel}_upper and {channel}_output.
    """
    frac = lambda cond: F.avg(cond.cast("double"))
    g = df.groupBy(*keys).agg(*[a for c in channels for a in (
        frac(F.col(f"{c}_average") >= limit - 1e-9).alias(f"_clip_{c}"), frac(F.col(f"{c}_output") <= near_zero).alias(f"_low_{c}"),
        frac(F.col(f"{c}_output") >= near_one).alias(f"_high_{c}"))])
    gaps = exact_quantiles(df, keys, {f"_gap_{c}": (F.col(f"{c}_upper") - F.col(f"{c}_lower"), 0.5) for c in channels})
    each = lambda p: [F.col(f"{p}{c}") for c in channels]
    s, n = F.sort_array(F.array(*each("_gap_"))), len(channels)
    return g.join(gaps, list(keys)).select(
        *keys, mean_of(each("_clip_")).alias("clip_fraction"), mean_of(each("_low_")).alias("low_fraction"), mean_of(each("_high_")).alias("high_fraction"),
        (1.0 - mean_of(each("_low_")) - mean_of(each("_high_"))).alias("mid_fraction"), ((s[(n - 1) // 2] + s[n // 2]) / 2).alias("median_threshold_gap"))


def jaw_summary(df: DataFrame, keys: Sequence[str], label: str, activation: str, direction: str, jaw: str = "Jaws", rest: str = "norm",
                sides: Sequence[str] = ("Jleft", "Jright")) -> DataFrame:
    """Activation of jaw versus rest, direction of jaw versus sideways moves, and their difference."""
    mean = lambda cond, c: F.avg(F.when(cond, F.col(c)))
    j, n, s = F.col(label) == jaw, F.col(label) == rest, F.col(label).isin(*sides)
    g = df.groupBy(*keys).agg(mean(j, activation).alias("jaw_activation"), mean(n, activation).alias("rest_activation"),
                              mean(j, direction).alias("jaw_direction"), mean(s, direction).alias("side_direction"))
    a = F.col("jaw_activation") / F.greatest(F.col("rest_activation"), F.lit(1e-9))
    d = F.col("jaw_direction") / F.greatest(F.col("side_direction"), F.lit(1e-3))
    return g.withColumns({"activation_ratio": a, "direction_ratio": d, "center_score": a - d})


def mode_winners(table: DataFrame) -> DataFrame:
    """Three ranked winners of a mode-by-method comparison.

    The jaw winner prefers rows with little clipping and a used middle range, and falls back to all rows.
    """
    fit = (F.col("clip_fraction") < 0.5) & (F.col("mid_fraction") > 0.1)
    any_fit = F.max(fit.cast("int")).over(Window.partitionBy())
    pick = lambda name, df, *order: first_best(df.withColumn("winner", F.lit(name)), ["winner"], *order)
    jaw = table.withColumns({"_fit": fit.cast("int"), "_any": any_fit}).filter("_any = 0 OR _fit = 1").drop("_fit", "_any")
    return (
        pick("direction", table, F.desc("direction_macro_f1"), F.desc("roc_auc"), "mode", "method")
        .unionByName(pick("sensible", table, "clip_fraction", F.desc("mid_fraction"), F.desc("direction_macro_f1"), "mode", "method"))
        .unionByName(pick("jaw_center", jaw, F.desc("center_score"), F.desc("activation_ratio"), "mode", "method")))


def event_scores(references: DataFrame, clicks: DataFrame, matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Precision, recall, F1 and median lag of clicks against references per session (0 where undefined)."""
    return event_scores_of(references.groupBy(*keys).agg(F.count(F.lit(1)).alias("reference_onsets")), clicks, matches, keys)


def event_scores_of(r: DataFrame, clicks: DataFrame, matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`event_scores` from the number of references per key, ``reference_onsets``."""
    c = clicks.groupBy(*keys).agg(F.count(F.lit(1)).alias("detected_clicks"))
    m = matches.groupBy(*keys).agg(F.count(F.lit(1)).alias("matched_clicks"))
    lag = exact_quantiles(matches, keys, {"median_lag_ms": (F.col("lag_sec") * 1000.0, 0.5)})
    out = r.join(c, list(keys), "left").join(m, list(keys), "left").join(lag, list(keys), "left").fillna(0, ["detected_clicks", "matched_clicks"])
    precision, recall = ratio(F.col("matched_clicks"), F.col("detected_clicks")), ratio(F.col("matched_clicks"), F.col("reference_onsets"))
    return out.withColumns({
        "missed_onsets": F.col("reference_onsets") - F.col("matched_clicks"), "extra_clicks": F.col("detected_clicks") - F.col("matched_clicks"),
        "precision": precision, "recall": recall, "event_f1": ratio(2.0 * precision * recall, precision + recall)})


def weighted_mean(value: str, weight: str) -> Column:
    """Weighted mean, the plain mean when all weights are 0, 0 for no rows."""
    w = F.sum(weight)
    return F.coalesce(F.when(w == 0, F.avg(value)).otherwise(F.try_divide(F.sum(F.col(value) * F.col(weight)), w.cast("double"))), F.lit(0.0))


def strategy_summary(scores: DataFrame, keys: Sequence[str], role: str = "split_role") -> DataFrame:
    """Session scores weighted by reference count, per strategy and split."""
    return scores.groupBy(*keys, role).agg(
        *[weighted_mean(m, "reference_onsets").alias(f"weighted_{m}") for m in ("precision", "recall", "event_f1")],
        F.sum("reference_onsets").alias("total_references"), F.sum("detected_clicks").alias("total_clicks"), F.sum("extra_clicks").alias("total_extra_clicks"))


def best_config(summary: DataFrame, by: Sequence[str], config: str) -> DataFrame:
    """Best configuration per group: F1, then precision, then fewest extra clicks."""
    return first_best(summary, by, F.desc("weighted_event_f1"), F.desc("weighted_precision"), F.asc("total_extra_clicks"), F.asc(config))


def seed_summary(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, worst and population deviation over seeds."""
    return runs.groupBy(*keys).agg(
        *[F.avg(c).alias(f"{c}_mean") for c in ("false_triggers_per_min", "repeated_triggers_per_min", "direction_accuracy", "wrong_rate", "miss_rate", "avg_latency_s")],
        *[F.max(c).alias(f"{c}_worst") for c in ("false_triggers_per_min", "repeated_triggers_per_min", "wrong_rate", "miss_rate")],
        F.stddev_pop("direction_accuracy").alias("direction_accuracy_std"), F.stddev_pop("avg_latency_s").alias("avg_latency_s_std"),
        *[F.sum(c).alias(f"{c}_total") for c in ("wrong", "missed", "direction_trials")])


def _ranked(summary: DataFrame, order: Sequence[Column]) -> DataFrame:
    return summary.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(*order)))


def rank_safety_first(summary: DataFrame, config: str) -> DataFrame:
    """Fewest false triggers, then fewest wrong commands, then speed, then accuracy (one row per config of the grid)."""
    return _ranked(summary, [
        F.asc("false_triggers_per_min_mean"), F.asc("false_triggers_per_min_worst"), F.asc("wrong_total"), F.asc_nulls_last("avg_latency_s_mean"),
        F.desc("direction_accuracy_mean"), F.asc(config)])


def rank_constrained(summary: DataFrame, config: str, false_max: float = 0.5, repeated_max: float = 0.5) -> DataFrame:
    """Configs within both trigger limits, or all of them if none is, by misses, errors, speed, accuracy."""
    meets = (F.col("false_triggers_per_min_worst") <= false_max) & (F.col("repeated_triggers_per_min_worst") <= repeated_max)
    rows = summary.withColumn("meets_constraints", meets).withColumn("_any", F.max(F.col("meets_constraints").cast("int")).over(Window.partitionBy()))
    kept = rows.filter("_any = 0 OR meets_constraints").drop("_any")
    return _ranked(kept, [F.asc("miss_rate_mean"), F.asc("wrong_rate_mean"), F.asc_nulls_last("avg_latency_s_mean"), F.desc("direction_accuracy_mean"), F.asc(config)])


def decode_summary(decode: DataFrame, key: str = "session_id") -> DataFrame:
    """Exactness and absolute error per (session, label) and per label over all sessions, in one pass."""
    g = decode.groupingSets([[F.col(key), F.col("label")], [F.col("label")]], F.col(key), F.col("label")).agg(
        F.count(F.lit(1)).alias("trial_count"),
        F.avg(F.col("unconstrained_exact").cast("double")).alias("unconstrained_exact_accuracy"), F.avg(F.col("constrained_exact").cast("double")).alias("constrained_exact_accuracy"),
        F.avg(F.abs("unconstrained_error")).alias("unconstrained_mae"), F.avg(F.abs("constrained_error")).alias("constrained_mae"),
        F.grouping(key).cast("boolean").alias("pooled"))
    return g


def decode_by_file(decode: DataFrame, labels: Sequence[str], key: str = "session_id", accuracy: float = 0.55, error: float = 1.0) -> DataFrame:
    """Constrained exactness and error of the named labels per session and over all, and whether that clears the gate."""
    exact, off = F.avg(F.col("constrained_exact").cast("double")), F.avg(F.abs("constrained_error"))
    g = decode.where(F.col("label").isin(*labels)).groupingSets([[F.col(key)], []], F.col(key)).agg(
        F.count(F.lit(1)).alias("trial_count"), exact.alias("constrained_exact_accuracy"), off.alias("constrained_mae"), F.grouping(key).cast("boolean").alias("pooled"))
    return g.withColumn("gate_pass", F.coalesce((F.col("constrained_exact_accuracy") >= accuracy) & (F.col("constrained_mae") <= error), F.lit(False)))


def joint_metrics(windows: DataFrame, intervals: DataFrame, keys: Sequence[str], y: str, y_count: str, labels: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """Movement, count and joint exactness per fold, at window and at interval grain, one row per fold."""
    out = None
    for grain, rows in (("window", windows), ("interval", intervals)):
        move = classification_metrics(rows, keys, y, "predicted_label", labels).select(*keys, F.col("n").alias(f"{grain}s"), F.col("accuracy").alias(f"movement_{grain}_accuracy"), F.col("macro_f1").alias(f"movement_{grain}_macro_f1"))
        count = classification_metrics(rows, keys, y_count, "predicted_count", counts).select(*keys, F.col("accuracy").alias(f"count_{grain}_accuracy"), F.col("macro_f1").alias(f"count_{grain}_macro_f1"))
        joint = rows.groupBy(*keys).agg(F.avg(F.col("joint_exact").cast("double")).alias(f"joint_{grain}_exact"))
        both = move.join(count, list(keys)).join(joint, list(keys))
        out = both if out is None else out.join(both, list(keys))
    return out


def stage_chain(verdicts: DataFrame, requires: Mapping[str, Sequence[str]]) -> DataFrame:
    """What becomes of every stage when a stage only runs if all it requires have passed: ``stage, status, reason``.

    ``verdicts`` carry stage and gate_pass. The status is passed, failed (it ran and missed its gate, or has no verdict) or
    skipped; the reason of a skipped stage names its direct requirements that did not pass. ``requires`` is the caller's
    fixed graph; a cycle is an error.
    """
    before: dict[str, set[str]] = {}

    def ancestors(stage: str, path: tuple[str, ...] = ()) -> set[str]:
        if stage in path:
            raise ValueError(f"stages require each other: {' -> '.join((*path, stage))}")
        if stage not in before:
            before[stage] = {a for r in requires.get(stage, ()) for a in {r, *ancestors(r, (*path, stage))}}
        return before[stage]

    stages = sorted({*requires, *[r for rs in requires.values() for r in rs]})
    spark = verdicts.sparkSession
    table = F.broadcast(spark.createDataFrame([(s, sorted(ancestors(s)), sorted(requires.get(s, ()))) for s in stages], "stage string, _ancestors array<string>, _requires array<string>"))
    own = table.join(verdicts.select("stage", "gate_pass"), "stage", "left").withColumn("gate_pass", F.coalesce("gate_pass", F.lit(False)))
    failed = F.broadcast(own.agg(F.collect_set(F.when(~F.col("gate_pass"), F.col("stage"))).alias("_failed")))  # at most the stages of the graph
    runs = own.withColumn("_one", F.lit(1)).join(failed.withColumn("_one", F.lit(1)), "_one").withColumn("_stopped", F.arrays_overlap("_ancestors", "_failed"))
    status = F.when(F.col("_stopped"), "skipped").when(F.col("gate_pass"), "passed").otherwise("failed")
    by_stage = runs.withColumn("status", status)
    state = F.broadcast(by_stage.agg(F.map_from_entries(F.collect_list(F.struct("stage", "status"))).alias("_status")).withColumn("_one", F.lit(1)))
    missing = F.filter("_requires", lambda x: F.element_at("_status", x) != "passed")
    reason = F.array_join(F.transform(missing, lambda x: F.concat(x, F.lit(" "), F.element_at("_status", x))), "; ")
    return by_stage.join(state, "_one").select("stage", "status", F.when(F.col("status") == "skipped", reason).alias("reason"))


def task_summary(results: DataFrame, by: Sequence[str], metrics: Sequence[str] = ("accuracy", "macro_f1")) -> DataFrame:
    """Mean and population variance of metrics per task, or per pair of sessions."""
    return results.groupBy(*by).agg(F.count(F.lit(1)).alias("n_results"), *[a for m in metrics for a in (F.avg(m).alias(f"mean_{m}"), F.var_pop(m).alias(f"var_{m}"))])


def best_vs_baseline(results: DataFrame, group: str, baseline: float) -> DataFrame:
    """Best row per group value and its difference from the baseline group's best."""
    best = first_best(results, [group], F.desc("macro_f1"), F.desc("accuracy"), F.asc("model_name"))
    base = best.filter(F.col(group) == baseline).select(F.col("macro_f1").alias("_f"), F.col("active_recall").alias("_r"))
    # one baseline row, so broadcasting it is bounded
    one = F.broadcast(base.limit(1).withColumn("_one", F.lit(1)))
    return best.withColumn("_one", F.lit(1)).join(one, "_one", "left").withColumns({
        "delta_macro_f1": F.col("macro_f1") - F.col("_f"), "delta_active_recall": F.col("active_recall") - F.col("_r")}).drop("_f", "_r", "_one")


def stage_gates(metrics: DataFrame, gates: Sequence[tuple[str, str, float, str]] = STAGE_GATES) -> DataFrame:
    """Pass or fail per stage from (stage, metric, value) rows; a missing metric fails and is named as the reason."""
    table = metrics.sparkSession.createDataFrame(list(gates), "stage string, metric string, limit double, direction string")
    joined = F.broadcast(table).join(metrics, ["stage", "metric"], "left")
    ok = F.coalesce(F.when(F.col("direction") == "min", F.col("value") >= F.col("limit")).otherwise(F.col("value") <= F.col("limit")), F.lit(False))
    failing = F.array_join(F.sort_array(F.collect_list(F.when(~F.col("_ok"), F.col("metric")))), ", ")
    return joined.withColumn("_ok", ok).groupBy("stage").agg(F.bool_and("_ok").alias("gate_pass"), failing.alias("failing_metrics"))


def class_counts(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Label distribution per key as one map (a label set is small by nature)."""
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(label, "_n")))).alias("class_counts"))


def clamp(x: Column, lo: float | Column, hi: float | Column) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(as_col(lo), F.least(as_col(hi), x))


def session_adaptation(trace: DataFrame, steps: DataFrame, keys: Sequence[str], at: str, width: float) -> DataFrame:
    """Decision thresholds adapted to a session from quantiles of its guided phases, or the base values.

    Steps carry step_id, step_label in {BASELINE, JAW_TAP, HOLD, LEFT, RIGHT}, step_start, step_end; the first
    baseline step counts. The trace carries jaw, jaw_active, hand_left, hand_right.
    """
    first = steps.groupBy(*keys).agg(F.min(F.when(F.col("step_label") == "BASELINE", F.col("step_id"))).alias("_first"))
    used = steps.join(first, list(keys)).filter((F.col("step_label") != "BASELINE") | (F.col("step_id") == F.col("_first"))).drop("_first")
    rows = range_join(trace, used, keys, at, "step_start", "step_end", width)
    phase = lambda name, c: F.when(F.col("step_label") == name, F.col(c))
    left, right = F.col("step_label") == "LEFT", F.col("step_label") == "RIGHT"
    base = F.col("step_label") == "BASELINE"
    target = F.when(left, F.col("hand_left")).when(right, F.col("hand_right"))
    margin = F.when(left, F.col("hand_left") - F.col("hand_right")).when(right, F.col("hand_right") - F.col("hand_left"))
    q = exact_quantiles(rows, keys, {
        "tap_q40": (phase("JAW_TAP", "jaw"), 0.40), "hold_q50": (phase("HOLD", "jaw_active"), 0.50), "hold_q75": (phase("HOLD", "jaw_active"), 0.75),
        "base_jaw_q98": (phase("BASELINE", "jaw"), 0.98), "base_active_q98": (phase("BASELINE", "jaw_active"), 0.98),
        "target_q35": (target, 0.35), "target_q65": (target, 0.65), "margin_q35": (margin, 0.35)})
    both = rows.filter(base).select(*keys, F.explode(F.array("hand_left", "hand_right")).alias("_h"))
    q = q.join(exact_quantiles(both, keys, {"base_lr_q98": (F.col("_h"), 0.98)}), list(keys), "left")
    c = F.col
    yes = lambda cond: F.coalesce(cond, F.lit(False))
    tap = yes(c("tap_q40") > c("base_jaw_q98") + 0.04)
    hold = yes(c("hold_q50") > c("base_active_q98") + 0.03)
    hand = yes((c("target_q35") > c("base_lr_q98") + 0.03) & (c("margin_q35") > 0.05))
    click = F.when(tap, clamp((c("tap_q40") + c("base_jaw_q98")) / 2, 0.58, 0.88)).otherwise(0.80)
    return q.withColumn("click_threshold", click).withColumns({
        "rearm_threshold": F.when(tap, clamp(c("click_threshold") - 0.20, 0.25, c("click_threshold") - 0.06)).otherwise(0.50),
        "hold_probability_threshold": F.when(hold, clamp((c("hold_q50") + c("base_active_q98")) / 2, 0.55, 0.88)).otherwise(0.70),
        "hold_onset_sec": F.when(hold, F.when(c("hold_q75") >= 0.78, 0.40).otherwise(0.48)).otherwise(0.45),
        "jaw_reason": F.when(tap | hold, "session_quantile_shift").otherwise("fallback_to_base"),
        "direction_min_confidence": F.when(hand, clamp(c("target_q35") - 0.02, 0.50, 0.78)).otherwise(0.60),
        "direction_margin": F.when(hand, clamp(c("margin_q35") * 0.85, 0.05, 0.22)).otherwise(0.10),
        "hand_action_latch_sec": F.when(hand & yes(c("target_q65") < 0.72), 0.55).otherwise(0.45),
        "hand_switch_cooldown_sec": F.when(hand & yes(c("margin_q35") < 0.10), 0.26).otherwise(0.20),
        "hand_reason": F.when(hand, "session_confidence_separation").otherwise("fallback_to_base")})


def two_grain_metrics(windows: DataFrame, intervals: DataFrame, keys: Sequence[str], y: str, p: str, labels: Sequence[str]) -> DataFrame:
    """The same metrics at window and at interval grain, per fold and pooled."""
    out = None
    for grain, df in (("window", windows), ("interval", intervals)):
        for scope, by in (("fold", list(keys)), ("pooled", [])):
            rows = df if by else df.withColumn("_all", F.lit(1))
            m = classification_metrics(rows, by or ["_all"], y, p, labels)
            if not by:
                m = m.drop("_all").select(*[F.lit(None).cast(df.schema[k].dataType).alias(k) for k in keys], "*")
            m = m.withColumns({"grain": F.lit(grain), "scope": F.lit(scope)})
            out = m if out is None else out.unionByName(m)
    return out


def trial_review(trials: DataFrame, checks: DataFrame, quality: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Review numbers per session: structure, trials by label, count matches, channels that are not safe."""
    t = trials.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trials"), *[F.count_if(F.col("label") == l).alias(f"trials_{l.lower()}") for l in ("LEFT", "RIGHT", "JAW")],
        F.count_if("count_match").alias("count_matches"), F.count_if(~F.col("count_match")).alias("count_mismatches"))
    c = checks.groupBy(*keys).agg(F.count_if(F.col("severity") == "hard").alias("hard_issues"), F.count_if(F.col("severity") == "soft").alias("soft_warnings"))
    q = quality.groupBy(*keys).agg(F.count_if(F.col("status") != "safe").alias("not_safe_channels"))
    out = t.join(c, list(keys), "left").join(q, list(keys), "left").fillna(0, ["hard_issues", "soft_warnings", "not_safe_channels"])
    return out.withColumn("structural_pass", F.col("hard_issues") == 0)


def alignment_summary(events: DataFrame, key: str = "session_id") -> DataFrame:
    """Kept events inside and outside blocks per session, plus one overall row, with a reading of the share."""
    kept = F.col("kept_for_count")
    g = events.groupBy(key).agg(F.count_if(kept & F.col("inside_marker_block")).alias("inside"), F.count_if(kept & ~F.col("inside_marker_block")).alias("outside"))
    r = g.rollup(key).agg(F.sum("inside").alias("kept_inside"), F.sum("outside").alias("kept_outside"), F.grouping(key).cast("boolean").alias("overall"))
    total = F.col("kept_inside") + F.col("kept_outside")
    share = F.try_divide(F.col("kept_inside").cast("double"), total.cast("double"))
    note = (F.when(total == 0, "no kept events").when((share >= 0.90) & (F.col("kept_outside") <= 2), "strong")
            .when(share >= 0.75, "usable, review outside events").otherwise("weak, diagnostic only"))
    return r.withColumns({"inside_block_fraction": share, "note": note})
