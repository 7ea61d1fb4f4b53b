"""Composed experiments: two-stage pipelines, transfer, grids and leave-one-session-out."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import labels as lb
from pulsegrid.operators import joins as jn
from pulsegrid.operators import learn as ln
from pulsegrid.operators import machines as mc
from pulsegrid.operators import splits as sp
from pulsegrid.runtime import materialize
from pulsegrid.timeline import Timeline


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def fit_two_stage(train: DataFrame, features: Sequence[str], label: str = "label", moves: Sequence[str] = ("LEFT", "RIGHT"), kind: str = "logistic",
                  other: str | None = None, trees: int = 200):
    """Intent model on all rows, direction model on moving rows (with ``other`` as a third class if named)."""
    intent = F.when(F.col(label).isin(*moves) | ((F.col(label) == other) if other else F.lit(False)), "ACTIVE").otherwise("REST")
    gate = ln.fit_model(kind, train.withColumn("_intent", intent), features, "_intent", ["REST", "ACTIVE"], trees=trees)
    names = [*moves, "Other"] if other else list(moves)
    rows = train.filter(F.col(label).isin(*moves, *([other] if other else []))).withColumn("_dir", F.when(F.col(label).isin(*moves), F.col(label)).otherwise("Other"))
    return gate, ln.fit_model(kind, rows, features, "_dir", names, trees=trees)


def two_stage_scores(rows: DataFrame, gate, direction, moves: Sequence[str] = ("LEFT", "RIGHT")) -> DataFrame:
    """Gate probability, direction probabilities and the direction call per window, in one pass over the rows."""
    gated = gate.score(rows, "gate_").withColumnsRenamed({"gate_ACTIVE": "p_active"}).drop("gate_REST", "predicted")
    return direction.score(gated, "dir_").withColumnRenamed("predicted", "direction")


def two_stage_pipeline(train: DataFrame, test: DataFrame, features: Sequence[str], tau: float, kind: str = "logistic", label: str = "label", **tags: str) -> DataFrame:
    """Three-class and gate metrics of gate-then-direction."""
    gate, direction = fit_two_stage(train, features, label, kind=kind)
    scored = two_stage_scores(test, gate, direction).withColumn("predicted", mc.gate_then_classify("p_active", "direction", tau))
    three = ln.evaluate(scored, label, ["REST", "LEFT", "RIGHT"], target="three_class", **tags)
    gates = scored.select(F.when(F.col(label) == "REST", "REST").otherwise("ACTIVE").alias(label), F.when(F.col("p_active") >= tau, "ACTIVE").otherwise("REST").alias("predicted"))
    g = ln.evaluate(gates, label, ["REST", "ACTIVE"], target="gate", **tags)
    return three.unionByName(g, allowMissingColumns=True)


def window_size_sweep(build: Callable[[float], tuple[DataFrame, DataFrame]], sizes: Sequence[float], features: Sequence[str], tau: float) -> DataFrame:
    """The two-stage pipeline per window length; ``build`` gives the train and test windows of a length."""
    return _union([two_stage_pipeline(*build(s), features, tau, window_sec=str(s)) for s in sizes])


def mixed_window_pipeline(gate_rows: tuple[DataFrame, DataFrame], dir_rows: tuple[DataFrame, DataFrame], features: Sequence[str], tl: Timeline, window_id: str,
                          tau: float, width: float, label: str = "label") -> DataFrame:
    """Gate and direction on different window lengths, joined by time rather than by row order.

    Both window tables carry w_start, w_end and center.
    """
    gate, _ = fit_two_stage(gate_rows[0], features, label)
    _, direction = fit_two_stage(dir_rows[0], features, label)
    gated = gate.score(gate_rows[1], "gate_").select(*tl.keys, F.col("w_start").alias("g_start"), F.col("w_end").alias("g_end"), F.col("center").alias("g_center"), F.col("gate_ACTIVE").alias("p_active"))
    called = direction.score(dir_rows[1], "dir_").withColumnRenamed("predicted", "direction")
    p = jn.project_scores(called, gated, tl, window_id, width)
    return p.withColumn("predicted", mc.gate_then_classify("projected_p_active", "direction", tau))


def leave_one_session_out(rows: DataFrame, sessions: Sequence, features: Sequence[str], label: str, labels: Sequence[str], kinds: Sequence[str], key: str = "session_id",
                          stress: DataFrame | None = None, trees: int = 200) -> DataFrame:
    """Fold metrics per named session, metrics pooled over folds, and transfer to stress sessions trained on all.

    Discriminants of all folds come from one job: each fold is the sum of all sessions' moments less its own.
    """
    parts = []
    for kind in kinds:
        if kind == "lda":
            parts.append(_folds_by_subtraction(rows, sessions, features, label, labels, key, stress))
            continue
        scored = []
        for s in sessions:
            m = ln.fit_model(kind, rows.filter((F.col(key) != s) & F.col(key).isin(*sessions)), features, label, labels, trees=trees)
            one = m.score(rows.filter(F.col(key) == s))
            scored.append(one)
            parts.append(ln.evaluate(one, label, labels, scope="fold", fold=str(s), model_name=kind))
        parts.append(ln.evaluate(_union(scored), label, labels, scope="pooled", fold="", model_name=kind))
        if stress is not None:
            m = ln.fit_model(kind, rows.filter(F.col(key).isin(*sessions)), features, label, labels, trees=trees)
            parts.append(ln.evaluate(m.score(stress), label, labels, scope="stress", fold="", model_name=kind))
    return _union(parts)


def _folds_by_subtraction(rows: DataFrame, sessions: Sequence, features: Sequence[str], label: str, labels: Sequence[str], key: str, stress: DataFrame | None) -> DataFrame:
    names = [str(s) for s in sessions]
    grams = ln.group_moments(rows.filter(F.col(key).isin(*sessions)), features, label, labels, key)
    total = sum(grams.values())
    models = {s: ln.discriminant_of(total - grams[s] if s in grams else total, labels, features) for s in names}
    scored = ln.predict_groups(rows, models, {s: [s] for s in names}, key, label).select(F.lit("fold").alias("scope"), F.col("model").alias("fold"), "label", "predicted")
    scored = materialize(scored)
    every = scored.unionByName(scored.withColumns({"scope": F.lit("pooled"), "fold": F.lit("")}))
    if stress is not None:
        model = ln.discriminant_of(total, labels, features)
        others = ln.predict_groups(stress.withColumn("_stress", F.lit("stress")), {"": model}, {"stress": [""]}, "_stress", label)
        every = every.unionByName(others.select(F.lit("stress").alias("scope"), F.lit("").alias("fold"), "label", "predicted"))
    return ln.evaluate_by(every, ["scope", "fold"], "label", labels).withColumn("model_name", F.lit("lda"))


def cross_session_pairs(rows: DataFrame, pairs: Sequence[tuple], features: Sequence[str], label: str, labels: Sequence[str], kind: str = "logistic", key: str = "session_id") -> DataFrame:
    """Train on one session and test on another, for a caller-given list of pairs; discriminants of all pairs in two jobs."""
    if kind == "lda":
        grams = ln.group_moments(rows.filter(F.col(key).isin(*{a for a, _ in pairs})), features, label, labels, key)
        models = {str(a): ln.discriminant_of(grams[str(a)], labels, features) for a in {a for a, _ in pairs}}
        tests: dict[str, list[str]] = {}
        for a, b in pairs:
            tests.setdefault(str(b), []).append(f"{a}\t{b}")
        by_pair = {f"{a}\t{b}": models[str(a)] for a, b in pairs}
        scored = ln.predict_groups(rows, by_pair, tests, key, label)
        both = F.split("model", "\t")
        return ln.evaluate_by(materialize(scored), ["model"], "label", labels).withColumns({"train_session": both[0], "test_session": both[1]}).drop("model")
    out = []
    for a, b in pairs:
        m = ln.fit_model(kind, rows.filter(F.col(key) == a), features, label, labels)
        out.append(ln.evaluate(m.score(rows.filter(F.col(key) == b)), label, labels, train_session=str(a), test_session=str(b)))
    return _union(out)


def transfer_scores(train: DataFrame, target: DataFrame, shared: Sequence[str], stats: Sequence[str], tau: float) -> DataFrame:
    """Train on known sessions and score an unseen one on the channels both share."""
    features = [f"{c}_{s}" for c in shared for s in stats]
    gate, direction = fit_two_stage(train, features)
    return two_stage_scores(target, gate, direction).withColumn("predicted", mc.gate_then_classify("p_active", "direction", tau))


def experiment_grid(datasets: Mapping[str, tuple[DataFrame, DataFrame]], tasks: Mapping[str, tuple[Callable[[DataFrame], DataFrame], Sequence[str]]],
                    feature_sets: Mapping[str, Sequence[str]], kinds: Sequence[str], label: str = "label", trees: int = 100) -> DataFrame:
    """Every dataset x task x feature set x model, each a row of metrics."""
    parts = []
    for d, (train, test) in datasets.items():
        for t, (remap, labels) in tasks.items():
            a, b = remap(train), remap(test)
            for f, features in feature_sets.items():
                parts.append(ln.model_bank(a, b, features, label, labels, kinds, trees, dataset=d, task=t, feature_set=f))
    return _union(parts)


def feature_configurations(tables: Mapping[float, tuple[DataFrame, DataFrame]], label: str, labels: Sequence[str], kinds: Sequence[str], trees: int = 100) -> DataFrame:
    """Window lengths (seconds) x time, spectral or combined features x with or without asymmetries, each a row of metrics.

    ``tables`` give train and test windows per length, with the feature names that `labels.feature_projection` knows.
    """
    parts = []
    for seconds, (train, test) in tables.items():
        for mode in ("time_only", "spectral_only", "combined"):
            for asymmetry in (False, True):
                if asymmetry and mode == "time_only":
                    continue  # asymmetries are spectral
                features = lb.feature_projection(train.columns, mode, asymmetry)
                row = ln.model_bank(train, test, features, label, labels, kinds, trees, feature_mode=mode)
                parts.append(row.withColumns({"window_sec": F.lit(float(seconds)), "with_asymmetry": F.lit(asymmetry), "n_features": F.lit(len(features))}))
    return _union(parts)


def event_state_tasks(windows: DataFrame, features: Sequence[str], kinds: Sequence[str], role: str = "split_role", trees: int = 100) -> DataFrame:
    """The three event-label tasks over one window table."""
    parts = []
    for task, labels in lb.EVENT_TASK_LABELS.items():
        rows = windows.withColumn("label", lb.event_task_label("event_label", task))
        parts.append(ln.model_bank(rows.filter(F.col(role) == "train"), rows.filter(F.col(role) == "test"), features, "label", labels, kinds, trees, task=task))
    return _union(parts)


def hold_vs_repeated(segments: DataFrame, features: Sequence[str], kinds: Sequence[str], baseline: Column, role: str = "split_role", trees: int = 100) -> DataFrame:
    """Segment classifier next to the count heuristic."""
    labels = ["HOLD", "REPEATED"]
    train, test = segments.filter(F.col(role) == "train"), segments.filter(F.col(role) == "test")
    bank = ln.model_bank(train, test, features, "label", labels, kinds, trees)
    return bank.unionByName(ln.evaluate(test.withColumn("predicted", baseline), "label", labels, model_name="count_heuristic"))


def calibrated_windows(windows: DataFrame, calibration: DataFrame, features: Sequence[str], tl: Timeline) -> DataFrame:
    return sp.calibration_zscore(windows, calibration, tl, features)
