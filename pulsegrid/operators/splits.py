"""Train/test splits and calibration-aware normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.labels import argmax_label
from pulsegrid.timeline import Running, Timeline, attach, carry


def session_order_split(windows: DataFrame, catalog: DataFrame, train_sessions: int | None = None, key: str = "session_id") -> DataFrame:
    """First sessions of a family train, its last session tests, the rest is left out.

    Without ``train_sessions`` every session but the last trains. The catalog carries family and session_rank.
    """
    last = catalog.groupBy("family").agg(F.max("session_rank").alias("_last"))
    rank = F.col("session_rank")
    limit = F.lit(train_sessions) if train_sessions is not None else F.col("_last") - 1
    roles = catalog.join(last, "family").withColumn(
        "split_role", F.when(rank == F.col("_last"), "test").when(rank <= limit, "train")).filter("split_role IS NOT NULL")
    return windows.join(roles.select(key, "split_role"), key)


def _ranked(rows: DataFrame, tl: Timeline, order: Sequence[str]) -> DataFrame:
    counts = rows.groupBy(*tl.keys).agg(F.count(F.lit(1)).alias("_total"))
    return attach(carry(rows, tl, order=order, _rank=Running("sum", F.lit(1))), tl, counts)


def chronological_split(windows: DataFrame, tl: Timeline, fraction: float, order: Sequence[str] = ()) -> DataFrame:
    """First share of each series by time trains; both sides keep at least one row."""
    rows = _ranked(windows, tl, order)
    cut = F.greatest(F.lit(1), F.least(F.col("_total") - 1, F.bround(F.col("_total") * fraction)))
    return rows.withColumn("split_role", F.when(F.col("_rank") <= cut, "train").otherwise("test")).drop("_rank", "_total")


def class_time_split(windows: DataFrame, tl: Timeline, label: str, test_size: float = 0.3, order: Sequence[str] = ()) -> DataFrame:
    """First share of every class by time trains."""
    rows = _ranked(windows, tl.by(label), order)
    cut = F.floor(F.col("_total") * (1 - test_size))
    return rows.withColumn("split_role", F.when(F.col("_rank") <= cut, "train").otherwise("test")).drop("_rank", "_total")


HASH_CELL = 1 << 22


def _shuffled(groups: DataFrame, group: Sequence[str], seed: int) -> DataFrame:
    """A reproducible random order: position and tie-break from a digest of the group and the seed."""
    digest = F.md5(F.concat_ws("|", *[F.col(g).cast("string") for g in group], F.lit(str(seed))))
    return groups.withColumn("_digest", digest).withColumn("_place", F.conv(F.substring("_digest", 1, 8), 16, 10).cast("bigint"))


def stratified_group_folds(rows: DataFrame, group: Sequence[str], label: str, folds: int, seed: int = 42) -> DataFrame:
    """Deal whole groups to folds, class by class in shuffled order. Each group has one label."""
    groups = _shuffled(rows.groupBy(*group).agg(F.min(label).alias("_class")), group, seed)
    dealt = carry(groups, Timeline(("_class",), "_place", HASH_CELL), order=("_digest",), _n=Running("sum", F.lit(1)))
    return rows.join(dealt.select(*group, ((F.col("_n") - 1) % folds).cast("int").alias("fold")), list(group))


def stratified_group_holdout(rows: DataFrame, group: Sequence[str], label: str, test_size: float = 0.25, seed: int = 42) -> DataFrame:
    """Hold out whole groups: a quota per class, then the total is met by dropping or adding groups in shuffled order."""
    groups = _shuffled(rows.groupBy(*group).agg(F.min(label).alias("_class")), group, seed).withColumn("_all", F.lit(1))
    per_class = groups.groupBy("_class").agg(F.count(F.lit(1)).alias("_nc"))
    quota = F.when((F.bround(F.col("_nc") * test_size) == 0) & (F.col("_nc") > 1), F.lit(1)).otherwise(F.bround(F.col("_nc") * test_size))
    ranked = carry(groups, Timeline(("_class",), "_place", HASH_CELL), order=("_digest",), _rc=Running("sum", F.lit(1)))
    picked = ranked.join(per_class.withColumn("_quota", F.least(quota, F.col("_nc"))), "_class").withColumn("_in", (F.col("_rc") <= F.col("_quota")).cast("int"))
    totals = per_class.groupBy().agg(F.sum("_nc").alias("_n"), F.sum(F.least(quota, F.col("_nc"))).alias("_chosen")).withColumn("_all", F.lit(1))
    order = carry(picked, Timeline(("_all", "_in"), "_place", HASH_CELL), order=("_digest",), _ro=Running("sum", F.lit(1)))
    # one row of totals, so broadcasting it is bounded
    placed = order.join(F.broadcast(totals), "_all")
    want = F.greatest(F.lit(1), F.least(F.col("_n") - 1, F.bround(F.col("_n") * test_size)))
    test = F.when(F.col("_in") == 1, F.col("_ro") <= want).otherwise(F.col("_ro") <= want - F.col("_chosen"))
    return rows.join(placed.select(*group, F.when(test, "test").otherwise("train").alias("split_role")), list(group))


def leave_one_session_out(rows: DataFrame, fold: str, key: str = "session_id") -> DataFrame:
    """Role of every row when the named session is held out."""
    return rows.withColumn("split_role", F.when(F.col(key) == fold, "test").otherwise("train"))


def _moments(rows: DataFrame, keys: Sequence[str], features: Sequence[str], where: Column | None = None) -> DataFrame:
    pick = (lambda f: F.when(where, F.col(f))) if where is not None else F.col
    return rows.groupBy(*keys).agg(*[a for f in features for a in (
        F.avg(pick(f)).alias(f"_m_{f}"), F.coalesce(F.nullif(F.stddev_pop(pick(f)), F.lit(0.0)), F.lit(1.0)).alias(f"_s_{f}"))])


def _scaled(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    return rows.withColumns({f: (F.col(f) - F.col(f"_m_{f}")) / F.col(f"_s_{f}") for f in features}).drop(*[f"_{k}_{f}" for f in features for k in "ms"])


def calibration_zscore(windows: DataFrame, calibration: DataFrame, tl: Timeline, features: Sequence[str]) -> DataFrame:
    """Standardise each session by its own calibration windows (population spread, 0 counts as 1)."""
    return _scaled(attach(windows, tl, _moments(calibration, tl.keys, features)), features)


def uncalibrated_sessions(windows: DataFrame, calibration: DataFrame, key: str = "session_id") -> DataFrame:
    """Sessions without any calibration window; they cannot be standardised."""
    return windows.select(key).distinct().join(calibration, key, "left_anti")


def rest_baseline_scale(rows: DataFrame, features: Sequence[str], label: str = "label", role: str = "split_role", rest: str = "REST", minimum: int = 10) -> DataFrame:
    """Standardise by the training REST rows if there are more than ``minimum``, else by all training rows."""
    train = rows.filter(F.col(role) == "train").withColumn("_one", F.lit(1))
    resting = F.col(label) == rest
    both = _moments(train, ["_one"], features, resting).join(
        _moments(train, ["_one"], features).select("_one", *[F.col(f"_{k}_{f}").alias(f"_g{k}_{f}") for f in features for k in "ms"]), "_one").join(
        train.groupBy("_one").agg(F.count_if(resting).alias("_rest")), "_one")
    use = F.col("_rest") > minimum
    one = both.select("_one", *[F.when(use, F.col(f"_{k}_{f}")).otherwise(F.col(f"_g{k}_{f}")).alias(f"_{k}_{f}") for f in features for k in "ms"])
    # one row of moments, so broadcasting it is bounded
    return _scaled(rows.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one").drop("_one"), features)


def interval_vote(windows: DataFrame, keys: Sequence[str], scores: dict[str, str]) -> DataFrame:
    """Mean class probability per interval and the best class, the first listed on ties."""
    g = windows.groupBy(*keys).agg(F.count(F.lit(1)).alias("window_count"), *[F.avg(c).alias(c) for c in scores.values()])
    return g.withColumn("predicted_label", argmax_label(scores))


def joint_vote(windows: DataFrame, keys: Sequence[str], movement: dict[str, str], counts: dict[str, str], y: str, y_count: str) -> DataFrame:
    """Movement and count of an interval by mean class probabilities, and whether both are right (``joint_exact``).

    Labels are those of the interval, equal in all its windows; the first listed class wins ties.
    """
    columns = [*movement.values(), *counts.values()]
    g = windows.groupBy(*keys).agg(F.count(F.lit(1)).alias("window_count"), F.min(y).alias(y), F.min(y_count).alias(y_count), *[F.avg(c).alias(c) for c in columns])
    return joint_match(g, movement, counts, y, y_count)


def joint_match(rows: DataFrame, movement: dict[str, str], counts: dict[str, str], y: str, y_count: str) -> DataFrame:
    """Predicted movement and count of each row, and whether both are right."""
    out = rows.withColumns({"predicted_label": argmax_label(movement), "predicted_count": argmax_label(counts)})
    exact = (F.col("predicted_label") == F.col(y)) & (F.col("predicted_count") == F.col(y_count))
    return out.withColumn("joint_exact", F.coalesce(exact, F.lit(False)))
