"""Label vocabularies and label-mapping column functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Class names and aliases that results must carry.
REST, BASELINE, LEFT, RIGHT, ACTIVE, UNKNOWN = "REST", "BASELINE", "LEFT", "RIGHT", "ACTIVE", "UNKNOWN"
INACTIVE, ONSET, OFFSET = "INACTIVE", "ONSET", "OFFSET"
JAW_STATES = (INACTIVE, ONSET, ACTIVE, OFFSET)
EVENT_TASK_LABELS = {
    "jaw_4state": JAW_STATES,
    "clench_vs_nonclench": ("NON_CLENCH", "CLENCH"),
    "active_vs_other": ("OTHER", "ACTIVE"),
}


def lookup(key: Column, mapping: Mapping[str, str], default: Column | None = None) -> Column:
    """Small dictionary lookup that stays inside generated code."""
    expr = None
    for k, v in mapping.items():
        expr = F.when(key == k, F.lit(v)) if expr is None else expr.when(key == k, F.lit(v))
    return expr.otherwise(default) if default is not None else expr


def canonical_label(label: str | Column, mapping: Mapping[str, str]) -> Column:
    """Trimmed, lower-cased lookup: null is REST, an unlisted text is UNKNOWN."""
    raw = F.col(label) if isinstance(label, str) else label
    return F.when(raw.isNull(), F.lit(REST)).otherwise(lookup(F.lower(F.trim(raw)), mapping, F.lit(UNKNOWN)))


def unknown_labels(df: DataFrame, label: str, mapping: Mapping[str, str]) -> DataFrame:
    """Distinct raw labels that ``canonical_label`` cannot place."""
    return df.filter(canonical_label(label, mapping) == UNKNOWN).select(label).distinct()


def normalize_label(label: str | Column, aliases: Mapping[str, str]) -> Column:
    """Blank or absent labels become ``missing``; aliases are replaced; other texts stay (trimmed)."""
    raw = F.trim(F.col(label) if isinstance(label, str) else label)
    blank = raw.isNull() | (raw == "") | (F.lower(raw) == "nan")
    return F.when(blank, F.lit("missing")).otherwise(lookup(raw, aliases, raw))


def event_task_label(state: str | Column, task: str) -> Column:
    """Map the four jaw states to a training task's classes."""
    s = F.col(state) if isinstance(state, str) else state
    known = s.isin(*JAW_STATES)
    if task == "jaw_4state":
        return s
    if task == "clench_vs_nonclench":
        return F.when(known, F.when(s == INACTIVE, "NON_CLENCH").otherwise("CLENCH"))
    if task == "active_vs_other":
        return F.when(known, F.when(s == ACTIVE, "ACTIVE").otherwise("OTHER"))
    raise ValueError(f"unknown event task {task!r}")


def active_vs_rest(df: DataFrame, label: str = "label") -> DataFrame:
    """Keep REST/LEFT/RIGHT and merge the movements into ACTIVE; baseline windows are dropped."""
    return df.filter(F.col(label).isin(REST, LEFT, RIGHT)).withColumn(
        label, F.when(F.col(label) == REST, REST).otherwise(ACTIVE)
    )


def one_vs_all(df: DataFrame, task: str, label: str = "label") -> DataFrame:
    """LEFT-vs-ALL, RIGHT-vs-ALL or LEFT-vs-RIGHT (which drops everything else)."""
    if task == "left_vs_right":
        return df.filter(F.col(label).isin(LEFT, RIGHT))
    target = {"left_vs_all": LEFT, "right_vs_all": RIGHT}[task]
    return df.withColumn(label, F.when(F.col(label) == target, target).otherwise("ALL"))


def coarse_task(df: DataFrame, task: str, label: str = "label") -> DataFrame:
    """Coarse tasks over segment labels; rows outside the task are dropped."""
    c = F.col(label)
    if task == "jaw_vs_rest":
        kept = df.filter(c.isin(REST, BASELINE, "HOLD", "REPEATED"))
        return kept.withColumn(label, F.when(c.isin("HOLD", "REPEATED"), "JAW").otherwise(REST))
    if task == "left_right_2class":
        return df.filter(c.isin(LEFT, RIGHT))
    if task == "left_right_3class":
        return df.filter(c.isin(LEFT, RIGHT, REST))
    if task == "active_vs_rest":
        return active_vs_rest(df, label)
    raise ValueError(f"unknown coarse task {task!r}")


def jaw_binary(label: str | Column) -> Column:
    c = F.col(label) if isinstance(label, str) else label
    return F.when(c.isin(BASELINE, REST), "NON_CLENCH").otherwise("CLENCH")


def display_label(label: str | Column, movements: Sequence[str]) -> Column:
    """Movement labels show as ACTIVE, resting ones as themselves, the rest as OTHER."""
    c = F.col(label) if isinstance(label, str) else label
    return F.when(c.isin(*movements), ACTIVE).when(c.isin(REST, BASELINE), c).otherwise("OTHER")


def slug(text: str | Column) -> Column:
    """Lower-case text with every run of other characters replaced by one underscore."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def channel_number(channel: str | Column) -> Column:
    c = F.col(channel) if isinstance(channel, str) else channel
    return F.regexp_extract(c, r"(\d+)$", 1).cast("int")


def argmax_label(scores: Mapping[str, str]) -> Column:
    """Label whose score column is largest; the first listed label wins ties."""
    best = F.greatest(*[F.col(c) for c in scores.values()]) if len(scores) > 1 else F.col(next(iter(scores.values())))
    expr = None
    for label, col in scores.items():
        hit = F.col(col) == best
        expr = F.when(hit, F.lit(label)) if expr is None else expr.when(hit, F.lit(label))
    return expr


def slice_sessions(df: DataFrame, names: Sequence[str], key: str = "session_id") -> DataFrame:
    """Rows of the named sessions; at least two names are required."""
    if len(set(names)) < 2:
        raise ValueError("name at least two sessions")
    return df.filter(F.col(key).isin(*names))


def missing_sessions(wanted: DataFrame, catalog: DataFrame, key: str = "session_id") -> DataFrame:
    """Wanted sessions that the catalog lacks."""
    return wanted.select(key).distinct().join(catalog, key, "left_anti")


def feature_projection(columns: Sequence[str], mode: str, with_asymmetry: bool = False) -> list[str]:
    """Feature names of one mode: time_only, spectral_only or combined, with or without asymmetries."""
    spectral = ("_mu_power", "_beta_power")
    time = ("_mean", "_std", "_rms", "_ptp", "_var", "_energy")
    if mode not in ("time_only", "spectral_only", "combined"):
        raise ValueError(f"unknown feature mode {mode!r}")
    suffixes = {"time_only": time, "spectral_only": spectral, "combined": time + spectral}[mode]
    keep = [c for c in columns if c.endswith(suffixes)]
    if with_asymmetry and mode != "time_only":
        keep += [c for c in columns if c.startswith(("mu_asym_", "beta_asym_"))]
    return keep
