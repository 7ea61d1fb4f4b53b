"""Classifiers over feature windows: Spark ML models, a Gaussian discriminant, and their bookkeeping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.labels import argmax_label
from pulsegrid.operators.forest import fit_forest
from pulsegrid.operators.metrics import classification_metrics
from pulsegrid.runtime import materialize
from pulsegrid.timeline import Running, Timeline, carry

MODELS = ("lda", "logistic", "forest", "tree", "svm")


def class_weights(train: DataFrame, label: str, balanced: bool) -> tuple[Column, int]:
    """Balanced weight n / (k * n_c) as an expression; the class counts are one small row per class."""
    counts = {r[0]: r[1] for r in train.groupBy(label).count().collect()}
    n, k = sum(counts.values()), len(counts)
    weight = F.lit(1.0)
    if balanced:
        for name, c in counts.items():
            weight = F.when(F.col(label) == name, F.lit(n / (k * c))).otherwise(weight)
    return weight, n


def label_index(label: str, labels: Sequence[str]) -> Column:
    expr = F.lit(None).cast("double")
    for i, name in enumerate(labels):
        expr = F.when(F.col(label) == name, F.lit(float(i))).otherwise(expr)
    return expr


def complete(features: Sequence[str]) -> Column:
    """Whether a row has every feature."""
    return F.forall(F.array(*[F.col(f).cast("double") for f in features]), lambda x: x.isNotNull() & ~F.isnan(x))


@dataclass
class SparkModel:
    """A fitted Spark ML pipeline and the class order of its outputs. Rows with a missing feature score NULL."""

    labels: list[str]
    pipeline: PipelineModel
    features: list[str]
    kind: str

    def score(self, rows: DataFrame, prefix: str = "prob_") -> DataFrame:
        """Add one probability column per class and ``predicted``; models without probabilities give 0 or 1."""
        out = self.pipeline.transform(rows)
        if "probability" in out.columns:
            p = vector_to_array("probability")
            probs = {f"{prefix}{l}": p[i] for i, l in enumerate(self.labels)}
        else:
            probs = {f"{prefix}{l}": (F.col("prediction") == i).cast("double") for i, l in enumerate(self.labels)}
        names = F.array(*[F.lit(l) for l in self.labels])
        whole = complete(self.features)
        probs = {name: F.when(whole, p) for name, p in probs.items()}
        out = out.withColumns({**probs, "predicted": F.when(whole, F.get(names, F.col("prediction").cast("int")))})
        return out.select(*rows.columns, *probs, "predicted")

    def score_shuffled(self, rows: DataFrame, features: Sequence[str]) -> DataFrame:
        """``predicted`` of every row of `permuted` with one of ``features``, numbered ``_at``, taken from ``_other``."""
        each = rows.withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1))))
        return self.score(each.withColumns({f: F.when(F.col("_at") == i, F.col("_other")[i]).otherwise(F.col(f)) for i, f in enumerate(features)}))

    def importances(self) -> dict[str, float]:
        return dict(zip(self.features, self.pipeline.stages[-1].featureImportances.toArray().tolist()))


@dataclass
class Discriminant:
    """Gaussian discriminant with a shared covariance: linear scores per class. Rows with a missing feature score NULL."""

    labels: list[str]
    weights: np.ndarray
    offsets: np.ndarray
    features: list[str]

    def score(self, rows: DataFrame, prefix: str = "prob_") -> DataFrame:
        raw = [sum((F.col(f) * float(w) for f, w in zip(self.features, ws)), F.lit(float(o))) for ws, o in zip(self.weights, self.offsets)]
        scored = rows.withColumns({f"_g{i}": e for i, e in enumerate(raw)})
        top = F.greatest(*[F.col(f"_g{i}") for i in range(len(raw))])
        scored = scored.withColumns({f"_e{i}": F.exp(F.col(f"_g{i}") - top) for i in range(len(raw))})
        total = sum((F.col(f"_e{i}") for i in range(len(raw))), F.lit(0.0))
        whole = complete(self.features)
        out = scored.withColumns({f"{prefix}{l}": F.when(whole, F.col(f"_e{i}") / total) for i, l in enumerate(self.labels)})
        out = out.withColumn("predicted", F.when(whole, argmax_label({l: f"_g{i}" for i, l in enumerate(self.labels)})))
        return out.drop(*[f"_{k}{i}" for i in range(len(raw)) for k in "ge"])

    def score_shuffled(self, rows: DataFrame, features: Sequence[str]) -> DataFrame:
        """As `SparkModel.score_shuffled`; the scores are linear, so only the term of the changed feature is made anew."""
        lacks = lambda x: x.isNull() | F.isnan(x)
        known = lambda x: F.when(lacks(x), 0.0).otherwise(x)
        values = {f: F.col(f).cast("double") for f in self.features}
        sums = {f"_s{k}": sum((known(values[f]) * float(w) for f, w in zip(self.features, ws)), F.lit(float(o))) for k, (ws, o) in enumerate(zip(self.weights, self.offsets))}
        change = F.zip_with(F.array(*[values[f] for f in features]), "_other", lambda x, y: F.struct(
            (known(y) - known(x)).alias("by"), (lacks(y).cast("int") - lacks(x).cast("int")).alias("lacking")))
        gone = sum((lacks(x).cast("int") for x in values.values()), F.lit(0))
        others = [c for c in rows.columns if c not in self.features and c != "_other"]
        each = rows.select(*others, *[e.alias(c) for c, e in sums.items()], gone.alias("_gone"), F.posexplode(change).alias("_at", "_change"))
        place = [self.features.index(f) for f in features]
        each = each.withColumns({f"_s{k}": F.col(f"_s{k}") + F.get(F.array(*[F.lit(float(ws[i])) for i in place]), F.col("_at")) * F.col("_change.by") for k, ws in enumerate(self.weights)})
        best = argmax_label({l: f"_s{k}" for k, l in enumerate(self.labels)})
        return each.select(*others, "_at", F.when(F.col("_gone") + F.col("_change.lacking") == 0, best).alias("predicted"))


def group_moments(rows: DataFrame, features: Sequence[str], label: str, labels: Sequence[str], key: str | None = None) -> dict[str, np.ndarray]:
    """Counts, sums and cross products of the features per group and class (classes, d + 1, d + 1), all groups in one job.

    Rows with a missing feature or label are left out. What reaches the driver is one upper triangle per group and class,
    for groups that the caller lists; any union of groups is fitted by adding them up, and left out by subtracting.
    """
    feats, d = list(features), len(features)
    group = F.col(key).cast("string") if key else F.lit("")
    used = rows.select(group.alias("_g"), label_index(label, labels).cast("int").alias("_y"), *[F.col(f).cast("double") for f in feats]).dropna()
    i, j = np.triu_indices(d + 1)

    def partial(batches):
        sums: dict[tuple[str, int], np.ndarray] = {}
        for pdf in batches:
            for k, g in pdf.groupby(["_g", "_y"]):
                x = np.column_stack([np.ones(len(g)), g[feats].to_numpy()])
                sums[k] = sums.get(k, 0) + x.T @ x
        for (g, y), m in sums.items():
            yield pd.DataFrame({"g": g, "y": int(y), "i": i, "j": j, "s": m[i, j]})

    cells = used.mapInPandas(partial, "g string, y int, i int, j int, s double").groupBy("g", "y", "i", "j").agg(F.sum("s").alias("s")).toPandas()
    out: dict[str, np.ndarray] = {}
    for g, part in cells.groupby("g"):
        gram = np.zeros((len(labels), d + 1, d + 1))
        gram[part["y"], part["i"], part["j"]] = part["s"]
        gram[part["y"], part["j"], part["i"]] = part["s"]
        out[g] = gram
    return out


def discriminant_of(gram: np.ndarray, labels: Sequence[str], features: Sequence[str]) -> Discriminant:
    """The discriminant of `group_moments`; the pooled covariance is divided by the number of rows.

    Where it has no inverse (constant or collinear features) the pseudo-inverse leaves such directions out. Classes
    without rows are unknown to the model.
    """
    present = [k for k in range(len(labels)) if gram[k, 0, 0] > 0]
    if not present:
        raise ValueError("no complete labelled row to fit on")
    n = sum(gram[k, 0, 0] for k in present)
    means = np.array([gram[k, 0, 1:] / gram[k, 0, 0] for k in present])
    within = sum(gram[k, 1:, 1:] - gram[k, 0, 0] * np.outer(m, m) for k, m in zip(present, means)) / n
    weights = means @ np.linalg.pinv(within, hermitian=True)
    prior = np.log([gram[k, 0, 0] / n for k in present])
    return Discriminant([labels[k] for k in present], weights, prior - 0.5 * np.einsum("kd,kd->k", weights, means), list(features))


def fit_discriminant(train: DataFrame, features: Sequence[str], label: str, labels: Sequence[str]) -> Discriminant:
    """Class means and pooled covariance from per-partition sums; only a d-by-d system is solved on the driver."""
    d = len(features)
    return discriminant_of(group_moments(train, features, label, labels).get("", np.zeros((len(labels), d + 1, d + 1))), labels, features)


def predict_groups(rows: DataFrame, models: Mapping[str, Discriminant], tests: Mapping[str, Sequence[str]], key: str, label: str) -> DataFrame:
    """``model, label, predicted`` of every row under each model that tests its group, in one pass over the rows.

    ``tests`` names the models per group. A row with a missing feature has no prediction.
    """
    feats = next(iter(models.values())).features
    used = rows.select(F.col(key).cast("string").alias("_g"), F.col(label).alias("label"), *[F.col(f).cast("double") for f in feats]).where(F.col("_g").isin(*tests))

    def run(batches):
        for pdf in batches:
            for g, part in pdf.groupby("_g"):
                x = part[list(feats)].to_numpy()
                whole = ~np.isnan(x).any(axis=1)
                for name in tests[g]:
                    m = models[name]
                    best = np.argmax(x @ m.weights.T + m.offsets, axis=1) if len(x) else np.zeros(0, dtype=int)
                    said = np.where(whole, np.array(m.labels, dtype=object)[best], None)
                    yield pd.DataFrame({"model": name, "label": part["label"].to_numpy(), "predicted": said})

    return used.mapInPandas(run, "model string, label string, predicted string")


def fit_model(kind: str, train: DataFrame, features: Sequence[str], label: str, labels: Sequence[str], balanced: bool = True, trees: int = 200, depth: int = 30, seed: int = 42):
    """Fit one model of the bank: lda, logistic, forest, tree or svm.

    Rows with a missing feature or label are left out of the fit for every kind. The linear models scale features to
    unit spread inside the fitted model; forests grow to ``depth`` (Spark's limit is 30).
    """
    train = train.where(complete(features) & F.col(label).isin(*labels))
    if kind == "lda":
        return fit_discriminant(train, features, label, labels)
    weight, n = class_weights(train, label, balanced)
    rows = train.withColumns({"_y": label_index(label, labels), "_w": weight})
    common = dict(featuresCol="_x", labelCol="_y", weightCol="_w")
    if kind == "logistic":
        est = LogisticRegression(**common, regParam=1.0 / n, standardization=True, maxIter=200)
    elif kind == "forest":
        named = train.sparkSession.createDataFrame([(i, l) for i, l in enumerate(labels)], f"i int, `{label}` string")
        per_class = [r["_w"] for r in named.select("i", weight.alias("_w")).orderBy("i").collect()]
        return fit_forest(rows, features, "_y", labels, per_class, trees, depth, seed)
    elif kind == "tree":
        est = DecisionTreeClassifier(**common, maxDepth=4, seed=seed)
    elif kind == "svm":
        svm = LinearSVC(regParam=1.0 / n, standardization=True, maxIter=40, tol=1e-4)
        est = OneVsRest(classifier=svm, **common)
    else:
        raise ValueError(f"unknown model {kind!r}")
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="keep"), est]).fit(rows)
    return SparkModel(list(labels), pipeline, list(features), kind)


def evaluate_by(scored: DataFrame, by: Sequence[str], label: str, labels: Sequence[str]) -> DataFrame:
    """Metrics of scored rows per group, and the number of rows that had no score."""
    missed = scored.groupBy(*by).agg(F.count_if(F.col("predicted").isNull()).alias("unscored"))
    return classification_metrics(scored.where("predicted IS NOT NULL"), list(by), label, "predicted", labels).join(missed, list(by))


def evaluate(scored: DataFrame, label: str, labels: Sequence[str], **tags: str) -> DataFrame:
    """One row of metrics for scored test rows, and the number of rows that had no score."""
    missed = scored.agg(F.count_if(F.col("predicted").isNull()).alias("unscored"), F.lit(1).alias("_all"))
    m = classification_metrics(scored.where("predicted IS NOT NULL").withColumn("_all", F.lit(1)), ["_all"], label, "predicted", labels)
    m = m.join(F.broadcast(missed), "_all").drop("_all")  # one row
    return m.select(*[F.lit(v).alias(k) for k, v in tags.items()], "*")


def model_bank(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, labels: Sequence[str], kinds: Sequence[str] = MODELS, trees: int = 200, **tags: str) -> DataFrame:
    """Fit every model and compare them on the test rows."""
    out = None
    for kind in kinds:
        m = fit_model(kind, train, features, label, labels, trees=trees)
        row = evaluate(m.score(test), label, labels, model_name=kind, **tags)
        out = row if out is None else out.unionByName(row)
    return out


def out_of_fold(rows: DataFrame, features: Sequence[str], label: str, labels: Sequence[str], folds: Sequence, kind: str = "logistic", fold: str = "fold", trees: int = 200) -> DataFrame:
    """One prediction per row from the model that did not see its fold."""
    out = None
    for k in folds:
        m = fit_model(kind, rows.filter(F.col(fold) != k), features, label, labels, trees=trees)
        part = m.score(rows.filter(F.col(fold) == k))
        out = part if out is None else out.unionByName(part)
    return out


def permuted(rows: DataFrame, columns: Sequence[str], repeats: int, seed: int = 42) -> DataFrame:
    """Every row once per ``_repeat`` (1 to ``repeats``), with ``_other``: the ``columns`` of a row dealt to it at random.

    Each repeat deals every row out once. The rows are numbered by random orders without a global sort in one task, and
    only their numbers are copied per repeat; equal rows may stand for each other.
    """
    rows = materialize(rows.withColumn("_row", F.md5(F.to_json(F.struct(*rows.columns)))))

    def numbered(df: DataFrame, out: str) -> DataFrame:
        place = F.conv(F.substring(F.md5(F.concat_ws("|", "_row", F.lit(seed), "_repeat")), 1, 8), 16, 10).cast("bigint")
        placed = df.withColumn("_place", place)
        return carry(placed, Timeline(("_repeat",), "_place", 1 << 22), order=("_row",), **{out: Running("sum", F.lit(1))}).drop("_place")

    left = materialize(numbered(rows.withColumn("_repeat", F.lit(0)), "_n").drop("_repeat"))
    dealt = numbered(left.select("_row", "_n", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("_repeat")), "_to").drop("_row")
    values = left.select("_n", F.array(*[F.col(c).cast("double") for c in columns]).alias("_other"))
    right = dealt.join(values, "_n").select(F.col("_to").alias("_n"), "_repeat", "_other")
    return left.join(right, "_n").drop("_n", "_row")


def permute_column(rows: DataFrame, column: str, seed: int = 42) -> DataFrame:
    """Shuffle one numeric column among the rows."""
    return permuted(rows, [column], 1, seed).withColumn(column, F.col("_other")[0]).select(*rows.columns)


def permutation_importance(model, test: DataFrame, features: Sequence[str], label: str, labels: Sequence[str], repeats: int = 10, seed: int = 42) -> DataFrame:
    """Loss of macro F1 when one feature is shuffled: mean and spread over ``repeats`` shuffles, one row per feature.

    All features and repeats are scored and counted in one job. The features of one repeat share its order of rows.
    """
    base = evaluate(model.score(test), label, labels).select(F.col("macro_f1").alias("_base"), F.lit(1).alias("_one"))
    scored = model.score_shuffled(permuted(test, features, repeats, seed), features)
    m = classification_metrics(scored.where("predicted IS NOT NULL"), ["_at", "_repeat"], label, "predicted", labels)
    names = F.array(*[F.lit(f) for f in features])
    # one row of base metrics, so broadcasting it is bounded
    loss = m.withColumn("_one", F.lit(1)).join(F.broadcast(base), "_one").select(F.get(names, F.col("_at")).alias("feature"), (F.col("_base") - F.col("macro_f1")).alias("_loss"))
    return loss.groupBy("feature").agg(F.avg("_loss").alias("importance"), F.stddev_pop("_loss").alias("importance_std"), F.count("_loss").alias("repeats"))
