"""A random forest whose trees never meet on the driver or in one task.

Features are binned once. Every tree draws its rows by a hash of the row's number (Poisson, as bagging does). Nodes of more
than ``BLOCK`` rows are split level by level from histograms that Spark adds up; what is left of a tree below them, at most
``BLOCK`` rows a node, is brought together by (tree, node) and grown in one task. The grown parts are a table in the shared
folder; scoring brings rows and parts together by the same key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.runtime import materialize

BINS = 32
BLOCK = 1 << 17  # rows of a tree (or rows to score) that one task holds at once, a byte a feature
CELLS = 1 << 21  # histogram cells held at once
POISSON = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040)])
PARTS = "tree int, leaf int, depth int, feature binary, cut binary, left binary, share binary, importance array<double>"


def draws(rows: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree draws each row."""
    with np.errstate(over="ignore"):
        z = rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(tree + 1) * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return np.searchsorted(POISSON, (z >> np.uint64(11)) / float(1 << 53), side="right").astype(np.uint8)


def route(codes: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The leaf of every row; a leaf has feature -1, the right child follows the left one."""
    node, going = np.zeros(len(codes), dtype=np.int64), np.arange(len(codes))
    while len(going):
        at = node[going]
        inner = feature[at] >= 0
        going, at = going[inner], at[inner]
        node[going] = left[at] + (codes[going, feature[at]] > cut[at])
    return node


def best_splits(hist: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gini gain times weight, place of the feature and cut of the best split per node of ``hist`` (node, feature, bin, class)."""
    below = np.cumsum(hist, axis=2)
    total = below[:, :1, -1:, :]
    below, above = below[:, :, :-1], total - below[:, :, :-1]
    a, b = below.sum(3), above.sum(3)
    ok = (a > 1e-9) & (b > 1e-9)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where(ok, (below**2).sum(3) / a + (above**2).sum(3) / b, -np.inf).reshape(len(hist), -1)
        best = score.argmax(1)
        whole = total[:, 0, 0]
        gain = score[np.arange(len(hist)), best] - (whole**2).sum(1) / whole.sum(1)
    return np.where(np.isfinite(gain) & (gain > 1e-9 * whole.sum(1)), gain, 0.0), best // (BINS - 1), best % (BINS - 1)


def _tried(seed: int, tree: int, node: int, n: int, d: int) -> np.ndarray:
    """The features that ``n`` nodes try: the square root of ``d`` each, at random."""
    k = int(np.ceil(np.sqrt(d)))
    return np.argpartition(np.random.default_rng([seed, tree, node, n]).random((n, d)), k - 1, axis=1)[:, :k] if k < d else np.tile(np.arange(d), (n, 1))


def grow(codes: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, depth: int, seed: int, tree: int, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One part of a tree, level by level over all its nodes: feature, cut, left child and class shares per node, and gains per feature."""
    d = codes.shape[1]
    feature, cut, left, share = [], [], [], []
    gains, made = np.zeros(d), 1
    order, node, nodes = np.arange(len(y)), np.zeros(len(y), dtype=np.int64), 1
    for level in range(depth + 1):
        totals = np.bincount(node * classes + y[order], w[order], nodes * classes).reshape(nodes, classes)
        f, c, l = np.full(nodes, -1, dtype=np.int16), np.zeros(nodes, dtype=np.uint8), np.zeros(nodes, dtype=np.int32)
        share.append(totals / totals.sum(1, keepdims=True))
        mixed = np.flatnonzero((totals > 0).sum(1) > 1) if level < depth else np.zeros(0, dtype=np.int64)
        tried = _tried(seed, tree, leaf * 64 + level, len(mixed), d)
        ends = np.searchsorted(node, np.arange(nodes + 1))
        step = max(1, CELLS // (tried.shape[1] * BINS * classes)) if len(mixed) else 1
        for at in range(0, len(mixed), step):
            some, cols = mixed[at : at + step], tried[at : at + step]
            sizes = ends[some + 1] - ends[some]
            own = np.repeat(np.arange(len(some)), sizes)
            rows = order[np.repeat(ends[some] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(own))]
            hist = np.zeros(len(some) * cols.shape[1] * BINS * classes)
            for j in range(cols.shape[1]):
                cell = ((own * cols.shape[1] + j) * BINS + codes[rows, cols[own, j]]) * classes + y[rows]
                hist += np.bincount(cell, w[rows], len(hist))
            gain, place, at_bin = best_splits(hist.reshape(len(some), cols.shape[1], BINS, classes))
            split = gain > 0
            f[some[split]], c[some[split]] = cols[split, place[split]], at_bin[split]
            np.add.at(gains, f[some[split]], gain[split])
        inner = f >= 0
        l[inner] = made + 2 * np.arange(inner.sum())
        feature.append(f), cut.append(c), left.append(l)
        if not inner.any():
            break
        keep = inner[node]
        order, node = order[keep], node[keep]
        child = (l[node] - made) + (codes[order, f[node]] > c[node])
        by = np.argsort(child, kind="stable")
        order, node, nodes = order[by], child[by], 2 * int(inner.sum())
        made += nodes
    return *(np.concatenate(x) for x in (feature, cut, left, share)), gains


@dataclass
class Top:
    """The split nodes of a tree that held more than a block of rows."""

    feature: list[int]
    cut: list[int]
    left: list[int]
    depth: list[int]

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        return route(codes, np.array(self.feature), np.array(self.cut), np.array(self.left))


def _coded(rows: DataFrame, features: Sequence[str], edges: np.ndarray, others: Sequence[str]) -> DataFrame:
    """``others`` and the bins of the features, a byte each."""
    feats = list(features)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[feats].to_numpy(dtype=float)
            codes = np.column_stack([np.searchsorted(edges[i], x[:, i], side="left") for i in range(len(feats))]).astype(np.uint8)
            yield pdf[list(others)].assign(codes=[r.tobytes() for r in codes])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others)
    return rows.select(*others, *[F.col(f).cast("double") for f in feats]).mapInPandas(run, f"{kinds}, codes binary")


def _matrix(blobs: Sequence[bytes], d: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype=np.uint8).reshape(-1, d)


def _split_large(coded: DataFrame, tops: list[Top], large: set[tuple[int, int]], d: int, weights: np.ndarray, seed: int) -> list:
    """Best split of every large node, from histograms added up by Spark: one small row a node."""
    k = len(weights)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for pdf in batches:
            codes, y, ids = _matrix(pdf["codes"], d), pdf["y"].to_numpy(), pdf["_row"].to_numpy()
            for t in {t for t, _ in large}:
                n, leaf = draws(ids, t, seed), tops[t].leaves(codes)
                for node in {b for a, b in large if a == t}:
                    own = np.flatnonzero((leaf == node) & (n > 0))
                    cols = _tried(seed, t, -node % (1 << 31), 1, d)[0]
                    cell = (np.arange(len(cols))[None, :] * BINS + codes[own][:, cols]) * k + y[own][:, None]
                    size = len(cols) * BINS * k
                    w = np.repeat(n[own] * weights[y[own]], len(cols))
                    h = np.stack([np.bincount(cell.ravel(), w, size), np.bincount(cell.ravel(), None, size)])
                    sums[t, node] = sums.get((t, node), 0) + h
        for (t, node), h in sums.items():
            yield pd.DataFrame({"tree": [t], "node": [node], "h": [h.tobytes()]})

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        t, node = int(pdf["tree"].iloc[0]), int(pdf["node"].iloc[0])
        h = sum(np.frombuffer(b) for b in pdf["h"]).reshape(2, -1, BINS, k)
        gain, place, cut = best_splits(h[:1])
        rows = h[1, place[0]].sum(1)
        below = rows[: cut[0] + 1].sum()
        total = h[0, 0].sum(0)
        return pd.DataFrame({"tree": [t], "node": [node], "feature": [int(_tried(seed, t, -node % (1 << 31), 1, d)[0][place[0]])], "cut": [int(cut[0])], "gain": [float(gain[0])],
                             "below": [int(below)], "above": [int(rows.sum() - below)], "share": [(total / total.sum()).tolist()]})

    hist = coded.mapInPandas(partial, "tree int, node int, h binary")
    return hist.groupBy("tree", "node").applyInPandas(decide, "tree int, node int, feature int, cut int, gain double, below bigint, above bigint, share array<double>").collect()


@dataclass
class Forest:
    """A fitted forest; ``parts`` is the table of grown trees. Rows with a missing feature score NULL."""

    labels: list[str]
    features: list[str]
    edges: np.ndarray
    tops: list[Top]
    parts: DataFrame
    gains: DataFrame
    kind: str = "forest"

    def score(self, rows: DataFrame, prefix: str = "prob_") -> DataFrame:
        """Add one probability column per class, the mean over the trees, and ``predicted``."""
        d, k, tops, names = len(self.features), len(self.labels), self.tops, [f"_p{i}" for i in range(len(self.labels))]
        whole = F.forall(F.array(*[F.col(f).cast("double") for f in self.features]), lambda x: x.isNotNull() & ~F.isnan(x))
        fixed = materialize(rows.withColumn("_row", F.monotonically_increasing_id()))
        coded = materialize(_coded(fixed.where(whole), self.features, self.edges, ["_row"]))
        cuts = max(1, -(-coded.count() // BLOCK))

        def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                codes, ids = _matrix(pdf["codes"], d), pdf["_row"].to_numpy()
                part = (ids * 2654435761 >> 16) % cuts
                for t, top in enumerate(tops):
                    place = top.leaves(codes) * cuts + part
                    for p in np.unique(place):
                        own = place == p
                        yield pd.DataFrame({"tree": [t], "leaf": [int(p // cuts)], "part": [int(p % cuts)], "ids": [ids[own].tobytes()], "codes": [codes[own].tobytes()]})

        def look_up(key, some: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
            if some.empty or tree.empty:
                return pd.DataFrame({n: [] for n in ("_row", *names)})
            g = tree.iloc[0]
            leaf = route(_matrix(some["codes"], d), np.frombuffer(g["feature"], np.int16), np.frombuffer(g["cut"], np.uint8), np.frombuffer(g["left"], np.int32))
            share = np.frombuffer(g["share"]).reshape(-1, k)[leaf]
            return pd.DataFrame({"_row": np.frombuffer(b"".join(some["ids"]), np.int64), **{n: share[:, i] for i, n in enumerate(names)}})

        each = coded.mapInPandas(deal, "tree int, leaf int, part int, ids binary, codes binary")
        parts = self.parts.select("tree", "leaf", "feature", "cut", "left", "share", F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))).alias("part"))
        by = ["tree", "leaf", "part"]
        votes = each.groupBy(*by).cogroup(parts.groupBy(*by)).applyInPandas(look_up, "_row bigint, " + ", ".join(f"{n} double" for n in names))
        mean = votes.groupBy("_row").agg(*[(F.sum(n) / len(tops)).alias(n) for n in names])
        joined = fixed.join(mean, "_row", "left")
        best = F.greatest(*names) if k > 1 else F.col(names[0])
        predicted = F.lit(None).cast("string")
        for n, label in reversed(list(zip(names, self.labels))):
            predicted = F.when(F.col(n) == best, label).otherwise(predicted)
        return joined.select(*rows.columns, *[F.col(n).alias(f"{prefix}{label}") for n, label in zip(names, self.labels)], predicted.alias("predicted"))

    def score_shuffled(self, rows: DataFrame, features: Sequence[str]) -> DataFrame:
        """As `learn.SparkModel.score_shuffled`."""
        each = rows.withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1))))
        return self.score(each.withColumns({f: F.when(F.col("_at") == i, F.col("_other")[i]).otherwise(F.col(f)) for i, f in enumerate(features)}))

    def importances(self) -> dict[str, float]:
        """Gain of each feature as a share of its tree's, averaged over the trees."""
        each = self.gains.select("tree", F.posexplode("importance").alias("i", "g")).groupBy("tree", "i").agg(F.sum("g").alias("g"))
        total = each.groupBy("tree").agg(F.sum("g").alias("all")).where("all > 0")
        found = {r["i"]: r["v"] for r in each.join(total, "tree").groupBy("i").agg(F.sum(F.col("g") / F.col("all")).alias("v")).collect()}  # one row a feature
        s = sum(found.values()) or 1.0
        return {f: found.get(i, 0.0) / s for i, f in enumerate(self.features)}


def fit_forest(train: DataFrame, features: Sequence[str], y: str, labels: Sequence[str], weights: Sequence[float], trees: int, depth: int, seed: int) -> Forest:
    """``trees`` trees to ``depth`` over every row of ``train``; ``y`` is the class number, ``weights`` one number a class."""
    spark, feats, d, k = train.sparkSession, list(features), len(features), len(labels)
    weights = np.asarray(weights, dtype=float)
    probs = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    rows = materialize(train.select(F.col(y).cast("int").alias("y"), F.monotonically_increasing_id().alias("_row"), *[F.col(f).cast("double").alias(f) for f in feats]))
    long = rows.select(F.posexplode(F.array(*feats)).alias("i", "x"))
    found = long.groupBy("i").agg(F.percentile_approx("x", probs, 1000).alias("q")).collect()  # one row a feature
    edges = np.array([r["q"] for r in sorted(found, key=lambda r: r["i"])])
    coded = materialize(_coded(rows, feats, edges, ["y", "_row"]))
    tops = [Top([-1], [0], [0], [0]) for _ in range(trees)]
    gains, done = np.zeros((trees, d)), []
    large = {(t, 0) for t in range(trees)} if coded.count() > BLOCK else set()
    while large:
        after = set()
        for r in _split_large(coded, tops, large, d, weights, seed):
            t, node, top = r["tree"], r["node"], tops[r["tree"]]
            if r["gain"] <= 0 or top.depth[node] >= depth:
                done.append((t, node, r["share"]))
                continue
            gains[t, r["feature"]] += r["gain"]
            top.feature[node], top.cut[node], top.left[node] = r["feature"], r["cut"], len(top.feature)
            for size in (r["below"], r["above"]):
                if size > BLOCK:
                    after.add((t, len(top.feature)))
                top.feature.append(-1), top.cut.append(0), top.left.append(0), top.depth.append(top.depth[node] + 1)
        large = after
    closed = {(t, node) for t, node, _ in done}

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            codes, ys, ids = _matrix(pdf["codes"], d), pdf["y"].to_numpy().astype(np.uint8), pdf["_row"].to_numpy()
            for t, top in enumerate(tops):
                n, leaf = draws(ids, t, seed), top.leaves(codes)
                for node in np.unique(leaf):
                    own = (leaf == node) & (n > 0)
                    if own.any() and (t, int(node)) not in closed:
                        yield pd.DataFrame({"tree": [t], "leaf": [int(node)], "codes": [codes[own].tobytes()], "y": [ys[own].tobytes()], "n": [n[own].tobytes()]})

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        t, leaf = int(pdf["tree"].iloc[0]), int(pdf["leaf"].iloc[0])
        ys = np.frombuffer(b"".join(pdf["y"]), np.uint8).astype(np.int64)
        w = np.frombuffer(b"".join(pdf["n"]), np.uint8) * weights[ys]
        at = tops[t].depth[leaf]
        f, c, l, share, gain = grow(_matrix(pdf["codes"], d), ys, w, k, depth - at, seed, t, leaf)
        return pd.DataFrame({"tree": [t], "leaf": [leaf], "depth": [at], "feature": [f.tobytes()], "cut": [c.tobytes()], "left": [l.tobytes()], "share": [share.tobytes()], "importance": [gain.tolist()]})

    each = coded.mapInPandas(deal, "tree int, leaf int, codes binary, y binary, n binary")
    n = max(trees, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = materialize(each.repartition(n, "tree", "leaf").groupBy("tree", "leaf").applyInPandas(finish, PARTS))
    if done:
        leaf = (np.array([-1], np.int16).tobytes(), np.zeros(1, np.uint8).tobytes(), np.zeros(1, np.int32).tobytes())
        parts = parts.unionByName(spark.createDataFrame([(t, node, tops[t].depth[node], *map(bytearray, leaf), bytearray(np.array(s).tobytes()), [0.0] * d) for t, node, s in done], PARTS))
    above = spark.createDataFrame([(t, g.tolist()) for t, g in enumerate(gains)], "tree int, importance array<double>")  # one row a tree
    return Forest(list(labels), feats, edges, tops, parts, parts.select("tree", "importance").unionByName(above))
