"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has its own mean and covariance; the covariances are shrunk towards the diagonal of the pooled one. All
that is needed from the labelled rows are counts, sums and cross products, which Spark adds up over every labelled
row. The score is the logistic of the difference of the two Mahalanobis log densities (plus the log prior ratio),
taken with inverse Cholesky factors that are computed once and shipped with the scoring function.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.tables import in_steps

BYTE = np.arange(256)
CLASSES = {
    "upper": (BYTE >= 65) & (BYTE <= 90),
    "lower": (BYTE >= 97) & (BYTE <= 122),
    "digit": (BYTE >= 48) & (BYTE <= 57),
    "space": BYTE == 32,
    "line": BYTE == 10,
    "stop": np.isin(BYTE, [ord(c) for c in ".,;:?'\"-()"]),
    "symbol": (BYTE > 32) & (BYTE < 127) & ~np.isin(BYTE | 32, np.arange(97, 123)) & ~np.isin(BYTE, [ord(c) for c in ".,;:?'\"-()0123456789"]),
    "control": (BYTE < 32) & ~np.isin(BYTE, [9, 10, 13]) | (BYTE == 127),
    "tail": (BYTE >= 128) & (BYTE < 192),
    "lead": BYTE >= 192,
}
# characters added to the length before shares are taken: a few signs in a short text say little
PRIOR = 40
FEATURES = ("log_chars", "upper", "digit", "space", "stop", "symbol", "control", "word_length", "line_length", "new_words", "new_lines", "long_words")


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of transformed statistics per text; null counts as empty, and an empty text gives finite numbers."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    if not n:
        return np.zeros((0, len(FEATURES)))
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    count = {}
    for name, table in CLASSES.items():
        places = np.flatnonzero(table[data])
        count[name] = np.diff(np.searchsorted(places, at)).astype(float)
    chars = np.diff(at) - count["tail"]
    safe = np.maximum(chars, 1)
    words, fresh_words, fresh_lines, long_words = np.ones(n), np.ones(n), np.ones(n), np.zeros(n)
    for i, text in enumerate(texts.to_pylist()):
        found = text.split()
        if found:
            words[i] = len(found)
            fresh_words[i] = len(set(found))
            long_words[i] = sum(len(w) > 20 for w in found)
            lines = text.split("\n")
            fresh_lines[i] = len(set(lines)) / len(lines)
    share = {k: np.sqrt(v / (safe + PRIOR)) for k, v in count.items()}
    return np.column_stack([
        np.log1p(chars), share["upper"], share["digit"], share["space"], share["stop"], share["symbol"], share["control"],
        np.log(np.maximum(chars - count["space"] - count["line"], 1) / words), np.log1p(chars / (count["line"] + 1)),
        np.log(fresh_words) / np.maximum(np.log(words), 1), fresh_lines, np.sqrt(long_words / words),
    ])


@dataclass(frozen=True)
class Quadratic:
    """Means, inverse Cholesky factors and log terms of the two classes."""

    means: np.ndarray
    whiten: np.ndarray
    constants: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, priors included."""
        z = [(x - self.means[k]) @ self.whiten[k].T for k in (0, 1)]
        return self.constants[1] - self.constants[0] - 0.5 * ((z[1] ** 2).sum(1) - (z[0] ** 2).sum(1))


def from_moments(counts: np.ndarray, sums: np.ndarray, products: np.ndarray, shrinkage: float = 0.05, floor: float = 1e-4) -> Quadratic:
    """Fit from counts (2), sums (2, d) and cross products (2, d, d) of the classes.

    Where a class has fewer than two rows there is no covariance: the model then says the (smoothed) prior of the labels
    for every text, which is 0.5 without any label.
    """
    if (counts < 2).any():
        odds = np.log(counts + 1)
        return Quadratic(np.zeros_like(sums), np.zeros_like(products), odds)
    means = sums / counts[:, None]
    cov = products / counts[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = (cov * counts[:, None, None]).sum(0) / counts.sum()
    target = np.diag(np.maximum(np.diag(pooled), floor))
    whiten, constants = [], []
    for k in (0, 1):
        factor = np.linalg.cholesky((1 - shrinkage) * cov[k] + shrinkage * target)
        whiten.append(np.linalg.inv(factor))
        constants.append(np.log(counts[k] / counts.sum()) - np.log(np.diag(factor)).sum())
    return Quadratic(means, np.array(whiten), np.array(constants))


def add_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the statistics as one array column ``x``, one row per row of ``df``, repeated rows too.

    Texts go through Python a few megabytes at a time, a longer one by itself; null counts as empty, an empty table gives
    an empty one, and only the two named columns are looked at.
    """
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_steps(batches, 1):
            x = statistics(batch.column(1))
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(FEATURES)), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), rows], names=[id_col, "x"])

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind.simpleString()}, x array<double>")


def fit(rows: DataFrame, label: str | Column = "label", shrinkage: float = 0.05) -> Quadratic:
    """Fit on rows with ``x`` and a 0/1 label; rows without a label are left out. Only moments reach the driver.

    A repeated row counts as often as it occurs; with no rows, or one class only, see `from_moments`.
    """
    d = len(FEATURES)
    label = F.col(label) if isinstance(label, str) else label

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(total.shape[1]), 2), pa.int32()), pa.array(np.repeat([0, 1], total.shape[1]), pa.int32()),
                                          pa.array(total.ravel())], names=["cell", "label", "v"])

    used = rows.select("x", label.cast("int").alias("y")).where(F.col("y").isin(0, 1))
    sums = used.mapInArrow(partial, "cell int, label int, v double").groupBy("label", "cell").agg(F.sum("v").alias("v"))
    total = np.zeros((2, 1 + d + d * d))
    for r in sums.collect():  # 2 * (1 + d + d*d) numbers
        total[r["label"], r["cell"]] = r["v"]
    return from_moments(total[:, 0], total[:, 1 : 1 + d], total[:, 1 + d :].reshape(2, d, d), shrinkage)


def score(df: DataFrame, model: Quadratic, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``score`` in [0, 1] and ``predicted`` of every row, null and empty texts included."""
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_steps(batches, 1):
            s = 1 / (1 + np.exp(-np.clip(model.log_odds(statistics(batch.column(1))), -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind.simpleString()}, score double, predicted int")


def score_rows(rows: DataFrame, model: Quadratic, threshold: float = 0.5, id_col: str = "doc_id") -> DataFrame:
    """The same from rows that already carry their statistics ``x``; one result per row, none for an empty table."""
    kind = rows.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            s = 1 / (1 + np.exp(-np.clip(model.log_odds(x), -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    return rows.select(id_col, "x").mapInArrow(run, f"{id_col} {kind.simpleString()}, score double, predicted int")
