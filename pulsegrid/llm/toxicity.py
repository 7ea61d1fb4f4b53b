"""Toxicity by a weighted lexicon: folded text, Aho-Corasick matches, exception phrases, normalised by length.

Folding makes disguised spellings equal: compatibility forms, look-alike letters of other scripts, and digits or
signs inside a word that stand for letters. The lexicon holds word beginnings and whole words with weights; a word
counts with its strongest match, unless it stands in an exception phrase. The score is a logistic function of the
summed weights, plain and per word.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.tables import in_steps
from pulsegrid.runtime import materialize

# fixed values: letters of other scripts that look like Latin ones (small ones, then capitals), and signs that stand for letters
LOOKALIKE = str.maketrans("аеорсухіјѕԁӏνοαρτικβ" "АВЕЅІЈКМНОРСТУХΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdlvoaptikb" "ABESIJKMHOPCTYXABEZHIKMNOPTYX")
STAND_IN = str.maketrans("0134578@$!|+", "oieastbasiit")
JOINED = re.compile(r"(?<![^\W_])[^\W\d_](?:[*_.\-][^\W\d_]){2,}(?![^\W_])")
WORD = re.compile(r"[^\W_]+")
SPELLED = re.compile(r"(?=\S*[^\W\d_])[\w@$!|+]*[\w@$][\w@$!|+]*")
PREFIXES = range(3, 11)
LEAST_TOXIC, LEAST_WEIGHT = 3, 2.2


def fold(text: str | None) -> str:
    """Lower case, composed, look-alikes as Latin; inside words with a letter, digits and signs as letters.

    Single letters with signs between them (``w.o.r.d``) become one word.
    """
    text = unicodedata.normalize("NFKC", text or "").translate(LOOKALIKE).lower().translate(LOOKALIKE)
    text = JOINED.sub(lambda m: re.sub(r"[*_.\-]", "", m[0]), text) if re.search(r"[*_.\-]", text) else text
    return SPELLED.sub(_spell, text) if re.search(r"[0134578@$!|+]", text) else text


def _spell(found: re.Match) -> str:
    word = found[0]
    core = word.rstrip("!|+")  # closing signs are punctuation
    if core.isalpha() or len(core) < 3 or not core[0].isalpha() and sum(c.isalpha() for c in core) < 2:
        return word
    return core.translate(STAND_IN) + word[len(core):]


def terms(word: str) -> Iterator[str]:
    """The lexicon keys a word can match: beginnings of 3 to 10 letters, and the whole word with its end marked."""
    for n in PREFIXES:
        if n > len(word):
            break
        yield " " + word[:n]
    yield f" {word} "


def measures(found: list[tuple[str, float, str, str]], n_words: int) -> tuple[float, float]:
    """Summed weights, plain and per hundred words; the repeats of a word count by their logarithm."""
    times = Counter((h[0], h[1]) for h in found)
    total = sum(w * (1 + np.log(c)) for (_, w), c in times.items())
    return np.log1p(total), np.log1p(100 * total / (n_words + 20))


@dataclass
class Lexicon:
    """``weights`` by key (a leading blank, a trailing blank for whole words), two-word ``exceptions``, logistic ``coef``."""

    weights: dict[str, float]
    exceptions: frozenset[tuple[str, str]] = frozenset()
    coef: Sequence[float] = (-3.0, 1.0, 1.0)
    _machine: object = field(default=None, repr=False)

    def machine(self):
        if self._machine is None:
            self._machine = ahocorasick.Automaton()
            for key, w in self.weights.items():
                self._machine.add_word(key, (len(key), w))
            if self.weights:
                self._machine.make_automaton()
        return self._machine

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "coef": self.coef, "_machine": None}

    def hits(self, text: str | None) -> tuple[list[tuple[str, float, str, str]], int]:
        """(word, weight, word before, word after) of every counted word of a text, and its number of words."""
        words = WORD.findall(fold(text))
        if not words or not self.weights:
            return [], len(words)
        line = " " + " ".join(words) + " "
        best: dict[int, float] = {}
        for end, (n, w) in self.machine().iter(line):
            start = end - n + 1
            best[start] = max(w, best.get(start, 0.0))
        if not best:
            return [], len(words)
        starts = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
        out = []
        for i in np.searchsorted(starts, sorted(best)):
            before, after = words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else ""
            if (before, words[i]) not in self.exceptions and (words[i], after) not in self.exceptions:
                out.append((words[i], best[int(starts[i])], before, after))
        return out, len(words)

    def features(self, text: str | None) -> tuple[float, float]:
        return measures(*self.hits(text))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.coef[0] + x @ np.asarray(self.coef[1:]), -500, 500)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> list[float]:
    """Ridge logistic regression by Newton steps, intercept first and not penalised."""
    a = np.column_stack([np.ones(len(x)), x])
    b, pen = np.zeros(a.shape[1]), np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + pen, a.T @ (y - p) - pen @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b.tolist()


def _weight(neg: Column, pos: Column, clean: int, toxic: int) -> Column:
    """Log odds of a key less one standard error, as in `choose_weights`."""
    return F.log((pos + 0.5) / (toxic + 1)) - F.log((neg + 0.5) / (clean + 1)) - F.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))


def choose_weights(counts: dict[str, tuple[int, int]], clean: int, toxic: int, least: int = LEAST_TOXIC) -> dict[str, float]:
    """Keys whose log odds, less one standard error, reach `LEAST_WEIGHT`.

    A key goes if a longer one stands for nearly all of its toxic documents (``moron`` rather than ``mor``), and else
    a longer key goes if it says no more than a shorter one that stays.
    """
    out = {}
    for key, (neg, pos) in counts.items():
        if pos < least or pos <= neg:
            continue
        w = np.log((pos + 0.5) / (toxic + 1)) - np.log((neg + 0.5) / (clean + 1)) - np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
        if w >= LEAST_WEIGHT:
            out[key] = float(w)
    for key in sorted(out, key=len, reverse=True):
        for n in range(4, len(key) if key in out else 0):
            short = key[:n]
            if short in out and counts[key][1] >= 0.9 * counts[short][1] and out[key] >= out[short] - 0.3:
                del out[short]
    return {k: w for k, w in out.items() if not any(out.get(k[:n], 0) >= w for n in range(4, len(k)))}


def fit(docs: DataFrame, labels: DataFrame, label: str = "label", id_col: str = "doc_id", text_col: str = "text", max_rows: int = 8000) -> Lexicon:
    """Learn lexicon, exceptions and logistic from at most ``max_rows`` labelled ids of each label (lowest hashes).

    The sample bounds the lexicon: every key that reaches the weight is taken. Ids without a label, or without a
    document, are left out; repeated labels count once, repeated documents as often as they occur; null texts are empty
    and texts of any length are read whole; other columns are not looked at. Without rows of both labels the lexicon is
    empty and the score constant.
    """
    known = labels.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1)).distinct()
    lowest = known.where(F.col("label") == 0).orderBy("h").limit(max_rows).union(known.where(F.col("label") == 1).orderBy("h").limit(max_rows))
    # at most 2 * max_rows ids are sent to every task, and only their texts are written
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = materialize(texts.join(F.broadcast(materialize(lowest)), "id").select("label", "text"))
    size = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(size) != {0, 1}:
        return Lexicon({}, coef=(5.0 if 1 in size else -5.0, 0.0, 0.0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in in_steps(batches, 1):
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tally[k].update({t for w in set(WORD.findall(fold(text))) for t in terms(w)})
        for k in (0, 1):
            keys = list(tally[k])
            for i in range(0, len(keys), 20_000):
                part = keys[i : i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([0 if k else tally[k][t] for t in part], pa.int64()),
                                                  pa.array([tally[k][t] if k else 0 for t in part], pa.int64())], names=["key", "neg", "pos"])

    counted = (
        sample.mapInArrow(count, "key string, neg bigint, pos bigint").groupBy("key").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
        .where((F.col("pos") >= LEAST_TOXIC) & (F.col("pos") > F.col("neg")))
        .where(_weight(F.col("neg"), F.col("pos"), size[0], size[1]) >= LEAST_WEIGHT - 1e-9)
    )
    lexicon = Lexicon(choose_weights({r["key"]: (r["neg"], r["pos"]) for r in counted.collect()}, size[0], size[1]))

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_steps(batches, 1):
            rows = [(k, *lexicon.features(t), [p for w, _, b, a in lexicon.hits(t)[0] for p in (f"{b} {w}" if b else "", f"{w} {a}" if a else "") if p])
                    for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([sorted(set(r[3])) for r in rows], pa.list_(pa.string()))], names=["label", "phrases"])

    pairs = sample.mapInArrow(phrases, "label int, phrases array<string>").select("label", F.explode("phrases").alias("phrase"))
    benign = (
        pairs.groupBy("phrase").agg(F.sum(1 - F.col("label")).alias("neg"), F.sum("label").alias("pos"))
        .where((F.col("neg") >= 3) & (F.col("neg") > 9 * F.col("pos")))
    )
    lexicon = Lexicon(lexicon.weights, frozenset(tuple(r["phrase"].split(" ")) for r in benign.collect()))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_steps(batches, 1):
            x = np.array([lexicon.features(t) for t in batch.column(1).to_pylist()]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["label", "a", "b"])

    got = sample.mapInArrow(measure, "label int, a double, b double").toPandas()  # two numbers for each of 2 * max_rows rows at most
    coef = _logistic(got[["a", "b"]].to_numpy(), got["label"].to_numpy(dtype=float))
    # the sample may hold another share of label 1 than all labelled ids: shift the intercept to theirs
    n = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    coef[0] += float(np.log(n[1] / n[0]) - np.log(size[1] / size[0]))
    return Lexicon(lexicon.weights, lexicon.exceptions, coef)


def score(df: DataFrame, lexicon: Lexicon, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``score``, ``predicted``, ``n_hits`` and matched ``words`` of every row; null and empty texts score too.

    One result per row, repeated rows too, none for an empty table; texts are scored whole, a few megabytes at a time.
    """
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_steps(batches, 1):
            x, words, n_hits = [], [], []
            for text in batch.column(1).to_pylist():
                found, n = lexicon.hits(text)
                x.append(measures(found, n))
                n_hits.append(len(found))
                words.append(sorted({h[0] for h in found}))
            s = lexicon.score(np.array(x).reshape(-1, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(n_hits, pa.int32()),
                                              pa.array(words, pa.list_(pa.string()))], names=[id_col, "score", "predicted", "n_hits", "words"])

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind.simpleString()}, score double, predicted int, n_hits int, words array<string>")
