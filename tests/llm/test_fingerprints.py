"""Fingerprints against true set similarity, edited texts against plain strings, odd rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import fingerprints as fp

TEXTS = ["", None, "one", "one two", "éß日本 x " * 3, "a b c d e f g", "a b c d e f g", "  \n\t", "w " * 20_000, "".join(chr(97 + i % 26) for i in range(4000)), "😀 b c d e f g h i j"]


@pytest.mark.parametrize("ids", [list(range(11)), [None, None, 3, 3, 3, 1, 1, 9, 8, 7, 100]])
def test_edited_texts_and_neighbours(spark, ids):
    df = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, TEXTS)], "doc_id bigint, text string, fingerprint string").repartition(3)
    rows = fp.fingerprint_edits(df).collect()
    hashes = {r["text"]: r["h"] for r in df.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    docs = sorted(((i, t or "") for i, t in zip(ids, TEXTS)), key=lambda d: (d[0] is not None, d[0] or 0, hashes[d[1]]))
    want = []
    for k, (i, t) in enumerate(docs):
        n, after = len(t) // 4, docs[(k + 1) % len(docs)][1]
        want.append((i, len(t), hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest()))
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows), key=str) == sorted(want, key=str)
    assert all(len(r["fingerprint"]) == fp.BINS * fp.DIGITS and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    by = {}
    for r, (i, n, sha) in ((r, (r["doc_id"], r["n_chars"], r["edited_sha256"])) for r in rows):
        by.setdefault(n, set()).add(r["fingerprint"])
    assert len(by[13]) == 1  # the repeated text


def test_one_row_and_none(spark):
    df = spark.createDataFrame([(5, "abcdefgh")], "doc_id bigint, text string")
    (r,) = fp.fingerprint_edits(df).collect()
    assert r["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and r["near_next"] == 1.0
    assert fp.fingerprint_edits(df.limit(0)).collect() == []


@pytest.mark.parametrize("size", [12, 40, 300, 3000])
def test_likeness_estimates_jaccard(spark, size):
    r = random.Random(size)
    words = [f"w{i}" for i in range(5000)]
    pairs = []
    for k in range(60):
        a = [r.choice(words) for _ in range(size)]
        b = a[: size * (k % 6) // 5] + [r.choice(words) for _ in range(size - size * (k % 6) // 5)]
        pairs.append((" ".join(a), " ".join(b)))
    df = fp.with_fingerprint(fp.with_fingerprint(spark.createDataFrame(pairs, "a string, b string"), "a", "fa"), "b", "fb")
    errors = []
    for x in df.select("a", "b", fp.likeness(F.col("fa"), F.col("fb")).alias("near")).collect():
        s = [{tuple(t.split()[i : i + 5]) for i in range(size - 4)} for t in (x["a"], x["b"])]
        errors.append(x["near"] - len(s[0] & s[1]) / len(s[0] | s[1]))
    assert max(map(abs, errors)) < 0.25 and abs(sum(errors) / len(errors)) < 0.03


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string")
    plan = fp.fingerprint_edits(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
