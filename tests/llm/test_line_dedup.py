"""Line deduplication against all pairs of lines; the banded edit distance against the full table; odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import line_dedup as ld
from pulsegrid.runtime import materialize


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(r, line, times, letters="abéc "):
    out = list(line)
    for _ in range(times):
        k, p = r.random(), r.randrange(len(out))
        if k < 0.4:
            out[p] = r.choice(letters)
        elif k < 0.7 and len(out) > 9:
            del out[p]
        else:
            out.insert(p, r.choice(letters))
    return "".join(out)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance_equals_the_full_table(spark, edits):
    r = random.Random(edits)
    rows = []
    for _ in range(300):
        a = "".join(r.choice("abéc") for _ in range(r.randint(9, 20)))
        rows.append((a, edited(r, a, r.randint(0, 5))))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", ld.within_edits(F.col("a"), F.col("b"), edits).alias("near")).collect()
    assert all(x["near"] == (distance(x["a"], x["b"]) <= edits) for x in got)


def corpus():
    r = random.Random(9)
    base = ["".join(r.choice("abéc ") for _ in range(r.randint(9, 60))) for _ in range(60)]
    docs = []
    for i in range(80):
        lines = [r.choice([r.choice(base), edited(r, r.choice(base), r.randint(1, 4)), "short", ""]) for _ in range(r.randint(1, 6))]
        docs.append((None if i == 40 else i, "\n".join(lines)))
    return docs + [(80, ""), (81, None), (82, "x" * 30_000 + "\n" + "x" * 30_001), (83, docs[5][1]), (84, "\n\n"), (5, docs[5][1])]


def expected(docs, edits, least, order):
    """Removed (doc, text, at) with near flags, comparing every pair of distinct lines."""
    place = {}
    for key in sorted({d for d in docs if d[1] is not None}, key=order):
        for at, line in enumerate(key[1].split("\n")):
            if len(line) >= least:
                place.setdefault(line, (order(key), at))
    near = {x for x in place for y in place if place[y] < place[x] and abs(len(x) - len(y)) <= edits and distance(x, y) <= edits} if len(place) < 2000 else set()
    out = set()
    for key in {d for d in docs if d[1] is not None}:
        for at, line in enumerate(key[1].split("\n")):
            if line in place and ((order(key), at) != place[line] or line in near):
                out.add((key, at, (order(key), at) == place[line]))
    return out


@pytest.mark.parametrize("edits", [2])
def test_repeats_equal_all_pairs(spark, monkeypatch, edits):
    docs = [d for d in corpus() if not d[1] or len(d[1]) < 5000]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id bigint, text string, h1 int").repartition(3)
    hashes = {(r["doc_id"], r["text"]): r["h"] for r in df.withColumn("h", F.xxhash64("text")).collect()}
    order = lambda d: (d[0] is not None, d[0] or 0, hashes[d])
    want = {(d[0], hashes[d], at, near) for d, at, near in expected(docs, edits, 9, order)}
    for few in (0, 10**6):
        monkeypatch.setattr(ld, "BROADCAST_ROWS", few)
        got = [tuple(r) for r in ld.find_repeats(df, edits, min_chars=9).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_removal_and_report(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t, f"l{i}") for i, t in docs], "doc_id bigint, text string, at string").repartition(3)
    repeats = materialize(ld.find_repeats(df, 2, min_chars=9))
    report = ld.dedup_report(df, repeats).collect()
    assert len(report) == len(docs)
    assert {(r["n_exact"], r["n_near"]) for r in report if r["doc_id"] == 82} == {(0, 1)}
    left = ld.remove_lines(df, repeats)
    assert left.columns == df.columns
    gone = {}
    for r in repeats.collect():
        gone.setdefault((r["_doc"], r["_hash"]), set()).add(r["at"])
    found = {}
    for x in left.collect():
        found.setdefault(x["doc_id"], []).append(x["text"])
    for r in df.withColumn("h", F.xxhash64("text")).collect():
        cut = gone.get((r["doc_id"], r["h"]))
        text = r["text"] if cut is None else "\n".join(x for i, x in enumerate(r["text"].split("\n")) if i not in cut)
        assert found.get(r["doc_id"], []).count(text) == (0 if cut is not None and not text.strip() else docs.count((r["doc_id"], r["text"])))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    repeats = ld.find_repeats(df)
    assert repeats.collect() == [] and ld.remove_lines(df, repeats).collect() == [] and ld.dedup_report(df, repeats).collect() == []


def test_short_lines_repeat_exactly_and_are_never_near(spark):
    docs = [(1, "ab\nlonger line one\n\nx"), (2, "ab\nac\nlonger line ome"), (3, "x\nab"), (4, "\n")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    repeats = materialize(ld.find_repeats(df, 2, min_chars=9, exact_chars=1))
    assert {(r["_doc"], r["at"], r["near"]) for r in repeats.collect()} == {(2, 0, False), (2, 2, True), (3, 0, False), (3, 1, False)}
    assert {(r["doc_id"], r["text"]) for r in ld.remove_lines(df, repeats).collect()} == {docs[0], (2, "ac"), docs[3]}


def test_query_and_stage_count_every_repeat(spark):
    import corpus_pipeline
    from pulsegrid.llm.queries import op1_line_dedup

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()}
    lines = [x for _, t in texts for x in (t or "").split("\n") if x]
    assert any(len(x) < 20 for x in lines) and len(texts) == docs.count()
    assert op1_line_dedup(spark, sf).agg(F.sum("n_exact")).first()[0] == len(lines) - len(set(lines))
    left = [x for r in corpus_pipeline.drop_repeated_lines(spark, docs, sf).collect() for x in (r["text"] or "").split("\n") if x]
    assert len(left) == len(set(left))
