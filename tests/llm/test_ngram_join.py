"""The similarity join against all pairs, with groups larger than a block; components against union-find."""

import random

import numpy as np
import pyarrow as pa
import pytest

from pulsegrid.llm import components as cc
from pulsegrid.llm import ngram_join as nj


def union(n, links):
    p = list(range(n))

    def root(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in links:
        p[root(a)] = root(b)
    return [root(i) for i in range(n)]


def texts():
    r = random.Random(3)
    words = [f"w{i}" for i in range(2000)]
    out = []
    for size in (12, 60, 400):
        base = [r.choice(words) for _ in range(size)]
        for _ in range(25):
            t = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8])):
                t[r.randrange(size)] = r.choice(words)
            out.append(" ".join(t))
    passage = " ".join(r.choice(words) for _ in range(15))
    out += [passage + " " + " ".join(r.choice(words) for _ in range(40)) for _ in range(30)]
    return out + ["", "", None, "one two", "one, two!", "One", "###", "###", "a b c d e", "long " * 20_000, "long " * 30_000]


def expected(rows, threshold=0.8):
    sets = [set(s.tolist()) for s in nj.shingle_sets(pa.array(rows, pa.string()))]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9]
    return sets, links


@pytest.mark.parametrize("blocks", [(1024, 256), (8, 4)])
def test_join_equals_all_pairs(spark, monkeypatch, blocks):
    monkeypatch.setattr(nj, "BAND_BLOCK", blocks[0])
    monkeypatch.setattr(nj, "VERIFY_BLOCK", blocks[1])
    rows = texts()
    sets, links = expected(rows)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id int, text string, node string").repartition(4)
    got = {r["doc_id"]: r for r in nj.join_ngrams(df).collect()}
    degree, other = [0] * len(rows), [set() for _ in rows]
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
        if sets[a] != sets[b]:
            other[a].add(frozenset(sets[b]))
            other[b].add(frozenset(sets[a]))
    root = union(len(rows), links)
    least = {}
    for i, r in enumerate(root):
        least.setdefault(r, i)
    assert [got[i]["n_links"] for i in range(len(rows))] == degree
    assert [got[i]["n_text_links"] for i in range(len(rows))] == [len(o) for o in other]
    assert [got[i]["class_id"] for i in range(len(rows))] == [least[r] for r in root]
    assert [got[i]["first"] for i in range(len(rows))] == [least[r] == i for i, r in enumerate(root)]


@pytest.mark.parametrize("threshold", [0.5, 0.6, 0.95])
def test_other_thresholds_lose_no_link(spark, threshold):
    rows = texts()
    sets, links = expected(rows, threshold)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string").repartition(4)
    got = {r["doc_id"]: r["n_links"] for r in nj.join_ngrams(df, threshold=threshold).collect()}
    degree = [0] * len(rows)
    for pair in links:
        for i in pair:
            degree[i] += 1
    assert [got[i] for i in range(len(rows))] == degree


def test_bands_follow_from_the_threshold():
    assert nj.band_plan(0.8) == (32, 5)
    for t in (0.3, 0.5, 0.7, 0.9, 1.0):
        bands, rows = nj.band_plan(t)
        assert (1 - t**rows) ** bands <= nj.MISSED and bands * rows % nj.STEP == 0
    for t in (0.0, 0.01, 1.1):
        with pytest.raises(ValueError):
            nj.band_plan(t)


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (2, None)], "doc_id bigint, text string")
    rows = nj.join_ngrams(df).collect()
    assert sorted((r["n_links"], r["first"]) for r in rows) == [(0, True), (2, False), (2, False), (2, True)]
    assert nj.join_ngrams(df.limit(0)).collect() == []


def test_pruning_bound_is_the_beta_tail():
    rng = np.random.default_rng(0)
    t = 0.8 + 0.2 / 256
    for m in (20, 26, 30):
        tail = (rng.beta(m + 1, 32 - m + 1, 400_000) >= t).mean()
        assert (m >= nj.least_matches(32, 0.8, 0.01)) == (tail >= 0.01)


def test_matrix_of_links_equals_sets():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, rng.integers(20, 200)).astype(np.uint64)) for _ in range(40)]
    for threshold in (0.5, 0.8):
        got = nj._linked(sets, threshold, width=16)
        for i in range(40):
            for j in range(40):
                a, b = set(sets[i].tolist()), set(sets[j].tolist())
                assert got[i, j] == (i != j and len(a & b) >= threshold * len(a | b) - 1e-9)


def test_components_equal_union_find(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)] + [(7, 7), (300, 299), (300, 299)]
    got = {x["node"]: x["component"] for x in cc.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = union(301, edges)
    inside = {v for a, b in edges if a != b for v in (a, b)}
    least = {}
    for v in sorted(inside):
        least.setdefault(root[v], v)
    assert got == {v: least[root[v]] for v in inside}
    assert cc.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
