"""Runs against a search over every period, also through the candidate stretches and the query's planted periods."""

import hashlib
import random
from fractions import Fraction

import numpy as np
import pytest
import zlib

from pulsegrid.llm import periodic_runs as pr
from pulsegrid.llm import queries


def plain_runs(w, least=24, repeats=3):
    n, out = len(w), []
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            size = i + q - s
            if size >= max(least, repeats * q) and not any(w[s : s + size - p] == w[s + p : s + size] for p in range(1, q)):
                out.append((s, size, q))
    return sorted(out, key=lambda x: (x[0], x[2]))


def random_words(rng, longest=120):
    n, k = rng.randint(0, longest), rng.choice([1, 2, 3, 5, 30])
    w = [f"w{rng.randrange(k)}" for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n > 10:
            a, b = rng.randrange(n), rng.randint(0, n)
            p = rng.randint(1, max(1, (n - a) // 3))
            for i in range(a, b):
                w[i] = w[a + (i - a) % p]
    return w


@pytest.mark.parametrize("least,repeats", [(24, 3), (6, 2), (8, 3), (5, 4), (4, 2)])
def test_runs_equal_a_plain_search(least, repeats):
    rng = random.Random(least)
    group = [random_words(rng) for _ in range(150)]
    number = {}
    arrays = [np.array([number.setdefault(x, len(number)) for x in w], dtype=np.int64) for w in group]
    for w, runs in zip(group, pr.runs_of(arrays, least, repeats)):  # all sequences share two trees
        assert [tuple(r) for r in runs.tolist()] == plain_runs(w, least, repeats)


@pytest.mark.parametrize("least,repeats", [(24, 3), (6, 2), (7, 3)])
def test_candidates_lose_no_run(least, repeats):
    rng = random.Random(least + 1)
    for _ in range(300):
        words = [x.encode() for x in random_words(rng)]
        spans = pr.candidates(np.fromiter(map(hash, words), dtype=np.int64, count=len(words)), least, repeats)
        got = pr._solve([(0, words, spans)], least, repeats).get(0, np.zeros((0, 3), int)).tolist() if spans else []
        assert [tuple(r) for r in got] == plain_runs(words, least, repeats)


def test_extensions_and_ranks_equal_plain_ones():
    rng = random.Random(2)
    for _ in range(60):
        s = [rng.randint(1, 3) for _ in range(rng.randint(1, 40))] + [0]
        tree = pr.SuffixTree(s, 4)
        for turn, rank in zip((1, -1), tree.ranks()):
            order = sorted(range(len(s)), key=lambda i: [turn * x if x else -9 for x in s[i:]])
            assert np.argsort(rank).tolist() == order
        i, j = [np.array(x) for x in zip(*[(a, b) for a in range(len(s)) for b in range(len(s)) if a != b])]
        lcp = [next(k for k in range(len(s)) if s[a + k : a + k + 1] != s[b + k : b + k + 1]) for a, b in zip(i, j)]
        assert tree.extensions(i, j).tolist() == lcp


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_whole_query_on_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    some = 0
    for r in docs:
        words = planted(r.doc_id, [w for w in (r.text or "").encode().split()])
        if len(words) > 1500:
            continue
        runs, g = plain_runs(words), got[r.doc_id]
        some += len(runs)
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert g.n_runs == len(runs)
        assert g.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert g.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest()
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        assert (g.start, g.length, g.period, g.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
    assert some > 10


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "x " * 30), (4, "x " * 23), (5, "a b " * 40_000), (5, "a b " * 40_000), (6, "é é " * 30)]
    df = spark.createDataFrame([(i, t, 1, "y") for i, t in rows], "doc_id int, text string, runs int, collapsed string")
    got = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in pr.find_runs(df).collect()]
    want = [(1, [], ""), (2, [], ""), (3, [], ""), (None, [(0, 30, 1)], "x"), (4, [], " ".join(["x"] * 23)), (5, [(0, 80_000, 2)], "a b"), (5, [(0, 80_000, 2)], "a b"), (6, [(0, 30, 1)], "é é")]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert pr.find_runs(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        pr.find_runs(df, min_words=1)
