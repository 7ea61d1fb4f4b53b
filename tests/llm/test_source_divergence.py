"""The audit against plain Python counts and its SQL, the skyband against all pairs, and odd tables."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from pulsegrid.llm import queries
from pulsegrid.llm import source_divergence as sd


def plain_audit(rows, least, top):
    words = lambda t: [w for w in re.split(r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if w]
    docs = [(lang or "", source or "", words(text)) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = Counter(w for d in mine for w in set(d[2]))
        kept = sorted((w for w, n in held.items() if n >= least), key=str.encode)

        def shares(part):
            c = Counter(w for d in part for w in d[2])
            total = sum(c[w] for w in kept)
            return {w: (c[w], 1 + 10**9 * (c[w] + 5) // (total + 5 * len(kept))) for w in kept}

        whole = shares(mine)
        each = {s: shares([d for d in mine if d[1] == s]) for s in {d[1] for d in mine}}
        for s, p in each.items():
            pair = sorted((-sum(abs(p[w][1] - q[w][1]) for w in kept), t.encode(), t) for t, q in each.items() if t != s)
            term = sorted((whole[w][1] - p[w][1], w.encode(), w) for w in kept if p[w][0] and p[w][1] > whole[w][1])[:top]
            out += [(lang, s, part, name, -v, i + 1) for part, found in (("pair", pair), ("term", term)) for i, (v, _, name) in enumerate(found)]
    return sorted(out)


def rows_of(rng, n=400):
    vocabulary = [f"{c}{d}" for c in "abcdeéßxyz" for d in "klmno"] + ["Zed", "ZED", "naïve"]
    rows = []
    for i in range(n):
        lang, source = rng.choice(["en", "en", "fr", None, ""]), rng.choice(["s1", "s1", "s1", "s2", "s3", None] + [f"t{k}" for k in range(70)])
        start = rng.randrange(30)
        rows.append((lang, source, None if i % 50 == 0 else " ".join(rng.choice(vocabulary[start : start + 25]) + rng.choice(["", ",", "1"]) for _ in range(rng.randint(0, 40)))))
    return rows + rows[:20]


@pytest.mark.parametrize("least,top", [(5, 3), (30, 50), (10_000, 5)])
def test_audit_equals_plain_counts(spark, least, top, monkeypatch):
    rows = rows_of(random.Random(least))
    monkeypatch.setattr(sd, "BLOCK_TERMS", 16)  # several blocks of terms and of sources
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, term int, item string").repartition(5)
    got = sorted(tuple(r) for r in sd.audit(df, least, top).collect())
    assert got == plain_audit(rows, least, top)


def test_query_equals_its_sql(spark, tmp_path):
    rows = rows_of(random.Random(9), 1500)
    spark.createDataFrame(rows, "lang string, source string, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = queries.op12_source_divergence(spark, str(tmp_path))
    want = con.execute(queries.SQL["op12_source_divergence"]).fetch_df()
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.itertuples(index=False, name=None))


@pytest.mark.parametrize("k", [1, 3, 50])
def test_skyband_keeps_what_fewer_than_k_dominate(k):
    rng = np.random.default_rng(k)
    for n in (0, 1, 40, 700):
        high, low = rng.integers(0, 12, n), rng.integers(0, 12, n)
        beaten = [sum(high[:i] >= high[i]) and int(((high[:i] >= high[i]) & (low[:i] <= low[i])).sum()) for i in range(n)]
        assert sd.skyband(high, low, k).tolist() == [b < k for b in beaten]
        frame = pd.DataFrame({"lang": "en", "source": "s", "term": [f"{i:05}" for i in range(n)], "n": high, "all": low})
        parts = [frame.iloc[a : a + 90] for a in range(0, n, 90)]
        got = pd.concat([frame.iloc[:0], *sd._prune(iter(parts), k, block=32)])
        assert got["term"].tolist() == [f"{i:05}" for i in range(n) if beaten[i] < k]


def test_empty_table(spark):
    df = spark.createDataFrame([], "lang string, source string, text string")
    assert sd.audit(df).collect() == []
