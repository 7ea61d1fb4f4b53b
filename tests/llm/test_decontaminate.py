"""Phrase matches against a scan of every window, proximity matches against a nested loop, odd rows."""

import hashlib
import re

import duckdb
import pyarrow as pa
import pytest

from pulsegrid.llm import decontaminate as dc
from pulsegrid.llm import queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = str.maketrans(dc.UPPER, dc.LOWER)
LONG = "one two three four five six seven eight nine ten eleven twelve"
DOCS = [(1, LONG), (1, LONG), (None, "x " + LONG.upper() + " y"), (2, ""), (3, None), (4, "short item"), (4, "Short, ITEM! short item"),
        (5, "ten nine eight"), (6, "é-É Ünï ß 12a"), (7, "to be or not to be or not to be to be or not to be or not to be"), (8, "w " * 30_000 + LONG), (9, "one two three")]
ITEMS = [(10, LONG), (9, "short item"), (8, ""), (7, None), (6, "to be or not to be or not to be to"), (5, "é-É"), (5, "absent word here"), (11, LONG)]


def split(text):
    return WORD.findall((text or "").translate(UP))


def brute(docs, items, width=10):
    out = []
    for doc_id, text in docs:
        w, hit, found = split(text), set(), set()
        for item, t in items:
            q = split(t)
            for k in range(max(1, len(q) - width + 1)) if q else ():
                win = q[k : k + width]
                for s in range(len(w) - len(win) + 1):
                    if w[s : s + len(win)] == win:
                        hit.update(range(s, s + len(win)))
                        found.add(str(item))
        ids = ",".join(sorted(found))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(i, t, 0) for i, t in DOCS], "doc_id bigint, text string, term int").repartition(3)
    return docs, spark.createDataFrame(ITEMS, "item_id int, text string")


def test_equals_a_scan_of_every_window(tables):
    rows = dc.find_contamination(*tables).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows), key=str)
    assert got == brute(DOCS, ITEMS)


@pytest.mark.parametrize("block", [1, 3])
def test_vocabulary_blocks_give_the_same_index(tables, block):
    tests = dc.test_windows(tables[1])
    whole = dc.build_index(tables[0], tests.vocabulary)
    assert sorted(map(tuple, dc.build_index(tables[0], tests.vocabulary, block=block).collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)


def test_empty_tables(tables):
    docs, items = tables
    assert dc.find_contamination(docs.limit(0), items).collect() == []
    rows = dc.find_contamination(docs, items.limit(0)).collect()
    assert len(rows) == len(DOCS) and not any(r["contaminated"] for r in rows)


def test_word_splitting_keeps_texts_apart():
    texts = ["ab", "cd", "", None, " a", "b ", "é", "x1", "--", "é日本", "A\x7fB\x80C", "tail"]
    coded, at = dc._split_words(pa.array(texts, pa.string()))
    got = [w.decode() for w in coded.to_pylist()]
    assert [got[a:b] for a, b in zip(at, at[1:])] == [split(t) for t in texts]


def test_proximity_equals_a_nested_loop(spark):
    docs = spark.createDataFrame([(1, "a x b y c"), (2, "a b c"), (3, "c b a"), (4, "a x x x b c"), (5, "b b b")], "doc_id int, text string")
    tests = dc.test_windows(spark.createDataFrame([(1, "a b c")], "item_id int, text string"))
    index = dc.build_index(docs, tests.vocabulary)
    counts = {"a": 4, "b": 7, "c": 4}
    for slop in (0, 1, 2):
        want = set()
        for d, t in ((r["doc_id"], r["text"].split()) for r in docs.collect()):
            anchor = min(enumerate("abc"), key=lambda x: (counts[x[1]], x[0]))
            for p, w in enumerate(t):
                if w == anchor[1] and all(any(x == q and abs(p - anchor[0] + o - k) <= slop for k, x in enumerate(t)) for o, q in enumerate("abc")):
                    want.add((d, p - anchor[0]))
        assert {(r["_doc"], r["start"]) for r in dc.proximity_matches(index, tests, slop).collect()} == want


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    want = con.execute(queries.SQL["op3_positional_index"]).fetch_df()
    got = queries.op3_positional_index(spark, sf).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.itertuples(index=False, name=None))
