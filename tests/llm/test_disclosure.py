"""Base spans against plain patterns, disclosing terms against a plain count, and sanitised texts."""

import hashlib
import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import disclosure as d
from pulsegrid.llm import queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                    "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end(), m.group()))
    return out


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(3)
    signs = "ab1.@-+ ()9 0%é𝄞_\n4444 4444 5"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "a@b.cd@e.fg x@y.z", "+1 555 555 5555 4444 4444 4444 4448", "@", "x@y", "1.1.1.1" * 50, "0255.1.1.00 256.1.1.1"]
    texts += ["9" * 50_000 + "@" + "a." * 20_000 + "b", "𝄞é 4111 1111 1111 1111", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in d.with_entities(df, out="found").collect():
        got = [(d.KINDS[x["kind"]], x["start"], x["end"]) for x in r.found]
        assert got == [w[:3] for w in base_spans(r.text)], r.text
        assert all(r.text.encode()[x["from"]:x["to"]].decode() == r.text[x["start"]:x["end"]] for x in r.found)


def test_whole_query_on_a_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = queries.op11_disclosure(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        spans = base_spans(docs[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.spans.startswith(joined)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in d.KINDS]


@pytest.mark.parametrize("length", [0, 1, 255, 256, 257, 1000])
def test_running_sums(spark, length):
    values = [(i * 7) % 11 for i in range(length)]
    df = spark.createDataFrame([(values,)], "v array<bigint>")
    assert df.select(d.running(F.col("v"))).first()[0] == [sum(values[:i]) for i in range(length)]


def corpus():
    """Texts in which some words stand only near one address, some often elsewhere too, and one address is everywhere."""
    rng = random.Random(5)
    common = [f"common{'abcdefghij'[i]}" for i in range(10)]
    filler = lambda n: " ".join(rng.choice(common) for _ in range(n))
    texts = []
    for i in range(12):
        texts.append(f"{filler(4)} Blauberg wrote from anna@site.example {'' if i % 3 else 'tuesday '}{filler(3)} {i:x}y")
    texts += [f"{filler(5)} tuesday note {i}" for i in range(3)]
    texts += [f"{filler(5)} bert@site.example {filler(3)} {i} zwei" for i in range(2)] + [f"blauberg {filler(9)}"]
    texts += [f"{filler(8)} {i}" for i in range(300)] + [f"all@site.example {filler(3)} {i}" for i in range(200)]
    return texts + texts[:5] + [None, ""]


def plain_terms(texts, reach=100, min_texts=3, bits=1.0, floor=4.0):
    different = sorted({t for t in texts if t is not None} | ({""} if None in texts else set()))
    words = lambda s: set(re.findall(r"[^\W\d_]{4,}", s.lower()))
    near, holders = {}, {}
    for t in different:
        mine = base_spans(t)
        for k, a, b, v in mine:
            same = [x for x in mine if x[0] == k]
            lo = max([x[2] for x in same if x[2] <= a] + [0])
            hi = min([x[1] for x in same if x[1] >= b] + [len(t)])
            left, right = t[lo:a], t[b:hi]
            left = re.sub(r"^[^\W\d_]+", "", left[-reach:]) if len(left) > reach else left
            right = re.sub(r"[^\W\d_]+$", "", right[:reach]) if len(right) > reach else right
            holders.setdefault(v.lower(), set()).add(t)
            for w in words(left + " " + right):
                near.setdefault((v.lower(), w), set()).add(t)
    out = {}
    for (v, w), both in near.items():
        alone = sum(w in words(t) for t in different)
        rest = math.log2(alone / len(both))
        n = len(set(different)) + (None in texts)  # a null text has a key of its own
        if len(both) >= min_texts and rest <= bits and math.log2(n / len(holders[v])) - rest >= floor:
            out[v, w] = rest
    return out


def test_disclosing_terms_equal_a_plain_count(spark):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = d.with_entities(df.withColumn("hash", d.text_key(F.col("text"))), out="found")
    got = {(r.entity.value, r.term): r.bits for r in d.disclosing_terms(rows.where(F.size("found") > 0).select("hash", "found"), rows.select("hash", "text")).collect()}
    want = plain_terms([t for t in texts if t != ""] + [""])
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert ("anna@site.example", "blauberg") in got and ("anna@site.example", "tuesday") in got
    assert not any(k[0] in ("all@site.example", "bert@site.example") for k in got)


def test_spans_and_sanitised_texts(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id int, text string, hash_ int, spans int").repartition(3)
    got = {r.doc_id: r for r in d.find_spans(df).collect()}
    assert len(got) == len(texts)
    clean = d.sanitise(df, d.find_spans(df))
    assert clean.columns == df.columns
    out = {r.doc_id: r.text for r in clean.collect()}
    assert "Blauberg" not in out[0] and "anna@" not in out[0] and "[email]" in out[0] and "[term]" in out[0]
    assert "tuesday" not in out[0] and "t*" in out[0]
    assert out[17] == texts[17] and out[20] == texts[20]  # holds no entity: every word stays
    assert out[len(texts) - 2] is None and out[len(texts) - 1] == ""
    first = [(x.kind, x.start) for x in got[0].spans]
    assert first == sorted(first) and {texts[0][x.start:x.end] for x in got[0].spans if x.kind == 4} == {"Blauberg", "tuesday", "wrote", "from"}


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id int, text string, found string, id int")
    assert d.find_spans(empty).collect() == [] and d.sanitise(empty, d.find_spans(empty)).collect() == []
    odd = spark.createDataFrame([(None, "a@b.c", "x", 1), (None, "a@b.c", "x", 1), (3, None, None, None)], "doc_id int, text string, found string, id int")
    rows = d.find_spans(odd).collect()
    assert sorted(len(r.spans) for r in rows) == [0, 1, 1]


def test_query_equals_its_sql(spark, tmp_path):
    spark.createDataFrame(list(enumerate(corpus())), "doc_id int, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.SQL["op11_disclosure"]).fetch_df()
    got = queries.op11_disclosure(spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.itertuples(index=False, name=None))
    assert sum(r["n_terms_removed"] for r in got) and sum(r["n_terms_generalised"] for r in got)
