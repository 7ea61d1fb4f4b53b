"""Sharding, packing and token files against brute force and exact round trips."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import packing, sharding, token_files
from pulsegrid.llm.tokens import Encoder, default_path

ODD = ["", None, " ", "a  b", "a \nb", "\n b", " x", "x ", "it's  'twas 123 45.6!! ok\t z", "<|endoftext|> hi", "日本 語", "é× è",
       "a\x1c b", "a​ b", "a　 b  c", "nb   sp", "\r\n x", "a" * 5000, "word " * 5000, "x", "x"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None if i == 3 else i // 2, t, i) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, row_number int").repartition(3)


@pytest.mark.parametrize("total", [0, 1, 2, 5, 64, 1000])
def test_permutation_is_a_bijection_and_inverts(total):
    rows = np.arange(total)
    p = sharding.permute(rows, total, seed=3)
    assert sorted(p) == list(rows)
    assert list(sharding.permute(p, total, seed=3, inverse=True)) == list(rows)


def test_shards_are_even_gapless_and_computable(spark):
    df = spark.range(0, 1003).withColumnRenamed("id", "doc_id").repartition(5)
    rows = sharding.shard_rows(df, 40, seed=5).collect()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(map(len, by.values()))[0] + 1 >= max(map(len, by.values()))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    r = rows[17]
    assert r["row_number"] == r["doc_id"]
    assert sharding.row_at(r["shard"], r["slot"], 1003, 40, seed=5) == r["row_number"]
    assert sorted(map(tuple, sharding.shard_rows(df.repartition(2), 40, seed=5).collect())) == sorted(map(tuple, rows))


def test_shards_of_odd_rows(spark, odd):
    assert len(sharding.shard_rows(odd, 4).collect()) == len(ODD)
    assert sharding.shard_rows(odd.limit(0), 4).collect() == []


def test_encoder_equals_whole_encoding():
    e = Encoder(default_path())
    ids, b = e.encode(pa.array(ODD, pa.string()), 7)
    for i, t in enumerate(ODD):
        assert list(ids[b[i] : b[i + 1]]) == [*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 7]


def expected(end):
    e = Encoder(default_path())
    return [[*e.tokenizer.encode(t or "", add_special_tokens=False).ids, end] for t in ODD]


def test_best_fit_equals_the_plain_algorithm():
    rng = np.random.default_rng(2)
    lengths = np.sort(rng.integers(1, 33, 400))[::-1]
    rooms = []
    for n in lengths:  # one piece at a time, tightest open window
        fit = [i for i, r in enumerate(rooms) if r >= n]
        if fit:
            i = min(fit, key=lambda k: rooms[k])
            rooms[i] -= n
        else:
            rooms.append(32 - n)
    counts = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True))}
    moves = packing.best_fit(counts, 32)
    assert max(w + b - a for _, a, b, w, _ in moves) == len(rooms)
    used = {}
    for n, a, b, w, o in moves:
        for k in range(b - a):
            assert used.get(w + k, 0) == o
            used[w + k] = o + n
    assert sorted(32 - u for u in used.values()) == sorted(rooms)


def test_packing_holds_every_id_once(odd):
    rows = packing.pack_documents(odd, default_path(), window=64, end=1, keep_ids=True).collect()
    got, want = {}, {}
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and 0 < r["length"] <= 64
        if r["doc_tokens"] > 64 and r["length"] == 64:
            assert r["offset"] == 0
    windows = {}
    for r in rows:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(windows) == list(range(len(windows)))
    for spans in windows.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 64
    for ids in expected(1):
        for s in range(0, len(ids), 64):
            k = (s, np.asarray(ids[s : s + 64], dtype="<u4").tobytes(), len(ids))
            want[k] = want.get(k, 0) + 1
    for r in rows:
        k = (r["start"], bytes(r["ids"]), r["doc_tokens"])
        got[k] = got.get(k, 0) + 1
    assert got == want
    assert packing.pack_documents(odd.limit(0), default_path()).collect() == []


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 2000])
def test_elias_fano_round_trip(n):
    rng = np.random.default_rng(n)
    values = np.cumsum(rng.integers(0, 900, n))
    ef = token_files.Boundaries.encode(values)
    assert list(ef.all()) == list(values)
    assert [ef.select(i) for i in range(0, n, max(1, n // 50))] == list(values[:: max(1, n // 50)])
    assert 8 * (ef.low.nbytes + ef.high.nbytes) < n * (np.log2(values[-1] / n + 1) + 4) + 32


@pytest.mark.parametrize("block", [50, 1 << 20])
def test_token_files_round_trip(spark, odd, tmp_path, block):
    path = str(tmp_path / "files")
    token_files.write_token_files(odd, path, default_path(), end=2, block_ids=block)
    blocks = spark.read.parquet(path)
    rows = sorted(token_files.read_token_files(blocks).collect(), key=lambda r: r["start"])
    want = sorted((len(x), zlib.crc32(np.asarray(x, dtype="<u4").tobytes())) for x in expected(2))
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in rows) == want
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda x: -1 if x is None else x)
    b = blocks.orderBy("part", "block").first()
    assert len(token_files.document_ids(bytes(b["payload"]), 0)) == rows[0]["n_tokens"]


def test_empty_token_files(spark, odd, tmp_path):
    path = str(tmp_path / "none")
    token_files.write_token_files(odd.limit(0), path, default_path(), end=2)
    assert token_files.read_token_files(spark.read.parquet(path)).collect() == []


def test_the_tokenizer_gets_a_bounded_number_of_units_at_once(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from pulsegrid.llm import tokens

    class Counted:
        def __init__(self, inner):
            self.inner, self.sizes = inner, []

        def encode_batch_fast(self, units, **kw):
            self.sizes.append(len(units))
            return self.inner.encode_batch_fast(units, **kw)

    monkeypatch.setattr(tokens, "CALL_UNITS", 50, raising=False)
    texts = pa.array([" ".join(f"w{i}x{i * 7}" for i in range(400)), "", "a b c"])
    code, plain = tokens.Encoder(tokens.default_path()), tokens.Encoder(tokens.default_path())
    code.tokenizer = Counted(code.tokenizer)
    ids, bounds = code.encode(texts, 1)
    want = [[*plain.tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts.to_pylist()]
    assert ids.tolist() == [i for x in want for i in x] and np.diff(bounds).tolist() == [len(x) for x in want]
    assert len(code.tokenizer.sizes) > 1 and max(code.tokenizer.sizes) <= 50


def test_block_shifts_go_to_the_payloads(spark, tmp_path):
    """Payloads are not shuffled to meet their shifts, whatever Spark guesses about sizes."""
    path = str(tmp_path / "blocks")
    token_files.write_token_files(spark.createDataFrame([(1, "one two"), (2, None), (3, "three")], "doc_id bigint, text string"), path, default_path(), 2, block_ids=2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = token_files.read_token_files(spark.read.parquet(path))
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        rows = out.orderBy("doc_id").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [r.start for r in rows] == [0, rows[0].n_tokens, rows[0].n_tokens + 1]


def test_every_unit_is_looked_up_once():
    class Once(dict):
        def __contains__(self, key):
            raise AssertionError("a second look-up")

        __getitem__ = __contains__

    code = Encoder(default_path())
    code.place = Once()
    texts = ["the cat and the dog", "the bird", "the cat and the dog"]
    for _ in range(2):
        ids, bounds = code.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [code.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_hands_python_small_batches(spark, tmp_path, monkeypatch):
    """Each batch leaves its size in a folder: none holds more rows than set, and the session's setting is as before."""
    inner, folder = packing.in_steps, str(tmp_path)

    def noted(batches, text):
        import uuid

        for batch in batches:
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(str(batch.num_rows))
            yield from inner(iter([batch]), text)

    monkeypatch.setattr(packing, "in_steps", noted)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = spark.range(2_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text")).coalesce(1)
    out = packing.pack_documents(docs, default_path())
    sizes = [int(p.read_text()) for p in tmp_path.iterdir()]
    assert out.count() == 2_000 and spark.conf.get(name) == before
    assert sum(sizes) == 2_000 and max(sizes) <= packing.BATCH_ROWS
