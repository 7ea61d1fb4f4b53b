"""One registered query per operator, over whole tables with production parameters."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import disclosure, periodic_runs, quality, source_divergence, toxicity
from pulsegrid.llm.decontaminate import find_contamination
from pulsegrid.llm.fingerprints import fingerprint_edits
from pulsegrid.llm.license_scan import scan_licenses, templates
from pulsegrid.llm.line_dedup import dedup_report, find_repeats
from pulsegrid.llm.ngram_join import join_ngrams
from pulsegrid.llm.packing import pack_documents
from pulsegrid.llm.sharding import shard_rows
from pulsegrid.llm.tables import table
from pulsegrid.llm.token_files import read_token_files, write_token_files
from pulsegrid.llm.tokens import default_path
from pulsegrid.runtime import materialize, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents that repeat earlier lines exactly, or from 20 characters within two edits, per document."""
    docs = table(spark, sf_dir, "documents")
    return dedup_report(docs, find_repeats(docs, edits=2, min_chars=20, exact_chars=1))


@query
def op2_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt to shards 0 to 39 under the law ``rows``: counts differ by one at most."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = shard_rows(docs, 40, ["doc_id", "text_crc32"], seed=17)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op3_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark phrases of ten words found in all documents."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query
def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and links of all documents at Jaccard 0.8 on five-word n-grams."""
    joined = join_ngrams(table(spark, sf_dir, "documents"), threshold=0.8, n=5, tolerance=1e-6)
    return joined.select("doc_id", "class_id", "n_links", "n_text_links")


@query
def op5_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2048 ids, one row per piece."""
    packed = pack_documents(table(spark, sf_dir, "documents"), default_path(), window=2048, end=1)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def fold_of(column: str, folds: int):
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


@query
def op6_toxic_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from labelled rows outside fold 2 of 4."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(F.col("toxic").isNotNull() & (fold_of("doc_id", 4) != 2)).select("doc_id", F.col("toxic").alias("label")).distinct()
    lexicon = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, lexicon, threshold=0.3)
    return scored.select("doc_id", (F.coalesce(fold_of("doc_id", 4), F.lit(-1)) == 2).alias("held_out"), "score", "predicted", "n_hits")


@query
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint_edits(table(spark, sf_dir, "documents"))


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to token files in ascending doc_id and read back."""
    path = f"{shared_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), path, default_path(), end=2)
    return read_token_files(spark.read.parquet(path))


@query
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices, headers and whole texts in all documents, at least 0.8 of a template's five-word shingles."""
    return scan_licenses(table(spark, sf_dir, "documents"), templates(), share=0.8, guarantee=0.999)


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from labelled rows outside fold 1 of 3."""
    rows = materialize(quality.add_statistics(table(spark, sf_dir, "documents")))
    labels = table(spark, sf_dir, "labels").where(F.col("quality").isNotNull() & (fold_of("doc_id", 3) != 1)).select("doc_id", F.col("quality").alias("label")).distinct()
    model = quality.fit(rows.join(labels, "doc_id"))
    scored = quality.score_rows(rows, model, threshold=0.5)
    return scored.select("doc_id", (F.coalesce(fold_of("doc_id", 3), F.lit(-1)) == 1).alias("held_out"), "score", "predicted")


@query
def op11_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents, and the words that give it away by their co-occurrence over the corpus."""
    found = disclosure.find_spans(table(spark, sf_dir, "documents"), reach=100, generalise_bits=1.0, remove_bits=0.5, min_texts=3, min_information=4.0)
    number = lambda kind, action: F.size(F.filter("spans", lambda x: (x["kind"] == kind) & (x["action"] == action))).cast("bigint")
    counts = [number(k, "remove").alias(f"n_{kind}") for k, kind in enumerate(disclosure.KINDS)]
    terms = [number(len(disclosure.KINDS), action).alias(f"n_terms_{action}d") for action in ("remove", "generalise")]
    base, every = disclosure.digest(F.col("spans"), base_only=True), disclosure.digest(F.col("spans"))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), every.alias("spans"), *terms)


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: differences between the sources of a language, and each source's 50 terms of largest surplus."""
    return source_divergence.audit(table(spark, sf_dir, "documents"), min_docs=30, top=50)


SQL["op12_source_divergence"] = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents),
  w AS (SELECT lang, source, r, unnest(words) AS term FROM d),
  kept AS (SELECT lang, term FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
  v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
  g AS (SELECT DISTINCT lang, source FROM d),
  c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
  cells AS (SELECT g.lang, g.source, term, coalesce(n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
  p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v)::HUGEINT AS p FROM cells JOIN v USING (lang)),
  l AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY 1, 2),
  q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)::HUGEINT) // (sum(n) OVER (PARTITION BY lang) + 5 * v)::HUGEINT AS q FROM l JOIN v USING (lang)),
  pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y USING (lang, term) WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
  terms AS (SELECT lang, source, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
  u AS (SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value FROM pairs UNION ALL SELECT lang, source, 'term', item, value::BIGINT FROM terms)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM u) WHERE part = 'pair' OR rank <= 50"""


def planted_period(doc_id: object, words: list[bytes]) -> list[bytes]:
    """Every tenth document, by the checksum of its id, repeats a stretch of its words from some word on; no id, no change."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least 24 words and three periods in all documents, and digests of all runs and of the texts without the repeats."""
    found = periodic_runs.find_runs(table(spark, sf_dir, "documents"), min_words=24, repeats=3, rewrite=planted_period)
    best = periodic_runs.strongest(F.col("runs")).alias("best")
    lines = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", *[x[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), best, F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")
    ).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
WORDS = rf"list_filter(string_split_regex(translate(coalesce(text, ''), {AZ}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
SQL["op3_positional_index"] = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents), b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
  s AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
  t AS (SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM s)),
  o AS (SELECT r, n, k, array_to_string(w[k : k + n - 1], ' ') AS phrase FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM t) WHERE len(w) >= n)),
  f AS (SELECT r, o.n, k, item_id FROM o JOIN t ON t.n = o.n AND t.phrase = o.phrase),
  h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM f) GROUP BY 1),
  i AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM f) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)"""


def _matches(k: int, pattern: str) -> str:
    return f"SELECT r, t, {k} AS kind, string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}') AS m FROM d"


IP_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
SQL["op11_disclosure"] = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, coalesce(text, '') AS t FROM documents),
  k AS ({_matches(0, r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')} UNION ALL {_matches(1, r'[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)')}
    UNION ALL {_matches(2, r'[0-9](?:[\x20-]?[0-9])+')} UNION ALL {_matches(3, r'\+[0-9][\x20().0-9-]+[0-9]')}),
  x AS (SELECT r, t, kind, i, g[i] AS a, g[i + 1] AS z, m[i] AS m, regexp_replace(m[i], '[^0-9]', '', 'g') AS dig FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM k)),
  p AS (SELECT *, (sum(length(a) + length(m)) OVER (PARTITION BY r, kind ORDER BY i) - length(m))::BIGINT AS s FROM x),
  b AS (SELECT *, s + length(m) AS e, CASE kind WHEN 0 THEN lower(m) WHEN 1 THEN m ELSE dig END AS entity FROM p WHERE CASE kind WHEN 0 THEN true WHEN 1 THEN regexp_full_match(m, '{IP_PART}(?:\.{IP_PART}){{3}}')
    WHEN 2 THEN length(dig) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(dig) + 1), lambda j: CASE WHEN j % 2 = 1 THEN substr(dig, length(dig) - j + 1, 1)::INT
      ELSE substr(dig, length(dig) - j + 1, 1)::INT * 2 - CASE WHEN substr(dig, length(dig) - j + 1, 1)::INT >= 5 THEN 9 ELSE 0 END END)) % 10 = 0 ELSE length(dig) BETWEEN 8 AND 15 END),
  c AS (SELECT t, kind, entity, lower(CASE WHEN length(a) > 100 THEN regexp_replace(right(a, 100), '^\p{{L}}+', '') ELSE a END || ' ' || CASE WHEN length(z) > 100 THEN regexp_replace(left(z, 100), '\p{{L}}+$', '') ELSE z END) AS near FROM b),
  pr AS (SELECT DISTINCT t, kind, entity, unnest(regexp_extract_all(near, '\p{{L}}{{4,}}')) AS term FROM c),
  tg AS (SELECT kind, entity, term, count(*) AS n FROM pr GROUP BY 1, 2, 3 HAVING count(*) >= 3),
  w AS (SELECT term, count(*) AS alone FROM (SELECT DISTINCT t, unnest(regexp_extract_all(lower(t), '\p{{L}}{{4,}}')) AS term FROM d) GROUP BY 1),
  hd AS (SELECT kind, entity, count(DISTINCT t) AS holders FROM c GROUP BY 1, 2),
  nb AS (SELECT *, -log2(n / alone::DOUBLE) AS bits FROM tg JOIN w USING (term) JOIN hd USING (kind, entity) WHERE n >= 0.5 * alone),
  told AS (SELECT kind, entity, term, CASE WHEN bits <= 0.5 THEN 'remove' ELSE 'generalise' END AS act FROM nb WHERE log2((SELECT count(*) FROM (SELECT DISTINCT text FROM documents)) / holders::DOUBLE) - bits >= 4),
  ws AS (SELECT t, term, max(act) AS act FROM (SELECT DISTINCT t, kind, entity FROM c) JOIN told USING (kind, entity) GROUP BY 1, 2),
  tg2 AS (SELECT t, string_split_regex(t, '\p{{L}}{{4,}}') AS g, regexp_extract_all(t, '\p{{L}}{{4,}}') AS m FROM (SELECT DISTINCT t FROM ws)),
  wp AS (SELECT *, (sum(length(a) + length(m)) OVER (PARTITION BY t ORDER BY i) - length(m))::BIGINT AS s FROM (SELECT t, i, g[i] AS a, m[i] AS m FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM tg2))),
  wt AS (SELECT wp.t, s, s + length(m) AS e, act FROM wp JOIN ws ON ws.t = wp.t AND ws.term = lower(m) WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.t = wp.t AND b.s < wp.s + length(wp.m) AND wp.s < b.e)),
  sp AS (SELECT r, kind, s, e, 'remove' AS act FROM b UNION ALL SELECT d.r, 4, s, e, act FROM wt JOIN d ON d.t = wt.t),
  j AS (SELECT r, string_agg(['email', 'ip', 'card', 'phone', 'term'][kind + 1] || ':' || s || ':' || e, ',' ORDER BY kind, s) AS spans, string_agg(['email', 'ip', 'card', 'phone', 'term'][kind + 1] || ':' || s || ':' || e, ',' ORDER BY kind, s) FILTER (kind < 4) AS base,
    count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c, count(*) FILTER (kind = 3) AS d, count(*) FILTER (kind = 4 AND act = 'remove') AS x, count(*) FILTER (kind = 4 AND act = 'generalise') AS y FROM sp GROUP BY 1)
SELECT doc_id, coalesce(a, 0) AS n_email, coalesce(b, 0) AS n_ip, coalesce(c, 0) AS n_card, coalesce(j.d, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(x, 0) AS n_terms_removed, coalesce(y, 0) AS n_terms_generalised
FROM d LEFT JOIN j USING (r)"""
