"""Personal data and the words that give it away, found and taken out with Spark SQL functions alone.

Four fixed kinds of identifiers (email, ip, card, phone) are the protected entities. A term is a word near them. Over
all different texts of the corpus, P(entity | term) is the share of the texts with the term in which it stands near the
entity, and -log2 of it is what remains unknown of the entity to a reader of the term; the pointwise mutual information
is the entity's own information less that rest. A term whose rest is at most ``remove_bits`` is removed, one up to
``generalise_bits`` is generalised to its first letter, in every text that holds the entity. Texts without an entity keep
every word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.runtime import materialize

KINDS = ("email", "ip", "card", "phone")
# Each match starts where a run of its characters starts or where the last match ended, and never gives a character back:
# the same matches as the plain patterns, in time linear in the text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
TERM = r"\p{L}{4,}"
GENERAL = "term"
BROADCAST_TERMS = 1_000_000  # terms handed to every task at most; beyond it Spark shuffles both sides
BROADCAST_TEXTS = 100_000  # texts with disclosing terms handed to every task at most
BLOCK = 256  # pieces of a text summed at once


def running(sizes: Column) -> Column:
    """Sums of the earlier elements of an array of numbers, in blocks, so that long arrays are not copied per element."""
    def within(block: Column) -> Column:
        start = F.struct(F.array().cast("array<bigint>").alias("done"), F.lit(0).cast("bigint").alias("sum"))
        return F.aggregate(block, start, lambda s, x: F.struct(F.concat(s["done"], F.array(s["sum"])).alias("done"), (s["sum"] + x).alias("sum")))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int")), lambda k: within(F.slice(sizes, k * BLOCK + 1, F.lit(BLOCK))))
    start = F.struct(F.array().cast("array<struct<done:array<bigint>,sum:bigint>>").alias("done"), F.lit(0).cast("bigint").alias("sum"))
    shifted = F.aggregate(blocks, start, lambda s, b: F.struct(
        F.concat(s["done"], F.array(F.struct(b["done"].alias("done"), s["sum"].alias("sum")))).alias("done"), (s["sum"] + b["sum"]).alias("sum")))["done"]
    sums = F.flatten(F.transform(shifted, lambda b: F.transform(b["done"], lambda x: x + b["sum"])))
    return F.when(F.size(sizes) > 0, sums).otherwise(F.array().cast("array<bigint>"))


def _luhn(digits: Column) -> Column:
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c >= "5", 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda s, x: s + x) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return match.rlike(f"^{part}(?:\\.{part}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(8, 15) if kind == "phone" else F.lit(True)


def _entity(kind: str, match: Column) -> Column:
    return F.lower(match) if kind == "email" else match if kind == "ip" else F.regexp_replace(match, "[^0-9]", "")


def _span(k: int, kind: str, gaps: Column, places: Column, reach: int):
    """The span of match i of a kind, or null: ``gaps`` are the pieces between the matches, ``places`` their sizes summed."""
    def span(match: Column, i: Column) -> Column:
        left, right, at = F.get(gaps, i), F.get(gaps, i + 1), F.get(places, i)
        start, first = at["chars"] + F.char_length(left), at["bytes"] + F.octet_length(left)
        before = F.when(F.char_length(left) > reach, F.regexp_replace(F.right(left, F.lit(reach)), r"^\p{L}+", "")).otherwise(left)
        after = F.when(F.char_length(right) > reach, F.regexp_replace(F.left(right, F.lit(reach)), r"\p{L}+$", "")).otherwise(right)
        return F.when(_valid(kind, match), F.struct(
            F.lit(k).alias("kind"), start.alias("start"), (start + F.char_length(match)).alias("end"), first.alias("from"), (first + F.octet_length(match)).alias("to"),
            _entity(kind, match).alias("entity"), before.alias("before"), after.alias("after")))

    return span


SPAN = "struct<kind:int,start:bigint,end:bigint,from:bigint,to:bigint,entity:string,before:string,after:string>"


def with_entities(docs: DataFrame, text_col: str = "text", reach: int = 100, out: str = "__found") -> DataFrame:
    """``docs`` with ``out``: an array of the base spans by kind, then start.

    ``start`` and ``end`` count code points, ``from`` and ``to`` bytes (end exclusive); ``before`` and ``after`` are up to
    ``reach`` code points on either side, not beyond the neighbouring match of the kind, without words cut in two.
    A null text has none.
    """
    text = F.col(text_col)
    none = F.array().cast(f"array<{SPAN}>")
    for kind in KINDS:
        need = NEEDS[kind]
        there = text.contains(need) if need else text.rlike("[0-9][\\x20-]?[0-9]")
        docs = docs.withColumn(f"__m_{kind}", F.when(there, F.regexp_extract_all(text, F.lit(PATTERNS[kind]), 0)))
    for kind in KINDS:
        m = F.col(f"__m_{kind}")
        if kind == "card":  # most numbers are too short to be one
            any_valid = F.exists(m, lambda x: F.length(x) >= 16)
        else:
            any_valid = F.size(m) > 0
        docs = docs.withColumn(f"__g_{kind}", F.when(any_valid, F.split(text, PATTERNS[kind], -1)))
    for kind in KINDS:
        m, g = F.col(f"__m_{kind}"), F.col(f"__g_{kind}")
        sizes = lambda f: F.zip_with(F.slice(g, 1, F.size(m)), m, lambda x, y: (f(x) + f(y)).cast("bigint"))
        docs = docs.withColumn(f"__p_{kind}", F.when(g.isNotNull(), F.zip_with(running(sizes(F.char_length)), running(sizes(F.octet_length)), lambda c, b: F.struct(c.alias("chars"), b.alias("bytes")))))
    found = []
    for k, kind in enumerate(KINDS):
        spans = F.filter(F.transform(f"__m_{kind}", _span(k, kind, F.col(f"__g_{kind}"), F.col(f"__p_{kind}"), reach)), lambda x: x.isNotNull())
        found.append(F.when(F.col(f"__g_{kind}").isNotNull(), spans).otherwise(none))
    names = [f"__{x}_{kind}" for x in "mgp" for kind in KINDS]
    return docs.withColumn(out, F.concat(*found)).drop(*names)


def disclosing_terms(rows: DataFrame, texts: DataFrame, generalise_bits: float = 1.0, remove_bits: float = 0.5, min_texts: int = 3, min_information: float = 4.0) -> DataFrame:
    """``entity, term, bits, action`` (remove or generalise): terms that give an entity away, over all different texts.

    ``rows`` carry ``hash`` and ``found`` of texts with entities, ``texts`` the ``hash`` and ``text`` of all. A term
    counts only with ``min_texts`` different texts in which it stands near the entity, and only if it tells at least
    ``min_information`` bits of it (an entity that is everywhere is no secret).
    """
    different = rows.groupBy("hash").agg(F.any_value("found").alias("found"))
    near = F.regexp_extract_all(F.lower(F.concat_ws(" ", F.col("x.before"), F.col("x.after"))), F.lit(TERM), 0)
    mentions = different.select("hash", F.explode("found").alias("x"))
    key = F.struct(F.col("x.kind").alias("kind"), F.col("x.entity").alias("value")).alias("entity")
    pairs = materialize(mentions.select("hash", key, F.explode(near).alias("term")).distinct())
    together = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both")).where(F.col("both") >= min_texts)
    floor = 2.0 ** -generalise_bits
    # texts with the term near any entity are a lower bound of all its texts: most common words end here
    reachable = pairs.select("hash", "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("around"))
    likely = materialize(together.join(reachable, "term").where(F.col("both") >= floor * F.col("around")).select("entity", "term", "both"))
    terms = materialize(likely.select("term").distinct())
    few = F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms
    words = texts.select("hash", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), 0))).alias("term"))
    spread = words.join(few, "term").groupBy("term", "hash").agg(F.lit(1).alias("one")).groupBy("term").agg(F.count(F.lit(1)).alias("alone"))
    holders = mentions.select("hash", key).distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("holders"))
    total = texts.agg(F.count_distinct("hash")).first()[0]
    bits = -F.log2(F.col("both") / F.col("alone"))
    known = likely.join(spread, "term").where(F.col("both") >= floor * F.col("alone")).join(holders, "entity")
    told = F.log2(F.lit(float(total)) / F.col("holders")) - bits
    return known.where(told >= min_information).select("entity", "term", bits.alias("bits"), F.when(bits <= remove_bits, "remove").otherwise("generalise").alias("action"))


def _word_spans(rows: DataFrame) -> DataFrame:
    """``hash, term, start, end, from, to`` of every term of the texts in ``rows`` (hash, text)."""
    cut = rows.select("hash", F.split("text", TERM, -1).alias("g"), F.regexp_extract_all("text", F.lit(TERM), 0).alias("m")).where(F.size("m") > 0)
    sizes = lambda f: F.zip_with(F.slice("g", 1, F.size("m")), F.col("m"), lambda x, y: (f(x) + f(y)).cast("bigint"))
    placed = cut.select("hash", "g", "m", running(sizes(F.char_length)).alias("c"), running(sizes(F.octet_length)).alias("b"))
    one = placed.select("hash", F.inline(F.arrays_zip(F.slice("g", 1, F.size("m")).alias("gap"), F.col("m").alias("word"), F.col("c").alias("c"), F.col("b").alias("b"))))
    start, first = F.col("c") + F.char_length("gap"), F.col("b") + F.octet_length("gap")
    return one.select("hash", F.lower("word").alias("term"), start.alias("start"), (start + F.char_length("word")).alias("end"), first.alias("from"), (first + F.octet_length("word")).alias("to"))


def text_key(text: Column) -> Column:
    """Two hashes of a text: rows equal in both hold the same text."""
    return F.struct(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))


def _by_key(df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Join with a table of one row per ``hash``: by broadcast while its rows are counted to be few, else by a shuffle."""
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_TEXTS else keys, "hash", how)


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 100, generalise_bits: float = 1.0, remove_bits: float = 0.5,
               min_texts: int = 3, min_information: float = 4.0) -> DataFrame:
    """``id_col``, ``hash`` (`text_key`) and ``spans`` of every row: structs of kind, start, end (code points), from, to (bytes), action.

    The base kinds are 0 to 3 in the order of `KINDS` with action remove; kind 4 are disclosing terms with their action.
    Spans are sorted by kind, then start; a term that meets a base span is left out. Rows of equal text get equal spans.
    Null and empty texts have none; repeated rows and repeated texts count as one text; an empty table gives an empty
    result; texts of any length are taken whole; other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("hash"))
    every = materialize(with_entities(rows, "text", reach, "found").select("id", "hash", "found"))
    held = every.where(F.size("found") > 0)
    told = materialize(disclosing_terms(held, rows.select("hash", "text"), generalise_bits, remove_bits, min_texts, min_information))
    mentions = held.select("hash", F.explode("found").alias("x")).select("hash", F.struct(F.col("x.kind").alias("kind"), F.col("x.entity").alias("value")).alias("entity")).distinct()
    worst = materialize(told.join(mentions, "entity").groupBy("hash", "term").agg(F.max("action").alias("action")))  # "remove" sorts after "generalise"
    texts = _by_key(rows, materialize(worst.select("hash").distinct()), "left_semi").groupBy("hash").agg(F.any_value("text").alias("text"))
    words = _word_spans(texts).join(worst, ["hash", "term"])
    extra = materialize(words.groupBy("hash").agg(F.array_sort(F.collect_list(F.struct("start", "end", "from", "to", "action"))).alias("extra")))  # one text's words
    shape = lambda x, kind, action: F.struct(kind.alias("kind"), *[x[c].alias(c) for c in ("start", "end", "from", "to")], action.alias("action"))
    base = F.transform("found", lambda x: shape(x, x["kind"], F.lit("remove")))
    free = F.filter("extra", lambda w: ~F.exists("found", lambda x: (x["start"] < w["end"]) & (w["start"] < x["end"])))
    more = F.transform(free, lambda w: shape(w, F.lit(len(KINDS)), w["action"]))
    with_spans = _by_key(held, extra, "left").select("id", "hash", F.when(F.col("extra").isNull(), base).otherwise(F.concat(base, more)).alias("spans"))
    return with_spans.unionByName(every.where(F.size("found") == 0).select("id", "hash", base.alias("spans"))).withColumnRenamed("id", id_col)


def digest(spans: Column, base_only: bool = False) -> Column:
    """Spans as ``kind:start:end``, comma-joined in their order."""
    names = F.array(*[F.lit(k) for k in (*KINDS, GENERAL)])
    kept = F.filter(spans, lambda x: x["kind"] < len(KINDS)) if base_only else spans
    return F.array_join(F.transform(kept, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, spans: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with entities and removed terms replaced by ``[kind]``, generalised ones by their first letter and a star.

    ``spans`` as from `find_spans`, over the same texts. Overlapping spans become one, named by the one that starts first.
    """
    names = F.array(*[F.lit(f"[{k}]") for k in (*KINDS, GENERAL)])
    by_text = materialize(spans.where(F.size("spans") > 0).select("hash", F.col("spans").alias("__spans")).dropDuplicates(["hash"]))
    raw = F.col(text_col).cast("binary")
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).cast("bigint").alias("at"))

    def piece(first: Column, last: Column) -> Column:
        return F.substring(raw, (first + 1).cast("int"), (last - first).cast("int")).cast("string")

    def step(s: Column, x: Column) -> Column:
        mark = F.when(x["action"] == "remove", F.get(names, x["kind"])).otherwise(F.concat(F.left(piece(x["from"], x["to"]), F.lit(1)), F.lit("*")))
        fresh = F.struct(F.concat(s["parts"], F.array(piece(s["at"], x["from"]), mark)).alias("parts"), x["to"].alias("at"))
        return F.when(x["from"] >= s["at"], fresh).otherwise(F.struct(s["parts"].alias("parts"), F.greatest(s["at"], x["to"]).alias("at")))

    order = F.array_sort(F.transform("__spans", lambda x: F.struct(*[x[c].alias(c) for c in ("from", "to", "kind", "action")])))
    whole = F.aggregate(order, start, step, lambda s: F.concat(F.array_join(s["parts"], ""), piece(s["at"], F.octet_length(text_col).cast("bigint"))))
    keyed = docs.withColumn("hash", text_key(F.col(text_col))) if "hash" not in docs.columns else docs
    joined = keyed.alias("d").join(by_text.alias("s"), F.col("d.hash") == F.col("s.hash"), "left").select("d.*", "s.__spans")
    return joined.withColumn(text_col, F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(whole)).select(*docs.columns)
