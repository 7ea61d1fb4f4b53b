"""Line deduplication: exact repeats and lines within a few edits, by a segment-partition edit join, all in Spark SQL.

A line within ``edits`` edits of a line of length l keeps at least one of l's ``edits + 1`` segments unchanged, at a
place that the lengths bound. So every line stores its own segments and probes the few substrings at which a segment of
an equal or shorter line can sit. Lines that meet are filtered by parity sketches of letters and letter pairs (an edit
flips few bits) and verified by a banded bit-parallel edit distance: one machine word holds the band of a column.

A document is known by its id and a hash of its text: rows equal in both are one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.runtime import materialize

DOC = ["_doc", "_hash"]
BROADCAST_ROWS = 2_000_000  # line hashes (8 bytes each) handed to every task at most; beyond it Spark shuffles both sides


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All lines: ``_doc, _hash, at`` (0-based), ``line``, ``length`` in code points, and two hashes ``h1, h2``."""
    split = docs.select(F.col(id_col).alias("_doc"), F.xxhash64(text_col).alias("_hash"), F.posexplode(F.split(text_col, "\n", -1)).alias("at", "line"))
    return split.select(*DOC, "at", "line", F.char_length("line").alias("length"), F.xxhash64("line").bitwiseAND(F.lit(-2)).alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def segment_keys(lines: DataFrame, edits: int) -> DataFrame:
    """``h1, key, own`` per line: its own segments, and the substrings where a shorter or equal line's may sit.

    A line of length l is cut into ``edits + 1`` segments whose sizes differ by one at most, longer ones last. One row
    per (length gap, segment, shift) keeps the generated code small.
    """
    parts = edits + 1
    places = [(gap, i, shift) for gap in range(parts) for i in range(1, parts + 1)
              for shift in range(max(1 - i, gap - (parts - i)), min(i - 1, gap + parts - i) + 1)]
    table = F.array(*[F.struct(F.lit(g).alias("gap"), F.lit(i).alias("i"), F.lit(s).alias("shift")) for g, i, s in places])
    rows = lines.select("h1", "line", "length", F.inline(table)).withColumn("other", F.col("length") - F.col("gap"))
    rows = rows.withColumn("base", F.expr(f"int(other div {parts})")).withColumn("extra", F.col("other") % parts)
    longer = F.greatest(F.col("i") - 1 - parts + F.col("extra"), F.lit(0))  # longer segments before this one
    size = F.col("base") + F.when(F.col("i") > parts - F.col("extra"), 1).otherwise(0)
    rows = rows.select("h1", "line", "length", "other", "i", (F.col("base") * (F.col("i") - 1) + longer + 1 + F.col("shift")).alias("start"), size.alias("size"),
                       ((F.col("gap") == 0) & (F.col("shift") == 0)).alias("own"))
    inside = rows.where((F.col("start") >= 1) & (F.col("start") + F.col("size") - 1 <= F.col("length")))
    return inside.select("h1", F.xxhash64("i", "other", F.substring("line", F.col("start"), F.col("size"))).alias("key"), "own")


def sketches(line: Column) -> Column:
    """Parities of the counts of letters and of letter pairs, 64 bits each."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))
    start = F.struct(F.lit("").alias("last"), F.lit(0).cast("bigint").alias("one"), F.lit(0).cast("bigint").alias("two"))
    step = lambda s, c: F.struct(c.alias("last"), s["one"].bitwiseXOR(bit(c)).alias("one"), s["two"].bitwiseXOR(bit(F.concat(s["last"], c))).alias("two"))
    return F.aggregate(F.split(line, ""), start, step)


def within_edits(a: Column, b: Column, edits: int) -> Column:
    """Whether the edit distance of two strings is at most ``edits``; lengths must be at least ``2 * edits + 1``.

    Bit t of a word stands for row ``j - edits + t`` of column j, so the band moves down with the columns. The distance
    is followed along the band's lower edge to the last row of ``a``, and along that row to the last column.
    """
    k, w = edits, 2 * edits + 1
    mask = (1 << w) - 1
    big = lambda v: F.lit(v).cast("bigint")
    right = lambda x, by: F.call_function("shiftright", x, by)

    def compare(pair: Column) -> Column:
        """``pair`` is a lambda variable, so the two letter arrays are made once."""
        chars, m = pair["a"], pair["m"]

        def equal(c: Column, j: Column) -> Column:
            return sum((F.when(F.get(chars, j + (t - k)) == c, big(1 << t)).otherwise(big(0)) for t in range(w)), big(0))

        def step(s: Column, x: Column) -> Column:
            vp, vn, j = s["vp"], s["vn"], s["j"]
            d0 = (((x.bitwiseAND(vp)) + vp).bitwiseXOR(vp)).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(big(mask))

            def rest(d: Column) -> Column:
                hp = vn.bitwiseOR(F.bitwise_not(d.bitwiseOR(vp))).bitwiseAND(big(mask))
                hn = d.bitwiseAND(vp)
                down = right(d, F.lit(1))
                row = m - j + k  # bit of a's last row in this column
                bit = lambda v: right(v, row).bitwiseAND(big(1))
                edge = F.when(d.bitwiseAND(big(1 << (w - 1))) == 0, 1).otherwise(0)
                dist = s["dist"] + F.when(row >= w - 1, edge).otherwise((bit(hp) - bit(hn)).cast("int"))
                return F.struct(hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp))).bitwiseAND(big(mask)).alias("vp"), down.bitwiseAND(hp).alias("vn"), (j + 1).alias("j"), dist.alias("dist"))

            return F.get(F.transform(F.array(d0), rest), F.lit(0))

        first = F.struct(big(((1 << (k + 1)) - 1) << k).alias("vp"), big(0).alias("vn"), F.lit(1).alias("j"), F.lit(k).alias("dist"))
        return F.aggregate(F.transform(pair["b"], equal), first, step)["dist"] <= k

    pair = F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b"), F.char_length(a).alias("m"))
    return (F.abs(F.char_length(a) - F.char_length(b)) <= k) & F.get(F.transform(F.array(pair), compare), F.lit(0))


def near_pairs(lines: DataFrame, edits: int) -> DataFrame:
    """Pairs ``a, b`` (h1 of each) of different lines within ``edits`` edits; ``lines`` as from `lines_of`, long enough.

    Line hashes lose their last bit here: two lines that differ in it alone count as one (one chance in 2**63 a pair).
    """
    # each key row is two numbers; the last bit of the second tells own segments from probes
    tag = F.when(F.col("own"), F.col("h1").bitwiseOR(F.lit(1))).otherwise(F.col("h1").bitwiseAND(F.lit(-2)))
    rows = segment_keys(lines, edits)
    keyed = rows.select("key", tag.alias("tag"))
    # one shuffle: a key matters if two lines meet at it and it is a segment of one of them
    line, own, here = F.col("tag").bitwiseAND(F.lit(-2)), F.col("tag").bitwiseAND(F.lit(1)), Window.partitionBy("key")
    members = (
        keyed.select("key", line.alias("h1"), own.alias("own"), F.min(line).over(here).alias("lo"), F.max(line).over(here).alias("hi"), F.max(own).over(here).alias("any"))
        .where((F.col("lo") != F.col("hi")) & (F.col("any") == 1)).select("key", "h1", (F.col("own") == 1).alias("own")).distinct()
    )
    members = materialize(members)
    met = materialize(members.select("h1").distinct())
    texts = materialize(_few(lines.select("h1", "line", "length"), met, "h1").groupBy("h1", "line", "length").agg(F.lit(1).alias("_")).drop("_"))
    sketched = materialize(texts.select("h1", "length", sketches(F.col("line")).alias("s")).select("h1", "length", "s.one", "s.two"))
    m = materialize(members.join(sketched, "h1"))
    a, b = m.where("own").alias("a"), m.alias("b")
    close = (
        (F.col("a.h1") != F.col("b.h1")) & (~F.col("b.own") | (F.col("a.h1") < F.col("b.h1")))
        & F.col("b.length").between(F.col("a.length"), F.col("a.length") + edits)
        & (F.bit_count(F.col("a.one").bitwiseXOR(F.col("b.one"))) <= 2 * edits)
        & (F.bit_count(F.col("a.two").bitwiseXOR(F.col("b.two"))) <= 4 * edits)
    )
    pairs = materialize(a.join(b, (F.col("a.key") == F.col("b.key")) & close).select(
        F.least("a.h1", "b.h1").alias("a"), F.greatest("a.h1", "b.h1").alias("b")).distinct())
    left = texts.select(F.col("h1").alias("a"), F.col("line").alias("line_a"))
    right = texts.select(F.col("h1").alias("b"), F.col("line").alias("line_b"))
    both = materialize(pairs.join(left, "a").join(right, "b"))
    return both.where(within_edits(F.col("line_a"), F.col("line_b"), edits)).select("a", "b").distinct()


def _few(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose key is in ``keys``: by broadcast while the keys are counted to be few, else by a shuffle."""
    small = keys.count() <= BROADCAST_ROWS
    return df.join(F.broadcast(keys) if small else keys, on, "left_semi")


def _each_once(lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """``lines`` with the most frequent ones reduced to one row each: at most 20,000 lines hold a 20,000th of all rows."""
    total = firsts.agg(F.sum("n")).first()[0] or 0
    hot = materialize(firsts.where(F.col("n") >= max(50, total / 20_000)).select("h1", "h2"))
    few = F.broadcast(hot)
    once = lines.join(few, ["h1", "h2"], "left_semi").groupBy("h1", "h2", "line", "length").agg(F.count(F.lit(1)).alias("n"))
    names = ["h1", "line", "length"]
    return lines.join(few, ["h1", "h2"], "left_anti").select(*names).unionByName(once.select(*names))


def find_repeats(docs: DataFrame, edits: int = 2, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text", exact_chars: int | None = None) -> DataFrame:
    """Lines to remove: ``_doc, _hash, at, near`` (false: an exact repeat, true: only near an earlier line).

    Among equal lines the first stays, in the order of document id (null first), text hash and line number. A first
    line also goes if a line with an earlier first place is within ``edits`` edits. Lines of fewer than ``min_chars``
    code points have no near lines, those of fewer than ``exact_chars`` (``min_chars`` if not given) always stay. Null
    and empty texts have no lines, rows equal in id and text are one document, an empty table gives an empty result.
    """
    if min_chars < 2 * edits + 1:
        raise ValueError("min_chars must be at least 2 * edits + 1")
    lines = lines_of(docs, id_col, text_col).where(F.col("length") >= min(min_chars, min_chars if exact_chars is None else exact_chars))
    place = F.struct(*DOC, "at")
    firsts = materialize(lines.groupBy("h1", "h2").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("n")))
    pairs = near_pairs(_each_once(lines.where(F.col("length") >= min_chars), firsts), edits)
    a = firsts.select(F.col("h1").alias("a"), F.col("place").alias("place_a"))
    b = firsts.select(F.col("h1").alias("b"), F.col("place").alias("place_b"))
    near = materialize(
        pairs.join(a, "a").join(b, "b")
        .select(F.when(F.col("place_a") < F.col("place_b"), F.col("b")).otherwise(F.col("a")).alias("h1"), F.greatest("place_a", "place_b").alias("place")).distinct())
    # only lines that repeat, or are near an earlier one, can lose a place
    suspect = firsts.where(F.col("n") > 1).select("h1", "h2", "place").join(near.select("h1", "place", F.lit(True).alias("near")), ["h1", "place"], "left")
    once = near.join(firsts.where(F.col("n") == 1).select("h1", "place"), ["h1", "place"]).select("place.*", F.lit(True).alias("near"))
    spots = lines.select("h1", "h2", *DOC, "at").join(suspect, ["h1", "h2"])
    again = spots.where((place != F.col("place")) | F.coalesce("near", F.lit(False))).select(*DOC, "at", ((place == F.col("place")) & F.coalesce("near", F.lit(False))).alias("near"))
    return again.unionByName(once).distinct()


def dedup_report(docs: DataFrame, repeats: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: number of lines, exact and near repeats among them, and whether all its text went."""
    gone = repeats.groupBy(*DOC).agg(F.sum((~F.col("near")).cast("bigint")).alias("n_exact"), F.sum(F.col("near").cast("bigint")).alias("n_near"))
    base = docs.select(F.col(id_col).alias("_doc"), F.xxhash64(text_col).alias("_hash"),
                       F.when(F.coalesce(F.length(text_col), F.lit(0)) > 0, F.size(F.split(text_col, "\n", -1))).otherwise(0).cast("bigint").alias("n_lines"))
    same = F.col("d._doc").eqNullSafe(F.col("g._doc")) & (F.col("d._hash") == F.col("g._hash"))
    return base.alias("d").join(gone.alias("g"), same, "left").select(
        F.col("d._doc").alias(id_col), "n_lines", F.coalesce("n_exact", F.lit(0)).alias("n_exact"), F.coalesce("n_near", F.lit(0)).alias("n_near"))


def remove_lines(docs: DataFrame, repeats: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines of ``repeats`` cut out of ``text_col``. A document that loses all its text is dropped.

    Columns other than the text stay as they are; texts without repeats, null and empty ones included, do not change.
    """
    cut = repeats.groupBy(*DOC).agg(F.array_sort(F.collect_set("at")).alias("__cut"))  # bounded by one document's lines
    keyed = docs.withColumn("__text_hash", F.xxhash64(text_col))
    same = F.col(f"d.{id_col}").eqNullSafe(F.col("g._doc")) & (F.col("d.__text_hash") == F.col("g._hash"))
    kept = F.filter(F.split(text_col, "\n", -1), lambda line, i: ~F.array_contains(F.col("__cut"), i))
    text = F.when(F.col("__cut").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    joined = keyed.alias("d").join(cut.alias("g"), same, "left").select("d.*", "g.__cut")
    return joined.withColumn(text_col, text).where(F.col("__cut").isNull() | (F.trim(text_col) != "")).select(*docs.columns)
