"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits, in Spark SQL.

Every word n-gram is hashed once; the top bits of the hash choose a bin and each bin keeps its least value. An empty
bin takes the value of the first filled bin in an order of bins that is its own and the same for all documents. The
low bits of all bins, in hexadecimal, are the fingerprint. Two unequal values agree in their low bits by chance with
probability 2**-bits, which `likeness` takes off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.tables import number_rows, partitions

BINS, BIN_BITS, DIGITS = 128, 7, 2  # two hexadecimal digits: 8 bits a bin
VALUE_BITS = 63 - BIN_BITS


def _shift(x: Column, n: int) -> Column:
    return F.call_function("shiftright", x, F.lit(n))


def with_fingerprint(df: DataFrame, text_col: str, out: str, n: int = 5) -> DataFrame:
    """Add the fingerprint of ``text_col`` as ``out``.

    Words are what spaces, tabs and line ends separate. A text of fewer than ``n`` words is one n-gram of them all. Null, empty and
    blank texts share one fingerprint of zeros. Equal texts have equal fingerprints.
    """
    w, h, s, m = (f"_{out}_{x}" for x in ("words", "hashes", "sorted", "mins"))
    gram = lambda i: F.xxhash64(*[F.get(F.col(w), i + k) for k in range(n)]).bitwiseAND(F.lit((1 << 63) - 1))
    starts = F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0)))
    bin_of = lambda x: _shift(x, VALUE_BITS).cast("int")
    text = F.coalesce(F.col(text_col), F.lit(""))
    for blank in "\n\t\r":
        text = F.replace(text, F.lit(blank), F.lit(" "))
    step = (
        df.withColumn(w, F.filter(F.split(text, " "), lambda x: x != ""))
        .withColumn(h, F.when(F.size(w) > 0, F.transform(starts, gram)).otherwise(F.array().cast("array<bigint>")))
        .withColumn(s, F.sort_array(h))
        .withColumn(m, F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(F.col(s), i - 1)))))
    )
    value = lambda x: F.struct(bin_of(x).alias("bin"), x.alias("value"))
    order = lambda b: F.transform(m, lambda x: F.struct(F.xxhash64(b, bin_of(x)).alias("order"), x.alias("value")))
    empty = F.array_except(F.sequence(F.lit(0), F.lit(BINS - 1)), F.transform(m, bin_of))
    filled = F.sort_array(F.concat(F.transform(m, value), F.transform(empty, lambda b: F.struct(b.alias("bin"), F.array_min(order(b))["value"].alias("value")))))
    low = F.lit([f"{i:0{DIGITS}x}" for i in range(16**DIGITS)])
    packed = F.array_join(F.transform(filled, lambda x: F.get(low, x["value"].bitwiseAND(F.lit(16**DIGITS - 1)).cast("int"))), "")
    return step.withColumn(out, F.when(F.size(m) > 0, packed).otherwise(F.lit("0" * DIGITS * BINS))).drop(w, h, s, m)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1, chance agreement taken off."""
    digits = lambda x, i: F.substring(x, i * DIGITS + 1, F.lit(DIGITS))
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: digits(a, i) == digits(b, i))) / BINS
    chance = 2.0 ** (-4 * DIGITS)
    return F.greatest(F.lit(0.0), (same - chance) / (1 - chance))


def with_next(df: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """Add ``next_<column>`` from the following row in ascending ``order``; after the last row comes the first.

    Rows are dealt to ranges whose bounds are rows of the table; the row at each bound is also sent to the range before
    it, so the texts are shuffled once. Only the bounds (one per range) reach the driver. Rows equal in all of
    ``order`` share a range.
    """
    spark = df.sparkSession
    key = F.struct(*order)
    numbered = number_rows(df.select(*order), order, "__row")
    total = numbered.count()
    step = max(1, -(-total // (2 * partitions(spark))))
    bounds = numbered.where(F.col("__row") % step == 0).distinct()
    bounds = sorted((tuple(r[c] for c in order) for r in bounds.collect()), key=lambda t: [(v is not None, v) if v is not None else (False, 0) for v in t])
    bounds = list(dict.fromkeys(bounds))
    if not bounds:
        return df.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    kinds = {c: df.schema[c].dataType for c in order}
    listed = F.array(*[F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(order, b)]) for b in bounds])
    n = len(bounds)
    placed = df.withColumn("__bounds", listed).withColumn("__bucket", F.size(F.filter("__bounds", lambda b: b <= key)) - 1).withColumn(
        "__edge", F.array_contains("__bounds", key)).drop("__bounds")
    before = F.when(F.col("__bucket") == 0, n - 1).otherwise(F.col("__bucket") - 1)
    homes = F.when(F.col("__edge"), F.array(F.struct(F.col("__bucket").alias("__home"), F.lit(False).alias("__copy"), F.lit(0).alias("__late")),
                                           F.struct(before.alias("__home"), F.lit(True).alias("__copy"), F.lit(1).alias("__late"))))
    homes = homes.otherwise(F.array(F.struct(F.col("__bucket").alias("__home"), F.lit(False).alias("__copy"), F.lit(0).alias("__late"))))
    dealt = placed.select("*", F.inline(homes))
    window = Window.partitionBy("__home").orderBy("__late", *order)
    followed = dealt.select("*", *[F.lead(c).over(window).alias(f"next_{c}") for c in columns])
    return followed.where(~F.col("__copy")).drop("__bucket", "__edge", "__home", "__copy", "__late")


def fingerprint_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and their likeness to the edited and to the next text.

    The edited text has its last quarter (code points, rounded down) replaced by as many from the beginning of the
    next document in ascending id, or by all of a shorter one; equal ids go by text hash. Null texts count as empty.
    """
    base = df.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    base = with_fingerprint(base.withColumn("_hash", F.xxhash64("_text")), "_text", "_print", n)
    rows = with_next(base, ["_doc", "_hash"], ["_text", "_print"])
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), (F.col("n_chars") - quarter).cast("int")), F.substring("next__text", F.lit(1), quarter))
    rows = rows.withColumn("n_chars", F.char_length("_text").cast("bigint")).withColumn("_edited", edited)
    rows = with_fingerprint(rows, "_edited", "_edited_print", n)
    return rows.select(
        F.col("_doc").alias(id_col), "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        F.col("_print").alias("fingerprint"), F.col("_edited_print").alias("edited_fingerprint"),
        likeness(F.col("_print"), F.col("_edited_print")).alias("near_edited"), likeness(F.col("_print"), F.col("next__print")).alias("near_next"))
