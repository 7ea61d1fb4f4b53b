"""Bindings of the generic operators to the driver's tables.

``events`` is read as single-channel recordings (one per user), ``lineitem`` as four-channel
recordings (one per supplier), ``embeddings`` as windows that are already cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.timeline import Timeline, number_rows

EVENTS_TL = Timeline(chunk_rows=32)
ITEMS_TL = Timeline(chunk_rows=256)
CHANNELS = ["ch1", "ch2", "ch3", "ch4"]
FS = 1.0

MARKERS = {"view": 0, "signup": 1, "purchase": 2, "click": 3, "error": 4}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # timestamps in the files carry no zone and are compared as UTC
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hours() -> Column:
    """Hours of ``ts`` since 2024 to six digits, rounded by the product as the SQL's round does; by the decimal digits exact halves may fall on the other side."""
    h = (F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 3600000000.0
    return F.round(h * 1e6) / 1e6


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), "event_id", "ts", "value", F.col("event_type").alias("label")
    )
    code = F.lit(None).cast("int")
    for name, c in MARKERS.items():
        code = F.when(F.col("label") == name, F.lit(c)).otherwise(code)
    numbered = number_rows(rows, ["session_id"], ["ts", "event_id"], F.date_trunc("day", "ts"))
    return numbered.withColumn("marker", code)


def item_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("session_id"), "l_orderkey", "l_linenumber", "l_shipdate",
        F.col("l_quantity").alias("ch1"), (F.col("l_extendedprice") / 1000.0).alias("ch2"),
        F.round(F.col("l_discount") * 100.0).alias("ch3"), F.round(F.col("l_tax") * 100.0).alias("ch4"),
        F.col("l_returnflag").alias("label"),
    )
    order = ["l_shipdate", "l_orderkey", "l_linenumber"]
    return number_rows(rows, ["session_id"], order, F.date_trunc("month", "l_shipdate"))


EV = """ev AS (
  SELECT user_id AS session_id, event_id, ts, value, event_type AS label,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample_idx,
    CASE event_type WHEN 'view' THEN 0 WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2
      WHEN 'click' THEN 3 WHEN 'error' THEN 4 END AS marker
  FROM events)"""

LI = """li AS (
  SELECT l_suppkey AS session_id, l_quantity AS ch1, l_extendedprice / 1000.0 AS ch2,
    round(l_discount * 100.0) AS ch3, round(l_tax * 100.0) AS ch4, l_returnflag AS label,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS sample_idx
  FROM lineitem)"""

# runs of equal marker code, nonzero ones only
MK = """mk AS (
  SELECT session_id, marker AS code, min(sample_idx) AS start_sample, max(sample_idx) AS end_sample,
    count(*) AS run_length_samples
  FROM (SELECT *, sample_idx - row_number() OVER (PARTITION BY session_id, marker ORDER BY sample_idx) AS g FROM ev)
  WHERE marker <> 0 GROUP BY session_id, marker, g)"""


# Added before rounding so that exact halves (means over 2, 4, 8 rows) fall on the same side in both engines.
NUDGE = 2.7e-10


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """Round the named doubles (and turn -0.0 into 0.0) so results compare across engines."""
    return df.withColumns({c: F.round(F.col(c) + NUDGE, digits) + F.lit(0.0) for c in columns})


def r(expr: str, digits: int = 6) -> str:
    return f"(round({expr} + {NUDGE}, {digits}) + 0.0)"


def peaks_sql(name: str, src: str, keys: str, pos: str, value: str, height: str | None = None, distance: int = 1) -> str:
    """Tables up to ``{name}`` (keys, pos, v, prom): plateau middles above ``height``, thinned highest first, with prominence.

    Needs WITH RECURSIVE. ``src`` has consecutive positions per series.
    """
    k = [c.strip() for c in keys.split(",")]
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in k)
    high = f"AND v >= {height}" if height else ""
    return f"""{name}_g AS (SELECT {keys}, {pos} AS i, {value} AS v, {pos} - row_number() OVER (PARTITION BY {keys}, {value} ORDER BY {pos}) AS g FROM {src}),
  {name}_r AS (SELECT {keys}, v, min(i) AS s, max(i) AS e FROM {name}_g GROUP BY {keys}, v, g),
  {name}_t AS (SELECT {keys}, v, s, e, (s + e) // 2 AS m FROM (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM {name}_r WINDOW w AS (PARTITION BY {keys} ORDER BY s)) WHERE a < v AND b < v {high}),
  {name}_o AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY v DESC, m DESC) AS k FROM {name}_t),
  {name}_w AS (SELECT DISTINCT {keys}, 0::BIGINT AS k, []::BIGINT[] AS kept FROM {name}_o
    UNION ALL SELECT {', '.join(f'o.{c}' for c in k)}, o.k, CASE WHEN len(list_filter(kept, lambda x: abs(x - m) < {distance})) > 0 THEN kept ELSE list_append(kept, m) END FROM {name}_w w JOIN {name}_o o ON {on('o', 'w')} AND o.k = w.k + 1),
  {name}_k AS (SELECT {keys}, unnest(arg_max(kept, k)) AS m FROM {name}_w GROUP BY {keys}),
  {name}_b AS (SELECT {', '.join(f't.{c}' for c in k)}, t.m, v, s, e, coalesce(max(x.i) FILTER (x.i < s AND x.x > v), -1) AS lo, coalesce(min(x.i) FILTER (x.i > e AND x.x > v), 1000000000000) AS hi
    FROM {name}_t t JOIN {name}_k y ON {on('t', 'y')} AND t.m = y.m JOIN (SELECT {keys}, i, v AS x FROM {name}_g) x ON {on('x', 't')} GROUP BY {', '.join(f't.{c}' for c in k)}, t.m, v, s, e),
  {name} AS (SELECT {', '.join(f'b.{c}' for c in k)}, b.m AS {pos}, b.v AS v, b.v - greatest(min(x.x) FILTER (x.i <= b.m), min(x.x) FILTER (x.i >= b.m)) AS prom
    FROM {name}_b b JOIN (SELECT {keys}, i, v AS x FROM {name}_g) x ON {on('x', 'b')} AND x.i > b.lo AND x.i < b.hi GROUP BY {', '.join(f'b.{c}' for c in k)}, b.m, b.v)"""
