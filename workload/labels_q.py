"""Label mapping, catalog and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import labels as lb
from pulsegrid.sources import recordings as rec
from pulsegrid.sources import registry as reg
from workload import metrics_q as mq
from workload.base import EV, r, table
from workload.registry import query

NAMES = {"click": "JAWS", "signup": "LEFT", "purchase": "RIGHT", "view": "REST"}


def events(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("session_id"), "event_id", F.when(F.col("event_id") % 7 == 0, None).otherwise(F.concat(F.lit(" "), F.upper("event_type"))).alias("raw"), "event_type", "value")


RAW = "e AS (SELECT user_id AS session_id, event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE ' ' || upper(event_type) END AS raw, event_type, value FROM events)"


@query(f"""WITH {RAW} SELECT session_id, event_id, CASE WHEN raw IS NULL THEN 'REST' ELSE coalesce(CASE lower(trim(raw)) WHEN 'click' THEN 'JAWS' WHEN 'signup' THEN 'LEFT' WHEN 'purchase' THEN 'RIGHT' WHEN 'view' THEN 'REST' END, 'UNKNOWN') END AS canonical_label FROM e""")
def map_labels(spark, sf):
    return events(spark, sf).select("session_id", "event_id", lb.canonical_label("raw", NAMES).alias("canonical_label"))


@query(f"WITH {RAW} SELECT DISTINCT raw FROM e WHERE raw IS NOT NULL AND lower(trim(raw)) NOT IN ('click', 'signup', 'purchase', 'view')")
def unknown_labels(spark, sf):
    return lb.unknown_labels(events(spark, sf), "raw", NAMES)


@query(f"WITH {RAW} SELECT session_id, event_id, CASE WHEN raw IS NULL THEN 'missing' WHEN trim(raw) = 'VIEW' THEN 'norm' ELSE trim(raw) END AS label FROM e")
def normalize_label(spark, sf):
    return events(spark, sf).select("session_id", "event_id", lb.normalize_label("raw", {"VIEW": "norm"}).alias("label"))


@query("""WITH s AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'ONSET' WHEN 'signup' THEN 'ACTIVE' WHEN 'view' THEN 'OFFSET' ELSE 'INACTIVE' END AS st FROM events)
SELECT event_id, st AS jaw_4state, CASE WHEN st = 'INACTIVE' THEN 'NON_CLENCH' ELSE 'CLENCH' END AS clench_vs_nonclench, CASE WHEN st = 'ACTIVE' THEN 'ACTIVE' ELSE 'OTHER' END AS active_vs_other,
  CASE WHEN event_type IN ('view', 'error') THEN 'NON_CLENCH' ELSE 'CLENCH' END AS jaw_binary, CASE event_type WHEN 'click' THEN 'ACTIVE' WHEN 'signup' THEN 'ACTIVE' WHEN 'view' THEN 'REST' WHEN 'error' THEN 'BASELINE' ELSE 'OTHER' END AS display FROM s JOIN events USING (event_id)""")
def remap_event_task(spark, sf):
    e = F.col("event_type")
    st = lb.lookup(e, {"click": "ONSET", "signup": "ACTIVE", "view": "OFFSET"}, F.lit("INACTIVE"))
    seg = lb.lookup(e, {"click": "LEFT", "signup": "RIGHT", "view": "REST", "error": "BASELINE"}, F.lit("PAUSE"))
    return table(spark, sf, "events").select("event_id", *[lb.event_task_label(st, t).alias(t) for t in lb.EVENT_TASK_LABELS],
                                             lb.jaw_binary(seg).alias("jaw_binary"), lb.display_label(seg, ["LEFT", "RIGHT"]).alias("display"))


TASKS = f"WITH {mq.PR}"


@query(f"{TASKS} SELECT event_id, CASE WHEN y = 'REST' THEN 'REST' ELSE 'ACTIVE' END AS y FROM pr")
def remap_active_vs_rest(spark, sf):
    return lb.active_vs_rest(mq.predictions(spark, sf).select("event_id", "y"), "y")


@query(f"""{TASKS} SELECT 'left_vs_all' AS task, event_id, CASE WHEN y = 'LEFT' THEN y ELSE 'ALL' END AS y FROM pr UNION ALL SELECT 'right_vs_all', event_id, CASE WHEN y = 'RIGHT' THEN y ELSE 'ALL' END FROM pr
UNION ALL SELECT 'left_vs_right', event_id, y FROM pr WHERE y <> 'REST'""")
def remap_one_vs_all(spark, sf):
    rows = mq.predictions(spark, sf).select("event_id", "y")
    parts = [lb.one_vs_all(rows, t, "y").select(F.lit(t).alias("task"), "event_id", "y") for t in ("left_vs_all", "right_vs_all", "left_vs_right")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""{TASKS} SELECT 'left_right_2class' AS task, event_id, y FROM pr WHERE y <> 'REST' UNION ALL SELECT 'left_right_3class', event_id, y FROM pr UNION ALL SELECT 'jaw_vs_rest', event_id, y FROM pr WHERE y = 'REST'""")
def remap_coarse_task(spark, sf):
    rows = mq.predictions(spark, sf).select("event_id", "y")
    parts = [lb.coarse_task(rows, t, "y").select(F.lit(t).alias("task"), "event_id", "y") for t in ("left_right_2class", "left_right_3class", "jaw_vs_rest")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT user_id AS session_id, count(*) AS n FROM events WHERE user_id IN (1, 2, 3) GROUP BY 1")
def session_subset(spark, sf):
    return lb.slice_sessions(events(spark, sf), [1, 2, 3]).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT l_suppkey AS session_id FROM lineitem WHERE l_suppkey NOT IN (SELECT user_id FROM events)")
def missing_sessions(spark, sf):
    wanted = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("session_id"))
    return lb.missing_sessions(wanted, events(spark, sf).select("session_id").distinct())


FILES = """f AS (SELECT s_suppkey AS session_id, n_name AS family, CASE WHEN s_suppkey % 9 = 0 THEN 'notes-' || s_suppkey || '.csv' ELSE 'LR-' || (s_suppkey % 12 + 1) || '-' || (s_suppkey % 28 + 1) || '-26-(' || (s_suppkey % 3 + 1) || ').csv' END AS filename
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def files(spark, sf):
    k = F.col("s_suppkey")
    name = F.when(k % 9 == 0, F.concat(F.lit("notes-"), k.cast("string"), F.lit(".csv"))).otherwise(
        F.concat(F.lit("LR-"), (k % 12 + 1).cast("string"), F.lit("-"), (k % 28 + 1).cast("string"), F.lit("-26-("), (k % 3 + 1).cast("string"), F.lit(").csv")))
    return table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        k.alias("session_id"), F.col("n_name").alias("family"), name.alias("filename"))


@query(f"""WITH {FILES}, p AS (SELECT *, CASE WHEN filename LIKE 'LR%' THEN make_date(2026, (session_id % 12 + 1)::INT, (session_id % 28 + 1)::INT) END AS parsed_date, CASE WHEN filename LIKE 'LR%' THEN (session_id % 3 + 1)::INT END AS run_index FROM f)
SELECT session_id, family, filename, strftime(parsed_date, '%Y-%m-%d') AS parsed_date, run_index, row_number() OVER (PARTITION BY family ORDER BY parsed_date NULLS FIRST, run_index NULLS LAST, filename) AS session_rank FROM p""")
def session_catalog(spark, sf):
    return rec.session_catalog(files(spark, sf)).withColumn("parsed_date", F.date_format("parsed_date", "yyyy-MM-dd"))


@query(f"WITH {FILES} SELECT session_id, trim(regexp_replace(lower(filename), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM f")
def file_slugs(spark, sf):
    return files(spark, sf).select("session_id", lb.slug("filename").alias("slug"))


@query("""WITH c AS (SELECT s_suppkey % 40 AS key, n_name AS subject, CASE s_suppkey % 3 WHEN 0 THEN 'HR' WHEN 1 THEN 'LR' ELSE 'LRJ' END AS protocol_family, CASE WHEN s_acctbal > 0 THEN 'main' ELSE 'stress' END AS trust_tier FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT 'main_lr' AS part, key, count(*) AS n FROM c WHERE protocol_family = 'LR' AND trust_tier = 'main' GROUP BY 2 UNION ALL SELECT 'duplicate', key, count(*) FROM c GROUP BY 2 HAVING count(*) > 1""")
def contract_registry(spark, sf):
    k = F.col("s_suppkey")
    c = table(spark, sf, "supplier").select((k % 40).alias("key"), F.element_at(F.array(F.lit("HR"), F.lit("LR"), F.lit("LRJ")), (k % 3 + 1).cast("int")).alias("protocol_family"),
                                            F.when(F.col("s_acctbal") > 0, "main").otherwise("stress").alias("trust_tier"))
    main = reg.contracts_for(c, "LR", "main").groupBy("key").agg(F.count(F.lit(1)).alias("n")).select(F.lit("main_lr").alias("part"), "key", "n")
    return main.unionByName(reg.duplicate_keys(c).select(F.lit("duplicate").alias("part"), "key", "n"))


@query("""SELECT 'event_id' AS column, 0 AS rank, 1.0::DOUBLE AS whole_fraction, count(*) FILTER (event_id <> 0) AS nonzero FROM events""".replace("'event_id' AS column, 0 AS rank", "'marker' AS \"column\", 2 AS rank").replace("count(*) FILTER (event_id <> 0)", "count(*) FILTER (event_type <> 'view')"))
def detect_marker_column(spark, sf):
    e = table(spark, sf, "events").select("value", "event_id", F.when(F.col("event_type") == "view", 0).otherwise(1).alias("marker"))
    return rec.detect_marker_column(e, ["value", "event_id", "marker"])
