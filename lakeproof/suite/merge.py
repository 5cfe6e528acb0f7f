"""Merge-mode, ledger, measure and report queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import buckets, ledger, measures, quality, reconcile, stitch
from ..operators.skew import numbered
from ..session import cut_lineage, scratch_path
from ..sources import writers
from .base import SQL, query
from .proof import REBUILT, STRAY, rebuilt_orders, stray_orders
from .quality import order_specs


@query("dedup_latest", """SELECT * EXCLUDE rn REPLACE (CAST(l_shipdate AS VARCHAR) AS l_shipdate) FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC,
    l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) AS rn FROM lineitem) WHERE rn = 1""")
def _(t):
    return measures.dedup_latest(t.lineitem, ["l_orderkey", "l_linenumber"], "l_shipdate").withColumn(
        "l_shipdate", F.col("l_shipdate").cast("string"))


def order_batch(orders):
    """A change batch: newer and older versions of some orders, and new ones."""
    newer = orders.where("o_orderpriority = '2-HIGH'").withColumns(
        {"o_orderdate": F.col("o_orderdate") + F.expr("interval 1 day"), "o_totalprice": F.col("o_totalprice") + 1})
    older = orders.where("o_orderpriority = '3-MEDIUM'").withColumns(
        {"o_orderdate": F.col("o_orderdate") - F.expr("interval 1 day"), "o_totalprice": F.col("o_totalprice") - 1})
    fresh = orders.where("o_orderpriority = '5-LOW'").withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    return newer.unionByName(older).unionByName(fresh).unionByName(
        newer.withColumn("o_orderdate", F.col("o_orderdate") - F.expr("interval 2 hour")))


BATCH = """b AS (SELECT * REPLACE (o_orderdate + INTERVAL 1 DAY AS o_orderdate, o_totalprice + 1 AS o_totalprice) FROM orders WHERE o_orderpriority = '2-HIGH'
  UNION ALL SELECT * REPLACE (o_orderdate + INTERVAL 22 HOUR AS o_orderdate, o_totalprice + 1 AS o_totalprice) FROM orders WHERE o_orderpriority = '2-HIGH'
  UNION ALL SELECT * REPLACE (o_orderdate - INTERVAL 1 DAY AS o_orderdate, o_totalprice - 1 AS o_totalprice) FROM orders WHERE o_orderpriority = '3-MEDIUM'
  UNION ALL SELECT * REPLACE (-o_orderkey - 1 AS o_orderkey) FROM orders WHERE o_orderpriority = '5-LOW')"""


@query("stitch_full", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'")
def _(t):
    return stitch.stitch(t.orders, t.orders.where("o_orderstatus = 'O'"), "full").select("o_orderkey", "o_totalprice")


@query("stitch_append", """SELECT event_type, COUNT(*) AS rows FROM (SELECT event_type FROM events WHERE event_type NOT IN ('click')
  UNION ALL SELECT event_type FROM events WHERE event_type = 'click' AND value > 10) GROUP BY 1""")
def _(t):
    batch = t.events.where("event_type = 'click' and value > 10")
    once = stitch.stitch(t.events, batch, "append", load_key="event_type")
    return stitch.stitch(once, batch, "append", load_key="event_type").groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"))


@query("stitch_upsert", f"""WITH {BATCH}, u AS (SELECT *, 1 AS f FROM b UNION ALL SELECT *, 0 FROM orders)
SELECT o_orderkey, o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY o_orderdate DESC, f DESC) AS rn FROM u) WHERE rn = 1""")
def _(t):
    out = stitch.stitch(t.orders, order_batch(t.orders), "upsert", ["o_orderkey"], "o_orderdate")
    return out.select("o_orderkey", "o_totalprice", F.col("o_orderdate").cast("string").alias("o_orderdate"))


@query("upsert_partitions", f"""WITH {BATCH}, c AS (SELECT * FROM b WHERE o_orderstatus <> 'P'), u AS (SELECT *, 1 AS f FROM c UNION ALL SELECT *, 0 FROM orders)
SELECT o_orderkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderkey, o_orderstatus ORDER BY o_orderdate DESC, f DESC) AS rn FROM u) WHERE rn = 1""")
def _(t):
    name = f"orders_{uuid.uuid4().hex[:8]}"
    writers.write_partitioned(t.orders, name, ["o_orderstatus"], scratch_path(t.spark, name))
    for _ in range(2):
        stitch.upsert_partitions(name, order_batch(t.orders).where("o_orderstatus <> 'P'"), ["o_orderkey", "o_orderstatus"], "o_orderdate", ["o_orderstatus"])
    return t.spark.table(name).select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("string").alias("o_orderdate"))


@query("merge_bucketed", f"""WITH {BATCH}, c AS (SELECT * REPLACE (o_totalprice + 1 AS o_totalprice, o_orderdate + INTERVAL 1 DAY AS o_orderdate) FROM orders WHERE o_custkey % 4 = 0),
u AS (SELECT *, 0 AS f FROM orders UNION ALL SELECT *, 1 FROM b UNION ALL SELECT *, 2 FROM c)
SELECT o_orderkey, o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY o_orderdate DESC, f DESC) AS rn FROM u)
WHERE rn = 1 AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH')""")
def _(t):
    """Two batches and then deletions, merged into buckets that are never shuffled."""
    name = f"orders_{uuid.uuid4().hex[:8]}"
    buckets.create_bucketed(t.orders, name, ["o_orderkey"], "o_orderdate", slices=8, buckets=4)
    buckets.merge_bucketed(name, order_batch(t.orders))
    later = t.orders.where("o_custkey % 4 = 0").withColumns({"o_totalprice": F.col("o_totalprice") + 1, "o_orderdate": F.expr("o_orderdate + interval 1 day")})
    buckets.merge_bucketed(name, later)
    gone = t.orders.where("o_orderpriority = '2-HIGH'").select("o_orderkey", F.lit("2099-01-01").cast("timestamp_ntz").alias("o_orderdate"), F.lit(True).alias("gone"))
    buckets.merge_bucketed(name, gone, deleted="gone")
    return buckets.read_bucketed(t.spark, name).select("o_orderkey", "o_totalprice", F.col("o_orderdate").cast("string").alias("o_orderdate"))


@query("stitch_delete_flag", f"""WITH {BATCH}, n AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY o_orderdate DESC) AS rn FROM b)
SELECT o_orderkey, o_totalprice, 'N' AS is_deleted FROM n WHERE rn = 1
UNION ALL SELECT o_orderkey, o_totalprice, 'Y' FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)""")
def _(t):
    out = stitch.stitch(t.orders, order_batch(t.orders), "delete_flag", ["o_orderkey"], "o_orderdate")
    return out.select("o_orderkey", "o_totalprice", "is_deleted")


@query("stitch_roll_out", """SELECT y, COUNT(*) AS rows FROM (SELECT year(o_orderdate) AS y FROM orders WHERE year(o_orderdate) BETWEEN 1997 AND 1999
  UNION ALL SELECT 2000 FROM orders WHERE year(o_orderdate) = 2000 AND o_orderstatus = 'F') GROUP BY y""")
def _(t):
    target = t.orders.withColumn("y", F.year("o_orderdate"))
    batch = target.where("y = 2000 and o_orderstatus = 'F'")
    out = stitch.stitch(target, batch, "roll_out", load_key="y", window=(1997, 2000))
    return out.groupBy(F.col("y").cast("long").alias("y")).agg(F.count(F.lit(1)).alias("rows"))


@query("stitch_scd2", """WITH v AS (SELECT user_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events),
c AS (SELECT * FROM v WHERE prev IS DISTINCT FROM event_type),
h AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nxt FROM c)
SELECT user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS valid_from, coalesce(strftime(nxt, '%Y-%m-%d %H:%M:%S'), '') AS valid_to, nxt IS NULL AS is_current FROM h""")
def _(t):
    feed = t.events.select("user_id", "ts", "event_type")
    first = stitch.stitch_scd2(None, feed.where("ts < '2024-01-15'"), ["user_id"], "ts")
    out = stitch.stitch(first, feed.where("ts >= '2024-01-10'"), "scd2", ["user_id"], "ts")
    text = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias(c)
    return out.where("is_version").select("user_id", "event_type", text("valid_from"), text("valid_to"), "is_current")


@query("stitch_scd2_late", SQL["stitch_scd2"])
def _(t):
    # three batches by a hash of the row, so that every batch has rows earlier than what is there
    feed = t.events.select("user_id", "ts", "event_type")
    history = None
    for i in (2, 0, 1):
        history = stitch.stitch_scd2(history, feed.where(F.pmod(F.xxhash64("user_id", "ts"), F.lit(3)) == i), ["user_id"], "ts")
    text = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias(c)
    return history.where("is_version").select("user_id", "event_type", text("valid_from"), text("valid_to"), "is_current")


@query("replace_table", """SELECT o_orderstatus, COUNT(*) AS rows FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1""")
def _(t):
    name = f"swap_{uuid.uuid4().hex[:8]}"
    writers.replace_table(t.orders, name)
    writers.replace_table(t.spark.table(name).where("o_orderpriority <> '5-LOW'"), name)
    return t.spark.table(name).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("rows"))


# ---- ledgers: events of users stand for batches, files and layers ----------------------------

@query("batch_state", """WITH e AS (SELECT user_id, ts, CASE event_type WHEN 'purchase' THEN 'C' WHEN 'error' THEN 'F' ELSE 'I' END AS s FROM events)
SELECT CAST(user_id AS VARCHAR) AS parent_batch_id, strftime(MIN(ts), '%Y-%m-%d %H:%M:%S') AS started, arg_max(s, ts) AS completion_status,
  CASE arg_max(s, ts) WHEN 'C' THEN 'Completed' WHEN 'F' THEN 'Failed' ELSE 'In Progress' END AS process_status,
  CASE WHEN arg_max(s, ts) = 'I' THEN '' ELSE strftime(MAX(ts), '%Y-%m-%d %H:%M:%S') END AS ended FROM e GROUP BY user_id""")
def _(t):
    status = F.when(F.col("event_type") == "purchase", "C").when(F.col("event_type") == "error", "F").otherwise("I")
    events = t.events.select(F.col("user_id").cast("string").alias("parent_batch_id"), F.lit("app").alias("source_system"),
                             status.alias("completion_status"), F.col("ts").alias("logged_at"))
    text = lambda c, n: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias(n)
    return ledger.batch_state(events).select("parent_batch_id", text("batch_start_date", "started"), "completion_status",
                                             "process_status", text("batch_end_date", "ended"))


@query("batch_ledger", "SELECT c_mktsegment AS parent_batch_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'F' WHEN c_mktsegment = 'MACHINERY' THEN 'I' ELSE 'C' END AS completion_status FROM customer GROUP BY ALL")
def _(t):
    name = f"batches_{uuid.uuid4().hex[:8]}"
    for row in t.customer.select("c_mktsegment").distinct().orderBy("c_mktsegment").collect():
        batch = row["c_mktsegment"]
        ledger.batch_open(t.spark, name, batch, "crm")
        ledger.batch_open(t.spark, name, batch, "crm")
        if batch != "MACHINERY":
            ledger.batch_close(t.spark, name, batch, "F" if batch == "BUILDING" else "C")
    return ledger.batch_state(t.spark.table(name)).select("parent_batch_id", "completion_status")


@query("file_audit", """SELECT event_type AS source_object_name, 'bronze' AS layer, COUNT(*) AS row_count FROM events GROUP BY 1""")
def _(t):
    name = f"audit_{uuid.uuid4().hex[:8]}"
    counts = t.events.groupBy(F.col("event_type").alias("source_object_name")).agg(F.count(F.lit(1)).alias("row_count"))
    ledger.file_audits(counts, name, "b1", "app", "bronze")
    return t.spark.table(name).select("source_object_name", "layer", "row_count")


@query("file_registry", """WITH f AS (SELECT 'events_' || strftime(ts, '%Y%m%d') || '_' || event_type || '.csv' AS file_name, COUNT(*) AS record_count FROM events GROUP BY 1)
SELECT file_name, record_count, 100 + row_number() OVER (ORDER BY file_name) AS file_id, regexp_replace(file_name, '[0-9]+', '*', 'g') AS pattern_name, 'b9' AS parent_batch_id FROM f""")
def _(t):
    name = F.concat(F.lit("events_"), F.date_format("ts", "yyyyMMdd"), F.lit("_"), F.col("event_type"), F.lit(".csv"))
    return ledger.file_registry(t.events.withColumn("_source_file_name", name), "b9", start=101)


@query("file_registry_listing", """WITH f AS (SELECT 'part_' || p_brand || '.csv' AS file_name, COUNT(*) AS record_count FROM part GROUP BY 1
  UNION ALL SELECT DISTINCT 'empty_' || p_size || '.csv', 0 FROM part) SELECT file_name, record_count, row_number() OVER (ORDER BY file_name) AS file_id FROM f""")
def _(t):
    named = t.part.select(F.concat(F.lit("part_"), F.col("p_brand"), F.lit(".csv")).alias("_source_file_name"))
    landed = named.select(F.col("_source_file_name").alias("file_name")).unionByName(
        t.part.select(F.concat(F.lit("empty_"), F.col("p_size").cast("string"), F.lit(".csv")).alias("file_name")))
    return ledger.file_registry(named, "b1", listing=landed).select("file_name", "record_count", "file_id")


LEDGER = """e AS (SELECT 'f' || user_id AS file_name, CASE event_type WHEN 'signup' THEN 'landing' WHEN 'view' THEN 'raw' WHEN 'click' THEN 'curated'
  WHEN 'purchase' THEN 'published' ELSE 'warehouse' END AS layer, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS n, value FROM events),
g AS (SELECT file_name, arg_max(n, ts) FILTER (WHERE layer = 'landing') AS a, arg_max(n, ts) FILTER (WHERE layer = 'raw') AS b,
  arg_max(n, ts) FILTER (WHERE layer = 'curated') AS c, arg_max(n, ts) FILTER (WHERE layer = 'published') AS d, arg_max(n, ts) FILTER (WHERE layer = 'warehouse') AS w,
  arg_max(CASE WHEN value > 100 THEN 'FAILED' ELSE 'DONE' END, ts) FILTER (WHERE layer = 'raw') AS raw_status,
  COUNT(*) FILTER (WHERE value > 100) AS failure_count FROM e GROUP BY 1)"""


def ledger_events(events):
    layers = {"signup": "landing", "view": "raw", "click": "curated", "purchase": "published", "error": "warehouse"}
    layer = F.create_map(*[F.lit(x) for kv in layers.items() for x in kv])[F.col("event_type")]
    return events.select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("file_name"), F.lit("b1").alias("batch_id"),
                         layer.alias("layer"), F.when(F.col("value") > 100, "FAILED").otherwise("DONE").alias("status"),
                         F.get_json_object("props", "$.k").cast("long").alias("record_count"), F.lit("").alias("message"),
                         F.col("ts").alias("logged_at"))


@query("ingestion_ledger", f"""WITH {LEDGER} SELECT file_name, coalesce(a, -1) AS landing_record_count, coalesce(b, -1) AS raw_record_count,
  coalesce(w, -1) AS warehouse_record_count, coalesce(raw_status, '') AS raw_status, failure_count FROM g""")
def _(t):
    out = ledger.ingestion_ledger(ledger_events(t.events))
    n = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    return out.select("file_name", n("landing_record_count"), n("raw_record_count"), n("warehouse_record_count"),
                      F.coalesce("raw_status", F.lit("")).alias("raw_status"), "failure_count")


@query("stage_count_drift", f"""WITH {LEDGER}, s AS (SELECT file_name, 'landing_to_raw' AS step, a - b AS lost FROM g UNION ALL SELECT file_name, 'raw_to_curated', b - c FROM g
  UNION ALL SELECT file_name, 'curated_to_published', c - d FROM g UNION ALL SELECT file_name, 'published_to_warehouse', d - w FROM g)
SELECT file_name, step, lost FROM s WHERE lost <> 0""")
def _(t):
    return ledger.stage_count_drift(ledger.ingestion_ledger(ledger_events(t.events))).drop("batch_id")


@query("ledger_parity", """WITH o AS (SELECT user_id AS k, COUNT(*) AS n FROM events GROUP BY 1), w AS (SELECT user_id AS k, COUNT(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1)
SELECT 'ledger' AS pair, false AS passed, CAST((SELECT CAST(COUNT(DISTINCT n) AS DOUBLE) FROM o) <> (SELECT COUNT(DISTINCT n) FROM w) AS BIGINT)
  + CAST((SELECT MIN(n) FROM o) <> (SELECT MIN(n) FROM w) AS BIGINT) + CAST((SELECT MAX(n) FROM o) <> (SELECT MAX(n) FROM w) AS BIGINT)
  + CAST((SELECT SUM(n) FROM o) <> (SELECT SUM(n) FROM w) AS BIGINT) + CAST((SELECT SUM(n * n) FROM o) <> (SELECT SUM(n * n) FROM w) AS BIGINT)
  + CAST((SELECT COUNT(*) FROM o) <> (SELECT COUNT(*) FROM w) AS BIGINT) * 2 AS failures""")
def _(t):
    count = lambda df: df.groupBy("user_id").agg(F.count(F.lit(1)).alias("record_count"))
    return ledger.ledger_parity(count(t.events), count(t.events.where("event_type <> 'error'")), ["user_id"]).summary()


@query("batch_failures", """SELECT user_id AS batch_id, CASE WHEN bool_or(event_type = 'error' AND value > 50) THEN 'F' ELSE 'C' END AS completion_status,
  COUNT(*) FILTER (WHERE event_type = 'error' AND value > 50) AS failures FROM events GROUP BY 1""")
def _(t):
    status = F.when((F.col("event_type") == "error") & (F.col("value") > 50), " Failed").otherwise("ok")
    return ledger.batch_failures(t.events.select(F.col("user_id").alias("batch_id"), status.alias("output_status")))


@query("batch_summary", """SELECT c_custkey AS parent_batch_id, c_name AS source_system, coalesce(f, 0) AS files, coalesce(r, 0) AS ingestion_rows FROM customer
LEFT JOIN (SELECT o_custkey, COUNT(DISTINCT o_orderdate) AS f FROM orders GROUP BY 1) ON o_custkey = c_custkey
LEFT JOIN (SELECT user_id, COUNT(DISTINCT event_type) AS r FROM events GROUP BY 1) ON user_id = c_custkey""")
def _(t):
    batches = t.customer.select(F.col("c_custkey").alias("parent_batch_id"), F.col("c_name").alias("source_system"))
    files = t.orders.select(F.col("o_custkey").alias("parent_batch_id"), F.col("o_orderdate").alias("file_id"))
    rows = t.events.select(F.col("user_id").alias("batch_id"), F.col("event_type").alias("file_id"))
    return ledger.batch_summary(batches, files, rows)


@query("latest_batches", "SELECT o_orderkey AS parent_batch_id, CAST(o_orderdate AS VARCHAR) AS started FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 5")
def _(t):
    b = t.orders.select(F.col("o_orderkey").alias("parent_batch_id"), F.col("o_orderdate").alias("batch_start_date"))
    return ledger.latest_batches(b).select("parent_batch_id", F.col("batch_start_date").cast("string").alias("started"))


# ---- measures and reports -------------------------------------------------------------------

AREA = "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Medical Affairs' WHEN o_orderpriority = '3-MEDIUM' THEN 'Field Sales' ELSE 'Other' END"


def calls_of(orders):
    roles = {"1-URGENT": "msl", "2-HIGH": "Medical", "3-MEDIUM": "Rep"}
    role = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in roles.items() for x in kv]), F.col("o_orderpriority")), F.lit("staff"))
    return orders.select(F.col("o_orderkey").alias("call_id"), F.col("o_custkey").alias("account_id"), role.alias("owner_role"), "o_orderdate")


@query("activity_view", f"""SELECT o_orderkey AS call_id, o_custkey AS account_id, coalesce(c_name, '') AS account_name, 'Field Sales' AS function_area
FROM ({STRAY}) o LEFT JOIN customer ON c_custkey = o_custkey WHERE {AREA} = 'Field Sales'""")
def _(t):
    accounts = t.customer.select(F.col("c_custkey").alias("account_id"), F.col("c_name").alias("account_name"))
    out = measures.activity_view(calls_of(stray_orders(t.orders)), accounts, "Field Sales")
    return out.select("call_id", "account_id", F.coalesce("account_name", F.lit("")).alias("account_name"), "function_area")


@query("function_area", f"SELECT o_orderkey AS call_id, {AREA} AS area FROM orders")
def _(t):
    from ..operators.mapping import function_area
    return calls_of(t.orders).select("call_id", function_area("owner_role").alias("area"))


@query("reach_frequency", "SELECT l_partkey, COUNT(DISTINCT l_suppkey) AS reach, COUNT(l_orderkey) AS frequency FROM lineitem GROUP BY 1")
def _(t):
    return measures.reach_frequency(t.lineitem, "l_partkey", "l_suppkey", "l_orderkey")


@query("child_measures", """SELECT o_orderkey, coalesce(detail_count, 0) AS detail_count, coalesce(negative_count, 0) AS negative_count, coalesce(expense_total, 0) AS expense_total, coalesce(event_count, 0) AS event_count
FROM orders LEFT JOIN (SELECT l_orderkey, COUNT(*) AS detail_count, COUNT(*) FILTER (WHERE l_returnflag = 'R') AS negative_count,
    CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS expense_total FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
LEFT JOIN (SELECT user_id, COUNT(*) AS event_count FROM events GROUP BY 1) ON user_id = o_orderkey""")
def _(t):
    lines = {"detail_count": F.count(F.lit(1)), "negative_count": F.count_if(F.col("l_returnflag") == "R"),
             "expense_total": F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double")}
    return measures.child_measures(t.orders.select("o_orderkey"), "o_orderkey", [
        (t.lineitem, "l_orderkey", lines), (t.events, "user_id", {"event_count": F.count(F.lit(1))})])


NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
         "pages", "benchmark", "labels", "conversations")
COUNTS = "\nUNION ALL ".join(f"SELECT '{'gold' if n in ('orders', 'lineitem') else 'bronze'}' AS layer, '{n}' AS \"table\", COUNT(*) AS rows, 'OK' AS flag FROM {n}" for n in NAMES)


def estate(t):
    layers = {"gold": {n: getattr(t, n) for n in ("orders", "lineitem")},
              "bronze": {n: getattr(t, n) for n in NAMES if n not in ("orders", "lineitem")}}
    layers["gold"]["no_orders"] = t.orders.where("o_totalprice < 0")
    layers["gold"]["gone"] = lambda: t.no_such_table
    return measures.estate_counts(t.spark, layers)


@query("estate_counts", f"""{COUNTS} UNION ALL SELECT 'gold', 'no_orders', COUNT(*), 'EMPTY' FROM orders WHERE o_totalprice < 0 UNION ALL SELECT 'gold', 'gone', -1, 'UNREADABLE'""")
def _(t):
    return estate(t)


@query("estate_totals", f"SELECT layer, COUNT(*) + CASE layer WHEN 'gold' THEN 2 ELSE 0 END AS tables, CAST(SUM(rows) AS BIGINT) AS rows FROM ({COUNTS}) GROUP BY layer")
def _(t):
    return measures.estate_totals(estate(t))


@query("failure_rollup", """WITH e AS (SELECT user_id, CASE WHEN value > 90 THEN 'event ' || event_id ELSE event_type || '.csv' END AS text, event_id FROM events WHERE event_type = 'error' OR value > 60),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY text, event_id) AS rn FROM e)
SELECT user_id, COUNT(*) AS failures, string_agg('- ' || text, chr(10) ORDER BY rn) FILTER (WHERE rn <= 20) AS message FROM n GROUP BY 1""")
def _(t):
    entry = F.struct(F.when((F.col("event_type") == "error") | (F.col("value") > 60), "Failed").otherwise("OK").alias("status"),
                     F.when(F.col("value") > 90, F.concat(F.lit("event "), F.col("event_id").cast("string"))).alias("message"),
                     F.concat(F.col("event_type"), F.lit(".csv")).alias("file_name"))
    return measures.failure_rollup(t.events.select("user_id", F.array(entry).alias("result")), "result", ["user_id"])


@query("recipient_list", r"""SELECT DISTINCT unnest(regexp_extract_all(text, '[\w.+-]+@[\w-]+\.[\w.]+')) AS recipient FROM documents""")
def _(t):
    return measures.recipient_list(t.documents, "text")


def positions(ordered):
    """The rows of an ordered frame with their place in it."""
    return numbered(cut_lineage(ordered.withColumn("place", F.monotonically_increasing_id())), ["place"], "position").drop("place")


@query("order_config", """SELECT step, name, row_number() OVER (ORDER BY step, name) AS position FROM (SELECT CAST(p_size AS VARCHAR) AS step, p_name AS name FROM part)""")
def _(t):
    rows = t.part.select(F.col("p_size").cast("string").alias("step"), F.col("p_name").alias("name"))
    return positions(measures.order_config(rows, "step", "name"))


@query("rank_duplicates", """SELECT base_name, cross_system, overlap, row_number() OVER (ORDER BY cross_system DESC, overlap DESC, base_name) AS position
FROM (SELECT p_name AS base_name, p_size % 2 = 0 AS cross_system, CASE WHEN p_size % 5 = 0 THEN 0.0 ELSE (p_size % 7) / 7.0 END AS overlap FROM part)""")
def _(t):
    overlap = F.when(F.col("p_size") % 5 != 0, (F.col("p_size") % 7) / 7.0)
    groups = t.part.select(F.col("p_name").alias("base_name"), (F.col("p_size") % 2 == 0).alias("cross_system"), overlap.alias("column_overlap"))
    return positions(measures.rank_duplicates(groups)).select("base_name", "cross_system", F.coalesce("column_overlap", F.lit(0.0)).alias("overlap"), "position")


@query("sample_result", "SELECT least(COUNT(*), 50) AS rows FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    return measures.sample_result(t.orders.where("o_orderstatus = 'F'")).agg(F.count(F.lit(1)).alias("rows"))


@query("ship_gate", f"""WITH {REBUILT}, q AS (SELECT COUNT(*) AS n FROM documents WHERE n_chars < 0)
SELECT false AS ready, '6 test(s) failing' AS reason, 75 AS readiness FROM q WHERE n = 0""")
def _(t):
    tables = {"orders": t.orders, "lineitem": t.lineitem, "customer": t.customer, "pages": t.pages}
    tests = quality.run_tests(t.spark, [s for s in order_specs() if s["columns"] != ["no_such_column"]], tables).where("status <> 'skipped'")
    recon = reconcile.reconcile(t.orders, rebuilt_orders(t.orders), ["o_orderkey"], scale=2, pair="orders").summary()
    return measures.ship_gate(t.documents.where("n_chars < 0"), tests, recon)
