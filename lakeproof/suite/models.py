"""Config-driven model, suggestion and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ledger
from ..plans import medallion, models, suggest
from ..session import scratch_path
from ..sources import evolving, files
from ..streaming import landing
from .base import SQL, query


def table_name(prefix):
    return f"{prefix}_{uuid.uuid4().hex[:8]}"


@query("active_queries", """SELECT CASE WHEN p_size < 5 THEN 'query_config_' || p_size ELSE lower(replace(p_name, ' ', '_')) END AS name,
  CASE WHEN p_type = 'ECONOMY' THEN '' ELSE 'select * from ' || p_brand END AS sql, CAST(p_size AS VARCHAR) AS ord,
  CASE WHEN p_type = 'ECONOMY' THEN 'empty SQL' WHEN p_type = 'PROMO' THEN 'inactive' ELSE '' END AS skipped FROM part""")
def _(t):
    cfg = t.part.select(
        F.when(F.col("p_size") < 5, " ").otherwise(F.concat(F.lit("gold."), F.initcap("p_name"))).alias("Target_Table"),
        F.when(F.col("p_type") == "ECONOMY", " ").otherwise(F.concat(F.lit("select * from "), F.col("p_brand"))).alias("query_text"),
        F.when(F.col("p_type") == "PROMO", "No").when(F.col("p_type") == "SMALL", " Yes").alias("is_active"),
        F.col("p_size").alias("execution_order"))
    return models.active_queries(cfg).fillna("", ["skipped"])


CONFIGURED = """select event_id, '{file_name}' as _source_file, '{batch_id}' as _batch_id, cast({file_id} as string) as pt_file_id
from {raw_filename} where event_type = '{batch_id}'"""


@query("run_config_query", "SELECT event_id, 'e.csv' AS _source_file, 'click' AS _batch_id, '7' AS pt_file_id FROM events WHERE event_type = 'click'")
def _(t):
    return models.run_config_query(t.spark, CONFIGURED, {"batch_id": "click", "file_name": "e.csv", "file_id": 7}, t.events)


@query("full_refresh_query", "SELECT event_id, '' AS _source_file, '' AS _batch_id, '' AS pt_file_id FROM events")
def _(t):
    df = models.full_refresh_query(t.spark, CONFIGURED, raw=t.events)
    return df.select("event_id", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("_source_file", "_batch_id", "pt_file_id")])


@query("build_models", """SELECT 'status' AS kind, n AS name, s AS value FROM (VALUES ('stg_orders', 'created'), ('stg_lines', 'created'), ('fct_revenue', 'created'), ('dim_bad', 'failed'), ('mart_bad', 'skipped'), ('rpt_gone', 'failed')) v(n, s)
UNION ALL SELECT 'rows', o_orderstatus, CAST(COUNT(*) AS VARCHAR) FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderstatus""")
def _(t):
    suffix = uuid.uuid4().hex[:8]
    silver, gold = f"silver_{suffix}", f"gold_{suffix}"
    todo = [
        {"name": "mart_bad", "sql": f"select * from {gold}.dim_bad", "depends_on": ["dim_bad"]},
        {"name": "fct_revenue", "depends_on": ["stg_orders", "stg_lines"],
         "sql": f"select o_orderstatus, count(*) as n from {silver}.stg_orders join {silver}.stg_lines on l_orderkey = o_orderkey group by 1"},
        {"name": "stg_orders", "fn": lambda s: t.orders}, {"name": "stg_lines", "fn": lambda s: t.lineitem.select("l_orderkey")},
        {"name": "dim_bad", "sql": f"select no_such_column from {silver}.stg_orders", "depends_on": ["stg_orders"]},
        {"name": "rpt_gone", "sql": "select 1", "needs": [f"{silver}.never_landed"]}]
    done = models.build_models(t.spark, todo, {"silver": silver, "gold": gold})
    built = t.spark.table(f"{gold}.fct_revenue")
    return done.select(F.lit("status").alias("kind"), "name", F.col("status").alias("value")).unionByName(
        built.select(F.lit("rows").alias("kind"), F.col("o_orderstatus").alias("name"), F.col("n").cast("string").alias("value")))


@query("incremental_model", """SELECT user_id, COUNT(DISTINCT event_type) AS kinds, 1 AS versions FROM events GROUP BY user_id""")
def _(t):
    return last_events(t, None)


@query("incremental_model_bucketed", SQL["incremental_model"])
def _(t):
    return last_events(t, 4)


def last_events(t, slices):
    """One row for each user, built in three increments."""
    name = table_name("last_event")

    def build(upto):
        def fn(spark, since):
            seen = t.events.where(F.col("ts") < upto)
            touched = seen if since is None else seen.join(seen.where(F.col("ts") >= F.lit(since)).select("user_id").distinct(), "user_id", "left_semi")
            return touched.groupBy("user_id").agg(F.countDistinct("event_type").alias("kinds"), F.max("ts").alias("ts"))
        return fn

    for upto in ("2024-01-10", "2024-01-20", "2025-01-01"):
        models.incremental_model(t.spark, build(upto), name, ["user_id"], "ts", slices)
    return t.spark.table(name).groupBy("user_id").agg(F.max("kinds").alias("kinds"), F.count(F.lit(1)).alias("versions"))


@query("suggest_types_catalog", """WITH c AS (SELECT p_brand AS "table", p_partkey AS ord, p_type, p_size, CASE p_type WHEN 'ECONOMY' THEN 'order date' WHEN 'STANDARD' THEN 'part code' WHEN 'PROMO' THEN 'is_open'
    WHEN 'SMALL' THEN 'net amount' WHEN 'MEDIUM' THEN 'ratio' ELSE 'blob' END AS col_name FROM part)
SELECT ord, CASE p_type WHEN 'ECONOMY' THEN 'DATE_LIKE' WHEN 'STANDARD' THEN 'KEY_LIKE' WHEN 'PROMO' THEN 'FLAG_LIKE' WHEN 'LARGE' THEN 'UNKNOWN' ELSE 'NUMERIC_LIKE' END AS category,
  CASE p_type WHEN 'ECONOMY' THEN 'DATE' WHEN 'PROMO' THEN CASE WHEN p_size <= 25 THEN 'BOOLEAN' ELSE 'INT' END WHEN 'SMALL' THEN CASE WHEN p_size % 3 = 0 THEN 'BIGINT' ELSE 'DECIMAL(18,2)' END
    WHEN 'MEDIUM' THEN CASE WHEN p_size % 3 = 0 THEN 'BIGINT' ELSE 'DOUBLE' END ELSE 'STRING' END AS target_type,
  CASE WHEN p_type = 'LARGE' OR (p_type = 'PROMO' AND p_size > 25) OR (p_type = 'MEDIUM' AND p_size % 3 <> 0) THEN 'NEEDS_REVIEW' ELSE 'AUTO_APPROVED' END AS review_status FROM c""")
def _(t):
    names = {"ECONOMY": "order date", "STANDARD": "part code", "PROMO": "is_open", "SMALL": "net amount", "MEDIUM": "ratio", "LARGE": "blob"}
    name = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("p_type")]
    cols = t.part.select(F.col("p_brand").alias("table"), name.alias("col_name"), F.col("p_partkey").alias("ord"),
                         F.when(F.col("p_type").isin("SMALL", "MEDIUM"), "numeric").alias("kind"),
                         F.when(F.col("p_size") % 3 == 0, 0).otherwise(2).alias("decimals"),
                         F.when(F.col("p_size") <= 25, 2).otherwise(9).alias("symbols"))
    return suggest.suggest_types_catalog(cols).select("ord", "category", "target_type", "review_status")


@query("suggest_types", """SELECT 'l_quantity' AS col_name, 'NUMERIC_LIKE' AS category, CASE WHEN bool_and(l_quantity = floor(l_quantity)) THEN 'BIGINT' ELSE 'DOUBLE' END AS target_type FROM lineitem
UNION ALL SELECT 'l_tax', 'NUMERIC_LIKE', CASE WHEN bool_and(l_tax = floor(l_tax)) THEN 'BIGINT' ELSE 'DOUBLE' END FROM lineitem
UNION ALL SELECT 'has_flag', 'FLAG_LIKE', CASE WHEN COUNT(DISTINCT l_linenumber % 2) <= 2 THEN 'BOOLEAN' ELSE 'INT' END FROM lineitem
UNION ALL SELECT 'is_many', 'FLAG_LIKE', CASE WHEN COUNT(DISTINCT l_linenumber) <= 2 THEN 'BOOLEAN' ELSE 'INT' END FROM lineitem
UNION ALL SELECT 'day', 'DATE_LIKE', 'DATE' FROM (SELECT 1 FROM lineitem LIMIT 1) UNION ALL SELECT 'kind', 'TEXT_LIKE', 'STRING' FROM (SELECT 1 FROM lineitem LIMIT 1)""")
def _(t):
    df = t.lineitem.select("l_quantity", "l_tax", (F.col("l_linenumber") % 2).alias("has_flag"), F.col("l_linenumber").alias("is_many"),
                           F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), F.col("l_returnflag").alias("kind"))
    return suggest.suggest_types(df, "lineitem").select("col_name", "category", "target_type")


@query("validate_mapping", """WITH m AS (SELECT p_partkey AS row, CASE WHEN p_size = 1 THEN '' ELSE p_brand END AS t, CASE WHEN p_size = 2 THEN '' ELSE p_name END AS c,
    CASE WHEN p_type = 'PROMO' THEN 'FLOAT' ELSE 'string' END AS k, CASE p_type WHEN 'SMALL' THEN 'needs_review' WHEN 'LARGE' THEN '?' ELSE 'AUTO_APPROVED' END AS s FROM part),
d AS (SELECT *, row_number() OVER (PARTITION BY t, c ORDER BY row) AS n FROM m)
SELECT row, 'target_table' AS field, 'empty' AS error FROM d WHERE t = '' UNION ALL SELECT row, 'target_column', 'empty' FROM d WHERE c = ''
UNION ALL SELECT row, 'target_type', 'unsupported' FROM d WHERE k = 'FLOAT' UNION ALL SELECT row, 'review_status', 'unsupported' FROM d WHERE s = '?'
UNION ALL SELECT row, 'review_status', 'not reviewed' FROM d WHERE s = 'needs_review' UNION ALL SELECT row, 'target_column', 'duplicate' FROM d WHERE n > 1 AND t <> '' AND c <> ''""")
def _(t):
    status = F.when(F.col("p_type") == "SMALL", "needs_review").when(F.col("p_type") == "LARGE", "?").otherwise("AUTO_APPROVED")
    rows = t.part.select(F.col("p_partkey").alias("row"), F.when(F.col("p_size") == 1, " ").otherwise(F.col("p_brand")).alias("target_table"),
                         F.when(F.col("p_size") == 2, None).otherwise(F.upper("p_name")).alias("target_column"),
                         F.when(F.col("p_type") == "PROMO", "FLOAT").otherwise("string").alias("target_type"), status.alias("review_status"))
    return suggest.validate_mapping(rows)


# Three batches of orders of two sources, by year of the order; the second batch runs twice.
LOADS = ("1", 1995, 1997), ("2", 1996, 1998), ("3", 1997, 1999)
MODES = {"full": {}, "append": {}, "upsert": {"keys": ("o_custkey",), "order_key": "o_orderdate"},
         "delete_flag": {"keys": ("o_custkey",), "order_key": "o_orderdate"},
         "roll_out": {"load_key": "load_no", "window": ("2", "3")}, "scd2": {"keys": ("o_custkey",), "order_key": "o_orderdate"}}


def batches_of(t, mode, config):
    """Run the batches of both sources through the lake; returns the published table and the two ledgers."""
    suffix = uuid.uuid4().hex[:8]
    names = {n: f"{n}_{mode}_{suffix}" for n in ("cur", "pub", "bat", "aud")}
    newest = Window.partitionBy("o_custkey", "o_orderdate").orderBy(F.desc("o_orderkey"))
    year = F.year("o_orderdate")
    rows = (t.orders.withColumn("rn", F.row_number().over(newest)).where("rn = 1").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
            .withColumn("part", F.concat(F.lit("y"), year.cast("string"))))
    for batch, first, last in LOADS:
        for source, side in (("crm", F.col("o_custkey") % 2 == 0), ("erp", F.col("o_custkey") % 2 == 1)):
            path = scratch_path(t.spark, f"landed-{batch}-{source}")
            files.land_files(rows.where(side & year.between(first, last)), path, "csv", by="part")
            obj = medallion.SourceObject(
                "orders", path, "*.csv", names["cur"], names["pub"], stitching=mode, **config,
                curated_query="""select cast(o_orderkey as bigint) as o_orderkey, cast(o_custkey as bigint) as o_custkey, cast(o_orderdate as date) as o_orderdate,
                  o_orderstatus, 'load-{batch_id}' as load_tag, '{file_name}' as _source_file, batch_id, cast({file_id} as string) as pt_file_id from {raw_filename}""",
                publish_query="""select o_orderkey, o_custkey, o_orderdate, o_orderstatus, substr(load_tag, 6, 1) as load_no, 'own-' || pt_file_id as file_tag
                  from {curated_db}.{curated_tbl_name} where batch_id in ('{batch_id}')""".replace(
                    ", 'own-' || pt_file_id as file_tag", f", 'src-{source}' as data_src_nm"))
            for _ in range(2 if batch == "2" else 1):
                medallion.run_batch(t.spark, [obj], f"{batch}{source}", source, names["bat"], names["aud"])
    return names


LOADED = """r AS (SELECT o_orderkey, o_custkey, o_orderdate, o_orderstatus, 'src-' || CASE WHEN o_custkey % 2 = 0 THEN 'crm' ELSE 'erp' END AS src FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1),
b AS (SELECT r.*, l AS load_no FROM r, (VALUES ('1', 1995, 1997), ('2', 1996, 1998), ('3', 1997, 1999)) v(l, lo, hi) WHERE year(o_orderdate) BETWEEN lo AND hi)"""
NEWEST = "SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, load_no DESC) AS n FROM b"
DAY = "strftime(o_orderdate, '%Y-%m-%d') AS day"
MODE_SQL = {
    "full": f"SELECT o_orderkey, {DAY}, src, load_no, '' AS state FROM b WHERE load_no = '3'",
    "append": f"SELECT o_orderkey, {DAY}, src, load_no, '' AS state FROM b",
    "upsert": f"SELECT o_orderkey, {DAY}, src, load_no, '' AS state FROM ({NEWEST}) WHERE n = 1",
    "delete_flag": f"""SELECT o_orderkey, {DAY}, src, load_no, CASE WHEN load_no = '3' THEN 'N' ELSE 'Y' END AS state FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY load_no DESC, o_orderdate DESC) AS n FROM b) WHERE n = 1""",
    "roll_out": f"SELECT o_orderkey, {DAY}, src, load_no, '' AS state FROM b WHERE load_no IN ('2', '3')",
    "scd2": f"""SELECT o_orderkey, day, src, load_no, CASE WHEN nxt IS NULL THEN 'open' ELSE strftime(nxt, '%Y-%m-%d') END AS state FROM (
      SELECT *, {DAY}, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS nxt FROM (
        SELECT *, lag((o_orderkey, o_orderstatus, load_no)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS prev FROM (
          SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY load_no DESC) AS m FROM b) WHERE m = 1)
      WHERE prev IS DISTINCT FROM (o_orderkey, o_orderstatus, load_no))""",
}


def register_mode(mode):
    @query(f"run_batch_{mode}", f"WITH {LOADED} {MODE_SQL[mode]}")
    def _(t):
        names = batches_of(t, mode, MODES[mode])
        out = t.spark.table(names["pub"])
        state = F.col("is_deleted") if mode == "delete_flag" else F.lit("")
        if mode == "scd2":
            out, state = out.where("is_version"), F.when(F.col("is_current"), "open").otherwise(F.col("valid_to").cast("string"))
        return out.select("o_orderkey", F.col("o_orderdate").cast("string").alias("day"), F.col("data_src_nm").alias("src"), "load_no", state.alias("state"))


for _mode in MODES:
    register_mode(_mode)


@query("run_batch", """WITH y AS (SELECT o_custkey % 2 AS side, CAST(year(o_orderdate) AS VARCHAR) AS part, COUNT(*) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1 GROUP BY ALL)
SELECT v.b || CASE WHEN side = 0 THEN 'crm' ELSE 'erp' END AS batch_id, CAST(SUM(n) AS BIGINT) AS rows, 'C' AS completion_status FROM y, (VALUES ('1', 1995, 1997), ('2', 1996, 1998), ('3', 1997, 1999)) v(b, lo, hi)
WHERE CAST(part AS INT) BETWEEN lo AND hi GROUP BY 1""")
def _(t):
    names = batches_of(t, "append", MODES["append"])
    state = ledger.batch_state(t.spark.table(names["bat"])).select(F.col("parent_batch_id").alias("batch_id"), "completion_status")
    return t.spark.table(names["cur"]).where("_source_file is not null and pt_file_id is not null").groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("rows")).join(state, "batch_id")


@query("config_filters", """SELECT event_id, 's3://x/' || event_type || '/y' AS path, 'kept' AS run FROM events WHERE event_type IN ('click', 'view') AND event_type <> 'view' AND value >= 5
UNION ALL SELECT event_id, '', 'refreshed' FROM events""")
def _(t):
    sql = """select event_id, 's3://x/{kind}/y' as path from {raw_filename} where event_type in ('{kind}', '{other}') and event_type <> '{other}' and value >= {least}"""
    kept = models.run_config_query(t.spark, sql, {"kind": "click", "other": "view", "least": 5}, t.events)
    fresh = models.full_refresh_query(t.spark, sql, raw=t.events)
    return kept.withColumn("run", F.lit("kept")).unionByName(fresh.select("event_id", F.lit("").alias("path"), F.lit("refreshed").alias("run")))


# ---- streams --------------------------------------------------------------------------------

@query("stream_landing", "SELECT event_type, COUNT(*) AS rows, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS VARCHAR) AS total FROM events GROUP BY 1")
def _(t):
    inbox, out, mark = (scratch_path(t.spark, n) for n in ("inbox", "bronze", "mark"))
    for i, half in enumerate((t.events.where("value < 20"), t.events.where("not value < 20"))):
        half.write.parquet(f"{inbox}/{i}")  # files arrive between two runs
        landing.stream_landing(t.spark, inbox, t.events.schema, out, mark).awaitTermination()
    return t.spark.read.parquet(out).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("value").cast("decimal(18,2)")).cast("string").alias("total"))


EVOLVED = """WITH e AS (SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_id % 3 AS v FROM events)
SELECT event_id, user_id, CASE WHEN v = 2 AND event_type = 'error' THEN NULL ELSE event_type END AS event_type,
  CASE WHEN v > 0 AND NOT (v = 2 AND event_type = 'view') THEN round(value, 2) END AS amount, CASE WHEN v = 2 AND k % 2 = 0 THEN k END AS k,
  CASE WHEN v = 2 AND event_type = 'view' THEN 'amount=n/a' END AS rescued FROM e"""


@query("stream_evolving", EVOLVED)
def _(t):
    """Three versions of a feed's files: without an amount, with it, and with more columns, other case and cells that do not fit."""
    inbox, out, mark = (scratch_path(t.spark, n) for n in ("inbox", "bronze", "mark"))
    e = t.events.select("event_id", "user_id", "event_type", F.round("value", 2).alias("amount"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    kind = F.col("event_type")
    versions = (e.select("event_id", "user_id", "event_type"), e.select("user_id", "event_id", "event_type", "amount"),
                e.select(F.col("event_id").alias("Event_ID"), "user_id", F.when(kind != "error", kind).alias("event_type"),
                         F.when(kind == "view", "n/a").otherwise(F.col("amount").cast("string")).alias("amount"), F.when(F.col("k") % 2 == 0, F.col("k")).alias("k")))
    for i, rows in enumerate(versions):
        rows.where(e["event_id"] % 3 == i).write.json(f"{inbox}/{i}")
        landing.stream_evolving(t.spark, inbox, out, mark, glob="*.json").awaitTermination()
    rescued = F.from_json("_rescued_data", evolving.CELL)
    return evolving.read_landed(t.spark, out, f"{mark}-schema").select(
        "event_id", "user_id", "event_type", "amount", F.col("k").cast("int").alias("k"),
        F.array_join(F.transform(rescued, lambda c: F.concat(c["column"], F.lit("="), c["value"])), ",").alias("rescued"))


@query("read_evolving_csv", """SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority END AS priority,
  CASE WHEN o_orderkey % 2 = 1 THEN o_custkey END AS customer FROM orders""")
def _(t):
    """CSV files of two headers, the second with other columns in another order, under one schema."""
    inbox, log = scratch_path(t.spark, "inbox"), scratch_path(t.spark, "schema")
    old = t.orders.select("o_orderkey", "o_orderstatus").where("o_orderkey % 2 = 0")
    new = t.orders.where("o_orderkey % 2 = 1").select(F.col("o_orderpriority").alias("priority"), "o_orderstatus", F.col("o_custkey").alias("customer"), "o_orderkey")
    old.write.option("header", "true").csv(f"{inbox}/old")
    new.write.option("header", "true").csv(f"{inbox}/new")
    read = evolving.read_evolving(t.spark, inbox, log, "csv", "*.csv")
    return read.where("_rescued_data is null").select("o_orderkey", "o_orderstatus", "priority", "customer")


@query("stream_upsert", """SELECT user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events) WHERE rn = 1""")
def _(t):
    inbox, mark, name = scratch_path(t.spark, "changes"), scratch_path(t.spark, "mark"), table_name("latest")
    feed = t.events.select("user_id", "ts", "event_type")
    for i, part in enumerate((feed.where("ts < '2024-01-16'"), feed.where("ts >= '2024-01-12'"))):
        part.write.parquet(f"{inbox}/{i}")
        stream = t.spark.readStream.schema(feed.schema).option("recursiveFileLookup", "true").parquet(inbox)
        landing.stream_upsert(stream, name, ["user_id"], "ts", mark, repeats="1 hour").awaitTermination()
    return t.spark.table(name).select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))
