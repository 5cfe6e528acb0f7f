"""Source, sink and mapping queries."""

from __future__ import annotations

import uuid
import zipfile

from pyspark.sql import functions as F

from ..operators import mapping
from ..sources import files, jdbc, writers
from ..session import scratch_path
from .base import query
from .proof import PART_COLUMNS, STRAY, part_columns, stray_orders


@query("read_landing", "SELECT 'orders.parquet' AS file_name, COUNT(*) AS rows, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS VARCHAR) AS total FROM orders")
def _(t):
    df = files.read_landing(t.spark, t.dir, "parquet", "orders.parq*")
    return df.groupBy(F.col("_source_file_name").alias("file_name")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("string").alias("total"))


@query("read_landing_csv", """SELECT o_orderstatus, COUNT(*) AS rows, COUNT(DISTINCT o_orderkey) AS keys,
  MAX(o_orderpriority) AS top FROM orders GROUP BY 1""")
def _(t):
    path = scratch_path(t.spark, "landing")
    files.land_files(t.orders.withColumn("status", F.col("o_orderstatus")), path, "csv", by="status")
    df = files.read_landing(t.spark, path, "csv", "*.csv")
    return df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("o_orderkey").alias("keys"),
                                           F.max("o_orderpriority").alias("top"))


def _zip_batches(folder: str):
    """Each Arrow batch of documents becomes one archive with one JSON-lines member per language."""
    def write(batches):
        import io

        import pandas as pd
        import pyarrow.fs as pafs

        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                for lang, group in batch.groupby("lang"):
                    z.writestr(f"docs/{lang}/part.json", group.to_json(orient="records", lines=True))
            name = f"{root}/{uuid.uuid4().hex}.zip"
            with fs.open_output_stream(name) as out:
                out.write(buffer.getvalue())
            yield pd.DataFrame({"archive": [name]})
    return write


@query("expand_archives", "SELECT lang, COUNT(*) AS docs, CAST(SUM(n_chars) AS BIGINT) AS chars, COUNT(DISTINCT text) AS texts FROM documents GROUP BY lang")
def _(t):
    zips, out = scratch_path(t.spark, "zips"), scratch_path(t.spark, "unzipped")
    zips, out = (p if "://" in p or p.startswith("file:") else f"file://{p}" for p in (zips, out))
    t.documents.mapInPandas(_zip_batches(zips), "archive string").write.format("noop").mode("overwrite").save()
    files.expand_archives(t.spark, zips, out)
    docs = files.read_landing(t.spark, out, "json", "*.json",
                              schema="doc_id long, text string, lang string, source string, n_chars long")
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"),
                                    F.countDistinct("text").alias("texts"))


def text_lineitem(lineitem):
    """lineitem as landed text, with unreadable quantities and dates in some rows."""
    return lineitem.select(
        F.col("l_orderkey").cast("string").alias("Order Key"), F.col("l_linenumber").cast("string").alias("line"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 3), "n/a").otherwise(
            F.col("l_quantity").cast("string")).alias("qty"),
        F.when(F.col("l_tax") > 0.07, "someday").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("shipped"))


LOAD = [{"target": "order_key", "source": "Order Key", "type": "BIGINT"}, {"target": "line", "type": "INT"},
        {"target": "qty", "type": "DOUBLE"}, {"target": "shipped", "type": "DATE"}]
LANDED = """t AS (SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate,
  l_returnflag = 'R' AND l_linenumber = 3 AS bad_qty, l_tax > 0.07 AS bad_date FROM lineitem)"""


@query("typed_load", f"""WITH {LANDED} SELECT l_orderkey AS order_key, l_linenumber AS line, l_quantity AS qty,
  CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS shipped, 'b7' AS _batch_id,
  sha256(concat_ws(chr(1), l_orderkey, l_linenumber, l_quantity, CAST(CAST(l_shipdate AS DATE) AS VARCHAR))) AS _record_hash
FROM t WHERE NOT bad_qty AND NOT bad_date""")
def _(t):
    good, _ = files.typed_load(text_lineitem(t.lineitem), LOAD, batch_id="b7", hash_rows=True)
    return good.select("order_key", "line", "qty", F.col("shipped").cast("string").alias("shipped"), "_batch_id", "_record_hash")


@query("typed_load_rejected", f"""WITH {LANDED} SELECT CAST(l_orderkey AS VARCHAR) AS order_key, CAST(l_linenumber AS VARCHAR) AS line,
  CASE WHEN bad_qty THEN 'n/a' ELSE CAST(l_quantity AS VARCHAR) END AS qty,
  concat_ws(',', CASE WHEN bad_qty THEN 'qty' END, CASE WHEN bad_date THEN 'shipped' END) AS errors
FROM t WHERE bad_qty OR bad_date""")
def _(t):
    _, bad = files.typed_load(text_lineitem(t.lineitem), LOAD, batch_id="b7")
    return bad.select("order_key", "line", "qty", F.array_join("_cast_errors", ",").alias("errors"))


@query("write_partitioned", """SELECT event_type, COUNT(*) AS rows,
  CAST(SUM(CASE WHEN event_type = 'click' THEN 0 ELSE CAST(value AS DECIMAL(18,2)) END) AS VARCHAR) AS total
FROM events WHERE event_type <> 'click' OR value > 10 GROUP BY event_type""")
def _(t):
    name = f"events_{uuid.uuid4().hex[:8]}"
    path = scratch_path(t.spark, name)
    writers.write_partitioned(t.events, name, ["event_type"], path)
    clicks = t.events.where("event_type = 'click' and value > 10").withColumn("value", F.lit(0.0))
    for _ in range(2):  # the second, repeated write must change nothing
        writers.write_partitioned(clicks, name, ["event_type"])
    return t.spark.table(name).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("value").cast("decimal(18,2)")).cast("string").alias("total"))


@query("copy_into_once", "SELECT o_orderstatus, COUNT(*) AS rows FROM orders GROUP BY 1")
def _(t):
    name, path = f"once_{uuid.uuid4().hex[:8]}", scratch_path(t.spark, "once")
    files.land_files(t.orders.where("o_orderstatus <> 'P'").withColumn("s", F.col("o_orderstatus")), path + "/a", "parquet", by="s")
    files.copy_into_once(t.spark, path, name, f"{name}_ledger")
    files.land_files(t.orders.where("o_orderstatus = 'P'").withColumn("s", F.col("o_orderstatus")), path + "/b", "parquet", by="s")
    for _ in range(2):
        files.copy_into_once(t.spark, path, name, f"{name}_ledger")
    return t.spark.table(name).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("rows"))


@query("reject_zone", """SELECT 'kept' AS zone, COUNT(*) AS rows FROM lineitem WHERE l_discount <= 0.05
UNION ALL SELECT 'rejected', COUNT(*) FROM lineitem WHERE NOT l_discount <= 0.05""")
def _(t):
    path = scratch_path(t.spark, "rejects")
    kept = writers.reject_zone(t.lineitem, F.col("l_discount") <= 0.05, path, "discount", "b1")
    both = kept.select(F.lit("kept").alias("zone")).unionByName(
        t.spark.read.parquet(path).select(F.lit("rejected").alias("zone")))
    return both.groupBy("zone").agg(F.count(F.lit(1)).alias("rows"))


@query("load_rowcount_check", """WITH s AS (SELECT event_type AS "table", COUNT(*) AS a FROM events WHERE event_type <> 'view' GROUP BY 1),
l AS (SELECT event_type AS "table", COUNT(*) AS b FROM events WHERE event_type <> 'error' AND (event_type <> 'click' OR value > 1) GROUP BY 1)
SELECT "table", coalesce(a, -1) AS source_rows, coalesce(b, -1) AS loaded_rows,
  CASE WHEN a = b THEN 'completed' WHEN a <> b THEN 'completed_with_warnings' ELSE 'not_loaded' END AS status
FROM s FULL OUTER JOIN l USING ("table")""")
def _(t):
    count = lambda df: df.groupBy(F.col("event_type").alias("table")).agg(F.count(F.lit(1)).alias("rows"))
    out = files.load_rowcount_check(count(t.events.where("event_type <> 'view'")), count(
        t.events.where("event_type <> 'error' and (event_type <> 'click' or value > 1)")))
    return out.select("table", F.coalesce("source_rows", F.lit(-1)).alias("source_rows"),
                      F.coalesce("loaded_rows", F.lit(-1)).alias("loaded_rows"), "status")


@query("counted_write", "SELECT 'lineitem' AS \"table\", COUNT(*) AS source_rows, COUNT(*) AS loaded_rows, true AS row_count_match FROM lineitem")
def _(t):
    df, seen = files.counted(t.lineitem, "load")
    df.write.mode("overwrite").parquet(scratch_path(t.spark, "counted"))
    loaded = t.spark.range(1).select(F.lit("lineitem").alias("table"), F.lit(seen.get["rows"]).cast("long").alias("rows"))
    source = t.lineitem.groupBy(F.lit("lineitem").alias("table")).agg(F.count(F.lit(1)).alias("rows"))
    return files.load_rowcount_check(source, loaded).drop("status")


@query("export_types", f"""WITH {PART_COLUMNS} SELECT DISTINCT "table", col_name, CASE WHEN col_type = 'int' THEN 'NUMBER(38,0)'
  WHEN col_type = 'string' THEN 'VARCHAR' ELSE replace(upper(col_type), 'DECIMAL', 'NUMBER') END AS target_type FROM cols""")
def _(t):
    return jdbc.export_types(part_columns(t.part)).select("table", "col_name", "target_type").distinct()


# ---- mapping --------------------------------------------------------------------------------

@query("apply_mapping", """SELECT CAST(c_custkey AS VARCHAR) AS account_id, c_name AS account_name, c_name || ' ' || c_mktsegment AS full_name,
  'N' AS dq_orphan_parent, 'b1' AS batch_id, '' AS territory, c_acctbal AS balance FROM customer""")
def _(t):
    rules = [{"target": "account_id", "source": "c_custkey"}, {"target": "account_name", "source": "C_NAME"},
             {"target": "full_name", "concat": ["c_name", "c_mktsegment"]}, {"target": "dq_orphan_parent", "constant": "N"},
             {"target": "batch_id", "constant": "b1"}, {"target": "territory", "source": "c_territory"},
             {"target": "balance", "source": "c_acctbal", "type": "double"}]
    return mapping.apply_mapping(t.customer, rules).fillna("", ["territory"])


HEADERS = """names AS (SELECT lower(p_type) AS o, replace(p_name, ' ', '_') AS n, MIN(p_partkey) AS ord,
    upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] || '_vod__c' AS h
  FROM part GROUP BY ALL),
targets AS (SELECT DISTINCT lower(p_type) AS o, replace(p_name, ' ', '_') || z AS n, split_part(p_name, ' ', 1) || z AS w, p_size % 5 AS k
  FROM (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN 'zz' ELSE '' END AS z FROM part)),
named AS (SELECT *, CASE k WHEN 0 THEN n WHEN 1 THEN n || '_id' WHEN 2 THEN w WHEN 3 THEN o || '_id' ELSE 'dq_' || w END AS target FROM targets),
pre AS (SELECT o, split_part(n, '_', 1) AS w, arg_min(h, ord) AS h FROM names GROUP BY ALL)"""


@query("infer_mapping", f"""WITH {HEADERS}
SELECT DISTINCT t.o AS object, target, CASE WHEN k = 3 THEN 'object_key' WHEN k = 4 THEN 'default' WHEN k = 0 AND x.h IS NOT NULL THEN 'exact'
    WHEN k = 1 AND x.h IS NOT NULL THEN 'variant' WHEN k = 2 AND p.h IS NOT NULL THEN 'prefix' ELSE 'none' END AS rule,
  CASE WHEN k = 3 THEN '`ID`' WHEN k = 4 THEN '''N''' WHEN k IN (0, 1) AND x.h IS NOT NULL THEN '`' || x.h || '`'
    WHEN k = 2 AND p.h IS NOT NULL THEN '`' || p.h || '`' ELSE 'cast(null as string)' END AS expression
FROM named t LEFT JOIN names x ON x.o = t.o AND x.n = t.n LEFT JOIN pre p ON p.o = t.o AND p.w = t.w""")
def _(t):
    first, second = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    obj = F.lower("p_type").alias("object")
    headers = t.part.select(obj, F.concat(F.initcap(first), F.initcap(second), F.lit("_vod__c")).alias("header"),
                                                 F.col("p_partkey").alias("ord"))
    ids = t.part.select(obj, F.lit("ID").alias("header"), F.lit(-1).cast("long").alias("ord"))
    unknown = F.when(F.col("p_partkey") % 3 == 0, "zz").otherwise("")  # no header is called like this
    name, first, k = F.concat(F.translate("p_name", " ", "_"), unknown), F.concat(first, unknown), F.col("p_size") % 5
    target = (F.when(k == 0, name).when(k == 1, F.concat(name, F.lit("_id"))).when(k == 2, first)
              .when(k == 3, F.concat(F.lower("p_type"), F.lit("_id"))).otherwise(F.concat(F.lit("dq_"), first)))
    targets = t.part.select(obj, target.alias("target"))
    return mapping.infer_mapping(headers.unionByName(ids), targets).select("object", "target", "rule", "expression")


@query("snake_case_catalog", """WITH c AS (SELECT p_brand AS "table", p_partkey AS ord,
  CASE p_type WHEN 'ECONOMY' THEN 'Order' WHEN 'STANDARD' THEN '1st_' || replace(p_name, ' ', '_') ELSE replace(p_name, ' ', '_') || '_id' END AS b,
  CASE p_type WHEN 'ECONOMY' THEN 'order_col' WHEN 'STANDARD' THEN 'col_1st_' || replace(p_name, ' ', '_') ELSE replace(p_name, ' ', '_') || '_id' END AS base FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY "table", base ORDER BY ord) - 1 AS n FROM c)
SELECT "table", ord, base || CASE WHEN n > 0 THEN '_' || n ELSE '' END AS target_column FROM n""")
def _(t):
    first, second = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    header = (F.when(F.col("p_type") == "ECONOMY", "Order").when(F.col("p_type") == "STANDARD", F.concat(F.lit("1st "), F.col("p_name")))
              .when(F.col("p_type") == "PROMO", F.concat(F.lit("%"), F.initcap(first), F.initcap(second), F.lit("ID")))
              .otherwise(F.concat(first, F.lit("."), second, F.lit("/ID "))))
    cols = t.part.select(F.col("p_brand").alias("table"), header.alias("col_name"), F.col("p_partkey").alias("ord"))
    return mapping.snake_case_catalog(cols).select("table", "ord", "target_column")


@query("snake_case_columns", "SELECT o_orderkey AS order_key, o_orderstatus AS select_col, o_orderpriority AS order_key_1 FROM orders")
def _(t):
    return mapping.snake_case_columns(t.orders.select(F.col("o_orderkey").alias("%Order Key"), F.col("o_orderstatus").alias("Select"),
                                                      F.col("o_orderpriority").alias("orderKey")))


@query("publish_projection", """SELECT o_orderkey, o_totalprice, '' AS order_sk, 'orders' AS data_src_nm FROM orders WHERE o_orderstatus = 'F'""")
def _(t):
    curated = t.orders.withColumnRenamed("o_orderstatus", "batch_id")
    return mapping.publish_projection(curated, ["o_orderkey", "o_totalprice", "order_sk", "data_src_nm"], "F", "orders").fillna("")


@query("category_decode", """SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'Industry'
  WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Home' ELSE 'Other' END AS area FROM customer""")
def _(t):
    area = mapping.category_decode(F.initcap("c_mktsegment"), {"Industry": ["BUILDING", "MACHINERY"], "Home": ["HOUSEHOLD"]}, "Other")
    return t.customer.select("c_custkey", area.alias("area"))


@query("mask_secret_columns", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE '***' END AS api_key, c_name AS note FROM customer")
def _(t):
    key = F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment"))
    return mapping.mask_secret_columns(t.customer.select("c_custkey", key.alias("api_key"), F.col("c_name").alias("note")))


@query("promote_numeric_strings", """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name ELSE CAST(c_acctbal AS VARCHAR) END AS amount,
  coalesce(CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END, -1) AS amount_number FROM customer""")
def _(t):
    text = F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_name")).otherwise(
        F.concat(F.lit("$ "), F.regexp_replace(F.col("c_acctbal").cast("string"), r"^(-?\d+)(\d{3})", "$1,$2")))
    return mapping.promote_numeric_strings(t.customer.select("c_custkey", text.alias("amount")), ["amount"]).fillna(-1.0)


@query("repoint_paths", "SELECT page_id, CASE WHEN url LIKE 'https://%' THEN 's3://{bucket_name}/' || substr(url, 9) ELSE url END AS url FROM pages")
def _(t):
    return mapping.repoint_paths(t.pages.select("page_id", "url"), ["url"], "https://", "s3://{bucket_name}/")


@query("repoint_counts", """SELECT 'url' AS "column", COUNT(*) FILTER (WHERE url LIKE 'https://%') AS updated FROM pages
UNION ALL SELECT 'html', COUNT(*) FILTER (WHERE html LIKE 'https://%') FROM pages""")
def _(t):
    return mapping.repoint_counts(t.pages, ["url", "html"], "https://")


@query("path_zone_report", """WITH p AS (SELECT p_partkey, 's3://{bucket_name}/landing/' || p_name AS landing, 's3://lake/' || p_type || '/raw_files/' AS raw,
  's3://lake/' || (CASE WHEN p_size > 25 THEN 'curated' ELSE 'x' END) AS curated, '' AS publish FROM part WHERE p_size > 10)
SELECT p_partkey, 'landing' AS zone, true AS has_bucket_placeholder, true AS mentions_zone FROM p
UNION ALL SELECT p_partkey, 'raw', false, true FROM p UNION ALL SELECT p_partkey, 'curated', false, curated LIKE '%curated' FROM p
UNION ALL SELECT p_partkey, 'publish', false, false FROM p""")
def _(t):
    cfg = t.part.select(
        "p_partkey", F.when(F.col("p_size") > 10, "A").otherwise("I").alias("active_flag"),
        F.concat(F.lit("s3://{bucket_name}/landing/"), F.col("p_name")).alias("s3_landing_path"),
        F.concat(F.lit("s3://lake/"), F.col("p_type"), F.lit("/raw_files/")).alias("s3_raw_path"),
        F.concat(F.lit("s3://lake/"), F.when(F.col("p_size") > 25, "curated").otherwise("x")).alias("s3_curated_path"),
        F.lit(None).cast("string").alias("s3_publish_path"))
    return mapping.path_zone_report(cfg, ["p_partkey"]).drop("template")


@query("replace_nan_nulls", """SELECT COUNT(*) FILTER (WHERE c_mktsegment <> 'BUILDING') AS names, COUNT(*) FILTER (WHERE c_acctbal >= 0) AS balances,
  COUNT(*) AS keys FROM customer""")
def _(t):
    df = t.customer.select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", " ").otherwise(F.col("c_name")).alias("name"),
                           F.when(F.col("c_acctbal") < 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal")).alias("bal"))
    return mapping.replace_nan_nulls(df).agg(F.count("name").alias("names"), F.count("bal").alias("balances"), F.count("c_custkey").alias("keys"))


@query("flag_columns", f"""SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer) THEN 'N' ELSE 'Y' END AS dq_account_missing
FROM ({STRAY})""")
def _(t):
    return mapping.flag_columns(stray_orders(t.orders), t.customer, [("o_custkey", "c_custkey")], "dq_account_missing").select(
        "o_orderkey", "dq_account_missing")
