"""Scalar-function and type-mapping queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as L
from ..functions import variant
from .base import query


def text(c, name):
    return F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("")).alias(name)


@query("to_date", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS with_format,
  CASE WHEN o_orderstatus = 'F' THEN '' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS plain FROM orders""")
def _(t):
    a = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.date_format("o_orderdate", "dd-MMM-yyyy"))
    b = F.when(F.col("o_orderstatus") == "F", "someday").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t.orders.select("o_orderkey", text(L.to_date(a, "DD-MON-YYYY"), "with_format"), text(L.to_date(b), "plain"))


@query("to_char", "SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M:%S') AS stamp, CAST(value AS VARCHAR) AS shown FROM events")
def _(t):
    return t.events.select("event_id", L.to_char("ts", "YYYY/MM/DD HH24:MI:SS").alias("stamp"), L.to_char("value").alias("shown"))


@query("dateadd", """SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) AS VARCHAR) AS d,
  CAST(CAST(l_shipdate AS DATE) + 7 * l_linenumber AS VARCHAR) AS w, CAST(CAST(CAST(l_shipdate AS DATE) + to_months(CAST(l_quantity AS INTEGER)) AS DATE) AS VARCHAR) AS m,
  CAST(CAST(CAST(l_shipdate AS DATE) - to_months(12 * l_linenumber) AS DATE) AS VARCHAR) AS y FROM lineitem""")
def _(t):
    day, n = F.col("l_shipdate").cast("date"), F.col("l_quantity").cast("int")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", text(L.dateadd("day", n, day), "d"),
                             text(L.dateadd("week", F.col("l_linenumber"), day), "w"), text(L.dateadd("MM", n, day), "m"),
                             text(L.dateadd("years", -F.col("l_linenumber"), day), "y"))


@query("datediff", """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(o_orderdate AS DATE) AS a, CAST(l_shipdate AS DATE) AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
m AS (SELECT *, (year(b) - year(a)) * 12 + month(b) - month(a) AS whole, CASE WHEN day(a) = day(b) OR (a = last_day(a) AND b = last_day(b)) THEN 0 ELSE (day(b) - day(a)) / 31.0 END AS part FROM p)
SELECT l_orderkey, l_linenumber, l_partkey, date_diff('day', a, b) AS days, CAST(trunc(date_diff('day', a, b) / 7.0) AS INTEGER) AS weeks,
  CAST(trunc(whole + part) AS INTEGER) AS months, CAST(trunc((whole + part) / 12) AS INTEGER) AS years FROM m""")
def _(t):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    a, b = F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date")
    return j.select("l_orderkey", "l_linenumber", "l_partkey",
                    *[L.datediff(u, a, b).alias(f"{u}s") for u in ("day", "week", "month", "year")])


@query("try_to_number", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN -1 ELSE o_totalprice END AS n FROM orders")
def _(t):
    c = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("x"), F.col("o_totalprice").cast("string"))).otherwise(F.col("o_totalprice").cast("string"))
    return t.orders.select("o_orderkey", F.coalesce(L.try_to_number(c), F.lit(-1.0)).alias("n"))


@query("null_helpers", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'final' ELSE 'open' END AS state, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_custkey END AS z,
  coalesce(nullif(o_custkey, 0), -1) AS n FROM orders""")
def _(t):
    maybe = F.when(F.col("o_orderstatus") != "F", F.col("o_custkey"))
    return t.orders.select("o_orderkey", L.iff(F.col("o_orderstatus") == "F", "final", "open").alias("state"),
                           L.zeroifnull(maybe).alias("z"), F.coalesce(L.nullifzero("o_custkey"), F.lit(-1)).alias("n"))


@query("surrogate_key", "SELECT COUNT(*) AS rows, COUNT(DISTINCT (l_orderkey, l_partkey)) AS keys, true AS positive FROM lineitem")
def _(t):
    sk = L.surrogate_key("l_orderkey", "l_partkey")
    return t.lineitem.select(sk.alias("sk")).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("sk").alias("keys"), (F.min("sk") >= 0).alias("positive"))


@query("record_hash", """SELECT c_custkey, sha256(concat_ws(chr(1), c_custkey, c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN chr(0) ELSE c_mktsegment END)) AS h FROM customer""")
def _(t):
    seg = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    return t.customer.select("c_custkey", L.record_hash("c_custkey", "c_name", seg).alias("h"))


@query("flatten", """SELECT label, pos, COUNT(*) AS n, CAST(SUM(CAST(v AS DECIMAL(18,6))) AS VARCHAR) AS total FROM (
  SELECT label, unnest(embedding) AS v, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY ALL""")
def _(t):
    rows = L.flatten(t.embeddings, "embedding", "v", position="pos")
    return rows.groupBy("label", "pos").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("v").cast("decimal(18,6)")).cast("string").alias("total"))


@query("json_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, -1 AS absent FROM events")
def _(t):
    return t.events.select("event_id", L.json_path("props", "$.k", "int").alias("k"),
                           F.coalesce(L.json_path("props", "$.none", "int"), F.lit(-1)).alias("absent"))


@query("variant_access", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, '{"k":' || json_extract_string(props, '$.k') || '}' AS whole,
  CAST(NULL AS INTEGER) AS absent FROM events""")
def _(t):
    v = variant.parse_variant("props")
    return t.events.select("event_id", variant.variant_at(v, "k", "int").alias("k"), variant.variant_at(v, "$").alias("whole"), variant.variant_at(v, "k.z[0]", "int").alias("absent"))


def event_documents(t):
    """Every event as nested JSON: its user with the properties as an object, and a list."""
    props = F.from_json("props", "k int")
    return t.events.select("event_id", F.to_json(F.struct(
        F.col("event_id").alias("id"), F.struct(F.col("user_id").alias("id"), props.alias("props")).alias("user"), F.array("event_type", F.lit("x")).alias("tags"))).alias("doc"))


@query("variant_flatten", """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_id, unnest(['id', 'user', 'tags', 'user.id', 'user.props', 'tags[0]', 'tags[1]', 'user.props.k']) AS path,
  unnest([NULL, NULL, NULL, NULL, NULL, 0, 1, NULL]) AS "index",
  unnest([event_id::varchar, '{"id":' || user_id || ',"props":{"k":' || k || '}}', '["' || event_type || '","x"]', user_id::varchar, '{"k":' || k || '}', event_type, 'x', k::varchar]) AS value FROM e""")
def _(t):
    docs = event_documents(t).select("event_id", variant.parse_variant("doc").alias("doc"))
    flat = variant.flatten_variant(docs, "doc", recursive=True)
    return flat.select("event_id", "path", "index", variant.variant_at("value", "$").alias("value"))


@query("variant_flatten_keyless", """SELECT i AS "index", COUNT(*) AS n, COUNT(DISTINCT v) AS kinds FROM (
  SELECT unnest([0, 1, 2]) AS i, unnest([conv_id::varchar, turn::varchar, role]) AS v FROM conversations) GROUP BY 1""")
def _(t):
    """Conversations as lists without keys."""
    lists = t.conversations.select(variant.parse_variant(F.concat(
        F.lit("["), F.concat_ws(",", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.concat(F.lit('"'), F.col("role"), F.lit('"'))), F.lit("]"))).alias("doc"))
    flat = variant.flatten_variant(lists, "doc")
    return flat.groupBy("index").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(variant.variant_at("value", "$")).alias("kinds"))


@query("variant_documents", """SELECT event_id, event_id AS id, user_id AS owner, event_type AS tag, CASE WHEN event_id % 2 = 0 THEN floor(value)::bigint::varchar ELSE 'n/a' END AS amount FROM events""")
def _(t):
    """Documents of two shapes, typed by one aggregate; a field of two kinds stays a variant."""
    odd = F.col("event_id") % 2 == 1
    doc = F.to_json(F.struct(F.col("event_id").alias("id"), F.struct(F.col("user_id").alias("id")).alias("user"), F.array("event_type").alias("tags"),
                             F.when(~odd, F.floor("value").cast("long")).alias("amount")))
    text = F.when(odd, F.concat(F.substring(doc, 1, 1), F.lit('"amount":"n/a",'), F.expr("substr(_d, 2)"))).otherwise(F.col("_d"))
    docs = t.events.withColumn("_d", doc).select("event_id", variant.parse_variant(text).alias("doc"))
    typed = variant.typed_documents(docs, "doc")
    return typed.select("event_id", "id", F.col("user")["id"].alias("owner"), F.col("tags")[0].alias("tag"), variant.variant_at("amount", "$").alias("amount"))


@query("listagg", "SELECT o_orderstatus, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY 1")
def _(t):
    few = t.orders.select("o_orderstatus", "o_orderpriority").distinct()
    return few.groupBy("o_orderstatus").agg(L.listagg("o_orderpriority", "|").alias("priorities"))


@query("serial_to_date", "SELECT p_partkey, CAST(DATE '1899-12-30' + CAST(p_partkey + 30000 AS INTEGER) AS VARCHAR) AS d FROM part")
def _(t):
    return t.part.select("p_partkey", text(L.serial_to_date(F.concat((F.col("p_partkey") + 30000).cast("string"), F.lit(".75"))), "d"))


@query("flag_to_boolean", """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN 'true' WHEN 'N' THEN 'false' ELSE '' END AS flag FROM lineitem""")
def _(t):
    c = F.when(F.col("l_returnflag") == "A", " TRUE").when(F.col("l_returnflag") == "N", "0").otherwise("maybe")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", text(L.flag_to_boolean(c), "flag"))


@query("date_attributes", """SELECT o_orderkey, year(o_orderdate) AS year, quarter(o_orderdate) AS quarter, month(o_orderdate) AS month,
  dayofweek(o_orderdate) + 1 AS day_of_week, strftime(o_orderdate, '%Y-%m') AS month_key FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", *[c.alias(n) for n, c in L.date_attributes("o_orderdate").items()])


@query("names", r"""SELECT p_partkey, lower(p_brand) || '.' || p_name || '.' || lower(p_type) AS norm, lower(p_type) AS base FROM part""")
def _(t):
    full = F.concat(F.lit('"'), "p_brand", F.lit('".`'), "p_name", F.lit("`..'"), "p_type", F.lit("'"))
    return t.part.select("p_partkey", L.norm_name(full).alias("norm"), L.base_name(full).alias("base"))


@query("canonical_layer", """SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'gold' WHEN 'STANDARD' THEN 'silver' WHEN 'PROMO' THEN 'bronze' WHEN 'SMALL' THEN 'gold' ELSE '' END AS layer,
  CASE p_type WHEN 'ECONOMY' THEN 'marts' WHEN 'STANDARD' THEN 'intermediate' WHEN 'SMALL' THEN 'marts' ELSE 'staging' END AS model FROM part""")
def _(t):
    kinds = {"ECONOMY": "s3://x/curated/publish/", "STANDARD": "crm_Conformed", "PROMO": "LANDING/x", "SMALL": "datamart"}
    models = {"ECONOMY": "DIM_x", "STANDARD": "int_x", "PROMO": "stg_x", "SMALL": "other"}
    pick = lambda d: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), F.col("p_type")), F.lit("x"))
    schema = F.when(F.col("p_type") == "SMALL", "gold").otherwise("silver")
    return t.part.select("p_partkey", F.coalesce(L.canonical_layer(F.concat(pick(kinds), F.lit("_"), F.col("p_brand"))), F.lit("")).alias("layer"),
                         L.model_layer(pick(models), schema).alias("model"))


@query("map_types_warehouse", """SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'DECIMAL(' || (p_size % 18 + 1) || ',0)' WHEN 'STANDARD' THEN 'DECIMAL(38,0)'
  WHEN 'PROMO' THEN 'TIMESTAMP_NTZ' WHEN 'SMALL' THEN 'ARRAY<STRING>' WHEN 'MEDIUM' THEN 'DOUBLE' ELSE 'STRING' END AS target_type FROM part""")
def _(t):
    kind = (F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit("number ("), (F.col("p_size") % 18 + 1).cast("string"), F.lit(",0)")))
            .when(F.col("p_type") == "STANDARD", "Number").when(F.col("p_type") == "PROMO", "timestamp_ntz(9)")
            .when(F.col("p_type") == "SMALL", "ARRAY").when(F.col("p_type") == "MEDIUM", "double precision").otherwise("VARIANT"))
    return L.map_types(t.part.select("p_partkey", kind.alias("col_type")), "warehouse").select("p_partkey", "target_type")


@query("map_types_control", """SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'DECIMAL(' || (p_size % 18 + 1) || ',2)' WHEN 'STANDARD' THEN 'DECIMAL(38,6)'
  WHEN 'PROMO' THEN 'TIMESTAMP' WHEN 'SMALL' THEN 'BIGINT' WHEN 'MEDIUM' THEN 'DOUBLE' ELSE 'STRING' END AS target_type FROM part""")
def _(t):
    kind = (F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit("numeric("), (F.col("p_size") % 18 + 1).cast("string"), F.lit(", 2)")))
            .when(F.col("p_type") == "STANDARD", "numeric").when(F.col("p_type") == "PROMO", "timestamp without time zone")
            .when(F.col("p_type") == "SMALL", "bigserial").when(F.col("p_type") == "MEDIUM", "double precision").otherwise("weird_type"))
    return L.map_types(t.part.select("p_partkey", kind.alias("col_type")), "control").select("p_partkey", "target_type")
