"""Data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality
from .base import query
from .proof import PART_COLUMNS, part_columns, stray_orders, STRAY


@query("not_null", "SELECT COUNT(*) FILTER (WHERE quality IS NULL) AS violations FROM documents LEFT JOIN labels USING (doc_id)")
def _(t):
    return quality.not_null(t.documents.join(t.labels, "doc_id", "left"), "quality")


@query("unique", """SELECT COUNT(*) AS violations FROM (SELECT quality FROM documents LEFT JOIN labels USING (doc_id)
GROUP BY quality HAVING COUNT(*) > 1)""")
def _(t):
    return quality.unique(t.documents.join(t.labels, "doc_id", "left"), ["quality"])


@query("relationships", f"SELECT COUNT(*) AS violations FROM ({STRAY}) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def _(t):
    return quality.relationships(stray_orders(t.orders), t.customer, [("o_custkey", "c_custkey")])


@query("contract", f"""WITH {PART_COLUMNS},
e AS (SELECT "table", col_name AS c, MAX(split_part(upper(col_type), '(', 1)) AS want FROM cols WHERE p_type <> 'PROMO' GROUP BY ALL),
g AS (SELECT "table", col_name AS c, MAX(split_part(upper(col_type), '(', 1)) AS got FROM cols WHERE p_type <> 'ECONOMY' GROUP BY ALL)
SELECT "table", c AS "column", CASE WHEN got IS NULL THEN 'missing' ELSE 'type_drift' END AS finding
FROM e LEFT JOIN g USING ("table", c) WHERE got IS DISTINCT FROM want""")
def _(t):
    cols = part_columns(t.part)
    return quality.contract(cols.where("p_type <> 'ECONOMY'"), cols.where("p_type <> 'PROMO'"))


@query("accepted_values", "SELECT COUNT(*) AS violations FROM orders WHERE o_orderstatus NOT IN ('O', 'F')")
def _(t):
    return quality.accepted_values(t.orders, "o_orderstatus", ["O", "F"])


@query("accepted_range", "SELECT COUNT(*) AS violations FROM lineitem WHERE NOT (l_discount >= 0.01 AND l_discount <= 0.05)")
def _(t):
    return quality.accepted_range(t.lineitem, "l_discount", 0.01, 0.05)


@query("regex", "SELECT COUNT(*) AS violations FROM pages WHERE NOT regexp_matches(url, '^https://[a-z0-9.-]+/')")
def _(t):
    return quality.regex(t.pages, "url", "^https://[a-z0-9.-]+/")


@query("expression", """SELECT COUNT(*) AS violations FROM lineitem
WHERE NOT (l_extendedprice * (1 - l_discount) >= 1000 OR l_quantity < 3)""")
def _(t):
    rule = "l_extendedprice * (1 - l_discount) >= 1000 or l_quantity < 3"
    return t.lineitem.agg(F.count_if(quality.breaks_expression(rule)).alias("violations"))


@query("quarantine", """SELECT doc_id, quality, 'quality_good' AS _dq_rule FROM documents LEFT JOIN labels USING (doc_id)
WHERE NOT (quality = 1)""")
def _(t):
    rows = t.documents.join(t.labels, "doc_id", "left").select("doc_id", "quality")
    return quality.quarantine(rows, "quality = 1", "quality_good").drop("_dq_rejected_at")


@query("quarantine_all", """SELECT o_orderkey, 'status' AS _dq_rule FROM orders WHERE NOT (o_orderstatus <> 'P')
UNION ALL SELECT o_orderkey, 'price' FROM orders WHERE NOT (o_totalprice < 400000)""")
def _(t):
    rules = {"status": "o_orderstatus <> 'P'", "price": "o_totalprice < 400000"}
    return quality.quarantine_all(t.orders, rules).select("o_orderkey", "_dq_rule")


@query("union_rejects", """SELECT o_orderkey, 'status' AS _dq_rule, '' AS note FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT o_orderkey, 'price', o_orderpriority FROM orders WHERE o_totalprice >= 400000""")
def _(t):
    a = quality.quarantine(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus <> 'P'", "status")
    b = quality.quarantine(t.orders.withColumn("note", F.col("o_orderpriority")), "o_totalprice < 400000", "price")
    return quality.union_rejects([a, b]).select("o_orderkey", "_dq_rule", F.coalesce("note", F.lit("")).alias("note"))


# Declared keys that grow with part: one relationship per part, between tables named after brand and name.
RELS = """rels AS (SELECT DISTINCT 'dim_' || replace(p_name, ' ', '_') AS pk, 'fct_' || lower(p_brand) AS fk,
  CASE WHEN p_name LIKE 'small%' THEN ['id', 'version'] ELSE ['id'] END AS pk_cols,
  CASE WHEN p_name LIKE 'small%' THEN ['part_id', 'part_version'] ELSE ['part_id'] END AS fk_cols FROM part)"""


def part_relationships(part):
    small = F.col("p_name").like("small%")
    ids, both = F.array(F.lit("id")), F.array(F.lit("id"), F.lit("version"))
    fk, fks = F.array(F.lit("part_id")), F.array(F.lit("part_id"), F.lit("part_version"))
    return part.select(F.concat(F.lit("GOLD.dim_"), F.translate("p_name", " ", "_")).alias("pk_table"),
                       F.when(small, both).otherwise(ids).alias("pk_columns"),
                       F.concat(F.lit("GOLD.fct_"), F.col("p_brand")).alias("fk_table"),
                       F.when(small, fks).otherwise(fk).alias("fk_columns"))


@query("build_test_specs", f"""WITH {RELS}, {PART_COLUMNS},
u AS (SELECT DISTINCT pk, pk_cols FROM rels),
nn AS (SELECT pk AS m, unnest(pk_cols) AS c FROM u UNION SELECT fk, unnest(fk_cols) FROM rels)
SELECT pk AS model, CASE len(pk_cols) WHEN 1 THEN 'unique' ELSE 'unique_combo' END AS kind,
  array_to_string(pk_cols, ',') AS columns, '' AS parent, '' AS parent_columns FROM u
UNION ALL SELECT m, 'not_null', c, '', '' FROM nn
UNION ALL SELECT fk, 'relationships', array_to_string(fk_cols, ','), pk, array_to_string(pk_cols, ',') FROM rels
UNION ALL SELECT DISTINCT lower("table"), 'contract', col_name, '', '' FROM cols""")
def _(t):
    specs = quality.build_test_specs(part_relationships(t.part), part_columns(t.part))
    text = lambda c: F.coalesce(F.array_join(c, ","), F.lit("")).alias(c)
    return specs.select("model", "kind", text("columns"), F.coalesce("parent", F.lit("")).alias("parent"),
                        text("parent_columns"))


def order_specs():
    return [
        {"model": "orders", "kind": "not_null", "columns": ["o_orderkey"]},
        {"model": "orders", "kind": "unique", "columns": ["o_orderkey"]},
        {"model": "orders", "kind": "accepted_values", "columns": ["o_orderstatus"], "values": ["O", "F"]},
        {"model": "orders", "kind": "relationships", "columns": ["o_custkey"], "parent": "customer",
         "parent_columns": ["c_custkey"]},
        {"model": "orders", "kind": "relationships", "columns": ["o_custkey"], "parent": "absent",
         "parent_columns": ["id"]},
        {"model": "lineitem", "kind": "unique_combo", "columns": ["l_orderkey", "l_linenumber"]},
        {"model": "lineitem", "kind": "range", "columns": ["l_discount"], "min": 0.0, "max": 0.05},
        {"model": "lineitem", "kind": "regex", "columns": ["l_returnflag"], "pattern": "^[AN]$"},
        {"model": "lineitem", "kind": "expression", "columns": [], "expression": "l_quantity * l_tax < 4"},
        {"model": "lineitem", "kind": "not_null", "columns": ["no_such_column"]},
        {"model": "lineitem", "kind": "relationships", "columns": ["l_orderkey"], "parent": "orders",
         "parent_columns": ["o_orderkey"]},
        {"model": "pages", "kind": "contract", "columns": [],
         "expected": [("page_id", "BIGINT"), ("url", "STRING"), ("html", "BINARY"), ("fetched", "DATE")]},
    ]


@query("run_tests", f"""WITH o AS ({STRAY}), r AS (
SELECT 'orders' AS model, 'not_null' AS kind, 'o_orderkey' AS columns, (SELECT COUNT(*) FROM o WHERE o_orderkey IS NULL) AS v
UNION ALL SELECT 'orders', 'unique', 'o_orderkey', (SELECT COUNT(*) FROM (SELECT 1 FROM o GROUP BY o_orderkey HAVING COUNT(*) > 1))
UNION ALL SELECT 'orders', 'accepted_values', 'o_orderstatus', (SELECT COUNT(*) FROM o WHERE o_orderstatus NOT IN ('O', 'F'))
UNION ALL SELECT 'orders', 'relationships', 'o_custkey', (SELECT COUNT(*) FROM o WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
UNION ALL SELECT 'lineitem', 'unique_combo', 'l_orderkey,l_linenumber', (SELECT COUNT(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1))
UNION ALL SELECT 'lineitem', 'range', 'l_discount', (SELECT COUNT(*) FROM lineitem WHERE NOT l_discount BETWEEN 0.0 AND 0.05)
UNION ALL SELECT 'lineitem', 'regex', 'l_returnflag', (SELECT COUNT(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N'))
UNION ALL SELECT 'lineitem', 'expression', '', (SELECT COUNT(*) FROM lineitem WHERE NOT (l_quantity * l_tax < 4))
UNION ALL SELECT 'lineitem', 'relationships', 'l_orderkey', (SELECT COUNT(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM o))
UNION ALL SELECT 'pages', 'contract', '', 2)
SELECT model, kind, columns, CASE v WHEN 0 THEN 'passed' ELSE 'failed' END AS status, v AS violations FROM r
UNION ALL SELECT 'orders', 'relationships', 'o_custkey', 'skipped', 0
UNION ALL SELECT 'lineitem', 'not_null', 'no_such_column', 'error', 0""")
def _(t):
    tables = {"silver.stg_orders": stray_orders(t.orders), "gold.lineitem": t.lineitem, "gold.customer": t.customer,
              "bronze.pages": t.pages}
    return quality.run_tests(t.spark, order_specs(), tables).select("model", "kind", "columns", "status", "violations")


# A rule table that grows with part.
RULES = """rules AS (SELECT p_partkey AS id,
  CASE p_type WHEN 'ECONOMY' THEN 'Null Check' WHEN 'STANDARD' THEN 'picklist' WHEN 'PROMO' THEN 'range_check'
    WHEN 'SMALL' THEN 'fk-check' WHEN 'MEDIUM' THEN 'row_count' ELSE 'mystery' END AS rule_type,
  CASE WHEN p_size < 45 THEN p_name ELSE '' END AS table_name, CASE WHEN p_size > 5 THEN p_brand ELSE '' END AS column_name,
  CASE WHEN p_size < 15 THEN 'Critical' WHEN p_size < 30 THEN 'soft' WHEN p_size < 35 THEN 'reject' ELSE '' END AS severity,
  CASE WHEN p_retailprice < 1000 THEN 'a; b|' || p_size ELSE '' END AS rule_expression,
  CASE WHEN p_retailprice > 950 THEN CAST(p_size AS VARCHAR) ELSE '' END AS min_value, p_name AS parent_table,
  CASE WHEN p_size > 20 THEN 'id' ELSE '' END AS parent_column FROM part)"""


def part_rules(part):
    kinds = {"ECONOMY": "Null Check", "STANDARD": "picklist", "PROMO": "range_check", "SMALL": "fk-check",
             "MEDIUM": "row_count"}
    rule = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("p_type")),
                      F.lit("mystery"))
    size = F.col("p_size")
    blank = lambda cond, c: F.when(cond, c).otherwise("")
    return part.select(
        F.col("p_partkey").alias("id"), rule.alias("rule_type"), blank(size < 45, F.col("p_name")).alias("table_name"),
        blank(size > 5, F.col("p_brand")).alias("column_name"),
        F.when(size < 15, "Critical").when(size < 30, "soft").when(size < 35, "reject").otherwise("").alias("severity"),
        blank(F.col("p_retailprice") < 1000, F.concat(F.lit("a; b|"), size.cast("string"))).alias("rule_expression"),
        blank(F.col("p_retailprice") > 950, size.cast("string")).alias("min_value"),
        F.col("p_name").alias("parent_table"), blank(size > 20, F.lit("id")).alias("parent_column"))


CLASSIFIED = f"""{RULES}, c AS (SELECT id, table_name, column_name, rule_expression AS e, min_value, parent_column,
  CASE rule_type WHEN 'Null Check' THEN 'not_null' WHEN 'picklist' THEN 'accepted_values' WHEN 'range_check' THEN 'range'
    WHEN 'fk-check' THEN 'relationships' WHEN 'row_count' THEN 'file_check'
    ELSE CASE WHEN rule_expression <> '' THEN 'expression' ELSE 'unclassified' END END AS kind,
  CASE severity WHEN 'Critical' THEN 'error' WHEN 'soft' THEN 'warn' WHEN 'reject' THEN 'quarantine' ELSE 'error' END AS severity,
  replace(table_name, ' ', '_') AS "table" FROM rules)"""


@query("classify_rules", f"""WITH {CLASSIFIED}
SELECT id AS rule_id, kind, severity, "table", column_name AS "column",
  CASE WHEN kind = 'accepted_values' AND e <> '' THEN replace(replace(e, '; ', ','), '|', ',') ELSE '' END AS "values",
  CASE WHEN kind = 'range' THEN min_value ELSE '' END AS "min" FROM c""")
def _(t):
    c = quality.classify_rules(part_rules(t.part))
    return c.select("rule_id", "kind", "severity", "table", "column",
                    F.coalesce(F.array_join("values", ","), F.lit("")).alias("values"),
                    F.coalesce("min", F.lit("")).alias("min"))


COMPILED = f"""{CLASSIFIED}, p AS (SELECT *, column_name <> '' AND "table" <> '' AS on_col FROM c),
q AS (SELECT *, CASE WHEN severity = 'quarantine' AND e <> '' AND "table" <> '' AND kind NOT IN ('file_check', 'accepted_values') THEN true
    WHEN kind = 'not_null' THEN on_col WHEN kind = 'accepted_values' THEN on_col AND e <> ''
    WHEN kind = 'range' THEN on_col AND min_value <> '' WHEN kind = 'expression' THEN "table" <> '' ELSE false END AS has_pred FROM p),
r AS (SELECT *, CASE WHEN kind = 'file_check' THEN 'file_check' WHEN has_pred AND (kind = 'expression' OR severity = 'quarantine') THEN 'quarantine'
    WHEN has_pred OR (kind = 'relationships' AND on_col AND parent_column <> '') THEN 'test' ELSE 'unclassified' END AS route FROM q)"""


@query("compile_rules", f"WITH {COMPILED} SELECT id AS rule_id, kind, severity, route, has_pred AS has_predicate FROM r")
def _(t):
    c = quality.compile_rules(part_rules(t.part))
    return c.select("rule_id", "kind", "severity", "route", F.col("predicate").isNotNull().alias("has_predicate"))


@query("rule_summary", f"""WITH {COMPILED} SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE route = 'test') AS test,
  COUNT(*) FILTER (WHERE route = 'quarantine') AS quarantine, COUNT(*) FILTER (WHERE route = 'file_check') AS file_check,
  COUNT(*) FILTER (WHERE route = 'unclassified') AS unclassified FROM r""")
def _(t):
    return quality.rule_summary(quality.compile_rules(part_rules(t.part)))


@query("priority_routing", """SELECT p_partkey, (CASE WHEN p_type = 'ECONOMY' THEN 'fail_' ELSE 'warn_' END) || p_brand AS route,
  's3://lake/' || p_type || '/' || (CASE WHEN p_type = 'ECONOMY' THEN 'fail_' ELSE 'warn_' END) || p_brand AS target_path FROM part""")
def _(t):
    level = F.when(F.col("p_type") == "ECONOMY", "High").otherwise("low")
    rows = t.part.select("p_partkey", F.col("p_brand").alias("rule_name"), level.alias("priority_level"),
                         F.concat(F.lit("s3://lake/"), "p_type", F.lit("/")).alias("dq_failure_path"))
    return quality.priority_routing(rows).select("p_partkey", "route", "target_path")


@query("rule_templates", """SELECT p_brand AS rule_name, p_name AS tgt_table_name, p_type AS column_name,
  'select * from ' || p_name || ' where ' || p_type || ' > ' || s AS check_sql
FROM part JOIN (SELECT p_brand AS b, MAX(lpad(CAST(p_size AS VARCHAR), 3, '0')) AS s FROM part WHERE p_retailprice > 950 GROUP BY 1) m
  ON b = p_brand WHERE p_size > 25""")
def _(t):
    flag = F.when(F.col("p_size") > 25, "A").otherwise("I")
    rules = t.part.select(F.col("p_brand").alias("rule_name"), F.col("p_name").alias("tgt_table_name"),
                          F.col("p_type").alias("column_name"), flag.alias("active_flag"))
    body = F.concat(F.lit("select * from {table} where {column} > "), F.lpad(F.col("p_size").cast("string"), 3, "0"))
    master = t.part.select(F.col("p_brand").alias("rule_name"), body.alias("sql_query"),
                           F.when(F.col("p_retailprice") > 950, "Y").otherwise("N").alias("is_active"))
    return quality.rule_templates(rules, master)


@query("source_freshness", """SELECT CAST(MAX(ts) AS VARCHAR) AS newest,
  round(date_diff('second', date_trunc('second', MAX(ts)), TIMESTAMP '2024-02-01 00:00:00') / 3600.0, 3) AS age_hours,
  CASE WHEN date_diff('second', date_trunc('second', MAX(ts)), TIMESTAMP '2024-02-01 00:00:00') / 3600.0 > 48 THEN 'error'
       WHEN date_diff('second', date_trunc('second', MAX(ts)), TIMESTAMP '2024-02-01 00:00:00') / 3600.0 > 24 THEN 'warn' ELSE 'pass' END AS state
FROM events""")
def _(t):
    rows = t.events.withColumnRenamed("ts", "_loaded_at")
    return quality.source_freshness(rows, "2024-02-01 00:00:00").select(
        F.col("newest").cast("string").alias("newest"), F.round("age_hours", 3).alias("age_hours"), "state")


@query("rule_replay", """SELECT COUNT(*) FILTER (WHERE l_discount < 0.05) AS old_pass, COUNT(*) FILTER (WHERE NOT l_discount < 0.05) AS old_fail,
  COUNT(*) FILTER (WHERE l_discount < 0.03 OR l_quantity > 40) AS new_pass, COUNT(*) FILTER (WHERE NOT (l_discount < 0.03 OR l_quantity > 40)) AS new_fail,
  COUNT(*) FILTER (WHERE l_discount < 0.05 AND NOT (l_discount < 0.03 OR l_quantity > 40)) AS newly_failing,
  COUNT(*) FILTER (WHERE NOT l_discount < 0.05 AND (l_discount < 0.03 OR l_quantity > 40)) AS newly_passing FROM lineitem""")
def _(t):
    return quality.rule_replay(t.lineitem, "l_discount < 0.05", "l_discount < 0.03 or l_quantity > 40")


@query("reject_rate", """WITH n AS (SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE NOT l_tax < 0.08) AS a,
  COUNT(*) FILTER (WHERE NOT l_quantity > 5) AS b FROM lineitem)
SELECT 'tax' AS rule, a AS rejected, total, round(a / total, 6) AS rate, a / total <= 0.1 AS passed FROM n
UNION ALL SELECT 'quantity', b, total, round(b / total, 6), b / total <= 0.1 FROM n""")
def _(t):
    out = quality.reject_rate(t.lineitem, {"tax": "l_tax < 0.08", "quantity": "l_quantity > 5"}, 0.1)
    return out.withColumn("rate", F.round("rate", 6))


@query("file_checks", """WITH f AS (SELECT 'orders_' || strftime(o_orderdate, '%Y%m') || CASE WHEN o_orderstatus = 'P' THEN '.json' ELSE '.csv' END AS file,
  o_orderdate, o_orderpriority FROM orders),
g AS (SELECT file, COUNT(*) AS n, MIN(o_orderpriority) AS h, MAX(o_orderdate) AS d FROM f GROUP BY file)
SELECT file, 'row_count' AS "check", n >= 40 AS passed, CAST(n AS VARCHAR) AS observed FROM g
UNION ALL SELECT file, 'header', lower(h) = '1-urgent', h FROM g
UNION ALL SELECT file, 'file_format', file LIKE '%.csv', split_part(file, '.', 2) FROM g
UNION ALL SELECT file, 'filename', regexp_matches(file, '^orders_199[0-9]{3}'), file FROM g
UNION ALL SELECT file, 'freshness', date_diff('hour', d, TIMESTAMP '2000-01-01') <= 48, CAST(date_diff('hour', d, TIMESTAMP '2000-01-01') AS VARCHAR) || '.0' FROM g""")
def _(t):
    name = F.concat(F.lit("orders_"), F.date_format("o_orderdate", "yyyyMM"),
                    F.when(F.col("o_orderstatus") == "P", ".json").otherwise(".csv"))
    return quality.file_checks(t.orders.withColumn("file_name", name), expected_header=["1-Urgent"],
                               header_col="o_orderpriority", name_pattern="^orders_199[0-9]{3}", formats=("csv",),
                               min_rows=40, loaded_at="o_orderdate", as_of="2000-01-01 00:00:00")


@query("run_tests_failing_spec", """SELECT 'orders' AS model, 'expression' AS kind, 'error' AS status, 0 AS violations FROM (SELECT 1 FROM orders LIMIT 1)
UNION ALL SELECT 'orders', 'not_null', 'passed', 0 UNION ALL SELECT 'orders', 'range', 'failed', COUNT(*) FROM orders WHERE o_totalprice > 100000
UNION ALL SELECT 'orders', 'unique', 'passed', 0 UNION ALL SELECT 'lineitem', 'not_null', 'error', 0""")
def _(t):
    specs = [{"model": "orders", "kind": "expression", "columns": [], "expression": "cast(o_orderpriority as int) > 0"},
             {"model": "orders", "kind": "not_null", "columns": ["o_orderkey"]},
             {"model": "orders", "kind": "range", "columns": ["o_totalprice"], "max": 100000},
             {"model": "orders", "kind": "unique", "columns": ["o_orderkey"]},
             {"model": "lineitem", "kind": "not_null", "columns": ["no_such_column"]}]
    found = quality.run_tests(t.spark, specs, {"orders": t.orders, "lineitem": t.lineitem})
    return found.select("model", "kind", "status", "violations")


@query("file_checks_listing", """WITH l AS (SELECT DISTINCT 'part_' || p_brand || '.csv' AS file FROM part UNION SELECT 'empty_' || p_size || '.csv' FROM part),
g AS (SELECT 'part_' || p_brand || '.csv' AS file, COUNT(*) AS n FROM part GROUP BY 1), f AS (SELECT l.file, coalesce(n, 0) AS n FROM l LEFT JOIN g USING (file))
SELECT file, 'row_count' AS "check", n >= 1 AS passed, CAST(n AS VARCHAR) AS observed FROM f
UNION ALL SELECT file, 'schema', n > 0, CASE WHEN n > 0 THEN '' ELSE 'id,price' END FROM f""")
def _(t):
    named = t.part.select(F.concat(F.lit("part_"), F.col("p_brand"), F.lit(".csv")).alias("file_name"), F.lit("Price, id,name").alias("header"))
    landed = named.select("file_name").unionByName(t.part.select(F.concat(F.lit("empty_"), F.col("p_size").cast("string"), F.lit(".csv")).alias("file_name")))
    return quality.file_checks(named, header_col="header", min_rows=1, listing=landed, expected_columns=["id", "price"])
