"""Reconciliation and profiling queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import keys, profile, ranges, reconcile, states
from ..session import cut_lineage, scratch_path, small_frame
from ..sources import writers
from .base import SQL, query

ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


def rebuilt_orders(orders: DataFrame) -> DataFrame:
    """A candidate build of orders with urgent prices shifted, some rows lost and some invented."""
    price = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") + 10.0).otherwise(F.col("o_totalprice"))
    kept = orders.where("not (o_orderstatus = 'P' and o_orderpriority = '5-LOW')").withColumn("o_totalprice", price)
    extra = orders.where("o_orderstatus = 'F' and o_totalprice > 400000").withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    return kept.unionByName(extra)


REBUILT = """cand AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
         CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 10.0 ELSE o_totalprice END AS o_totalprice,
         o_orderdate, o_orderpriority
  FROM orders WHERE NOT (o_orderstatus = 'P' AND o_orderpriority = '5-LOW')
  UNION ALL
  SELECT -o_orderkey - 1, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
  FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 400000)"""

NUMBERS = {"o_orderkey": 0, "o_custkey": 0, "o_totalprice": 2, "l_orderkey": 0, "l_partkey": 0, "l_suppkey": 0,
           "l_linenumber": 0, "l_quantity": 2, "l_extendedprice": 2, "l_discount": 2, "l_tax": 2}


def fingerprint_sql(table: str, cols) -> str:
    """Per-column metrics of a table as one UNION ALL, in the long form of column_fingerprint."""
    parts = []
    for c in cols:
        shown = f"CAST({c} AS DECIMAL(18,2))" if NUMBERS.get(c) == 2 else c
        metrics = {"nonnull": f"COUNT({c})", "nulls": f"COUNT(*) - COUNT({c})", "distinct": f"COUNT(DISTINCT {c})",
                   "min": f"MIN({shown})", "max": f"MAX({shown})"}
        if c in NUMBERS:
            wide = "CAST({} AS DECIMAL(18,2))" if NUMBERS[c] else "CAST({} AS HUGEINT)"
            n = wide.format(c)
            metrics |= {"sum": f"SUM({n})", "sumsq": f"SUM({n} * {n})"}
        parts += [f"SELECT '{c}' AS \"column\", '{m}' AS metric, CAST({e} AS VARCHAR) AS value FROM {table}"
                  for m, e in metrics.items()]
    return "\nUNION ALL ".join(parts)


LINEITEM = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
            "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
TABLE_COUNT = "SELECT '*' AS \"column\", 'row_count' AS metric, CAST(COUNT(*) AS VARCHAR) AS value FROM {}"


@query("row_count", f"""WITH {REBUILT}, n AS (
  SELECT (SELECT COUNT(*) FROM orders) AS source, (SELECT COUNT(*) FROM cand) AS candidate)
SELECT source, candidate, candidate - source AS delta, abs(candidate - source) <= 0.01 * greatest(1, source) AS match FROM n""")
def _(t):
    return profile.row_count(t.orders, rebuilt_orders(t.orders), tol=0.01)


@query("duplicate_keys", """SELECT COUNT(*) AS duplicate_keys FROM (
  SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING COUNT(*) > 1) d""")
def _(t):
    return profile.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("duplicate_groups", """SELECT l_orderkey, l_linenumber, COUNT(*) AS copies FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1""")
def _(t):
    return profile.duplicate_groups(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("null_keys", """SELECT COUNT(*) FILTER (WHERE doc_id IS NULL OR quality IS NULL) AS null_keys
FROM documents LEFT JOIN labels USING (doc_id)""")
def _(t):
    return profile.null_keys(t.documents.join(t.labels, "doc_id", "left"), ["doc_id", "quality"])


@query("column_fingerprint", TABLE_COUNT.format("lineitem") + "\nUNION ALL " + fingerprint_sql("lineitem", LINEITEM))
def _(t):
    return profile.column_fingerprint(t.lineitem, scale=2)


@query("column_fingerprint_text", TABLE_COUNT.format("documents") + "\nUNION ALL " + fingerprint_sql(
    "documents", ("text", "lang", "source")))
def _(t):
    return profile.column_fingerprint(t.documents, ["text", "lang", "source"])


CHANGED_LINES = """changed AS (SELECT * REPLACE (CASE WHEN l_returnflag = 'R' THEN l_quantity + 1 ELSE l_quantity END AS l_quantity)
  FROM lineitem WHERE NOT (l_returnflag = 'N' AND l_linestatus = 'F'))"""
STATE_COLUMNS = [c for c in LINEITEM if c not in ("l_returnflag", "l_linestatus")]


@query("fingerprint_states", f"""WITH {CHANGED_LINES}, p AS (SELECT COUNT(DISTINCT (l_returnflag, l_linestatus)) AS n FROM lineitem),
r AS (SELECT COUNT(DISTINCT (l_returnflag, l_linestatus)) AS n FROM changed WHERE l_returnflag = 'R'), f AS (
{TABLE_COUNT.format('changed')} UNION ALL {fingerprint_sql('changed', STATE_COLUMNS)})
SELECT "column", metric, CASE WHEN metric = 'distinct' THEN 'within 5 %' ELSE value END AS value FROM f
UNION ALL SELECT '*', 'partitions_read', n || ', ' || (SELECT n FROM r) FROM p""")
def _(t):
    """Lineitem by flag and status: one flag's partitions change, one partition goes, and only the changed are read again."""
    path, kept = scratch_path(t.spark, "lines"), scratch_path(t.spark, "states")
    by = ["l_returnflag", "l_linestatus"]
    t.lineitem.write.partitionBy(*by).parquet(path)
    _, first = states.refresh_states(t.spark, path, by, kept, STATE_COLUMNS, scale=2)
    kinds = t.spark.read.parquet(path)
    with writers.dynamic_overwrite(t.spark):
        more = kinds.where("l_returnflag = 'R'").withColumn("l_quantity", F.col("l_quantity") + 1)
        cut_lineage(more).write.mode("overwrite").partitionBy(*by).parquet(path)
    gone = t.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/l_returnflag=N/l_linestatus=F")
    gone.getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    held, second = states.refresh_states(t.spark, path, by, kept, STATE_COLUMNS, scale=2)
    found = states.merged_fingerprint(held, STATE_COLUMNS)
    exact = profile.distinct_counts(t.spark.read.parquet(path), STATE_COLUMNS).select("column", F.lit("distinct").alias("metric"), "n")
    near = F.abs(F.col("value").cast("double") - F.col("n")) <= 3 * states.sketch_error() * F.col("n")
    shown = F.when(F.col("metric") == "distinct", F.when(near, "within 5 %").otherwise(F.col("value"))).otherwise(F.col("value"))
    reads = small_frame(t.spark, [("*", "partitions_read", f"{first}, {second}")], "column string, metric string, value string")
    return found.join(exact, ["column", "metric"], "left").select("column", "metric", shown.alias("value")).unionByName(reads)


def equal_sql(a: str, b: str, tol: str) -> str:
    na, nb = f"TRY_CAST({a} AS DOUBLE)", f"TRY_CAST({b} AS DOUBLE)"
    return (f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN true WHEN {a} IS NULL OR {b} IS NULL THEN false "
            f"WHEN {na} IS NOT NULL AND {nb} IS NOT NULL THEN abs({na} - {nb}) <= {tol} * greatest(1.0, abs({na}), abs({nb})) "
            f"ELSE trim({a}) = trim({b}) END")


DIFF = (f"WITH {REBUILT}, s AS ({TABLE_COUNT.format('orders')} UNION ALL {fingerprint_sql('orders', ORDERS)}), "
        f"c AS ({TABLE_COUNT.format('cand')} UNION ALL {fingerprint_sql('cand', ORDERS)})")


@query("fingerprint_diff", f"""{DIFF}
SELECT "column", metric, s.value AS source, c.value AS candidate,
       {equal_sql('s.value', 'c.value', "CASE WHEN \"column\" = 'o_custkey' THEN 0.5 ELSE 1e-6 END")} AS match
FROM s FULL OUTER JOIN c USING ("column", metric)""")
def _(t):
    a = profile.column_fingerprint(t.orders, scale=2)
    b = profile.column_fingerprint(rebuilt_orders(t.orders), scale=2)
    return profile.fingerprint_diff(a, b, col_tol={"O_CUSTKEY": 0.5})


RECONCILE = f"""{DIFF}, j AS (
  SELECT "column", metric, s.value AS source, c.value AS candidate, {equal_sql('s.value', 'c.value', '1e-6')} AS m
  FROM s FULL OUTER JOIN c USING ("column", metric) WHERE "column" <> 'o_orderkey'),
k AS (SELECT 'duplicate_keys' AS metric,
        (SELECT COUNT(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING COUNT(*) > 1) x) AS s,
        (SELECT COUNT(*) FROM (SELECT o_orderkey FROM cand GROUP BY 1 HAVING COUNT(*) > 1) x) AS c
      UNION ALL SELECT 'null_keys', (SELECT COUNT(*) FROM orders WHERE o_orderkey IS NULL),
        (SELECT COUNT(*) FROM cand WHERE o_orderkey IS NULL))
SELECT 'orders' AS pair, CASE WHEN "column" = '*' THEN 'row_count' ELSE 'fingerprint' END AS "check", "column", metric,
       source, candidate, m AS match FROM j
UNION ALL SELECT 'orders', 'key', '*', metric, CAST(s AS VARCHAR), CAST(c AS VARCHAR), s = 0 AND c = 0 FROM k"""


@query("reconcile", RECONCILE)
def _(t):
    verdict = reconcile.reconcile(t.orders, rebuilt_orders(t.orders), ["o_orderkey"], scale=2, pair="orders")
    return verdict.checks.drop("detail")


@query("reconcile_empty_slice", f"""WITH {REBUILT}
SELECT 'orders' AS pair, 'row_count' AS "check", '*' AS "column", 'row_count' AS metric,
  (SELECT CAST(COUNT(*) AS VARCHAR) FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW') AS source,
  (SELECT CAST(COUNT(*) AS VARCHAR) FROM cand WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW') AS candidate,
  false AS match, 'the candidate has no rows after the filter: build or load it first' AS detail""")
def _(t):
    return reconcile.reconcile(t.orders, rebuilt_orders(t.orders), ["o_orderkey"], scale=2, pair="orders",
                               where="o_orderstatus = 'P' and o_orderpriority = '5-LOW'").checks


@query("reconcile_many", f"""WITH {REBUILT}, f AS (
  SELECT 'customer' AS pair, 0 AS failures UNION ALL
  SELECT 'lineitem', 2 * CAST(EXISTS (
    SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1) AS INTEGER) / 2 UNION ALL
  SELECT 'orders', CAST((SELECT COUNT(*) FROM orders) <> (SELECT COUNT(*) FROM cand) AS INTEGER) + (
    SELECT COUNT(*) FROM (SELECT {equal_sql('s.value', 'c.value', '1e-6')} AS m FROM
      ({fingerprint_sql('orders', ORDERS[1:])}) s FULL OUTER JOIN ({fingerprint_sql('cand', ORDERS[1:])}) c
      USING ("column", metric)) WHERE NOT m))
SELECT pair, failures = 0 AS passed, CAST(failures AS BIGINT) AS failures FROM f""")
def _(t):
    pairs = [{"name": "customer", "source": t.customer, "candidate": t.customer, "key": "c_custkey"},
             {"name": "lineitem", "source": t.lineitem, "candidate": t.lineitem, "key": "l_orderkey, l_linenumber"},
             {"name": "orders", "source": t.orders, "candidate": rebuilt_orders(t.orders), "key": ["o_orderkey"],
              "containment": [{"child_columns": ["o_custkey"], "parent": t.customer, "parent_columns": ["c_custkey"]}]}]
    return reconcile.reconcile_many(t.spark, pairs, scale=2).summary()


STRAY = "SELECT * REPLACE (CASE WHEN o_orderstatus = 'P' THEN o_custkey + 200000 ELSE o_custkey END AS o_custkey) FROM orders"


def stray_orders(orders: DataFrame) -> DataFrame:
    key = F.when(F.col("o_orderstatus") == "P", F.col("o_custkey") + 200000).otherwise(F.col("o_custkey"))
    return orders.withColumn("o_custkey", key)


@query("check_containment", f"""SELECT COUNT(*) AS orphans FROM ({STRAY}) o
WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)""")
def _(t):
    return reconcile.check_containment(stray_orders(t.orders), t.customer, [("o_custkey", "c_custkey")])


@query("check_containment_compound", """SELECT COUNT(*) AS orphans FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM (SELECT l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_returnflag = 'A') a
                  WHERE a.p = l.l_partkey AND a.s = l.l_suppkey)""")
def _(t):
    seen = t.lineitem.where("l_returnflag = 'A'")
    return reconcile.check_containment(t.lineitem, seen, ["l_partkey", "l_suppkey"])


@query("orphan_rows", f"""SELECT o_orderkey, o_custkey, o_totalprice FROM ({STRAY}) o
WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)""")
def _(t):
    return reconcile.orphan_rows(stray_orders(t.orders), t.customer, [("o_custkey", "c_custkey")]).select(
        "o_orderkey", "o_custkey", "o_totalprice")


@query("reconcile_rows", f"""WITH {REBUILT}
SELECT coalesce(s.o_orderkey, c.o_orderkey) AS o_orderkey,
  CASE WHEN c.o_orderkey IS NULL THEN 'missing' WHEN s.o_orderkey IS NULL THEN 'extra' ELSE 'changed' END AS status,
  CASE WHEN s.o_orderkey IS NOT NULL AND c.o_orderkey IS NOT NULL THEN 'o_totalprice' ELSE '' END AS changed
FROM orders s FULL OUTER JOIN cand c ON s.o_orderkey = c.o_orderkey
WHERE s.o_orderkey IS NULL OR c.o_orderkey IS NULL OR s.o_totalprice <> c.o_totalprice""")
def _(t):
    return reconcile.reconcile_rows(t.orders, rebuilt_orders(t.orders), ["o_orderkey"]).select(
        "o_orderkey", "status", F.array_join("changed_columns", ",").alias("changed"))


@query("reconcile_rows_tolerance", f"""WITH {REBUILT}
SELECT coalesce(s.o_orderkey, c.o_orderkey) AS o_orderkey,
  CASE WHEN c.o_orderkey IS NULL THEN 'missing' WHEN s.o_orderkey IS NULL THEN 'extra' ELSE 'changed' END AS status
FROM orders s FULL OUTER JOIN cand c ON s.o_orderkey = c.o_orderkey
WHERE s.o_orderkey IS NULL OR c.o_orderkey IS NULL
   OR abs(s.o_totalprice - c.o_totalprice) > 0.0001 * greatest(1, s.o_totalprice, c.o_totalprice)""")
def _(t):
    return reconcile.reconcile_rows(t.orders, rebuilt_orders(t.orders), ["o_orderkey"],
                                    col_tol={"o_totalprice": 1e-4}).select("o_orderkey", "status")


@query("reconcile_rows_by_ranges", SQL["reconcile_rows"])
def _(t):
    found = ranges.reconcile_rows_by_ranges(t.orders, rebuilt_orders(t.orders), ["o_orderkey"])
    return found.select("o_orderkey", "status", F.array_join("changed_columns", ",").alias("changed"))


@query("reconcile_rows_by_ranges_repeated_keys", """WITH c AS (SELECT * REPLACE (CASE WHEN l_orderkey % 97 = 5 THEN l_tax + 1 ELSE l_tax END AS l_tax)
  FROM lineitem WHERE NOT (l_orderkey % 89 = 3 AND l_returnflag = 'R')),
s AS (SELECT l_orderkey, l_linenumber, COUNT(*) AS n, SUM(CAST(l_tax AS DECIMAL(18,2))) AS x FROM lineitem GROUP BY ALL),
k AS (SELECT l_orderkey, l_linenumber, COUNT(*) AS m, SUM(CAST(l_tax AS DECIMAL(18,2))) AS y FROM c GROUP BY ALL)
SELECT l_orderkey, l_linenumber, CASE WHEN m IS NULL THEN 'missing' WHEN m <> n THEN 'recount' ELSE 'changed' END AS status,
       n AS source_rows, coalesce(m, 0) AS candidate_rows FROM s LEFT JOIN k USING (l_orderkey, l_linenumber) WHERE m IS DISTINCT FROM n OR x <> y""")
def _(t):
    taxed = t.lineitem.withColumn("l_tax", F.when(F.col("l_orderkey") % 97 == 5, F.col("l_tax") + 1).otherwise(F.col("l_tax")))
    cand = taxed.where("not (l_orderkey % 89 = 3 and l_returnflag = 'R')")
    return ranges.reconcile_rows_by_ranges(t.lineitem, cand, ["l_orderkey", "l_linenumber"]).drop("changed_columns")


@query("range_digests", f"""WITH {REBUILT}, b AS (SELECT least(min(s), min(c)) AS low, greatest(max(s), max(c)) AS high FROM (
    SELECT o_orderkey AS s, NULL AS c FROM orders UNION ALL SELECT NULL, o_orderkey FROM cand)),
w AS (SELECT low, (high - low + 1 + 1023) // 1024 AS width FROM b),
s AS (SELECT (o_orderkey - low) // width AS n, COUNT(*) AS source_rows, list(o_totalprice ORDER BY o_orderkey) AS v, list(o_orderkey ORDER BY o_orderkey) AS k FROM orders, w GROUP BY 1),
c AS (SELECT (o_orderkey - low) // width AS n, COUNT(*) AS candidate_rows, list(o_totalprice ORDER BY o_orderkey) AS v, list(o_orderkey ORDER BY o_orderkey) AS k FROM cand, w GROUP BY 1)
SELECT CAST(n AS INTEGER) AS "range", coalesce(source_rows, 0) AS source_rows, coalesce(candidate_rows, 0) AS candidate_rows
FROM s FULL OUTER JOIN c USING (n) WHERE s.k IS DISTINCT FROM c.k OR s.v IS DISTINCT FROM c.v""")
def _(t):
    """The ranges of orders that differ, and the rows of each side in them, from digests alone."""
    cand = rebuilt_orders(t.orders)
    plan = ranges.plan_ranges(t.orders, cand, ["o_orderkey"], fanout=32)
    a, b = (cut_lineage(ranges.range_digests(df, plan)) for df in (t.orders, cand))
    found, _ = ranges.differing_ranges(a, b, plan)
    counts = a.select("range", F.col("rows").alias("source_rows")).join(b.select("range", F.col("rows").alias("candidate_rows")), "range", "full_outer")
    return counts.where(F.col("range").isin(found)).na.fill(0)


@query("reconcile_rows_repeated_keys", """WITH c AS (SELECT * FROM lineitem WHERE l_returnflag <> 'R'),
s AS (SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY ALL),
k AS (SELECT l_orderkey, l_linenumber, COUNT(*) AS m FROM c GROUP BY ALL)
SELECT l_orderkey, l_linenumber, CASE WHEN m IS NULL THEN 'missing' ELSE 'recount' END AS status,
       n AS source_rows, coalesce(m, 0) AS candidate_rows
FROM s LEFT JOIN k USING (l_orderkey, l_linenumber) WHERE m IS DISTINCT FROM n""")
def _(t):
    cand = t.lineitem.where("l_returnflag <> 'R'")
    return reconcile.reconcile_rows(t.lineitem, cand, ["l_orderkey", "l_linenumber"]).drop("changed_columns")


# A column catalogue that grows with part: every part is a column of the table named by its brand.
PART_TYPES = """CASE p_type WHEN 'ECONOMY' THEN 'int' WHEN 'STANDARD' THEN 'string' ELSE 'decimal(' || (p_size % 18 + 1) || ',0)' END"""
PART_COLUMNS = f"""cols AS (SELECT p_brand AS "table", replace(p_name, ' ', '_') || '_' || p_size % 7 AS col_name,
  {PART_TYPES} AS col_type, p_type FROM part)"""


def part_columns(part: DataFrame) -> DataFrame:
    kind = (F.when(F.col("p_type") == "ECONOMY", "int").when(F.col("p_type") == "STANDARD", "string")
            .otherwise(F.concat(F.lit("decimal("), (F.col("p_size") % 18 + 1).cast("string"), F.lit(",0)"))))
    return part.select(F.col("p_brand").alias("table"),
                       F.concat(F.translate("p_name", " ", "_"), F.lit("_"), (F.col("p_size") % 7).cast("string")).alias("col_name"),
                       kind.alias("col_type"), "p_type")


@query("schema_parity", f"""WITH {PART_COLUMNS},
s AS (SELECT DISTINCT "table", col_name AS c FROM cols WHERE p_type <> 'PROMO'),
k AS (SELECT DISTINCT "table", col_name AS c FROM cols WHERE p_type <> 'ECONOMY')
SELECT "table", c AS "column", 'only_in_source' AS side FROM (FROM s EXCEPT FROM k)
UNION ALL SELECT "table", c, 'only_in_candidate' FROM (FROM k EXCEPT FROM s)""")
def _(t):
    cols = part_columns(t.part)
    upper = cols.where("p_type <> 'ECONOMY'").withColumn("col_name", F.upper("col_name"))
    return profile.schema_parity(cols.where("p_type <> 'PROMO'"), upper)


@query("type_drift", f"""WITH {PART_COLUMNS},
s AS (SELECT "table", col_name AS c, MAX(col_type) AS a FROM cols WHERE p_type <> 'PROMO' GROUP BY ALL),
k AS (SELECT "table", col_name AS c, MAX(col_type) AS b FROM cols WHERE p_type <> 'ECONOMY' GROUP BY ALL)
SELECT "table", c AS "column", a AS source, b AS candidate,
  CASE WHEN (a = 'string') <> (b = 'string') THEN 'numeric_drift' ELSE 'translated' END AS finding
FROM s JOIN k USING ("table", c) WHERE a <> b""")
def _(t):
    cols = part_columns(t.part)
    return profile.type_drift(cols.where("p_type <> 'PROMO'"), cols.where("p_type <> 'ECONOMY'"))


@query("column_set_diff", """SELECT name, CASE WHEN a AND b THEN 'both' WHEN a THEN 'only_a' ELSE 'only_b' END AS side FROM (
  SELECT coalesce(x.n, y.n) AS name, x.n IS NOT NULL AS a, y.n IS NOT NULL AS b
  FROM (SELECT DISTINCT lower(p_name) AS n FROM part) x
  FULL OUTER JOIN (SELECT DISTINCT lower(p_name) || CASE WHEN p_size > 25 THEN '_new' ELSE '' END AS n FROM part) y ON x.n = y.n)""")
def _(t):
    return profile.column_set_diff(t.part.select("p_name"),
                                   t.part.select(F.upper(F.concat("p_name", F.when(F.col("p_size") > 25, "_new").otherwise("")))))


# Column names as they appear in warehouses, made from the rows of part.
NAMED = """named AS (SELECT p_partkey, p_brand, CASE p_type
  WHEN 'ECONOMY' THEN replace(p_name, ' ', '_') || '_sk' WHEN 'STANDARD' THEN 'dwh_' || p_size || '_ts'
  WHEN 'PROMO' THEN 'job_' || p_size || '_run_id' WHEN 'SMALL' THEN 'loaded_at'
  ELSE replace(p_name, ' ', '_') || '_id' END AS col_name FROM part)"""


def named_columns(part: DataFrame) -> DataFrame:
    base = F.translate("p_name", " ", "_")
    size = F.col("p_size").cast("string")
    name = (F.when(F.col("p_type") == "ECONOMY", F.concat(base, F.lit("_sk")))
            .when(F.col("p_type") == "STANDARD", F.concat(F.lit("dwh_"), size, F.lit("_ts")))
            .when(F.col("p_type") == "PROMO", F.concat(F.lit("job_"), size, F.lit("_run_id")))
            .when(F.col("p_type") == "SMALL", F.lit("loaded_at"))
            .otherwise(F.concat(base, F.lit("_id"))))
    return part.select("p_partkey", "p_brand", name.alias("col_name"))


@query("suggest_exclude", f"""WITH {NAMED} SELECT p_partkey, col_name,
  CASE WHEN col_name LIKE '%\\_sk' ESCAPE '\\' THEN 'surrogate' ELSE 'run_stamp' END AS reason
FROM named WHERE col_name LIKE '%\\_sk' ESCAPE '\\' OR col_name LIKE 'dwh\\_%\\_ts' ESCAPE '\\'
  OR col_name LIKE '%\\_run\\_id' ESCAPE '\\' OR col_name = 'loaded_at'""")
def _(t):
    return reconcile.suggest_exclude(named_columns(t.part)).select("p_partkey", "col_name", "reason")


@query("suggest_key", """WITH c AS (
  SELECT 'gold.dim_' || replace(p_name, ' ', '_') AS t, CASE WHEN p_size < 5 THEN 'ID' WHEN p_size < 10
    THEN replace(p_name, ' ', '_') || '_id' ELSE p_type END AS col_name FROM part),
d AS (SELECT DISTINCT 'dim_' || replace(p_name, ' ', '_') AS b FROM part WHERE p_retailprice > 980)
SELECT t AS "table", CASE WHEN bool_or(b IS NOT NULL) THEN 'part_key'
    WHEN bool_or(col_name = substr(t, 10) || '_id') THEN max(col_name) FILTER (WHERE col_name = substr(t, 10) || '_id')
    WHEN bool_or(col_name = 'ID') THEN 'ID' ELSE '' END AS key,
  CASE WHEN bool_or(b IS NOT NULL) THEN 'declared_relationship'
    WHEN bool_or(col_name = substr(t, 10) || '_id') THEN 'name_match'
    WHEN bool_or(col_name = 'ID') THEN 'id_column' ELSE 'none' END AS key_source
FROM c LEFT JOIN d ON b = substr(t, 6) GROUP BY t""")
def _(t):
    base = F.translate("p_name", " ", "_")
    name = (F.when(F.col("p_size") < 5, "ID").when(F.col("p_size") < 10, F.concat(base, F.lit("_id")))
            .otherwise(F.col("p_type")))
    cols = t.part.select(F.concat(F.lit("gold.dim_"), base).alias("table"), name.alias("col_name"))
    rels = t.part.where("p_retailprice > 980").select(
        F.concat(F.lit("x.dim_"), base).alias("pk_table"), F.array(F.lit("part_key")).alias("pk_columns"))
    return reconcile.suggest_key(cols, rels).withColumn("key", F.coalesce(F.array_join("key", ","), F.lit("")))


@query("confirm_key", """SELECT (SELECT COUNT(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1)) AS duplicate_keys,
  0 AS null_keys, NOT EXISTS (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1) AS usable""")
def _(t):
    return reconcile.confirm_key(t.lineitem, ["l_orderkey", "l_linenumber"])


KEY_COLUMNS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
KEY_SETS = [c for n in (1, 2, 3) for c in combinations(KEY_COLUMNS, n)]
UNIQUE_SETS = "\nUNION ALL ".join(
    f"SELECT {list(s)} AS s FROM lineitem HAVING COUNT(DISTINCT ({', '.join(s)}{', 0' if len(s) == 1 else ''})) = COUNT(*)" for s in KEY_SETS)


@query("minimal_keys", f"""WITH u AS ({UNIQUE_SETS}) SELECT array_to_string(s, ',') AS columns, CAST(len(s) AS INTEGER) AS size FROM u
WHERE NOT EXISTS (SELECT 1 FROM u AS v WHERE len(v.s) < len(u.s) AND list_has_all(u.s, v.s))""")
def _(t):
    return keys.minimal_keys(t.lineitem, list(KEY_COLUMNS)).select(F.array_join("columns", ",").alias("columns"), "size")


@query("slice_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 1000 AND 2000")
def _(t):
    return reconcile.slice_filter(t.orders, "o_orderstatus = 'F' and o_totalprice between 1000 and 2000").select("o_orderkey")


# ---- large numbers, failures and drift that cancels out ---------------------------------------

@query("column_fingerprint_wide", """WITH t AS (SELECT CAST(o_orderkey % 9 AS HUGEINT) * 1000000000000000000 + o_orderkey AS big, CAST(epoch_us(o_orderdate) AS HUGEINT) AS moment FROM orders),
v AS (SELECT 'big' AS "column", big AS x FROM t UNION ALL SELECT 'moment', moment FROM t)
SELECT "column", CAST(SUM(x) AS VARCHAR) AS sum, format('{:.9e}', SUM(CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS sumsq, COUNT(DISTINCT x) AS n FROM v GROUP BY 1""")
def _(t):
    # squares of 64-bit numbers and of times in microseconds leave every decimal
    big = (F.col("o_orderkey") % 9).cast("long") * F.lit(10 ** 18) + F.col("o_orderkey")
    at = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    found = profile.column_fingerprint(t.orders.select(big.alias("big"), at.alias("moment")))
    value = lambda metric: F.max(F.when(F.col("metric") == metric, F.col("value")))
    return found.where("column <> '*'").groupBy("column").agg(
        value("sum").alias("sum"), F.format_string("%.9e", value("sumsq").cast("double")).alias("sumsq"), value("distinct").cast("long").alias("n"))


@query("reconcile_failing_pair", """SELECT 'good' AS pair, true AS passed, '' AS failed UNION ALL SELECT 'broken', false, 'error' UNION ALL
SELECT 'less', false, CASE WHEN (SELECT COUNT(*) FROM orders WHERE o_orderkey % 2 = 0) > 0 THEN 'row_count' ELSE '' END""")
def _(t):
    small = t.orders.select("o_orderkey", "o_totalprice")
    broken = small.withColumn("o_totalprice", F.concat(F.lit("no number "), F.col("o_orderkey").cast("string")).cast("double"))
    verdict = reconcile.reconcile_many(t.spark, [
        {"name": "good", "source": small, "candidate": small, "key": "o_orderkey"},
        {"name": "broken", "source": small, "candidate": broken, "key": "o_orderkey"},
        {"name": "less", "source": small, "candidate": small.where("o_orderkey % 2 = 1"), "key": "o_orderkey"}])
    failed = F.coalesce(F.max(F.when(~F.col("match") & F.col("check").isin("error", "row_count"), F.col("check"))), F.lit(""))
    return verdict.checks.groupBy("pair").agg(F.bool_and("match").alias("passed"), failed.alias("failed"))


@query("reconcile_rows_drift", """SELECT o_custkey FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1) WHERE n > 1""")
def _(t):
    # the first and the last order of a customer drift in opposite directions: sums stay, prices do not
    own = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    back = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderkey"))
    price = F.col("o_totalprice")
    step = F.when(F.row_number().over(own) == 1, 1).otherwise(0) - F.when(F.row_number().over(back) == 1, 1).otherwise(0)
    moved = t.orders.withColumn("o_totalprice", price + step * 1e6)
    return reconcile.reconcile_rows(t.orders, moved, ["o_custkey"], ["o_totalprice"], tol=1e-6).select("o_custkey")
