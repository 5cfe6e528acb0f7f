"""Lineage and catalogue queries over scripts and catalogues that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import catalog, lineage, measures
from ..session import spread
from .base import query

# ---- a script corpus: every part is a job whose idiom follows its type -----------------------

SCRIPT = {
    "ECONOMY": 'df = spark.read.table("raw_db.{n}")\ndf.write.mode("overwrite").saveAsTable("Curated.{n}_{s}")\n',
    "STANDARD": 'df = spark.read.parquet("s3://Lake/landing/{n}/")\n# ' + "-" * 90 + '\ndf.write.save("s3://lake/silver/{n}")\n',
    "PROMO": 'spark.sql("""with recent as (select * from raw_db.{n})\ninsert into gold.{n}_{s} select * from recent join silver.{n}""")\n',
    "SMALL": 'dyf = ctx.create_dynamic_frame.from_catalog(database="raw_db", table_name="{n}")\nfor c in dyf.columns: print(c)\n' + "#" * 250
             + '\ndyf.toDF().write.format("snowflake").option("dbtable", "CRM.PUBLIC.{n}").save()\n',
    "MEDIUM": 'import pandas as pd\nfiles = {{"{n}.xlsx": "{n}_{s}", "b.csv": "other"}}\nfor f, t in files.items():\n    pd.read_excel(f)\n    df.write.parquet(out + t)\n',
    "LARGE": 'for t in tables:\n    df = spark.read.load(f"s3://{{bucket}}/silver/{{t}}/")\n    df.write.insertInto("gold.{n}")\n',
}


def script_text(part):
    n, s = F.translate("p_name", " ", "_"), F.col("p_size").cast("string")
    out = None
    for kind, text in SCRIPT.items():
        body = F.lit(text.replace("{{", "\u0001").replace("}}", "\u0002"))
        body = F.replace(F.replace(body, F.lit("{n}"), n), F.lit("{s}"), s)
        body = F.translate(body, "\u0001\u0002", "{}")
        out = F.when(F.col("p_type") == kind, body) if out is None else out.when(F.col("p_type") == kind, body)
    return out


def scripts_of(part):
    part = spread(part.select("p_partkey", "p_name", "p_type", "p_size"))  # a few files, and a script takes far longer than its bytes
    return part.select(F.concat(F.lit("job_"), F.col("p_partkey").cast("string")).alias("name"), script_text(part).alias("text"))


IO = """src AS (SELECT 'job_' || p_partkey AS name, p_type, replace(p_name, ' ', '_') AS n, replace(p_name, ' ', '_') || '_' || p_size AS ns FROM part),
io AS (SELECT name, p_type, CASE p_type WHEN 'ECONOMY' THEN ['raw_db.' || n] WHEN 'STANDARD' THEN ['s3://lake/landing/' || n || '/'] WHEN 'PROMO' THEN ['raw_db.' || n, 'silver.' || n]
    WHEN 'SMALL' THEN ['raw_db.' || n] WHEN 'MEDIUM' THEN [] ELSE ['s3://silver'] END AS reads,
  CASE p_type WHEN 'ECONOMY' THEN ['curated.' || ns] WHEN 'STANDARD' THEN ['s3://lake/silver/' || n] WHEN 'PROMO' THEN ['gold.' || ns]
    WHEN 'SMALL' THEN ['crm.public.' || n] WHEN 'MEDIUM' THEN list_sort([ns, 'other']) ELSE ['gold.' || n] END AS writes,
  p_type IN ('STANDARD', 'MEDIUM', 'LARGE') AS external FROM src)"""


@query("extract_io", f"WITH {IO} SELECT name, array_to_string(reads, ',') AS reads, array_to_string(writes, ',') AS writes, external FROM io")
def _(t):
    io = lineage.extract_io(scripts_of(t.part))
    return io.select("name", F.array_join("reads", ",").alias("reads"), F.array_join("writes", ",").alias("writes"), "external")


@query("extract_sql_tables", """SELECT p_partkey AS name, 'raw.' || lower(p_brand[1:5]) || p_size AS "table" FROM part
UNION ALL SELECT p_partkey, 'lake.' || replace(p_name, ' ', '_') FROM part WHERE p_type <> 'PROMO'""")
def _(t):
    n, brand = F.translate("p_name", " ", "_"), F.concat(F.substring("p_brand", 1, 5), F.col("p_size").cast("string"))
    sql = F.concat(F.lit('WITH base AS (SELECT * FROM "RAW".'), brand, F.lit(") select * from base b"), F.when(
        F.col("p_type") != "PROMO", F.concat(F.lit(" left join lake."), n, F.lit(" x on x.id = b.id join raw."), brand)).otherwise(""))
    return lineage.extract_sql_tables(t.part.select(F.col("p_partkey").alias("name"), sql.alias("sql")))


@query("extract_sql_scopes", """WITH p AS (SELECT p_partkey AS name, lower(replace(p_name, ' ', '_')) AS n, p_size % 2 = 0 AS even FROM part)
SELECT name, unnest(['raw.' || n, 't_' || n || '_x', 'raw.k' || name, 'u', 'v', 't_' || n, CASE WHEN even THEN 'base' ELSE 'r' END]) AS "table" FROM p""")
def _(t):
    """Nested WITHs, several statements, and names of tables that are those of a CTE elsewhere."""
    sql = """with t_{n} as (select * from raw.{n}), u(a, b) as (select * from T_{n} join t_{n}_x on true)
select * from u where a in (with v as (select 1 from raw.k{k}) select * from v) and b > (1);
select extract(day from d) from u join v, t_{n}; """
    n = F.translate("p_name", " ", "_")
    text = F.replace(F.replace(F.lit(sql), F.lit("{n}"), n), F.lit("{k}"), F.col("p_partkey").cast("string"))
    last = F.when(F.col("p_size") % 2 == 0, "with recursive r as (select * from base union all select * from r) select * from r").otherwise("with r as (select * from r) select * from r")
    return lineage.extract_sql_tables(t.part.select(F.col("p_partkey").alias("name"), F.concat(text, last).alias("sql")))


@query("extract_sql_tables_quoted", """SELECT p_partkey AS name, unnest(['raw.public.' || lower(p_brand[1:5]), 'db.t' || p_size, 'a.b', 'c.' || replace(p_name, ' ', '_')]) AS "table" FROM part""")
def _(t):
    # view text as warehouses give it out: quoted names, comments, literals, lists, FROM inside calls
    sql = F.concat(F.lit("/* from no.comment */ select extract(day from ts), trim(both ' ' from x), 'from no.literal' -- join no.remark\nfrom \"RAW\".\"PUBLIC\".\""),
                   F.substring("p_brand", 1, 5), F.lit('" r, `db`.`t'), F.col("p_size").cast("string"),
                   F.lit("` as t2, a.b join c."), F.translate("p_name", " ", "_"), F.lit(" on r.x is not distinct from a.x, lateral flatten(r.y), unnest(r.z)"))
    return lineage.extract_sql_tables(t.part.select(F.col("p_partkey").alias("name"), sql.alias("sql")))


@query("resolve_long_reference", """SELECT o_orderkey AS id, 'w' || o_orderkey % 7 || '.t' AS full_name FROM orders""")
def _(t):
    # references of some sixty parts, as sub-selects have them, that share one part with one table
    filler = ".".join(f"x{i}" for i in range(60))
    ref = F.concat(F.lit(filler + ".w"), (F.col("o_orderkey") % 7).cast("string"), F.lit(".k"), F.col("o_orderkey").cast("string"), F.lit(".t"))
    tables = t.orders.select(F.concat(F.lit("w"), (F.col("o_orderkey") % 7).cast("string"), F.lit(".t")).alias("full_name")).distinct()
    refs = t.orders.select("o_orderkey", ref.alias("ref"))
    found = lineage.resolve_reference(refs.select("ref"), tables)
    return refs.join(found, "ref").select(F.col("o_orderkey").alias("id"), "full_name")


@query("classify_jobs", f"""WITH {IO} SELECT name, CASE p_type WHEN 'SMALL' THEN 'publish' WHEN 'STANDARD' THEN 'transformation' WHEN 'LARGE' THEN 'transformation'
  WHEN 'MEDIUM' THEN 'ingestion' ELSE CASE WHEN list_contains((SELECT list('raw_db.' || replace(p_name, ' ', '_')) FROM part WHERE p_size > 48), reads[1]) THEN
    CASE WHEN p_type = 'PROMO' THEN 'ingestion' ELSE 'transformation' END ELSE 'ingestion' END END AS kind FROM io""")
def _(t):
    scripts = scripts_of(t.part)
    known = t.part.where("p_size > 48").select(F.concat(F.lit("RAW_DB."), F.translate("p_name", " ", "_")).alias("full_name"))
    return lineage.classify_jobs(lineage.extract_io(scripts), known, scripts)


# ---- a catalogue: every part is a table of some system and schema ----------------------------

def catalog_of(part):
    n = F.translate("p_name", " ", "_")
    size = F.col("p_size")
    full = (F.when(size < 8, F.concat(F.lit("raw_db."), n)).when(size < 16, F.concat(F.lit("LAKE.curated."), n))
            .when(size < 24, F.concat(F.lit("crm_gold.dim_"), n)).when(size < 32, F.concat(F.lit("DWH.PUBLIC."), n))
            .when(size < 40, F.concat(F.lit("DWH.PUBLIC.DIM_"), n)).otherwise(F.concat(F.lit("DWH.S"), size.cast("string"), F.lit("."), n)))
    return part.select("p_partkey", full.alias("full_name"), F.when(size < 24, "lake").otherwise("warehouse").alias("system"),
                       F.when(size % 10 == 9, "view").otherwise("table").alias("kind"),
                       F.array("p_brand", "p_type", F.lit("id"), F.lit("Id")).alias("columns"))


CATALOG = """cat AS (SELECT p_partkey, CASE WHEN p_size < 8 THEN 'raw_db.' || n WHEN p_size < 16 THEN 'LAKE.curated.' || n WHEN p_size < 24 THEN 'crm_gold.dim_' || n
    WHEN p_size < 32 THEN 'DWH.PUBLIC.' || n WHEN p_size < 40 THEN 'DWH.PUBLIC.DIM_' || n ELSE 'DWH.S' || p_size || '.' || n END AS full_name,
  CASE WHEN p_size < 24 THEN 'lake' ELSE 'warehouse' END AS system, CASE WHEN p_size % 10 = 9 THEN 'view' ELSE 'table' END AS kind, p_size,
  list_sort(list_distinct([lower(p_brand), lower(p_type), 'id'])) AS cols FROM (SELECT *, replace(p_name, ' ', '_') AS n FROM part)),
tabs AS (SELECT lower(full_name) AS norm, MIN(full_name) AS full_name, split_part(lower(full_name), '.', -1) AS base FROM cat GROUP BY ALL)"""

RESOLVED = """wanted AS (SELECT DISTINCT ref, split_part(ref, '.', -1) AS base FROM refs),
hits AS (SELECT w.ref, k.full_name, w.ref = k.norm AS exact, len(list_intersect(list_distinct(string_split(w.ref, '.')), string_split(k.norm, '.'))) AS score FROM wanted w JOIN tabs k USING (base)),
top AS (SELECT ref, MAX(score) AS s FROM hits GROUP BY 1),
uniq AS (SELECT h.ref, MIN(h.full_name) AS full_name FROM hits h JOIN top ON top.ref = h.ref AND score = s GROUP BY 1 HAVING COUNT(*) = 1),
res AS (SELECT w.ref, coalesce(e.full_name, u.full_name) AS full_name FROM wanted w LEFT JOIN (SELECT ref, full_name FROM hits WHERE exact) e ON e.ref = w.ref LEFT JOIN uniq u ON u.ref = w.ref)"""


@query("resolve_reference", f"""WITH {IO}, {CATALOG}, refs AS (SELECT unnest(list_concat(reads, writes)) AS ref FROM io), {RESOLVED}
SELECT ref, coalesce(full_name, '') AS full_name FROM res""")
def _(t):
    io = lineage.extract_io(scripts_of(t.part))
    return lineage.resolve_reference(lineage.io_rows(io), catalog_of(t.part)).fillna("")


# The lake schema decides the layer: raw_db is bronze, crm_gold gold, and "lake" (of LAKE.curated) says nothing, so bronze.
NAME_MATCH = """named AS (SELECT DISTINCT system, system || ':' || lower(full_name) AS node, split_part(lower(full_name), '.', -1) AS base,
    CASE WHEN p_size < 16 THEN 'load' ELSE 'copy' END AS label FROM cat WHERE system IN ('lake', 'warehouse')),
both_sides AS (SELECT base FROM named GROUP BY 1 HAVING COUNT(DISTINCT system) = 2),
nm AS (SELECT DISTINCT node AS src, 'name:' || base AS dst, label FROM named WHERE system = 'lake' AND base IN (FROM both_sides)
  UNION SELECT 'name:' || base, node, 'same_name' FROM named WHERE system = 'warehouse' AND base IN (FROM both_sides))"""


@query("name_match_edges", f"WITH {CATALOG}, {NAME_MATCH} SELECT * FROM nm")
def _(t):
    return lineage.name_match_edges(catalog_of(t.part))


FK = """fk AS (SELECT DISTINCT CASE WHEN fs < 24 THEN 'lake:' ELSE 'warehouse:' END || f AS src, CASE WHEN ps < 24 THEN 'lake:' ELSE 'warehouse:' END || p AS dst, 'fk' AS label FROM (
  SELECT x.f, x.p, a.p_size AS fs, b.p_size AS ps FROM (SELECT 'raw_db.' || replace(p_name, ' ', '_') AS f, 'dwh.public.' || replace(reverse(p_name), ' ', '_') AS p0, 'dwh.public.dim_' || replace(p_name, ' ', '_') AS p FROM part) x
  JOIN cat a ON lower(a.full_name) = f JOIN cat b ON lower(b.full_name) = p))"""


def rels_of(part):
    n = F.translate("p_name", " ", "_")
    return part.select(F.concat(F.lit("RAW_DB."), n).alias("fk_table"), F.concat(F.lit('dwh."public".dim_'), n).alias("pk_table"))


@query("fk_edges", f"WITH {CATALOG}, {FK} SELECT * FROM fk")
def _(t):
    return lineage.fk_edges(rels_of(t.part), catalog_of(t.part))


VIEWS = """vw AS (SELECT DISTINCT 'warehouse:' || lower(full_name) AS owner, 'raw_db.' || split_part(lower(full_name), '.', -1) AS ref FROM cat WHERE system = 'warehouse' AND kind = 'view')"""


def views_of(part):
    cat = catalog_of(part).where("system = 'warehouse' and kind = 'view'")
    return cat.select("full_name", F.concat(F.lit("select * from RAW_DB."), F.lower(F.substring_index("full_name", ".", -1))).alias("sql")).distinct()


LINEAGE = f"""{IO}, {CATALOG}, {VIEWS}, uses AS (SELECT 'job:' || name AS owner, unnest(reads) AS ref, 'read' AS role, '' AS label FROM io
  UNION ALL SELECT 'job:' || name, unnest(writes), 'write', '' FROM io UNION ALL SELECT owner, ref, 'read', 'view' FROM vw),
refs AS (SELECT DISTINCT ref FROM uses), {RESOLVED},
node AS (SELECT ref, coalesce((SELECT MAX(c.system) FROM cat c WHERE c.full_name = res.full_name) || ':' || lower(full_name), 'ref:' || ref) AS node FROM res),
linked AS (SELECT u.*, node FROM uses u JOIN node USING (ref) WHERE node <> owner), {NAME_MATCH}, {FK},
edges AS (SELECT CASE role WHEN 'read' THEN node ELSE owner END AS src, CASE role WHEN 'read' THEN owner ELSE node END AS dst, label FROM linked UNION FROM nm UNION FROM fk)"""


def graph_of(t):
    return lineage.build_lineage(catalog_of(t.part), scripts_of(t.part), views_of(t.part), rels_of(t.part))


@query("lineage_edges", f"WITH {LINEAGE} SELECT src, dst, label FROM edges")
def _(t):
    return graph_of(t).edges


@query("lineage_nodes", f"""WITH {LINEAGE} SELECT DISTINCT system || ':' || lower(full_name) AS id FROM cat UNION SELECT 'job:' || name FROM io UNION SELECT node FROM linked UNION SELECT 'name:' || base FROM both_sides""")
def _(t):
    return graph_of(t).nodes.select("id")


@query("node_layer", """SELECT DISTINCT CASE WHEN p_size < 8 THEN 'lake:raw_db.' || n WHEN p_size < 16 THEN 'lake:lake.curated.' || n WHEN p_size < 24 THEN 'lake:crm_gold.dim_' || n
    WHEN p_size < 32 THEN 'warehouse:dwh.public.' || n WHEN p_size < 40 THEN 'warehouse:dwh.public.dim_' || n ELSE 'warehouse:dwh.s' || p_size || '.' || n END AS id,
  CASE WHEN p_size < 16 THEN 'bronze' WHEN p_size < 24 THEN 'gold' WHEN p_size BETWEEN 32 AND 39 THEN 'gold' ELSE 'silver' END AS layer
FROM (SELECT *, replace(p_name, ' ', '_') AS n FROM part) WHERE p_size % 10 <> 9""")
def _(t):
    nodes = lineage.catalog_nodes(catalog_of(t.part).where("kind <> 'view'"))
    return lineage.node_layer(nodes).select("id", "layer")


LAYERS = """l AS (SELECT DISTINCT CASE WHEN p_size < 16 THEN 'bronze' ELSE 'gold' END AS layer, split_part(lower(full_name), '.', -1) AS "table" FROM cat WHERE system = 'lake')"""


@query("job_outputs", f"""WITH {IO}, {CATALOG}, o AS (SELECT name, CASE p_type WHEN 'STANDARD' THEN 'silver' WHEN 'LARGE' THEN 'gold' END AS layer FROM io), {LAYERS}
SELECT name, layer, COUNT(*) AS tables FROM o JOIN l USING (layer) GROUP BY ALL""")
def _(t):
    return lineage.job_outputs(lineage.extract_io(scripts_of(t.part)), catalog_of(t.part))


@query("layer_tables", f"""WITH {CATALOG}, {LAYERS} SELECT layer, "table" FROM l""")
def _(t):
    return lineage.layer_tables(catalog_of(t.part))


# ---- closure and order over the tables' own key links ----------------------------------------

TREE = """e AS (SELECT DISTINCT 'l' || l_orderkey || '/' || l_linenumber AS src, 'o' || l_orderkey AS dst FROM lineitem
  UNION SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""


def key_edges(t):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    line = F.concat(key("l", "l_orderkey"), F.lit("/"), F.col("l_linenumber").cast("string"))
    return (t.lineitem.select(line.alias("src"), key("o", "l_orderkey").alias("dst"))
            .unionByName(t.orders.select(key("o", "o_orderkey").alias("src"), key("c", "o_custkey").alias("dst")))
            .unionByName(t.customer.select(key("c", "c_custkey").alias("src"), key("n", "c_nationkey").alias("dst")))
            .unionByName(t.nation.select(key("n", "n_nationkey").alias("src"), key("r", "n_regionkey").alias("dst"))))


CLOSURE = f"""{TREE}, up AS (SELECT DISTINCT 'n' || n_nationkey AS id, 0 AS depth FROM nation WHERE n_regionkey <= 1
  UNION SELECT e.src, depth + 1 FROM up JOIN e ON e.dst = up.id)"""


@query("upstream_closure", f"WITH RECURSIVE {CLOSURE} SELECT id, depth FROM up")
def _(t):
    targets = t.nation.where("n_regionkey <= 1").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"))
    return lineage.upstream_closure(key_edges(t), targets)


@query("closure_edges", f"WITH RECURSIVE {CLOSURE} SELECT DISTINCT src, dst FROM e WHERE src IN (SELECT id FROM up) AND dst IN (SELECT id FROM up)")
def _(t):
    edges = key_edges(t).distinct()
    targets = t.nation.where("n_regionkey <= 1").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"))
    return lineage.closure_edges(edges, lineage.upstream_closure(edges, targets)).select("src", "dst")


@query("topo_levels", f"""WITH {TREE}, lo AS (SELECT o_orderkey, o_custkey, CASE WHEN l.k IS NULL THEN 0 ELSE 1 END AS v FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) l ON l.k = o_orderkey),
lc AS (SELECT c_custkey, c_nationkey, coalesce(MAX(v) + 1, 0) AS v FROM customer LEFT JOIN lo ON o_custkey = c_custkey GROUP BY ALL),
ln AS (SELECT n_nationkey, n_regionkey, coalesce(MAX(v) + 1, 0) AS v FROM nation LEFT JOIN lc ON c_nationkey = n_nationkey GROUP BY ALL),
lr AS (SELECT n_regionkey AS k, MAX(v) + 1 AS v FROM ln GROUP BY 1)
SELECT DISTINCT 'l' || l_orderkey || '/' || l_linenumber AS id, 0 AS level, false AS cyclic FROM lineitem UNION ALL SELECT 'o' || o_orderkey, v, false FROM lo
UNION ALL SELECT 'c' || c_custkey, v, false FROM lc UNION ALL SELECT 'n' || n_nationkey, v, false FROM ln UNION ALL SELECT 'r' || k, v, false FROM lr""")
def _(t):
    return lineage.topo_levels(key_edges(t))


RINGS = """m AS (SELECT 'c' || c_custkey AS id, c_custkey AS k, c_nationkey AS n, c_custkey // 8 AS b, row_number() OVER (PARTITION BY c_custkey // 8 ORDER BY c_custkey) - 1 AS p,
  COUNT(*) OVER (PARTITION BY c_custkey // 8) AS many FROM customer), g AS (SELECT *, b % 2 = 0 AND many > 1 AS ring, MIN(id) OVER (PARTITION BY b) AS least FROM m)"""


def ring_edges(t):
    """Customers in blocks of eight, every second block a ring, the others chains; their nation before, their orders behind."""
    block = Window.partitionBy(F.expr("c_custkey div 8"))
    c = t.customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), "c_custkey", "c_nationkey", F.expr("c_custkey div 8").alias("b"),
                          F.lead(F.concat(F.lit("c"), F.col("c_custkey").cast("string"))).over(block.orderBy("c_custkey")).alias("next"),
                          F.min_by(F.concat(F.lit("c"), F.col("c_custkey").cast("string")), "c_custkey").over(block).alias("first"))
    on = c.select(F.col("id").alias("src"), F.coalesce("next", F.when(F.expr("b % 2 = 0 and first <> id"), F.col("first"))).alias("dst")).where("dst is not null")
    top = c.where("id = first").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("src"), F.col("id").alias("dst"))
    orders = t.orders.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("dst"))
    return on.unionByName(top).unionByName(orders)


@query("condensed_levels", f"""WITH {RINGS}, o AS (SELECT 'o' || o_orderkey AS id, CASE WHEN k IS NULL THEN 1 WHEN ring THEN 2 ELSE 2 + p END AS level, k IS NULL AS stray, o_custkey
  FROM orders LEFT JOIN g ON k = o_custkey)
SELECT id, CASE WHEN ring THEN least ELSE id END AS component, CASE WHEN ring THEN many ELSE 1 END AS members, ring AS cyclic, CASE WHEN ring THEN 1 ELSE 1 + p END AS level FROM g
UNION ALL SELECT DISTINCT 'n' || n, 'n' || n, 1, false, 0 FROM g WHERE p = 0
UNION ALL SELECT id, id, 1, false, level FROM o UNION ALL SELECT DISTINCT 'c' || o_custkey, 'c' || o_custkey, 1, false, 0 FROM o WHERE stray""")
def _(t):
    return lineage.condensed_levels(ring_edges(t))


# ---- catalogue analytics --------------------------------------------------------------------

DUPS = f"""{CATALOG}, m AS (SELECT split_part(lower(full_name), '.', -1) AS base_name, system, cols FROM cat),
g AS (SELECT base_name, COUNT(*) AS members, COUNT(DISTINCT system) > 1 AS cross_system FROM m GROUP BY 1 HAVING COUNT(*) > 1),
s AS (SELECT DISTINCT base_name, cols FROM m), j AS (SELECT a.base_name, MIN(len(list_intersect(a.cols, b.cols)) / len(list_distinct(list_concat(a.cols, b.cols)))) AS r FROM s a JOIN s b USING (base_name) GROUP BY 1),
d AS (SELECT base_name, members, cross_system, round(r, 2) AS column_overlap FROM g JOIN j USING (base_name))"""


@query("find_duplicates", f"WITH {DUPS} SELECT * FROM d")
def _(t):
    return catalog.find_duplicates(catalog_of(t.part))


@query("duplicate_advice", f"""WITH {DUPS} SELECT base_name, column_overlap, CASE WHEN cross_system AND column_overlap >= 0.6 THEN 'high' WHEN cross_system THEN 'medium' ELSE 'low' END AS severity FROM d""")
def _(t):
    return catalog.duplicate_advice(measures.rank_duplicates(catalog.find_duplicates(catalog_of(t.part)))).select(
        "base_name", "column_overlap", "severity")


@query("precheck_targets", f"""WITH {CATALOG} SELECT p_partkey, CASE WHEN EXISTS (SELECT 1 FROM cat k WHERE k.p_size < 8 AND split_part(lower(k.full_name), '.', -1) = split_part(lower(cat.full_name), '.', -1)) THEN 'already_present' ELSE 'to_build' END AS status,
  p_size >= 45 AS required FROM cat WHERE p_size >= 8""")
def _(t):
    cat = catalog_of(t.part).join(t.part.select("p_partkey", "p_size"), "p_partkey")
    planned = cat.where("p_size >= 8").select("p_partkey", "full_name", (F.col("p_size") < 45).alias("selected"))
    return catalog.precheck_targets(planned, cat.where("p_size < 8")).select("p_partkey", "status", "required")


@query("ensure_unique_names", """WITH s AS (SELECT DISTINCT lower(p_brand) AS sch, replace(p_name, ' ', '_') AS n FROM part)
SELECT sch AS "schema", n AS name, CASE WHEN COUNT(*) OVER (PARTITION BY n) = 1 THEN n ELSE sch || '_' || n END AS target FROM s""")
def _(t):
    tables = t.part.select(F.lower("p_brand").alias("schema"), F.translate("p_name", " ", "_").alias("name")).distinct()
    return catalog.ensure_unique_names(tables)


@query("contains_match_job", """WITH cells AS (SELECT DISTINCT p_name AS v, replace(p_name, ' ', '_') AS b FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2), split_part(p_name, ' ', 2) FROM part
  UNION SELECT DISTINCT 'run ' || p_name || ' daily', 'run_' || replace(p_name, ' ', '_') || '_daily' FROM part UNION SELECT DISTINCT p_brand, lower(replace(p_brand, '#', '_')) FROM part),
jobs AS (SELECT DISTINCT replace(p_name, ' ', '_') || CASE WHEN p_size > 25 THEN '_load' ELSE '' END AS j FROM part WHERE p_type = 'ECONOMY'),
hit AS (SELECT v, j, CASE WHEN b = j THEN 0 ELSE 1 END AS rank FROM cells JOIN jobs ON contains(b, j) OR contains(j, b))
SELECT v AS value, j AS job FROM hit QUALIFY row_number() OVER (PARTITION BY v ORDER BY rank, j) = 1""")
def _(t):
    p = t.part
    cells = (p.select(F.col("p_name").alias("value")).unionByName(p.select(F.substring_index("p_name", " ", -1).alias("value")))
             .unionByName(p.select(F.concat(F.lit("run "), "p_name", F.lit(" daily")).alias("value"))).unionByName(p.select(F.col("p_brand").alias("value"))))
    jobs = p.where("p_type = 'ECONOMY'").select(F.concat(F.translate("p_name", " ", "_"), F.when(F.col("p_size") > 25, "_load").otherwise("")).alias("job"))
    return catalog.contains_match_job(cells, jobs)


CONTROL = {"ECONOMY": ("Dq_Rules", "x"), "STANDARD": ("tbl", "Rule Name"), "PROMO": ("tbl2", "batch_id")}


@query("classify_control_table", """WITH n AS (SELECT p_brand AS b, p_size AS s, p_type, p_partkey % 4 AS k FROM part),
c AS (SELECT b || '.t' || s AS t, list_distinct(list(CASE p_type WHEN 'ECONOMY' THEN 'rule_name' WHEN 'STANDARD' THEN 'rule_type' WHEN 'PROMO' THEN 'severity' WHEN 'SMALL' THEN 'batch_id' WHEN 'MEDIUM' THEN 'output_status' ELSE 'source_system' END)) AS cols FROM n GROUP BY 1),
h AS (SELECT t, len(list_intersect(cols, ['rule_name', 'rule_type', 'severity'])) AS dq, len(list_intersect(cols, ['batch_id', 'output_status', 'source_system'])) AS ob FROM c)
SELECT t AS "table", CASE WHEN dq = 3 THEN 'dq_rules' ELSE 'outbound_logs' END AS canonical, 'columns' AS matched_by FROM h WHERE dq = 3 OR ob = 3
UNION ALL SELECT DISTINCT p_brand || '.DQ Rules', 'dq_rules', 'name' FROM part""")
def _(t):
    kinds = {"ECONOMY": "Rule Name", "STANDARD": "rule_type", "PROMO": "SEVERITY", "SMALL": "batch_id", "MEDIUM": "output-status", "LARGE": "source_system"}
    name = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("p_type")]
    cols = t.part.select(F.concat("p_brand", F.lit(".t"), F.col("p_size").cast("string")).alias("table"), name.alias("col_name"))
    byname = t.part.select(F.concat("p_brand", F.lit(".DQ Rules")).alias("table"), F.col("p_name").alias("col_name"))
    return catalog.classify_control_table(cols.unionByName(byname))


CONFIG_TEXT = """CASE p_type WHEN 'ECONOMY' THEN 'select curated_tablename from Cdl_Configuration where active_flag = 1' WHEN 'STANDARD' THEN 'x = configuration_id' WHEN 'PROMO' THEN 'jdbc:postgresql://h; ingestion_log; file_format'
 ELSE 'no config here' END"""


@query("detect_config_driven", """SELECT p_partkey AS name, CASE p_type WHEN 'ECONOMY' THEN 'cdl_configuration' WHEN 'PROMO' THEN 'ingestion_log' ELSE '' END AS tables,
  CASE p_type WHEN 'ECONOMY' THEN 'active_flag,curated_tablename' WHEN 'STANDARD' THEN 'configuration_id' WHEN 'PROMO' THEN 'file_format' ELSE '' END AS columns,
  CASE p_type WHEN 'PROMO' THEN 'postgres' WHEN 'SMALL' THEN 'jdbc' ELSE 'unknown' END AS store, p_type = 'ECONOMY' AS config_driven FROM part""")
def _(t):
    texts = {"ECONOMY": "select curated_tablename from Cdl_Configuration where active_flag = 1", "STANDARD": "x = configuration_id",
             "PROMO": "url = 'jdbc:postgresql://h'; t = 'ingestion_log'; file_format", "SMALL": "get_secret_manager()"}
    body = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in texts.items() for x in kv]), F.col("p_type")), F.lit("nothing here"))
    scripts = t.part.select(F.col("p_partkey").alias("name"), F.concat("p_name", F.lit("\n"), body).alias("text"))
    out = catalog.detect_config_driven(scripts)
    return out.withColumns({c: F.array_join(c, ",") for c in ("tables", "columns")})


@query("config_driven_estate", "SELECT 2 AS tables, COUNT(DISTINCT p_type) FILTER (WHERE p_type IN ('ECONOMY', 'PROMO')) + 1 AS columns, true AS config_driven FROM part")
def _(t):
    texts = {"ECONOMY": "select curated_tablename from Cdl_Configuration where active_flag = 1", "PROMO": "ingestion_log; file_format"}
    body = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in texts.items() for x in kv]), F.col("p_type")), F.lit("nothing"))
    return catalog.config_driven_estate(catalog.detect_config_driven(t.part.select(F.col("p_partkey").alias("name"), body.alias("text"))))


@query("review_queue", """SELECT p_partkey AS name, 'NEEDS-AI' AS tag, 0 AS line, 'throttled' AS detail FROM part WHERE p_type = 'ECONOMY'
UNION ALL SELECT p_partkey, 'ASSUMPTION', 2, 'check ' || p_name FROM part WHERE p_type = 'STANDARD' UNION ALL SELECT p_partkey, 'TODO', 3, '# FIXME' FROM part WHERE p_type = 'STANDARD'
UNION ALL SELECT p_partkey, 'DIALECT', 0, 'listagg' FROM part WHERE p_type = 'PROMO' UNION ALL SELECT p_partkey, 'DIALECT', 0, 'untranslated_function' FROM part WHERE p_type = 'PROMO'""")
def _(t):
    fixed = {"ECONOMY": "-- SCAFFOLD-REASON: throttled\n-- TODO: x", "PROMO": "select listagg(a), to_char(b) from t", "SMALL": "select to_char(b)", "LARGE": "select 1"}
    body = F.when(F.col("p_type") == "STANDARD", F.concat(F.lit("select 1\n-- TODO[assumption]: check "), "p_name", F.lit("\r\n  # FIXME\n"))).otherwise(
        F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in fixed.items() for x in kv]), F.col("p_type")), F.lit("")))
    kind = F.when(F.col("p_type") == "SMALL", "Notebooks").otherwise("models")
    return catalog.review_queue(t.part.select(kind.alias("kind"), F.col("p_partkey").alias("name"), body.alias("text"))).drop("kind")


# ---- operations graph: jobs per brand and type, one config row per part ----------------------

JOB = "'load_' || lower(replace(p_brand, '#', '_')) || '_' || lower(p_type)"
OPS = f"""j AS (SELECT DISTINCT {JOB} AS k, 'load_' || lower(replace(p_brand, '#', '_')) || '_economy' AS up, p_type FROM part),
c AS (SELECT p_partkey, {JOB} AS job, replace(p_name, ' ', '_') AS n, p_size, p_type FROM part),
cat AS (SELECT DISTINCT 'tbl:raw_' || replace(p_name, ' ', '_') AS id, 'crm_silver.raw_' || replace(p_name, ' ', '_') AS label FROM part WHERE p_size > 45
  UNION SELECT DISTINCT 'tbl:dim_' || replace(p_name, ' ', '_') || '_' || p_size, 'crm_gold.dim_' || replace(p_name, ' ', '_') || '_' || p_size FROM part WHERE p_size > 20),
r AS (SELECT *, 'raw_' || n AS s, 'dim_' || n || '_' || p_size AS t FROM c),
rn AS (SELECT r.*, CASE WHEN EXISTS (SELECT 1 FROM cat WHERE id = 'tbl:' || s) THEN 'tbl:' ELSE 'ref:' END || s AS sn, CASE WHEN EXISTS (SELECT 1 FROM cat WHERE id = 'tbl:' || t) THEN 'tbl:' ELSE 'ref:' END || t AS tn FROM r),
edges AS (SELECT 'job:' || up AS src, 'job:' || k AS dst, 'execution' AS kind, '' AS label FROM j WHERE p_type <> 'ECONOMY' AND up IN (SELECT k FROM j)
  UNION SELECT sn, 'job:' || job, 'data', '' FROM rn WHERE p_type <> 'LARGE' UNION SELECT 'job:' || job, tn, 'data', '' FROM rn WHERE p_type <> 'LARGE'
  UNION SELECT sn, tn, 'data', 'query_configuration' FROM rn WHERE p_type = 'LARGE' UNION SELECT 'job:' || job, 'ctl:query_config', 'control', 'reads' FROM rn WHERE p_type <> 'LARGE')"""


def ops_of(t):
    brand = F.lower(F.translate("p_brand", "#", "_"))
    job = F.concat(F.lit("load_"), brand, F.lit("_"), F.lower("p_type"))
    up = F.concat(F.lit("load_"), brand, F.lit("_economy"))
    jobs = t.part.select(job.alias("key"), job.alias("legacy_name"), F.when(
        F.col("p_type") == "ECONOMY", F.array(F.lit("never_there"))).otherwise(F.array(up)).alias("depends_on")).distinct()
    n = F.translate("p_name", " ", "_")
    dim = F.concat(F.lit("dim_"), n, F.lit("_"), F.col("p_size").cast("string"))
    cfg = t.part.select(
        "p_partkey", F.when(F.col("p_type") == "LARGE", "???").otherwise(job).alias("job_name"), F.concat(F.lit("raw_"), n).alias("src_table"), dim.alias("target_tablename"))
    cells = catalog.config_cells(cfg, "query_config", "query_configuration", "p_partkey")
    cat = (t.part.where("p_size > 45").select(F.concat(F.lit("crm_silver.raw_"), n).alias("full_name"))
           .unionByName(t.part.where("p_size > 20").select(F.concat(F.lit("crm_gold."), dim).alias("full_name"))).distinct())
    return catalog.ops_graph(jobs, cells, cat.withColumn("system", F.lit("lake")))


@query("ops_graph", f"WITH {OPS} SELECT src, dst, kind, label FROM edges")
def _(t):
    return ops_of(t).edges


@query("ops_health", f"""WITH {OPS}, touched AS (SELECT src AS id FROM edges WHERE kind = 'data' UNION SELECT dst FROM edges WHERE kind = 'data')
SELECT 'missing_table' AS kind, id[5:] AS detail FROM touched WHERE id LIKE 'ref:%' UNION ALL SELECT 'orphan_table', label FROM cat WHERE id NOT IN (SELECT id FROM touched)
UNION ALL SELECT 'job_no_logic', k FROM j WHERE 'job:' || k NOT IN (SELECT id FROM touched)
UNION ALL SELECT 'broken_chain', k || ' depends on unknown task never_there' FROM j WHERE p_type = 'ECONOMY'
UNION ALL SELECT 'broken_chain', k || ' depends on unknown task ' || up FROM j WHERE p_type <> 'ECONOMY' AND up NOT IN (SELECT k FROM j)""")
def _(t):
    return ops_of(t).health
