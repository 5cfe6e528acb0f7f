"""Lineage: what scripts read and write, the dataflow graph, its closure and its order."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import as_col, base_name, canonical_layer, norm_name, once
from ..session import cut_lineage, small_frame, spread, staged
from .order import condensed_levels, cycle_components, topo_levels  # noqa: F401  (the order of a lineage graph)

NAME = r"([a-zA-Z_][\w$]*(?:\.[a-zA-Z_\"`][\w$\"`]*){0,2})"

# The script idioms that name a table or path (Java regular expressions).
SQL_NOISE = r"--[^\n]*|/\*(?s:.*?)\*/|'(?:[^']|'')*'"
FROM_INSIDE_CALL = r"(?i)(\b(?:extract|trim|substring|overlay)\s*\([^()]*?)\bfrom\b"
DISTINCT_FROM = r"(?i)\bis\s+(?:not\s+)?distinct\s+from\b"
SQL_PART = r"(?:[a-zA-Z_][\w$]*+|\"[^\"]+\"|`[^`]+`|\[[^\]]+\])"
SQL_NAME = SQL_PART + r"(?:\s*\.\s*" + SQL_PART + r")*+"
FROM_LIST = (r"(?i)\b(?:from|join)\s+(" + SQL_NAME + r"(?!\s*\()(?:(?:\s+(?:as\s+)?[a-zA-Z_]\w*+)?\s*,\s*" + SQL_NAME + r"(?!\s*\())*)")
QUOTED_COMMA = r"(?<=[\"`\[][^\"`\[\],]{0,100}),(?=[^\"`\[\],]{0,100}[\"`\]]\s*(?:[.,]|$))"
CTE_DEFINED = r"(?i)(?:\bwith\s+(?:recursive\s+)?|\)\s*,\s*)(" + SQL_PART + r")(?:\s*\([^()]*\))?\s+as\s*(?:(?:not\s+)?materialized\s*)?\("
CATALOG_READ = r"(?is)database\s*=\s*['\"]([^'\"]+)['\"][^)]*?table_name\s*=\s*['\"]([^'\"]+)['\"]"
CATALOG_SINK = r"(?is)catalogDatabase\s*=\s*['\"]([^'\"]+)['\"][^)]*?catalogTableName\s*=\s*['\"]([^'\"]+)['\"]"
READ_TABLE = r"(?i)\.(?:read\s*\.\s*)?table\(\s*['\"]([^'\"]+)['\"]"
SAVE_TABLE = r"(?i)\.(?:saveAsTable|insertInto)\(\s*['\"]([^'\"]+)['\"]"
LOAD_PATH = r"(?i)\.(?:load|parquet|csv|json|orc)\(\s*['\"](s3[a-z]?://[^'\"]+)['\"]"
SAVE_PATH = r"(?i)\.save\(\s*['\"](s3[a-z]?://[^'\"]+)['\"]"
SQL_BLOCK = r"(?is)(?:spark|glueContext\.spark_session|sqlContext)\.sql\(\s*['\"]{1,3}(.+?)['\"]{1,3}\s*\)"
SQL_WRITE = (r"(?i)\b(?:insert\s+into|insert\s+overwrite(?:\s+table)?|create\s+(?:or\s+replace\s+)?table"
             r"(?:\s+if\s+not\s+exists)?)\s+") + NAME
DBTABLE = r"(?i)(?:dbtable|sftable|sffulltablename)\s*['\"]?\s*[,:=]\s*['\"]([^'\"]+)['\"]"
S3_LITERAL = r"(?i)['\"](s3a?://[^'\"]+)['\"]"
FILE_READ = (r"(?i)(?:\bpd\b|\bpandas\b)\s*\.\s*read_\w+\s*\(|create_dynamic_frame\.from_options\s*\(|"
             r"spark\s*\.\s*read[\s\S]{0,80}?\.\s*(?:load|csv|json|parquet|orc|text|excel)\s*\(")
WRITE_CALL = r"(?i)\.write\s*(?:Stream)?\s*\.|\.write\b|write_dynamic_frame"
FILE_TABLE_MAP = r"(?i)['\"][^'\"]+\.(?:xlsx|xls|csv|parquet|json|txt|tsv|avro)['\"]\s*:\s*['\"]([A-Za-z_][\w]*)['\"]"

# Path words that mark an output, that name a layer, and that name a derived layer.
OUTPUT_WORDS = ("processed", "output", "curated", "stage", "staging", "bronze", "silver", "gold", "refined",
                "conformed", "clean", "target", "sink", "dest")
PATH_LAYERS = ("landing", "raw", "bronze", "staging", "stage", "silver", "conformed", "gold", "mart", "curated",
               "processed", "refined", "serving", "publish", "published", "presentation")
DERIVED_LAYERS = ("silver", "gold", "mart", "curated", "refined", "serving", "conformed", "publish", "published",
                  "presentation")
GOLD_NAME = r"^(dim|dimension|fact|fct|mart|agg|aggregate|rpt|report|kpi|summary|metrics?)_"


def is_path(c) -> Column:
    return as_col(c).rlike("^s3a?://")


def _has(c: Column, words) -> Column:
    return c.rlike("|".join(words))


def path_layer(c) -> Column:
    """The first layer word, in the order listed, that occurs in a path; '' if none does."""
    low, out = F.lower(as_col(c)), None
    for word in PATH_LAYERS:
        hit = low.contains(word)
        out = F.when(hit, word) if out is None else out.when(hit, word)
    return out.otherwise("")


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def _pairs(text: Column, pattern: str) -> Column:
    return F.transform(_all(text, pattern, 0), lambda m: norm_name(F.concat(
        F.regexp_extract(m, pattern, 1), F.lit("."), F.regexp_extract(m, pattern, 2))))


def _in_context(text: Column, pattern: str, width: int) -> Column:
    """Every match with the text before it (at most ``width`` characters): ``array<struct<m, before>>``."""
    found = _all(text, pattern, 0)
    pieces = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    start = F.struct(F.lit("").alias("tail"), F.array().cast("array<struct<m:string,before:string>>").alias("out"))

    def step(acc, x):
        before = F.right(F.concat(acc["tail"], x["p"]), F.lit(width))
        return F.struct(F.concat(before, x["m"]).alias("tail"),
                        F.array_append(acc["out"], F.struct(x["m"].alias("m"), F.lower(before).alias("before"))).alias("out"))

    return F.aggregate(F.arrays_zip(pieces.alias("p"), found.alias("m")), start, step, lambda acc: acc["out"])


def _listed(tokens: Column) -> Column:
    """The tables of a FROM or JOIN with the list that follows it."""
    names = F.transform(F.split(F.regexp_replace(tokens, QUOTED_COMMA, "_"), ","), lambda n: norm_name(
        F.regexp_extract(F.regexp_replace(n, r"(?i)^\s*(?:from|join)\s+", ""), "^\\s*(" + SQL_NAME + ")", 1)))
    return F.filter(names, lambda n: (n != "") & ~n.isin("lateral", "unnest", "select", "values", "table"))


def sql_tables(c) -> Column:
    """FROM and JOIN targets of a text in order of first use, without the CTE names that are in scope there.

    Names may be quoted, and a FROM may list several. Comments and string literals are blanked first;
    the FROM of EXTRACT, TRIM and the like and of IS DISTINCT FROM names no table, nor does a function.

    One fold over parentheses, definitions and FROMs keeps the depth and the CTEs in scope. A CTE is in scope from the end of its body,
    with RECURSIVE from its start, to the parenthesis that closes the query of its WITH, or to the end of the statement. So a
    table outside that shares the name is kept, in another statement, around a nested WITH or in the body itself.
    """
    sql = F.regexp_replace(F.coalesce(as_col(c), F.lit("")), SQL_NOISE, " ")
    sql = F.regexp_replace(F.regexp_replace(sql, FROM_INSIDE_CALL, "$1 "), DISTINCT_FROM, " ")
    tokens = _all(sql, f"{CTE_DEFINED}|{FROM_LIST}|[();]", 0)
    none = F.array().cast("array<struct<name:string,depth:int,recursive:boolean>>")
    start = F.struct(F.lit(0).alias("depth"), none.alias("open"), none.alias("seen"), F.array().cast("array<string>").alias("out"))

    def step(acc, t):
        follows, ends = t.rlike(r"^\)\s*,"), t == ";"
        closes, defines = (t == ")") | follows, t.rlike(r"(?i)^with\b") | follows
        depth = F.when(ends, 0).when(closes, F.greatest(F.lit(0), acc["depth"] - 1)).otherwise(acc["depth"])
        ready = F.concat(acc["seen"], F.filter(acc["open"], lambda o: o["depth"] == depth))
        seen = F.when(ends, none).when(closes, F.filter(ready, lambda s: s["depth"] <= depth)).otherwise(acc["seen"])
        waiting = F.when(ends, none).when(closes, F.filter(acc["open"], lambda o: o["depth"] < depth)).otherwise(acc["open"])
        recursive = t.rlike(r"(?i)^with\s+recursive\b") | (follows & F.exists(seen, lambda s: (s["depth"] == depth) & s["recursive"]))
        entry = F.array(F.struct(norm_name(F.regexp_extract(t, CTE_DEFINED, 1)).alias("name"), depth.alias("depth"), recursive.alias("recursive")))
        used = F.filter(_listed(t), lambda n: ~F.exists(seen, lambda s: s["name"] == n))
        return F.struct(
            (depth + F.when(defines | (t == "("), 1).otherwise(0)).alias("depth"), F.when(defines & ~recursive, F.concat(waiting, entry)).otherwise(waiting).alias("open"),
            F.when(defines & recursive, F.concat(seen, entry)).otherwise(seen).alias("seen"),
            F.when(t.rlike(r"(?i)^(?:from|join)\b"), F.concat(acc["out"], used)).otherwise(acc["out"]).alias("out"))

    return F.array_distinct(F.aggregate(tokens, start, step, lambda acc: acc["out"]))


def extract_sql_tables(sqls: DataFrame, name: str = "name", sql: str = "sql") -> DataFrame:
    """``(name, table)`` of every text; texts are dealt evenly over tasks, since a fold costs far more than its bytes."""
    return spread(sqls.select(name, F.col(sql).alias("_sql"))).select(name, F.explode(sql_tables("_sql")).alias("table"))


def extract_io(scripts: DataFrame, name: str = "name", text: str = "text") -> DataFrame:
    """Per script: sorted ``reads`` and ``writes`` and whether it pulls from outside (``external``).

    One projection over the corpus: every idiom is a regular expression inside Spark, a script never
    leaves its row, and nothing is shuffled. The expressions cost far more than reading: deal out a corpus of
    few files with ``session.spread`` first.
    """
    src = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<string>")
    base = once(scripts.withColumnRenamed(name, "name"), ["name"], {
        "r_table": F.transform(_all(src, READ_TABLE), lambda n: norm_name(n)),
        "r_path": F.transform(_all(src, LOAD_PATH), lambda p: F.lower(F.trim(p))),
        "r_catalog": _pairs(src, CATALOG_READ), "w_catalog": _pairs(src, CATALOG_SINK),
        "w_table": F.transform(_all(src, SAVE_TABLE), lambda n: norm_name(n)),
        "w_path": F.transform(_all(src, SAVE_PATH), lambda p: F.lower(F.trim(p))),
        "db": _in_context(src, DBTABLE, 240), "s3": _in_context(src, S3_LITERAL, 80), "sql": _all(src, SQL_BLOCK),
        "mapped": F.transform(_all(src, FILE_TABLE_MAP), lambda n: norm_name(n)),
        "has_write": src.rlike(WRITE_CALL), "file_read": src.rlike(FILE_READ)})

    def db(x):
        return norm_name(F.regexp_extract(x["m"], DBTABLE, 1))

    def writing(x):
        return x["before"].contains("write") | x["before"].contains("sink")

    def s3_case(x):
        raw = F.lower(F.trim(F.regexp_extract(x["m"], S3_LITERAL, 1)))
        template, layer, b = raw.rlike(r"[{}]"), path_layer(raw), x["before"]
        target = F.when(~template, raw).when(layer != "", F.concat(F.lit("s3://"), layer))
        writes = b.contains("write") | b.contains("save")
        role = (F.when(target.isNull(), "template").when(b.contains("read") & ~writes, "read")
                .when(writes | b.contains("sink"), "out").when(_has(raw, OUTPUT_WORDS), "out").otherwise("read"))
        return F.struct(target.alias("target"), role.alias("role"))

    def of_role(role):
        return F.transform(F.filter("s3c", lambda x: x["role"] == role), lambda x: x["target"])

    cases = once(base, ["name", "r_table", "r_path", "r_catalog", "w_catalog", "w_table", "w_path", "file_read"], {
        "s3c": F.transform("s3", s3_case),
        "db_w": F.transform(F.filter("db", writing), db),
        "db_r": F.transform(F.filter("db", lambda x: ~writing(x)), db),
        "sql_r": F.flatten(F.transform("sql", lambda q: sql_tables(q))),
        "sql_w": F.flatten(F.transform("sql", lambda q: F.transform(_all(q, SQL_WRITE), lambda n: norm_name(n)))),
        "mapped": F.when(F.col("has_write"), F.col("mapped")).otherwise(none)})
    out_paths = of_role("out")
    reads = F.concat("r_table", "r_path", "r_catalog", "db_r", "sql_r", of_role("read"))
    writes = F.concat("w_catalog", "w_table", "w_path", "db_w", "sql_w", "mapped",
                      F.when(F.size("mapped") == 0, out_paths).otherwise(none))
    named = once(cases, ["name", "file_read"], {
        "all_reads": F.array_distinct(F.filter(reads, lambda x: x != "")),
        "all_writes": F.array_distinct(F.filter(writes, lambda x: x != "")),
        "outside": (F.size(out_paths) > 0) | F.exists("s3c", lambda x: x["role"] == "template")})
    plain_w = F.filter("all_writes", lambda x: ~x.rlike(r"[{}]"))
    plain_r = F.array_except(F.filter("all_reads", lambda x: ~x.rlike(r"[{}]")), plain_w)
    braced = F.exists(F.concat("all_reads", "all_writes"), lambda x: x.rlike(r"[{}]"))
    return once(named, ["name"], {
        "reads": F.array_sort(plain_r), "writes": F.array_sort(plain_w),
        "external": F.col("file_read") | F.col("outside") | braced | F.exists(plain_r, lambda r: is_path(r))})


def io_rows(io: DataFrame) -> DataFrame:
    """``(name, ref, role)``, one row per read or written reference."""
    both = F.concat(F.transform("reads", lambda r: F.struct(r.alias("ref"), F.lit("read").alias("role"))),
                    F.transform("writes", lambda w: F.struct(w.alias("ref"), F.lit("write").alias("role"))))
    return io.select("name", F.inline(both))


# ---- name resolution ------------------------------------------------------------------------

def _other_parts(norm: Column) -> Column:
    parts = F.split(norm, r"\.")
    return F.array_except(F.array_distinct(parts), F.slice(parts, -1, 1))


def resolve_reference(refs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Known table of every reference: ``refs(ref)`` against ``catalog(full_name)`` → ``(ref, full_name)``.

    The exact name wins; else the only table of that base name; else the table that shares strictly
    more name parts than any other; else NULL. Tables are first reduced to their base name and set of
    other parts; a reference meets a set only where they share a part of one base name, and the
    parts shared are counted. The work is linear in the parts of a name, however many it has: references
    and sets go by number, so their texts are not repeated with every part.
    """
    base = F.substring_index("norm", ".", -1).alias("base")
    names = spread(catalog.select("full_name")).select(norm_name("full_name").alias("norm"), "full_name")
    tables = staged(names.groupBy("norm").agg(F.min("full_name").alias("full_name")), "tables")  # read by two joins
    sets = (tables.groupBy(base, F.sort_array(_other_parts(F.col("norm"))).alias("parts"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("full_name").alias("full_name")))
    sets = staged(sets.withColumn("set", F.monotonically_increasing_id()), "sets")
    norm = F.when(is_path("ref"), F.col("ref")).otherwise(norm_name("ref"))
    named = spread(refs.select("ref").distinct()).withColumn("norm", norm)
    exact = named.join(tables.select("norm", F.col("full_name").alias("exact")), "norm", "left")
    wanted = staged(exact.select(F.monotonically_increasing_id().alias("id"), "ref", "exact", F.when(F.col("exact").isNull(), F.col("norm")).alias("norm")), "refs")
    open_refs = wanted.where("exact is null")
    alone = sets.groupBy("base").agg(F.sum("n").alias("n"), F.min("full_name").alias("full_name"))
    shared = (open_refs.select("id", base, F.explode(_other_parts(F.col("norm"))).alias("part"))
              .join(sets.select("base", "set", "n", "full_name", F.explode("parts").alias("part")), ["base", "part"])
              .groupBy("id", "set").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n"), F.first("full_name").alias("full_name")))
    levels = (shared.groupBy("id", "k").agg(F.sum("n").alias("n"), F.min("full_name").alias("full_name"))
              .unionByName(open_refs.select("id", base).join(alone, "base").select("id", F.lit(0).cast("long").alias("k"), "n", "full_name")))
    best = levels.groupBy("id").agg(F.max(F.struct("k", "n", "full_name")).alias("b")).where("b.n = 1")
    return wanted.join(best, "id", "left").select("ref", F.coalesce("exact", "b.full_name").alias("full_name"))


# ---- graph ----------------------------------------------------------------------------------

@dataclass(frozen=True)
class Graph:
    """``nodes(id, label, type, system)`` and ``edges(src, dst, label)``."""

    nodes: DataFrame
    edges: DataFrame


def catalog_layer(full_name) -> Column:
    """Layer of a lake table by its schema name; bronze where the name says nothing."""
    return F.coalesce(canonical_layer(F.substring_index(norm_name(full_name), ".", 1)), F.lit("bronze"))


def catalog_nodes(catalog: DataFrame) -> DataFrame:
    """Nodes of ``catalog(full_name, system, kind)``: warehouse tables silver, views gold, lake by schema."""
    kind = (F.when((F.col("system") == "warehouse") & (F.col("kind") == "view"), "gold")
            .when(F.col("system") == "warehouse", "silver").otherwise(catalog_layer("full_name")))
    return catalog.select(F.concat("system", F.lit(":"), norm_name("full_name")).alias("id"),
                          F.col("full_name").alias("label"), kind.alias("type"), "system").dropDuplicates(["id"])


def name_match_edges(catalog: DataFrame) -> DataFrame:
    """Lake tables to the warehouse tables of the same base name, through one node ``name:<base>``.

    Every lake table of a name that both sides have leads to the node (load from bronze, else copy), and
    the node leads to every warehouse table (same_name): edges grow with the tables, not with the pairs.
    """
    hub = F.concat(F.lit("name:"), F.col("base"))
    lake = catalog.where("system = 'lake'").select(
        base_name("full_name").alias("base"), F.concat(F.lit("lake:"), norm_name("full_name")).alias("src"),
        F.when(catalog_layer("full_name") == "bronze", "load").otherwise("copy").alias("label")).distinct()
    warehouse = catalog.where("system = 'warehouse'").select(
        base_name("full_name").alias("base"), F.concat(F.lit("warehouse:"), norm_name("full_name")).alias("dst")).distinct()
    shared = lake.select("base").distinct().join(warehouse.select("base").distinct(), "base")
    into = lake.join(shared, "base", "left_semi").select("src", hub.alias("dst"), "label")
    out = warehouse.join(shared, "base", "left_semi").select(hub.alias("src"), "dst", F.lit("same_name").alias("label"))
    return into.unionByName(out)


def fk_edges(rels: DataFrame, catalog: DataFrame) -> DataFrame:
    """Edge from referencing to referenced table where both are known and differ."""
    ids = catalog.select(norm_name("full_name").alias("norm"), F.concat("system", F.lit(":"), norm_name("full_name")).alias("id"))
    known = ids.groupBy("norm").agg(F.max("id").alias("id"))
    pairs = rels.select(norm_name("fk_table").alias("fk"), norm_name("pk_table").alias("pk")).where("fk <> pk").distinct()
    return (pairs.join(known.select(F.col("norm").alias("fk"), F.col("id").alias("src")), "fk")
            .join(known.select(F.col("norm").alias("pk"), F.col("id").alias("dst")), "pk")
            .select("src", "dst", F.lit("fk").alias("label")))


def build_lineage(catalog: DataFrame, scripts: DataFrame | None = None, views: DataFrame | None = None,
                  rels: DataFrame | None = None) -> Graph:
    """Dataflow graph of ``catalog(full_name, system, kind)``, job ``scripts(name, text)``, view
    definitions ``views(full_name, sql)`` and declared keys ``rels(fk_table, pk_table)``.

    References nobody knows become nodes of their own (``ref:``): silver if some job writes them,
    else source. The extracted references are written to the checkpoint folder, so every script is
    parsed once.
    """
    spark = catalog.sparkSession
    none = small_frame(spark, [], "owner string, ref string, role string, label string")
    uses = none
    if scripts is not None:
        io = extract_io(scripts)
        uses = uses.unionByName(io_rows(io).select(F.concat(F.lit("job:"), norm_name("name")).alias("owner"), "ref", "role",
                                                   F.lit("").alias("label")))
    if views is not None:
        deps = spread(views.select("full_name", "sql")).select(F.concat(F.lit("warehouse:"), norm_name("full_name")).alias("owner"),
                            F.explode(sql_tables("sql")).alias("ref"), F.lit("read").alias("role"), F.lit("view").alias("label"))
        uses = uses.unionByName(deps)
    uses = cut_lineage(uses)
    ids = catalog.groupBy("full_name").agg(F.max(F.concat("system", F.lit(":"), norm_name("full_name"))).alias("known"))
    resolved = resolve_reference(uses.select("ref"), catalog).join(ids, "full_name", "left").select(
        "ref", F.coalesce("known", F.concat(F.lit("ref:"), F.when(is_path("ref"), F.col("ref")).otherwise(norm_name("ref")))).alias("node"))
    linked = uses.join(resolved, "ref").where("node <> owner")
    reading = F.col("role") == "read"
    edges = linked.select(F.when(reading, F.col("node")).otherwise(F.col("owner")).alias("src"),
                          F.when(reading, F.col("owner")).otherwise(F.col("node")).alias("dst"), "label")
    new = (linked.where("node like 'ref:%'").groupBy(F.col("node").alias("id"))
           .agg(F.bool_or((F.col("role") == "write") & ~F.col("ref").rlike("^s3a?://")).alias("written"))
           .select("id", F.substring("id", 5, 1 << 30).alias("label"),
                   F.when(F.col("written"), "silver").otherwise("source").alias("type"), F.lit("").alias("system")))
    nodes = catalog_nodes(catalog).unionByName(new)
    if scripts is not None:
        jobs = scripts.select(F.concat(F.lit("job:"), norm_name("name")).alias("id"), F.col("name").alias("label"),
                              F.lit("job").alias("type"), F.lit("lake").alias("system")).dropDuplicates(["id"])
        busy = uses.where("label = ''").select(F.col("owner").alias("id")).distinct()
        nodes = nodes.unionByName(jobs.join(busy, "id", "left_semi"))
    if views is not None:
        undeclared = views.select(F.concat(F.lit("warehouse:"), norm_name("full_name")).alias("id"),
                                  F.col("full_name").alias("label"), F.lit("gold").alias("type"), F.lit("warehouse").alias("system"))
        nodes = nodes.unionByName(undeclared.dropDuplicates(["id"]).join(nodes.select("id"), "id", "left_anti"))
    same = name_match_edges(catalog)
    hubs = same.where("label = 'same_name'").select(
        F.col("src").alias("id"), F.substring("src", 6, 1 << 30).alias("label"), F.lit("name").alias("type"), F.lit("").alias("system"))
    nodes = nodes.unionByName(hubs.distinct())
    edges = edges.unionByName(same)
    if rels is not None:
        edges = edges.unionByName(fk_edges(rels, catalog))
    return Graph(nodes, edges.distinct())


def upstream_closure(edges: DataFrame, targets: DataFrame, max_depth: int | None = None) -> DataFrame:
    """All ancestors of the target nodes ``targets(id)`` with their distance: ``(id, depth)``.

    The distinct edges are written down once; one frontier per round follows, each written to the
    checkpoint folder, until no new node appears; cycles end by themselves. A depth limit that cuts something off is an error, not a shorter result.
    """
    links = cut_lineage(edges.select("src", "dst").distinct())
    frontier = cut_lineage(targets.select("id").distinct().withColumn("depth", F.lit(0)))
    seen, depth = frontier, 0
    while True:
        step = links.join(frontier.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id")).distinct()
        frontier = cut_lineage(step.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth + 1)))
        if frontier.isEmpty():
            return seen
        depth += 1
        if max_depth is not None and depth > max_depth:
            raise ValueError(f"the closure goes beyond max_depth={max_depth}")
        seen = seen.unionByName(frontier)


def closure_edges(edges: DataFrame, closure: DataFrame) -> DataFrame:
    """The edges with both ends inside a closure."""
    ids = closure.select("id")
    return (edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
            .join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns))


# ---- jobs -----------------------------------------------------------------------------------

def classify_jobs(io: DataFrame, catalog: DataFrame, scripts: DataFrame | None = None) -> DataFrame:
    """ingestion, transformation or publish per job ``(name, reads, writes, external)``.

    A job touching a derived layer, or reading bronze, transforms; one that pulls from outside
    without reading a known table ingests; otherwise the majority of its reads decides. With the
    scripts at hand, a job that writes to an external warehouse publishes.
    """
    known = catalog.select(norm_name("full_name").alias("ref")).distinct().withColumn("_known", F.lit(True))
    io = staged(io.select("name", "reads", "writes", "external"), "io")  # read by two joins, and costly to make
    rows = io_rows(io).join(known, "ref", "left")
    path, read = is_path("ref"), F.col("role") == "read"
    layer = path_layer("ref")
    facts = rows.groupBy("name").agg(
        F.bool_or(path & (layer.isin(*DERIVED_LAYERS) | (read & (layer == "bronze")))).alias("derived"),
        F.count_if(read & ~path & F.col("_known").isNotNull()).alias("known_reads"),
        F.count_if(read & (path | F.col("_known").isNull())).alias("outside_reads"),
        F.count_if(read).alias("n_reads"))
    joined = io.select("name", "external").join(facts, "name", "left").fillna(0, ["known_reads", "outside_reads", "n_reads"])
    kind = (F.when(F.coalesce("derived", F.lit(False)), "transformation")
            .when(F.col("external") & (F.col("known_reads") == 0), "ingestion")
            .when(F.col("n_reads") == 0, "ingestion")
            .when(F.col("outside_reads") == 0, "transformation")
            .when(F.col("outside_reads") >= F.col("known_reads"), "ingestion").otherwise("transformation"))
    out = joined.select("name", kind.alias("kind"))
    if scripts is not None:
        loads = scripts.select("name", publishes("text").alias("_publishes"))
        out = out.join(loads, "name", "left").select(
            "name", F.when(F.coalesce("_publishes", F.lit(False)), "publish").otherwise(F.col("kind")).alias("kind"))
    return out


def publishes(text) -> Column:
    """Does the script write to an external warehouse through a connector?"""
    low = F.lower(as_col(text))
    connector = low.rlike(r"net\.snowflake\.spark\.snowflake|format\([\"'](snowflake|jdbc)[\"']\)|redshift|bigquery")
    return connector & low.rlike(r"\.save\(|\.write") & low.rlike("dbtable|sftable|preactions")


def node_layer(nodes: DataFrame) -> DataFrame:
    """Target layer of graph nodes; dimensional names lift a warehouse table to gold."""
    base = base_name("label")
    default = F.when(F.col("type") == "source", "external").when(
        F.col("type").isin("bronze", "silver", "gold"), F.col("type")).otherwise("silver")
    lifted = (F.col("system") == "warehouse") & (F.col("type") != "gold") & (base.rlike(GOLD_NAME) | base.contains("mart"))
    return nodes.withColumn("layer", F.when(lifted, "gold").otherwise(default))


def layer_tables(catalog: DataFrame) -> DataFrame:
    """Base names of the lake tables of every layer: ``(layer, table)``."""
    return catalog.where("system = 'lake'").select(catalog_layer("full_name").alias("layer"),
                                                   base_name("full_name").alias("table")).distinct()


def job_outputs(io: DataFrame, catalog: DataFrame) -> DataFrame:
    """Output layer of each job and how many lake tables it holds: ``(name, layer, tables)``.

    The layer is the one the job writes, or the one above what it reads. All tables of that layer are
    its outputs: look them up in ``layer_tables`` by layer; jobs times tables is never spelled out.
    """
    def layers(col):
        return F.transform(F.filter(col, lambda p: is_path(p)), lambda p: canonical_layer(p))
    w, r = layers("writes"), layers("reads")
    out = (F.when(F.array_contains(w, "gold"), "gold").when(F.array_contains(w, "silver"), "silver")
           .when(F.array_contains(r, "silver"), "gold").when(F.array_contains(r, "bronze"), "silver"))
    counts = layer_tables(catalog).groupBy("layer").agg(F.count(F.lit(1)).alias("tables"))
    return io.select("name", out.alias("layer")).join(counts, "layer").select("name", "layer", "tables")
