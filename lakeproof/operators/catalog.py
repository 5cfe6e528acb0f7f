"""Catalogue analytics: duplicates, planned targets, control tables, operations graph, script reviews."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import as_col, base_name
from ..session import cut_lineage

# Known control tables, the names they go by and the columns that give them away.
CONTROL_TABLES = {
    "configuration_master": (r"^config(uration)?_master$|^cdl_config(uration)?(_master)?$", (
        "source_system", "file_pattern", "file_name_pattern", "target_table", "frequency", "is_active", "active_flag",
        "landing_path")),
    "file_process_log": (r"^file_process_log$|^file_processing_log$", (
        "file_name", "file_status", "batch_id", "record_count", "processed_date", "process_status", "file_received_date")),
    "parent_batch_process": (r"^parent_batch(_process)?$|^batch_process(_master)?$", (
        "batch_id", "batch_status", "batch_start_time", "batch_end_time", "batch_date", "parent_batch_id")),
    "cdl_ingestion_log": (r"^(cdl_)?ingestion_log$", (
        "table_name", "ingestion_status", "batch_id", "row_count", "ingestion_start", "ingestion_end", "layer")),
    "query_configuration": (r"^query_config(uration)?$", (
        "query_text", "query_sql", "sql_text", "execution_order", "step_number", "target_table", "query_type")),
    "dq_rules": (r"^dq_rules?$|^data_quality_rules?$", (
        "rule_name", "rule_type", "rule_expression", "column_name", "table_name", "severity", "threshold", "is_active")),
    "message_template": (r"^message_templates?$|^notification_templates?$", (
        "template_name", "template_body", "message_body", "subject", "recipients", "notification_type")),
    "cdl_ds_snowflake_replicate": (r"^(cdl_|dl_)?(ds_)?snowflake_replicat(e|ion)$", (
        "snowflake_table", "snowflake_schema", "replicate_flag", "source_table", "sync_status", "last_sync_time")),
    "dq_rules_master": (r"^dq_rules_master$", ("rule_name", "sql_query", "is_active")),
    "outbound_logs": (r"^outbound_logs?$", ("output_status", "batch_id", "source_system")),
    "stitching_configuration": (r"^stitching_config(uration)?$", (
        "stitching_type", "target_table_name", "source_table_name", "primary_keys", "record_load_key", "dl_source")),
    "outbound_query_configuration": (r"^outbound_query_config(uration)?$", (
        "target_location_path", "source_system", "sql_query")),
}

# Config columns by role, best first, and the words that mark a run ledger.
ROLE_COLUMNS = {
    "source": ("source_tablename", "source_table_name", "source_table", "src_table", "source_object_name",
               "curated_tablename", "raw_tablename", "from_table"),
    "target": ("target_tablename", "target_table_name", "target_table", "tgt_table", "publish_tablename",
               "curated_tablename", "to_table"),
    "interface": ("interface", "job", "job_name", "step", "step_name", "stage", "phase"),
    "replica": ("snowflake_table", "target_table", "snowflake_schema"),
}
LEDGER_WORDS = ("batch", "log", "ingestion", "audit")

# Layer by catalogue name, and by a name only a config row knows; first match wins.
OPS_LAYERS = {"gold": r"gold|publish|mart|_dim|\.dim|_fct|\.fct|fact", "silver": "silver|curated|cleansed|conform",
              "bronze": "bronze|raw|landing|stage|staging"}
CONFIG_NAME_LAYERS = {"source": r"\.(xlsx|xls|csv|json|parquet)$|landing", "bronze": r"^raw[_.]|/raw|_raw|bronze",
                      "silver": "^stg_|staging|curated|silver", "gold": "^(dim|fct|fact|mart|pub)_|gold|publish"}

# Table words and driver columns of config-driven scripts, and words that are no tables.
CONFIG_TABLE = (r"(?i)\b(\w*(?:configuration|config_master|ingestion_log|file_process_log|batch_process|control_table|"
                r"metadata_table|_replicate|_manifest)\w*|\w+_config|\w+_control)\b")
CONFIG_NOT_TABLES = ("hadoopconfiguration", "configuration", "sparkconfiguration")
CONFIG_NOT_SUFFIX = r"(_id|_name|_qry|_query|_available|_df|_sequence)$"
CONFIG_COLUMNS = (
    "source_object_name", "curated_tablename", "publish_tablename", "configuration_id", "full_or_incremental_load",
    "parent_batch_id", "active_flag", "source_system", "pattern_name", "primary_key", "s3_landing_path", "s3_raw_path",
    "s3_curated_path", "s3_publish_path", "curated_database", "publish_database", "file_format", "sql_query",
    "source_tablename", "target_tablename", "priority_column", "truncate_load_flag", "partition_column",
    "data_load_flag", "reporting_cluster")

# Review marks, scaffold marks and dialect leftovers in generated artifacts.
TODO_MARK = r"(?i)(?:--|#)\s*(?:TODO|FIXME)\s*(?:\[\s*([A-Za-z][A-Za-z-]*)\s*\])?\s*:?\s*(.*)"
SCAFFOLD_MARKS = ("scaffold-reason:", "generated scaffold", "configure an ai provider", "hand-translate")
SCAFFOLD_REASON = r"(?:--|#)\s*SCAFFOLD-REASON:\s*(.+)"
DIALECT_LEFTOVERS = {
    "flatten": r"(?i)\bLATERAL\s+FLATTEN\b|\bFLATTEN\s*\(",
    "semi_structured": r"(?i)\bPARSE_JSON\b|\bTO_VARIANT\b|\bTO_OBJECT\b|\bOBJECT_CONSTRUCT\b|\bARRAY_CONSTRUCT\b",
    "listagg": r"(?i)\bLISTAGG\b|\bGROUP_CONCAT\b",
    "untranslated_function": r"(?i)\bTRY_TO_(DATE|TIMESTAMP|NUMBER|DECIMAL)\b|\bTO_CHAR\b",
}


def word_name(c) -> Column:
    """Last dotted part in lower case, other characters than letters and digits one underscore."""
    last = F.substring_index(F.regexp_replace(F.trim(as_col(c)), "^\"+|\"+$", ""), ".", -1)
    return F.btrim(F.regexp_replace(F.lower(last), "[^a-z0-9]+", "_"), F.lit("_"))


# ---- planned targets and names --------------------------------------------------------------

def precheck_targets(planned: DataFrame, existing: DataFrame) -> DataFrame:
    """Planned tables ``(full_name, selected)`` with ``status`` (already_present or to_build) against
    ``existing(full_name)``, by base name without regard to case, and ``required`` for upstream tables
    that were not selected."""
    have = existing.select(base_name("full_name").alias("_base")).distinct()
    return (planned.join(have, base_name("full_name") == F.col("_base"), "left")
            .select(*planned.columns, F.when(F.col("_base").isNotNull(), "already_present").otherwise("to_build").alias("status"),
                    (~F.col("selected")).alias("required")))


def ensure_unique_names(tables: DataFrame) -> DataFrame:
    """Landing name of ``tables(schema, name)``: the base name, schema-qualified where schemas share it."""
    based = tables.withColumn("_base", base_name("name"))
    shared = based.groupBy(F.col("_base").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    target = F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat("schema", F.lit("_"), "_base"))
    return based.join(shared, F.col("_base").eqNullSafe(F.col("_b"))).select(*tables.columns, target.alias("target"))


# ---- duplicates -----------------------------------------------------------------------------

def _pair_minimum(pdf):
    """Smallest Jaccard ratio between two blocks of column sets, by one matrix product per block pair."""
    import numpy as np
    import pandas as pd

    words = {w: i for i, w in enumerate(sorted({w for cols in pdf["columns"] for w in cols}))}
    bits = np.zeros((len(pdf), len(words)), dtype=np.float32)
    for r, cols in enumerate(pdf["columns"]):
        bits[r, [words[w] for w in cols]] = 1
    size = bits.sum(axis=1)
    left, right = (pdf["block"] == pdf["b1"]).to_numpy(), (pdf["block"] == pdf["b2"]).to_numpy()
    both = bits[left] @ bits[right].T
    ratio = both / (size[left][:, None] + size[right][None, :] - both)
    return pd.DataFrame({"base_name": [pdf["base_name"].iloc[0]], "overlap": [float(ratio.min())]})


def find_duplicates(catalog: DataFrame, block: int = 256) -> DataFrame:
    """Base names held in more than one place: ``(base_name, members, cross_system, column_overlap)``.

    ``catalog(full_name, system, columns)``. The overlap is the smallest Jaccard ratio of the column
    sets of any two members, rounded to 2 digits, NULL with fewer than two known column sets. Equal
    column sets collapse first; a name with more than ``block`` different sets is cut into blocks, and
    each pair of blocks is one small matrix product whose single result leaves the task: pairs of
    members are never rows, and no task sees a whole group.
    """
    sets = F.array_sort(F.array_distinct(F.transform("columns", lambda c: F.lower(c))))
    members = catalog.select(base_name("full_name").alias("base_name"), "system", sets.alias("columns")).where("base_name <> ''")
    groups = members.groupBy("base_name").agg(
        F.count(F.lit(1)).alias("members"), (F.min("system") != F.max("system")).alias("cross_system"),
        F.count_if(F.size("columns") > 0).alias("_known")).where("members > 1")
    distinct = members.where("size(columns) > 0").select("base_name", "columns").distinct()
    width = distinct.groupBy("base_name").agg(F.count(F.lit(1)).alias("_sets")).where("_sets > 1")
    blocks = F.ceil(F.col("_sets") / block).cast("int")
    placed = (distinct.join(width, "base_name")
              .withColumn("block", F.pmod(F.xxhash64("columns"), F.greatest(blocks, F.lit(1)).cast("long")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
              .select("base_name", "columns", "block", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2")))
    # a block pair only one of whose blocks has sets (uneven hashing) holds no pair
    pairs = placed.groupBy("base_name", "b1", "b2").agg(F.countDistinct("block").alias("_blocks"), F.count(F.lit(1)).alias("_rows"))
    usable = pairs.where((F.col("b1") == F.col("b2")) | (F.col("_blocks") == 2)).select("base_name", "b1", "b2")
    minima = (placed.join(usable, ["base_name", "b1", "b2"], "left_semi").groupBy("base_name", "b1", "b2")
              .applyInPandas(_pair_minimum, "base_name string, overlap double"))
    smallest = minima.groupBy("base_name").agg(F.min("overlap").alias("overlap"))
    overlap = F.when(F.col("_known") >= 2, F.round(F.coalesce("overlap", F.lit(1.0)), 2))
    return groups.join(smallest, "base_name", "left").select("base_name", "members", "cross_system", overlap.alias("column_overlap"))


def duplicate_advice(dups: DataFrame) -> DataFrame:
    severity = (F.when(F.col("cross_system") & (F.coalesce("column_overlap", F.lit(0.0)) >= 0.6), "high")
                .when(F.col("cross_system"), "medium").otherwise("low"))
    return dups.withColumn("severity", severity)


# ---- control tables -------------------------------------------------------------------------

def classify_control_table(columns: DataFrame) -> DataFrame:
    """Which control table is each table of ``columns(table, col_name)``? By name, else by at least
    three tell-tale columns (most hits, then listed first). Output ``(table, canonical, matched_by)``."""
    norm, by_name = word_name("table"), None
    for canonical, (pattern, _) in CONTROL_TABLES.items():
        by_name = F.when(norm.rlike(pattern), canonical) if by_name is None else by_name.when(norm.rlike(pattern), canonical)
    order = list(CONTROL_TABLES)
    owners: dict[str, list[int]] = {}
    for i, (_, hints) in enumerate(CONTROL_TABLES.values()):
        for h in hints:
            owners.setdefault(h, []).append(i)
    lookup = F.create_map(*[x for h, ids in owners.items() for x in (F.lit(h), F.array(*[F.lit(i) for i in ids]))])
    hits = (columns.select("table", word_name("col_name").alias("c")).distinct()
            .select("table", F.explode(F.try_element_at(lookup, F.col("c"))).alias("i"))
            .groupBy("table", "i").agg(F.count(F.lit(1)).alias("n")).where("n >= 3"))
    best = hits.groupBy("table").agg(F.max_by("i", F.struct("n", -F.col("i"))).alias("i"))
    named = F.get(F.array(*[F.lit(c) for c in order]), F.col("i"))
    return (columns.select("table").distinct().withColumn("_name", by_name).join(best, "table", "left")
            .select("table", F.coalesce("_name", named).alias("canonical"),
                    F.when(F.col("_name").isNotNull(), "name").when(F.col("i").isNotNull(), "columns").alias("matched_by"))
            .where("canonical is not null"))


def detect_config_driven(scripts: DataFrame) -> DataFrame:
    """Config tables and driver columns per script ``(name, text)``, and whether each is config-driven
    (a table and two columns)."""
    low = F.lower(F.coalesce("text", F.lit("")))
    tables = F.filter(F.array_distinct(F.regexp_extract_all(low, F.lit(CONFIG_TABLE), 1)),
                      lambda t: ~t.isin(*CONFIG_NOT_TABLES) & ~t.rlike(CONFIG_NOT_SUFFIX))
    found = F.array_compact(F.array(*[F.when(low.contains(c), F.lit(c)) for c in CONFIG_COLUMNS]))
    store = (F.when(low.rlike("jdbc:postgresql|postgres") | (low.contains("jdbc") & low.contains("5432")), "postgres")
             .when(low.rlike(r"net\.snowflake|format\([\"']snowflake[\"']\)"), "snowflake")
             .when(low.rlike("jdbc|rds|get_secret_manager"), "jdbc").otherwise("unknown"))
    return scripts.select("name", F.array_sort(tables).alias("tables"), F.array_sort(found).alias("columns"), store.alias("store")
                          ).withColumn("config_driven", (F.size("tables") >= 1) & (F.size("columns") >= 2))


def config_driven_estate(detected: DataFrame) -> DataFrame:
    """The verdict over all scripts together: distinct tables and columns, and the store they sit in."""
    names = detected.select(F.explode(F.concat(
        F.transform("tables", lambda t: F.struct(F.lit("table").alias("k"), t.alias("v"))),
        F.transform("columns", lambda c: F.struct(F.lit("column").alias("k"), c.alias("v"))))).alias("x")).select("x.*").distinct()
    counts = names.agg(F.count_if(F.col("k") == "table").alias("tables"), F.count_if(F.col("k") == "column").alias("columns"))
    return counts.withColumn("config_driven", (F.col("tables") >= 1) & (F.col("columns") >= 2))


def review_queue(artifacts: DataFrame) -> DataFrame:
    """Open review items of generated artifacts ``(kind, name, text)``: ``(kind, name, tag, line, detail)``.

    A scaffold is one item; otherwise every TODO or FIXME mark with its line, and dialect leftovers
    outside notebooks.
    """
    low = F.lower("text")
    scaffold = low.rlike("|".join(SCAFFOLD_MARKS))
    reason = F.regexp_extract("text", SCAFFOLD_REASON, 1)
    whole = artifacts.where(scaffold).select(
        "kind", "name", F.lit("NEEDS-AI").alias("tag"), F.lit(0).alias("line"),
        F.when(reason != "", F.trim(reason)).otherwise("not translated").alias("detail"))
    lines = (artifacts.where(~scaffold).where(low.rlike("todo|fixme"))
             .select("kind", "name", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("pos", "l")))
    marks = lines.select("kind", "name", "pos", "l", F.explode(F.regexp_extract_all("l", F.lit(TODO_MARK), 0)).alias("m"))
    tag, detail = F.upper(F.regexp_extract("m", TODO_MARK, 1)), F.trim(F.regexp_extract("m", TODO_MARK, 2))
    todo = marks.select("kind", "name", F.when(tag == "", "TODO").otherwise(tag).alias("tag"), (F.col("pos") + 1).alias("line"),
                        F.when(detail == "", F.trim("l")).otherwise(detail).alias("detail"))
    leftovers = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(k)) for k, p in DIALECT_LEFTOVERS.items()]))
    dialect = (artifacts.where(~scaffold).where(~F.lower("kind").rlike("notebook|pyspark"))
               .select("kind", "name", F.lit("DIALECT").alias("tag"), F.lit(0).alias("line"), F.explode(leftovers).alias("detail")))
    return whole.unionByName(todo).unionByName(dialect)


# ---- job matching and operations graph ------------------------------------------------------

def _grams(c: Column, n: int) -> Column:
    """All distinct substrings of length n."""
    last = F.length(c) - (n - 1)
    return F.when(last >= 1, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(c, i, F.lit(n))))).otherwise(
        F.array().cast("array<string>"))


def _contained(short: DataFrame, long: DataFrame) -> DataFrame:
    """Pairs ``(s, l)`` of distinct names where l contains s, without comparing all names.

    Every short name is looked up by its rarest substring of (up to) three characters among those of
    the long names; only names sharing it are compared.
    """
    grams = long.select("l", F.explode(F.array_union(_grams(F.col("l"), 3), F.array_union(
        _grams(F.col("l"), 2), _grams(F.col("l"), 1)))).alias("g"))
    frequency = grams.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    width = F.least(F.lit(3), F.length("s"))
    probes = short.where("s <> ''").select("s", F.explode(
        F.when(width == 3, _grams(F.col("s"), 3)).otherwise(F.array("s"))).alias("g"))
    rarest = probes.join(frequency, "g").groupBy("s").agg(F.min_by("g", F.struct("n", "g")).alias("g"),
                                                          F.count(F.lit(1)).alias("found"))
    needed = short.where("s <> ''").select("s", F.when(width == 3, F.size(_grams(F.col("s"), 3))).otherwise(1).alias("need"))
    possible = rarest.join(needed, "s").where("found = need").select("s", "g")  # every gram must occur somewhere
    return possible.join(grams, "g").where(F.contains("l", "s")).select("s", "l")


def contains_match_job(cells: DataFrame, jobs: DataFrame) -> DataFrame:
    """Job of every config cell: ``cells(value)`` against ``jobs(job)`` → ``(value, job)``.

    Equal base names first, else a job whose base name contains the cell's or is contained in it
    (first by name). Cells without a match are left out.
    """
    values = cells.select("value").distinct().select("value", word_name("value").alias("b")).where("b <> ''")
    known = jobs.select("job", word_name("job").alias("b")).where("b <> ''").groupBy("b").agg(F.min("job").alias("job"))
    bases, job_bases = values.select("b").distinct(), known.select(F.col("b").alias("jb"))
    exact = bases.join(job_bases, F.col("b") == F.col("jb")).select("b", "jb", F.lit(0).alias("rank"))
    inner = _contained(bases.select(F.col("b").alias("s")), job_bases.select(F.col("jb").alias("l")))
    outer = _contained(job_bases.select(F.col("jb").alias("s")), bases.select(F.col("b").alias("l")))
    near = (inner.select(F.col("s").alias("b"), F.col("l").alias("jb")).unionByName(
        outer.select(F.col("l").alias("b"), F.col("s").alias("jb"))).withColumn("rank", F.lit(1)))
    best = exact.unionByName(near).groupBy("b").agg(F.min(F.struct("rank", "jb")).alias("m")).select("b", F.col("m.jb").alias("jb"))
    return (values.join(best, "b").join(known.select(F.col("b").alias("jb"), "job"), "jb").select("value", "job"))


def config_cells(df: DataFrame, table: str, canonical: str, row_id: str) -> DataFrame:
    """A control table as cells ``(table, canonical, row_id, col, value)``."""
    cols = [c for c in df.columns if c != row_id]
    text = df.select(F.col(row_id).cast("string").alias("row_id"), *[F.col(c).cast("string").alias(c) for c in cols])
    return text.unpivot("row_id", cols, "col", "value").select(
        F.lit(table).alias("table"), F.lit(canonical).alias("canonical"), "row_id", "col", "value")


@dataclass(frozen=True)
class OpsGraph:
    """``nodes(id, label, type)``, typed ``edges(src, dst, kind, label)`` and ``health(kind, detail)``."""

    nodes: DataFrame
    edges: DataFrame
    health: DataFrame


def _role_columns(cells: DataFrame) -> DataFrame:
    """The column of each config table that plays each role: exact candidates first, then containing ones."""
    low = F.lower("col")
    picks = []
    for role, names in ROLE_COLUMNS.items():
        rank = None
        for i, n in enumerate(names):
            rank = F.when(low == n, i) if rank is None else rank.when(low == n, i)
        for i, n in enumerate(names):
            rank = rank.when(low.contains(n), 100 + i)
        picks.append(F.struct(F.lit(role).alias("role"), rank.alias("rank")))
    return (cells.select("table", "col").distinct().select("table", "col", F.inline(F.array(*picks))).where("rank is not null")
            .groupBy("table", "role").agg(F.min(F.struct("rank", "col")).alias("b")).select("table", "role", F.col("b.col").alias("col")))


def _first_layer(name: Column, patterns: dict[str, str], fallback) -> Column:
    low, out = F.lower(name), None
    for layer, pattern in patterns.items():
        out = F.when(low.rlike(pattern), layer) if out is None else out.when(low.rlike(pattern), layer)
    return out.otherwise(fallback)


def _ops_layer(name: Column) -> Column:
    return _first_layer(name, OPS_LAYERS, "silver")


def _named_layer(name: Column, fallback) -> Column:
    return _first_layer(name, CONFIG_NAME_LAYERS, fallback)


def ops_graph(jobs: DataFrame, cells: DataFrame, catalog: DataFrame) -> OpsGraph:
    """Execution, control, data and replicate edges of ``jobs(key, legacy_name, depends_on)``, control
    table ``cells`` (see config_cells) and ``catalog(full_name, system)``.

    An edge needs evidence: a config value that equals a catalogue table by base name or names a job.
    Tables that only a config row knows become ``ref:`` nodes. The matched rows and the edges, which
    several parts of the result read, are written to the checkpoint folder once.
    """
    job_id = F.concat(F.lit("job:"), word_name("legacy_name"))
    named = jobs.withColumn("legacy_name", F.coalesce("legacy_name", "key")).withColumn("id", job_id)
    job_nodes = named.groupBy("id").agg(F.min("legacy_name").alias("label")).withColumn("type", F.lit("job"))
    deps = named.select("key", "id", F.explode("depends_on").alias("up"))
    keys = named.groupBy(F.col("key").alias("up")).agg(F.min("id").alias("up_id"))
    execution = deps.join(keys, "up").where("up_id <> id").select(
        F.col("up_id").alias("src"), F.col("id").alias("dst"), F.lit("execution").alias("kind"), F.lit("").alias("label"))
    broken = deps.join(keys, "up", "left_anti").select(
        F.lit("broken_chain").alias("kind"), F.concat("key", F.lit(" depends on unknown task "), "up").alias("detail"))

    warehouse = F.col("system") == "warehouse"
    table_nodes = catalog.select(
        F.concat(F.when(warehouse, "sf:").otherwise("tbl:"), word_name("full_name")).alias("id"), F.col("full_name").alias("label"),
        F.when(warehouse, "gold").otherwise(_ops_layer(F.col("full_name"))).alias("type")).groupBy("id").agg(
        F.min(F.struct("label", "type")).alias("x")).select("id", "x.*")
    by_base = table_nodes.groupBy(F.substring_index("id", ":", -1).alias("base")).agg(F.max("id").alias("node"))  # tbl before sf

    filled = cells.where(F.trim(F.coalesce("value", F.lit(""))) != "")
    roles = _role_columns(cells)
    ruled = filled.join(roles, ["table", "col"])
    rows = ruled.groupBy("table", "canonical", "row_id").agg(
        *[F.max(F.when(F.col("role") == r, F.col("value"))).alias(r) for r in ROLE_COLUMNS])
    match = cut_lineage(contains_match_job(filled.select("value"), named.select(F.col("legacy_name").alias("job"))).select(
        "value", F.concat(F.lit("job:"), word_name("job")).alias("job")))

    def with_node(df, col, fallback):
        found = df.withColumn("base", word_name(col)).join(by_base, "base", "left").drop("base")
        made = F.when(F.col(col).isNotNull(), F.concat(F.lit("ref:"), word_name(col)))
        return found.withColumn(f"{col}_node", F.coalesce("node", made) if fallback else F.col("node")).drop("node")

    data_rows = with_node(with_node(with_node(rows, "source", True), "target", True), "replica", False)
    data_rows = cut_lineage(data_rows.join(match.withColumnRenamed("value", "interface"), "interface", "left"))
    linked = data_rows.where("source_node is not null and target_node is not null")
    through = F.when(F.col("job").isNotNull(), F.array(
        F.struct(F.col("source_node").alias("src"), F.col("job").alias("dst"), F.lit("").alias("label")),
        F.struct(F.col("job").alias("src"), F.col("target_node").alias("dst"), F.lit("").alias("label")))).otherwise(F.array(
            F.struct(F.col("source_node").alias("src"), F.col("target_node").alias("dst"), F.col("canonical").alias("label"))))
    data = linked.select(F.inline(through)).where("src <> dst").select("src", "dst", F.lit("data").alias("kind"), "label")
    replicate = (data_rows.where(F.col("canonical").rlike("snowflake|replicat")).where("replica_node is not null and source_node is not null")
                 .where("source_node <> replica_node and source_node not like 'ref:%'")
                 .select(F.col("source_node").alias("src"), F.col("replica_node").alias("dst"), F.lit("replicate").alias("kind"), F.lit("").alias("label")))
    ledger = F.col("canonical").rlike("|".join(LEDGER_WORDS))
    control = filled.select("table", "canonical", "value").distinct().join(match, "value").select(
        F.col("job").alias("src"), F.concat(F.lit("ctl:"), word_name("table")).alias("dst"), F.lit("control").alias("kind"),
        F.when(ledger, "writes").otherwise("reads").alias("label"))
    edges = cut_lineage(execution.unionByName(data).unionByName(replicate).unionByName(control).distinct())

    control_nodes = cells.select(F.concat(F.lit("ctl:"), word_name("table")).alias("id"), F.col("table").alias("label"),
                                 F.lit("control").alias("type")).distinct()
    made = (data_rows.select(F.col("source").alias("label"), F.col("source_node").alias("id"), F.lit("silver").alias("fallback"))
            .unionByName(data_rows.select(F.col("target").alias("label"), F.col("target_node").alias("id"), F.lit("gold").alias("fallback")))
            .where("id like 'ref:%'"))
    ref_nodes = made.groupBy("id").agg(F.max(F.struct("fallback", "label")).alias("x")).select(
        "id", F.col("x.label").alias("label"), _named_layer(F.col("x.label"), F.col("x.fallback")).alias("type"))
    nodes = job_nodes.unionByName(table_nodes).unionByName(control_nodes).unionByName(ref_nodes)
    return OpsGraph(nodes, edges, ops_health(nodes, edges).unionByName(broken))


def ops_health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """missing_table, orphan_table and job_no_logic findings of an operations graph."""
    flow = edges.where("kind in ('data', 'replicate')")
    touched = flow.select(F.col("src").alias("id")).unionByName(flow.select(F.col("dst").alias("id"))).distinct()
    used = touched.unionByName(edges.where("kind = 'control'").select(F.col("src").alias("id"))).distinct()
    missing = nodes.where("id like 'ref:%'").select(F.lit("missing_table").alias("kind"), F.col("label").alias("detail"))
    orphan = (nodes.where("type in ('bronze', 'silver', 'gold') and id not like 'ref:%'").join(touched, "id", "left_anti")
              .select(F.lit("orphan_table").alias("kind"), F.col("label").alias("detail")))
    idle = nodes.where("type = 'job'").join(used, "id", "left_anti").select(
        F.lit("job_no_logic").alias("kind"), F.col("label").alias("detail"))
    return missing.unionByName(orphan).unionByName(idle)
