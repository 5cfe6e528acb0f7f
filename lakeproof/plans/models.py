"""Config-driven SQL models: selection, binding, dependency-ordered builds and incremental refresh."""

from __future__ import annotations

import re
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.buckets import create_bucketed, merge_bucketed, newest_merged
from ..operators.quality import first_filled
from ..operators.skew import quoted
from ..operators.stitch import stitch_upsert
from ..session import small_frame, table_exists
from ..sources.writers import replace_table

# Column names of a query configuration by role, best first, and the words for active.
SQL_COLUMNS = ("query_text", "query_sql", "sql_text", "sql_query", "query", "sql", "statement", "transformation_sql")
TARGET_COLUMNS = ("target_table", "target_tablename", "target_object", "target", "publish_tablename",
                  "curated_tablename", "output_table", "table_name", "model_name")
ACTIVE_COLUMNS = ("is_active", "active_flag", "active", "enabled")
ORDER_COLUMNS = ("execution_order", "step_number", "sequence", "seq_no", "run_order")
ACTIVE_WORDS = ("y", "yes", "true", "1", "a", "active", "t")
GOLD_PREFIX = r"(?i)^(dim|dimension|fact|fct|mart|agg|aggregate|rpt|report|kpi|summary|metrics?)_"

# Runtime tokens of a configured query that stand for names, not for values.
NAME_TOKENS = ("raw_filename", "curated_db", "curated_tbl_name")


def _column(cfg: DataFrame, names) -> str | None:
    have = {c.lower(): c for c in cfg.columns}
    return next((have[n] for n in names if n in have), None)


def active_queries(cfg: DataFrame) -> DataFrame:
    """Every config row as ``(name, sql, ord, skipped)``: ``skipped`` says why a row is no model.

    Columns are found by their usual names. Models come in the order of the order column as text, then
    by name.
    """
    sql_col, order_col = _column(cfg, SQL_COLUMNS), _column(cfg, ORDER_COLUMNS)
    sql = F.trim(F.coalesce(quoted(sql_col).cast("string"), F.lit(""))) if sql_col else F.lit("")
    active_col = _column(cfg, ACTIVE_COLUMNS)
    active = (F.lower(F.trim(F.coalesce(quoted(active_col).cast("string"), F.lit("y")))).isin(*ACTIVE_WORDS)
              if active_col else F.lit(True))
    order = quoted(order_col).cast("string") if order_col else F.lit("")
    target_col = _column(cfg, TARGET_COLUMNS)
    target = first_filled(cfg, [target_col.lower()]) if target_col else F.lit("")
    name = F.lower(F.btrim(F.regexp_replace(F.substring_index(target, ".", -1), "[^a-zA-Z0-9_]+", "_"), F.lit("_")))
    name = F.when(name != "", name).otherwise(F.concat(F.lit("query_config_"), order))
    skipped = F.lit("no SQL column recognised") if sql_col is None else (
        F.when(sql == "", "empty SQL").when(~active, "inactive"))
    return cfg.select(name.alias("name"), sql.alias("sql"), order.alias("ord"), skipped.cast("string").alias("skipped")
                      ).orderBy("ord", "name")


TOKEN = r"\{(\w+)\}"
LITERAL = r"'(?:[^']|'')*'"
OPERAND = rf"(?:{LITERAL}|\{{\w+\}})"
FILTER = re.compile(rf"([\w.`\"]+)\s*(<=>|<>|!=|>=|<=|=|>|<|\bnot\s+in\b|\bin\b|\bnot\s+like\b|\blike\b)\s*"
                    rf"({OPERAND}|\(\s*{OPERAND}(?:\s*,\s*{OPERAND})*\s*\))", re.I)


def _spelled(text: str, columns: dict[str, str]) -> str:
    """Tokens as parameter markers, names or columns; a literal around tokens becomes a concatenation."""

    def marker(name: str) -> str:
        return f"`{columns[name]}`" if name in columns else f":{name}"

    def operand(m: re.Match) -> str:
        part = m.group()
        if part[0] == "{":
            return f"IDENTIFIER(:{part[1:-1]})" if part[1:-1] in NAME_TOKENS else marker(part[1:-1])
        pieces = re.split(TOKEN, part[1:-1])
        cells = [marker(x) if i % 2 else f"'{x}'" for i, x in enumerate(pieces) if i % 2 or x]
        return part if len(pieces) == 1 else cells[0] if len(cells) == 1 else f"concat({', '.join(cells)})"

    return re.sub(rf"{LITERAL}|{TOKEN}", operand, text)


def bind_template(sql: str, columns: dict[str, str] | None = None) -> str:
    """A configured query with its runtime tokens as parameter markers.

    A filter on a token (a comparison, IN or LIKE) keeps all rows when the parameter is NULL, which is
    the full refresh of the same query. Tokens inside a longer literal are concatenated with the rest
    of it. Name tokens become identifiers, tokens listed in ``columns`` columns of the input.
    """
    columns = columns or {}

    def filtered(m: re.Match) -> str:
        tokens = list(dict.fromkeys(t for t in re.findall(TOKEN, m.group(3)) if t not in NAME_TOKENS and t not in columns))
        whole = f"{m.group(1)} {m.group(2)} {_spelled(m.group(3), columns)}"
        return f"({' OR '.join(f':{t} IS NULL' for t in tokens)} OR {whole})" if tokens else m.group()

    text = re.sub(r"\{curated_db\}\s*\.\s*\{curated_tbl_name\}", "IDENTIFIER(:curated_db || '.' || :curated_tbl_name)", sql)
    return _spelled(FILTER.sub(filtered, text), columns)


def _markers(sql: str) -> set[str]:
    return set(re.findall(r"(?<!:):([A-Za-z_]\w*)", re.sub(LITERAL, "", sql)))


def run_config_query(spark: SparkSession, sql: str, params: dict, raw: DataFrame | None = None,
                     columns: dict[str, str] | None = None) -> DataFrame:
    """Run a configured query with values bound as parameters; ``raw`` stands in for {raw_filename}.

    ``columns`` names the columns of ``raw`` that hold what a token means for each row (its file, say).
    """
    bound = bind_template(sql, columns)
    args = {k: params.get(k) for k in _markers(bound)}
    if raw is not None:
        args["raw_filename"] = f"raw_{uuid.uuid4().hex}"
        raw.createOrReplaceTempView(args["raw_filename"])
    return spark.sql(bound, args={k: args[k] for k in _markers(bound)})


def full_refresh_query(spark: SparkSession, sql: str, names: dict | None = None, raw: DataFrame | None = None) -> DataFrame:
    """The same query over all batches: runtime values are NULL, filters on them keep everything."""
    return run_config_query(spark, sql, {k: v for k, v in (names or {}).items() if k in NAME_TOKENS}, raw)


def build_layer(name: str) -> str:
    """Schema a model is built in: gold for dimensional and serving names, else silver."""
    return "gold" if re.match(GOLD_PREFIX, name) else "silver"


def _waves(models: dict[str, dict]) -> list[list[str]]:
    """Models grouped so that each group only depends on earlier ones."""
    open_deps = {n: {d for d in m.get("depends_on", ()) if d in models and d != n} for n, m in models.items()}
    waves = []
    while open_deps:
        ready = [n for n, deps in open_deps.items() if not deps & open_deps.keys()]
        if not ready:
            raise ValueError(f"models depend on each other in a cycle: {sorted(open_deps)}")
        waves.append(ready)
        for n in ready:
            del open_deps[n]
    return waves


def missing_sources(spark: SparkSession, needed: list[str]) -> list[str]:
    """The source tables that do not exist yet."""
    return sorted(t for t in set(needed) if not table_exists(spark, t))


def build_models(spark: SparkSession, models: list[dict], schemas: dict[str, str] | None = None, parallel: int = 4) -> DataFrame:
    """Materialise models ``{name, sql | fn(spark), depends_on?, materialized?, needs?}`` in dependency order.

    Independent models run as concurrent Spark jobs. A failure marks everything downstream as skipped
    and leaves the rest alone. Output ``(name, target, status, message)``.
    """
    by_name = {m["name"]: m for m in models}
    broken, rows = set(), []

    def target_of(name):
        layer = build_layer(name)
        return f"{(schemas or {}).get(layer, layer)}.{name}"

    def build(name):
        m, target = by_name[name], target_of(name)
        absent = missing_sources(spark, m.get("needs", ()))
        if absent:
            return name, target, "failed", f"missing source tables: {', '.join(absent)}"
        try:
            if m.get("materialized") == "view":
                spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} AS {m['sql']}")
            else:
                df = m["fn"](spark) if "fn" in m else spark.sql(m["sql"])
                replace_table(df, target)
            return name, target, "created", "created"
        except Exception as error:
            return name, target, "failed", str(error)

    for schema in sorted({target_of(n).split(".")[0] for n in by_name}):
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}")
    with ThreadPoolExecutor(parallel) as pool:
        for wave in _waves(by_name):
            ready = []
            for name in wave:
                blocked = sorted(set(by_name[name].get("depends_on", ())) & broken)
                if blocked:
                    rows.append((name, target_of(name), "skipped", f"depends on {', '.join(blocked)}"))
                    broken.add(name)
                else:
                    ready.append(name)
            for result in pool.map(build, ready):
                rows.append(result)
                if result[2] != "created":
                    broken.add(result[0])
    return small_frame(spark, rows, "name string, target string, status string, message string")


def incremental_model(spark: SparkSession, fn, table: str, keys: list[str], watermark: str, slices: int | None = None) -> None:
    """First build complete, later builds merged: ``fn(spark, since)`` returns the rows whose watermark
    is at or after ``since`` (NULL on the first build).

    With ``slices`` the table is bucketed by its key (``operators.buckets``): a later build rewrites only the slices its
    rows fall into and knows ``since`` without reading the table. Without, the whole table is written again.
    """
    if slices:
        if not table_exists(spark, table):
            create_bucketed(fn(spark, None), table, keys, watermark, slices)
            return
        kind = spark.table(table).schema[watermark].dataType
        newest = newest_merged(spark, table)
        since = spark.range(1).select(F.lit(newest).cast(kind)).first()[0]
        merge_bucketed(table, fn(spark, since))
        return
    if not table_exists(spark, table):
        fn(spark, None).write.format("parquet").saveAsTable(table)
        return
    current = spark.table(table)
    since = current.agg(F.max(watermark)).first()[0]
    replace_table(stitch_upsert(current, fn(spark, since), keys, watermark), table)
