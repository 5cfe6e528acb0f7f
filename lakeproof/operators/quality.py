"""Executable data-quality tests, rule tables, quarantine and their follow-up reports."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import as_col
from ..session import small_frame
from .profile import duplicate_keys
from .reconcile import check_containment
from .skew import quoted

# Rule-type words of control tables and the kind each one means.
RULE_KINDS = {
    "not_null": ("not_null", "notnull", "null_check", "mandatory", "required"),
    "unique": ("unique", "uniqueness", "duplicate_check", "pk_check", "primary_key"),
    "accepted_values": ("accepted_values", "domain", "value_list", "picklist", "lov"),
    "relationships": ("referential", "foreign_key", "fk_check", "lookup"),
    "range": ("range", "range_check", "between", "min_max", "threshold"),
    "regex": ("regex", "pattern", "format"),
    "file_check": ("row_count", "record_count", "count_check", "header", "header_check", "file_format", "filename",
                   "schema_check", "freshness"),
    "expression": ("custom_sql", "expression", "sql", "business_rule"),
}

# Severity words and the severity each one means.
SEVERITIES = {
    "error": ("critical", "fail", "hard", "error"),
    "warn": ("warn", "warning", "soft"),
    "quarantine": ("quarantine", "reject"),
}

# Column names under which a rule table may keep each field, best first.
RULE_FIELDS = {
    "rule_type": ("rule_type", "rule_name", "check_type", "dq_type"),
    "expression": ("rule_expression", "expression", "rule_sql", "check_sql", "condition"),
    "table": ("table_name", "target_table", "object_name", "entity"),
    "column": ("column_name", "column", "field_name", "attribute"),
    "severity": ("severity", "criticality", "action"),
    "values": ("accepted_values", "value_list", "values", "domain_values"),
    "min": ("min_value", "minimum", "lower_bound"),
    "max": ("max_value", "maximum", "upper_bound"),
    "ref_table": ("ref_table", "reference_table", "lookup_table", "parent_table"),
    "ref_column": ("ref_column", "reference_column", "lookup_column", "parent_column"),
    "label": ("rule_name", "rule_type"),
}

# Load-timestamp columns looked for by the freshness check, best first.
LOADED_AT_COLUMNS = ("_loaded_at", "loaded_at", "_load_ts", "load_ts", "_ingested_at", "ingested_at", "dl_load_ts",
                     "_batch_ts", "_ingest_ts", "ingest_ts")

RESULT_SCHEMA = ("model string, kind string, columns string, status string, passed boolean, violations long, "
                 "detail string")


# ---- row predicates: true means the row violates the rule ------------------------------------

def breaks_not_null(c) -> Column:
    return as_col(c).isNull()


def breaks_accepted_values(c, values) -> Column:
    """NULL passes."""
    return F.coalesce(~as_col(c).cast("string").isin(*values), F.lit(False))


def breaks_range(c, low=None, high=None) -> Column:
    """Both bounds are inclusive and optional, but one is needed. NULL passes."""
    if low is None and high is None:
        raise ValueError("a range needs at least one bound")
    c = as_col(c)
    ok = F.lit(True)
    if low is not None:
        ok = ok & (c >= F.lit(low))
    if high is not None:
        ok = ok & (c <= F.lit(high))
    return F.coalesce(~ok, F.lit(False))


def breaks_regex(c, pattern: str) -> Column:
    return F.coalesce(~as_col(c).rlike(pattern), F.lit(False))


def breaks_expression(rule: str) -> Column:
    return F.coalesce(~F.expr(f"({rule})"), F.lit(False))


# ---- single tests ---------------------------------------------------------------------------

def not_null(df: DataFrame, c: str) -> DataFrame:
    return df.agg(F.count_if(quoted(c).isNull()).alias("violations"))


def unique(df: DataFrame, key: list[str]) -> DataFrame:
    """Repeated keys; several NULL keys are one violation, as they form one group."""
    return duplicate_keys(df, key).withColumnRenamed("duplicate_keys", "violations")


def relationships(child: DataFrame, parent: DataFrame, on) -> DataFrame:
    return check_containment(child, parent, on).withColumnRenamed("orphans", "violations")


def accepted_values(df: DataFrame, c: str, values) -> DataFrame:
    return df.agg(F.count_if(breaks_accepted_values(quoted(c), values)).alias("violations"))


def accepted_range(df: DataFrame, c: str, low=None, high=None) -> DataFrame:
    return df.agg(F.count_if(breaks_range(quoted(c), low, high)).alias("violations"))


def regex(df: DataFrame, c: str, pattern: str) -> DataFrame:
    return df.agg(F.count_if(breaks_regex(quoted(c), pattern)).alias("violations"))


def contract_findings(actual: dict[str, str], expected: list[tuple[str, str]]) -> list[str]:
    def family(kind):
        return kind.upper().replace(" ", "").split("(")[0]

    have = {n.lower(): t for n, t in actual.items()}
    found = [f"missing: {n}" for n, _ in expected if n.lower() not in have]
    found += [f"type of {n}: want {t} got {have[n.lower()]}" for n, t in expected
              if t and n.lower() in have and family(t) != family(have[n.lower()])]
    return found


def contract(columns: DataFrame, expected: DataFrame) -> DataFrame:
    """Contract check over column catalogues ``(table, col_name, col_type)``; extra columns are allowed."""
    def side(df, name):
        family = F.regexp_replace(F.upper(F.substring_index("col_type", "(", 1)), r"\s", "")
        return df.groupBy("table", F.lower("col_name").alias("column")).agg(F.max(family).alias(name))
    joined = side(expected, "want").join(side(columns, "got"), ["table", "column"], "left")
    finding = F.when(F.col("got").isNull(), "missing").when(F.col("got") != F.col("want"), "type_drift")
    return joined.withColumn("finding", finding).where("finding is not null").select("table", "column", "finding")


# ---- test specifications --------------------------------------------------------------------

def _base(c) -> Column:
    return F.lower(F.substring_index(as_col(c), ".", -1))


def build_test_specs(rels: DataFrame, contracts: DataFrame | None = None) -> DataFrame:
    """Tests from declared relationships ``(pk_table, pk_columns, fk_table, fk_columns)`` and contracts
    ``(table, col_name, col_type)``: rows ``(model, kind, columns, parent, parent_columns)``. A contract
    gives one row per expected column, so a table with very many columns never becomes one value.
    """
    usable = rels.select(_base("pk_table").alias("pk"), "pk_columns", _base("fk_table").alias("fk"), "fk_columns")
    grain = usable.where(F.size("pk_columns") > 0).groupBy("pk").agg(F.min("pk_columns").alias("cols"))
    none, no_cols = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    single = F.size("cols") == 1
    uniques = grain.select(F.col("pk").alias("model"), F.when(single, "unique").otherwise("unique_combo").alias("kind"),
                           F.col("cols").alias("columns"), none.alias("parent"), no_cols.alias("parent_columns"))
    foreign = usable.where((F.size("fk_columns") > 0) & (F.col("pk") != "")).distinct()
    parents = foreign.select(F.col("fk").alias("model"), F.lit("relationships").alias("kind"),
                             F.col("fk_columns").alias("columns"), F.col("pk").alias("parent"),
                             F.col("pk_columns").alias("parent_columns"))
    required = (grain.select(F.col("pk").alias("model"), F.explode("cols").alias("c"))
                .unionByName(foreign.select(F.col("fk").alias("model"), F.explode("fk_columns").alias("c"))).distinct()
                .select("model", F.lit("not_null").alias("kind"), F.array("c").alias("columns"),
                        none.alias("parent"), no_cols.alias("parent_columns")))
    out = uniques.unionByName(required).unionByName(parents)
    if contracts is not None:
        expected = contracts.select(_base("table").alias("model"), F.lit("contract").alias("kind"),
                                    F.array(F.lower("col_name")).alias("columns"), none.alias("parent"),
                                    no_cols.alias("parent_columns")).distinct()
        out = out.unionByName(expected)
    return out


def resolve_model(name: str, tables: dict[str, DataFrame]) -> str | None:
    """The deployed table of a model: ``x`` or ``stg_x``, gold before silver before bronze.

    ``tables`` is keyed by ``schema.table`` or by the bare table name.
    """
    low = name.lower()
    wanted = (low, low[4:] if low.startswith("stg_") else f"stg_{low}")
    rank = {"gold": 0, "silver": 1, "bronze": 2}
    found = [(rank.get(k.lower().rpartition(".")[0].split(".")[-1], 3), wanted.index(k.lower().split(".")[-1]), k)
             for k in tables if k.lower().split(".")[-1] in wanted]
    return min(found)[2] if found else None


ROW_TESTS = {
    "not_null": lambda s: breaks_not_null(quoted(s["columns"][0])),
    "accepted_values": lambda s: breaks_accepted_values(quoted(s["columns"][0]), s["values"]),
    "range": lambda s: breaks_range(quoted(s["columns"][0]), s.get("min"), s.get("max")),
    "regex": lambda s: breaks_regex(quoted(s["columns"][0]), s["pattern"]),
    "expression": lambda s: breaks_expression(s["expression"]),
}


def _fixed(spark, spec, status, passed, violations, detail) -> DataFrame:
    return small_frame(spark, [(spec["model"], spec["kind"], ",".join(spec.get("columns", ())), status, passed,
                                violations, detail)], RESULT_SCHEMA)


def _measured(spec, count: DataFrame) -> DataFrame:
    n = F.coalesce(F.col("violations"), F.lit(0))
    return count.select(
        F.lit(spec["model"]).alias("model"), F.lit(spec["kind"]).alias("kind"),
        F.lit(",".join(spec.get("columns", ()))).alias("columns"),
        F.when(n == 0, "passed").otherwise("failed").alias("status"), (n == 0).alias("passed"),
        n.cast("long").alias("violations"),
        F.when(n > 0, F.concat(n.cast("string"), F.lit(f" violation(s) of {spec['kind']}"))).otherwise("").alias("detail"))


def _row_tests(df: DataFrame, specs: list[dict]) -> DataFrame:
    """All row tests of one table in one scan."""
    row = df.agg(*[F.count_if(ROW_TESTS[s["kind"]](s)).alias(f"v{i}") for i, s in enumerate(specs)])
    lines = [F.struct(F.lit(s["model"]).alias("model"), F.lit(s["kind"]).alias("kind"),
                      F.lit(",".join(s.get("columns", ()))).alias("columns"), F.col(f"v{i}").alias("violations"))
             for i, s in enumerate(specs)]
    n = F.col("violations")
    return row.select(F.inline(F.array(*lines))).select(
        "model", "kind", "columns", F.when(n == 0, "passed").otherwise("failed").alias("status"),
        (n == 0).alias("passed"), n.cast("long").alias("violations"),
        F.when(n > 0, F.concat(n.cast("string"), F.lit(" violation(s) of "), F.col("kind"))).otherwise("").alias("detail"))


def _spec_test(spec: dict, tables: dict[str, DataFrame]) -> DataFrame:
    df = tables[resolve_model(spec["model"], tables)]
    kind, spark = spec["kind"], df.sparkSession
    if kind in ("unique", "unique_combo"):
        return _measured(spec, unique(df, spec["columns"]))
    if kind == "relationships":
        parent = resolve_model(spec["parent"], tables)
        if parent is None:
            return _fixed(spark, spec, "skipped", None, 0, f"parent {spec['parent']} is not deployed")
        pairs = list(zip(spec["columns"], spec["parent_columns"]))
        return _measured(spec, relationships(df, tables[parent], pairs))
    if kind == "contract":
        found = contract_findings({f.name: f.dataType.simpleString() for f in df.schema.fields}, spec["expected"])
        return _fixed(spark, spec, "failed" if found else "passed", not found, len(found), "; ".join(found))
    return _fixed(spark, spec, "skipped", None, 0, f"unknown test kind {kind}")


def run_tests(spark: SparkSession, specs: list[dict], tables: dict[str, DataFrame], parallel: int = 4) -> DataFrame:
    """Run all specs: one result row each ``(model, kind, columns, status, passed, violations, detail)``.

    The row tests of a table share one scan. A spec that fails, in planning (missing column, bad
    expression) or at run time (a value that cannot be cast), becomes an error row with its message and
    the other specs still run: if a shared scan fails, its specs are run one by one.
    """
    rows, by_model, alone = [], {}, []

    def error_row(spec: dict, message: str) -> tuple:
        return spec["model"], spec["kind"], ",".join(spec.get("columns", ())), "error", False, 0, message

    for spec in specs:
        target = resolve_model(spec["model"], tables)
        if target is None:
            rows.append(error_row(spec, "model is not deployed"))
        elif spec["kind"] in ROW_TESTS:
            by_model.setdefault(target, []).append(spec)
        else:
            alone.append(spec)

    def one(spec: dict) -> list[tuple]:
        try:
            if spec["kind"] in ROW_TESTS:
                return [tuple(r) for r in _row_tests(tables[resolve_model(spec["model"], tables)], [spec]).collect()]
            return [tuple(r) for r in _spec_test(spec, tables).collect()]
        except Exception as error:
            return [error_row(spec, str(error))]

    def group(name: str) -> list[tuple]:
        try:
            return [tuple(r) for r in _row_tests(tables[name], by_model[name]).collect()]
        except Exception:
            return [row for spec in by_model[name] for row in one(spec)]

    with ThreadPoolExecutor(parallel) as pool:
        for found in [*pool.map(group, by_model), *pool.map(one, alone)]:
            rows += found
    return spark.createDataFrame(rows, RESULT_SCHEMA)


# ---- rule tables ----------------------------------------------------------------------------

def first_filled(df: DataFrame, names) -> Column:
    """The first candidate column of the frame with text in it, trimmed; '' if none has any."""
    have = {c.lower(): c for c in df.columns}
    found = [F.nullif(F.trim(quoted(have[n]).cast("string")), F.lit("")) for n in names if n in have]
    return F.coalesce(*found, F.lit(""))


def rule_word(c) -> Column:
    """Lower-case word characters only, everything else one underscore."""
    return F.btrim(F.regexp_replace(F.lower(F.trim(as_col(c))), "[^a-z0-9_]+", "_"), F.lit("_"))


def _by_word(word: Column, groups: dict[str, tuple[str, ...]]) -> Column:
    pairs = [x for meaning, words in groups.items() for w in words for x in (F.lit(w), F.lit(meaning))]
    return F.try_element_at(F.create_map(*pairs), word)


def classify_rules(rules: DataFrame) -> DataFrame:
    """Kind, severity and parameters of every row of a loosely named rule table; no row is dropped."""
    field = {name: first_filled(rules, cols) for name, cols in RULE_FIELDS.items()}
    expression = field["expression"]
    kind = F.coalesce(_by_word(rule_word(field["rule_type"]), RULE_KINDS),
                      F.when(expression != "", "expression").otherwise("unclassified"))
    word = F.lower(F.when(field["severity"] == "", "error").otherwise(field["severity"]))
    listed = F.when(field["values"] != "", field["values"]).otherwise(expression)
    values = F.filter(F.transform(F.split(listed, "[,;|]"), lambda v: F.trim(v)), lambda v: v != "")
    return rules.select(
        kind.alias("kind"), rule_word(field["table"]).alias("table"), field["column"].alias("column"),
        F.coalesce(_by_word(word, SEVERITIES), word).alias("severity"), field["label"].alias("rule"),
        expression.alias("expression"), F.when(kind == "accepted_values", values).alias("values"),
        F.when(kind == "range", field["min"]).alias("min"), F.when(kind == "range", field["max"]).alias("max"),
        F.when(kind == "relationships", rule_word(field["ref_table"])).alias("ref_table"),
        F.when(kind == "relationships", field["ref_column"]).alias("ref_column"),
        *[quoted(c).alias(f"rule_{c}") for c in rules.columns if c.lower() == "id"])


def _sql_text(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))


def compile_rules(rules: DataFrame) -> DataFrame:
    """Classified rules with a route (test, quarantine, file_check, unclassified) and a row predicate.

    The predicate is what a good row satisfies; unique and relationships have none, they are checked
    as a whole. A quarantine severity is honoured for every kind that has a predicate, and rules
    without the parameters their kind needs are kept as unclassified.
    """
    r = classify_rules(rules)
    kind, col = F.col("kind"), F.concat(F.lit("`"), F.col("column"), F.lit("`"))
    listed = F.array_join(F.transform("values", _sql_text), ", ")
    low, high = F.col("min") != "", F.col("max") != ""
    bounds = F.array_join(F.array_compact(F.array(
        F.when(low, F.concat(col, F.lit(" >= "), F.col("min"))),
        F.when(high, F.concat(col, F.lit(" <= "), F.col("max"))))), " AND ")
    on_column = (F.col("table") != "") & (F.col("column") != "")
    predicate = (F.when((kind == "not_null") & on_column, F.concat(col, F.lit(" IS NOT NULL")))
                 .when((kind == "accepted_values") & on_column & (F.size("values") > 0),
                       F.concat(col, F.lit(" IN ("), listed, F.lit(")")))
                 .when((kind == "range") & on_column & (low | high), bounds)
                 .when((kind == "regex") & on_column & (F.col("expression") != ""),
                       F.concat(col, F.lit(" RLIKE "), _sql_text(F.replace(F.col("expression"), F.lit("\\"), F.lit("\\\\")))))
                 .when((kind == "expression") & (F.col("table") != "") & (F.col("expression") != ""), F.col("expression")))
    whole = on_column & ((kind == "unique") | (
        (kind == "relationships") & (F.col("ref_table") != "") & (F.col("ref_column") != "")))
    stated = (F.col("severity") == "quarantine") & (F.col("expression") != "") & (F.col("table") != "")
    predicate = F.when(stated & (kind != "file_check") & ~kind.isin("regex", "accepted_values"), F.col("expression")
                       ).otherwise(predicate)
    route = (F.when(kind == "file_check", "file_check")
             .when((kind == "expression") & F.col("predicate").isNotNull(), "quarantine")
             .when((F.col("severity") == "quarantine") & F.col("predicate").isNotNull(), "quarantine")
             .when(F.col("predicate").isNotNull() | whole, "test")
             .otherwise("unclassified"))
    return r.withColumn("predicate", predicate).withColumn("route", route)


def rule_summary(compiled: DataFrame) -> DataFrame:
    return compiled.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("route") == k).alias(k) for k in ("test", "quarantine", "file_check", "unclassified")])


def specs_of(compiled_rows) -> list[dict]:
    """run_tests specs of the collected ``test`` rows of a compiled rule table."""
    specs = []
    for r in compiled_rows:
        spec = {"model": r["table"], "columns": [r["column"]], "severity": r["severity"]}
        if r["kind"] == "unique":
            specs.append({**spec, "kind": "unique"})
        elif r["kind"] == "relationships":
            specs.append({**spec, "kind": "relationships", "parent": r["ref_table"], "parent_columns": [r["ref_column"]]})
        else:
            specs.append({**spec, "kind": "expression", "expression": r["predicate"]})
    return specs


# ---- quarantine and reports -----------------------------------------------------------------

def quarantine(df: DataFrame, rule: str, name: str) -> DataFrame:
    """Rows for which the rule is false. Where it is NULL the row is neither rejected nor cleared."""
    return df.where(~F.expr(f"({rule})")).withColumns(
        {"_dq_rejected_at": F.current_timestamp(), "_dq_rule": F.lit(name)})


def quarantine_all(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Rejects of several rules in one scan: one row per broken rule."""
    broken = F.array_compact(F.array(*[F.when(~F.expr(f"({r})"), F.lit(n)) for n, r in rules.items()]))
    return df.withColumn("_dq_rule", F.explode(broken)).withColumn("_dq_rejected_at", F.current_timestamp())


def union_rejects(frames: list[DataFrame]) -> DataFrame:
    """All rejects of a table in one frame, whatever columns each rule added."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def priority_routing(results: DataFrame) -> DataFrame:
    """Target of a failure: ``fail_`` for high priority, else ``warn_``, below the rule's own folder."""
    prefix = F.when(F.lower(F.trim("priority_level")) == "high", "fail_").otherwise("warn_")
    folder = F.regexp_replace("dq_failure_path", "/+$", "")
    return results.withColumn("route", F.concat(prefix, F.col("rule_name"))).withColumn(
        "target_path", F.concat(folder, F.lit("/"), F.col("route")))


def rule_templates(rules: DataFrame, master: DataFrame) -> DataFrame:
    """Rule bodies of the active templates with ``{table}`` and ``{column}`` filled in.

    ``rules``: ``(rule_name, tgt_table_name, column_name, active_flag)``; ``master``: ``(rule_name,
    sql_query, is_active)``.
    """
    bodies = (master.where(F.upper(F.trim("is_active")) == "Y")
              .groupBy(F.lower("rule_name").alias("_rule")).agg(F.max("sql_query").alias("body")))
    active = rules.where(F.upper(F.trim("active_flag")).isin("A", "Y"))
    text = F.replace(F.replace("body", F.lit("{table}"), F.col("tgt_table_name")), F.lit("{column}"), F.col("column_name"))
    return (active.join(bodies, F.lower("rule_name") == F.col("_rule"))
            .select("rule_name", "tgt_table_name", "column_name", text.alias("check_sql")))


def loaded_at_column(df: DataFrame) -> str | None:
    have = {c.lower(): c for c in df.columns}
    return next((have[c] for c in LOADED_AT_COLUMNS if c in have), None)


def source_freshness(df: DataFrame, as_of, warn_h: float = 24, error_h: float = 48, column: str | None = None) -> DataFrame:
    """Age of the newest row in hours and its state (pass, warn, error); an empty table is an error."""
    column = column or loaded_at_column(df)
    if column is None:
        raise ValueError("the table has no known load-timestamp column")
    as_of = as_of if isinstance(as_of, Column) else F.lit(as_of)
    age = (F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(F.col("newest").cast("timestamp"))) / 3600
    state = F.when(F.col("newest").isNull() | (age > error_h), "error").when(age > warn_h, "warn").otherwise("pass")
    return df.agg(F.max(quoted(column)).alias("newest")).select("newest", age.alias("age_hours"), state.alias("state"))


def rule_replay(df: DataFrame, old: str, new: str) -> DataFrame:
    """Pass and fail counts of two versions of a rule on the same rows, and how many rows switched."""
    a, b = F.expr(f"({old})"), F.expr(f"({new})")
    return df.agg(
        F.count_if(a).alias("old_pass"), F.count_if(~a).alias("old_fail"),
        F.count_if(b).alias("new_pass"), F.count_if(~b).alias("new_fail"),
        F.count_if(a & ~b).alias("newly_failing"), F.count_if(~a & b).alias("newly_passing"))


def reject_rate(df: DataFrame, rules: dict[str, str], max_rate: float) -> DataFrame:
    """Rejected share per rule in one scan, and whether it stays within the limit."""
    row = df.agg(F.count(F.lit(1)).alias("total"),
                 *[F.count_if(~F.expr(f"({r})")).alias(f"r{i}") for i, r in enumerate(rules.values())])
    lines = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("rejected"), F.col("total").alias("total"))
                      for i, n in enumerate(rules)])
    rate = F.when(F.col("total") > 0, F.col("rejected") / F.col("total")).otherwise(0.0)
    return row.select(F.inline(lines)).withColumn("rate", rate).withColumn("passed", F.col("rate") <= max_rate)


def file_checks(rows: DataFrame, file_col: str = "file_name", expected_header: list[str] | None = None,
                header_col: str | None = None, name_pattern: str | None = None, formats: tuple[str, ...] = (),
                min_rows: int | None = None, loaded_at: str | None = None, as_of=None, max_age_h: float = 48,
                listing: DataFrame | None = None, expected_columns: list[str] | None = None) -> DataFrame:
    """Landing checks per file: row count, header, schema, format, name and freshness.

    ``rows`` has one row per record with its file name; a file becomes one row by a map-side
    combined aggregate. ``listing(file_name)`` are the files that landed (see sources.files.landed_files):
    those without rows are checked too. The schema check looks for ``expected_columns`` in the header in
    any order and shows those it lacks. Output ``(file, check, passed, observed)``, one row per file and check.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    if header_col:
        aggs.append(F.min(header_col).alias("header"))
    if loaded_at:
        aggs.append(F.max(loaded_at).alias("newest"))
    files = rows.groupBy(F.col(file_col).alias("file")).agg(*aggs)
    if listing is not None:
        landed = listing.select(F.col("file_name").alias("file")).distinct()
        files = landed.join(files, "file", "full_outer").withColumn("n", F.coalesce("n", F.lit(0)))
    extension = F.lower(F.substring_index("file", ".", -1))
    checks = []

    def add(check, passed, observed):
        checks.append(F.struct(F.lit(check).alias("check"), F.coalesce(passed, F.lit(False)).alias("passed"),
                               observed.cast("string").alias("observed")))

    if min_rows is not None:
        add("row_count", F.col("n") >= min_rows, F.col("n"))
    if expected_header is not None:
        wanted = ",".join(h.lower() for h in expected_header)
        add("header", F.lower("header") == wanted, F.col("header"))
    if expected_columns is not None:
        have = F.transform(F.split(F.lower("header"), ","), lambda c: F.trim(c))
        lacking = F.array_except(F.array(*[F.lit(c.lower()) for c in expected_columns]), F.coalesce(have, F.array().cast("array<string>")))
        add("schema", F.size(lacking) == 0, F.array_join(lacking, ","))
    if formats:
        add("file_format", extension.isin(*[f.lower() for f in formats]), extension)
    if name_pattern:
        add("filename", F.col("file").rlike(name_pattern), F.col("file"))
    if loaded_at:
        as_of = as_of if isinstance(as_of, Column) else F.lit(as_of)
        age = (F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(F.col("newest").cast("timestamp"))) / 3600
        add("freshness", age <= max_age_h, F.round(age, 2))
    return files.select("file", F.inline(F.array(*checks)))
