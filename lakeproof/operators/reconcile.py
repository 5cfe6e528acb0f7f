"""Proof that a candidate table equals its source: verdict, containment and row-level differences."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import as_col
from ..functions.types import is_numeric
from ..session import cut_lineage, small_frame
from . import profile
from .profile import TABLE
from .skew import numbered, quoted

# Statement separators, comment starts and verbs a row filter must not contain.
FORBIDDEN_IN_FILTER = (r";|--|/\*|\b(DROP|TRUNCATE|DELETE|ALTER|GRANT|REVOKE|INSERT|UPDATE|MERGE|CREATE|CALL|EXECUTE"
                       r"|COPY|MOVE)\b")

# Names of columns that differ by design between two builds of a table.
SURROGATE_SUFFIXES = ("_sk", "_skey", "_surrogate", "_hash")
SURROGATE_WORDS = ("xxhash", "surrogate")
RUN_STAMP_NAMES = ("_load_ts", "_loaded_at", "loaded_at", "load_timestamp", "load_date", "_batch_id", "batch_id",
                   "dwh_batch_id", "_source_file", "_etl_run_id", "etl_run_id", "inserted_at", "updated_at",
                   "_ingested_at")
TABLE_PREFIXES = ("dim_", "fact_", "fct_", "mart_")


def slice_filter(df: DataFrame, predicate: str | None) -> DataFrame:
    """Rows matching a free-form predicate, which may only be a row filter."""
    text = (predicate or "").strip()
    if not text:
        return df
    if re.search(FORBIDDEN_IN_FILTER, text, re.IGNORECASE):
        raise ValueError("the filter may only be a row predicate: no separators, comments or DDL/DML words")
    return df.where(F.expr(text))


@dataclass(frozen=True)
class Verdict:
    """``checks`` has one row per check ``(pair, check, column, metric, source, candidate, match, detail)``."""

    checks: DataFrame

    @property
    def failures(self) -> DataFrame:
        return self.checks.where(~F.col("match"))

    @property
    def passed(self) -> bool:
        return self.failures.isEmpty()

    def summary(self) -> DataFrame:
        return self.checks.groupBy("pair").agg(F.bool_and("match").alias("passed"),
                                               F.count_if(~F.col("match")).alias("failures"))

    def gate(self) -> DataFrame:
        """One row: how many pairs passed, and whether all did."""
        return self.summary().agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total"),
                                  F.coalesce(F.bool_and("passed"), F.lit(False)).alias("all_passed"))


CHECK_COLUMNS = ("pair", "check", "column", "metric", "source", "candidate", "match", "detail")
CHECK_SCHEMA = ("pair string, check string, column string, metric string, source string, candidate string, "
                "match boolean, detail string")


def _schema_checks(pair: str, src: DataFrame, cand: DataFrame) -> list[tuple]:
    """Schema parity and type drift; reads the two schemas only, no data."""
    s = {f.name.lower(): f.dataType for f in src.schema.fields}
    c = {f.name.lower(): f.dataType for f in cand.schema.fields}
    rows = []
    for name in sorted(s.keys() | c.keys()):
        st, ct = s.get(name), c.get(name)
        left, right = st and st.simpleString(), ct and ct.simpleString()
        if st is None or ct is None:
            detail = "missing from candidate" if ct is None else "unexpected in candidate"
            rows.append((pair, "schema", name, "presence", left, right, False, detail))
        elif is_numeric(st) != is_numeric(ct):
            rows.append((pair, "type_drift", name, "type", left, right, False, "number against non-number"))
        elif left != right:
            rows.append((pair, "type_note", name, "type", left, right, True, "translated type"))
    return rows


def _checks(spark: SparkSession, pair: str, src: DataFrame, cand: DataFrame, key, exclude, tol, col_tol, row_tol,
            where, approx, scale) -> DataFrame:
    rows = _schema_checks(pair, src, cand)
    src_names = {c.lower(): c for c in src.columns}
    cand_names = {c.lower(): c for c in cand.columns}
    key = [k.lower() for k in key or []]
    absent = [k for k in key if k not in src_names or k not in cand_names]
    rows += [(pair, "key", k, "presence", None, None, False, "key column not on both sides") for k in absent]
    static = small_frame(spark, rows, CHECK_SCHEMA)
    if absent:
        return static

    skipped = {c.lower() for c in exclude or ()}
    shared = sorted((src_names.keys() & cand_names.keys()) - skipped)
    cols = [c for c in shared if c not in key] or shared
    both_numeric = {c for c in cols if is_numeric(src.schema[src_names[c]].dataType)
                    and is_numeric(cand.schema[cand_names[c]].dataType)}

    def side(df, names):
        part = slice_filter(df, where).select(*[quoted(names[c]).alias(c) for c in dict.fromkeys([*cols, *key])])
        fp = profile.column_fingerprint(part, cols, approx=approx, scale=scale, key=key)
        sums = F.col("metric").isin("sum", "sumsq") & ~F.col("column").isin(*both_numeric) if both_numeric \
            else F.col("metric").isin("sum", "sumsq")
        return fp.where(~sums)

    diff = profile.fingerprint_diff(side(src, src_names), side(cand, cand_names), tol, col_tol)
    is_count = (F.col("column") == TABLE) & (F.col("metric") == "row_count")
    is_key = (F.col("column") == TABLE) & ~is_count
    s, c = F.col("source").try_cast("double"), F.col("candidate").try_cast("double")
    match = (F.when(is_count, (s > 0) & (c > 0) & (F.abs(c - s) <= F.lit(float(row_tol)) * F.greatest(F.lit(1.0), s)))
             .when(is_key, (s == 0) & (c == 0))
             .otherwise(F.col("match")))
    over = "after the filter" if (where or "").strip() else "in the table"
    detail = (F.when(is_count & (s == 0) & (c == 0), f"both sides have no rows {over}")
              .when(is_count & (c == 0), f"the candidate has no rows {over}: build or load it first")
              .when(is_count & (s == 0), f"the source has no rows {over}")
              .when(is_count & ~match, "row count outside the tolerance")
              .when(is_key & ~match, "duplicate or null keys")
              .when(~match, F.concat(F.lit("differs: "), F.col("metric"))))
    measured = diff.select(
        F.lit(pair).alias("pair"),
        F.when(is_count, "row_count").when(is_key, "key").otherwise("fingerprint").alias("check"),
        "column", "metric", "source", "candidate", match.alias("match"), detail.alias("detail"))
    return static.unionByName(measured.select(*CHECK_COLUMNS))


def _short_circuit(checks: DataFrame) -> DataFrame:
    """Where one side is empty, keep that single diagnosis and drop the pair's per-column noise.

    The window runs over check rows: a handful per column of a pair, whatever the size of the tables.
    """
    no_rows = (F.col("check") == "row_count") & ((F.col("source") == "0") | (F.col("candidate") == "0"))
    empty = F.max(F.when(no_rows, 1).otherwise(0)).over(Window.partitionBy("pair"))
    measured = F.col("check").isin("fingerprint", "key") & (F.col("metric") != "presence")
    return checks.withColumn("_empty", empty).where(~(measured & (F.col("_empty") == 1))).drop("_empty")


def reconcile(src: DataFrame, cand: DataFrame, key=None, exclude=(), tol: float = 1e-6, col_tol=None,
              row_tol: float = 0.0, where: str | None = None, pair: str = "pair", approx: float | None = None,
              scale: int | None = None) -> Verdict:
    """Compare two versions of a table: schema, types, row count, key integrity, column fingerprints.

    Each side is read twice (one aggregate for all counts, sums and extremes; one shuffle of digests
    for distinct counts and duplicate keys), when this is called: the verdict holds the few rows that
    came out. Without a key the key checks are left out.
    """
    return _verdict(src.sparkSession, _measured_rows(_checks(src.sparkSession, pair, src, cand, key, exclude, tol, col_tol, row_tol,
                                                             where, approx, scale)))


def _measured_rows(checks: DataFrame) -> list[tuple]:
    """Run the checks of a pair; a handful of rows per column, whatever the size of the tables."""
    return [tuple(r) for r in checks.select(*CHECK_COLUMNS).collect()]


def _verdict(spark: SparkSession, rows: list[tuple]) -> Verdict:
    return Verdict(_short_circuit(spark.createDataFrame(rows, CHECK_SCHEMA)))


def _pair_rows(spark: SparkSession, p: dict, defaults: dict) -> list[tuple]:
    src, cand, name = p["source"], p["candidate"], p["name"]
    exclude = [*p.get("exclude", ()), *[c for c in cand.columns if exclude_reason_of(c)]]
    key = p.get("key")
    key = [k.strip() for k in key.split(",")] if isinstance(key, str) else key
    key = key or suggested_key_of(cand.columns, name)
    rows = _measured_rows(_checks(spark, name, src, cand, key, exclude, p.get("tol", defaults["tol"]),
                                  {**(defaults["col_tol"] or {}), **p.get("col_tol", {})}, p.get("row_tol", defaults["row_tol"]),
                                  p.get("where"), defaults["approx"], defaults["scale"]))
    for fk in p.get("containment", ()):
        orphans = check_containment(cand, fk["parent"], list(zip(fk["child_columns"], fk["parent_columns"]))).first()["orphans"]
        rows.append((name, "containment", ",".join(fk["child_columns"]), "orphans", "0", str(orphans), orphans == 0,
                     "rows without a parent" if orphans else None))
    return rows


def reconcile_many(spark: SparkSession, pairs: list[dict], tol: float = 1e-6, row_tol: float = 0.0,
                   col_tol: dict | None = None, approx: float | None = None, scale: int | None = None, parallel: int = 4) -> Verdict:
    """Reconcile a list of pairs ``{name, source, candidate, key?, exclude?, where?, tol?, row_tol?,
    col_tol?, containment?: [{child_columns, parent, parent_columns}]}``; request-level settings are
    the defaults. Columns that differ by design are left out of the comparison by name. A pair that
    fails, in planning or at run time, becomes a failed row with its message; the others report.
    """
    defaults = {"tol": tol, "row_tol": row_tol, "col_tol": col_tol, "approx": approx, "scale": scale}

    def run(p: dict) -> list[tuple]:
        try:
            return _pair_rows(spark, p, defaults)
        except Exception as error:
            return [(p["name"], "error", None, "error", None, None, False, str(error))]

    with ThreadPoolExecutor(parallel) as pool:
        return _verdict(spark, [row for rows in pool.map(run, pairs) for row in rows])


# ---- key and exclusion suggestions ----------------------------------------------------------

def _alternatives(words) -> str:
    return "|".join(words)


SURROGATE_PATTERN = f"({_alternatives(SURROGATE_SUFFIXES)})$|{_alternatives(SURROGATE_WORDS)}"
RUN_STAMP_PATTERN = f"^({_alternatives(RUN_STAMP_NAMES)})$|^dwh_.*_ts$|_run_id$"


def exclude_reason(c) -> Column:
    """Why a column of this name cannot be compared (surrogate or run stamp), else NULL."""
    name = F.lower(as_col(c))
    return F.when(name.rlike(SURROGATE_PATTERN), "surrogate").when(name.rlike(RUN_STAMP_PATTERN), "run_stamp")


def exclude_reason_of(name: str) -> str | None:
    low = name.lower()
    if re.search(SURROGATE_PATTERN, low):
        return "surrogate"
    return "run_stamp" if re.search(RUN_STAMP_PATTERN, low) else None


def suggest_exclude(columns: DataFrame) -> DataFrame:
    """The columns of a catalogue that should be left out of a comparison, with the reason."""
    return columns.withColumn("reason", exclude_reason("col_name")).where("reason is not null")


def business_table(c) -> Column:
    """Table name without schema and layer prefix."""
    base = F.lower(F.substring_index(F.trim(as_col(c)), ".", -1))
    return F.regexp_replace(base, f"^({_alternatives(TABLE_PREFIXES)})", "")


def suggested_key_of(columns: list[str], table: str) -> list[str]:
    names = {c.lower(): c for c in columns}
    base = re.sub(f"^({_alternatives(TABLE_PREFIXES)})", "", table.lower().split(".")[-1])
    return [names[k] for k in (f"{base}_id", "id") if k in names][:1]


def suggest_key(columns: DataFrame, relationships: DataFrame | None = None) -> DataFrame:
    """Best key per table of a catalogue ``(table, col_name)`` and where it came from.

    Order: declared target of a relationship ``(pk_table, pk_columns)``, then ``<table>_id``, then ``id``.
    """
    low = F.lower("col_name")
    ranked = columns.select(
        "table",
        F.when(low == F.concat(business_table("table"), F.lit("_id")), 2).when(low == "id", 3).otherwise(9)
        .alias("rank"),
        F.array(F.col("col_name")).alias("key"))
    if relationships is not None:
        declared = relationships.where(F.size("pk_columns") > 0).select(
            F.lower(F.substring_index("pk_table", ".", -1)).alias("_base"), F.col("pk_columns").alias("key"))
        declared = declared.groupBy("_base").agg(F.min("key").alias("key"))
        tables = columns.select("table").distinct().withColumn("_base", F.lower(F.substring_index("table", ".", -1)))
        ranked = ranked.unionByName(tables.join(declared, "_base").select("table", F.lit(1).alias("rank"), "key"))
    best = ranked.groupBy("table").agg(F.min(F.struct("rank", "key")).alias("b"))
    source = (F.when(F.col("b.rank") == 1, "declared_relationship").when(F.col("b.rank") == 2, "name_match")
              .when(F.col("b.rank") == 3, "id_column").otherwise("none"))
    return best.select("table", F.when(F.col("b.rank") < 9, F.col("b.key")).alias("key"), source.alias("key_source"))


def confirm_key(df: DataFrame, key: list[str]) -> DataFrame:
    """Is the suggested key really a key: no duplicate and no NULL in the data."""
    counts = profile.duplicate_keys(df, key).select(F.col("duplicate_keys").alias("n"), F.lit("d").alias("k"))
    nulls = profile.null_keys(df, key).select(F.col("null_keys").alias("n"), F.lit("n").alias("k"))
    both = counts.unionByName(nulls).agg(
        F.sum(F.when(F.col("k") == "d", F.col("n"))).alias("duplicate_keys"),
        F.sum(F.when(F.col("k") == "n", F.col("n"))).alias("null_keys"))
    return both.withColumn("usable", (F.col("duplicate_keys") == 0) & (F.col("null_keys") == 0))


# ---- containment ----------------------------------------------------------------------------

def _key_pairs(on) -> list[tuple[str, str]]:
    return [(k, k) if isinstance(k, str) else tuple(k) for k in on]


def _orphan_keys(child: DataFrame, parent: DataFrame, pairs) -> DataFrame:
    """Child keys (all parts set) without a parent, one row per key with its row count.

    Both sides shrink to distinct keys before the join, so a child key that holds a third of the
    table is one row in the shuffle.
    """
    kids = (child.select(*[quoted(c).alias(f"k{i}") for i, (c, _) in enumerate(pairs)]).dropna()
            .groupBy(*[f"k{i}" for i in range(len(pairs))]).agg(F.count(F.lit(1)).alias("rows")))
    known = parent.select(*[quoted(p).alias(f"k{i}") for i, (_, p) in enumerate(pairs)]).distinct()
    return kids.join(known, [f"k{i}" for i in range(len(pairs))], "left_anti")


def check_containment(child: DataFrame, parent: DataFrame, on) -> DataFrame:
    """Number of child rows whose complete key has no parent row. ``on``: names or (child, parent) pairs."""
    return _orphan_keys(child, parent, _key_pairs(on)).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("orphans"))


def orphan_rows(child: DataFrame, parent: DataFrame, on) -> DataFrame:
    """The child rows behind check_containment."""
    pairs = _key_pairs(on)
    known = parent.select(*[quoted(p).alias(f"_k{i}") for i, (_, p) in enumerate(pairs)]).distinct()
    cond = [quoted(c) == F.col(f"_k{i}") for i, (c, _) in enumerate(pairs)]
    return child.dropna(subset=[c for c, _ in pairs]).join(known, cond, "left_anti")


# ---- row-level differences ------------------------------------------------------------------

def _within(x: Column, y: Column, tol: Column) -> Column:
    return x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= tol * F.greatest(F.lit(1.0), F.abs(x), F.abs(y)), F.lit(False))


def _drifted(rows: DataFrame, grouped: DataFrame, key: list[str], inner: dict[int, tuple[float, Column]]) -> DataFrame:
    """``grouped`` with ``_drifted``: the columns of which values of equal rank are not within the tolerance.

    ``inner`` has the tolerance of each column ``_v<i>`` and what shows that a key is still undecided. Only keys
    of three or more rows are ranked (the extremes decide the others). Both sides are numbered by key and value,
    spread over range partitions, and meet by key and rank: two rows a group, however hot the key.
    """
    own = [f"_g{j}" for j in range(len(key))]
    keyed = [quoted(k).alias(g) for k, g in zip(key, own)]
    open_keys = grouped.where((F.col("source_rows") > 2) & reduce(lambda a, b: a | b, [same for _, same in inner.values()]))
    left = rows.select(*keyed, "_sign", *[f"_v{i}" for i in inner])
    right = open_keys.select(*[quoted(k).alias(f"_o{j}") for j, k in enumerate(key)])
    kept = left.join(right, [F.col(g).eqNullSafe(F.col(f"_o{j}")) for j, g in enumerate(own)] or [F.lit(True)], "left_semi")
    cells = kept.select(*own, "_sign", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"_v{i}").alias("x")) for i in inner])).alias("_cell"))
    cells = (cells.select(*own, "_sign", F.col("_cell.i").alias("_column"), F.col("_cell.x").alias("_value")).where("_value is not null")
             .withColumn("_tie", F.monotonically_increasing_id()))  # equal values of a hot key are spread as well
    ranked = numbered(cells, ["_value", "_tie"], "_rank", within=[*own, "_column", "_sign"])
    pairs = ranked.groupBy(*own, "_column", "_rank").agg(
        F.max(F.when(F.col("_sign") > 0, F.col("_value"))).alias("x"), F.max(F.when(F.col("_sign") < 0, F.col("_value"))).alias("y"))
    room = F.create_map(*[F.lit(x) for i, (t, _) in inner.items() for x in (i, t)])[F.col("_column")]
    found = pairs.where(~_within(F.col("x"), F.col("y"), room)).groupBy(*own).agg(F.collect_set("_column").alias("_found"))
    joined = grouped.join(found, [quoted(k).eqNullSafe(F.col(g)) for k, g in zip(key, own)] or [F.lit(True)], "left")
    return joined.select(*grouped.columns, F.coalesce("_found", F.array().cast("array<int>")).alias("_drifted"))


#: A 64-bit hash in three parts of 22, 21 and 21 bits: plain long sums of each stay exact for 10^12 rows of one key.
PART_BITS = (22, 21, 21)


def _parts(v: Column) -> tuple[Column, Column, Column]:
    return v.bitwiseAND(0x3FFFFF), F.shiftright(v, 22).bitwiseAND(0x1FFFFF), F.shiftrightunsigned(v, 43)


def _added(terms: list[Column]) -> Column:
    """The sum as a balanced tree: a wide table makes no deep expression."""
    half = len(terms) // 2
    return terms[0] if len(terms) == 1 else _added(terms[:half]) + _added(terms[half:])


def reconcile_rows(src: DataFrame, cand: DataFrame, key: list[str], cols: list[str] | None = None,
                   tol: float = 0.0, col_tol: dict[str, float] | None = None) -> DataFrame:
    """Keys that are missing, extra, repeated a different number of times, or changed (with the columns).

    One aggregate over the union of both sides, no join: repeated keys cannot fan out and a hot key
    is reduced on the map side. A column is compared through the sum of its 64-bit value hashes
    (source positive, candidate negative), the status of a key through one such sum over all columns, whose hashes differ
    by column: where ``changed_columns`` are not asked for, Spark leaves the sums of single columns out. Number columns with a tolerance are compared value by value: through
    the minimum and maximum of the key's rows, and in keys with as many rows on both sides that agree in these,
    by rank (see ``_drifted``). A tolerance column of a key with another number of rows has changed.
    NULL equals NULL, in keys too.
    """
    names = [c for c in (cols or src.columns) if c.lower() not in {k.lower() for k in key}]
    tols = {k.lower(): v for k, v in (col_tol or {}).items()}

    def aligned(c):
        """Text for columns that are not both numbers or of one type; the union widens numbers itself."""
        a, b = src.schema[c].dataType, cand.select(quoted(c)).schema[0].dataType
        return quoted(c) if a == b or (is_numeric(a) and is_numeric(b)) else quoted(c).cast("string").alias(c)

    def tagged(df, sign):
        return df.select(*[aligned(c) for c in [*key, *names]], F.lit(sign).cast("long").alias("_sign"))

    both = tagged(src, 1).unionByName(tagged(cand, -1))

    def near(c):
        return tols.get(c.lower(), tol) if is_numeric(both.schema[c].dataType) else 0

    def compared(i, c):
        if near(c):
            return quoted(c).cast("double")
        return F.xxhash64(F.lit(i), F.to_json(quoted(c)) if isinstance(both.schema[c].dataType, (T.MapType, T.VariantType)) else quoted(c))

    rows = both.select(*[quoted(k) for k in key], "_sign", *[compared(i, c).alias(f"_v{i}") for i, c in enumerate(names)])
    aggs, changed, inner, differs = [], [], {}, []
    for i, c in enumerate(names):
        v, t = F.col(f"_v{i}"), near(c)
        if t:
            aggs.append(F.sum(F.when(v.isNull(), F.col("_sign")).otherwise(0)).alias(f"_n{i}"))
            same = (F.col("source_rows") == F.col("candidate_rows")) & (F.col(f"_n{i}") == 0)
            for what, measure in (("l", F.min), ("u", F.max)):
                aggs += [measure(F.when(F.col("_sign") == sign, v)).alias(f"_{what}{i}_{side}") for side, sign in (("a", 1), ("b", -1))]
                same = same & _within(F.col(f"_{what}{i}_a"), F.col(f"_{what}{i}_b"), F.lit(float(t)))
            inner[i] = (float(t), same)
            same = same & ~F.array_contains("_drifted", i)
            differs.append(~same)
        else:
            aggs += [F.sum(F.col("_sign") * part).alias(f"_h{i}_{j}") for j, part in enumerate(_parts(v))]
            same = (F.col(f"_h{i}_0") == 0) & (F.col(f"_h{i}_1") == 0) & (F.col(f"_h{i}_2") == 0)
        changed.append(F.when(~same, F.lit(c)))
    if exact := [_parts(F.col(f"_v{i}")) for i in range(len(names)) if i not in inner]:
        for j, bits in enumerate(PART_BITS):  # the sum over all columns, modulo a power of two
            mask = (1 << bits) - 1
            aggs.append(F.sum(F.col("_sign") * _added([parts[j] for parts in exact]).bitwiseAND(mask)).alias(f"_d{j}"))
            differs.append(F.col(f"_d{j}").bitwiseAND(mask) != 0)
    grouped = rows.groupBy(*[quoted(k) for k in key]).agg(
        F.count_if(F.col("_sign") > 0).alias("source_rows"), F.count_if(F.col("_sign") < 0).alias("candidate_rows"),
        *aggs)
    if inner:
        grouped = _drifted(rows, cut_lineage(grouped), key, inner)
    columns = F.array_compact(F.array(*changed)) if changed else F.array().cast("array<string>")
    status = (F.when(F.col("candidate_rows") == 0, "missing").when(F.col("source_rows") == 0, "extra")
              .when(F.col("source_rows") != F.col("candidate_rows"), "recount")
              .when(reduce(lambda a, b: a | b, differs, F.lit(False)), "changed"))
    out = grouped.withColumn("changed_columns", columns).withColumn("status", status).where("status is not null")
    return out.select(*key, "status", "source_rows", "candidate_rows",
                      F.when(F.col("status").isin("changed", "recount"), F.col("changed_columns"))
                      .otherwise(F.array().cast("array<string>")).alias("changed_columns"))
