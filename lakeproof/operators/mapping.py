"""Column mapping between layers: header names, projections, inferred sources, row-level decodes."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import as_col
from ..session import small_frame
from .skew import numbered, quoted

# Words a target column must not be called.
RESERVED_WORDS = (
    "all", "and", "array", "as", "between", "boolean", "by", "case", "column", "create", "date", "default", "delete",
    "double", "false", "from", "group", "insert", "int", "join", "null", "order", "select", "string", "table",
    "timestamp", "true", "update", "user", "where")

# Where a header is cut into words, and a word of initials that is joined with a single letter behind it.
WORD_BREAK = r"[^0-9A-Za-z]+|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[a-z0-9])(?=[A-Z])"
INITIALS = r"^[a-z]{1,2}$"
VENDOR_SUFFIX = r"(?i)_vod__c$|__c$"
SECRET_PATTERN = r"(?i)(password|passwd|secret|token|api_?key|credential|private_?key)"

# The path columns of the main configuration table and the lake's zones.
PATH_COLUMNS = ("s3_landing_path", "s3_archive_path", "s3_raw_path", "s3_curated_path", "s3_publish_path",
                "s3_reject_path")
ZONES = ("landing", "raw", "curated", "publish")


# ---- header names ---------------------------------------------------------------------------

def snake_name(c, reserved_suffix: str = "_col") -> Column:
    """Target column name of a header: its words in lower case joined by underscores; never empty, a number first or a reserved word.

    Initials before a single letter and more words are one word: ``a_b_name`` is ``ab_name``.
    """
    words = F.filter(F.transform(F.split(as_col(c), WORD_BREAK), F.lower), lambda w: w != "")
    first, second = F.try_element_at(words, F.lit(1)), F.try_element_at(words, F.lit(2))
    joined = (F.size(words) > 2) & first.rlike(INITIALS) & second.rlike("^[a-z]$")
    text = F.array_join(F.when(joined, F.concat(F.array(F.concat(first, second)), F.slice(words, 3, F.size(words)))).otherwise(words), "_")
    return (F.when(text == "", "unnamed").when(text.rlike(r"^\d"), F.concat(F.lit("col_"), text))
            .when(text.isin(*RESERVED_WORDS), F.concat(text, F.lit(reserved_suffix))).otherwise(text))


def header_name(c) -> Column:
    """Raw header of a vendor file as a plain snake name: vendor suffix dropped, camel case split."""
    text = F.regexp_replace(as_col(c), VENDOR_SUFFIX, "")
    text = F.lower(F.regexp_replace(text, r"(?<=[a-z0-9])(?=[A-Z])", "_"))
    return F.btrim(F.regexp_replace(text, "__+", "_"), F.lit("_"))


def snake_case_columns(df: DataFrame) -> DataFrame:
    """Rename all columns of a frame; a name given before gets the first of _1, _2, ... that is free, in column order."""
    headers = small_frame(df.sparkSession, list(enumerate(df.columns)), "at int, header string")
    bases = {r["at"]: r["base"] for r in headers.select("at", snake_name("header").alias("base")).collect()}
    names: list[str] = []
    for at in range(len(df.columns)):
        choices = itertools.chain([bases[at]], (f"{bases[at]}_{n}" for n in itertools.count(1)))
        names.append(next(x for x in choices if x not in names))
    return df.toDF(*names)


def snake_case_catalog(columns: DataFrame) -> DataFrame:
    """The same over a catalogue ``(table, col_name, ord)``; adds ``target_column``."""
    named = columns.withColumn("_base", snake_name("col_name"))
    ranked = numbered(named, ["ord", "col_name"], "_n", start=0, within=["table", "_base"])
    suffix = F.when(F.col("_n") > 0, F.concat(F.lit("_"), F.col("_n").cast("string"))).otherwise("")
    return ranked.withColumn("target_column", F.concat("_base", suffix)).drop("_base", "_n")


# ---- projections ----------------------------------------------------------------------------

def _mapped(m: dict) -> Column:
    if "concat" in m:
        c = F.concat_ws(" ", *[quoted(s) for s in m["concat"]])
    elif "constant" in m:
        c = F.lit(m["constant"])
    elif m.get("now"):
        c = F.current_timestamp().cast("string")
    elif m.get("source"):
        c = quoted(m["source"])
    else:
        c = F.lit(None)
    return c.cast(m.get("type", "string")).alias(m["target"])


def apply_mapping(df: DataFrame, mapping: list[dict]) -> DataFrame:
    """raw → curated: ``{target, source | concat | constant | now, type?}`` per target column.

    A target without any of these, or whose source the file does not have, is a typed NULL.
    """
    have = {c.lower() for c in df.columns}

    def usable(m):
        needs = m.get("concat") or ([m["source"]] if m.get("source") else [])
        return m if all(n.lower() in have for n in needs) else {"target": m["target"], "type": m.get("type", "string")}

    return df.select(*[_mapped(usable(m)) for m in mapping])


def publish_projection(df: DataFrame, cols: list[str], batch: str, src_name: str) -> DataFrame:
    """curated → publish for one batch: known columns pass through, ``data_src_nm`` is the source,
    unknown ones (surrogate keys, measures to fill) are NULL text. The batch filter prunes partitions.
    """
    have = {c.lower(): c for c in df.columns}

    def value(name):
        low = name.lower()
        if low in have:
            return quoted(have[low])
        if low == "data_src_nm":
            return F.lit(src_name)
        if low in ("batch_id", "dwh_batch_id"):
            return F.lit(batch)
        if low.startswith("dwh_") and low.endswith("_ts"):
            return F.current_timestamp().cast("string")
        return F.lit(None).cast("string")

    return df.where(F.col("batch_id") == batch).select(*[value(c).alias(c) for c in cols])


def _boundary_prefixes(c: Column) -> Column:
    """All proper prefixes of a snake name that end before an underscore."""
    parts = F.split(c, "_")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
                       lambda n: F.array_join(F.slice(parts, 1, n), "_"))


def infer_mapping(headers: DataFrame, targets: DataFrame) -> DataFrame:
    """Best source for every target column ``(object, target)`` among headers ``(object, header, ord)``.

    Order: object id and name, full name, exact name, audit and flag defaults, name variants, a
    shared prefix, else NULL. Every rule is an equi-join on a derived name (prefixes are spelled out
    at their underscores), so no target meets all headers. Output ``(object, target, rule, source,
    expression)``.
    """
    names = (headers.select("object", header_name("header").alias("name"), "header", "ord")
             .groupBy("object", "name").agg(F.max_by("header", "ord").alias("header"), F.min("ord").alias("ord")))
    wanted = targets.select("object", "target", F.lower("target").alias("low")).distinct()
    low, obj = F.col("low"), F.lower("object")
    base = F.regexp_replace(low, "_id$", "")

    def named(rank, rule, name, cond=None):
        pick = F.struct(F.lit(rank).alias("rank"), F.lit(rule).alias("rule"), name.alias("name"))
        return pick if cond is None else F.when(cond, pick)

    looked = F.array_compact(F.array(
        named(1, "object_key", F.lit("id"), low == F.concat(obj, F.lit("_id"))),
        named(2, "object_name", F.lit("name"), low == F.concat(obj, F.lit("_name"))),
        named(4, "exact", low),
        named(6, "variant", base), named(7, "variant", F.regexp_replace(base, "s+$", "")),
        named(8, "variant", F.concat(base, F.lit("2")))))
    by_name = (wanted.select("object", "target", F.inline(looked)).join(names, ["object", "name"])
               .select("object", "target", "rank", "rule", "header", "ord"))

    full = wanted.where(low == "full_name").select("object", "target")
    first = names.where("name = 'first_name'").select("object", F.col("header").alias("f"))
    last = names.where("name = 'last_name'").select("object", F.col("header").alias("l"))
    by_full = full.join(first, "object").join(last, "object").select(
        "object", "target", F.lit(3).alias("rank"), F.lit("full_name").alias("rule"),
        F.concat_ws("|", "f", "l").alias("header"), F.lit(0).alias("ord"))

    default = (F.when(low == "_source_file", "'{file_name}'")
               .when(low.isin("_batch_id", "dwh_batch_id"), "'{batch_id}'")
               .when(low.isin("_load_ts", "dwh_silver_ts"), "cast(current_timestamp() as string)")
               .when(low.startswith("dq_"), "'N'"))
    by_default = wanted.where(default.isNotNull()).select(
        "object", "target", F.lit(5).alias("rank"), F.lit("default").alias("rule"), default.alias("header"),
        F.lit(0).alias("ord"))

    longer = names.select("object", F.explode(_boundary_prefixes(F.col("name"))).alias("low"), "name", "header", "ord"
                          ).where("low <> name").groupBy("object", "low").agg(F.min(F.struct("ord", "header")).alias("h")
                                                                             ).select("object", "low", "h.header", "h.ord")
    shorter = wanted.select("object", "target", "low", F.explode(_boundary_prefixes(low)).alias("name")).where("low <> name")
    by_prefix = (wanted.join(longer, ["object", "low"]).select("object", "target", "header", "ord")
                 .unionByName(shorter.join(names, ["object", "name"]).select("object", "target", "header", "ord"))
                 .select("object", "target", F.lit(9).alias("rank"), F.lit("prefix").alias("rule"), "header", "ord"))

    nothing = wanted.select("object", "target", F.lit(10).alias("rank"), F.lit("none").alias("rule"),
                            F.lit(None).cast("string").alias("header"), F.lit(0).alias("ord"))
    found = by_name.unionByName(by_full).unionByName(by_default).unionByName(by_prefix).unionByName(nothing)
    best = found.groupBy("object", "target").agg(F.min(F.struct("rank", "ord", "rule", "header")).alias("b"))
    rule, header = F.col("b.rule"), F.col("b.header")
    tick = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    expression = (F.when(rule == "none", "cast(null as string)").when(rule == "default", header)
                  .when(rule == "full_name", F.concat(F.lit("concat_ws(' ', "), F.array_join(
                      F.transform(F.split(header, r"\|"), tick), ", "), F.lit(")")))
                  .otherwise(tick(header)))
    source = F.when(rule.isin("none", "default"), F.lit(None)).otherwise(header)
    return best.select("object", "target", rule.alias("rule"), source.alias("source"), expression.alias("expression"))


# ---- row rules ------------------------------------------------------------------------------

def category_decode(c, categories: dict[str, list[str]], default: str) -> Column:
    """Label whose (upper-case) values contain the text, else the default."""
    text, out = F.upper(as_col(c)), None
    for label, values in categories.items():
        hit = text.isin(*values)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


# Owner roles and the function area of each.
FUNCTION_AREAS = {"Medical Affairs": ["MSL", "MEDICAL", "MEDICAL AFFAIRS"],
                  "Field Sales": ["REP", "SALES", "FIELD", "FIELD SALES"]}


def function_area(c) -> Column:
    return category_decode(c, FUNCTION_AREAS, "Other")


def mask_secret_columns(df: DataFrame, pattern: str = SECRET_PATTERN) -> DataFrame:
    """Replace the filled values of columns whose name looks secret; NULL and '' stay."""
    def shown(name):
        c = quoted(name)
        if not re.search(pattern, name):
            return c
        return F.when(c.isNotNull() & (c.cast("string") != ""), "***").otherwise(c.cast("string")).alias(name)
    return df.select(*[shown(c) for c in df.columns])


def clean_number(c) -> Column:
    """The text without grouping commas, currency signs and blanks if that is a number, else NULL."""
    text = F.regexp_replace(as_col(c), r"[,$\s]", "")
    return F.when(text.rlike(r"^-?\d+(\.\d+)?$"), text)


def promote_numeric_strings(df: DataFrame, cols: list[str]) -> DataFrame:
    """Clean number text in place (other text stays) and add ``<col>_number`` as DOUBLE."""
    return df.withColumns({
        **{c: F.coalesce(clean_number(quoted(c)), quoted(c)) for c in cols},
        **{f"{c}_number": clean_number(quoted(c)).try_cast("double") for c in cols}})


def repoint_paths(df: DataFrame, cols: list[str], old: str, new: str) -> DataFrame:
    """Swap a leading path prefix in each column; other values stay."""
    def moved(c):
        return F.when(quoted(c).startswith(old), F.concat(F.lit(new), F.substr(quoted(c), F.lit(len(old) + 1)))
                      ).otherwise(quoted(c))
    return df.withColumns({c: moved(c) for c in cols})


def repoint_counts(df: DataFrame, cols: list[str], old: str) -> DataFrame:
    """How many values of each column the swap touches."""
    row = df.agg(*[F.count_if(quoted(c).startswith(old)).alias(c) for c in cols])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("updated")) for c in cols])))


def path_zone_report(df: DataFrame, keep: list[str], zones=ZONES) -> DataFrame:
    """Per active config row and zone: is the bucket a placeholder, does the path name its zone?"""
    lines = F.array(*[F.struct(F.lit(z).alias("zone"), F.coalesce(quoted(f"s3_{z}_path"), F.lit("")).alias("template"))
                      for z in zones])
    return (df.where(F.upper("active_flag") == "A").select(*keep, F.inline(lines))
            .withColumn("has_bucket_placeholder", F.contains("template", F.lit("{bucket_name}")))
            .withColumn("mentions_zone", F.regexp("template", F.concat(F.lit(r"\b"), F.col("zone")))))


def replace_nan_nulls(df: DataFrame) -> DataFrame:
    """NaN numbers and empty or 'nan' text become NULL, so null counts agree between engines."""
    def clean(f):
        c = quoted(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            return F.when(~F.isnan(c), c).alias(f.name)
        if isinstance(f.dataType, T.StringType):
            return F.when(~F.lower(F.trim(c)).isin("", "nan"), c).alias(f.name)
        return c
    return df.select(*[clean(f) for f in df.schema.fields])


def flag_columns(df: DataFrame, parent: DataFrame, on, name: str) -> DataFrame:
    """Add a Y/N column: Y where the key is set and the parent has no such row."""
    pairs = [(k, k) if isinstance(k, str) else tuple(k) for k in on]
    known = parent.select(*[quoted(p).alias(f"_k{i}") for i, (_, p) in enumerate(pairs)]).distinct().withColumn("_hit", F.lit(True))
    cond = [quoted(c) == F.col(f"_k{i}") for i, (c, _) in enumerate(pairs)]
    is_set = F.lit(True)
    for c, _ in pairs:
        is_set = is_set & quoted(c).isNotNull()
    flag = F.when(is_set & F.col("_hit").isNull(), "Y").otherwise("N")
    return df.join(known, cond, "left").select(*[quoted(c) for c in df.columns], flag.alias(name))
