"""Suggested target types from names and data, and validation of reviewed mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.mapping import snake_case_catalog, snake_name
from ..operators.skew import orderable, quoted
from ..session import small_frame
from ..sources.files import LOAD_TYPES

# Words in a column name that hint at its category or number type.
FLAG_WORDS = "flag|is_|has_|active|enabled|indicator"
KEY_WORDS = "id|key|code"
COUNT_WORDS = "units|count|qty|quantity"
MONEY_WORDS = "amount|sales|price|cost|value|revenue|margin|difference|ops"
REVIEW_STATUSES = ("AUTO_APPROVED", "NEEDS_REVIEW", "MANUALLY_APPROVED")


def field_category(name: Column, kind: Column) -> Column:
    """date, key, text, flag, numeric or unknown by name and by kind of data; first match wins."""
    low = F.lower(name)
    return (F.when((kind == "date") | low.rlike("date|timestamp"), "DATE_LIKE").when(low.rlike(KEY_WORDS), "KEY_LIKE")
            .when(kind == "text", "TEXT_LIKE").when(low.rlike(FLAG_WORDS), "FLAG_LIKE")
            .when(kind == "numeric", "NUMERIC_LIKE").otherwise("UNKNOWN"))


def suggest_types_catalog(columns: DataFrame) -> DataFrame:
    """Target column, type, rule and confidence for ``columns(table, col_name, ord, kind, decimals, symbols)``.

    ``kind`` is date, text, numeric or NULL; ``decimals`` the most decimal places and ``symbols`` the
    number of distinct values where known. Below 0.80 a suggestion needs review.
    """
    low, cat = F.lower("col_name"), F.col("category")
    few = low.rlike(FLAG_WORDS) & F.coalesce(F.col("symbols") <= 2, F.lit(True))
    whole = low.rlike(COUNT_WORDS) | F.coalesce(F.col("decimals") == 0, F.lit(False))

    def pick(kind, rule, confidence):
        return F.struct(F.lit(kind).alias("target_type"), F.lit(rule).alias("rule"), F.lit(confidence).alias("confidence"))

    choice = (F.when(cat == "DATE_LIKE", pick("DATE", "serial_to_date", 0.90))
              .when(cat.isin("TEXT_LIKE", "KEY_LIKE"), pick("STRING", "cast_string", 0.90))
              .when((cat == "FLAG_LIKE") & few, pick("BOOLEAN", "flag_to_boolean_or_int_review", 0.90))
              .when(cat == "FLAG_LIKE", pick("INT", "flag_to_boolean_or_int_review", 0.50))
              .when((cat == "NUMERIC_LIKE") & whole, pick("BIGINT", "cast_bigint", 0.90))
              .when((cat == "NUMERIC_LIKE") & low.rlike(MONEY_WORDS), pick("DECIMAL(18,2)", "cast_decimal_18_2", 0.90))
              .when(cat == "NUMERIC_LIKE", pick("DOUBLE", "cast_double", 0.70))
              .otherwise(pick("STRING", "no_rule_review", 0.50)))
    named = columns.withColumn("category", field_category(F.col("col_name"), F.col("kind"))).withColumn("_c", choice)
    status = F.when(F.col("_c.confidence") >= 0.80, "AUTO_APPROVED").otherwise("NEEDS_REVIEW")
    return snake_case_catalog(named).select(
        "table", "col_name", "ord", "category", snake_name("table", "_table").alias("target_table"), "target_column",
        "_c.target_type", "_c.rule", "_c.confidence", status.alias("review_status"))


def profile_columns(df: DataFrame, table: str) -> DataFrame:
    """Kind, decimals and distinct values of every column, measured in one pass over the data.

    Text counts as numeric or date if every filled value converts. Distinct values are counted only
    as far as a flag needs: none, one, two or more.
    """
    aggs, plan = [], []
    for i, f in enumerate(df.schema.fields):
        c = quoted(f.name)
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            kind, decimals = F.lit("date"), F.lit(None)
        elif isinstance(f.dataType, T.NumericType):
            kind = F.lit("numeric")
            decimals = F.when(F.bool_and(c.cast("double") == F.floor(c.cast("double"))), 0).otherwise(2)
        elif isinstance(f.dataType, T.StringType):
            filled = F.count(F.nullif(F.trim(c), F.lit("")))
            number = F.count(F.trim(c).try_cast("double"))
            date = F.count_if(F.trim(c).rlike(r"^\d{4}-\d{2}-\d{2}") & F.trim(c).try_cast("timestamp").isNotNull())
            kind = F.when(filled == 0, F.lit(None)).when(number == filled, "numeric").when(date == filled, "date").otherwise("text")
            decimals = F.when(F.count_if(F.trim(c).rlike(r"\.\d*[1-9]")) > 0, 2).otherwise(0)
        else:
            kind, decimals = F.lit("text"), F.lit(None)
        aggs += [kind.cast("string").alias(f"k{i}"), decimals.cast("int").alias(f"d{i}")]
        if orderable(f.dataType):
            aggs += [F.min(c).cast("string").alias(f"lo{i}"), F.max(c).cast("string").alias(f"hi{i}")]
        plan.append((f.name, i, orderable(f.dataType)))
    row = df.agg(*aggs)
    lines = [F.struct(F.lit(table).alias("table"), F.lit(n).alias("col_name"), F.lit(i).alias("ord"), F.col(f"k{i}").alias("kind"),
                      F.col(f"d{i}").alias("decimals"),
                      (F.col(f"lo{i}") if ok else F.lit(None).cast("string")).alias("lo"),
                      (F.col(f"hi{i}") if ok else F.lit(None).cast("string")).alias("hi")) for n, i, ok in plan]
    return row.select(F.inline(F.array(*lines)))


def suggest_types(df: DataFrame, table: str) -> DataFrame:
    """Suggested mapping of a table from its names and its data.

    A second pass, only over flag-named columns, counts values that are neither the smallest nor the
    largest one: none means at most two distinct values, without a distinct count.
    """
    profile = profile_columns(df, table).collect()  # one row per column
    flags = [r for r in profile if r["lo"] is not None and any(w in r["col_name"].lower() for w in FLAG_WORDS.split("|"))]
    between = {}
    if flags:
        counts = df.agg(*[F.count_if(~quoted(r["col_name"]).cast("string").isin(r["lo"], r["hi"])).alias(f"n{i}")
                          for i, r in enumerate(flags)]).first()
        between = {r["col_name"]: (2 if counts[i] == 0 else 3) for i, r in enumerate(flags)}
    rows = [(r["table"], r["col_name"], r["ord"], r["kind"], r["decimals"], between.get(r["col_name"])) for r in profile]
    return suggest_types_catalog(small_frame(
        df.sparkSession, rows, "table string, col_name string, ord int, kind string, decimals int, symbols int"))


def validate_mapping(mapping: DataFrame) -> DataFrame:
    """Errors of mapping rows ``(row, target_table, target_column, target_type, review_status)``:
    ``(row, field, error)``. A repeated target column is an error in every row but the first."""
    table, column = F.trim(F.coalesce("target_table", F.lit(""))), F.trim(F.coalesce("target_column", F.lit("")))
    kind, status = F.upper(F.trim(F.coalesce("target_type", F.lit("")))), F.upper(F.trim(F.coalesce("review_status", F.lit(""))))
    first = (mapping.where((table != "") & (column != "")).groupBy(F.lower(table).alias("_t"), F.lower(column).alias("_c"))
             .agg(F.min("row").alias("_first")))
    joined = mapping.join(first, (F.lower(table) == F.col("_t")) & (F.lower(column) == F.col("_c")), "left")

    def error(cond, field, text):
        return F.when(cond, F.struct(F.lit(field).alias("field"), F.lit(text).alias("error")))

    found = F.array_compact(F.array(
        error(table == "", "target_table", "empty"), error(column == "", "target_column", "empty"),
        error(~kind.isin(*LOAD_TYPES), "target_type", "unsupported"),
        error(~status.isin(*REVIEW_STATUSES), "review_status", "unsupported"),
        error(status == "NEEDS_REVIEW", "review_status", "not reviewed"),
        error(F.col("_first").isNotNull() & (F.col("row") > F.col("_first")), "target_column", "duplicate")))
    return joined.select("row", F.inline(found))
