"""Counts, key integrity and per-column fingerprints of a table, and their comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import FALSE_SPELLINGS, TRUE_SPELLINGS, as_col
from ..functions.types import is_numeric, numeric_type_text
from ..session import small_frame
from .skew import orderable, quoted

METRICS = ("nonnull", "nulls", "distinct", "min", "max", "sum", "sumsq")
TABLE = "*"  # the column name under which table-level metrics are listed


def row_count(src: DataFrame, cand: DataFrame, tol: float = 0.0) -> DataFrame:
    """One row: both counts, their difference, and whether it is within the fractional tolerance."""
    sides = (src.agg(F.count(F.lit(1)).alias("source"), F.lit(0).cast("long").alias("candidate"))
             .unionByName(cand.agg(F.lit(0).cast("long").alias("source"), F.count(F.lit(1)).alias("candidate"))))
    both = sides.agg(F.sum("source").alias("source"), F.sum("candidate").alias("candidate"))
    delta = F.col("candidate") - F.col("source")
    return both.select("source", "candidate", delta.alias("delta"),
                       (F.abs(delta) <= F.lit(tol) * F.greatest(F.lit(1), "source")).alias("match"))


def duplicate_groups(df: DataFrame, key: list[str]) -> DataFrame:
    """The key groups that occur more than once, with their size. NULL keys form a group."""
    return (df.groupBy(*[quoted(k) for k in key]).agg(F.count(F.lit(1)).alias("copies"))
            .where(F.col("copies") > 1))


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return duplicate_groups(df, key).agg(F.count(F.lit(1)).alias("duplicate_keys"))


def any_null(key: list[str]) -> Column:
    cond = quoted(key[0]).isNull()
    for k in key[1:]:
        cond = cond | quoted(k).isNull()
    return cond


def null_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.agg(F.count_if(any_null(key)).alias("null_keys"))


def _text(c: Column) -> Column:
    return c.cast("string")


def _number(c: Column, dtype: T.DataType, scale: int | None) -> Column:
    """A form of the number whose sum and sum of squares neither overflow nor depend on row order."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return c.cast("double") if scale is None else c.cast(T.DecimalType(18, scale))
    if isinstance(dtype, T.DecimalType):
        return c if dtype.precision <= 18 else c.cast("double")
    return c.cast(T.DecimalType(19, 0))


def _sum_of_squares(n: Column) -> Column:
    """Exact as long as decimals hold it; in floating point where a square or the sum leaves their range."""
    square = F.try_multiply(n, n)
    exact = F.when(F.count(square) == F.count(n), F.try_sum(square))
    wide = n.cast("double")
    return F.coalesce(_text(exact), _text(F.sum(wide * wide)))


def _measure_row(df: DataFrame, cols: list[str], key: list[str], approx: float | None,
                 scale: int | None) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """All metrics but the exact distinct counts, in one pass and one row."""
    types = {f.name: f.dataType for f in df.schema.fields}
    aggs, plan = [], []

    def add(column, metric, value):
        plan.append((column, metric, f"m{len(plan)}"))
        aggs.append(_text(value).alias(plan[-1][2]))

    add(TABLE, "row_count", F.count(F.lit(1)))
    if key:
        add(TABLE, "null_keys", F.count_if(any_null(key)))
    for name in cols:
        c, dtype = quoted(name), types[name]
        add(name, "nonnull", F.count(c))
        add(name, "nulls", F.count_if(c.isNull()))
        if approx is not None:
            add(name, "distinct", F.approx_count_distinct(c, approx))
        if orderable(dtype):
            shown = (c.cast(T.DecimalType(18, scale)) if scale is not None and isinstance(
                dtype, (T.FloatType, T.DoubleType)) else c)
            add(name, "min", F.min(shown))
            add(name, "max", F.max(shown))
        if is_numeric(dtype):
            n = _number(c, dtype, scale)
            add(name, "sum", F.sum(n))
            add(name, "sumsq", _sum_of_squares(n))
    return df.agg(*aggs), plan


def _long(row: DataFrame, plan) -> DataFrame:
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(m).alias("metric"), F.col(a).alias("value")) for c, m, a in plan])))


def distinct_counts(df: DataFrame, cols: list[str], key: list[str] = (), slices: int = 1, short: bool = False) -> DataFrame:
    """Exact distinct count ``n`` of many columns, and how many values are ``repeated``, in one shuffle of digests.

    ``count(DISTINCT a), count(DISTINCT b), ...`` makes Spark shuffle one row as wide as all the
    columns per column and input row. Here a row becomes one ``(column number, digest)`` pair per
    column, reduced on the map side. Values of up to 64 bits map one-to-one to their 64-bit hash;
    wider values (text, decimals, nested) use two independent 64-bit hashes. The whole ``key`` (with
    NULLs told apart) counts as one more column, listed as ``*``. ``slices`` of more than one count only the values
    of one slice of that many by digest: a value repeated there is repeated, and only a slice is shuffled. ``short`` leaves
    out the second hash of wide values: where then nothing is repeated, no value is, and else some may only seem to be.
    """
    narrow = (T.IntegralType, T.FloatType, T.DoubleType, T.DateType, T.TimestampType, T.TimestampNTZType,
              T.BooleanType)
    digests, names = [], []

    def shown(name: str) -> Column:
        c = quoted(name)
        return F.to_json(c) if isinstance(df.schema[name].dataType, (T.MapType, T.VariantType)) else c

    for i, name in enumerate(cols):
        c = shown(name)
        second = F.lit(0).cast("long") if short or isinstance(df.schema[name].dataType, narrow) else F.xxhash64(F.lit("second"), c)
        digests += [F.when(c.isNotNull(), F.xxhash64(c)).alias(f"h{i}"), second.alias(f"g{i}")]
    if key:
        parts = [x for k in key for x in (shown(k), quoted(k).isNull())]
        digests += [F.xxhash64(*parts).alias(f"h{len(cols)}"), F.xxhash64(F.lit("second"), *parts).alias(f"g{len(cols)}")]
    labels = [*cols, *([TABLE] if key else [])]
    names = [f"(h{i}, g{i}) as `{i}`" for i in range(len(labels))]
    pairs = df.sparkSession.sql(f"select i, h, g from {{digests}} unpivot ((h, g) for i in ({', '.join(names)}))",
                                digests=df.select(*digests))
    kept = pairs.where("h is not null") if slices == 1 else pairs.where(F.pmod("h", F.lit(slices)) == 0)
    return (kept.groupBy("i", "h", "g").agg(F.count(F.lit(1)).alias("copies"))
            .groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("copies") > 1).alias("repeated"))
            .select(F.element_at(F.array(*[F.lit(c) for c in labels]), F.col("i").cast("int") + 1).alias("column"), "n", "repeated"))


def column_fingerprint(df: DataFrame, cols: list[str] | None = None, approx: float | None = None,
                       scale: int | None = None, key: list[str] = ()) -> DataFrame:
    """Long table ``(column, metric, value)`` of what two copies of a table must agree on.

    ``approx`` replaces exact distinct counts by sketches with that relative deviation (one pass,
    no shuffle of values). ``scale`` sums floating-point columns as decimals of that scale, which
    makes the sums independent of row order. Table metrics are listed under column ``*``; with a ``key``
    they include its NULLs and duplicates. The table is read twice: for the aggregates and for the digests.
    """
    cols = list(cols) if cols is not None else df.columns
    row, plan = _measure_row(df, cols, list(key), approx, scale)
    out = _long(row, plan)
    labels = [*(cols if approx is None else ()), *([TABLE] if key else [])]
    if labels:
        zero = small_frame(df.sparkSession, [(c, 0, 0) for c in labels], "column string, n long, repeated long")
        counts = (distinct_counts(df, labels[:-1] if key else labels, list(key)).unionByName(zero)
                  .groupBy("column").agg(F.sum("n").alias("n"), F.sum("repeated").alias("repeated")))
        is_key = F.col("column") == TABLE
        out = out.unionByName(counts.select("column", F.when(is_key, "duplicate_keys").otherwise("distinct").alias("metric"),
                                            _text(F.when(is_key, F.col("repeated")).otherwise(F.col("n"))).alias("value")))
    return out


def _boolean_of(c: Column) -> Column:
    text = F.lower(F.trim(c))
    return F.when(text.isin(*TRUE_SPELLINGS), True).when(text.isin(*FALSE_SPELLINGS), False)


def values_equal(a, b, tol) -> Column:
    """NULL equals NULL; numbers within a relative tolerance; booleans by meaning; else trimmed text."""
    a, b = as_col(a).cast("string"), as_col(b).cast("string")
    tol = tol if isinstance(tol, Column) else F.lit(float(tol))
    na, nb = a.try_cast("double"), b.try_cast("double")
    near = F.abs(na - nb) <= tol * F.greatest(F.lit(1.0), F.abs(na), F.abs(nb))
    ba, bb = _boolean_of(a), _boolean_of(b)
    return (F.when(a.isNull() & b.isNull(), True)
            .when(a.isNull() | b.isNull(), False)
            .when(na.isNotNull() & nb.isNotNull(), near | (na == nb))
            .when(ba.isNotNull() & bb.isNotNull(), ba == bb)
            .otherwise(F.trim(a) == F.trim(b)))


def tolerance_of(column: Column, tol: float, col_tol: dict[str, float] | None) -> Column:
    out = F.lit(float(tol))
    for name, t in (col_tol or {}).items():
        out = F.when(F.lower(column) == name.lower(), F.lit(float(t))).otherwise(out)
    return out


def fingerprint_diff(source: DataFrame, candidate: DataFrame, tol: float = 1e-6,
                     col_tol: dict[str, float] | None = None) -> DataFrame:
    """Compare two fingerprints metric by metric; columns are matched without regard to case."""
    s = source.select(F.lower("column").alias("column"), "metric", F.col("value").alias("source"))
    c = candidate.select(F.lower("column").alias("column"), "metric", F.col("value").alias("candidate"))
    return (s.join(c, ["column", "metric"], "full_outer")
            .withColumn("match", values_equal("source", "candidate", tolerance_of(F.col("column"), tol, col_tol))))


def column_catalog(df: DataFrame, table: str = "") -> DataFrame:
    """The columns of a frame as rows ``(table, col_name, col_type, ord)``."""
    rows = [(table, f.name, f.dataType.simpleString(), i) for i, f in enumerate(df.schema.fields)]
    return small_frame(df.sparkSession, rows, "table string, col_name string, col_type string, ord int")


def _catalog_pair(src_columns: DataFrame, cand_columns: DataFrame) -> DataFrame:
    def side(cols, name):
        return cols.groupBy("table", F.lower("col_name").alias("column")).agg(F.max("col_type").alias(name))
    return side(src_columns, "source").join(side(cand_columns, "candidate"), ["table", "column"], "full_outer")


def schema_parity(src_columns: DataFrame, cand_columns: DataFrame) -> DataFrame:
    """Columns that only one side has, over column catalogues ``(table, col_name, col_type)``."""
    side = (F.when(F.col("candidate").isNull(), "only_in_source")
            .when(F.col("source").isNull(), "only_in_candidate"))
    return _catalog_pair(src_columns, cand_columns).withColumn("side", side).where("side is not null").select(
        "table", "column", "side")


def type_drift(src_columns: DataFrame, cand_columns: DataFrame) -> DataFrame:
    """Shared columns whose type text changed: number against non-number fails, the rest is advisory."""
    drift = numeric_type_text("source") != numeric_type_text("candidate")
    respelled = F.upper(F.trim("source")) != F.upper(F.trim("candidate"))
    finding = F.when(drift, "numeric_drift").when(respelled, "translated")
    return (_catalog_pair(src_columns, cand_columns).where("source is not null and candidate is not null")
            .withColumn("finding", finding).where("finding is not null")
            .select("table", "column", "source", "candidate", "finding"))


def column_set_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Names in a only, in b only, and in both (case-insensitive), one row per name."""
    def names(df, tag):
        return df.select(F.lower(df.columns[0]).alias("name"), F.lit(tag).alias("tag"))
    seen = names(a, 1).unionByName(names(b, 2)).groupBy("name").agg(F.bit_or("tag").alias("tag"))
    return seen.select("name", F.element_at(F.array(F.lit("only_a"), F.lit("only_b"), F.lit("both")),
                                            F.col("tag")).alias("side"))
