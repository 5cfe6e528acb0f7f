"""Fingerprints from stored partial states: a changed partition is read again, all others are remembered.

A state is what a partition adds to the fingerprint of its table: counts, extremes, sums and a mergeable sketch of the distinct
values of each column. States of partitions add up to the state of the table, so the fingerprint of a table of any
size costs one read of the partitions that changed and one small aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .profile import TABLE, _number, is_numeric
from .skew import orderable, quoted

#: Size of a sketch (its registers are a power of two) and the relative standard error it has after merging.
SKETCH = 12


def sketch_error(size: int = SKETCH) -> float:
    """The relative standard error of a distinct count from merged sketches; three times it is rarely passed."""
    return 1.04 / (2 ** size) ** 0.5


def _sketched(c: Column, dtype: T.DataType) -> Column:
    """A whole number for each value: itself, or its 64-bit digest (a sketch leaves empty text out)."""
    if isinstance(dtype, (T.IntegerType, T.LongType)):
        return c
    if isinstance(dtype, (T.ByteType, T.ShortType)):
        return c.cast("int")
    return F.when(c.isNotNull(), F.xxhash64(F.to_json(c) if isinstance(dtype, (T.MapType, T.VariantType)) else c))


def partition_states(df: DataFrame, by: list[str], cols: list[str] | None = None, scale: int | None = None, size: int = SKETCH) -> DataFrame:
    """The columns ``by``, ``rows`` and, for each other column, a struct of its counts, extremes, sums and sketch.

    One aggregate; the rows of a large partition are reduced in the tasks that read them. Sums are decimals as in ``column_fingerprint``; a
    sum of squares is kept exactly and as a floating-point number, for the case that the exact one leaves its range.
    """
    skip = {b.lower() for b in by}
    names = [c for c in (cols or df.columns) if c.lower() not in skip]
    types = {f.name: f.dataType for f in df.schema.fields}
    out = [F.count(F.lit(1)).alias("rows")]
    for c in names:
        v, kind = quoted(c), types[c]
        fields = [F.count(v).alias("nonnull"), F.hll_sketch_agg(_sketched(v, kind), F.lit(size)).alias("sketch")]
        if orderable(kind):
            shown = v.cast(T.DecimalType(18, scale)) if scale is not None and isinstance(kind, (T.FloatType, T.DoubleType)) else v
            fields += [F.min(shown).alias("min"), F.max(shown).alias("max")]
        if is_numeric(kind):
            n = _number(v, kind, scale)
            square, wide = F.try_multiply(n, n), n.cast("double")
            fields += [F.sum(n).alias("sum"), F.when(F.count(square) == F.count(n), F.try_sum(square)).alias("squares"), F.sum(wide * wide).alias("wide")]
        out.append(F.struct(*fields).alias(c))
    return df.groupBy(*[quoted(b) for b in by]).agg(*out)


def merged_fingerprint(states: DataFrame, cols: list[str]) -> DataFrame:
    """``(column, metric, value)`` as ``column_fingerprint`` gives it, from the states of any set of partitions.

    ``distinct`` is an estimate with the error of ``sketch_error``; every other metric is what reading all rows would give.
    """
    whole, parts = [F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")], {}
    for i, c in enumerate(cols):
        s, have = quoted(c), states.schema[c].dataType.fieldNames()
        held = {"nonnull": F.coalesce(F.sum(s["nonnull"]), F.lit(0)), "distinct": F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(s["sketch"])), F.lit(0))}
        if "min" in have:
            held |= {"min": F.min(s["min"]), "max": F.max(s["max"])}
        if "sum" in have:
            exact = F.when(F.count_if((s["nonnull"] > 0) & s["squares"].isNull()) == 0, F.try_sum(s["squares"]))
            held |= {"sum": F.sum(s["sum"]), "sumsq": F.coalesce(exact.cast("string"), F.sum(s["wide"]).cast("string"))}
        parts[c] = {m: f"m{i}_{m}" for m in held}
        whole += [v.alias(parts[c][m]) for m, v in held.items()]
    row = states.agg(*whole)
    out = [F.struct(F.lit(TABLE).alias("column"), F.lit("row_count").alias("metric"), F.col("rows").cast("string").alias("value"))]
    for c, metrics in parts.items():
        shown = {m: F.col(a).cast("string") for m, a in metrics.items()} | {"nulls": (F.col("rows") - F.col(metrics["nonnull"])).cast("string")}
        out += [F.struct(F.lit(c).alias("column"), F.lit(m).alias("metric"), v.alias("value")) for m, v in shown.items()]
    return row.select(F.inline(F.array(*out)))


# ---- states kept beside a table -------------------------------------------------------------

def partition_signatures(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """``by`` (as text), ``files`` and ``signature`` of every partition folder: names, sizes and times, contents are not read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
             .select("path", "length", F.unix_micros("modificationTime").alias("at")))
    values = [F.url_decode(F.replace(F.regexp_extract("path", f"/{_pattern(b)}=([^/]*)/", 1), F.lit("+"), F.lit("%2B"))).alias(b) for b in by]
    digest = F.xxhash64(F.element_at(F.split("path", "/"), -1), "length", "at")
    return (files.select(*values, digest.alias("h")).groupBy(*[quoted(b) for b in by])
            .agg(F.count(F.lit(1)).alias("files"), F.bit_xor("h").alias("signature")))


def _pattern(name: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else f"\\{c}" for c in name)


def _newest(spark: SparkSession, folder: str) -> int:
    """The greatest version that was written to its end; -1 where there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    top = path(folder)
    files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(top):
        return -1
    names = [f.getPath().getName() for f in files.listStatus(top)]
    return max((int(n[2:]) for n in names if n.startswith("v=") and files.exists(path(f"{folder}/{n}/_SUCCESS"))), default=-1)


def refresh_states(spark: SparkSession, path: str, by: list[str], states: str, cols: list[str] | None = None, scale: int | None = None,
                   size: int = SKETCH) -> tuple[DataFrame, int]:
    """Bring the states of a partitioned Parquet folder up to date; the states, and how many partitions were read.

    Partitions whose files are the same keep their state, changed and new ones are read, removed ones are forgotten. The result
    is a new version below ``states``, valid when complete, so a run that dies leaves the last one; running it again reads the same.
    The number of partitions, not of rows, bounds what the driver sees. A change of ``cols``, ``scale`` or ``size`` needs another folder.
    """
    now = cut_lineage(partition_signatures(spark, path, by))
    version = _newest(spark, states)
    known = spark.read.parquet(f"{states}/v={version}") if version >= 0 else None
    same = [now[b].eqNullSafe(known[f"_key_{i}"]) for i, b in enumerate(by)] + [now["signature"] == known["_signature"]] if known is not None else []
    changed = now if known is None else now.join(known, same, "left_anti")
    todo = [tuple(r) for r in changed.select(*by).collect()]
    table = spark.read.parquet(path)
    text = [quoted(b).cast("string") for b in by]
    null = F.lit("__HIVE_DEFAULT_PARTITION__")
    part = table
    for i, b in enumerate(by):  # values of one column prune the folders, their combinations are joined
        part = part.where(F.coalesce(text[i], null).isin(sorted({t[i] for t in todo})))
    keys = changed.select(*[quoted(b).alias(f"_key_{i}") for i, b in enumerate(by)], F.col("signature").alias("_signature"))
    fresh = partition_states(part, by, cols, scale, size)
    placed = fresh.join(keys, [F.coalesce(quoted(b).cast("string"), null).eqNullSafe(F.col(f"_key_{i}")) for i, b in enumerate(by)])
    if known is not None:
        placed = known.join(now, same, "left_semi").unionByName(placed.select(*known.columns))
    if known is None or todo or known.count() != now.count():
        version += 1
        placed.write.mode("overwrite").parquet(f"{states}/v={version}")
    return spark.read.parquet(f"{states}/v={version}"), len(todo)
