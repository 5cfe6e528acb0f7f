"""Landed text files whose columns change: a versioned schema log, one merged schema, and a column for what does not fit.

A feed's columns are kept in a log of small JSON files. A batch first adds the columns it is the first to bring, then
every line is read with the merged schema. A logged column never changes its type: a cell that is no value
of it, a column the log does not take and a line that cannot be parsed are kept as text in ``_rescued_data``.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import once

RESCUED = "_rescued_data"
MODES = ("add", "rescue", "fail")
#: Types a new column can be found to have, narrowest first; text is what remains.
NARROW = ("bigint", "double", "boolean", "date", "timestamp")
CELL = "array<struct<column: string, value: string>>"


class SchemaLog:
    """The versions of a feed's schema below one folder; the greatest number is the current one.

    A version is written under another name and renamed, which fails where the name is taken: of two
    writers one wins, and the other reads its version and merges again.
    """

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.folder = self._path(path)
        self._fs = self.folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._utils = jvm.org.apache.hadoop.io.IOUtils

    def numbers(self) -> list[int]:
        if not self._fs.exists(self.folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self.folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int) -> T.StructType:
        stream = self._fs.open(self._path(self.folder, f"{number}.json"))
        try:
            return T.StructType.fromJson(json.loads(bytes(stream.readAllBytes()).decode()))
        finally:
            stream.close()

    def current(self) -> tuple[int, T.StructType]:
        """The newest version and its schema; -1 and no column where the feed has none yet."""
        known = self.numbers()
        return (known[-1], self.read(known[-1])) if known else (-1, T.StructType())

    def add(self, columns: dict[str, str]) -> T.StructType:
        """A version with the columns (name to type) that the current one lacks, by names without regard to case.

        Types are those that a text can be cast to; a nested value is kept as its JSON text.
        """
        nested = [n for n, t in columns.items() if not isinstance(T._parse_datatype_string(t), T.AtomicType)]
        if nested:
            raise ValueError(f"columns of a nested type: {', '.join(nested)}")
        for _ in range(100):
            number, schema = self.current()
            have = {f.name.lower() for f in schema}
            new = [T.StructField(n, T._parse_datatype_string(t)) for n, t in columns.items() if n.lower() not in have]
            if not new:
                return schema
            merged = T.StructType([*schema, *new])
            if self._write(number + 1, merged):
                return merged
        raise RuntimeError(f"the schema log {self.folder} is written by too many at once")

    def _write(self, number: int, schema: T.StructType) -> bool:
        import uuid

        final, partial = self._path(self.folder, f"{number}.json"), self._path(self.folder, f".{number}-{uuid.uuid4().hex}")
        if self._fs.exists(final):
            return False
        out = self._fs.create(partial, False)
        out.write(bytearray(json.dumps(schema.jsonValue()).encode()))
        out.close()
        try:
            done = self._fs.rename(partial, final)
        except Exception:  # some file systems raise where others return false
            done = False
        if not done:
            self._fs.delete(partial, False)
        return done


# ---- from lines to cells --------------------------------------------------------------------

def text_lines(reader, path: str, glob: str = "*") -> DataFrame:
    """The lines below a folder, by a batch or a stream reader, with their file and whether they are of its first block."""
    found = reader.format("text").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return found.select("value", F.col("_metadata.file_path").alias("_file"), (F.col("_metadata.file_block_start") == 0).alias("_first"))


def _json_cells(lines: DataFrame) -> DataFrame:
    cells = F.try_variant_get(F.try_parse_json("value"), "$", "map<string, variant>")

    def text(v: Column) -> Column:
        return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))

    entries = F.filter(F.map_entries(cells), lambda e: e["value"].isNotNull() & ~F.is_variant_null(e["value"]))
    named = F.transform(entries, lambda e: F.struct(e["key"].alias("column"), text(e["value"]).alias("value")))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("column"), F.col("value")))
    return lines.where(F.length(F.trim("value")) > 0).select(
        "_file", F.coalesce(named, F.array().cast(CELL)).alias("cells"), F.when(cells.isNull(), whole).otherwise(F.array().cast(CELL)).alias("broken"))


def _csv_cells(lines: DataFrame, separator: str) -> DataFrame:
    """Cells named by the first line of their own file; as many positions are read as the widest line can have."""
    lines = lines.where(F.length("value") > 0).withColumn("_at", F.monotonically_increasing_id())
    width = lines.agg(F.max(F.length("value") - F.length(F.replace("value", F.lit(separator), F.lit(""))))).first()[0]
    if width is None:
        return lines.select("_file", F.array().cast(CELL).alias("cells"), F.array().cast(CELL).alias("broken"))
    names = [f"c{i}" for i in range(width // len(separator) + 1)]
    parsed = F.from_csv("value", ", ".join(f"{n} string" for n in names), {"sep": separator, "mode": "PERMISSIVE", "escape": '"'})

    def read(df: DataFrame, keep: list[str]) -> DataFrame:
        return once(once(df, keep, {"_row": parsed}), keep, {"_cells": F.array(*[F.col("_row")[n] for n in names])})

    tops = lines.where("_first").groupBy(F.col("_file").alias("_of")).agg(F.min("_at").alias("_top"), F.min_by("value", "_at").alias("value"))
    head = read(tops, ["_of", "_top"]).select("_of", "_top", F.transform("_cells", F.trim).alias("_names"))  # of one line a file, not of all
    named = F.zip_with("_names", "_cells", lambda n, v: F.struct(n.alias("column"), v.alias("value")))
    kept = read(lines.join(head, F.col("_file") == F.col("_of")).where("_at > _top"), ["_file", "_names"])
    return once(kept, ["_file"], {"cells": F.filter(named, lambda e: e["value"].isNotNull()), "broken": F.array().cast(CELL)})


def landed_cells(lines: DataFrame, fmt: str, separator: str = ",") -> DataFrame:
    """``_file, cells, broken``: every line as the texts of its cells with their columns, nulls left out.

    ``json``: an object a line; a nested value is its JSON text; a line that is no object, or names a column twice, is ``broken``; numbers keep 38 digits. ``csv``: a file's first
    line names its columns; cells beyond them have none; a quoted cell cannot hold a line break. Empty lines are no rows.
    """
    if fmt == "json":
        return _json_cells(lines)
    if fmt == "csv":
        return _csv_cells(lines, separator)
    raise ValueError(f"cannot read lines of format {fmt!r}; known: json, csv")


# ---- the merged schema ----------------------------------------------------------------------

def _fits(text: Column, kind: str) -> Column:
    """Whether the text is a value of the type and is not changed by it."""
    if kind == "string":
        return F.lit(True)
    value = text.try_cast(kind)
    if isinstance(T._parse_datatype_string(kind), T.NumericType):
        exact = text.try_cast("decimal(38,18)")
        same = value.isNotNull() & exact.isNotNull() & value.try_cast("decimal(38,18)").eqNullSafe(exact)
        return F.when(text.rlike("[A-DF-Za-df-z]"), False).otherwise(same)  # no decimal has other letters; a failing parse costs far more
    shape = {"date": r"^\d{4}-\d\d-\d\d$", "boolean": "(?i)^(true|false)$"}.get(kind, r"^\d{4}-\d\d-\d\d[ T]" if kind.startswith("timestamp") else "")
    return F.when(text.rlike(shape), value.isNotNull()).otherwise(False)


def new_columns(cells: DataFrame, known: T.StructType, hints: dict[str, str] | None = None, infer: bool = True) -> dict[str, str]:
    """The columns the log lacks, each with its hinted type or the narrowest type that all its cells of this batch fit.

    One aggregate over the cells of unknown columns; only their names come to the driver. Names that differ in case are one.
    """
    have = [f.name.lower() for f in known]
    each = cells.select(F.explode("cells").alias("e")).select(F.col("e.column").alias("column"), F.col("e.value").alias("value"))
    fresh = each.where(F.col("column").isNotNull() & (F.col("column") != "") & ~F.lower("column").isin(have))
    rows = fresh.groupBy(F.lower("column").alias("key")).agg(
        F.min("column").alias("column"), *[F.bool_and(_fits(F.col("value"), t)).alias(t) for t in NARROW if infer]).orderBy("key").collect()
    hinted = {k.lower(): v for k, v in (hints or {}).items()}
    return {r["column"]: hinted.get(r["key"]) or next((t for t in NARROW if infer and r[t]), "string") for r in rows}


def evolve(cells: DataFrame, log: SchemaLog, mode: str = "add", hints: dict[str, str] | None = None, infer: bool = True) -> T.StructType:
    """The schema to read a batch with. ``add`` logs its new columns first; ``rescue`` leaves them to the rescue column once
    the feed has a schema; ``fail`` logs them and raises, so that a person sees the change and the next run goes on."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; known: {', '.join(MODES)}")
    number, schema = log.current()
    if mode == "rescue" and number >= 0:
        return schema
    new = new_columns(cells, schema, hints, infer)
    if not new:
        return schema
    merged = log.add(new)
    if mode == "fail" and number >= 0:
        raise ValueError(f"new columns in the feed: {', '.join(new)}")
    return merged


def shaped(cells: DataFrame, schema: T.StructType) -> DataFrame:
    """The logged columns with their types, ``_rescued_data`` and ``_source_file_path``.

    A column takes the first cell of its name (case aside) if that fits. All other cells are rescued, as a JSON array of
    ``{column, value}``; null where nothing is left over, so every cell of a line is in one place or the other.
    """
    # one array holds, for each logged column, the position of its cell, or null; generators keep every step to once a row, as a
    # filter on a column would else repeat all steps for each cell
    held = once(cells, ["_file", "cells", "broken"], {"_lower": F.transform("cells", lambda e: F.lower(e["column"]))})
    at = [F.nullif(F.array_position("_lower", F.lit(f.name.lower())), F.lit(0)).cast("int") for f in schema]
    placed = once(held, ["_file", "cells", "broken"], {f"_p{i}": p for i, p in enumerate(at)} | {"_none": F.lit(None).cast("int")})
    found = once(placed, ["_file", "cells", "broken", *[f"_p{i}" for i in range(len(at))]],
                 {f"_t{i}": F.try_element_at("cells", f"_p{i}")["value"] for i in range(len(at))} | {"_none": F.lit(None).cast("int")})
    texts = [f"_t{i}" for i in range(len(at))]
    taken = F.array_compact(F.array(*[F.when(_fits(F.col(t), f.dataType.simpleString()), F.col(f"_p{i}")) for i, (t, f) in enumerate(zip(texts, schema))]).cast("array<int>"))
    fitted = once(found, ["_file", "cells", "broken", *texts, *[f"_p{i}" for i in range(len(at))]], {"_taken": taken})
    columns = {f"_v{i}": F.when(F.array_contains("_taken", F.col(f"_p{i}")), F.col(t).try_cast(f.dataType)) for i, (t, f) in enumerate(zip(texts, schema))}
    left = F.concat(F.filter("cells", lambda e, i: ~F.array_contains(F.col("_taken"), i + 1)), F.col("broken"))
    typed = once(fitted, ["_file"], columns | {RESCUED: F.when(F.size(left) > 0, F.to_json(left, {"ignoreNullFields": "false"}))})
    return typed.select(*[F.col(f"_v{i}").alias(f.name) for i, f in enumerate(schema)], RESCUED, F.col("_file").alias("_source_file_path"))


def read_evolving(spark: SparkSession, path: str, log_path: str, fmt: str = "json", glob: str = "*", mode: str = "add",
                  hints: dict[str, str] | None = None, infer: bool = True, separator: str = ",") -> DataFrame:
    """All landed files of a feed under one schema, whichever columns each of them has."""
    cells = landed_cells(text_lines(spark.read, path, glob), fmt, separator)
    return shaped(cells, evolve(cells, SchemaLog(spark, log_path), mode, hints, infer))


def read_landed(spark: SparkSession, out: str, log_path: str) -> DataFrame:
    """What was landed so far under the newest schema: rows from before a column came have null there."""
    _, schema = SchemaLog(spark, log_path).current()
    whole = T.StructType([*schema, T.StructField(RESCUED, T.StringType()), T.StructField("_source_file_path", T.StringType()),
                          T.StructField("_ingestion_timestamp", T.TimestampType()), T.StructField("_batch_id", T.LongType())])
    try:
        return spark.read.schema(whole).parquet(out)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], whole)
