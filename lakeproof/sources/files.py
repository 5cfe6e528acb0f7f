"""Landing files: reading by pattern, archives, load-once and typed loads."""

from __future__ import annotations

import os
import re
import uuid
import zipfile
from collections import Counter

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import record_hash
from ..operators.skew import quoted
from ..session import staged, table_exists

# Types a load may cast to, and the audit columns every loaded table carries.
LOAD_TYPES = ("STRING", "BOOLEAN", "INT", "BIGINT", "DOUBLE", "DECIMAL(18,2)", "DATE", "TIMESTAMP")
AUDIT_COLUMNS = {"_source_file_name": "string", "_source_file_path": "string", "_ingestion_timestamp": "timestamp",
                 "_batch_id": "string", "_record_hash": "string"}


def read_landing(spark: SparkSession, path: str, fmt: str, glob: str = "*", schema=None, **options) -> DataFrame:
    """Files below a landing folder whose name matches, each row stamped with its file.

    Without a schema CSV columns stay text: a landing read never infers types by a second pass.
    """
    reader = spark.read.format(fmt).option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    if fmt == "csv":
        reader = reader.option("header", "true")
    for k, v in options.items():
        reader = reader.option(k, v)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    return df.select("*", F.col("_metadata.file_name").alias("_source_file_name"),
                     F.col("_metadata.file_path").alias("_source_file_path"))


def land_files(df: DataFrame, path: str, fmt: str, by: str, **options) -> None:
    """Write a frame as landing files, one folder per value of ``by``; hot values get several files."""
    writer = df.hint("rebalance", F.col(by)).write.mode("overwrite").partitionBy(by).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.options(**options).save(path)


# ---- archives -------------------------------------------------------------------------------

def _member_names(infos) -> dict[str, str]:
    """Base name of each member; members that share one keep their folders in the name."""
    shared = Counter(i.filename.split("/")[-1] for i in infos)
    return {i.filename: (i.filename.split("/")[-1] if shared[i.filename.split("/")[-1]] == 1
                         else i.filename.strip("/").replace("/", "__")) for i in infos}


def _extract_archives(out: str, chunk: int = 8 << 20):
    def extract(batches):
        import pandas as pd
        import pyarrow.fs as pafs

        target, root = pafs.FileSystem.from_uri(out)
        for batch in batches:
            written = []
            for source in batch["path"]:
                fs, name = pafs.FileSystem.from_uri(source)
                folder = f"{root}/{os.path.splitext(os.path.basename(name))[0]}"
                target.create_dir(folder, recursive=True)
                with fs.open_input_file(name) as raw, zipfile.ZipFile(raw) as archive:
                    infos = [i for i in archive.infolist() if not i.is_dir()]
                    names = _member_names(infos)
                    for info in infos:
                        final, size = f"{folder}/{names[info.filename]}", 0
                        partial = f"{folder}/.{uuid.uuid4().hex}"  # a retried task never leaves half a file
                        with archive.open(info) as member, target.open_output_stream(partial) as sink:
                            while block := member.read(chunk):
                                sink.write(block)
                                size += len(block)
                        target.move(partial, final)
                        written.append((source, info.filename, final, size))
            yield pd.DataFrame(written, columns=["archive", "member", "path", "bytes"])
    return extract


def _as_uri(spark: SparkSession, path: str) -> str:
    """The path with its scheme; without one it is on the session's default file system, as for Spark itself."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return re.sub("^file:/+", "file:///", files.makeQualified(place).toString())


def expand_archives(spark: SparkSession, path: str, out: str, glob: str = "*.zip") -> DataFrame:
    """Unpack zip archives under ``out/<archive>/`` and return ``(archive, member, path, bytes)``.

    Spark spreads the archives over tasks by name; members stream through in blocks, so neither an
    archive nor a member has to fit in memory. The manifest is written first, then returned.
    """
    out = _as_uri(spark, out)
    archives = (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
                .load(path).select(F.regexp_replace(F.regexp_replace("path", "^file:/+", "file:///"), "^s3[an]://", "s3://").alias("path")))
    manifest = f"{out}/_manifest"
    (archives.repartition("path").mapInPandas(_extract_archives(out), "archive string, member string, path string, bytes long")
     .write.mode("overwrite").parquet(manifest))
    return spark.read.parquet(manifest)


# ---- typed load -----------------------------------------------------------------------------

def _file_metadata(df: DataFrame) -> bool:
    try:
        df.select("_metadata.file_path").schema
        return True
    except AnalysisException:
        return False


def audit_values(df: DataFrame, batch_id: str | None = None, hash_cols=()) -> dict[str, Column]:
    """Audit columns: taken from the data where present, generated where not."""
    have = {c.lower(): c for c in df.columns}
    files = _file_metadata(df)
    made = {
        "_source_file_name": F.col("_metadata.file_name") if files else F.lit(None),
        "_source_file_path": F.col("_metadata.file_path") if files else F.lit(None),
        "_ingestion_timestamp": F.current_timestamp(),
        "_batch_id": F.lit(batch_id),
        "_record_hash": record_hash(*[quoted(c) for c in hash_cols]) if hash_cols else F.lit(None),
    }
    return {name: (quoted(have[name]) if name in have else made[name]).cast(kind)
            for name, kind in AUDIT_COLUMNS.items()}


def typed_load(df: DataFrame, mapping: list[dict], audit: bool = True, batch_id: str | None = None,
               hash_rows: bool = False) -> tuple[DataFrame, DataFrame]:
    """Cast each mapped column; ``(good, rejected)``.

    ``mapping`` rows are ``{target, type, source?}``. No cast raises: a row with a value that does
    not convert goes to ``rejected`` with the source text and the names of the failing columns.
    """
    bad_types = [m["type"] for m in mapping if m["type"].upper() not in LOAD_TYPES]
    if bad_types:
        raise ValueError(f"unsupported target types: {bad_types}")
    pairs = [(m.get("source") or m["target"], m["target"], m["type"]) for m in mapping]
    failed = F.array_compact(F.array(*[
        F.when(quoted(s).isNotNull() & quoted(s).try_cast(t).isNull(), F.lit(target)) for s, target, t in pairs]))
    extra = audit_values(df, batch_id, [s for s, _, _ in pairs] if hash_rows else ()) if audit else {}
    typed = df.select(
        *[quoted(s).try_cast(t).alias(target) for s, target, t in pairs],
        *[c.alias(n) for n, c in extra.items()],
        F.struct(*[quoted(s).cast("string").alias(target) for s, target, _ in pairs]).alias("_source"),
        failed.alias("_failed"))
    good = typed.where(F.size("_failed") == 0).drop("_source", "_failed")
    rejected = typed.where(F.size("_failed") > 0).select("_source.*", F.col("_failed").alias("_cast_errors"), *extra)
    return good, rejected


def load_rowcount_check(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """``(table, rows)`` on both sides: loaded against source, with a warning status on a mismatch."""
    joined = (expected.select("table", F.col("rows").alias("source_rows"))
              .join(observed.select("table", F.col("rows").alias("loaded_rows")), "table", "full_outer"))
    match = F.when(F.col("source_rows").isNotNull() & F.col("loaded_rows").isNotNull(),
                   F.col("source_rows") == F.col("loaded_rows"))
    status = F.when(match, "completed").when(~match, "completed_with_warnings").otherwise("not_loaded")
    return joined.withColumn("row_count_match", match).withColumn("status", status)


def counted(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """The frame with a row counter that is filled by the write that follows (no second scan)."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


# ---- load once ------------------------------------------------------------------------------



def landed_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """The files below a folder (names, sizes and times only; contents are not read)."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
            .load(path).select(F.col("path").alias("file_path"), "length", "modificationTime"))


def copy_into_once(spark: SparkSession, path: str, table: str, ledger: str, fmt: str = "parquet", glob: str = "*", max_files: int = 10_000) -> int:
    """Append the files that were not loaded before; returns how many.

    Files are loaded in the order of their paths, ``max_files`` at a time, which is all the names the driver holds; only new files are
    read. A load owns one ``_load_id`` partition. Its files are logged as started before the write and as
    done after it; a run that finds a load started but not done drops that partition and loads its
    files again, so a lost driver neither loses nor repeats rows.
    """
    def log(load_id, files, state):
        (files.select(F.lit(load_id).alias("load_id"), "file_path", F.lit(state).alias("state"),
                      F.current_timestamp().alias("logged_at"))
         .write.mode("append").format("parquet").saveAsTable(ledger))

    found = landed_files(spark, path, glob).select("file_path")
    if table_exists(spark, ledger):
        seen = spark.table(ledger)
        done = seen.where("state = 'done'")
        broken = seen.where("state = 'started'").join(done, "load_id", "left_anti").select("load_id").distinct()
        for row in broken.collect():  # one for each run that died
            if table_exists(spark, table):
                spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (_load_id = '{row['load_id']}')")
        found = found.join(done, "file_path", "left_anti")
    fresh, loaded, last = staged(found, "fresh-files"), 0, ""
    while names := [r["file_path"] for r in fresh.where(F.col("file_path") > last).orderBy("file_path").limit(max_files).collect()]:
        load_id = uuid.uuid4().hex
        files = spark.createDataFrame([(n,) for n in names], "file_path string")
        log(load_id, files, "started")
        reader = spark.read.format(fmt)
        rows = (reader.option("header", "true") if fmt == "csv" else reader).load(names)
        (rows.withColumn("_load_id", F.lit(load_id)).write.mode("append").format("parquet")
         .partitionBy("_load_id").saveAsTable(table))
        log(load_id, files, "done")
        loaded, last = loaded + len(names), names[-1]
    return loaded
