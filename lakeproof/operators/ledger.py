"""Batch, file and ingestion ledgers as append-only event tables, and the reports over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small_frame, table_exists
from ..sources.writers import replace_table
from .reconcile import Verdict, reconcile
from .skew import numbered

# Completion codes, and the layers an ingestion row passes through.
STATUSES = {"I": "In Progress", "C": "Completed", "F": "Failed"}
LAYERS = ("landing", "raw", "curated", "published", "warehouse")

BATCH_SCHEMA = "parent_batch_id string, source_system string, completion_status string, remarks string"
AUDIT_SCHEMA = ("batch_id string, source_system string, source_object_name string, layer string, row_count long, "
                "status string")


def _append(rows: DataFrame, ledger: str) -> None:
    rows.withColumn("logged_at", F.current_timestamp()).write.mode("append").format("parquet").saveAsTable(ledger)


def compact_ledger(spark: SparkSession, ledger: str) -> None:
    """Rewrite a ledger, which grows by a file for each event, as few files; its rows stay the same."""
    replace_table(spark.table(ledger).hint("rebalance"), ledger)


def batch_open(spark: SparkSession, ledger: str, batch_id: str, source_system: str) -> bool:
    """Log a batch as in progress unless the ledger knows it; true if it was new."""
    row = small_frame(spark, [(batch_id, source_system, "I", "")], BATCH_SCHEMA)
    if table_exists(spark, ledger):
        row = row.join(spark.table(ledger).select("parent_batch_id").distinct(), "parent_batch_id", "left_anti")
        if row.isEmpty():
            return False
    _append(row, ledger)
    return True


def batch_close(spark: SparkSession, ledger: str, batch_id: str, status: str, remarks: str = "") -> None:
    """Log the end of a batch (C or F)."""
    if status not in ("C", "F"):
        raise ValueError(f"a batch closes with C or F, not {status!r}")
    _append(small_frame(spark, [(batch_id, None, status, remarks)], BATCH_SCHEMA), ledger)


def batch_state(events: DataFrame) -> DataFrame:
    """The current state of every batch from its events ``(parent_batch_id, source_system,
    completion_status, logged_at)``: start, end (once closed) and status."""
    names = F.create_map(*[F.lit(x) for kv in STATUSES.items() for x in kv])
    latest = F.max_by("completion_status", "logged_at")
    state = events.groupBy("parent_batch_id").agg(
        F.max("source_system").alias("source_system"), F.min("logged_at").alias("batch_start_date"),
        F.max("logged_at").alias("_last"), latest.alias("completion_status"))
    return state.select(
        "parent_batch_id", "source_system", "batch_start_date",
        F.when(F.col("completion_status") != "I", F.col("_last")).alias("batch_end_date"), "completion_status",
        F.try_element_at(names, F.col("completion_status")).alias("process_status"))


def file_audit(spark: SparkSession, ledger: str, batch_id: str, source_system: str, source_object: str, layer: str,
               row_count: int, status: str = "SUCCEEDED") -> None:
    """Append one audit row; take ``row_count`` from the write's own counter (sources.files.counted)."""
    _append(small_frame(spark, [(batch_id, source_system, source_object, layer, row_count, status)], AUDIT_SCHEMA), ledger)


def file_audits(counts: DataFrame, ledger: str, batch_id: str, source_system: str, layer: str, status: str = "SUCCEEDED") -> None:
    """Append one audit row for each ``source_object_name, row_count`` of a frame; a null name is an object of its own."""
    _append(counts.select(F.lit(batch_id).alias("batch_id"), F.lit(source_system).alias("source_system"), "source_object_name",
                          F.lit(layer).alias("layer"), F.col("row_count").cast("long").alias("row_count"), F.lit(status).alias("status")), ledger)


def file_registry(rows: DataFrame, batch: str, start: int = 1, file_col: str = "_source_file_name",
                  listing: DataFrame | None = None) -> DataFrame:
    """One row per landed file with a consecutive file id from ``start``, its pattern and record count.

    ``listing(file_name)`` are the files that landed; those without rows are registered with a count of 0.
    """
    files = rows.groupBy(F.col(file_col).alias("file_name")).agg(F.count(F.lit(1)).alias("record_count"))
    if listing is not None:
        files = (listing.select("file_name").distinct().join(files, "file_name", "full_outer")
                 .withColumn("record_count", F.coalesce("record_count", F.lit(0))))
    pattern = F.regexp_replace("file_name", r"\d+", "*")
    return (numbered(files, ["file_name"], "file_id", start)
            .withColumns({"pattern_name": pattern, "parent_batch_id": F.lit(batch)}))


def ingestion_ledger(events: DataFrame) -> DataFrame:
    """One row per file with status, count, time and message of each layer.

    ``events``: ``(file_name, batch_id, layer, status, record_count, message, logged_at)``; the latest
    event of a layer counts. One conditional aggregate, no pivot job to discover the layers.
    """
    fields = (("status", "status"), ("record_count", "record_count"), ("completion_timestamp", "logged_at"),
              ("message", "message"))
    aggs = [F.max_by(F.when(F.col("layer") == layer, F.col(source)),
                     F.when(F.col("layer") == layer, F.col("logged_at"))).alias(f"{layer}_{name}")
            for layer in LAYERS for name, source in fields]
    failures = F.count_if(F.upper("status") == "FAILED").alias("failure_count")
    return events.groupBy("file_name", "batch_id").agg(*aggs, failures)


def batch_failures(logs: DataFrame) -> DataFrame:
    """Closing status per batch: F as soon as one outbound row failed."""
    failed = F.upper(F.trim("output_status")).isin("FAILED", "FAILURE", "F", "ERROR")
    return logs.groupBy("batch_id").agg(
        F.when(F.bool_or(F.coalesce(failed, F.lit(False))), "F").otherwise("C").alias("completion_status"),
        F.count_if(failed).alias("failures"))


def batch_summary(batches: DataFrame, files: DataFrame, rows: DataFrame) -> DataFrame:
    """Batches with their distinct files and ingestion rows; each side is counted before the join, so
    two long sides never multiply."""
    f = files.groupBy("parent_batch_id").agg(F.countDistinct("file_id").alias("files"))
    r = rows.groupBy(F.col("batch_id").alias("parent_batch_id")).agg(F.countDistinct("file_id").alias("ingestion_rows"))
    return (batches.join(f, "parent_batch_id", "left").join(r, "parent_batch_id", "left")
            .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("files", "ingestion_rows")}))


def ledger_parity(old: DataFrame, new: DataFrame, key: list[str], pair: str = "ledger") -> Verdict:
    """Do two file ledgers agree on counts and keys?"""
    return reconcile(old.select(*key, "record_count"), new.select(*key, "record_count"), key, pair=pair)


def stage_count_drift(ledger: DataFrame) -> DataFrame:
    """Rows a file lost (positive) or gained between neighbouring layers that both have a count."""
    steps = [F.struct(F.lit(f"{a}_to_{b}").alias("step"),
                      (F.col(f"{a}_record_count") - F.col(f"{b}_record_count")).alias("lost"))
             for a, b in zip(LAYERS, LAYERS[1:])]
    return ledger.select("file_name", "batch_id", F.inline(F.array(*steps))).where("lost <> 0")


def latest_batches(batches: DataFrame, n: int = 5) -> DataFrame:
    """The newest batches by start time, a report of ``n`` rows."""
    return batches.orderBy(F.col("batch_start_date").desc(), "parent_batch_id").limit(n)
