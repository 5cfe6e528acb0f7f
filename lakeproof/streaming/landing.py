"""Incremental landing and merging with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.buckets import upsert_bucketed
from ..operators.skew import newest_per_key
from ..operators.stitch import stitch_upsert, upsert_partitions
from ..session import table_exists
from ..sources import evolving
from ..sources.writers import recover_table, replace_table


def landing_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", glob: str = "*", max_files: int = 1000) -> DataFrame:
    """New files below a folder as a stream, each row stamped with its file."""
    reader = (spark.readStream.format(fmt).schema(schema).option("pathGlobFilter", glob)
              .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files))
    if fmt == "csv":
        reader = reader.option("header", "true")
    return reader.load(path).select("*", F.col("_metadata.file_name").alias("_source_file_name"),
                                    F.current_timestamp().alias("_ingestion_timestamp"))


def stream_landing(spark: SparkSession, path: str, schema, out: str, checkpoint: str, fmt: str = "parquet", glob: str = "*",
                   continuous: str | None = None) -> StreamingQuery:
    """Append files that arrived since the last run to the bronze folder ``out``, exactly once.

    Runs until the backlog is loaded, or goes on with the given trigger interval (``'1 minute'``).
    The checkpoint remembers the files, the sink's log the committed batches.
    """
    writer = (landing_stream(spark, path, schema, fmt, glob).writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", checkpoint).option("path", out))
    writer = writer.trigger(processingTime=continuous) if continuous else writer.trigger(availableNow=True)
    return writer.start()


def stream_evolving(spark: SparkSession, path: str, out: str, checkpoint: str, log_path: str | None = None, fmt: str = "json",
                    glob: str = "*", mode: str = "add", hints: dict[str, str] | None = None, infer: bool = True, separator: str = ",",
                    max_files: int = 1000, continuous: str | None = None) -> StreamingQuery:
    """Append files that arrived since the last run to ``out``, whichever columns they have (see ``sources.evolving``).

    The schema log is kept beside the checkpoint unless ``log_path`` says where. A batch replaces its own folder
    ``_batch_id=n``, and logging a column twice changes nothing, so a batch delivered again after a crash is harmless.
    ``sources.evolving.read_landed`` reads the result under the newest schema.
    """
    log_path = log_path or f"{checkpoint.rstrip('/')}-schema"

    def land(batch: DataFrame, batch_id: int) -> None:
        cells = evolving.landed_cells(batch, fmt, separator)
        schema = evolving.evolve(cells, evolving.SchemaLog(batch.sparkSession, log_path), mode, hints, infer)
        rows = evolving.shaped(cells, schema).withColumn("_ingestion_timestamp", F.current_timestamp())
        rows.write.mode("overwrite").parquet(f"{out.rstrip('/')}/_batch_id={batch_id}")

    lines = evolving.text_lines(spark.readStream.option("maxFilesPerTrigger", max_files), path, glob)
    writer = lines.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=continuous) if continuous else writer.trigger(availableNow=True)
    return writer.start()


def upsert_batch(target: str, keys: list[str], order_key: str, by: list[str] | None = None, slices: int | None = None):
    """The per-batch merge; with partition columns ``by`` only the touched partitions are rewritten, with ``slices`` the touched
    slices of a bucketed table (see ``operators.buckets``), else the table. Merging the same batch twice changes nothing
    (the newest row wins, ties go to an equal row), so a batch delivered again after a crash is harmless."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if slices:
            upsert_bucketed(target, batch, keys, order_key, slices)
            return
        if by:
            upsert_partitions(target, batch, keys, order_key, by)
            return
        recover_table(spark, target)
        if not table_exists(spark, target):
            newest_per_key(batch, keys, [order_key]).write.format("parquet").saveAsTable(target)
            return
        replace_table(stitch_upsert(spark.table(target), batch, keys, order_key), target)
    return merge


def stream_upsert(stream: DataFrame, target: str, keys: list[str], order_key: str, checkpoint: str,
                  repeats: str | None = None, by: list[str] | None = None, continuous: str | None = None,
                  slices: int | None = None) -> StreamingQuery:
    """Merge a change stream into a table, one micro-batch at a time.

    ``repeats`` (``'1 hour'``) drops events delivered again within that time of event time before they
    reach the merge; the state it keeps is bounded by the watermark.
    """
    if repeats:
        timed = stream.withColumn("_event_time", F.col(order_key).cast("timestamp")).withWatermark("_event_time", repeats)
        stream = timed.dropDuplicatesWithinWatermark([*keys, order_key]).drop("_event_time")
    writer = stream.writeStream.foreachBatch(upsert_batch(target, keys, order_key, by, slices)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=continuous) if continuous else writer.trigger(availableNow=True)
    return writer.start()
