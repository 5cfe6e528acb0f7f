"""One batch through the lake: landing → raw → curated → publish, with its ledgers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger
from ..operators.mapping import apply_mapping
from ..operators.stitch import stitch, stitch_scd2
from ..session import staged, table_exists
from ..sources.files import counted, read_landing
from ..sources.writers import drop_partitions, write_partitioned
from .models import run_config_query


SOURCE = "data_src_nm"


@dataclass(frozen=True)
class SourceObject:
    """Configuration of one landed object.

    ``curated_query`` and ``publish_query`` are configured SQL (see plans.models); without one the
    mapping rows, or a plain pass-through of the batch, are used. ``load_key`` (for ``append`` and
    ``roll_out``) tells the loads of the published table apart; without one it is the batch.
    ``window`` are the first and last load key that ``roll_out`` keeps.
    """

    name: str
    landing_path: str
    glob: str
    curated_table: str
    publish_table: str
    fmt: str = "csv"
    mapping: list[dict] = field(default_factory=list)
    curated_query: str | None = None
    publish_query: str | None = None
    stitching: str = "full"
    keys: tuple[str, ...] = ()
    order_key: str | None = None
    load_key: str | None = None
    window: tuple | None = None


def object_of(row: dict, **rest) -> SourceObject:
    """The object with its merge mode from a stitching configuration row (lists are comma-separated)."""
    split = lambda name: tuple(x.strip() for x in (row.get(name) or "").split(",") if x.strip())
    order, load = split("order_key"), split("record_load_key")
    return SourceObject(stitching=(row.get("stitching_type") or "full").strip().lower(), keys=split("primary_keys"),
                        order_key=order[0] if order else None, load_key=load[0] if load else None, **rest)


def publish(spark: SparkSession, obj: SourceObject, rows: DataFrame, batch_id: str, source_system: str) -> None:
    """Merge a batch into the published table by the object's mode.

    The table is partitioned by source, and for ``append`` by load too: a batch replaces the partitions
    of its own sources (or loads), read first where the mode needs the old rows, and leaves all others
    alone. The first batch takes the same way over an empty target. Running a batch again changes nothing.
    The rows are read several times, so they should be stored ones.
    """
    load_key = obj.load_key or "batch_id"
    if obj.stitching in ("append", "roll_out") and load_key not in rows.columns:
        rows = rows.withColumn(load_key, F.lit(batch_id))
    if obj.stitching == "append":
        write_partitioned(rows, obj.publish_table, [SOURCE, load_key])
        return
    sources = [r[0] for r in rows.select(SOURCE).distinct().collect()] or [source_system]
    exists = table_exists(spark, obj.publish_table)
    target = spark.table(obj.publish_table) if exists else None
    own = None if target is None else target.where(F.col(SOURCE).isin([s for s in sources if s is not None])
                                                   | (F.col(SOURCE).isNull() if None in sources else F.lit(False)))
    keys = [*obj.keys, *([SOURCE] if SOURCE not in obj.keys else [])]
    if obj.stitching == "scd2":
        merged = stitch_scd2(own, rows, keys, obj.order_key)
    else:
        empty = rows.limit(0) if own is None else own
        if obj.stitching == "delete_flag" and own is None:
            empty = empty.withColumn("is_deleted", F.lit("N"))
        merged = stitch(empty, rows, obj.stitching, keys, obj.order_key, load_key, obj.window)
    merged = staged(merged, "merged")
    write_partitioned(merged, obj.publish_table, [SOURCE])
    left = {r[0] for r in merged.select(SOURCE).distinct().collect()}
    drop_partitions(spark, obj.publish_table, [{SOURCE: s} for s in sources if s is not None and s not in left])


def run_object(spark: SparkSession, obj: SourceObject, batch_id: str, source_system: str, audit: str) -> None:
    """Load one object for a batch. Every write replaces the batch's own partitions, so a repeated run
    after a crash gives the same tables; the publish write is last."""
    raw = read_landing(spark, obj.landing_path, obj.fmt, obj.glob)
    file_id = F.regexp_replace("_source_file_name", r"[^\w.-]", "_")
    stamp = {"batch_id": F.lit(batch_id), "pt_file_id": file_id}
    if obj.curated_query:
        curated = run_config_query(spark, obj.curated_query, {"batch_id": batch_id}, raw.withColumns(stamp),
                                   columns={"file_name": "_source_file_name", "file_id": "pt_file_id"})
    elif obj.mapping:
        keep = [{"target": "pt_file_id", "source": "pt_file_id"}]
        curated = apply_mapping(raw.withColumns(stamp), obj.mapping + keep).withColumn("batch_id", F.lit(batch_id))
    else:
        curated = raw.drop("_source_file_path", "_source_file_name").withColumns(
            {**stamp, "pt_file_id": F.lit(obj.name)})
    seen, rows = counted(curated)
    write_partitioned(seen, obj.curated_table, ["batch_id", "pt_file_id"])
    ledger.file_audit(spark, audit, batch_id, source_system, obj.name, "curated", rows.get["rows"])

    if obj.publish_query:
        db, _, table = obj.curated_table.rpartition(".")
        published = run_config_query(spark, obj.publish_query, {
            "batch_id": batch_id, "curated_db": db or "default", "curated_tbl_name": table})
    else:
        published = spark.table(obj.curated_table).where(F.col("batch_id") == batch_id).drop("batch_id", "pt_file_id")
    if SOURCE not in published.columns:
        published = published.withColumn(SOURCE, F.lit(source_system))
    published = staged(published, "published")
    publish(spark, obj, published, batch_id, source_system)
    ledger.file_audit(spark, audit, batch_id, source_system, obj.name, "publish", published.count())


def run_batch(spark: SparkSession, objects: list[SourceObject], batch_id: str, source_system: str,
              batches: str = "parent_batch_process", audit: str = "ingestion_audit") -> str:
    """Open the batch, load every object, close it with C or F; returns the status.

    A failed object gets an audit row; the closing row of the batch holds the whole messages of all.
    """
    ledger.batch_open(spark, batches, batch_id, source_system)
    failures = []
    for obj in objects:
        try:
            run_object(spark, obj, batch_id, source_system, audit)
        except Exception as error:
            failures.append(f"{obj.name}: {error}")
            ledger.file_audit(spark, audit, batch_id, source_system, obj.name, "curated", 0, "FAILED")
    status = "F" if failures else "C"
    ledger.batch_close(spark, batches, batch_id, status, "; ".join(failures))
    return status
