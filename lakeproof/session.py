"""Session-level settings the library relies on: the shared checkpoint folder and scratch paths."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_KEY = "spark.checkpoint.dir"


def checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder named by the session.

    Only a local session without the setting gets a temporary folder: on a cluster a folder that
    one machine alone can see would lose its data with that machine, so there we refuse.
    """
    context = spark.sparkContext
    active = context.getCheckpointDir()
    if active:
        return active
    configured = spark.conf.get(CHECKPOINT_KEY, None) or context.getConf().get(CHECKPOINT_KEY)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="lakeproof-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame to the checkpoint folder and go on from there (survives lost executors)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint folder, for staging data between two jobs."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet below the checkpoint folder and read again: cut lineage with pruned reads and a known size,
    by which Spark chooses its joins (survives lost executors)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over ``spark.sql.shuffle.partitions`` tasks, for work that costs far more than its bytes: a reader deals by
    bytes, so that a small file, however long each of its rows takes, would be one task."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def small_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few configuration rows as literals in the plan (no Python data to ship to tasks)."""
    fields = T.StructType.fromDDL(schema).fields
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(fields, row)]) for row in rows]
    kind = T.ArrayType(T.StructType(fields))
    return spark.sql("select 1 as one").select(F.inline(F.array(*structs).cast(kind)))


def table_exists(spark: SparkSession, table: str) -> bool:
    return spark.catalog.tableExists(table)
