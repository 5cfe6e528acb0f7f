"""Idempotent table writes on plain files: partition overwrite, staged replacement, reject zones."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table_exists

OVERWRITE_MODE = "spark.sql.sources.partitionOverwriteMode"


@contextmanager
def dynamic_overwrite(spark: SparkSession):
    before = spark.conf.get(OVERWRITE_MODE)
    spark.conf.set(OVERWRITE_MODE, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(OVERWRITE_MODE, before)


def partition_columns(spark: SparkSession, table: str) -> list[str]:
    """The columns a table is partitioned by, in their order; none for a table that does not exist."""
    if not table_exists(spark, table):
        return []
    return [c.name for c in spark.catalog.listColumns(table) if c.isPartition]


def write_partitioned(df: DataFrame, table: str, by: list[str], path: str | None = None) -> None:
    """Replace only the partitions the frame holds; running it twice gives the same table.

    Rows are rebalanced by partition value: a small partition becomes one file, and adaptive
    execution splits one that holds a large share of the rows. A table that is partitioned in another
    way is refused: there, the same write would replace rows that the frame does not hold.
    """
    spark = df.sparkSession
    ordered = df.select(*[c for c in df.columns if c not in by], *by)
    balanced = ordered.hint("rebalance", *[F.col(c) for c in by])
    if not table_exists(spark, table):
        writer = balanced.write.mode("overwrite").partitionBy(*by).format("parquet")
        (writer.option("path", path) if path else writer).saveAsTable(table)
        return
    have = partition_columns(spark, table)
    if [c.lower() for c in have] != [c.lower() for c in by]:
        raise ValueError(f"{table} is partitioned by {have}, not by {list(by)}")
    with dynamic_overwrite(spark):
        balanced.select(*spark.table(table).columns).write.mode("overwrite").insertInto(table)


def drop_partitions(spark: SparkSession, table: str, values: list[dict]) -> None:
    """Drop partitions by the values of their columns, where the table has them."""
    for value in values:
        spec = ", ".join(f"`{c}` = {_literal(v)}" for c, v in value.items())
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({spec})")


def _literal(value) -> str:
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def replace_table(df: DataFrame, table: str) -> None:
    """Replace a table by a frame that may read it: write a staging table, then swap the names.

    The new table is partitioned like the old one. The old table is kept under a retired name until
    the new one is in place; a run that died in between is finished first by ``recover_table``.
    """
    spark = df.sparkSession
    stage, retired = f"{table}__stage_{uuid.uuid4().hex[:8]}", f"{table}__retired"
    by = partition_columns(spark, table)
    writer = (df.hint("rebalance", *[F.col(c) for c in by]) if by else df).write.mode("overwrite").format("parquet")
    (writer.partitionBy(*by) if by else writer).saveAsTable(stage)
    if table_exists(spark, table):
        spark.sql(f"DROP TABLE IF EXISTS {retired}")
        spark.sql(f"ALTER TABLE {table} RENAME TO {retired}")
        _relocate_partitions(spark, retired)  # else dropping it would delete what its partitions still point to
    spark.sql(f"ALTER TABLE {stage} RENAME TO {table}")
    _relocate_partitions(spark, table)
    spark.sql(f"DROP TABLE IF EXISTS {retired}")


def _relocate_partitions(spark: SparkSession, table: str) -> None:
    """Point the partitions of a renamed table to its new folder: a rename leaves them at the old one."""
    if not partition_columns(spark, table):
        return
    root = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Location'").first()["data_type"]
    for row in spark.sql(f"SHOW PARTITIONS {table}").collect():
        cells = [x.partition("=") for x in row[0].split("/")]
        spec = ", ".join(f"`{c}` = {_literal(unquote(v))}" for c, _, v in cells)
        spark.sql(f"ALTER TABLE {table} PARTITION ({spec}) SET LOCATION {_literal(root.rstrip('/') + '/' + row[0])}")


def recover_table(spark: SparkSession, table: str) -> None:
    """Bring back the retired version where a swap stopped between its two renames."""
    retired = f"{table}__retired"
    if not table_exists(spark, table) and table_exists(spark, retired):
        spark.sql(f"ALTER TABLE {retired} RENAME TO {table}")
        _relocate_partitions(spark, table)


def reject_zone(df: DataFrame, ok: Column, path: str, rule: str, batch_id: str = "none") -> DataFrame:
    """Write the rows that fail to ``path/_dq_rule=…/_dq_batch=…`` and return the others.

    NULL counts as a failure here: a row leaves the reject zone only by passing. A repeated batch
    replaces its own rejects.
    """
    passed = F.coalesce(ok, F.lit(False))
    rejects = df.where(~passed).withColumns({"_dq_rejected_at": F.current_timestamp(), "_dq_rule": F.lit(rule),
                                             "_dq_batch": F.lit(batch_id)})
    with dynamic_overwrite(df.sparkSession):
        rejects.write.mode("overwrite").partitionBy("_dq_rule", "_dq_batch").parquet(path)
    return df.where(passed)
