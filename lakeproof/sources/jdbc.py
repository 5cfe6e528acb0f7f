"""Parallel JDBC landing and publishing."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import export_type
from ..session import small_frame


def landing_names(tables: list[str]) -> dict[str, str]:
    """Landing name of each ``schema.table``: its base name, schema-qualified where two would collide."""
    split = {t: (t.rpartition(".")[0].split(".")[-1] or "public", t.split(".")[-1].lower()) for t in tables}
    shared = Counter(base for _, base in split.values())
    return {t: base if shared[base] == 1 else f"{schema}_{base}" for t, (schema, base) in split.items()}


def read_jdbc(spark: SparkSession, url: str, source: str, props: dict, partition: dict | None = None) -> DataFrame:
    """A table or a sub-select, read in parallel ranges when ``partition`` names
    ``{column, lower, upper, parts}``."""
    table = f"({source}) wrapped" if source.lstrip().lower().startswith("select") else source
    props = {"fetchsize": "10000", **props}
    if not partition:
        return spark.read.jdbc(url, table, properties=props)
    return spark.read.jdbc(url, table, column=partition["column"], lowerBound=partition["lower"],
                           upperBound=partition["upper"], numPartitions=partition["parts"], properties=props)


def jdbc_land(spark: SparkSession, url: str, tables: list[str], target: str, props: dict,
              partition: dict[str, dict] | None = None, read=read_jdbc) -> dict[str, str]:
    """Land every listed table as its own table of the target schema, full overwrite."""
    names = landing_names(tables)
    for source, name in names.items():
        df = read(spark, url, source, props, (partition or {}).get(source))
        df.write.mode("overwrite").format("parquet").saveAsTable(f"{target}.{name}")
    return {source: f"{target}.{name}" for source, name in names.items()}


def export_column_types(df: DataFrame) -> str:
    """Column list with warehouse types for a published copy of the frame."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    mapped = small_frame(df.sparkSession, rows, "ord int, name string, kind string").select(
        "ord", "name", export_type("kind").alias("target"))
    return ", ".join(f"{r['name']} {r['target']}" for r in mapped.orderBy("ord").collect())


def export_to_jdbc(df: DataFrame, url: str, table: str, props: dict, mode: str = "overwrite", parts: int = 16) -> None:
    """Publish a table to a warehouse over at most ``parts`` parallel connections."""
    (df.write.mode(mode).option("createTableColumnTypes", export_column_types(df))
     .option("numPartitions", parts).option("batchsize", 10000).option("truncate", "true")
     .jdbc(url, table, properties=props))


def export_types(columns: DataFrame) -> DataFrame:
    """Warehouse type of every row of a column catalogue."""
    return columns.withColumn("target_type", export_type(F.col("col_type")))
