"""Building blocks that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def orderable(dtype: T.DataType) -> bool:
    if isinstance(dtype, (T.MapType, T.VariantType)):
        return False
    if isinstance(dtype, T.ArrayType):
        return orderable(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(orderable(f.dataType) for f in dtype.fields)
    return True


def newest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The greatest row of each key by the order columns, then by all other columns.

    An aggregate, not a window: every map task already reduces a hot key to one row, so the
    shuffle carries at most one row per key and task.
    """
    taken = {c.lower() for c in [*keys, *order]}
    rest = [f.name for f in df.schema.fields if f.name.lower() not in taken and orderable(f.dataType)]
    rank = F.struct(*[quoted(c) for c in [*order, *rest]])
    row = F.struct(*[quoted(c) for c in df.columns])
    return df.groupBy(*[quoted(k) for k in keys]).agg(F.max_by(row, rank).alias("_row")).select("_row.*")


PART = "_part"


def range_parts(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The frame range-partitioned by key and order, with the partition number as column ``_part``.

    A hot key is spread over as many partitions as its rows need. The result is written to the
    checkpoint folder: sampled ranges may differ between two evaluations.
    """
    return cut_lineage(df.repartitionByRange(*keys, *order).withColumn(PART, F.spark_partition_id()))


def neighbour(df: DataFrame, keys: list[str], order: str, values: list[str], *, following: bool, prefix: str) -> DataFrame:
    """Values of the previous (or following) row of the same key, for a unique ``(keys, order)``.

    ``df`` comes from ``range_parts``. A plain lag/lead sorts a whole key in one task; here the window
    runs inside ``(partition, key)``, and a row at a partition edge takes its neighbour from the edge
    rows of that key in the nearest partition (one row per key and partition).
    """
    inside = Window.partitionBy(PART, *keys).orderBy(F.col(order).asc_nulls_first())
    step = F.lead if following else F.lag
    carried = F.struct(*[F.col(v) for v in values])
    near = df.withColumn("_near", step(carried).over(inside))

    edge_of = F.min_by if following else F.max_by
    edges = (df.groupBy(PART, *keys)
             .agg(edge_of(carried, F.struct(order)).alias("_edge"))
             .withColumn("_near_edge", step("_edge").over(Window.partitionBy(*keys).orderBy(PART)))
             .where(F.col("_near_edge").isNotNull())
             .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(PART).alias("_p"), "_near_edge"))
    on = [F.col(PART) == F.col("_p")] + [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    pick = F.coalesce("_near", "_near_edge")
    return (near.join(edges, on, "left")
            .select(*df.columns, *[pick[v].alias(f"{prefix}{v}") for v in values]))


def numbered(df: DataFrame, order: list[str], name: str = "row_id", start: int = 1, within: list[str] = ()) -> DataFrame:
    """Consecutive numbers in the given order, over the whole frame or within each key.

    A range partition numbers its own rows and adds the rows of the same key in earlier partitions,
    so neither the frame nor a hot key meets in one task.
    """
    keys = list(within)
    fixed = range_parts(df, keys, order)
    sizes = fixed.groupBy(PART, *keys).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy(PART) if keys else Window.orderBy(PART)
    offsets = sizes.select(F.col(PART).alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                           (F.sum("_n").over(earlier) - F.col("_n")).alias("_before"))
    local = F.row_number().over(Window.partitionBy(PART, *keys).orderBy(*order))
    on = [F.col(PART) == F.col("_p")] + [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return (fixed.withColumn("_local", local).join(offsets, on)
            .select(*df.columns, (F.col("_local") + F.col("_before") + F.lit(start - 1)).cast("long").alias(name)))
