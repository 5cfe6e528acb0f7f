"""Merge modes that turn a batch and a target into the next version of the target.

The lake's tables are plain files without MERGE, so every mode is a DataFrame; write the result with
``sources.writers.replace_table`` or, where keys decide the partition, ``write_partitioned``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, table_exists
from ..sources.writers import write_partitioned
from .skew import neighbour, newest_per_key, quoted, range_parts

KINDS = ("full", "append", "upsert", "delete_flag", "roll_out", "scd2")


def _on(keys: list[str], prefix: str = "_b_") -> Column:
    cond = quoted(keys[0]).eqNullSafe(F.col(prefix + keys[0]))
    for k in keys[1:]:
        cond = cond & quoted(k).eqNullSafe(F.col(prefix + k))
    return cond


def _renamed(df: DataFrame, cols: list[str], prefix: str = "_b_") -> DataFrame:
    return df.select(*[quoted(c).alias(prefix + c) for c in cols])


def stitch_full(target: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch is the table."""
    return batch


def stitch_append(target: DataFrame, batch: DataFrame, load_key: str) -> DataFrame:
    """Target plus batch; rows the target holds for the batch's own load keys are replaced, so a
    repeated run adds nothing."""
    loads = _renamed(batch.select(load_key).distinct(), [load_key])
    return target.join(loads, _on([load_key]), "left_anti").unionByName(batch)


def stitch_upsert(target: DataFrame, batch: DataFrame, keys: list[str], order_key: str | None = None) -> DataFrame:
    """The newest row of every key wins, other target rows stay; on a tie the batch wins.

    The target (one row per key) is only filtered against the batch's keys: while those fit a
    broadcast, Spark never shuffles it. The reduced batch is written to the checkpoint folder, as
    several joins read it.
    """
    best = cut_lineage(newest_per_key(batch, keys, [order_key] if order_key else []))
    if order_key is None:
        return target.join(_renamed(best, keys), _on(keys), "left_anti").unionByName(best)
    theirs, ours = quoted(order_key), F.col(f"_b_{order_key}")
    replaced = theirs.isNull() | F.coalesce(ours >= theirs, F.lit(False))
    kept = target.join(_renamed(best, [*keys, order_key]), _on(keys) & replaced, "left_anti")
    touched = target.select(*keys, order_key).join(_renamed(best, keys), _on(keys), "left_semi")
    newer = _renamed(touched, [*keys, order_key])
    stale = F.coalesce(ours > theirs, theirs.isNull() & ours.isNotNull())
    fresh = best.join(newer, _on(keys) & stale, "left_anti")
    return kept.unionByName(fresh)


def upsert_partitions(table: str, batch: DataFrame, keys: list[str], order_key: str, by: list[str]) -> None:
    """Upsert into a partitioned table, reading and rewriting only the partitions the batch touches.

    The partition columns must be part of the key, so that no row moves between partitions. The
    touched values prune the partitions read, the write replaces just those, and running it again
    changes nothing.
    """
    if not {b.lower() for b in by} <= {k.lower() for k in keys}:
        raise ValueError("the partition columns must be key columns")
    spark = batch.sparkSession
    if not table_exists(spark, table):
        write_partitioned(newest_per_key(batch, keys, [order_key]), table, by)
        return
    target = spark.table(table)
    touched = cut_lineage(batch.select(*by).distinct())
    part = target
    for column in by:  # as many values as partitions touched, which the write's commit lists anyway
        values = [r[0] for r in touched.select(column).distinct().collect()]
        known = [v for v in values if v is not None]
        hit = quoted(column).isin(known) if known else F.lit(False)
        part = part.where(hit | quoted(column).isNull() if len(known) < len(values) else hit)
    part = part.join(_renamed(touched, by), _on(by), "left_semi").select(*target.columns)
    write_partitioned(stitch_upsert(part, batch.select(*target.columns), keys, order_key), table, by)


def stitch_delete_flag(target: DataFrame, snapshot: DataFrame, keys: list[str], order_key: str | None = None,
                       flag: str = "is_deleted") -> DataFrame:
    """The batch is a full snapshot: its newest row per key is live, keys it lacks are flagged Y."""
    best = cut_lineage(newest_per_key(snapshot, keys, [order_key] if order_key else []))
    gone = target.drop(flag).join(_renamed(best, keys), _on(keys), "left_anti")
    return best.withColumn(flag, F.lit("N")).unionByName(gone.withColumn(flag, F.lit("Y")))


def stitch_roll_out(target: DataFrame, batch: DataFrame, load_key: str, window: tuple) -> DataFrame:
    """Rows whose load key left the window ``(low, high)`` roll out, then the batch is appended."""
    inside = quoted(load_key).between(F.lit(window[0]), F.lit(window[1]))
    return stitch_append(target.where(inside), batch, load_key)


def attribute_digest(df: DataFrame, keys: list[str], order_key: str) -> Column:
    """128 bits over all columns but key and order, with the NULLs of each column told apart."""
    skip = {c.lower() for c in (*keys, order_key)}
    cells = [x for c in df.columns if c.lower() not in skip for x in (quoted(c), quoted(c).isNull())]
    return F.struct(F.xxhash64(F.lit(0), *cells).alias("h"), F.xxhash64(F.lit(1), *cells).alias("g"))


def _history(versions: DataFrame, keys: list[str], order_key: str, names: list[str]) -> DataFrame:
    """Change points with the time of the next one, and the confirmations between them.

    Rows are spread by key and time, so that a key with any number of versions takes as many tasks as
    it needs; only partition edges are stitched.
    """
    parts = range_parts(versions, keys, [order_key])
    seen = neighbour(parts, keys, order_key, ["_digest"], following=False, prefix="_before")
    marked = cut_lineage(seen.withColumn("_change", ~F.col("_digest").eqNullSafe(F.col("_before_digest"))))
    real = neighbour(marked.where("_change").withColumn("_at", quoted(order_key)), keys, order_key, ["_at"], following=True, prefix="_next")
    own = [*[quoted(c) for c in names], quoted(order_key).alias("valid_from")]
    points = real.select(*own, F.col("_next_at").alias("valid_to"), F.col("_next_at").isNull().alias("is_current"), F.lit(True).alias("is_version"))
    repeats = marked.where("not _change").select(
        *own, F.lit(None).cast(points.schema["valid_to"].dataType).alias("valid_to"), F.lit(False).alias("is_current"), F.lit(False).alias("is_version"))
    return points.unionByName(repeats)


def stitch_scd2(target: DataFrame | None, batch: DataFrame, keys: list[str], order_key: str) -> DataFrame:
    """History with ``valid_from``, ``valid_to`` (NULL while open), ``is_current`` and ``is_version``.

    A row equal to the one before it is no version but a confirmation (``is_version`` false): it stays
    in the history, because a late row may fall between the two and make it a version again. So every
    split of a feed into batches, in any order and with repeats, gives the same history. Keys the
    batch touches are rebuilt from history and batch together; other keys pass through.
    """
    names = batch.columns
    versions = batch.select(*names, F.lit(1).alias("_from_batch"))
    rest = None
    if target is not None:
        touched = _renamed(batch.select(*keys).distinct(), keys)
        rest = target.join(touched, _on(keys), "left_anti")
        history = target.join(touched, _on(keys), "left_semi")
        versions = versions.unionByName(history.select(*names, F.lit(0).alias("_from_batch")))
    single = newest_per_key(versions, [*keys, order_key], ["_from_batch"]).drop("_from_batch")
    rebuilt = _history(single.withColumn("_digest", attribute_digest(single, keys, order_key)), keys, order_key, names)
    return rebuilt if rest is None else rest.unionByName(rebuilt)


def stitch(target: DataFrame, batch: DataFrame, kind: str, keys: list[str] = (), order_key: str | None = None,
           load_key: str | None = None, window: tuple | None = None) -> DataFrame:
    """Apply the merge mode a stitching configuration names."""
    keys = list(keys)
    if kind == "full":
        return stitch_full(target, batch)
    if kind == "append":
        return stitch_append(target, batch, load_key)
    if kind == "upsert":
        return stitch_upsert(target, batch, keys, order_key)
    if kind == "delete_flag":
        return stitch_delete_flag(target, batch, keys, order_key)
    if kind == "roll_out":
        return stitch_roll_out(target, batch, load_key, window)
    if kind == "scd2":
        return stitch_scd2(target, batch, keys, order_key)
    raise ValueError(f"unknown stitching type {kind!r}; known: {', '.join(KINDS)}")
