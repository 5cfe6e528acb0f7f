"""Merging into tables that are sliced and bucketed by a digest of their key: a batch moves, the table does not.

Such a table has two columns more: ``_key``, a digest of the key that is never null, and ``_slice``, the partition
that digest falls into. Within a slice rows are bucketed by ``_key``. A batch joins the buckets where they
lie, so only the batch is shuffled, and only the slices it touches are read and written.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, staged, table_exists
from .skew import newest_per_key, quoted

KEY, SLICE, PROPERTY = "_key", "_slice", "lakeproof.buckets"
#: Slices and buckets of a new table; a file holds about a ``slices * buckets``-th of it.
SLICES, BUCKETS = 16, 8


def _digested(df: DataFrame, keys: list[str], slices: int) -> DataFrame:
    digest = F.xxhash64(*[quoted(k) for k in keys])
    return df.withColumn(KEY, digest).withColumn(SLICE, F.pmod(KEY, F.lit(slices)).cast("int"))


def _by_slice(df: DataFrame) -> DataFrame:
    """The frame stored with a folder for each slice, so that a slice is read alone."""
    path = scratch_path(df.sparkSession, "slices")
    df.write.partitionBy(SLICE).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def _dealt(df: DataFrame, slices: int, buckets: int) -> DataFrame:
    """A task for each bucket of each slice, which is one file of the table and all that a task has to sort."""
    return df.repartitionById(slices * buckets, (quoted(SLICE) * buckets + F.pmod(F.hash(KEY), F.lit(buckets))).cast("int"))


def _facts(spark: SparkSession, table: str) -> dict:
    found = spark.sql(f"SHOW TBLPROPERTIES {table}").where(F.col("key") == PROPERTY).first()
    if found is None:
        raise ValueError(f"{table} is no bucketed table")
    return json.loads(found["value"])


def _note(spark: SparkSession, table: str, facts: dict) -> None:
    text = json.dumps(facts).replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{PROPERTY}' = '{text}')")


def _later(facts: dict, rows: DataFrame, order_key: str | None) -> dict:
    """The facts with the newest value of the order key, which bounds what a next increment has to read."""
    if order_key:
        newest = rows.agg(F.max(quoted(order_key)).cast("string")).first()[0]
        kind = rows.schema[order_key].dataType.simpleString()
        known = facts.get("newest")
        both = rows.sparkSession.range(1).select(F.greatest(F.lit(known).cast(kind), F.lit(newest).cast(kind)).cast("string"))
        facts = {**facts, "newest": both.first()[0]}
    return facts


def create_bucketed(df: DataFrame, table: str, keys: list[str], order_key: str | None = None, slices: int = SLICES, buckets: int = BUCKETS) -> None:
    """A new sliced and bucketed table of the newest row of each key (null keys are keys too)."""
    taken = {KEY, SLICE} & {c.lower() for c in df.columns}
    if taken:
        raise ValueError(f"columns of these names are the table's own: {sorted(taken)}")
    best = staged(_digested(newest_per_key(df, keys, [order_key] if order_key else []), keys, slices), "newest")
    (_dealt(best, slices, buckets).write.format("parquet").partitionBy(SLICE).bucketBy(buckets, KEY).sortBy(KEY).saveAsTable(table))
    _note(df.sparkSession, table, _later({"keys": list(keys), "order_key": order_key, "slices": slices, "buckets": buckets}, best, order_key))


def read_bucketed(spark: SparkSession, table: str) -> DataFrame:
    """The rows without the two columns that place them."""
    return spark.table(table).drop(KEY, SLICE)


def newest_merged(spark: SparkSession, table: str):
    """The greatest order key of all rows merged so far, as text; known without reading the table."""
    return _facts(spark, table).get("newest")


def merged_slices(target: DataFrame, best: DataFrame, keys: list[str], order_key: str | None, deleted: str | None) -> DataFrame:
    """The next version of the given slices: the newer row of each key, the batch's on a tie; deleted keys are left out.

    One outer join on the digest; keys are compared as a further condition, so keys of one digest stay apart. The
    target's side keeps the partitioning of its buckets.
    """
    columns = target.columns
    theirs = best.select(*[quoted(c).alias(f"_b_{c}") for c in best.columns])
    same = quoted(KEY) == F.col(f"_b_{KEY}")
    for k in keys:
        mine, new = quoted(k), F.col(f"_b_{k}")
        same = same & F.coalesce(mine == new, mine.isNull() & new.isNull())  # <=> would become a key of the join, and move the table
    arrived, there = F.col(f"_b_{KEY}").isNotNull(), quoted(KEY).isNotNull()
    wins: Column = arrived & ~there
    if order_key is None:
        wins = arrived
    else:
        mine, new = quoted(order_key), F.col(f"_b_{order_key}")
        wins = wins | (arrived & (mine.isNull() | F.coalesce(new >= mine, F.lit(False))))
    joined = target.join(theirs, same, "full_outer").withColumn("_wins", wins)
    if deleted:
        joined = joined.where(~(F.col("_wins") & F.coalesce(F.col(f"_b_{deleted}"), F.lit(False))))
    return joined.select(*[F.when(F.col("_wins"), F.col(f"_b_{c}")).otherwise(quoted(c)).alias(c) for c in columns])


def merge_bucketed(table: str, batch: DataFrame, deleted: str | None = None) -> int:
    """Merge a batch by the table's key and order key; gives the number of slices it touched.

    ``deleted`` names a boolean column of the batch, not of the table: the newest row of a key that has it true removes the key.
    Columns the batch lacks are null in its rows. The touched slices are written beside the old ones and the table is then
    pointed to them slice by slice (a task holds a bucket of one slice), so a run that dies leaves each slice old or new, and running it again gives the same table.
    ``vacuum_bucketed`` removes what the table no longer points to.
    """
    spark, facts = batch.sparkSession, _facts(batch.sparkSession, table)
    keys, order_key = facts["keys"], facts["order_key"]
    own = [c for c in spark.table(table).columns if c not in (KEY, SLICE)]
    have = {c.lower(): c for c in batch.columns}
    kinds = {f.name: f.dataType for f in spark.table(table).schema}
    if {k.lower() for k in keys} - have.keys():
        raise ValueError(f"the batch lacks key columns of {keys}")
    known = [(quoted(have[c.lower()]) if c.lower() in have else F.lit(None)).cast(kinds[c]).alias(c) for c in own]
    given = batch.select(*known, *([quoted(deleted)] if deleted else []))
    best = _by_slice(_digested(newest_per_key(given, keys, [order_key] if order_key else []), keys, facts["slices"]))
    touched = sorted(r[0] for r in best.select(SLICE).distinct().collect())  # at most as many as the table has slices
    if not touched:
        return 0
    slices = [[df.where(F.col(SLICE) == n) for df in (spark.table(table), best)] for n in touched]
    whole = reduce(DataFrame.unionByName, [merged_slices(target, new, keys, order_key, deleted) for target, new in slices])
    version = f"{_folder(spark, table)}/_versions/{uuid.uuid4().hex}"
    stage = f"{table}__slices_{uuid.uuid4().hex[:8]}"
    (whole.write.format("parquet").option("path", version).partitionBy(SLICE).bucketBy(facts["buckets"], KEY).sortBy(KEY).saveAsTable(stage))
    written = {r[0].partition("=")[2] for r in spark.sql(f"SHOW PARTITIONS {stage}").collect()}
    for n in touched:
        if str(n) in written:
            spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS PARTITION (`{SLICE}` = {n})")
            spark.sql(f"ALTER TABLE {table} PARTITION (`{SLICE}` = {n}) SET LOCATION '{version}/{SLICE}={n}'")
        else:  # every key of the slice was deleted
            spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (`{SLICE}` = {n})")
    spark.sql(f"DROP TABLE {stage}")  # its files stay: the path was given, so the table does not own them
    spark.catalog.refreshTable(table)
    _note(spark, table, _later(facts, best, order_key))
    return len(touched)


def _folder(spark: SparkSession, table: str) -> str:
    return spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Location'").first()["data_type"].rstrip("/")


def vacuum_bucketed(spark: SparkSession, table: str) -> int:
    """Remove the folders of earlier merges that no slice points to; gives their number. Readers of older versions must have ended."""
    root = _folder(spark, table)
    used = set()
    for row in spark.sql(f"SHOW PARTITIONS {table}").collect():
        n = row[0].partition("=")[2]
        place = spark.sql(f"DESCRIBE TABLE EXTENDED {table} PARTITION (`{SLICE}` = {n})").where("col_name = 'Location'").first()["data_type"]
        used.add(tuple(place.rstrip("/").split("/")[-2:]))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    top = path(f"{root}/_versions")
    files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    removed = 0
    if files.exists(top):
        for version in files.listStatus(top):
            name, slices = version.getPath().getName(), list(files.listStatus(version.getPath()))
            old = [s.getPath() for s in slices if s.isDirectory() and (name, s.getPath().getName()) not in used]
            for place in old:
                files.delete(place, True)
            removed += len(old)
            if len(old) == sum(s.isDirectory() for s in slices):
                files.delete(version.getPath(), True)
    return removed


def upsert_bucketed(table: str, batch: DataFrame, keys: list[str], order_key: str | None, slices: int = SLICES, buckets: int = BUCKETS) -> None:
    """Merge a batch, or make the table of it where there is none."""
    if table_exists(batch.sparkSession, table):
        merge_bucketed(table, batch)
    else:
        create_bucketed(batch, table, keys, order_key, slices, buckets)
