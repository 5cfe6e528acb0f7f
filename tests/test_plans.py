"""The physical plans must stay the ones a large cluster wants."""

import re
from contextlib import contextmanager

import pytest
from frames import rows
from pyspark.sql import functions as F

from lakeproof.operators import lineage, mapping, profile, quality, reconcile as rec, stitch
from lakeproof.sources import files, writers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("t"))
    df = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") % 5).cast("string").alias("batch_id"), (F.col("id") * 1.5).alias("v"),
                                  F.concat(F.lit("name "), F.col("id").cast("string")).alias("name"), F.lit("x").alias("pt_file_id"))
    writers.write_partitioned(df, "plan_t", ["batch_id"], path + "/t")
    df.write.parquet(path + "/flat")
    return spark.read.parquet(path + "/flat")


def test_a_batch_is_read_by_partition_and_needed_columns_only(spark, tables):
    text = plan(mapping.publish_projection(spark.table("plan_t"), ["k", "sk"], "3", "src"))
    assert re.search(r"PartitionFilters: \[isnotnull\(batch_id#\d+\), \(batch_id#\d+ = 3\)\]", text)
    assert "ReadSchema: struct<k:bigint>" in text


def test_a_slice_reaches_the_scan(tables):
    text = plan(rec.slice_filter(tables, "k > 10").select("v"))
    assert "PushedFilters: [IsNotNull(k), GreaterThan(k,10)]" in text


def test_distinct_counts_are_one_shuffle_of_narrow_pairs(tables):
    text = plan(profile.distinct_counts(tables, ["k", "v", "name"]))
    assert text.count("Exchange hashpartitioning") == 2 and "Expand" in text  # pairs, then one row per column
    shuffled = re.search(r"Exchange hashpartitioning\(i#\d+, h#\d+L, g#\d+L", text)
    assert shuffled and "name#" not in shuffled.group()


def test_row_reconciliation_has_no_join(tables):
    text = plan(rec.reconcile_rows(tables, tables, ["k"]))
    assert "Join" not in text and text.count("Exchange") == 1


@contextmanager
def setting(spark, key, value):
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key)


def test_containment_shrinks_both_sides_before_the_join(spark, tables):
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):  # parents too many to broadcast
        text = plan(rec.check_containment(tables, tables, ["k"]))
    assert text.index("Join") < text.index("partial_count") and "LeftAnti" in text


def test_row_tests_of_a_table_share_one_scan(spark, tables):
    specs = [{"model": "t", "kind": "not_null", "columns": [c]} for c in ("k", "v", "name")]
    assert plan(quality._row_tests(tables, specs)).count("FileScan") == 1


def test_a_side_of_a_reconciliation_is_scanned_twice(spark, tables):
    checks = rec._checks(spark, "p", tables, tables.withColumn("v", F.col("v") + 1), ["k"], (), 1e-6, None, 0.0, None, None, None)
    assert plan(checks).count("FileScan") <= 4


def test_extraction_needs_no_shuffle_and_no_python(spark):
    text = plan(lineage.extract_io(spark.createDataFrame([("a", "b")], "name string, text string")))
    assert "Exchange" not in text and "Python" not in text


def test_top_failures_are_limited_before_the_shuffle(spark):
    from lakeproof.operators.measures import failure_rollup
    df = spark.createDataFrame([("a", [("failed", "m", "f")])], "job string, res array<struct<status:string,message:string,file_name:string>>")
    assert "WindowGroupLimit" in plan(failure_rollup(df, "res", ["job"]))


def test_partition_upsert_leaves_other_partitions_alone(spark, tables, tmp_path):
    writers.write_partitioned(tables.select("k", "v", "batch_id"), "plan_u", ["batch_id"], str(tmp_path / "u"))
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "u").rglob("*.parquet") if "batch_id=1" not in str(p)}
    batch = spark.createDataFrame([(1, -1.0, "1"), (9999, 1.0, "1"), (5, 0.0, None)], "k long, v double, batch_id string")
    for _ in range(2):
        stitch.upsert_partitions("plan_u", batch, ["k", "batch_id"], "v", ["batch_id"])
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "u").rglob("*.parquet") if "batch_id=1" not in str(p) and "HIVE" not in str(p)}
    assert before == after
    got = spark.table("plan_u")
    assert got.count() == 4002 and rows(got.where("k in (1, 9999, 5) and (batch_id = '1' or batch_id is null)"), "k", "v") == sorted(
        [(1, 1.5), (9999, 1.0), (5, 0.0)], key=repr)
    with pytest.raises(ValueError):
        stitch.upsert_partitions("plan_u", batch, ["k"], "v", ["batch_id"])


def test_hot_keys_are_spread_when_rows_are_numbered(spark):
    from lakeproof.operators.skew import PART, range_parts
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    with setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):  # as if the rows were many
        spread = range_parts(df.repartition(4), ["k"], ["id"]).where("k = 'hot'").groupBy(PART).count()
    assert spread.count() > 1


def test_archive_listing_reads_no_contents(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x" * 10)
    df = files.landed_files(spark, str(tmp_path))
    assert "content" not in plan(df) and df.first()["length"] == 10
