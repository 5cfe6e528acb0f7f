import random

import pytest
from frames import rows
from pyspark.sql import functions as F

from lakeproof.operators import ledger, stitch
from lakeproof.operators.skew import newest_per_key, numbered
from lakeproof.sources import writers
from lakeproof.suite import QUERIES


def versions(feed):
    """Brute-force history: change points per key in time order, the last one open."""
    out = []
    for k in {r[0] for r in feed}:
        seq = {}
        for _, ts, v in sorted((r for r in feed if r[0] == k), key=lambda r: (r[1], r[2])):
            seq[ts] = v
        kept = []
        for ts in sorted(seq):
            if not kept or kept[-1][1] != seq[ts]:
                kept.append((ts, seq[ts]))
        out += [(k, v, ts, nxt, nxt is None) for (ts, v), nxt in zip(kept, [t for t, _ in kept[1:]] + [None])]
    return sorted(out, key=repr)


def history_of(spark, parts):
    history = None
    for part in parts:
        history = stitch.stitch_scd2(history, spark.createDataFrame(part, "k int, ts int, v int"), ["k"], "ts")
    return rows(history.where("is_version"), "k", "v", "valid_from", "valid_to", "is_current")


def test_late_rows_rebuild_the_history_of_their_key(spark):
    feed = [(1, 10, 0), (1, 30, 2), (2, 5, 7)]
    late = [(1, 20, 1), (1, 40, 2), (1, 5, 0)]
    assert history_of(spark, [feed, late, late]) == versions(feed + late)


def test_every_split_of_a_feed_gives_the_same_history(spark):
    feed = [(1, 1, 0), (1, 2, 0), (1, 3, 1), (1, 5, 0)]
    for order in ((0, 3, 2, 1), (3, 0, 1, 2), (2, 1, 3, 0)):
        assert history_of(spark, [[feed[i]] for i in order]) == versions(feed)
    assert history_of(spark, [[feed[0], feed[3]], [feed[2]], [feed[1]]]) == versions(feed)


def test_history_equals_brute_force_on_ordered_batches(spark):
    rng = random.Random(4)
    feed = sorted({(1 if rng.random() < 0.5 else rng.randint(2, 6), ts, rng.randint(0, 1)) for ts in range(800)}, key=lambda r: r[1])
    parts = [feed[a:b] for a, b in ((0, 300), (250, 600), (600, 800), (600, 800))]
    assert history_of(spark, parts) == versions(feed)


def test_tables_of_another_partitioning_are_refused_and_swaps_keep_theirs(spark):
    df = spark.createDataFrame([("crm", "a", 1), ("erp", "b", 2)], "src string, p string, v int")
    writers.write_partitioned(df, "guard_t", ["src"])
    with pytest.raises(ValueError):
        writers.write_partitioned(df, "guard_t", ["p"])
    writers.replace_table(spark.table("guard_t").withColumn("v", F.col("v") + 1), "guard_t")
    assert writers.partition_columns(spark, "guard_t") == ["src"]
    writers.write_partitioned(spark.createDataFrame([("a", 9, "crm")], "p string, v int, src string"), "guard_t", ["src"])
    assert rows(spark.table("guard_t"), "src", "v") == [("crm", 9), ("erp", 3)]
    writers.drop_partitions(spark, "guard_t", [{"src": "crm"}, {"src": "it's not there"}])
    assert rows(spark.table("guard_t"), "src", "v") == [("erp", 3)]


def test_upsert_keeps_newer_target_rows_and_unseen_keys(spark):
    target = spark.createDataFrame([(1, 10, "t"), (2, 10, "t"), (3, 10, "t"), (None, 1, "t"), (5, None, "t")], "k int, ts int, v string")
    batch = spark.createDataFrame([(1, 11, "b"), (1, 12, "b2"), (2, 9, "old"), (4, 1, "new"), (None, 2, "bn"), (5, 1, "b"), (3, 10, "tie")], "k int, ts int, v string")
    out = stitch.stitch(target, batch, "upsert", ["k"], "ts")
    assert rows(out) == sorted([(1, 12, "b2"), (2, 10, "t"), (3, 10, "tie"), (4, 1, "new"), (None, 2, "bn"), (5, 1, "b")], key=repr)
    assert rows(stitch.stitch(out, batch, "upsert", ["k"], "ts")) == rows(out)
    assert rows(stitch.stitch(target.drop("ts"), batch.select("k", "v").where("k = 4"), "upsert", ["k"]), "k") == sorted([(1,), (2,), (3,), (4,), (None,), (5,)], key=repr)


def test_delete_flag_append_and_roll_out(spark):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, load int")
    snap = spark.createDataFrame([(2, "b2", 2), (3, "c", 2)], "k int, v string, load int")
    assert rows(stitch.stitch(target, snap, "delete_flag", ["k"]), "k", "v", "is_deleted") == [(1, "a", "Y"), (2, "b2", "N"), (3, "c", "N")]
    once = stitch.stitch(target, snap, "append", load_key="load")
    assert rows(stitch.stitch(once, snap, "append", load_key="load")) == rows(once) and once.count() == 4
    assert rows(stitch.stitch(target, snap, "roll_out", load_key="load", window=(2, 9)), "k") == [(2,), (3,)]
    with pytest.raises(ValueError):
        stitch.stitch(target, snap, "sideways")


def test_newest_per_key_breaks_ties_by_all_columns(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, None, "z"), (None, 1, "n")], "k int, o int, v string")
    assert rows(newest_per_key(df, ["k"], ["o"])) == [(1, 5, "b"), (None, 1, "n")]


def test_numbers_are_consecutive_within_a_hot_key(spark):
    data = [("hot", i) for i in range(700)] + [("cold", i) for i in range(50)] + [(None, i) for i in range(20)]
    random.Random(1).shuffle(data)
    df = spark.createDataFrame(data, "k string, o int")
    assert rows(numbered(df, ["o"], within=["k"])) == sorted([(k, o, o + 1) for k, o in data], key=repr)
    assert [r["row_id"] for r in numbered(df, ["k", "o"], start=10).orderBy("row_id").collect()] == list(range(10, 780))


def test_partition_overwrite_and_swap(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string")
    writers.write_partitioned(df, "parts_t", ["p"], str(tmp_path / "t"))
    for _ in range(2):
        writers.write_partitioned(df.where("p = 'b'").withColumn("v", F.lit(9)), "parts_t", ["p"])
    assert rows(spark.table("parts_t"), "v", "p") == [(1, "a"), (9, "b")]
    writers.replace_table(df, "swap_t")
    writers.replace_table(spark.table("swap_t").where("v = 1"), "swap_t")  # reads what it replaces
    assert rows(spark.table("swap_t"), "v") == [(1,)]
    spark.sql("ALTER TABLE swap_t RENAME TO swap_t__retired")  # a swap that died between its two renames
    writers.recover_table(spark, "swap_t")
    assert spark.table("swap_t").count() == 1


def test_batch_ledger(spark):
    assert ledger.batch_open(spark, "led", "b1", "crm") and not ledger.batch_open(spark, "led", "b1", "crm")
    ledger.batch_close(spark, "led", "b1", "C")
    ledger.batch_open(spark, "led", "b2", "crm")
    assert rows(ledger.batch_state(spark.table("led")), "parent_batch_id", "source_system", "process_status") == [
        ("b1", "crm", "Completed"), ("b2", "crm", "In Progress")]
    with pytest.raises(ValueError):
        ledger.batch_close(spark, "led", "b1", "X")
    before, files = rows(spark.table("led")), len(spark.table("led").inputFiles())
    ledger.compact_ledger(spark, "led")
    assert rows(spark.table("led")) == before and len(spark.table("led").inputFiles()) < files


def test_batch_summary_does_not_fan_out(spark):
    batches = spark.createDataFrame([("b1",), ("b2",)], "parent_batch_id string")
    files = spark.createDataFrame([("b1", 1), ("b1", 2), ("b1", 2)], "parent_batch_id string, file_id int")
    ing = spark.createDataFrame([("b1", 7), ("b1", 8), ("b1", 9)], "batch_id string, file_id int")
    assert rows(ledger.batch_summary(batches, files, ing)) == [("b1", 2, 3), ("b2", 0, 0)]


def test_file_audit_counts_every_event_type(spark, tmp_path):
    kinds = ["click", "refund", None, None, "view"]
    spark.createDataFrame([(i, k) for i, k in enumerate(kinds)], "user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    got = {(r["source_object_name"], r["layer"]): r["row_count"] for r in QUERIES["file_audit"](spark, str(tmp_path)).collect()}
    assert got == {("click", "bronze"): 1, ("refund", "bronze"): 1, (None, "bronze"): 2, ("view", "bronze"): 1}
