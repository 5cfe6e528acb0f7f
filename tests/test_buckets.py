import random

import pytest
from frames import rows

from lakeproof.operators import buckets, stitch
from lakeproof.plans import models
from lakeproof.streaming import landing

SCHEMA = "a string, b int, at int, v string"


def made(seed, many, newest):
    draw = random.Random(seed)
    return [(draw.choice(["x", "y", None, "z" * 3]), draw.choice([None, *range(20)]), draw.choice([None, *range(newest)]), f"{seed}-{i}") for i in range(many)]


def plain(*batches):
    held = {}
    for batch in batches:
        best = {}
        for r in batch:
            k = r[:2]
            if k not in best or tuple((x is not None, x or 0 if not isinstance(x, str) else x) for x in r[2:]) > tuple(
                    (x is not None, x or 0 if not isinstance(x, str) else x) for x in best[k][2:]):
                best[k] = r
        for k, r in best.items():
            old = held.get(k)
            if old is None or old[2] is None or (r[2] is not None and r[2] >= old[2]):
                held[k] = r
    return sorted(held.values(), key=repr)


@pytest.fixture
def table(spark):
    name = f"bucketed_{random.randrange(10**9)}"
    yield name
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_batches_merge_like_the_plain_version_and_like_the_upsert_of_whole_tables(spark, table):
    batches = [made(1, 200, 9), made(2, 60, 12), made(3, 5, 30), made(3, 5, 30)]
    frames = [spark.createDataFrame(b, SCHEMA) for b in batches]
    buckets.create_bucketed(frames[0], table, ["a", "b"], "at", slices=7, buckets=3)
    for f in frames[1:]:
        buckets.merge_bucketed(table, f)
    got = rows(buckets.read_bucketed(spark, table))
    assert got == plain(*batches)
    whole = spark.createDataFrame(plain(batches[0]), SCHEMA)
    for f in frames[1:]:
        whole = stitch.stitch_upsert(whole, f, ["a", "b"], "at")
    assert rows(whole) == got
    assert buckets.newest_merged(spark, table) == str(max(r[2] or 0 for b in batches for r in b))


def test_the_table_is_not_shuffled_and_other_slices_are_neither_read_nor_written(spark, table):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        buckets.create_bucketed(spark.range(5000).selectExpr("id", "0L as at", "id % 3 as v"), table, ["id"], "at", slices=8, buckets=4)
        target = spark.table(table)
        batch = buckets._digested(spark.range(40).selectExpr("id", "1L as at", "5L as v"), ["id"], 8)
        plan = buckets.merged_slices(target, batch, ["id"], "at", None)._jdf.queryExecution().executedPlan().toString()
        exchanges = [line for line in plan.splitlines() if "Exchange" in line]
        assert len(exchanges) == 1 and "_b__key" in exchanges[0] and "Bucketed: true" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    before = {tuple(r) for r in spark.table(table).selectExpr("_slice", "_metadata.file_path").distinct().collect()}
    one = spark.sql("select 17L as id, 2L as at, 9L as v")
    assert buckets.merge_bucketed(table, one) == 1
    after = {tuple(r) for r in spark.table(table).selectExpr("_slice", "_metadata.file_path").distinct().collect()}
    assert len({s for s, _ in before ^ after}) == 1
    assert spark.table(table).count() == 5000 and rows(spark.table(table).where("v = 9"), "id") == [(17,)]
    changed = buckets.merged_slices(spark.table(table).where("_slice in (3)"), batch, ["id"], "at", None)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_slice" in changed


def test_a_merge_that_died_half_way_is_finished_by_running_it_again(spark, table, monkeypatch):
    first, second = made(5, 100, 5), made(6, 80, 9)
    buckets.create_bucketed(spark.createDataFrame(first, SCHEMA), table, ["a", "b"], "at", slices=6, buckets=2)
    real, done = type(spark).sql, []

    def dying(self, text, *more, **named):
        if "SET LOCATION" in text:
            done.append(text)
            if len(done) == 3:
                raise RuntimeError("lost")
        return real(self, text, *more, **named)

    monkeypatch.setattr(type(spark), "sql", dying)
    with pytest.raises(RuntimeError):
        buckets.merge_bucketed(table, spark.createDataFrame(second, SCHEMA))
    monkeypatch.undo()
    buckets.merge_bucketed(table, spark.createDataFrame(second, SCHEMA))
    assert rows(buckets.read_bucketed(spark, table)) == plain(first, second)
    assert buckets.vacuum_bucketed(spark, table) > 0 and buckets.vacuum_bucketed(spark, table) == 0
    assert rows(buckets.read_bucketed(spark, table)) == plain(first, second)


def test_deletions_missing_columns_and_empty_batches(spark, table):
    buckets.create_bucketed(spark.createDataFrame([("x", 1, 1, "p"), ("x", 2, 5, "q"), (None, None, 1, "r")], SCHEMA), table, ["a", "b"], "at", slices=2, buckets=2)
    assert buckets.merge_bucketed(table, spark.createDataFrame([], SCHEMA)) == 0
    gone = spark.createDataFrame([("x", 1, 2, True), ("x", 2, 4, True), ("y", 9, 1, True), (None, None, 3, None)], "a string, b int, at int, gone boolean")
    buckets.merge_bucketed(table, gone, deleted="gone")
    assert rows(buckets.read_bucketed(spark, table)) == [("x", 2, 5, "q"), (None, None, 3, None)] or rows(
        buckets.read_bucketed(spark, table)) == [(None, None, 3, None), ("x", 2, 5, "q")]
    everything = buckets.read_bucketed(spark, table).selectExpr("a", "b", "100 as at", "true as gone")
    buckets.merge_bucketed(table, everything, deleted="gone")
    assert rows(spark.table(table)) == []
    buckets.merge_bucketed(table, spark.createDataFrame([("x", 1, 1, "again")], SCHEMA))
    assert rows(buckets.read_bucketed(spark, table)) == [("x", 1, 1, "again")]
    with pytest.raises(ValueError):
        buckets.merge_bucketed(table, spark.createDataFrame([(1,)], "b int"))
    with pytest.raises(ValueError):
        buckets.create_bucketed(spark.createDataFrame([(1,)], "_key int"), table + "_no", ["_key"])


def test_streams_and_increments_merge_into_buckets(spark, table):
    merge = landing.upsert_batch(table, ["a", "b"], "at", slices=4)
    batches = [made(7, 50, 5), made(8, 50, 9)]
    for i, b in enumerate([*batches, batches[1]]):
        merge(spark.createDataFrame(b, SCHEMA), i)
    assert rows(buckets.read_bucketed(spark, table)) == plain(*batches)
    asked = []

    def build(_, since):
        asked.append(since)
        return spark.createDataFrame([("k", len(asked))], "k string, at int")

    for _ in range(3):
        models.incremental_model(spark, build, table + "_model", ["k"], "at", slices=2)
    assert asked == [None, 1, 2] and rows(buckets.read_bucketed(spark, table + "_model")) == [("k", 3)]
    spark.sql(f"DROP TABLE {table}_model")


def test_a_task_holds_one_bucket_of_one_slice(spark, table, monkeypatch):
    frame = spark.range(3000).selectExpr("id", "0L as at")
    dealt = buckets._dealt(buckets._digested(frame, ["id"], 4), 4, 3)
    held = dealt.selectExpr("spark_partition_id() as p", "_slice", "pmod(hash(_key), 3) as bucket").distinct()
    assert sorted(r["p"] for r in held.collect()) == list(range(12))
    buckets.create_bucketed(frame, table, ["id"], "at", slices=4, buckets=3)
    seen, real = [], buckets.merged_slices

    def noted(target, best, *rest):
        seen.append({tuple(r) for df in (target, best) for r in df.select("_slice").distinct().collect()})
        return real(target, best, *rest)

    monkeypatch.setattr(buckets, "merged_slices", noted)
    assert buckets.merge_bucketed(table, frame.selectExpr("id * 2 as id", "1L as at")) == 4
    assert seen == [{(n,)} for n in range(4)]
    files = spark.table(table).selectExpr("_slice", "_metadata.file_path as f").distinct()
    assert files.count() == 12 and spark.table(table).count() == 4500
