import datetime
import random

import pytest
from frames import rows
from pyspark.sql import functions as F

from lakeproof.operators import ranges, reconcile


def both_ways(src, cand, key, **more):
    a = rows(reconcile.reconcile_rows(src, cand, key, **more))
    b = rows(ranges.reconcile_rows_by_ranges(src, cand, key, **more))
    assert a == b
    return a


def made(spark, seed, many=400, keys=range(-50, 60)):
    draw = random.Random(seed)
    data = [(draw.choice([None, *keys]), draw.choice(["x", None, "y"]), draw.choice([1.5, None, float("nan"), 0.0]), draw.randrange(5)) for _ in range(many)]
    return spark.createDataFrame(data, "k int, t string, v double, n int")


@pytest.mark.parametrize("key", [["k"], ["t", "k"]])
def test_the_same_rows_as_comparing_all_of_them(spark, key):
    src = made(spark, 1)
    cand = src.withColumn("v", F.when(F.col("k") == 7, 9.0).otherwise(F.col("v"))).where("k is null or k <> -3").unionByName(
        spark.createDataFrame([(10**6, "new", 1.0, 1), (None, "null", 1.0, 1), (-(10**6), None, 1.0, 1)], "k int, t string, v double, n int"))
    assert both_ways(src, cand, key)
    assert both_ways(src, src, key) == []
    assert both_ways(src, src.where("false"), key) and both_ways(src.where("false"), src, key)
    assert both_ways(src.where("false"), src.where("false"), key) == []


def test_keys_of_other_types_extremes_and_dates(spark):
    src = made(spark, 2)
    assert both_ways(src, src.withColumn("k", F.col("k").cast("bigint")).withColumn("n", F.col("n") + F.lit(0)), ["k"]) == []
    text = src.withColumn("k", F.col("k").cast("string"))
    assert both_ways(src, text, ["k"]) == []
    assert both_ways(src, text.where("k <> '8'"), ["k"])
    wide = spark.createDataFrame([(-(2**63), 1), (2**63 - 1, 2), (0, 3), (None, 4)], "k long, v int")
    assert both_ways(wide, wide.where("v <> 2"), ["k"]) == [(2**63 - 1, "missing", 1, 0, [])]
    days = spark.createDataFrame([(datetime.date(2000, 1, 1) + datetime.timedelta(37 * i), i) for i in range(300)] + [(None, 1)], "d date, v int")
    changed = days.withColumn("v", F.when(F.col("v").isin(5, 250), -1).otherwise(F.col("v")))
    assert len(both_ways(days, changed, ["d"])) == 2


def test_tolerance_and_values_that_move_between_rows_of_a_key(spark):
    src = spark.createDataFrame([(i, float(i), "a") for i in range(200)], "k int, v double, t string")
    cand = src.withColumn("v", F.col("v") + F.when(F.col("k") == 9, 1.0).when(F.col("k") == 150, 1e-9).otherwise(0.0))
    assert [r[0] for r in both_ways(src, cand, ["k"], tol=1e-6)] == [9]
    assert [r[0] for r in both_ways(src, cand, ["k"], col_tol={"t": 0.0})] == [150, 9]
    twice = spark.createDataFrame([(1, 1.0, "a"), (1, 2.0, "b")], "k int, v double, t string")
    crossed = spark.createDataFrame([(1, 1.0, "b"), (1, 2.0, "a")], "k int, v double, t string")
    both_ways(twice, crossed, ["k"])


def test_only_ranges_that_differ_are_compared_and_read(spark, tmp_path):
    spark.range(0, 200_000, 1, 8).selectExpr("id as k", "id % 7 as v").write.parquet(str(tmp_path / "a"))
    src = spark.read.parquet(str(tmp_path / "a"))
    cand = src.withColumn("v", F.when(F.col("k").isin(3, 100_001, 100_002), -1).otherwise(F.col("v")))
    plan = ranges.plan_ranges(src, cand, ["k"], fanout=64, levels=2)
    a, b = (ranges.range_digests(df, plan) for df in (src, cand))
    found, compared = ranges.differing_ranges(a, b, plan)
    assert len(found) == 2 and compared == [64, 2 * 64]
    assert ranges.differing_ranges(a, a, plan) == ([], [64])
    part = src.where(plan.within(found))
    assert part.count() < 200 and "PushedFilters: [Or(And(GreaterThanOrEqual(k," in part._jdf.queryExecution().executedPlan().toString()
    equal = ranges.reconcile_rows_by_ranges(src, src, ["k"])
    assert "Scan" not in equal._jdf.queryExecution().optimizedPlan().toString().replace("LocalTableScan", "")
    assert "Relation" not in equal._jdf.queryExecution().optimizedPlan().toString().replace("LocalRelation", "")


def test_stored_digests_stand_for_a_side(spark, tmp_path):
    src = made(spark, 3)
    cand = src.where("k is null or k <> 11")
    plan = ranges.plan_ranges(src, cand, ["k"])
    ranges.range_digests(src, plan).write.parquet(str(tmp_path / "digests"))
    kept = spark.read.parquet(str(tmp_path / "digests"))
    got = rows(ranges.reconcile_rows_by_ranges(src, cand, ["k"], plan=plan, stored=(kept, None)))
    assert got == rows(reconcile.reconcile_rows(src, cand, ["k"])) and got
    later = src.unionByName(spark.createDataFrame([(5000, "beyond", 1.0, 1)], src.schema))  # a key the plan did not know
    assert [r[0] for r in rows(ranges.reconcile_rows_by_ranges(src, later, ["k"], plan=plan, stored=(kept, None)))] == [5000]
    with pytest.raises(ValueError):
        ranges.reconcile_rows_by_ranges(src, cand, ["k"], stored=(kept, None))


def test_runs_keep_the_widest_gaps():
    assert ranges.joined_runs([1, 2, 3, 7, 9, 100, 101], 9) == [(1, 3), (7, 7), (9, 9), (100, 101)]
    assert ranges.joined_runs([1, 2, 3, 7, 9, 100, 101], 2) == [(1, 9), (100, 101)]
    assert ranges.joined_runs([5, 1], 1) == [(1, 5)] and ranges.joined_runs([], 4) == []
