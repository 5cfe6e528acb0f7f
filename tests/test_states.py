import random

from frames import rows
from pyspark.sql import functions as F

from lakeproof.operators import profile, states
from lakeproof.sources import writers


def made(spark, seed, days=range(5), many=300):
    draw = random.Random(seed)
    data = [(draw.choice([None, *days]), draw.choice([None, "a b", "c+d", "é/%41", ""]), draw.choice([None, -1.25, 0.5, 3.0]), draw.choice([None, 10**17, 7]),
             draw.choice([None, [1], [2, 3]])) for _ in range(many)]
    return spark.createDataFrame(data, "day int, kind string, v double, big long, more array<int>")


def same_but_distinct(got, df, cols):
    exact = {(c, m): v for c, m, v in rows(profile.column_fingerprint(df, cols, scale=2))}
    found = {(c, m): v for c, m, v in rows(got)}
    assert found.keys() == exact.keys()
    for k, v in exact.items():
        assert found[k] == v or (k[1] == "distinct" and abs(float(found[k]) - float(v)) <= max(0.5, 3 * states.sketch_error() * float(v))), k


def test_partial_states_add_up_to_the_fingerprint(spark):
    df = made(spark, 1)
    cols = ["v", "big", "more", "kind"]
    same_but_distinct(states.merged_fingerprint(states.partition_states(df, ["day"], cols, scale=2), cols), df, cols)
    none = df.where("false")
    same_but_distinct(states.merged_fingerprint(states.partition_states(none, ["day"], cols, scale=2), cols), none, cols)


def test_the_error_of_merged_sketches_holds(spark):
    df = spark.range(120_000).selectExpr("id % 40 as p", "id", "cast(id % 30011 as string) as t", "id % 7 as few")
    for size in (8, 12):
        out = {(c, m): float(v) for c, m, v in rows(states.merged_fingerprint(states.partition_states(df, ["p"], size=size), ["id", "t", "few"])) if m == "distinct"}
        for c, n in (("id", 120_000), ("t", 30_011), ("few", 7)):
            assert abs(out[c, "distinct"] - n) <= 3 * states.sketch_error(size) * n


def test_only_changed_partitions_are_read_again(spark, tmp_path):
    path, kept, cols = str(tmp_path / "t"), str(tmp_path / "states"), ["v", "big", "more"]
    by = ["day", "kind"]
    df = made(spark, 2)
    df.write.partitionBy(*by).parquet(path)
    parts = df.select(*by).withColumn("kind", F.nullif("kind", F.lit(""))).distinct().count()
    refresh = lambda: states.refresh_states(spark, path, by, kept, cols, scale=2)
    held, read = refresh()
    assert read == parts == held.count()
    same_but_distinct(states.merged_fingerprint(held, cols), df, cols)
    held, read = refresh()
    assert read == 0 and sorted(p.name for p in (tmp_path / "states").iterdir()) == ["v=0"]
    extra = spark.createDataFrame([(3, "c+d", 9.5, 1, [9]), (77, "new", 1.0, 2, None), (None, None, 4.0, 3, None)], df.schema)
    extra.write.mode("append").partitionBy(*by).parquet(path)
    held, read = refresh()
    assert read == 3 and held.count() == parts + 1
    same_but_distinct(states.merged_fingerprint(held, cols), df.unionByName(extra), cols)
    day3 = df.unionByName(extra).where("day = 3").withColumn("v", F.lit(2.0))
    with writers.dynamic_overwrite(spark):
        day3.write.mode("overwrite").partitionBy(*by).parquet(path)
    import shutil
    shutil.rmtree(f"{path}/day=77")
    held, read = refresh()
    left = df.unionByName(extra).where("day is null or day not in (3, 77)").unionByName(day3)
    assert read == day3.select("kind").withColumn("kind", F.nullif("kind", F.lit(""))).distinct().count()
    same_but_distinct(states.merged_fingerprint(held, cols), left, cols)


def test_a_version_that_was_not_finished_is_no_version(spark, tmp_path):
    path, kept = str(tmp_path / "t"), str(tmp_path / "states")
    made(spark, 4).write.partitionBy("day").parquet(path)
    states.refresh_states(spark, path, ["day"], kept, ["v"])
    held, _ = states.refresh_states(spark, path, ["day"], kept, ["v"])
    n = held.count()
    spark.createDataFrame([(9, "a", 1.0, 1, None)], made(spark, 4).schema).write.mode("append").partitionBy("day").parquet(path)
    held, read = states.refresh_states(spark, path, ["day"], kept, ["v"])
    assert (read, held.count()) == (1, n + 1)
    (tmp_path / "states" / "v=1" / "_SUCCESS").unlink()
    held, read = states.refresh_states(spark, path, ["day"], kept, ["v"])
    assert (read, held.count()) == (1, n + 1)
