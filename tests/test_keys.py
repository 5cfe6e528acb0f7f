import random
from itertools import combinations

import pytest

from lakeproof.operators import keys


def brute(rows, names, most):
    able = [i for i in range(len(names)) if all(r[i] is not None for r in rows)]
    found = []
    for size in range(1, most + 1):
        for s in combinations(able, size):
            if rows and not any(set(k) <= set(s) for k in found) and len({tuple(r[i] for i in s) for r in rows}) == len(rows):
                found.append(s)
    return {tuple(names[i] for i in s) for s in found}


@pytest.mark.parametrize("seed", range(4))
def test_keys_against_brute_force(spark, seed):
    draw, names = random.Random(seed), ["a", "b c", "d", "e", "n"]
    rows = [(draw.randrange(12), draw.choice("xyzuvw"), draw.randrange(6) + 0.5, i % 9, draw.choice([None, 1, 2])) for i in range(60)]
    rows = list(dict.fromkeys(rows)) if seed % 2 else rows
    got = keys.minimal_keys(spark.createDataFrame(rows, "a int, `b c` string, d double, e int, n int"), most=4)
    assert {tuple(r["columns"]) for r in got.collect()} == brute(rows, names, 4)


def test_one_column_repeated_rows_and_nothing(spark):
    df = spark.range(500).selectExpr("id", "id % 7 as k", "cast(id as string) as t", "map('a', id) as m")
    assert {tuple(r["columns"]) for r in keys.minimal_keys(df).collect()} == {("id",), ("t",), ("m",)}
    assert keys.minimal_keys(df.unionByName(df)).collect() == []
    assert keys.minimal_keys(df.where("false")).collect() == []
    assert keys.minimal_keys(df, ["k"]).collect() == []


def test_only_sets_without_a_repeat_in_a_slice_are_counted_in_full(spark, monkeypatch):
    counted, plain = [], keys.distinct_counts

    def seen(df, cols, **how):
        counted.append((how.get("slices", 1), len(cols)))
        return plain(df, cols, **how)

    monkeypatch.setattr(keys, "distinct_counts", seen)
    df = spark.range(6000).selectExpr("id", "cast(id * 0.98 as long) as near", "id % 1000 as k")  # near repeats some 2 %
    assert {tuple(r["columns"]) for r in keys.minimal_keys(df, most=1).collect()} == {("id",)}
    assert (1, 1) in counted and (1, 2) not in counted
