import random

import pytest
from frames import rows
from pyspark.sql import functions as F

from lakeproof.operators import profile, reconcile as rec

SCHEMA = "order_id int, customer string, amount double, status string"
GOOD = [(1, "a", 10.0, "paid"), (2, "b", 20.0, "paid"), (3, "c", 30.0, "pending"), (4, "d", None, "paid")]


@pytest.fixture
def good(spark):
    return spark.createDataFrame(GOOD, SCHEMA)


def failing(verdict):
    return {(r["check"], r["column"], r["metric"]) for r in verdict.failures.collect()}


def test_identical_passes(good):
    verdict = rec.reconcile(good, good, ["order_id"])
    assert verdict.passed
    assert rows(verdict.gate()) == [(1, 1, True)]


def test_changed_value_with_equal_count_is_caught_by_the_sum(spark, good):
    broken = spark.createDataFrame([GOOD[0], (2, "b", 999.0, "paid"), GOOD[2], (5, "e", 50.0, "paid")], SCHEMA)
    found = failing(rec.reconcile(good, broken, ["order_id"], tol=1e-3))
    assert ("fingerprint", "amount", "sum") in found
    assert not any(check == "row_count" for check, _, _ in found)


def test_drift_below_the_tolerance_passes(spark, good):
    drift = spark.createDataFrame([(1, "a", 10.0000001, "paid"), *GOOD[1:]], SCHEMA)
    assert rec.reconcile(good, drift, ["order_id"], tol=1e-3).passed


def test_symmetric_drift_is_caught_by_the_sum_of_squares(spark):
    a = spark.createDataFrame([(1, 200), (2, 300), (3, 100), (4, 400), (5, 250)], "id int, v int")
    b = spark.createDataFrame([(1, 250), (2, 250), (3, 100), (4, 400), (5, 250)], "id int, v int")
    found = failing(rec.reconcile(a, b, ["id"]))
    assert ("fingerprint", "v", "sumsq") in found and ("fingerprint", "v", "sum") not in found


@pytest.mark.parametrize("case,expected", [
    (lambda d: d.where("order_id > 1"), ("row_count", "*", "row_count")),
    (lambda d: d.unionByName(d.where("order_id = 1")), ("key", "*", "duplicate_keys")),
    (lambda d: d.withColumn("order_id", F.when(F.col("order_id") < 4, F.col("order_id"))), ("key", "*", "null_keys")),
    (lambda d: d.withColumn("status", F.when(F.col("order_id") == 1, "void").otherwise(F.col("status"))),
     ("fingerprint", "status", "distinct")),
    (lambda d: d.withColumn("amount", F.when(F.col("order_id") > 1, F.col("amount"))), ("fingerprint", "amount", "nulls")),
    (lambda d: d.withColumn("amount", F.col("amount").cast("string")), ("type_drift", "amount", "type")),
    (lambda d: d.drop("status"), ("schema", "status", "presence")),
    (lambda d: d.withColumn("extra", F.lit(1)), ("schema", "extra", "presence")),
])
def test_each_mutation_fails_its_own_check(good, case, expected):
    assert expected in failing(rec.reconcile(good, case(good), ["order_id"]))


def test_one_empty_side_is_one_diagnosis(good):
    assert failing(rec.reconcile(good, good.limit(0), ["order_id"])) == {("row_count", "*", "row_count")}
    sliced = rec.reconcile(good, good, ["order_id"], where="amount > 1000")
    assert [r["detail"] for r in sliced.failures.collect()] == ["both sides have no rows after the filter"]


def test_missing_key_column_stops_the_pair(good):
    assert failing(rec.reconcile(good, good, ["nope"])) == {("key", "nope", "presence")}


def test_row_tolerance_is_fractional(spark):
    a, b = spark.range(100), spark.range(101)
    assert rows(profile.row_count(a, b, 0.01), "delta", "match") == [(1, True)]
    assert rows(profile.row_count(a, b), "match") == [(False,)]


def test_filters_may_only_filter(good):
    for bad in ("1=1; drop table x", "a -- b", "amount > 1 /* x */", "delete from t"):
        with pytest.raises(ValueError):
            rec.slice_filter(good, bad)
    assert rec.slice_filter(good, "  ").count() == 4
    assert rec.slice_filter(good, "status = 'updated'").count() == 0  # a word inside another word is fine


@pytest.mark.parametrize("a,b,tol,equal", [
    (None, None, 0, True), (None, "1", 0, False), ("True", "true", 0, True), ("t", "False", 0, False), (" x ", "x", 0, True),
    ("100", "100.00001", 1e-6, True), ("100", "101", 1e-6, False), ("0", "0.0000001", 1e-6, True), ("true", "1", 0, True)])
def test_values_equal(spark, a, b, tol, equal):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(profile.values_equal("a", "b", tol)).first()[0] is equal


def test_distinct_counts_match_spark_on_every_type(spark):
    df = spark.sql("""select id % 7 as i, cast(id % 5 as double) / 3 as d, if(id % 4 = 0, null, concat('s', id % 11)) as s,
        cast(id % 13 as decimal(30, 3)) as n, array(id % 3, id % 2) as a, id % 2 = 0 as b, cast(null as string) as z,
        timestamp_seconds(id % 17) as t, map('k', id % 6) as m from range(500)""")
    got = {r["column"]: int(r["value"]) for r in profile.column_fingerprint(df).where("metric = 'distinct'").collect()}
    assert got == {"i": 7, "d": 5, "s": 11, "n": 13, "a": 6, "b": 2, "z": 0, "t": 17, "m": 6}


def test_reconcile_rows_against_brute_force(spark):
    rng = random.Random(5)
    src = [(rng.choice([None, *range(40)]), rng.randint(0, 3), rng.choice([None, 1.0, 1.0000001, 2.0])) for _ in range(120)]
    cand = [r if rng.random() < 0.7 else (r[0], rng.randint(0, 3), r[2]) for r in src if rng.random() < 0.9] + [(99, 1, 1.0)]
    got = {r["k"]: (r["status"], tuple(r["changed_columns"]) if r["status"] == "changed" else ()) for r in rec.reconcile_rows(
        spark.createDataFrame(src, "k int, a int, b double"), spark.createDataFrame(cand, "k int, a int, b double"), ["k"]).collect()}
    expected = {}
    for k in {r[0] for r in src} | {r[0] for r in cand}:
        s, c = [r for r in src if r[0] == k], [r for r in cand if r[0] == k]
        changed = tuple(n for i, n in ((1, "a"), (2, "b")) if sorted(map(repr, (r[i] for r in s))) != sorted(map(repr, (r[i] for r in c))))
        status = "missing" if not c else "extra" if not s else "recount" if len(s) != len(c) else "changed" if changed else None
        if status:
            expected[k] = (status, changed if status == "changed" else ())
    assert got == expected


def test_one_inner_row_of_a_hot_key_drifts(spark):
    base = spark.range(2400).selectExpr("if(id < 2000, null, id % 4) as k", "id as n", "if(id % 7 = 0, null, 1e6 + id % 50 - 25) as v", "id % 3 as w")
    drift = base.withColumn("v", F.when(F.col("n").isin(1205, 2006), F.col("v") * 1.00002).otherwise(F.col("v") * (1 + 1e-7)))
    got = rec.reconcile_rows(base, drift, ["k"], ["v", "w"], tol=1e-6)
    assert rows(got, "k", "status", "changed_columns") == [(2, "changed", ["v"]), (None, "changed", ["v"])]
    many = spark.range(10_000).selectExpr("1 as k", "100.0D + id % 2 as v", "id")
    one = many.withColumn("v", F.when(F.col("id") == 5000, 100.9).otherwise(F.col("v")))
    assert rows(rec.reconcile_rows(many, one, ["k"], ["v"], tol=1e-4), "k", "status", "changed_columns") == [(1, "changed", ["v"])]


def test_row_tolerance_against_brute_force(spark):
    rng = random.Random(8)
    value = lambda: rng.choice([None, 0.0, 5.0, -5.0, 1e5, 2e5, float("nan")])
    src = [(rng.randint(0, 30), value()) for _ in range(200)]
    cand = [(k, x if x is None or rng.random() < 0.6 else x * rng.choice([1.0005, 1.01])) for k, x in src if k or rng.random() < 0.5]
    a, b = (spark.createDataFrame(x, "k int, x double") for x in (src, cand))
    got = {r["k"]: (r["status"], tuple(r["changed_columns"])) for r in rec.reconcile_rows(a, b, ["k"], tol=1e-3).collect()}
    near = lambda x, y: x == y or x != x and y != y or abs(x - y) <= 1e-3 * max(1, abs(x), abs(y))
    want = {}
    for k in range(31):
        s, c = ([x for i, x in side if i == k] for side in (src, cand))
        p, q = (sorted((x for x in side if x is not None), key=lambda x: (x != x, x)) for side in (s, c))
        if len(s) != len(c):
            want[k] = ("recount" if c else "missing", ("x",) if c else ())
        elif len(p) != len(q) or not all(map(near, p, q)):
            want[k] = ("changed", ("x",))
    assert got == want and 5 < len(want) < 29


def test_rows_compare_across_types(spark):
    a = spark.sql("select 1 as k, 5 as n, '7' as s, cast(2.50 as decimal(5,2)) as d union all select 2, 6, 'x', null")
    b = spark.sql("select 1L as K, 5L as n, 7 as s, 2.5D as d union all select 2L, 6L, 8, null")
    got = rec.reconcile_rows(a, b, ["k"])
    assert rows(got, "k", "status", "changed_columns") == [(2, "changed", ["s"])]


def test_containment_ignores_incomplete_keys(spark):
    child = spark.createDataFrame([(1, 1), (1, 2), (None, 9), (3, None), (3, 3), (3, 3)], "a int, b int")
    parent = spark.createDataFrame([(1, 1), (1, 1)], "x int, y int")
    on = [("a", "x"), ("b", "y")]
    assert rows(rec.check_containment(child, parent, on)) == [(3,)]
    assert rows(rec.orphan_rows(child, parent, on)) == [(1, 2), (3, 3), (3, 3)]


def test_suggestions(spark):
    cols = ["account_sk", "account_id", "dwh_silver_ts", "job_run_id", "_load_ts", "name", "xxhash_key"]
    df = spark.createDataFrame([("gold.dim_account", c) for c in cols], "table string, col_name string")
    assert rows(rec.suggest_exclude(df), "col_name", "reason") == [
        ("_load_ts", "run_stamp"), ("account_sk", "surrogate"), ("dwh_silver_ts", "run_stamp"), ("job_run_id", "run_stamp"),
        ("xxhash_key", "surrogate")]
    assert rows(rec.suggest_key(df), "key", "key_source") == [(["account_id"], "name_match")]
    assert [c for c in cols if rec.exclude_reason_of(c)] == [c for c in cols if c not in ("account_id", "name")]


def test_reconcile_many_keeps_going_after_a_bad_pair(spark, good):
    verdict = rec.reconcile_many(spark, [
        {"name": "ok", "source": good, "candidate": good, "key": "order_id"},
        {"name": "bad", "source": good, "candidate": good, "where": "drop table x"}])
    assert rows(verdict.summary(), "pair", "passed") == [("bad", False), ("ok", True)]
    assert rows(verdict.gate()) == [(1, 2, False)]


def test_sums_of_single_columns_are_left_out_where_changed_columns_are_not_asked_for(spark):
    names = [f"c{i}" for i in range(4)]
    src = spark.createDataFrame([(k, *[k + i for i in range(4)]) for k in (1, 1, 2, 3, 4)], ", ".join(f"{c} int" for c in ["k", *names]))
    cand = src.where("k <> 4").withColumns({"c0": F.when(F.col("k") == 2, F.col("c1")).otherwise(F.col("c0")),
                                            "c1": F.when(F.col("k") == 2, F.col("c0")).otherwise(F.col("c1"))})
    found = rec.reconcile_rows(src, cand, ["k"])
    assert rows(found, "k", "status", "changed_columns") == [(2, "changed", ["c0", "c1"]), (4, "missing", [])]
    short = found.drop("changed_columns")
    assert rows(short) == [(2, "changed", 1, 1), (4, "missing", 1, 0)]
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (short, found)]
    assert [plan.count("sum(") for plan in plans] == [3, 3 + 3 * len(names)]


def test_rows_of_a_key_that_only_swap_partners_are_no_change(spark):
    src = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, None, "x")], "k int, p string, q string")
    cand = spark.createDataFrame([(1, "a", "y"), (1, "b", "x"), (2, "x", None)], "k int, p string, q string")
    assert rows(rec.reconcile_rows(src, cand, ["k"]), "k", "status", "changed_columns") == [(2, "changed", ["p", "q"])]
