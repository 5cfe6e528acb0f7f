from frames import rows
from pyspark.sql import functions as F

from lakeproof.operators import measures, quality
from lakeproof.sources import writers

RULES = "rule_type string, table_name string, column_name string, severity string, rule_expression string, ref_table string, ref_column string"


def rule_table(spark):
    return spark.createDataFrame([
        ("not_null", "dim_account", "id", "critical", None, None, None), ("unique", "dim_account", "id", "warn", None, None, None),
        ("referential", "fct_calls", "account_id", "error", None, "dim_account", "id"),
        ("range_check", "fct_calls", "duration", "warn", None, None, None),
        ("row_count", "landing_file", None, "error", "count > 0", None, None),
        ("business_rule", "fct_calls", None, "quarantine", "amount >= 0", None, None),
        ("mystery", None, None, None, None, None, None)], RULES)


def test_rule_table_compiles_to_its_routes(spark):
    compiled = quality.compile_rules(rule_table(spark))
    assert rows(quality.rule_summary(compiled)) == [(7, 3, 1, 1, 2)]
    kinds = {(r["kind"], r["severity"], r["route"]) for r in compiled.collect()}
    assert ("not_null", "error", "test") in kinds and ("unique", "warn", "test") in kinds
    assert ("range", "warn", "unclassified") in kinds and ("unclassified", "error", "unclassified") in kinds
    assert compiled.where("route = 'quarantine'").first()["predicate"] == "amount >= 0"


def test_compiled_tests_run(spark):
    compiled = quality.compile_rules(rule_table(spark)).where("route = 'test'").collect()
    tables = {"gold.dim_account": spark.createDataFrame([(1,), (None,), (None,), (None,)], "id int"),
              "gold.fct_calls": spark.createDataFrame([(1, 1), (2, 5), (3, None)], "call_id int, account_id int")}
    out = quality.run_tests(spark, quality.specs_of(compiled), tables)
    assert rows(out, "model", "kind", "violations") == [
        ("dim_account", "expression", 3), ("dim_account", "unique", 1), ("fct_calls", "relationships", 1)]


def test_predicates_compiled_from_parameters_are_valid_sql(spark):
    df = spark.createDataFrame([("accepted_values", "t", "c", "error", "it's|b", None), ("range", "t", "n", "reject", None, "5"),
                                ("regex", "t", "c", "error", r"^\d+$", None)],
                               "rule_type string, table_name string, column_name string, severity string, rule_expression string, min_value string")
    data = spark.createDataFrame([("it's", 7), ("12", 3), (None, None)], "c string, n int")
    got = {r["kind"]: (r["route"], data.where(f"not ({r['predicate']})").count()) for r in quality.compile_rules(df).collect()}
    assert got == {"accepted_values": ("test", 1), "range": ("quarantine", 1), "regex": ("test", 1)}


def test_null_predicates_neither_pass_nor_fail(spark):
    df = spark.createDataFrame([(1, 5), (2, -1), (3, None)], "id int, amount int")
    out = quality.quarantine(df, "amount >= 0", "positive")
    assert rows(out, "id", "_dq_rule") == [(2, "positive")]
    assert "_dq_rejected_at" in out.columns
    checks = [quality.breaks_range(F.col("amount"), 0), quality.breaks_accepted_values("amount", ["5", "-1"]),
              quality.breaks_regex(F.col("amount").cast("string"), "^-?[0-9]$"), quality.breaks_expression("amount >= 0")]
    assert tuple(df.agg(*[F.count_if(c) for c in checks]).first()) == (1, 0, 0, 1)


def test_rejects_of_two_rules_are_kept_together(spark):
    df = spark.createDataFrame([(1, -1), (2, 9)], "id int, v int")
    out = quality.union_rejects([quality.quarantine(df, "v >= 0", "low"), quality.quarantine(df.withColumn("w", F.lit(1)), "v < 5", "high")])
    assert rows(out, "id", "_dq_rule", "w") == [(1, "low", None), (2, "high", 1)]


def test_skipped_unknown_and_failing_specs(spark):
    tables = {"silver.stg_t": spark.createDataFrame([(1, "x")], "id int, s string")}
    specs = [{"model": "t", "kind": "relationships", "columns": ["id"], "parent": "gone", "parent_columns": ["id"]},
             {"model": "t", "kind": "strange", "columns": []}, {"model": "absent", "kind": "unique", "columns": ["id"]},
             {"model": "t", "kind": "unique", "columns": ["nope"]}, {"model": "t", "kind": "not_null", "columns": ["id"]},
             {"model": "t", "kind": "contract", "columns": [], "expected": [("ID", "int"), ("s", "decimal(3,1)"), ("q", "date")]}]
    out = quality.run_tests(spark, specs, tables)
    assert sorted(r["status"] for r in out.collect()) == ["error", "error", "failed", "passed", "skipped", "skipped"]
    assert rows(out.where("kind = 'contract'"), "violations") == [(2,)]


def test_gold_is_preferred_and_stg_alias_found():
    tables = {"bronze.account": 1, "silver.stg_account": 2, "gold.account": 3}
    assert quality.resolve_model("account", tables) == "gold.account"
    assert quality.resolve_model("stg_account", {"bronze.account": 1}) == "bronze.account"
    assert quality.resolve_model("x", tables) is None


def test_specs_from_declared_keys(spark):
    rels = spark.createDataFrame([("A.DIM", ["id"], "B.FCT", ["dim_id"])], "pk_table string, pk_columns array<string>, fk_table string, fk_columns array<string>")
    assert rows(quality.build_test_specs(rels), "model", "kind", "columns", "parent") == [
        ("dim", "not_null", ["id"], None), ("dim", "unique", ["id"], None), ("fct", "not_null", ["dim_id"], None), ("fct", "relationships", ["dim_id"], "dim")]


def test_freshness(spark):
    df = spark.sql("select timestamp'2024-01-01 00:00:00' as load_ts")
    for as_of, state in (("2024-01-01 12:00:00", "pass"), ("2024-01-02 12:00:00", "warn"), ("2024-01-04 00:00:00", "error")):
        assert rows(quality.source_freshness(df, as_of), "state") == [(state,)]
    assert rows(quality.source_freshness(df.limit(0), "2024-01-01"), "state") == [("error",)]


def test_reject_zone_is_idempotent_per_batch(spark, tmp_path):
    df = spark.createDataFrame([(1, 5), (2, -1), (3, None)], "id int, v int")
    for batch in ("b1", "b1", "b2"):
        kept = writers.reject_zone(df, F.col("v") >= 0, str(tmp_path / "z"), "positive", batch)
    assert rows(kept, "id") == [(1,)]
    assert rows(spark.read.parquet(str(tmp_path / "z")), "id", "_dq_batch") == [(2, "b1"), (2, "b2"), (3, "b1"), (3, "b2")]


def test_ship_gate_names_the_first_blocker(spark):
    none = spark.createDataFrame([], "tag string")
    ok = spark.createDataFrame([(True,)], "passed boolean")
    bad = spark.createDataFrame([(True,), (False,)], "passed boolean")
    item = spark.createDataFrame([("TODO",)], "tag string")
    gate = lambda *a: tuple(measures.ship_gate(*a).first())
    assert gate(none, ok, ok) == (True, "all gates passed", 100)
    assert gate(item, bad, bad) == (False, "1 review item(s) unresolved", 75)
    assert gate(none, bad, ok) == (False, "1 test(s) failing", 100)
    assert gate(none, ok, bad) == (False, "1 table(s) not verified against source", 75)
    assert gate(none, ok.limit(0), ok) == (False, "tests not run yet", 100)


def test_failure_rollup_and_recipients(spark):
    df = spark.createDataFrame([("j", [("FAILED", f"m{i:02d}", "f") for i in range(25)] + [("ok", "x", "f"), ("failed", None, "late.csv")])],
                               "job string, res array<struct<status:string,message:string,file_name:string>>")
    out = measures.failure_rollup(df, "res", ["job"]).first()
    assert out["failures"] == 26 and out["message"].count("\n") == 19 and out["message"].startswith("- late.csv\n- m00")
    mails = spark.createDataFrame([("ops@corp.com; data@corp.com",), ("",), (None,)], "r string")
    assert [r[0] for r in measures.recipient_list(mails, "r").collect()] == ["data@corp.com", "ops@corp.com"]
