import zipfile

import pytest
from frames import rows
from pyspark.sql import functions as F

from lakeproof.functions import scalar, types
from lakeproof.operators import mapping
from lakeproof.plans import medallion, models, suggest
from lakeproof.sources import files, jdbc
from lakeproof.streaming import landing


def test_control_types(spark):
    expected = {"integer": "INT", "bigint": "BIGINT", "bigserial": "BIGINT", "numeric(12,2)": "DECIMAL(12,2)", "numeric": "DECIMAL(38,6)",
                "timestamp without time zone": "TIMESTAMP", "date": "DATE", "boolean": "BOOLEAN", "jsonb": "STRING", "text": "STRING",
                "double precision": "DOUBLE", "weird_type": "STRING", "": "STRING"}
    df = spark.createDataFrame([(k,) for k in expected], "col_type string")
    assert {r[0]: r[1] for r in types.map_types(df, "control").collect()} == expected
    schema = types.struct_type([("a", "DECIMAL(12,2)"), ("b", "ARRAY<STRING>")])
    assert schema.simpleString() == "struct<a:decimal(12,2),b:array<string>>"


def test_warehouse_and_export_types(spark):
    expected = {"NUMBER(10,2)": "DECIMAL(10,2)", "number": "DECIMAL(38,0)", "TINYINT": "BIGINT", "FLOAT8": "DOUBLE", "NVARCHAR2(5)": "STRING",
                "DATETIME": "TIMESTAMP_NTZ", "TIMESTAMP_TZ": "TIMESTAMP", "VARIANT": "STRING", "ARRAY": "ARRAY<STRING>", "VARBINARY": "BINARY",
                "TIME": "STRING", "what": "STRING"}
    df = spark.createDataFrame([(k,) for k in expected], "col_type string")
    assert {r[0]: r[1] for r in types.map_types(df, "warehouse").collect()} == expected
    back = spark.createDataFrame([("decimal(9,1)",), ("bigint",), ("timestamp",), ("map<string,int>",)], "col_type string")
    assert [r[1] for r in types.map_types(back, "export").collect()] == ["NUMBER(9,1)", "NUMBER(38,0)", "TIMESTAMP_NTZ", "VARCHAR"]


def test_date_helpers_at_month_ends(spark):
    df = spark.sql("select date'2024-01-31' a, date'2024-02-29' b")
    out = df.select(scalar.dateadd("month", 1, "a"), scalar.datediff("month", "a", "b"), scalar.datediff("day", "a", "b"),
                    scalar.dateadd("years", -1, "b"), scalar.datediff("yy", "a", "b")).first()
    assert [str(x) for x in out] == ["2024-02-29", "1", "29", "2023-02-28", "0"]
    with pytest.raises(ValueError):
        scalar.dateadd("fortnight", 1, "a")


def test_landing_csv(spark, tmp_path):
    (tmp_path / "commercial").mkdir()
    (tmp_path / "commercial" / "acc_1.csv").write_text("ID,NAME,ACCOUNT_TYPE,DATA_SRC_NM\nACC-9001,Harbor Clinic,HCO,crm_feed\nACC-9002,Dr Harbor,HCP,crm_feed\n")
    (tmp_path / "commercial" / "skip.txt").write_text("x")
    df = files.read_landing(spark, str(tmp_path), "csv", "acc_*.csv")
    assert rows(df, "ID", "_source_file_name") == [("ACC-9001", "acc_1.csv"), ("ACC-9002", "acc_1.csv")]


def test_archives_keep_every_member(spark, tmp_path):
    for n in ("one", "two"):
        with zipfile.ZipFile(tmp_path / f"{n}.zip", "w") as z:
            z.writestr("d/", "")
            z.writestr("d/a.txt", n)
            z.writestr("e/a.txt", n * 2)
            z.writestr("b.txt", n * 3)
    out = files.expand_archives(spark, str(tmp_path), str(tmp_path / "out"))
    assert sorted((r["member"], r["bytes"]) for r in out.collect()) == sorted([("d/a.txt", 3), ("e/a.txt", 6), ("b.txt", 9)] * 2)
    names = sorted(p.relative_to(tmp_path / "out").as_posix() for p in (tmp_path / "out").rglob("*.txt"))
    assert names == [f"{n}/{m}" for n in ("one", "two") for m in ("b.txt", "d__a.txt", "e__a.txt")]
    assert (tmp_path / "out" / "two" / "e__a.txt").read_text() == "twotwo"


def test_load_once_recovers_a_broken_load(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(5).write.parquet(path + "/a")
    n = len(list((tmp_path / "in" / "a").glob("*.parquet")))
    assert files.copy_into_once(spark, path, "once_t", "once_l") == n
    assert files.copy_into_once(spark, path, "once_t", "once_l") == 0
    # a load that wrote rows and died before it was logged as done
    spark.range(5, 8).write.parquet(path + "/b")
    names = [r["file_path"] for r in files.landed_files(spark, path + "/b", "*.parquet").collect()]
    spark.createDataFrame([("dead", f, "started") for f in names], "load_id string, file_path string, state string").withColumn(
        "logged_at", F.current_timestamp()).write.mode("append").saveAsTable("once_l")
    spark.range(5, 8).withColumn("_load_id", F.lit("dead")).write.mode("append").partitionBy("_load_id").saveAsTable("once_t")
    files.copy_into_once(spark, path, "once_t", "once_l")
    assert [r[0] for r in rows(spark.table("once_t"), "id")] == list(range(8))
    spark.range(8, 20, 1, 4).write.parquet(path + "/c")  # a few names at a time
    assert files.copy_into_once(spark, path, "once_t", "once_l", max_files=3) == 4
    assert sorted(r[0] for r in rows(spark.table("once_t"), "id")) == list(range(20))
    loads = spark.table("once_l").where("state = 'done' and file_path like '%/c/%'").groupBy("load_id").count()
    assert [r[0] for r in rows(loads, "count")] == [1, 3]


def test_typed_load_never_raises(spark):
    df = spark.createDataFrame([("1", "2024-01-01", "x"), ("a", "bad", None), (None, None, "y")], "n string, d string, s string")
    good, bad = files.typed_load(df, [{"target": "n", "type": "INT"}, {"target": "day", "source": "d", "type": "DATE"}, {"target": "s", "type": "STRING"}], batch_id="b")
    assert rows(good, "n", "s", "_batch_id") == sorted([(1, "x", "b"), (None, "y", "b")], key=repr)
    assert rows(bad, "n", "day", "_cast_errors") == [("a", "bad", ["n", "day"])]
    with pytest.raises(ValueError):
        files.typed_load(df, [{"target": "n", "type": "FLOAT"}])


def test_jdbc_landing_names_and_loop(spark):
    tables = ["public.account", "staging.Account", "public.call", "plain"]
    assert jdbc.landing_names(tables) == {"public.account": "public_account", "staging.Account": "staging_account", "public.call": "call", "plain": "plain"}
    seen = []

    def fake(session, url, source, props, partition):
        seen.append((source, partition))
        return session.range(2)

    spark.sql("create schema if not exists landed")
    done = jdbc.jdbc_land(spark, "jdbc:x", ["a.t", "b.t"], "landed", {}, {"a.t": {"column": "id"}}, read=fake)
    assert done == {"a.t": "landed.a_t", "b.t": "landed.b_t"} and seen == [("a.t", {"column": "id"}), ("b.t", None)]
    assert spark.table("landed.b_t").count() == 2
    assert jdbc.export_column_types(spark.sql("select 1L as id, cast(1 as decimal(5,2)) as d, 'x' as s")) == "id NUMBER(38,0), d NUMBER(5,2), s VARCHAR"


HEADERS = {
    "account": "ID Name Account_Type_vod__c FirstName LastName Specialty_1_vod__c Credentials_vod__c Primary_Parent_vod__c",
    "call": "Id Name Account_vod__c Call_Date_vod__c Status_vod__c Call_Channel__c Call_Type_vod__c Owner_Name Territory_vod__c Duration_vod__c",
    "call_detail": "ID Name Call2_vod__c Product_vod__c Product_Name_vod__c Detail_Priority_vod__c"}
TARGETS = {
    "account": {"account_id": "`ID`", "account_name": "`Name`", "account_type": "`Account_Type_vod__c`", "first_name": "`FirstName`",
                "full_name": "concat_ws(' ', `FirstName`, `LastName`)", "specialty": "`Specialty_1_vod__c`", "primary_parent_id": "`Primary_Parent_vod__c`",
                "dq_orphan_parent": "'N'", "_source_file": "'{file_name}'", "dwh_batch_id": "'{batch_id}'", "_load_ts": "cast(current_timestamp() as string)"},
    "call": {"call_id": "`Id`", "call_number": "cast(null as string)", "account_id": "`Account_vod__c`", "call_date": "`Call_Date_vod__c`",
             "duration_min": "`Duration_vod__c`", "owner_name": "`Owner_Name`", "location": "cast(null as string)", "call_channel": "`Call_Channel__c`"},
    "call_detail": {"call_id": "`Call2_vod__c`", "product_id": "`Product_vod__c`", "product_name": "`Product_Name_vod__c`", "detail_priority": "`Detail_Priority_vod__c`",
                    "line_number": "cast(null as string)"}}


def test_inferred_mapping_of_known_objects(spark):
    headers = spark.createDataFrame([(o, h, i) for o, hs in HEADERS.items() for i, h in enumerate(hs.split())], "object string, header string, ord int")
    targets = spark.createDataFrame([(o, t) for o, ts in TARGETS.items() for t in ts], "object string, target string")
    got = {}
    for r in mapping.infer_mapping(headers, targets).collect():
        got.setdefault(r["object"], {})[r["target"]] = r["expression"]
    assert got == TARGETS


def test_header_names(spark):
    expected = {"%Order Key": "order_key", "CustomerID": "customer_id", "XMLFile": "xml_file", "1st": "col_1st", "Select": "select_col", "": "unnamed",
                "a.b/c\\d e": "ab_cd_e", "--": "unnamed", "x__y": "x_y"}
    df = spark.createDataFrame([(k,) for k in expected], "h string")
    by_column = {r[0]: r[1] for r in df.select("h", mapping.snake_name("h")).collect()}
    by_frame = {k: mapping.snake_case_columns(spark.range(1).toDF(k)).columns[0] for k in expected}
    assert by_column == by_frame
    assert {k: by_column[k] for k in expected if k != "a.b/c\\d e"} == {k: v for k, v in expected.items() if k != "a.b/c\\d e"}
    assert mapping.snake_case_columns(spark.range(1).selectExpr("id as `A b`", "id as `a_b`", "id as AB")).columns == ["a_b", "a_b_1", "ab"]
    assert mapping.snake_case_columns(spark.range(1).selectExpr("id as A", "id as `a `", "id as a_1", "id as `a__1`")).columns == ["a", "a_1", "a_1_1", "a_1_2"]


def test_masking_keeps_null_and_empty(spark):
    df = spark.createDataFrame([(1, "hunter2", "sk-123", "ok"), (2, None, "", "x")], "id int, sftp_password string, api_key string, note string")
    assert rows(mapping.mask_secret_columns(df)) == [(1, "***", "***", "ok"), (2, None, "", "x")]


def test_query_configuration(spark):
    cfg = spark.createDataFrame([("gold.rpt_calls", "select * from curated.calls", "Y", 2), ("gold.dim_account", "select id, name from curated.account", "Y", 1),
                                 ("gold.old_extract", "select 1", "N", 3), ("", "", "Y", 4)], "target_table string, query_text string, is_active string, execution_order int")
    out = models.active_queries(cfg).collect()
    assert [r["name"] for r in out if r["skipped"] is None] == ["dim_account", "rpt_calls"]
    assert sorted(r["skipped"] for r in out if r["skipped"]) == ["empty SQL", "inactive"]
    assert rows(models.active_queries(cfg.select("target_table")), "skipped")[0] == ("no SQL column recognised",)


def test_bound_queries_take_values_as_values(spark):
    df = spark.createDataFrame([(1, "b1"), (2, "b2")], "id int, batch string")
    sql = "select id, '{batch_id}' as b from {raw_filename} where batch = '{batch_id}'"
    assert rows(models.run_config_query(spark, sql, {"batch_id": "b1"}, df)) == [(1, "b1")]
    assert rows(models.run_config_query(spark, sql, {"batch_id": "x' or '1'='1"}, df)) == []
    assert rows(models.full_refresh_query(spark, sql, raw=df), "id") == [(1,), (2,)]


def test_cyclic_models_are_refused(spark):
    with pytest.raises(ValueError):
        models.build_models(spark, [{"name": "a", "sql": "select 1", "depends_on": ["b"]}, {"name": "b", "sql": "select 1", "depends_on": ["a"]}])


def test_suggested_types_come_from_the_data_too(spark):
    df = spark.createDataFrame([("1", "y", "2024-01-01", "7.5", None), ("2", "n", "2024-02-01", "8", None)], "qty string, is_open string, ts string, ratio string, void string")
    got = {r["col_name"]: (r["category"], r["target_type"]) for r in suggest.suggest_types(df, "t").collect()}
    assert got == {"qty": ("NUMERIC_LIKE", "BIGINT"), "is_open": ("TEXT_LIKE", "STRING"), "ts": ("DATE_LIKE", "DATE"), "ratio": ("NUMERIC_LIKE", "DOUBLE"),
                   "void": ("KEY_LIKE", "STRING")}


def test_a_failing_object_fails_its_batch_only(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,y\n")
    good = medallion.SourceObject("a", str(tmp_path), "a.csv", "cur_a", "pub_a", stitching="upsert", keys=("id",),
                                  mapping=[{"target": "id", "source": "id"}, {"target": "name", "source": "name"}])
    bad = medallion.SourceObject("b", str(tmp_path / "missing"), "*.csv", "cur_b", "pub_b")
    assert medallion.run_batch(spark, [bad, good], "b1", "crm", "bat", "aud") == "F"
    (tmp_path / "a.csv").write_text("id,name\n2,z\n3,w\n")
    assert medallion.run_batch(spark, [good], "b2", "crm", "bat", "aud") == "C"
    assert rows(spark.table("pub_a"), "id", "name") == [("1", "x"), ("2", "z"), ("3", "w")]
    assert rows(spark.table("aud").where("layer = 'curated' and status = 'SUCCEEDED'"), "batch_id", "row_count") == [("b1", 2), ("b2", 2)]


def test_the_rows_of_a_batch_are_stored_once_before_the_merge_and_once_after(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,y\n")
    obj = medallion.SourceObject("a", str(tmp_path), "a.csv", "cur_once", "pub_once", stitching="upsert", keys=("id",),
                                 mapping=[{"target": "id", "source": "id"}, {"target": "name", "source": "name"}])
    stored, real = [], medallion.staged
    monkeypatch.setattr(medallion, "staged", lambda df, name: (stored.append(name), real(df, name))[1])
    assert medallion.run_batch(spark, [obj], "b1", "crm", "bat_once", "aud_once") == "C"
    assert stored == ["published", "merged"]
    assert rows(spark.table("pub_once"), "id", "name") == [("1", "x"), ("2", "y")]
    assert rows(spark.table("aud_once"), "layer", "row_count") == [("curated", 2), ("publish", 2)]


def test_streamed_files_load_once_and_merges_repeat_safely(spark, tmp_path):
    schema, inbox = "k int, ts timestamp, v string", str(tmp_path / "in")
    write = lambda name, data: spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{inbox}/{name}")
    from datetime import datetime as d
    write("1", [(1, d(2024, 1, 1), "a"), (2, d(2024, 1, 1), "b"), (1, d(2024, 1, 2), "a2")])
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    merge = lambda: landing.stream_upsert(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(inbox), "stream_t",
                                          ["k"], "ts", str(tmp_path / "mark2")).awaitTermination()
    for _ in range(2):
        landing.stream_landing(spark, inbox, schema, out, mark).awaitTermination()
        merge()
    assert spark.read.parquet(out).count() == 3
    write("2", [(2, d(2023, 1, 1), "late"), (3, d(2024, 1, 1), "c")])
    landing.stream_landing(spark, inbox, schema, out, mark).awaitTermination()
    merge()
    assert spark.read.parquet(out).count() == 5
    again = spark.createDataFrame([(1, d(2024, 1, 2), "a2"), (3, d(2024, 1, 1), "c")], schema)
    landing.upsert_batch("stream_t", ["k"], "ts")(again, 1)
    assert rows(spark.table("stream_t"), "k", "v") == [(1, "a2"), (2, "b"), (3, "c")]
