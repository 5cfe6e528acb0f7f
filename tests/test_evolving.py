import json

import pytest
from frames import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeproof.sources import evolving
from lakeproof.streaming import landing


def put(folder, name, lines):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("".join(x + "\n" for x in lines))


def rescued(row):
    return [(c.get("column"), c["value"]) for c in json.loads(row["_rescued_data"])] if row["_rescued_data"] else []


def cells_of(df):
    """Every cell of every row, wherever it went: sorted texts by column."""
    out = []
    for r in df.collect():
        typed = [(k, str(v).lower()) for k, v in r.asDict().items() if v is not None and not k.startswith("_")]
        out.append(sorted(typed + [((c or "").lower(), v.lower()) for c, v in rescued(r)]))
    return sorted(out)


def test_a_cell_that_does_not_fit_is_rescued_and_no_cell_is_lost(spark, tmp_path):
    inbox, log = tmp_path / "in", str(tmp_path / "log")
    put(inbox, "1.json", ['{"id": 1, "n": 1.5, "ok": true, "day": "2024-01-31", "s": "x"}'])
    assert rows(evolving.read_evolving(spark, str(inbox), log), "id", "n", "ok", "s") == [(1, 1.5, True, "x")]
    odd = ['{"id": "7x", "n": 12345678901234567890.5, "ok": "maybe", "day": "31.1.", "s": 5}', '{"ID": 2, "id": 3, "s": {"a": [1, null]}}',
           '{"id": 9223372036854775807, "n": 3, "ok": false}', "not json", "[1, 2]", "", '{"id": null, "new": 1}', '{"id": 1.5}']
    put(inbox, "2.json", odd)
    df = evolving.read_evolving(spark, str(inbox), log, glob="2.json", mode="rescue")
    assert df.schema["id"].dataType == T.LongType() and df.schema["day"].dataType == T.DateType()
    found = {tuple(sorted(rescued(r), key=repr)): r for r in df.collect()}
    first = found[(("day", "31.1."), ("id", "7x"), ("n", "12345678901234567890.5"), ("ok", "maybe"))]
    assert first["s"] == "5" and first["id"] is None
    assert found[(("id", "3"),)]["id"] == 2 and json.loads(found[(("id", "3"),)]["s"]) == {"a": [1, None]}
    assert found[()]["id"] == 9223372036854775807 and found[()]["n"] == 3.0
    assert {(None, "not json"), (None, "[1, 2]"), ("new", "1"), ("id", "1.5")} == {k[0] for k in found if len(k) == 1} - {("id", "3")}


def test_new_columns_are_typed_by_all_their_cells_or_by_hints(spark, tmp_path):
    put(tmp_path / "in", "a.json", ['{"a": "1", "b": 1, "c": 1, "D": "true", "t": "2024-01-01T10:00:00", "h": 1}', '{"a": "2x", "b": 2.5, "c": 3000000000, "d": null}'])
    df = evolving.read_evolving(spark, str(tmp_path / "in"), str(tmp_path / "log"), hints={"H": "decimal(9,2)"})
    assert {f.name: f.dataType.simpleString() for f in df.schema if not f.name.startswith("_")} == {
        "a": "string", "b": "double", "c": "bigint", "D": "boolean", "t": "timestamp", "h": "decimal(9,2)"}
    plain = evolving.read_evolving(spark, str(tmp_path / "in"), str(tmp_path / "log2"), infer=False)
    assert {f.dataType.simpleString() for f in plain.schema if not f.name.startswith("_")} == {"string"}


def test_csv_files_with_headers_of_their_own(spark, tmp_path):
    inbox = tmp_path / "in"
    put(inbox, "a.csv", ["id,name", "1,x", '2,"y, ""z"""', "3"])
    put(inbox, "b.csv", ["NAME,extra,id,id", "n,2024-02-01,4,5", "m,,6,,7,8"])
    put(inbox, "head_only.csv", ["id,never"])
    put(inbox, "empty.csv", [])
    df = evolving.read_evolving(spark, str(inbox), str(tmp_path / "log"), "csv", "*.csv")
    assert "NAME" in df.columns and "name" not in df.columns  # two spellings are one column
    found = {r["id"]: r for r in df.withColumnRenamed("NAME", "name").collect()}
    assert sorted(found) == [1, 2, 3, 4, 6] and found[2]["name"] == 'y, "z"' and found[3]["name"] is None
    assert str(found[4]["extra"]) == "2024-02-01" and rescued(found[4]) == [("id", "5")]
    assert rescued(found[6]) == [(None, "7"), (None, "8")]
    assert found[1]["_source_file_path"].endswith("a.csv")


def test_versions_of_the_log_and_modes(spark, tmp_path):
    log = evolving.SchemaLog(spark, str(tmp_path / "log"))
    assert log.current() == (-1, T.StructType())
    log.add({"a": "int"})
    log.add({"A": "string", "b": "date"})
    assert log.numbers() == [0, 1] and log.current()[1].simpleString() == "struct<a:int,b:date>"
    with pytest.raises(ValueError):
        log.add({"z": "array<string>"})
    assert log.read(0).simpleString() == "struct<a:int>"
    assert not log._write(1, T.StructType())  # the number is taken
    log.add({"b": "int"})
    assert log.numbers() == [0, 1]
    put(tmp_path / "in", "1.json", ['{"a": 1, "c": 2}'])
    read = lambda mode: evolving.read_evolving(spark, str(tmp_path / "in"), str(tmp_path / "log"), mode=mode)
    assert "c" not in read("rescue").columns and log.numbers() == [0, 1]
    with pytest.raises(ValueError, match="c"):
        read("fail")
    assert rows(read("fail"), "a", "c") == [(1, 2)]
    with pytest.raises(ValueError):
        read("whatever")


def test_a_stream_goes_on_after_columns_came_and_a_batch_delivered_again_changes_nothing(spark, tmp_path):
    inbox, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    run = lambda **more: landing.stream_evolving(spark, str(inbox), out, mark, glob="*.json", **more).awaitTermination()
    inbox.mkdir()
    run()
    landed = lambda: evolving.read_landed(spark, out, f"{mark}-schema")
    assert landed().collect() == []
    lines = [['{"id": 1, "v": "a"}', '{"id": 2, "v": "b"}'], ['{"id": 3, "w": 1.5}', "oops"], ['{"ID": "4", "w": "n/a", "x": [1, 2]}']]
    for i, batch in enumerate(lines):
        put(inbox, f"{i}.json", batch)
        run(max_files=1)
        run()
    whole = cells_of(landed())
    assert whole == sorted([[("id", "1"), ("v", "a")], [("id", "2"), ("v", "b")], [("id", "3"), ("w", "1.5")], [("", "oops")],
                            [("id", "4"), ("w", "n/a"), ("x", "[1,2]")]])
    assert evolving.SchemaLog(spark, f"{mark}-schema").numbers() == [0, 1, 2]
    (tmp_path / "mark" / "commits" / "2").unlink()  # the driver was lost after the write, before the commit
    (tmp_path / "mark" / "commits" / ".2.crc").unlink(missing_ok=True)
    run()
    assert cells_of(landed()) == whole and evolving.SchemaLog(spark, f"{mark}-schema").numbers() == [0, 1, 2]


def test_nothing_to_read(spark, tmp_path):
    put(tmp_path / "in", "a.json", ["", "  "])
    df = evolving.read_evolving(spark, str(tmp_path / "in"), str(tmp_path / "log"))
    assert df.columns == ["_rescued_data", "_source_file_path"] and df.collect() == []
    with pytest.raises(ValueError):
        evolving.read_evolving(spark, str(tmp_path / "in"), str(tmp_path / "log"), "xml")


def test_a_filter_on_the_rescue_column_repeats_no_step(spark, tmp_path):
    put(tmp_path / "in", "a.csv", ["id,name,at", "1,x,2024-01-01", "2,1-HIGH,2024-01-02", "3,E,n/a"])
    log = str(tmp_path / "log")
    evolving.SchemaLog(spark, log).add({"id": "bigint", "name": "string", "at": "date"})
    df = evolving.read_evolving(spark, str(tmp_path / "in"), log, "csv", "*.csv").where("_rescued_data is null")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_csv") <= 2 * 2 and plan.count("as date") <= 2  # the lines and the header; fitted once, cast once
    assert rows(df, "id", "name") == [(1, "x"), (2, "1-HIGH")]


def test_texts_that_are_numbers_and_texts_that_are_not(spark):
    texts = ["1", " 1 ", "1e3", "1E3", "-1.5", "0x1p3", "NaN", "Infinity", "1d", "E", "", "1-HIGH", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", *[evolving._fits(F.col("t"), k).alias(k) for k in ("bigint", "double", "date", "boolean")])
    assert {r["t"]: (r["bigint"], r["double"], r["date"], r["boolean"]) for r in df.collect()} == {
        t: (t in ("1", " 1 "), t in ("1", " 1 ", "1e3", "1E3", "-1.5"), False, False) for t in texts}
