import json
import random

import pytest
from frames import rows
from pyspark.sql import functions as F

from lakeproof.functions import variant


def plain_flatten(value, path, recursive):
    pairs = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else []
    for k, v in pairs:
        at = (f"{path}.{k}" if path else k) if isinstance(value, dict) else f"{path}[{k}]"
        yield at, k if isinstance(value, dict) else None, k if isinstance(value, list) else None, v
        if recursive:
            yield from plain_flatten(v, at, True)


def made(seed):
    draw = random.Random(seed)

    def value(depth):
        kind = draw.randrange(7 if depth else 5)
        if kind >= 5:
            n = draw.randrange(4)
            return [value(depth - 1) for _ in range(n)] if kind == 5 else {draw.choice(["a", "b", "c d", "é"]) + str(i): value(depth - 1) for i in range(n)}
        return [None, draw.randrange(100), draw.choice([True, False]), draw.choice(["x", "", "7"]), draw.randrange(9) + 0.5][kind]
    return [{"id": i, "v": value(3)} for i in range(40)]


@pytest.mark.parametrize("recursive", [False, True])
def test_flatten_against_the_plain_version(spark, recursive):
    docs = made(1)
    df = spark.createDataFrame([(d["id"], json.dumps(d["v"]), "p") for d in docs], "id int, doc string, path string")
    got = variant.flatten_variant(df.withColumn("doc", variant.parse_variant("doc")), "doc", recursive=recursive)
    assert got.columns == ["id", "path", "key", "index", "value"]
    found = sorted([(r["id"], r["path"], r["key"], r["index"], json.loads(r["j"])) for r in got.withColumn("j", F.to_json("value")).collect()], key=repr)
    assert found == sorted([(d["id"], *x) for d in docs for x in plain_flatten(d["v"], "", recursive)], key=repr)


def test_flatten_below_a_path_and_outer(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": [5, {"c": 6}]}}'), (2, '{"a": 1}'), (3, None), (4, "[]")], "id int, doc string").withColumn("doc", variant.parse_variant("doc"))
    inner = variant.flatten_variant(df, "doc", "a.b")
    assert rows(inner, "id", "path", "index") == [(1, "[0]", 0), (1, "[1]", 1)]
    assert rows(variant.flatten_variant(df, "doc", "a.b", outer=True), "id", "path") == sorted([(1, "[0]"), (1, "[1]"), (2, None), (3, None), (4, None)], key=repr)


def test_typed_access(spark):
    df = spark.createDataFrame([('{"a": {"b": [1, "x"]}, "n": "12", "d": 1.25, "t": "2024-01-01", "z": null}',), ("nope",), (None,)], "doc string")
    at = lambda p, t="string": variant.variant_at(variant.parse_variant("doc"), p, t)
    out = df.select(at("a:b[0]", "int"), at("$.a.b[1]"), at("a"), at("n", "int"), at("d", "decimal(5,2)").cast("string"), at("t", "date").cast("string"),
                    at("z"), at("a.b", "array<string>"), at("a.b[7]"), at("n", "date")).collect()
    assert tuple(out[0]) == (1, "x", '{"b":[1,"x"]}', 12, "1.25", "2024-01-01", None, ["1", "x"], None, None)
    assert set(out[1]) == set(out[2]) == {None}


def test_documents_are_typed_by_what_all_of_them_hold(spark):
    docs = ['{"a": 1, "b": "x", "n": null, "it\'s": true, "o": {"k": 1}, "mix": 1}', '{"a": 2.5, "o": {"k": 2, "l": "z"}, "mix": "t", "doc": 3}', "[1]", "5", "bad", None]
    df = spark.createDataFrame([(i, d, "old") for i, d in enumerate(docs)], "id int, doc string, b string").withColumn("doc", variant.parse_variant("doc"))
    kinds = {f.name: f.dataType.simpleString() for f in variant.documents_type(df, "doc")}
    assert kinds["a"].startswith("decimal") and kinds["mix"] == "variant" and kinds["n"] == "string" and kinds["it's"] == "boolean"
    assert kinds["o"] == "struct<k:bigint,l:string>"
    out = variant.typed_documents(df, "doc")
    assert [c for c in out.columns if c == "b"] == ["b"] and out.count() == 6
    first = out.where("id = 0").first()
    assert (float(first["a"]), first["b"], first["it's"], first["o"]["k"], first["n"]) == (1.0, "x", True, 1, None)
    assert out.where("id > 1 and (b is not null or a is not null)").isEmpty()
    assert variant.typed_documents(df.where("id > 1"), "doc").columns == ["id", "b"]
