"""Semi-structured values: parsing, typed access, flattening and typing of documents whose shape is not declared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import quoted
from ..session import staged
from .scalar import as_col

FLAT = ("path", "key", "index", "value")


def parse_variant(c) -> Column:
    """JSON text as a variant; text that is no JSON (or names a key twice) gives NULL."""
    return F.try_parse_json(as_col(c))


def as_path(path: str) -> str:
    """A path as Spark reads it: ``a.b[0]`` and ``a:b.c`` mean ``$.a.b[0]`` and ``$.a.b.c``; a path from ``$`` stays."""
    path = path.strip()
    if path.startswith("$"):
        return path
    head, colon, rest = path.partition(":")
    plain = f"{head}.{rest}" if colon else path
    return f"${plain}" if plain.startswith("[") else f"$.{plain}" if plain else "$"


def variant_at(c, path: str, dtype: str = "string") -> Column:
    """Typed access into a variant; a missing path, a null and a value that does not convert give NULL.

    As text, an object or array is its JSON; ``dtype`` may be ``variant``, or a struct or array of types.
    """
    v, path = as_col(c), as_path(path)
    if dtype == "string":
        inner = F.try_variant_get(v, path, "variant")
        nested = F.schema_of_variant(inner).rlike("^(OBJECT|ARRAY)<")
        return F.when(nested, F.to_json(inner)).otherwise(F.try_variant_get(v, path, "string"))
    return F.try_variant_get(v, path, dtype)


def _children(df: DataFrame, source: str, outer: bool) -> DataFrame:
    explode = "variant_explode_outer" if outer else "variant_explode"
    return df.sparkSession.sql(f"select d.*, e.pos as _pos, e.key as _key, e.value as _value from {{d}} d, lateral {explode}(d.`{source}`) e", d=df)


def flatten_variant(df: DataFrame, c: str, path: str = "$", outer: bool = False, recursive: bool = False) -> DataFrame:
    """One row per element of the object or array at ``path`` of column ``c``, with the frame's other columns and ``path``, ``key`` (of
    an object), ``index`` (of an array, from 0) and ``value`` (a variant).

    ``recursive`` goes on into every value that has elements, a level of nesting a round, each round written once. Values that
    have no elements give no row, or with ``outer`` one row of nulls. Columns of the names of the results are replaced.
    """
    taken = {x.lower() for x in (*FLAT, c)}
    others = [quoted(x) for x in df.columns if x.lower() not in taken]
    start = df.select(*others, F.try_variant_get(quoted(c), as_path(path), "variant").alias("_in"), F.lit("").alias("_at"))

    def level(rows: DataFrame, all_rows: bool) -> DataFrame:
        found = _children(rows, "_in", all_rows)
        step = F.when(F.col("_key").isNotNull(), F.concat(F.when(F.col("_at") == "", F.lit("")).otherwise(F.lit(".")), F.col("_key")))
        step = step.when(F.col("_pos").isNotNull(), F.concat(F.lit("["), F.col("_pos").cast("string"), F.lit("]")))
        return found.select(*others, F.concat("_at", step).alias("path"), F.col("_key").alias("key"),
                            F.when(F.col("_key").isNull(), F.col("_pos")).alias("index"), F.col("_value").alias("value"))

    out = level(start, outer)
    if not recursive:
        return out
    whole = staged(out, "flat")
    front = whole
    while True:
        nested = front.where(F.schema_of_variant("value").rlike("^(OBJECT|ARRAY)<"))
        front = staged(level(nested.select(*others, F.col("value").alias("_in"), F.col("path").alias("_at")), False), "flat")
        if front.isEmpty():
            return whole
        whole = whole.unionByName(front)


def documents_type(df: DataFrame, c: str) -> T.StructType:
    """The struct type that all objects of a variant column fit, by one aggregate. Fields of several kinds are ``variant``,
    fields that are always null ``string``; values that are no objects have no part in it."""
    objects = df.select(F.try_variant_get(quoted(c), "$", "map<string, variant>").alias("m"), quoted(c).alias("v")).where("m is not null")
    text = objects.agg(F.schema_of_variant_agg("v")).first()[0]
    if not text or not text.startswith("OBJECT<"):
        return T.StructType()
    spelt = text.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING")
    found = T._parse_datatype_string(spelt)
    return found if isinstance(found, T.StructType) else T.StructType()


def typed_documents(df: DataFrame, c: str, schema: T.StructType | None = None) -> DataFrame:
    """The frame with a column for each field of its documents, typed by ``documents_type`` unless a schema is given.

    A field that does not fit its type is NULL; columns of the frame with a field's name are replaced.
    """
    schema = documents_type(df, c) if schema is None else schema
    new = {f.name.lower() for f in schema}
    kept = [quoted(x) for x in df.columns if x.lower() not in new and x != c]

    def field(f: T.StructField) -> Column:
        kind = f.dataType.simpleString()
        if any(q in f.name for q in "'\\"):  # a path has no way to escape these
            return F.try_variant_get(F.try_element_at(F.try_variant_get(quoted(c), "$", "map<string, variant>"), F.lit(f.name)), "$", kind)
        return F.try_variant_get(quoted(c), f"$['{f.name}']", kind)

    return df.select(*kept, *[field(f).alias(f.name) for f in schema])
