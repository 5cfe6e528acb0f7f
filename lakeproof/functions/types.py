"""Type mapping between warehouse, control database and lake, as expressions over a column catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scalar import as_col

# Warehouse type families and the lake type of each.
WAREHOUSE_FAMILIES = {
    "BIGINT": ("INT", "INTEGER", "BIGINT", "SMALLINT", "TINYINT", "BYTEINT"),
    "DOUBLE": ("FLOAT", "DOUBLE", "REAL"),
    "STRING": ("VARCHAR", "CHAR", "CHARACTER", "STRING", "TEXT", "NVARCHAR", "NCHAR", "VARIANT", "OBJECT",
               "GEOGRAPHY", "GEOMETRY", "TIME"),
    "BOOLEAN": ("BOOLEAN",),
    "DATE": ("DATE",),
    "TIMESTAMP_NTZ": ("TIMESTAMP_NTZ", "DATETIME"),
    "TIMESTAMP": ("TIMESTAMP", "TIMESTAMP_LTZ", "TIMESTAMP_TZ"),
    "ARRAY<STRING>": ("ARRAY",),
    "BINARY": ("BINARY", "VARBINARY"),
}
WAREHOUSE_DECIMALS = ("NUMBER", "NUMERIC", "DECIMAL")

# Control-database type patterns, tried in this order.
CONTROL_PATTERNS = (
    (r"^(small|big)?serial", "BIGINT"),
    (r"^bigint", "BIGINT"),
    (r"^(integer|int4?|smallint|int2)", "INT"),
    (r"^(numeric|decimal)", "DECIMAL(38,6)"),
    (r"^(double precision|float8|real|float4?)", "DOUBLE"),
    (r"^bool", "BOOLEAN"),
    (r"^timestamp", "TIMESTAMP"),
    (r"^date$", "DATE"),
)

# Lake types and the warehouse type a published table gets.
EXPORT_TYPES = {
    "STRING": "VARCHAR", "DOUBLE": "FLOAT", "FLOAT": "FLOAT", "INT": "NUMBER(38,0)", "BIGINT": "NUMBER(38,0)",
    "SMALLINT": "NUMBER(38,0)", "TINYINT": "NUMBER(38,0)", "BOOLEAN": "BOOLEAN", "DATE": "DATE",
    "TIMESTAMP": "TIMESTAMP_NTZ", "TIMESTAMP_NTZ": "TIMESTAMP_NTZ", "BINARY": "BINARY",
}


def warehouse_type(c) -> Column:
    text = F.upper(F.trim(F.coalesce(as_col(c), F.lit(""))))
    family = F.regexp_extract(text, r"^([A-Z_]+)", 1)
    args = F.trim(F.regexp_extract(text, r"^[A-Z_]+\s*\(([^)]*)\)", 1))
    out = F.when(family.isin(*WAREHOUSE_DECIMALS),
                 F.when(args == "", "DECIMAL(38,0)").otherwise(F.concat(F.lit("DECIMAL("), args, F.lit(")"))))
    for target, names in WAREHOUSE_FAMILIES.items():
        out = out.when(family.isin(*names), target)
    return out.otherwise("STRING")


def control_type(c) -> Column:
    text = F.lower(F.trim(F.coalesce(as_col(c), F.lit(""))))
    exact = r"^(?:numeric|decimal)\s*\((\d+)\s*,\s*(\d+)\)"
    out = F.when(text.rlike(exact), F.concat(F.lit("DECIMAL("), F.regexp_extract(text, exact, 1), F.lit(","),
                                             F.regexp_extract(text, exact, 2), F.lit(")")))
    for pattern, target in CONTROL_PATTERNS:
        out = out.when(text.rlike(pattern), target)
    return out.otherwise("STRING")


def export_type(c) -> Column:
    text = F.upper(F.trim(F.coalesce(as_col(c), F.lit("STRING"))))
    out = F.when(text.rlike("^(DECIMAL|NUMERIC)"), F.regexp_replace(text, "DECIMAL|NUMERIC", "NUMBER"))
    for lake, target in EXPORT_TYPES.items():
        out = out.when(text == lake, target)
    return out.otherwise("VARCHAR")


DIALECTS = {"warehouse": warehouse_type, "control": control_type, "export": export_type}


def map_types(columns: DataFrame, dialect: str, type_col: str = "col_type", out: str = "target_type") -> DataFrame:
    """Add the mapped type to every row of a column catalogue."""
    return columns.withColumn(out, DIALECTS[dialect](type_col))


def struct_type(rows) -> T.StructType:
    """StructType from mapped ``(name, target_type)`` pairs of one table."""
    return T.StructType([T.StructField(n, T.DataType.fromDDL(t)) for n, t in rows])


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def numeric_type_text(c) -> Column:
    """Is the type text (as printed by Spark or mapped above) a number type?"""
    return F.upper(F.trim(as_col(c))).rlike(
        r"^(TINYINT|BYTE|SMALLINT|SHORT|INT|INTEGER|BIGINT|LONG|FLOAT|REAL|DOUBLE|DECIMAL|NUMERIC|NUMBER)\b")
