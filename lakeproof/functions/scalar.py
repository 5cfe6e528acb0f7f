"""Warehouse scalar functions as Column helpers. All of them stay inside Catalyst expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Warehouse date-format tokens and their Java counterparts (longest first).
FORMAT_TOKENS = {"YYYY": "yyyy", "HH24": "HH", "MON": "MMM", "Mon": "MMM", "MI": "mm", "SS": "ss", "DD": "dd"}

# Spellings of the two booleans in lower case.
TRUE_SPELLINGS = ("true", "t", "1", "1.0")
FALSE_SPELLINGS = ("false", "f", "0", "0.0")

# Words that name a lake layer, most refined layer first.
LAYER_WORDS = {
    "gold": ("gold", "publish", "published", "serving", "presentation", "mart", "semantic"),
    "silver": ("silver", "curated", "conformed", "cleansed", "refined", "enriched", "processed"),
    "bronze": ("bronze", "landing", "raw", "staging", "stage", "ingest"),
}

# Model-name prefixes per build layer.
MODEL_PREFIXES = {
    "staging": ("stg_",),
    "intermediate": ("int_",),
    "marts": ("dim_", "fct_", "fact_", "mart_", "pub_", "agg_"),
}


def as_col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def java_date_format(fmt: str) -> str:
    return re.sub("|".join(FORMAT_TOKENS), lambda m: FORMAT_TOKENS[m.group()], fmt)


def to_date(c, fmt: str | None = None) -> Column:
    """Date or NULL. Unparsable text never raises, with or without a format."""
    c = as_col(c)
    return F.try_to_date(c, java_date_format(fmt)) if fmt else c.try_cast("date")


def to_char(c, fmt: str | None = None) -> Column:
    c = as_col(c)
    return F.date_format(c, java_date_format(fmt)) if fmt else c.cast("string")


def _unit(unit: str) -> str:
    u = unit.strip().lower()
    if u.startswith("day"):
        return "day"
    if u.startswith("week"):
        return "week"
    if u.startswith("month") or u in ("mm", "mon"):
        return "month"
    if u.startswith("year") or u in ("yy", "yyyy"):
        return "year"
    raise ValueError(f"unsupported date unit {unit!r}")


def dateadd(unit: str, n, c) -> Column:
    """Shift a date; months and years keep the day of month where it exists."""
    c, n = as_col(c), n if isinstance(n, Column) else F.lit(n)
    u = _unit(unit)
    if u in ("day", "week"):
        return F.date_add(c, (n * (7 if u == "week" else 1)).cast("int"))
    return F.add_months(c, (n * (12 if u == "year" else 1)).cast("int"))


def datediff(unit: str, start, end) -> Column:
    """Whole days, weeks, months or years from start to end (full months, not calendar boundaries)."""
    start, end = as_col(start), as_col(end)
    u = _unit(unit)
    if u == "day":
        return F.datediff(end, start)
    if u == "week":
        return (F.datediff(end, start) / 7).cast("int")
    months = F.months_between(end, start)
    return (months if u == "month" else months / 12).cast("int")


def try_to_number(c) -> Column:
    return as_col(c).try_cast("double")


try_to_decimal = try_to_number


def iff(cond: Column, then, other) -> Column:
    return F.when(cond, then).otherwise(other)


def zeroifnull(c) -> Column:
    return F.coalesce(as_col(c), F.lit(0))


def nullifzero(c) -> Column:
    return F.nullif(as_col(c), F.lit(0))


def surrogate_key(*cols) -> Column:
    """Engine-local integer key; never comparable with a key made by another engine."""
    return F.abs(F.xxhash64(*[as_col(c) for c in cols]))


def record_hash(*cols) -> Column:
    """SHA-256 over all values; NULL and the empty string hash differently."""
    parts = [F.coalesce(as_col(c).cast("string"), F.lit("\u0000")) for c in cols]
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def flatten(df: DataFrame, c, value: str = "value", position: str | None = None, outer: bool = False) -> DataFrame:
    """One row per element of an array (or per entry of a map) column, all other columns kept."""
    c = as_col(c)
    if position:
        gen = (F.posexplode_outer if outer else F.posexplode)(c)
        return df.select("*", gen.alias(position, value))
    return df.select("*", (F.explode_outer if outer else F.explode)(c).alias(value))


def json_path(c, path: str, dtype: str = "string") -> Column:
    """Typed access into JSON text; malformed text and missing paths give NULL."""
    return F.get_json_object(as_col(c), path).try_cast(dtype)


def listagg(c, sep: str = ",") -> Column:
    """Sorted, separated text of a group. The group's text must fit one row: use on bounded groups."""
    return F.array_join(F.array_sort(F.collect_list(as_col(c))), sep)


def serial_to_date(c) -> Column:
    """Spreadsheet day serial (day 0 is 30 December 1899); the time fraction is cut."""
    return F.date_add(F.lit("1899-12-30").cast("date"), F.floor(as_col(c).try_cast("double")).cast("int"))


def flag_to_boolean(c) -> Column:
    text = F.lower(F.trim(as_col(c).cast("string")))
    return F.when(text.isin(*TRUE_SPELLINGS), True).when(text.isin(*FALSE_SPELLINGS), False)


def date_attributes(c) -> dict[str, Column]:
    """Calendar attributes computed from the date itself."""
    c = as_col(c)
    return {
        "year": F.year(c),
        "quarter": F.quarter(c),
        "month": F.month(c),
        "day_of_week": F.dayofweek(c),
        "month_key": F.date_format(c, "yyyy-MM"),
    }


def once(df: DataFrame, keep: list[str], cols: dict[str, Column]) -> DataFrame:
    """Add columns as the output of a generator, which the optimizer neither inlines nor pushes filters
    through: an expression used several times later is still evaluated once per row."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def norm_name(c) -> Column:
    """Dotted identifier without quotes, in lower case, empty parts dropped."""
    parts = F.transform(F.split(as_col(c), r"\."), lambda p: F.regexp_replace(F.trim(p), r"^[\"`'\s]+|[\"`'\s]+$", ""))
    return F.lower(F.array_join(F.filter(parts, lambda p: p != ""), "."))


def base_name(c) -> Column:
    """Last dotted part of an identifier, normalised."""
    return F.substring_index(norm_name(c), ".", -1)


def _any_word(c: Column, words) -> Column:
    return c.rlike("|".join(words))


def canonical_layer(c) -> Column:
    """gold, silver, bronze or NULL by the words in the text; the most refined layer wins."""
    text, out = F.lower(as_col(c)), None
    for layer, words in LAYER_WORDS.items():
        hit = _any_word(text, words)
        out = F.when(hit, layer) if out is None else out.when(hit, layer)
    return out


def model_layer(c, schema=None) -> Column:
    """staging, intermediate or marts by name prefix, then by the schema the model targets."""
    name, out = F.lower(as_col(c)), None
    for layer, prefixes in MODEL_PREFIXES.items():
        hit = name.rlike("^(" + "|".join(prefixes) + ")")
        out = F.when(hit, layer) if out is None else out.when(hit, layer)
    if schema is not None:
        out = out.when(F.lower(as_col(schema)) == "gold", "marts")
    return out.otherwise("staging")
