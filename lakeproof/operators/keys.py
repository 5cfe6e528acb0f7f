"""Composite keys of a table that declares none: a level-wise search for the smallest sets of columns that tell all rows apart."""

from __future__ import annotations

from itertools import combinations
from math import prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import small_frame
from .profile import distinct_counts
from .skew import quoted

#: Deviation of the sketches that sets are pruned by, how many times of it a count may be off, and sketches in one aggregate.
DEVIATION, SAFETY, AT_ONCE = 0.02, 5, 100
#: A set with a value repeated in one slice of so many by digest is no key; only the others are counted in full.
SLICES = 64


def _digest(df: DataFrame, columns: tuple[str, ...]):
    cells = [F.to_json(quoted(c)) if isinstance(df.schema[c].dataType, (T.MapType, T.VariantType)) else quoted(c) for c in columns]
    return F.struct(*cells)


def minimal_keys(df: DataFrame, cols: list[str] | None = None, most: int = 3) -> DataFrame:
    """``columns, size``: every set of up to ``most`` columns whose values are never repeated and of which no part is such a set.

    Columns with nulls are in no key; a table without rows has none. One aggregate gives counts, nulls and sketches of all columns. A
    set is only looked at if the distinct values of its columns could, multiplied, tell all rows apart; sketches of the sets
    of a level then leave those that come near the number of rows. Of these, sets that repeat a value within one slice of
    the digests are no keys, which shuffles a slice; only the rest are counted exactly, together in one
    shuffle of 64-bit digests, and sets that repeat one of these again by 128 bits. The sketches prune by ``SAFETY`` times their deviation, so a key is missed about once in a million sets.
    """
    names = list(cols or df.columns)
    least = 1 - SAFETY * DEVIATION
    whole = F.approx_count_distinct(F.xxhash64(_digest(df, tuple(names))), DEVIATION).alias("whole")
    first = df.agg(F.count(F.lit(1)).alias("rows"), whole, *[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(names)],
                   *[F.approx_count_distinct(F.xxhash64(_digest(df, (c,))), DEVIATION).alias(f"d{i}") for i, c in enumerate(names)]).first()
    rows, found = first["rows"], []
    able = [c for i, c in enumerate(names) if first[f"n{i}"] == rows]
    distinct = {c: first[f"d{i}"] / least for i, c in enumerate(names)}  # at most so many
    if rows and first["whole"] >= least * rows:  # else whole rows repeat
        for size in range(1, most + 1):
            sets = [s for s in combinations(able, size) if not any(set(k) <= set(s) for k in found) and prod(distinct[c] for c in s) >= rows]
            near = []
            for at in range(0, len(sets), AT_ONCE):
                part = sets[at:at + AT_ONCE]
                if size == 1:
                    near += [s for s in part if distinct[s[0]] * least >= least * rows]
                    continue
                seen = df.agg(*[F.approx_count_distinct(F.xxhash64(_digest(df, s)), DEVIATION).alias(f"s{i}") for i, s in enumerate(part)]).first()
                near += [s for i, s in enumerate(part) if seen[i] >= least * rows]
            if near:
                wide = df.select(*[_digest(df, s).alias(f"s{i}") for i, s in enumerate(near)])
                repeats = {r["column"] for r in distinct_counts(wide, wide.columns, slices=SLICES).where("repeated > 0").collect()}
                wide = wide.select(*[c for c in wide.columns if c not in repeats])
                if not wide.columns:
                    continue
                unlike = {r["column"] for r in distinct_counts(wide, wide.columns, short=True).where("repeated = 0").collect()}
                rest = wide.select(*[c for c in wide.columns if c not in unlike])  # repeated, or of equal 64-bit digests
                if rest.columns:
                    unlike |= {r["column"] for r in distinct_counts(rest, rest.columns).where("repeated = 0").collect()}
                found += [s for i, s in enumerate(near) if f"s{i}" in unlike]
    if not found:
        return df.sparkSession.createDataFrame([], "columns array<string>, size int")
    named = small_frame(df.sparkSession, [("\u0000".join(s), len(s)) for s in found], "columns string, size int")
    return named.select(F.split("columns", "\u0000").alias("columns"), "size")
