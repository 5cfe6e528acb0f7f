"""Row differences by a tree of digests: ranges of keys are compared level by level, rows only where they differ.

The digest of a range does not depend on the order of its rows, so it is a plain aggregate; digests of neighbouring
ranges add up to that of the range above. They can be stored with a table version: then a comparison reads no
rows of a side whose digests are known, and of both sides only the ranges that differ.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .reconcile import reconcile_rows
from .skew import orderable, quoted

#: Ranges of a level in one of the level above, and levels: some 16,000 ranges in all.
FANOUT, LEVELS = 128, 2
#: Ranges that go into a filter one by one; beyond it the smallest gaps between them are read as well.
MOST_RANGES = 64
PARTS = [f"d{i}" for i in range(6)]


@dataclass(frozen=True)
class RangePlan:
    """How rows fall into ranges, and what of them is compared; the same for both sides and for stored digests.

    ``low`` and ``width`` cut a whole-number or date key into ranges of equal width; without them (``low`` None) keys are
    dealt by their digest. ``types`` holds the common type of every compared column.
    """
    key: tuple[str, ...]
    types: tuple[tuple[str, str], ...]
    low: int | None
    width: int
    fanout: int
    levels: int

    @property
    def leaves(self) -> int:
        return self.fanout ** self.levels

    def aligned(self, df: DataFrame) -> DataFrame:
        return df.select(*[quoted(c).cast(t).alias(c) for c, t in self.types])

    def place(self, cast: bool = False) -> Column:
        """The number of a row's range; null keys and keys beyond the planned bounds have ranges of their own.

        ``cast`` is for rows that are not ``aligned``.
        """
        kinds = dict(self.types)
        keys = [quoted(k).cast(kinds[k]) if cast else quoted(k) for k in self.key]
        if self.low is None:
            return F.pmod(F.xxhash64(*keys), F.lit(self.leaves)).cast("int")
        whole = F.unix_date(keys[0]).cast("bigint") if kinds[self.key[0]] == "date" else keys[0].cast("bigint")
        behind = whole - self.low  # only where it cannot leave 64 bits
        steps = F.when(whole < self.low, -1).when(whole >= self.low + self.leaves * self.width, self.leaves).otherwise(F.call_function("div", behind, F.lit(self.width)))
        return F.when(whole.isNull(), -2).otherwise(steps).cast("int")

    def within(self, ranges: list[int]) -> Column:
        """Rows of the given ranges; for planned bounds as comparisons of the key itself, which reach the scan."""
        if self.low is None:
            return self.place().isin(ranges)
        first, kind = quoted(self.key[0]), dict(self.types)[self.key[0]]

        def bound(n: int) -> Column:
            at = self.low + n * self.width
            return F.date_from_unix_date(F.lit(at)) if kind == "date" else F.lit(at)

        hit = F.lit(False)
        for a, b in joined_runs([r for r in ranges if 0 <= r < self.leaves], MOST_RANGES):
            hit = hit | ((first >= bound(a)) & (first < bound(b + 1)))
        if -1 in ranges:
            hit = hit | (first < bound(0))
        if self.leaves in ranges:
            hit = hit | (first >= bound(self.leaves))
        return hit | first.isNull() if -2 in ranges else hit


def joined_runs(numbers: list[int], most: int) -> list[tuple[int, int]]:
    """Runs of consecutive numbers; where there are more than ``most``, the smallest gaps between them are closed."""
    runs: list[list[int]] = []
    for n in sorted(numbers):
        if runs and n == runs[-1][1] + 1:
            runs[-1][1] = n
        else:
            runs.append([n, n])
    gaps = sorted(range(1, len(runs)), key=lambda i: (runs[i - 1][1] - runs[i][0], i))[:max(0, most - 1)]  # the widest stay
    out: list[tuple[int, int]] = []
    for i, (a, b) in enumerate(runs):
        if i == 0 or i in set(gaps):
            out.append((a, b))
        else:
            out[-1] = (out[-1][0], b)
    return out


def plan_ranges(src: DataFrame, cand: DataFrame, key: list[str], cols: list[str] | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> RangePlan:
    """Ranges for two versions of a table: by value where the first key column is a whole number or a date on both sides
    (its least and greatest value are read), else by digest. Columns of two types are compared in their common type, or as text."""
    names = {c.lower() for c in key}
    compared = [*key, *[c for c in (cols or src.columns) if c.lower() not in names]]

    def common(c: str) -> str:
        a, b = (df.select(quoted(c)).schema[0].dataType for df in (src, cand))
        if a == b:
            return a.simpleString()
        if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
            return src.select(quoted(c).alias("c")).limit(0).unionByName(cand.select(quoted(c).alias("c")).limit(0)).schema[0].dataType.simpleString()
        return "string"

    types = tuple((c, common(c)) for c in compared)
    low, width, first = None, 1, types[0][1]
    if first in ("tinyint", "smallint", "int", "bigint", "date"):
        one = quoted(key[0])
        whole = F.unix_date(one.cast("date")) if first == "date" else one.cast("bigint")
        both = src.select(whole.alias("k")).unionByName(cand.select(whole.alias("k")))
        least, most = both.agg(F.min("k"), F.max("k")).first()
        if least is not None and -(1 << 61) <= least and most < 1 << 61:
            low, width = least, -(-(most - least + 1) // fanout ** levels)
    return RangePlan(tuple(key), types, low, width, fanout, levels)


def range_digests(df: DataFrame, plan: RangePlan) -> DataFrame:
    """``range, rows, d0 … d5`` of every range that has rows: sums of the parts of two 64-bit digests of each row.

    One aggregate with partial sums in every task, whatever the skew. The parts are 21 and 22 bits wide, so their sums stay exact
    for 10^12 rows of a range.
    """
    rows = plan.aligned(df)
    cells = [F.to_json(quoted(c)) if not orderable(rows.schema[c].dataType) else quoted(c) for c in rows.columns]
    cells += [quoted(c).isNull() for c in rows.columns]
    parts = []
    for seed in (0, 1):
        h = F.xxhash64(F.lit(seed), *cells)
        parts += [h.bitwiseAND(0x3FFFFF), F.shiftright(h, 22).bitwiseAND(0x1FFFFF), F.shiftrightunsigned(h, 43)]
    placed = rows.select(plan.place().alias("range"), *[p.alias(n) for p, n in zip(parts, PARTS)])
    return placed.groupBy("range").agg(F.count(F.lit(1)).alias("rows"), *[F.sum(n).alias(n) for n in PARTS])


def differing_ranges(a: DataFrame, b: DataFrame, plan: RangePlan) -> tuple[list[int], list[int]]:
    """The ranges whose digests differ, and how many ranges were compared on each level.

    The top level compares the sums of its ranges; each further level only ranges below one that differs, so of two
    nearly equal tables hardly any digest is looked at. Ranges outside the planned bounds are compared at the top.
    """
    both = a.unionByName(b.select("range", *[(-F.col(c)).alias(c) for c in ("rows", *PARTS)]))
    open_nodes, compared = None, []
    for level in range(1, plan.levels + 1):
        below = plan.fanout ** (plan.levels - level)
        node = F.floor(F.col("range") / below).cast("int")
        scope = both if open_nodes is None else both.where(F.floor(F.col("range") / (below * plan.fanout)).cast("int").isin(open_nodes))
        sums = scope.groupBy(node.alias("node")).agg(*[F.sum(c).alias(c) for c in ("rows", *PARTS)])
        differs = F.lit(False)
        for c in ("rows", *PARTS):
            differs = differs | (F.col(c) != 0)
        found = sums.select("node", differs.alias("differs")).collect()  # at most fanout for each open node, all ranges at worst
        compared.append(len(found))
        open_nodes = sorted(r["node"] for r in found if r["differs"])
        if not open_nodes:
            return [], compared
    return open_nodes, compared


def reconcile_rows_by_ranges(src: DataFrame, cand: DataFrame, key: list[str], cols: list[str] | None = None, tol: float = 0.0,
                             col_tol: dict[str, float] | None = None, plan: RangePlan | None = None,
                             stored: tuple[DataFrame | None, DataFrame | None] = (None, None)) -> DataFrame:
    """The rows of ``reconcile_rows``, reading rows a second time only in ranges that differ.

    Equal ranges hold no difference with any tolerance, so the exact digests serve for all. ``stored`` are digests of either side by
    the given ``plan``, kept from an earlier run; a side that has them is not read to compare ranges.
    """
    if any(stored) and plan is None:
        raise ValueError("stored digests need the plan they were made with")
    plan = plan or plan_ranges(src, cand, key, cols)
    a, b = (cut_lineage(range_digests(df, plan)) if known is None else known for df, known in zip((src, cand), stored))
    ranges, _ = differing_ranges(a, b, plan)

    def part(df: DataFrame) -> DataFrame:
        if not ranges:
            return df.where(F.lit(False))
        if plan.low is not None and df.schema[key[0]].dataType.simpleString() == dict(plan.types)[key[0]]:
            return df.where(plan.within(ranges))
        return df.where(plan.place(cast=True).isin(ranges))  # a key of another type is placed by its common type

    return reconcile_rows(part(src), part(cand), key, cols, tol, col_tol)
