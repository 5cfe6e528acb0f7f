"""Members of keys in tasks of bounded size: hot keys are cut into chunks whose pairs are separate units."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def in_units(df: DataFrame, key: str, member: str, chunk: int, size: str | None = None) -> DataFrame:
    """The rows with a column ``unit``, sorted by key and unit within partitions of whole units.

    A key of more than ``chunk`` rows (or of that sum of the ``size`` column) is cut into chunks by a hash
    of the member; each two of its chunks, and so each two of its members, meet in one unit, which holds no
    more than two chunks. Only the counts of such keys are gathered; the join with them is planned by the
    size of what was written.
    """
    total = F.sum(size) if size else F.count(F.lit(1))
    hot = staged(df.groupBy(key).agg(total.alias("_n")).where(F.col("_n") > chunk), "hot")
    marked = df.join(hot, key, "left")
    parts = F.ceil(F.col("_n") / chunk).cast("int")
    mine = F.pmod(F.xxhash64(member), parts).cast("int")
    others = F.transform(F.sequence(F.lit(0), parts - 1), lambda x: F.least(x, mine).cast("long") * parts + F.greatest(x, mine))
    units = F.when(F.col("_n").isNull(), F.array(F.lit(0).cast("long"))).otherwise(others)
    return (marked.select(*df.columns, F.explode(units).alias("unit"))
            .repartition(key, "unit").sortWithinPartitions(key, "unit"))


def runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole (key, unit) runs, the first two columns, with the row where each run starts and the end."""
    held: pa.Table | None = None

    def starts(table: pa.Table) -> np.ndarray:
        key, unit = (table.column(c).to_numpy() for c in columns[:2])
        return np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (unit[1:] != unit[:-1])]) if len(key) else np.zeros(0, int)

    for batch in batches:
        part = pa.Table.from_batches([batch]).select(columns)
        table = part if held is None else pa.concat_tables([held, part])
        if not len(table):
            continue
        at = starts(table)
        if at[-1]:
            yield table.slice(0, at[-1]), at
        held = table.slice(at[-1])
    if held is not None and len(held):
        yield held, np.array([0, len(held)])


def edges_batch(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def forest(n: int, linked: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect what is connected among n members.

    ``linked(i, open)`` gives the members linked to i among those marked open. A search from member to
    member: whoever was reached is not compared again, so members of one dense group cost little, and at
    most n - 1 links come out however many there are.
    """
    waiting, left, out = np.ones(n, dtype=bool), n, []
    for first in range(n):
        if not waiting[first]:
            continue
        waiting[first], queue = False, [first]
        left -= 1
        while queue and left:
            i = queue.pop()
            found = linked(i, waiting).tolist()
            waiting[found] = False
            left -= len(found)
            out += [(i, j) for j in found]
            queue += found
    return out
