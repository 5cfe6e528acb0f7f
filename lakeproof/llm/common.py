"""Helpers that the text operators share: bounded Arrow batches, added columns, staged tables, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import quoted
from ..session import scratch_path

#: Rows and bytes of one Arrow batch that a Python worker holds at a time.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches small, so that workers hold a few MB of text however long the documents are."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_of(name: str = "text") -> Column:
    """The text column, an empty text where it is null."""
    return F.coalesce(quoted(name).cast("string"), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """The name, or the name with underscores added until no column of the frame has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def add_fields(df: DataFrame, struct: Column, fields: list[str]) -> DataFrame:
    """The frame with the fields of one struct expression as columns; they replace columns of the same name."""
    new, held = {f.lower() for f in fields}, fresh(df, "_fields")
    kept = [quoted(c) for c in df.columns if c.lower() not in new]
    wide = df.select(*[quoted(c) for c in df.columns], struct.alias(held))
    return wide.select(*kept, *[F.col(held)[f].alias(f) for f in fields])


def staged(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet below the shared checkpoint folder and read again: cut lineage, pruned reads."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def training_row(key: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 0 or 2 by 3: labels may be learned from this row."""
    return F.crc32(quoted(key).cast("string").cast("binary")) % 3 != 1


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_label: int) -> tuple[DataFrame | None, dict[int, int]]:
    """``doc_id, label, text`` of a bounded sample of labelled training rows, and the rows of each label in all.

    Of each label the ``per_label`` documents whose ids have the smallest hashes. Null ids and labels take
    no part; several label rows of one id count as the larger label; of several documents of one id the
    smallest text is taken. None where no document is labelled. Only ids are shuffled to choose; the
    texts of the chosen are found with a broadcast of their ids (at most ``per_label`` for each label).
    """
    known = (labels.where(quoted(label).isNotNull() & F.col("doc_id").isNotNull() & training_row())
             .groupBy("doc_id").agg((F.max(quoted(label).cast("int")) > 0).cast("int").alias("label")))
    ids = docs.select("doc_id").distinct().join(known, "doc_id")
    totals = {r["label"]: r["n"] for r in ids.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = [r for x in sorted(totals)
              for r in ids.where(F.col("label") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label).collect()]
    if not picked:
        return None, totals
    sample = docs.sparkSession.createDataFrame(picked, ids.schema)
    texts = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(sample), "doc_id")
    return texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")), totals


def local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest (``a`` < ``b``, ``a`` the root) of the edges of one partition, by union-find."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.get(top, top) != top:
            top = parent[top]
        while parent.get(x, x) != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                parent.setdefault(min(x, y), min(x, y))
    ends = [x for x in parent if root(x) != x]
    for i in range(0, len(ends), 100_000):
        part = ends[i:i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array([parent[x] for x in part], pa.int64()), pa.array(part, pa.int64())], ["a", "b"])


def components(edges: DataFrame, max_rounds: int = 90) -> DataFrame:
    """Connected components of the edges ``a, b`` (long): one row ``node, component`` per node that is not the smallest.

    ``component`` is the smallest node reachable; nodes without a row are their own component. Every partition first reduces
    its edges to a forest. Then rounds contract the graph: each node moves to its first neighbour if that comes before
    itself, links are renamed and those within a node dropped, so the live links shrink; the moves are kept apart and composed at
    the end. Two rounds of three go by number, which draws any star together, the third by a hash, which halves
    any path. First neighbours are aggregates with map-side reduction and joins are of staged rows, so one hub of any degree is split.
    """
    out = "a long, b long"
    live = staged(edges.where("a <> b").selectExpr("least(a, b) a", "greatest(a, b) b").mapInArrow(local_forest, out), "edges")
    moves: list[DataFrame] = []
    while not live.isEmpty():
        if len(moves) == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        by_hash = len(moves) % 3 == 2
        place = [f"xxhash64({{0}}, {len(moves)})", "{0}"] if by_hash else ["{0}"]
        of_v, of_u = (f"struct({', '.join(x.format(c) for x in place)})" for c in ("v", "u"))
        both = live.selectExpr("a u", "b v").unionByName(live.selectExpr("b u", "a v"))
        first = both.groupBy("u").agg(F.expr(f"min({of_v})").alias("first"), F.expr(f"min_by(v, {of_v})").alias("top"))
        moved = staged(first.where(f"first < {of_u}").select("u", "top"), "moved")
        left = live.join(moved, F.col("a") == F.col("u"), "left").selectExpr("coalesce(top, a) a", "b")
        right = left.join(moved, F.col("b") == F.col("u"), "left").selectExpr("a", "coalesce(top, b) b")
        live = staged(right.where("a <> b").selectExpr("least(a, b) a", "greatest(a, b) b").distinct(), "live")
        moves.append(moved)
    if not moves:
        return live.selectExpr("b node", "a component")
    known = moves[-1]
    for moved in reversed(moves[:-1]):
        after = known.selectExpr("u t", "top last")  # a node that others moved to has stayed, and its later move counts
        gone = moved.join(after.select("t"), F.col("u") == F.col("t"), "left_anti")
        known = staged(known.unionByName(gone.join(after, F.col("top") == F.col("t"), "left").selectExpr("u", "coalesce(last, top) top")), "known")
    least = staged(known.groupBy("top").agg(F.min("u").alias("m")).selectExpr("top t", "least(top, m) component"), "least")
    members = known.where("u <> top").unionByName(least.selectExpr("t u", "t top"))
    return members.join(least, F.col("top") == F.col("t")).where("u <> component").selectExpr("u node", "component")


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of unsigned integers (multiply and fold)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))
