"""Hard-negative mining by exact integer scores: products of residues in float32, put together again by remainders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import quoted
from .common import staged

SCALE = 256
#: Rows of a block of all rows and of a tile of anchors, and anchors whose scores are held at a time.
BLOCK, TILE, AT_ONCE = 8192, 2048, 256
#: Components that are multiplied at a time, and the integers up to which float32 counts exactly.
SLICE, EXACT = 1024, 1 << 24
#: Squared norms from here on are no rows: five times a product of theirs would leave 64 bits.
NORM_LIMIT = 1 << 60


class Residues:
    """Integer vectors as residues modulo several primes, whose products float32 matrices give exactly.

    Residues lie around zero, so that a sum of ``SLICE`` products stays within ``EXACT``; there are as many
    primes as tell all scores up to ``bound`` apart in either sign.
    """

    def __init__(self, width: int, bound: int):
        half = int((EXACT / max(1, min(width, SLICE))) ** 0.5)
        self.primes, product = [], 1
        for p in range(2 * half + 1, 2, -1):
            if product > 2 * bound:
                break
            if all(p % x for x in range(2, int(p ** 0.5) + 1)):
                self.primes.append(p)
                product *= p

    def of(self, rows: np.ndarray) -> list[np.ndarray]:
        """A float32 matrix of residues for each prime; remainders of doubles are exact at any size."""
        out = []
        for p in self.primes:
            r = np.remainder(rows, p)
            out.append(np.where(r > p // 2, r - p, r).astype(np.float32))
        return out

    def scores(self, left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
        """All inner products as 64-bit integers, by balanced mixed-radix digits of the residues."""
        value, radix = None, 1
        for p, a, b in zip(self.primes, left, right):
            r = np.zeros((len(a), len(b)), np.int64)
            for i in range(0, a.shape[1], SLICE):
                r += (a[:, i:i + SLICE] @ b[:, i:i + SLICE].T).astype(np.int64)
            digit = (r if value is None else (r - value) % p * pow(radix, -1, p)) % p
            digit = np.where(digit > p // 2, digit - p, digit)
            value = digit if value is None else value + digit * np.int64(radix)
            radix *= p
        return value


def integer_rows(df: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """``id, label, v``: floor(scale * x) of every component as whole doubles, one row for each id."""
    wide = F.transform(quoted(vec_col), lambda x: x.cast("double"))
    sound = quoted(vec_col).isNotNull() & F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(quoted(id_col).isNotNull() & quoted(label_col).isNotNull() & F.coalesce(sound, F.lit(False))).select(
        quoted(id_col).cast("long").alias("id"), quoted(label_col).alias("label"), F.transform(wide, lambda x: F.floor(x * scale).cast("double")).alias("v"))
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("row")).select("id", "row.label", "row.v")


def matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of the given width; shorter vectors are filled up with zeros, which add nothing to a product."""
    out = np.zeros((len(vectors), width))
    at = 0
    for chunk in vectors.chunks:
        sizes = np.diff(chunk.offsets.to_numpy())
        flat = chunk.flatten().to_numpy(zero_copy_only=False)
        out[at:at + len(chunk)][np.arange(width) < sizes[:, None]] = flat
        at += len(chunk)
    return out


def greatest(scores: np.ndarray, ids: np.ndarray, among: np.ndarray, count: int) -> np.ndarray:
    """Of the positions ``among`` the ``count`` of the highest scores, the smaller ids first where scores are equal."""
    if len(among) > count:
        own = scores[among]
        among = among[own >= np.partition(own, len(own) - count)[len(own) - count]]
    return among[np.lexsort((ids[among], -scores[among]))[:count]]


def tiles(anchors: DataFrame, rows: DataFrame, many_anchors: int, many_rows: int) -> tuple:
    """Both frames dealt to the pairs of an anchor tile and a row block: the stated query set against all rows, in blocks."""
    tile_count, block_count = -(-many_anchors // TILE), -(-many_rows // BLOCK)

    def dealt(count: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")

    def each(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    left = anchors.withColumn("tile", dealt(tile_count)).withColumn("block", each(block_count))
    right = rows.withColumn("block", dealt(block_count)).withColumn("tile", each(tile_count))
    return left.groupBy("tile", "block"), right.groupBy("tile", "block")


def scored(residues: Residues, width: int, left: pa.Table, right: pa.Table) -> Iterator[tuple]:
    """``anchor position, scores of all rows`` for every anchor of a pair of tile and block."""
    theirs, own = residues.of(matrix(right["v"], width)), matrix(left["v"], width)
    for i in range(0, len(own), AT_ONCE):
        yield from enumerate(residues.scores(residues.of(own[i:i + AT_ONCE]), theirs), i)


def table(schema: str, names: list[str], rows: list[tuple]) -> pa.Table:
    """Rows of 64-bit integers."""
    held = np.array(rows, np.int64).reshape(-1, len(names))
    return pa.table({n: held[:, i] for i, n in enumerate(names)})


def hard_negatives(df: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 4, high: int = 5,
                   id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of every anchor's hard negatives.

    ``anchor`` is a condition on ``id``. An anchor's positives are its ``positives`` best other rows of its
    label; the negatives of a positive are the first ``negatives`` rows of other labels that score no more
    than the positive and at least ``low / high`` of it. Scores are inner products of floor(scale * x), exact; higher ones
    come first, ties by smaller id. Each anchor meets every row, in blocks of bounded size; a block keeps
    the best of each anchor, so what is shuffled for the selection does not grow with a label's rows.

    Rows with a null id, label or vector, or a null or non-finite component take no part, nor do those
    whose squared norm reaches 2^60 (their scores are no 64-bit integers). Of several rows of one id the
    least by label, then vector, counts. Shorter vectors are filled up with zeros. Other columns are not
    read; no rows, or no anchors, give no rows.
    """
    spark = df.sparkSession
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    rows = staged(integer_rows(df, id_col, vec_col, label_col, scale).where(norm < float(NORM_LIMIT)), "integer-rows")
    many, chosen, width, largest = rows.agg(F.count(F.lit(1)), F.count_if(anchor), F.max(F.size("v")), F.max(norm)).first()
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not chosen:
        return spark.createDataFrame([], schema)
    residues = Residues(width, int(largest * (1 + 1e-6)) + 1)
    anchors = rows.where(anchor).select(*[F.col(c).alias(c) for c in rows.columns])  # columns of their own beside those of all rows
    best, near = ["anchor_id", "id", "score"], ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]

    def same_label(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, labels = right["id"].to_numpy(), np.array(right["label"].to_pylist(), object)
        own, label, out = left["id"].to_numpy(), left["label"].to_pylist(), []
        for i, s in scored(residues, width, left, right):
            for j in greatest(s, ids, np.flatnonzero((labels == label[i]) & (ids != own[i])), positives):
                out.append((own[i], ids[j], s[j]))
        return table(schema, best, out)

    def other_label(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, labels = right["id"].to_numpy(), np.array(right["label"].to_pylist(), object)
        own, label, wanted, out = left["id"].to_numpy(), left["label"].to_pylist(), left["positives"].to_pylist(), []
        for i, s in scored(residues, width, left, right):
            other = np.flatnonzero(labels != label[i])
            held = s[other]
            for p in wanted[i]:
                among = other[(held <= p["score"]) & (high * held >= low * p["score"])]
                out += [(own[i], p["id"], ids[j], p["score"], s[j]) for j in greatest(s, ids, among, negatives)]
        return table(schema, near, out)

    def in_tiles(left: DataFrame, fn, names: list[str]) -> DataFrame:
        a, b = tiles(left, rows, chosen, many)
        return a.cogroup(b).applyInArrow(fn, ", ".join(f"{n} long" for n in names))

    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    first = in_tiles(anchors, same_label, best).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives)
    wanted = staged(first.groupBy("anchor_id").agg(F.collect_list(F.struct("id", "score")).alias("positives")), "positives")
    asked = anchors.join(wanted.withColumnRenamed("anchor_id", "id"), "id")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    found = in_tiles(asked, other_label, near).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return found.select(*names)
