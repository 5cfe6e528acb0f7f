"""Exact top-k inner products by a dual-tree search: cover trees over queries and over data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.skew import quoted
from .common import bounded_batches, staged

#: Most pivots of the top level, which vectors are gathered around (no more than there are blocks to fill;
#: a bounded sample, it bears on speed alone).
PIVOTS = 64
#: Vectors of a data block and of a query block, and of a leaf of their trees.
DATA_BLOCK, QUERY_BLOCK, LEAF = 4096, 1024, 256
#: A centre that covers fewer than a leaf's rows by this part makes no child, and so many of them in a row end the search for centres.
SMALL, FUTILE = 4, 16
#: Data blocks that each query block searches first, to know a k-th score before it asks others.
SEEDS = 2
SCALE = 64


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """``id, v``: floor(scale * x) of every component (as whole doubles); vectors with a null or non-finite one are left out."""
    wide = F.transform(quoted(vec_col), lambda x: x.cast("double"))
    sound = quoted(vec_col).isNotNull() & F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (df.where(quoted(id_col).isNotNull() & F.coalesce(sound, F.lit(False)))
            .select(quoted(id_col).cast("long").alias("id"), F.transform(wide, lambda x: F.floor(x * scale).cast("double")).alias("v")))


def matrix(vectors: list | pd.Series, width: int) -> np.ndarray:
    """Rows of the given width; shorter vectors are filled up with zeros, which add nothing to a product."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


class CoverTree:
    """A cover tree over rows: the children's centres of a node are farther apart than half its scale, and cover it.

    Built from the top: of a node's rows the first not yet covered becomes a centre (its own centre comes
    first), and takes all rows within half the scale; so on down to leaves. Rows that are about as far from each other as
    from any centre would be nodes of one row each: what such centres cover is gathered into whole leaves around the mean.
    Nodes keep the largest distance of a row from their centre, which is what bounds scores.
    """

    def __init__(self, rows: np.ndarray, leaf: int = LEAF):
        self.rows, self.leaf = rows, leaf
        self.nodes: list[tuple[np.ndarray, float, float, list[int], np.ndarray]] = []
        everyone = np.arange(len(rows))
        self.root = self.build(everyone, 0, self.reach(everyone, 0)) if len(rows) else -1

    def reach(self, members: np.ndarray, centre: int) -> np.ndarray:
        return np.sqrt(((self.rows[members] - self.rows[centre]) ** 2).sum(axis=1))

    def build(self, members: np.ndarray, centre: int, far: np.ndarray) -> int:
        radius, children = float(far.max()), []
        if len(members) > self.leaf and radius > 0:
            scale = radius / 2
            rest, at = members, centre
            distances, loose, futile = far, [], 0
            while len(rest):
                near = distances <= scale
                if near.sum() * SMALL >= self.leaf:
                    children.append(self.build(rest[near], at, distances[near]))
                    futile = 0
                else:
                    loose.append(rest[near])
                    futile += 1
                rest = rest[~near]
                if futile == FUTILE:
                    loose.append(rest)
                    break
                if len(rest):
                    at = int(rest[0])
                    distances = self.reach(rest, at)
            if loose:
                gathered = np.concatenate(loose)
                children += [self.gathered(gathered[i:i + self.leaf]) for i in range(0, len(gathered), self.leaf)]
        return self.node(self.rows[centre], radius, children, members)

    def gathered(self, members: np.ndarray) -> int:
        """A leaf around the mean of rows that no centre covers."""
        middle = self.rows[members].mean(axis=0)
        return self.node(middle, float(np.sqrt(((self.rows[members] - middle) ** 2).sum(axis=1)).max()), [], members)

    def node(self, middle: np.ndarray, radius: float, children: list[int], members: np.ndarray) -> int:
        self.nodes.append((middle, float(np.linalg.norm(middle)), radius, children, members))
        return len(self.nodes) - 1


def bound(q: tuple, d: tuple) -> float:
    """No query below the first node and row below the second have a larger product (with room for rounding)."""
    score = float(q[0] @ d[0]) + q[1] * d[2] + d[1] * q[2] + q[2] * d[2]
    return score + 1e-9 * (q[1] + q[2]) * (d[1] + d[2]) + 1e-6


class Best:
    """The k best of each query: scores (highest first) and ids, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, k: int, floor: np.ndarray):
        self.ids, self.k = ids, k
        self.score = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.floor = floor

    def worst(self, members: np.ndarray) -> float:
        """The lowest k-th score of a group of queries: what a row must reach to matter to any."""
        return float(np.maximum(self.score[members, -1], self.floor[members]).min())

    def add(self, members: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        scores = np.where(ids[None, :] == self.ids[members][:, None], -np.inf, scores)
        hit = scores >= np.maximum(self.score[members, -1], self.floor[members])[:, None]
        useful = hit.any(axis=1)
        members, scores, hit = members[useful], scores[useful], hit[useful]
        if not len(members):
            return
        if scores.shape[1] > self.k:  # what is below the k-th of these rows alone is among the best of no query
            hit &= scores >= np.partition(scores, -self.k, axis=1)[:, -self.k, None]
        owner, column = np.nonzero(hit)
        held = np.repeat(np.arange(len(members)), self.k)
        score = np.concatenate([self.score[members].ravel(), scores[owner, column]])
        found = np.concatenate([self.found[members].ravel(), ids[column]])
        order = np.lexsort((found, -score, np.concatenate([held, owner])))
        counts = self.k + np.bincount(owner, minlength=len(members))
        best = order[(np.cumsum(counts) - counts)[:, None] + np.arange(self.k)]
        self.score[members], self.found[members] = score[best], found[best]


def search(queries: CoverTree, data: CoverTree, data_ids: np.ndarray, best: Best) -> None:
    """Descend both trees together; a pair of nodes is dropped when no product in it reaches the group's worst k-th score."""
    if queries.root < 0 or data.root < 0:
        return
    start = bound(queries.nodes[queries.root], data.nodes[data.root])
    stack = [(start, queries.root, data.root)]
    while stack:
        most, a, b = stack.pop()
        q, d = queries.nodes[a], data.nodes[b]
        if most < best.worst(q[4]):
            continue
        if not q[3] and not d[3]:
            best.add(q[4], data_ids[d[4]], queries.rows[q[4]] @ data.rows[d[4]].T)
            continue
        split_query = q[3] and (not d[3] or q[2] > d[2])
        pairs = [(c, b) for c in q[3]] if split_query else [(a, c) for c in d[3]]
        stack += sorted((bound(queries.nodes[x], data.nodes[y]), x, y) for x, y in pairs)


def pivots(vectors: DataFrame, width: int, n: int = PIVOTS) -> np.ndarray:
    """Vectors far from each other out of the 16 n of smallest hash: the top level, by farthest-first choice."""
    sample = matrix([r["v"] for r in vectors.orderBy(F.xxhash64("id"), "id").limit(16 * n).collect()], width)
    if not len(sample):
        return np.zeros((1, width))
    chosen, far = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def blocks(vectors: DataFrame, top: np.ndarray, width: int, size: int) -> DataFrame:
    """``block, n, centre, radius, ids, rows``: the vectors around each pivot, cut into blocks of about ``size`` by a hash of the id."""
    held = vectors.sparkSession.sparkContext.broadcast(top)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres = held.value
        square = (centres ** 2).sum(axis=1)
        for batch in batches:
            rows = matrix(batch["v"], width)
            yield pd.DataFrame({"id": batch["id"], "cell": (square - 2 * rows @ centres.T).argmin(axis=1), "v": batch["v"]})

    def packed(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("id")
        rows = matrix(batch["v"], width)
        middle = rows.mean(axis=0)
        radius = float(np.sqrt(((rows - middle) ** 2).sum(axis=1)).max())
        return pd.DataFrame([(batch["cell"].iloc[0], batch["part"].iloc[0], len(batch), middle.tolist(), radius,
                              batch["id"].to_numpy(np.int64).tobytes(), rows.tobytes())], columns=["cell", "part", "n", "centre", "radius", "ids", "rows"])

    cells = staged(vectors.mapInPandas(placed, "id long, cell int, v array<double>"), "cells")
    counts = {r["cell"]: r["n"] for r in cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, -(-n // size))]) if counts else F.create_map(F.lit(0), F.lit(1))
    cut = cells.withColumn("part", F.pmod(F.xxhash64("id"), parts[F.col("cell")]).cast("int"))
    schema = "cell int, part int, n long, centre array<double>, radius double, ids binary, rows binary"
    return staged(cut.groupBy("cell", "part").applyInPandas(packed, schema)
                  .select(F.concat_ws("/", "cell", "part").alias("block"), "n", "centre", "radius", "ids", "rows"), "blocks")


def pair_bounds(queries: DataFrame, data: DataFrame) -> DataFrame:
    """``qblock, dblock, most, middle``: for each pair of blocks the bound of their products, and that of their centres.

    Only centres and radii meet here: the stated query set against all rows, in blocks.
    """
    q = queries.selectExpr("block qblock", "centre qc", "radius qr")
    d = data.selectExpr("block dblock", "centre dc", "radius dr")
    dot = F.aggregate(F.zip_with("qc", "dc", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    pairs = q.join(d, F.lit(True)).withColumn("middle", dot)
    slack = F.lit(1 + 1e-9)
    most = F.col("middle") + (norm(F.col("qc")) * F.col("dr") + norm(F.col("dc")) * F.col("qr") + F.col("qr") * F.col("dr")) * slack + 1e-6
    return pairs.select("qblock", "dblock", most.alias("most"), "middle")


def searched(pairs: DataFrame, queries: DataFrame, data: DataFrame, width: int, k: int, floors: DataFrame | None) -> DataFrame:
    """``query_id, vec_id, score`` of the k best in each pair of blocks, but for what the floors rule out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees: dict[str, tuple[str, CoverTree]] = {}  # the last one of either side

        def tree(side: str, block: str, rows: np.ndarray) -> CoverTree:
            if trees.get(side, ("",))[0] != block:
                trees[side] = (block, CoverTree(rows))
            return trees[side][1]

        for batch in batches:
            for row in batch.itertuples():
                q_ids, d_ids = np.frombuffer(row.q_ids, np.int64), np.frombuffer(row.d_ids, np.int64)
                q_rows, d_rows = np.frombuffer(row.q_rows).reshape(-1, width), np.frombuffer(row.d_rows).reshape(-1, width)
                floor = np.full(len(q_ids), -np.inf) if row.floors is None else np.frombuffer(row.floors)
                best = Best(q_ids, min(k, len(d_ids)) if len(d_ids) else 1, floor)
                search(tree("q", row.qblock, q_rows), tree("d", row.dblock, d_rows), d_ids, best)
                real = best.score >= np.maximum(floor, np.finfo(float).min)[:, None]
                yield pd.DataFrame({"query_id": np.repeat(q_ids, best.k)[real.ravel()], "vec_id": best.found[real], "score": best.score[real].astype(np.int64)})

    q = queries.select(F.col("block").alias("qblock"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"))
    q = q.withColumn("floors", F.lit(None).cast("binary")) if floors is None else q.join(floors, "qblock", "left")
    d = data.select(F.col("block").alias("dblock"), F.col("ids").alias("d_ids"), F.col("rows").alias("d_rows"))
    return (pairs.select("qblock", "dblock").join(q, "qblock").join(d, "dblock")
            .repartition("qblock", "dblock").mapInPandas(run, "query_id long, vec_id long, score long"))


def best_of(found: DataFrame, k: int) -> DataFrame:
    """Rank the results of a query and keep k; Spark keeps only k rows of a query per task before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(df: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE,
          data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest integer inner products of each query row with all other rows.

    Ties go to the smaller id; fewer than k where there are fewer rows. Vectors that are null or hold a null
    or non-finite component, and rows without an id, take no part; shorter vectors are filled up with zeros.
    Rows that repeat id and vector count once; of one vector, only the k + 1 smallest ids can be among the
    best of any query, and only they are searched. Products are exact below 2^53.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    whole = staged(integer_vectors(df, id_col, vec_col, scale).distinct(), "vectors")
    asked = staged(integer_vectors(queries, id_col, vec_col, scale).distinct(), "queries")
    width = max(whole.agg(F.max(F.size("v"))).first()[0] or 1, asked.agg(F.max(F.size("v"))).first()[0] or 1)
    alike = Window.partitionBy("v").orderBy("id")
    data = staged(whole.withColumn("n", F.row_number().over(alike)).where(F.col("n") <= k + 1).select("id", "v"), "data")
    top = pivots(whole, width)
    d, q = (blocks(side, top[:max(1, -(-side.count() // size))], width, size) for side, size in ((data, data_block), (asked, query_block)))
    bounds = staged(pair_bounds(q, d), "bounds")
    order = Window.partitionBy("qblock").orderBy(F.desc("middle"), "dblock")
    seeds = staged(bounds.withColumn("n", F.row_number().over(order)).where(F.col("n") <= SEEDS), "seeds")
    first = staged(best_of(searched(seeds, q, d, width, k, None), k), "first")
    floors = staged(floors_of(first, q, k), "floors")
    rest = bounds.join(seeds.select("qblock", "dblock"), ["qblock", "dblock"], "left_anti").join(floors, "qblock")
    rest = rest.where(F.col("most") >= F.col("floor"))
    more = searched(rest, q, d, width, k, floors.select("qblock", "floors"))
    found = first.select("query_id", "vec_id", "score").unionByName(more)
    return best_of(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def floors_of(first: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``qblock, floor, floors``: each query's k-th score so far in the order of the block, and the lowest of them."""
    known = first.groupBy("query_id").agg(F.min("score").cast("double").alias("kth"), F.count(F.lit(1)).alias("n"))
    members = queries.select(F.col("block").alias("qblock"), "ids").mapInPandas(unpacked, "qblock string, place int, query_id long")
    kth = F.when(F.col("n") >= k, F.col("kth")).otherwise(float("-inf"))
    each = members.join(known, "query_id", "left").select("qblock", "place", F.coalesce(kth, F.lit(float("-inf"))).alias("kth"))

    def packed(batch: pd.DataFrame) -> pd.DataFrame:
        values = batch.sort_values("place")["kth"].to_numpy(float)
        return pd.DataFrame([(batch["qblock"].iloc[0], float(values.min()), values.tobytes())], columns=["qblock", "floor", "floors"])

    return each.groupBy("qblock").applyInPandas(packed, "qblock string, floor double, floors binary")


def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for block, raw in zip(batch["qblock"], batch["ids"]):
            ids = np.frombuffer(raw, np.int64)
            yield pd.DataFrame({"qblock": block, "place": np.arange(len(ids)), "query_id": ids})
