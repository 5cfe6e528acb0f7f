"""Order of a directed graph: execution levels, strongly connected components, and levels with cycles as one node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path, staged

#: Rounds of levels after which what is left is contracted.
CONTRACT_ROUNDS = 8
#: No path: less than any level.
NEVER = -1


class Rounds:
    """The rows that rounds of one computation wrote, each round in a folder of its own; a plan that reads them never grows."""

    def __init__(self, spark, name: str, schema: str):
        self.spark, self.schema, self.path, self.number = spark, schema, scratch_path(spark, name), 0

    def add(self, df: DataFrame) -> DataFrame:
        place = f"{self.path}/round={self.number}"
        df.write.parquet(place)
        self.number += 1
        return self.spark.read.schema(self.schema).parquet(place)

    def all(self) -> DataFrame:
        if not self.number:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path)


def topo_levels(edges: DataFrame) -> DataFrame:
    """Execution level of every node: 0 without predecessors, else one more than the deepest one.

    Each round places the nodes whose last open edges leave the nodes just placed; only these edges' counts and these nodes are
    written. After some rounds, what is left is contracted: a node with one open predecessor hangs on it, chains of such nodes
    are resolved by pointer doubling, and their edges move to the head of the chain. So a chain of n nodes takes about log n
    rounds. Nodes that are never placed lie on or behind a cycle: level NULL, ``cyclic`` true.
    """
    return _levels(staged(edges.select("src", "dst").distinct(), "links"))


def _levels(both: DataFrame) -> DataFrame:
    """``topo_levels`` of distinct edges that are stored."""
    spark = both.sparkSession
    kind = both.schema["src"].dataType.simpleString()
    links = both.select("src", "dst", F.lit(1).alias("w"), F.lit(NEVER).alias("c"))  # a level is at least c, and w beyond src
    degree = staged(links.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("degree")), "degree")
    behind = degree.select("id")
    placed = Rounds(spark, "placed", f"id {kind}, level int")
    counted = Rounds(spark, "counted", f"id {kind}, n long, level int, degree long")
    ready = placed.add(links.select(F.col("src").alias("id")).distinct().join(degree, "id", "left_anti").select("id", F.lit(0).alias("level")))
    hung, since = [], 0
    while not ready.isEmpty():
        step = counted.add(
            links.join(ready.select(F.col("id").alias("src"), "level"), "src")
            .groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.max(F.greatest("c", F.col("level") + F.col("w"))).alias("level"))
            .join(degree, "id").select("id", "n", "level", "degree"))
        late = counted.all().where("n < degree").join(step.where("n < degree").select("id"), "id", "left_semi")
        late = late.groupBy("id", "degree").agg(F.sum("n").alias("n"), F.max("level").alias("level")).where("n = degree")
        ready = placed.add(step.where("n = degree").select("id", "level").unionByName(late.select("id", "level")))
        since += 1
        if since == CONTRACT_ROUNDS and not ready.isEmpty():
            links, degree, more = _contracted(links, placed.all(), counted.all(), ready)
            counted, since = Rounds(spark, "counted", counted.schema), 0
            hung.append(more)
    known = placed.all()
    for more in reversed(hung):
        level = F.greatest("c", F.col("level") + F.col("w")).alias("level")
        known = staged(known.unionByName(more.join(known.withColumnRenamed("id", "head"), "head").select("id", level)), "known")
    never = behind.join(known, "id", "left_anti")  # a node without predecessors is placed at once
    return known.select("id", "level", F.lit(False).alias("cyclic")).unionByName(never.select("id", F.lit(None).cast("int").alias("level"), F.lit(True).alias("cyclic")))


def _contracted(links: DataFrame, placed: DataFrame, counted: DataFrame, ready: DataFrame) -> tuple:
    """The open graph with every chain of single predecessors drawn together at its head.

    Gives its links, its in-degrees and the nodes that hang on a head (``id, head, w, c``): the level of such a node is at least ``c`` and ``w``
    beyond its head's. Nodes on a chain without a head lie on or behind a cycle and stay. Nodes just placed still have open links.
    """
    settled = placed.join(ready.select("id"), "id", "left_anti")
    open_links = staged(links.join(settled.select(F.col("id").alias("src")), "src", "left_anti"), "open")
    base = counted.groupBy("id").agg(F.max("level").alias("base"))  # what settled predecessors ask for
    first = placed.select("id")
    into = open_links.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.first("src").alias("head"), F.first("w").alias("w"), F.first("c").alias("c"))
    single = into.where("n = 1").join(first, "id", "left_anti").join(base, "id", "left")
    chain = staged(single.select("id", "head", "w", F.greatest("c", F.coalesce("base", F.lit(NEVER))).alias("c")), "chain")
    before = None
    while True:
        up = chain.select(F.col("id").alias("head"), F.col("head").alias("up"), F.col("w").alias("uw"), F.col("c").alias("uc"))
        left = chain.join(up.select("head"), "head", "left_semi").count()
        if left == 0 or left == before:  # pointers to nodes that hang as well are halved, or run in a circle
            break
        before = left
        jumped = chain.join(up, "head", "left")
        reach = F.when(F.col("up").isNull(), F.col("c")).otherwise(F.greatest("c", F.when(F.col("uc") > NEVER, F.col("uc") + F.col("w")).otherwise(F.lit(NEVER))))
        chain = staged(jumped.select("id", F.coalesce("up", "head").alias("head"), (F.col("w") + F.coalesce("uw", F.lit(0))).alias("w"), reach.alias("c")), "chain")
    circles = chain.join(chain.select(F.col("id").alias("head")), "head", "left_semi")
    hanging = staged(chain.join(circles.select("id"), "id", "left_anti"), "hanging")
    heads = hanging.select(F.col("id").alias("src"), "head", F.col("w").alias("hw"), F.col("c").alias("hc"))
    moved = (open_links.join(hanging.select(F.col("id").alias("dst")), "dst", "left_anti").join(heads, "src", "left"))
    asked = F.when(F.col("hc") > NEVER, F.col("hc") + F.col("w")).otherwise(F.lit(NEVER))
    drawn = moved.select(F.coalesce("head", "src").alias("src"), "dst", (F.col("w") + F.coalesce("hw", F.lit(0))).alias("w"), F.greatest("c", asked).alias("c"))
    merged = drawn.groupBy("src", "dst").agg(F.max("w").alias("w"), F.max("c").alias("c"))
    # what settled predecessors ask for stays with the links that are left
    based = merged.join(base.withColumnRenamed("id", "dst"), "dst", "left").select("src", "dst", "w", F.greatest("c", F.coalesce("base", F.lit(NEVER))).alias("c"))
    new = staged(based, "links")
    degree = staged(new.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("degree")), "degree")
    return new, degree, hanging


def cycle_components(edges: DataFrame) -> DataFrame:
    """``id, component, members, cyclic`` of every node: its strongly connected component, named by its smallest node.

    Nodes that no cycle reaches, and those that reach none, are trimmed off as components of their own. In what is left every node
    takes the greatest node that reaches it as its colour; of each colour the nodes that reach its first node are one component. They
    are taken out and the rest goes on. A round follows one edge everywhere at once, so a component takes as many rounds
    as its longest shortest path. ``cyclic``: more than one member, or an edge to itself.
    """
    spark = edges.sparkSession
    links = staged(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "links")
    kind = links.schema["src"].dataType.simpleString()
    found = Rounds(spark, "components", f"id {kind}, component {kind}")
    core = _inside(_inside(links, True), False)
    while not core.isEmpty():
        colour = staged(core.select(F.col("src").alias("id")).unionByName(core.select(F.col("dst").alias("id"))).distinct().select("id", F.col("id").alias("colour")), "colour")
        while True:
            came = core.join(colour.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("colour").alias("came"))
            new = staged(colour.join(came, "id", "left").select("id", F.greatest("colour", "came").alias("colour"), (F.col("came") > F.col("colour")).alias("changed")), "colour")
            colour = new.select("id", "colour")
            if new.where("changed").isEmpty():
                break
        inner = (core.join(colour.select(F.col("id").alias("src"), "colour"), "src")
                 .join(colour.select(F.col("id").alias("dst"), F.col("colour").alias("other")), "dst").where("colour = other"))
        inner = staged(inner.select("src", "dst", "colour"), "inner")
        reached = Rounds(spark, "reached", f"id {kind}, colour {kind}")
        front = reached.add(colour.where("id = colour"))
        while not front.isEmpty():
            step = inner.join(front.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id"), "colour").distinct()
            front = reached.add(step.join(reached.all().select("id"), "id", "left_anti"))
        members = reached.all()
        found.add(members.join(members.groupBy("colour").agg(F.min("id").alias("component")), "colour").select("id", "component"))
        gone = members.select("id")
        rest = core.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        core = _inside(_inside(staged(rest, "rest"), True), False)
    everyone = links.select(F.col("src").alias("id")).unionByName(links.select(F.col("dst").alias("id"))).distinct()
    named = everyone.join(found.all(), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    sizes = found.all().groupBy("component").agg(F.count(F.lit(1)).alias("many"))
    loops = links.where("src = dst").select(F.col("src").alias("id"), F.lit(True).alias("loop"))
    return (named.join(sizes, "component", "left").join(loops, "id", "left")
            .select("id", "component", F.coalesce("many", F.lit(1)).cast("long").alias("members"), ((F.coalesce("many", F.lit(1)) > 1) | F.coalesce("loop", F.lit(False))).alias("cyclic")))


def _inside(links: DataFrame, backward: bool) -> DataFrame:
    """The links among nodes on or behind a cycle; ``backward``: on or before one. Links are distinct and stored, before and after."""
    if links.isEmpty():
        return links
    way = links.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if backward else links
    kept = staged(_levels(way).where("cyclic").select("id"), "kept")
    return staged(links.join(kept.withColumnRenamed("id", "src"), "src", "left_semi").join(kept.withColumnRenamed("id", "dst"), "dst", "left_semi"), "inside")


def condensed_levels(edges: DataFrame) -> DataFrame:
    """``id, component, members, cyclic, level``: a cycle is one step, so every node has a level, also those behind a cycle."""
    parts = staged(cycle_components(edges), "parts")
    names = parts.select("id", "component")
    between = (edges.select("src", "dst").join(names.select(F.col("id").alias("src"), F.col("component").alias("a")), "src")
               .join(names.select(F.col("id").alias("dst"), F.col("component").alias("b")), "dst")
               .where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    level = topo_levels(between).select(F.col("id").alias("component"), "level")
    return parts.join(level, "component", "left").select("id", "component", "members", "cyclic", F.coalesce("level", F.lit(0)).alias("level"))
