import random

import pytest
from frames import rows
from pyspark.sql import functions as F

from lakeproof.operators import order


def plain_levels(edges):
    nodes = {x for e in edges for x in e}
    before = {n: {a for a, b in edges if b == n} for n in nodes}
    level, found = {}, True
    while found:
        found = {n: max((level[p] + 1 for p in before[n]), default=0) for n in nodes - level.keys() if before[n] <= level.keys()}
        level |= found
    return {n: level.get(n) for n in nodes}


def plain_components(edges):
    nodes = {x for e in edges for x in e}
    reach = {n: {n} for n in nodes}
    grown = True
    while grown:
        grown = False
        for a, b in edges:
            if not reach[b] <= reach[a]:
                reach[a] |= reach[b]
                grown = True
    return {n: frozenset(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}


def graph(seed):
    draw = random.Random(seed)
    pairs = {(draw.randrange(30), draw.randrange(30)) for _ in range(35)}
    tails = {(a, a + 1) for a in [*range(100, 125), *range(140, 150)]} | {(125, 5), (7, 140), (200, 201), (201, 200), (201, 202), (202, 203), (60, 60), (60, 61)}
    return sorted({(a, b) for a, b in pairs if a < b or draw.random() < 0.15} | tails)


@pytest.mark.parametrize("rounds", [1, 2, 8])
def test_levels_with_contraction_after_any_number_of_rounds(spark, monkeypatch, rounds):
    monkeypatch.setattr(order, "CONTRACT_ROUNDS", rounds)
    edges = graph(rounds)
    got = order.topo_levels(spark.createDataFrame(edges, "src int, dst int"))
    assert {r["id"]: r["level"] for r in got.collect()} == plain_levels(edges)
    assert got.where("cyclic <> (level is null)").isEmpty()


def test_a_long_chain_takes_few_rounds(spark):
    links = spark.range(2000).selectExpr("id as src", "id + 1 as dst").unionByName(spark.sql("select 3000L as src, 1990L as dst"))
    got = order.topo_levels(links)
    assert got.where("id = 3000").first()["level"] == 0
    assert got.where("id <> 3000 and level <> id").isEmpty() and got.count() == 2002


@pytest.mark.parametrize("seed", [1, 2])
def test_components_and_levels_of_the_condensed_graph(spark, seed):
    edges = graph(seed + 10)
    parts = plain_components(edges)
    name = {n: min(p) for n, p in parts.items()}
    loops = {a for a, b in edges if a == b}
    level = plain_levels({(name[a], name[b]) for a, b in edges if name[a] != name[b]})
    expected = sorted((n, name[n], len(parts[n]), len(parts[n]) > 1 or n in loops, level.get(name[n], 0)) for n in name)
    got = order.condensed_levels(spark.createDataFrame(edges, "src int, dst int"))
    assert got.columns == ["id", "component", "members", "cyclic", "level"]
    assert sorted(map(tuple, got.collect())) == expected


def test_members_of_a_cycle_are_told_from_nodes_behind_it(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "x"), ("x", "y"), ("q", "a"), (None, "a")], "src string, dst string")
    got = {r["id"]: (r["component"], r["cyclic"], r["level"]) for r in order.condensed_levels(edges).collect()}
    assert got == {"q": ("q", False, 0), "a": ("a", True, 1), "b": ("a", True, 1), "x": ("x", False, 2), "y": ("y", False, 3)}


def test_no_edges(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert rows(order.topo_levels(none)) == rows(order.cycle_components(none)) == rows(order.condensed_levels(none)) == []


def test_a_plan_does_not_grow_with_the_rounds(spark):
    deep = spark.range(7).selectExpr("id as src", "id + 1 as dst")
    shallow = spark.range(2).selectExpr("id as src", "id + 1 as dst")
    size = lambda df: len(order.topo_levels(df).withColumn("x", F.lit(1))._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert size(deep) == size(shallow)


def test_trimming_takes_distinct_edges_as_they_are(spark, monkeypatch):
    from lakeproof.operators import order
    def again(edges):
        raise AssertionError("the edges are made distinct and stored again")
    monkeypatch.setattr(order, "topo_levels", again)
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "a"), ("b", "c"), ("r", "a"), ("s", "s"), ("c", "d"), (None, "a")], "src string, dst string")
    assert sorted(map(tuple, order.cycle_components(edges).collect())) == [
        ("a", "a", 2, True), ("b", "a", 2, True), ("c", "c", 1, False), ("d", "d", 1, False), ("r", "r", 1, False), ("s", "s", 1, True)]
