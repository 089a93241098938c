"""Searches by regions against the search by rounds and against Dijkstra's."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from tests.test_operators import dijkstra
from waymark.operators import network, regions

EDGE, SEED = "src bigint, dst bigint, weight double", "node bigint, cost double, target bigint"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_the_search_by_rounds(spark, seed):
    rng = random.Random(seed)
    # weights of nothing and equal ones make ties and circles
    edges = [(rng.randrange(60), rng.randrange(60), float(rng.choice([0, 0, 1, 1, 2, 5]))) for _ in range(150)]
    big = 1 << 60
    edges = [(big + a, big + b, w) for a, b, w in edges]
    seeds = [(big + 3, 0.0, 3), (big + 17, 2.0, 17), (big + 17, 2.0, 9), (big + 40, 1.0, None)]
    e, s = spark.createDataFrame(edges, EDGE), spark.createDataFrame(seeds, SEED)
    # some nodes have no region
    home = spark.range(50).select((F.col("id") + big).alias("node"), (F.col("id") % 4).alias("region"))
    for cutoff in (None, 3.0):
        want = {r.node: (r.cost, r.target) for r in network.shortest_paths(e, s, cutoff=cutoff).collect()}
        tree = regions.regional_paths(e, s, home, cutoff=cutoff).collect()
        assert {r.node: (r.cost, r.target) for r in tree} == want and len(tree) == len(want)
        label, hop = {r.node: r for r in tree}, {r.node: r.next_node for r in tree}
        weight = {}
        for a, b, w in edges:
            weight.setdefault((a, b), set()).add(w)
        for r in tree:
            if r.next_node is not None:
                after = label[r.next_node]
                assert after.target == r.target and r.cost - after.cost in weight[r.node, r.next_node]
            steps, n = 0, r.node
            while hop[n] is not None:
                n, steps = hop[n], steps + 1
                assert steps < 100


def test_keys_and_text_targets(spark):
    e = spark.createDataFrame([("a", 1, 2, 1.0), ("b", 1, 2, 5.0), ("b", 2, 3, -1.0), ("b", 2, 3, None)], "k string, " + EDGE)
    s = spark.createDataFrame([("a", 2, 0.0, "x"), ("b", 2, 0.0, "y"), ("b", None, 0.0, "y"), ("b", 3, None, "y")], "k string, node bigint, cost double, target string")
    home = spark.createDataFrame([(1, 1), (2, 2), (2, 5)], "node bigint, region bigint")
    got = {(r.k, r.node): (r.cost, r.target, r.next_node) for r in regions.regional_paths(e, s, home, ["k"]).collect()}
    assert got == {("a", 1): (1.0, "x", 2), ("a", 2): (0.0, "x", None), ("b", 1): (5.0, "y", 2), ("b", 2): (0.0, "y", None)}
    nothing = regions.regional_paths(e, s.limit(0), home, ["k"])
    assert nothing.columns == ["k", "node", "cost", "target", "next_node"] and not nothing.collect()
    alone = regions.regional_paths(e.limit(0), s, home, ["k"]).collect()
    assert {(r.k, r.node) for r in alone} == {("a", 2), ("b", 2)}


def test_a_long_chain_ends_soon(spark):
    n = 2000
    e = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), (F.col("id") % 3 + 1).cast("double").alias("weight"))
    s = spark.createDataFrame([(n, 0.0, n)], SEED)
    home = regions.node_regions(spark.range(n + 1).select(F.col("id").alias("node"), (F.col("id") * 100.0).alias("x"), F.lit(0.0).alias("y")), 20_000.0)
    assert home.select("region").distinct().count() == 11
    begun = time.monotonic()
    got = {r.node: r.cost for r in regions.regional_paths(e, s, home).collect()}
    assert time.monotonic() - begun < 60
    assert got == {k: c for k, (c, _) in dijkstra([(i, i + 1, float(i % 3 + 1)) for i in range(n)], [(n, 0.0, n)]).items()}


def test_crowded_squares_are_quartered(spark):
    rng = random.Random(5)
    places = [(i, rng.uniform(0, 1000), rng.uniform(0, 1000)) for i in range(400)] + [(1000 + i, 5.0, 5.0) for i in range(200)] + [(5000, None, 1.0), (5001, float("nan"), 1.0), (3, 5000.0, 5000.0)]
    got = regions.node_regions(spark.createDataFrame(places, "node bigint, x double, y double"), 1000.0, 60).collect()
    assert sorted(r.node for r in got) == [*range(400), *range(1000, 1200)]
    count = {}
    for r in got:
        count[r.region] = count.get(r.region, 0) + 1
    assert max(count.values()) <= 60 and len(count) > 10
