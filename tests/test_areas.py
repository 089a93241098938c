"""Polygons from sides, and pieces of ways by band, against plain loops."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.test_operators import WAYS, road
from waymark.operators import dissolve, isochrones, network


def parts_of(cells, near):
    left, out = set(cells), []
    while left:
        stack, part = [left.pop()], set()
        while stack:
            c = stack.pop()
            part.add(c)
            for d in near:
                n = (c[0] + d[0], c[1] + d[1])
                if n in left:
                    left.discard(n)
                    stack.append(n)
        out.append(part)
    return out


FOUR = ((1, 0), (-1, 0), (0, 1), (0, -1))
EIGHT = (*FOUR, (1, 1), (1, -1), (-1, 1), (-1, -1))


def holes_of(cells):
    """Parts of the ground around the cells, but the outer one."""
    xs, ys = [c[0] for c in cells], [c[1] for c in cells]
    ground = {(x, y) for x in range(min(xs) - 1, max(xs) + 2) for y in range(min(ys) - 1, max(ys) + 2)} - set(cells)
    return [p for p in parts_of(ground, EIGHT) if (min(xs) - 1, min(ys) - 1) not in p]


def inside(x, y, polygon):
    odd = False
    for ring in polygon:
        for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def test_cell_polygons(spark):
    rng = random.Random(5)
    cells = {(k, rng.choice([1, 2]), x, y) for k in (1, 2) for x in range(-7, 7) for y in range(12) if rng.random() < 0.62}
    one = {(k, x, y): b for k, b, x, y in cells}
    # a hole with an island that has a hole
    frame = {(x, y) for x in range(30, 41) for y in range(11)} - {(x, y) for x in range(32, 39) for y in range(2, 9)} | {(x, y) for x in range(34, 37) for y in range(4, 7)} - {(35, 5)}
    one |= {(3, x, y): 1 for x, y in frame}
    df = spark.createDataFrame([(*c, b) for c, b in one.items()], "k int, cx bigint, cy bigint, band int")
    got = defaultdict(list)
    for r in isochrones.cell_polygons(df, ["k"], 50.0).collect():
        got[r.k, r.band].append(r)
    groups = defaultdict(set)
    for (k, x, y), b in one.items():
        groups[k, b].add((x, y))
    assert got.keys() == groups.keys()
    for g, own in groups.items():
        parts = parts_of(own, FOUR)
        assert len(got[g]) == len(parts) and sum(r.holes for r in got[g]) == sum(len(holes_of(p)) for p in parts)
        assert sorted(r.area for r in got[g]) == sorted(2500.0 * len(p) for p in parts)
        for r in got[g]:
            polygon = [[(p.x, p.y) for p in ring] for ring in r.polygon]
            assert all(ring[0] == ring[-1] for ring in polygon)
            held = {c for c in own if inside(c[0] * 50 + 25.1, c[1] * 50 + 24.9, polygon)}
            assert held in parts
    assert sorted(r.holes for r in got[3, 1]) == [1, 1]
    assert not isochrones.cell_polygons(df.limit(0), ["k"]).count()
    rest = isochrones.cell_difference(df, df.where("k = 1"), ["k"])
    assert rest.count() == df.where("k <> 1").count()


def square(x, y, size, turned=False):
    ring = [(x, y), (x + size, y), (x + size, y + size), (x, y + size), (x, y)]
    return ring[::-1] if turned else ring


def test_dissolved(spark):
    # three neighbours in a row, of which one is given the other way round and one has a hole; another area apart
    rows = [("a", [square(0.0, 0.0, 10.0)]), ("a", [square(10.0, 0.001, 10.0, True)]), ("a", [square(20.0, 0.0, 10.0), square(22.0, 2.0, 4.0)]), ("a", [square(50.0, 50.0, 10.0)]), ("b", [square(10.0, 10.0, 10.0)]), ("b", []), (None, [square(0.0, 0.0, 2.0)])]
    df = spark.createDataFrame(rows, "area string, polygon array<array<struct<x:double,y:double>>>")
    got = dissolve.dissolved(df.withColumnRenamed("area", "gebied"), ["gebied"])
    found = sorted((str(r.gebied), round(r.area, 6), r.holes, len(r.polygon[0])) for r in got.collect())
    assert found == [("None", 4.0, 0, 5), ("a", 100.0, 0, 5), ("a", 284.0, 1, 5), ("b", 100.0, 0, 5)]
    shells = got.where("holes = 1").select(dissolve.without_holes(F.col("polygon")).alias("p"), dissolve.without_holes(F.col("polygon"), 16.0).alias("q"), dissolve.without_holes(F.col("polygon"), 16.5).alias("r")).first()
    assert [len(x) for x in shells] == [1, 2, 1]


@pytest.mark.parametrize("keyed", [False, True])
def test_reached_pieces(spark, keyed):
    rng = random.Random(9)
    ways = [(i, rng.randrange(12), 20 + rng.randrange(12), rng.choice([0.0, 1.0, 4.0, 9.5]), 100.0 * rng.randint(1, 4), rng.random() < 0.7, rng.random() < 0.7, [(0.0, 0.0), (50.0, 0.0), (50.0, 10.0 * i)]) for i in range(60)]
    cost = {n: rng.choice([0.0, 1.5, 3.0, 8.0, 14.0]) for n in [*range(10), *range(20, 30)]}
    limits = [2.0, 5.0, 10.0]
    costs = spark.createDataFrame([(n, c) for n, c in cost.items()], "node bigint, cost double")
    keys = ["mode"] if keyed else []
    costs = costs.withColumn("mode", F.lit("x")).unionByName(costs.withColumn("mode", F.lit("y")).withColumn("cost", F.col("cost") + 1)) if keyed else costs
    got = defaultdict(list)
    for r in isochrones.reached_pieces(spark.createDataFrame(ways, WAYS), costs, limits, keys).collect():
        got[r.mode if keyed else "x", r.edge_id].append(r)
    for mode, more in (("x", 0.0), ("y", 1.0))[: 2 if keyed else 1]:
        for e, u, v, m, length, forward, backward, _ in ways:
            pieces = got.get((mode, e), [])
            for k in range(200):
                s = (k + 0.4217) / 200
                options = [cost[u] + more + s * m for _ in [0] if backward and u in cost] + [cost[v] + more + (1 - s) * m for _ in [0] if forward and v in cost]
                band = next((b + 1 for b, high in enumerate(limits) if options and min(options) <= high), None)
                assert [r.band for r in pieces if r.van_m < s * length < r.tot_m] == ([band] if band else [])
            for r in pieces:
                share = sum(((a.x - b.x) ** 2 + (a.y - b.y) ** 2) ** 0.5 for a, b in zip(r.line, r.line[1:], strict=False)) / (50 + 10 * e)
                assert abs(share - (r.tot_m - r.van_m) / length) < 1e-6


def test_reached_pieces_of_a_search(spark):
    net = road(spark, [(1, 1, 2, 10.0, 100.0, True, True, [(0.0, 0.0), (100.0, 0.0)]), (2, 2, 3, 10.0, 100.0, True, True, [(100.0, 0.0), (200.0, 0.0)])])
    seeds = spark.createDataFrame([(2, 0.0, 7)], "node bigint, cost double, target bigint")
    costs = network.shortest_paths(net.edges, seeds, cutoff=6.0)
    got = sorted((r.edge_id, r.band, r.van_m, r.tot_m) for r in isochrones.reached_pieces(net.ways, costs, [3.0, 6.0]).collect())
    assert got == [(1, 1, 70.0, 100.0), (1, 2, 40.0, 70.0), (2, 1, 0.0, 30.0), (2, 2, 30.0, 60.0)]
