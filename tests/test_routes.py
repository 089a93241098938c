"""Legs of example routes against the results they explain."""

from __future__ import annotations

import random
from collections import defaultdict

from tests.test_operators import WAYS
from waymark.operators import access, routes


def town(spark, rng, name, speed, minutes):
    """A grid of 6 x 6 crossings with one-way streets."""
    ways = []
    for x in range(6):
        for y in range(6):
            for d, (dx, dy) in enumerate(((1, 0), (0, 1))):
                if x + dx < 6 and y + dy < 6:
                    ways.append((x * 100 + y * 10 + d, x * 6 + y, (x + dx) * 6 + y + dy, rng.choice(minutes), 100.0, rng.random() < 0.9, rng.random() < 0.7, [(x * 100.0, y * 100.0), ((x + dx) * 100.0, (y + dy) * 100.0)]))
    return access.RoadNetwork.of(name, spark.createDataFrame(ways, WAYS), speed)


def points(spark, rng, n, name, kind="bigint"):
    rows = [(i, rng.uniform(-20, 520), rng.uniform(-20, 520)) for i in range(n)]
    return spark.createDataFrame(rows, f"{name} {kind}, x double, y double")


def summed(legs):
    by_id = defaultdict(list)
    for leg in sorted(legs.collect(), key=lambda r: (r.id, r.leg)):
        by_id[leg.id].append(leg)
    for mine in by_id.values():
        assert [x.leg for x in mine] == list(range(1, len(mine) + 1))
        for a, b in zip(mine, mine[1:], strict=False):
            if a.to_node is not None and b.kind in ("weg", "deel") and b.from_node is not None:
                assert a.to_node == b.from_node
    return {i: sum(x.minutes for x in mine) for i, mine in by_id.items()}, by_id


def test_direct_routes(spark):
    rng = random.Random(4)
    net = town(spark, rng, "lopen", 80.0, [1.0, 2.0, 5.0])
    homes, shops = points(spark, rng, 80, "pand_id"), points(spark, rng, 5, "target")
    want = {r.pand_id: r.total_min for r in access.direct(homes, shops, net, "lopen", 3.0, radius=60.0).collect()}
    got, _ = summed(routes.direct_routes(homes, shops, net, 60.0, 3.0))
    assert got.keys() == {k for k, v in want.items() if v is not None} and len(got) > 60
    assert all(abs(got[k] - want[k]) <= 0.0051 for k in got)


def test_car_routes(spark):
    rng = random.Random(6)
    walk, car = town(spark, rng, "lopen", 80.0, [1.0, 1.5, 4.0]), town(spark, rng, "auto", 833.33, [0.2, 0.5])
    homes, shops, lots = points(spark, rng, 60, "pand_id"), points(spark, rng, 4, "target"), points(spark, rng, 15, "parking")
    want = {r.pand_id: r for r in access.by_car(homes, shops, lots, car, walk, 5.0, 6.0, 60.0).collect()}
    got, by_id = summed(routes.car_routes(homes, shops, lots, car, walk, 5.0, 6.0, 60.0))
    assert got.keys() == {k for k, v in want.items() if v.total_min is not None} and len(got) > 40
    # the walk counts rounded to hundredths in the result, and by its legs here
    assert all(abs(got[k] - want[k].total_min) <= 0.0101 for k in got)
    kinds = {x.kind for mine in by_id.values() for x in mine}
    assert {"aanloop", "deel", "weg", "uitloop", "parkeren"} <= kinds
    assert all([x.modus for x in mine] == sorted((x.modus for x in mine), key=["auto", "lopen"].index) for mine in by_id.values())
