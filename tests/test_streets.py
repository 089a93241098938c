"""Street networks from map elements against a plain walk along the chains."""

from __future__ import annotations

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import streets


def answer(spark, tmp_path, nodes, ways):
    """An answer of a map service, written to a file and read."""
    e = [{"type": "node", "id": i, "lon": x, "lat": y} for i, (x, y) in nodes.items()]
    e += [{"type": "way", "id": i, "nodes": n, "tags": t} for i, n, t in ways]
    e.append({"type": "relation", "id": 1})
    path = tmp_path / "answer.json"
    path.write_text(json.dumps({"version": 0.6, "elements": e}))
    from waymark.sources.files import json_document

    return json_document(spark, str(path), streets.ELEMENTS)


def metres(a, b):
    (x1, y1), (x2, y2) = a, b
    p1, p2 = math.radians(y1), math.radians(y2)
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(h))


def plain(nodes, ways, kind):
    """Edges by walking on from every node that isn't only passed: {nodes in the smaller order: (length, forward, backward)}."""
    out = {}
    for _, n, t in ways:
        one = kind != "walk" and t.get("oneway") in ("yes", "-1")
        for a, b in zip(n, n[1:], strict=False):
            if a == b or a not in nodes or b not in nodes:
                continue
            if not one or t["oneway"] == "yes":
                out.setdefault(a, set()).add(b)
            if not one or t["oneway"] == "-1":
                out.setdefault(b, set()).add(a)
    back = {}
    for a, to in out.items():
        for b in to:
            back.setdefault(b, set()).add(a)

    def passed(n):
        i, o = back.get(n, set()), out.get(n, set())
        return len(i | o) == 2 and (len(i) == len(o) == 2 or (len(i) == len(o) == 1 and i != o))

    left = {(a, b) for a, to in out.items() for b in to}
    chains = []

    def walk(a, b, stop):
        chain = [a, b]
        left.discard((a, b))
        while passed(chain[-1]) and chain[-1] != stop:
            (n,) = out[chain[-1]] - {chain[-2]}
            left.discard((chain[-1], n))
            chain.append(n)
        chains.append(tuple(chain))

    for a, b in sorted(left):
        if not passed(a):
            walk(a, b, None)
    while left:
        # the least node of what is left starts its ring
        low = min(a for a, _ in left)
        for a, b in sorted(x for x in left if x[0] == low):
            walk(a, b, low)
    edges = {}
    for c in chains:
        r = c[::-1]
        key = lambda n: (n[0], n[1], n[-2], n[-1])
        own = key(c) <= key(r)
        length, f, b = edges.get(c if own else r, (sum(metres(nodes[p], nodes[q]) for p, q in zip(c, c[1:], strict=False)), False, False))
        edges[c if own else r] = (length, f or own, b or not own)
    return edges


def town(seed):
    rng = random.Random(seed)
    nodes = {i: (5 + rng.random() / 50, 53 + rng.random() / 50) for i in range(120)}
    ways, at = [], 0
    for w in range(14):
        n = list(range(at, at + rng.randint(2, 9)))
        at += len(n)
        if w % 3:
            n = [rng.randrange(at), *n, rng.randrange(at)]
        ways.append((100 + w, n, {"highway": rng.choice(["residential", "path", "tertiary"]), "oneway": rng.choice(["no", "yes", "-1"])}))
    # rings apart from the rest, one way and both ways, one of them of two ways; a way with an unknown node
    ways += [(200, [100, 101, 102, 103, 100], {"highway": "path", "oneway": "yes"}), (201, [106, 105, 104], {"highway": "path"}), (202, [104, 107, 108, 106], {"highway": "path"}), (203, [110, 111, 9999, 112, 113], {"highway": "path"})]
    ways.append((204, [0, 114], {"highway": "construction"}))
    return nodes, ways


@pytest.mark.parametrize(("seed", "kind"), [(1, "bike"), (2, "walk"), (3, "bike")])
def test_chains_become_edges(spark, tmp_path, seed, kind):
    nodes, ways = town(seed)
    rows = streets.street_network(answer(spark, tmp_path, nodes, ways), kind, whole=True).collect()
    want = plain(nodes, ways[:-1], kind)
    got = {tuple(r.nodes): (r.length_m, r.forward, r.backward) for r in rows}
    assert got.keys() == want.keys() and len(rows) == len(got)
    for k, (length, f, b) in want.items():
        assert got[k][1:] == (f, b) and abs(got[k][0] - length) < 1e-6
    assert sorted(r.edge_id for r in rows) == list(range(min(r.edge_id for r in rows), min(r.edge_id for r in rows) + len(rows)))
    for r in rows:
        assert (r.u, r.v) == (r.nodes[0], r.nodes[-1]) and [(p.x, p.y) for p in r.line] == [nodes[n] for n in r.nodes]
        assert abs(r.minutes - r.length_m / ({"walk": 4.8, "bike": 15.0}[kind] * 1000 / 60)) < 1e-9


def test_largest_part_and_speeds(spark, tmp_path):
    nodes = {i: (5 + i / 1000, 53 + (i % 3) / 1000) for i in range(30)}
    ways = [
        (1, [0, 1, 2, 3, 4, 5], {"highway": "primary", "maxspeed": "80"}), (2, [3, 6], {"highway": "residential", "maxspeed": "30 mph"}), (3, [3, 7], {"highway": "residential"}),
        (4, [5, 8], {"highway": "tertiary", "maxspeed": "signals"}), (5, [10, 11], {"highway": "primary"}), (6, [11, 12], {"highway": "primary"}), (7, [11, 13], {"highway": "primary"}),
        (8, [0, 20], {"highway": "footway"}), (9, [0, 21], {"highway": "service"}), (10, [0, 22], {"highway": "primary", "motor_vehicle": "no"}), (11, [5, 9], {"highway": "primary", "junction": "roundabout"}),
    ]
    doc = answer(spark, tmp_path, nodes, ways)
    # a second answer that overlaps the first
    rows = {(r.u, r.v): r for r in streets.street_network(doc.unionByName(doc), "drive").collect()}
    assert rows.keys() == {(0, 3), (3, 5), (3, 6), (3, 7), (5, 8), (5, 9)}
    speed = {k: round(r.speed_kmh, 6) for k, r in rows.items()}
    mean = (80 + 80 + 48.28032) / 3
    assert speed == {(0, 3): 80, (3, 5): 80, (3, 6): 48.28032, (3, 7): 48.28032, (5, 8): round(mean, 6), (5, 9): 80}
    assert rows[0, 3].ways == [1] and rows[0, 3].nodes == [0, 1, 2, 3] and (rows[5, 9].forward, rows[5, 9].backward) == (True, False)
    fine = streets.street_network(doc, "drive", simplify=False)
    assert {(r.u, r.v) for r in fine.collect()} == {(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (3, 6), (3, 7), (5, 8), (5, 9)}
    assert not streets.street_network(doc.where(F.lit(False)), "drive").collect()


def test_parts_of_long_chains(spark):
    rng = random.Random(8)
    ids = rng.sample(range(10_000), 300)
    a, b, c = ids[:120], ids[120:220], ids[220:]
    rows = [(min(p), max(p)) for part in (a, b, c) for p in zip(part, part[1:], strict=False)]
    # as many nodes in b as in a, by one edge that passes many
    df = spark.createDataFrame([(u, v, [u, v]) for u, v in rows] + [(b[0], b[0], [b[0], *range(20_000, 20_030), b[0]])], "u bigint, v bigint, nodes array<bigint>")
    got = streets.largest_part(df).collect()
    assert {r.u for r in got} | {r.v for r in got} == set(b)
    assert len(got) == len(b)


def test_segments_are_dealt_over_all_partitions(spark):
    nodes = spark.range(50).selectExpr("id as node", "5 + id * 0.001 as x", "53d as y").coalesce(1)
    ways = spark.range(49).selectExpr("id as way_id", "array(id, id + 1) as nodes", "map('highway', 'residential') as tags").coalesce(1)
    segments = streets.street_segments(streets.of_kind(ways, "walk"), nodes)
    # few small files don't mean few tasks
    assert segments.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {(r.src, r.dst) for r in segments.collect()} == {(a, b) for n in range(49) for a, b in ((n, n + 1), (n + 1, n))}
