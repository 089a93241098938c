"""Operators against brute force and hand-made fixtures."""

from __future__ import annotations

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from waymark.functions import classes, geometry
from waymark.operators import access, facilities, isochrones, maplayers, network, profiles, register, relational, reports, roads, rollup, spatial, transit
from waymark.plans import config, legends, run


def places(spark, rows, names="id bigint, x double, y double"):
    return spark.createDataFrame(rows, names)


def test_distance_join_equals_brute_force(spark):
    random.seed(1)
    a = [(i, random.uniform(-50, 50), random.uniform(-50, 50)) for i in range(80)]
    b = [(i, random.uniform(-50, 50), random.uniform(-50, 50)) for i in range(80)]
    got = {(r.id, r.rid) for r in spatial.within_distance(places(spark, a), places(spark, b, "rid bigint, rx double, ry double"), 9.0).collect()}
    assert got == {(i, j) for i, x, y in a for j, p, q in b if math.hypot(x - p, y - q) <= 9}
    near = {r.id: r.rid for r in spatial.nearest(places(spark, a), places(spark, b, "rid bigint, rx double, ry double"), 9.0, "id", "rid").collect()}
    best = {i: min((math.hypot(x - p, y - q), j) for j, p, q in b) for i, x, y in a}
    assert near == {i: j for i, (d, j) in best.items() if d <= 9}
    far = {r.id for r in spatial.far_from(places(spark, a), places(spark, b, "rid bigint, rx double, ry double"), 9.0, "id").collect()}
    assert far == set(best) - set(near)


RINGS = "array<array<struct<x:double,y:double>>>"


def box(x, y, w, h, turn=0, back=False):
    corners = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    corners = corners[turn:] + corners[:turn]
    corners = corners[::-1] if back else corners
    return [*corners, corners[0]]


def test_points_in_polygons_equal_brute_force(spark):
    """Boxes from each corner both ways, other shapes, holes (one reaches out of its shell) and points on sides; each polygon comes back as it was."""
    random.seed(7)
    shapes = [[box(random.randrange(30), random.randrange(30), 3 + k, 9 - k, k % 4, k % 2)] for k in range(8)]
    shapes += [[[(2, 2), (20, 4), (7, 19), (2, 2)]], [box(5, 5, 20, 20), box(9, 9, 6, 6)], [box(5, 5, 9, 9), box(12, 12, 15, 15)], [[(1, 1), (9, 1), (9, 9), (5, 20), (1, 1)]], [box(4, 4, 0, 8)], [box(0, 0, 9, 9), None], [], None]
    shapes = [rings and [r and [{"x": float(x), "y": float(y)} for x, y in r] for r in rings] for rings in shapes]
    polygons = spark.createDataFrame(list(enumerate(shapes)), f"rid int, polygon {RINGS}")
    points = places(spark, [(n, float(n % 36), float(n // 36)) for n in range(36 * 36)] + [(2000, None, 3.0), (2001, float("nan"), 3.0), (2002, 5.5, 5.5)])
    inside = geometry.within(F.col("x"), F.col("y"), F.col("polygon"))
    want = {(r.id, r.rid) for r in points.crossJoin(polygons.where("size(polygon) > 0")).where(inside).collect()}
    for size in (4.0, 50.0):
        got = spatial.points_in_polygons(points, polygons, size=size).collect()
        assert {(r.id, r.rid) for r in got} == want and len(got) == len(want) > 500
        assert all([[p.asDict() for p in ring] if ring else ring for ring in r.polygon] == shapes[r.rid] for r in got)
        left = spatial.points_in_polygons(points, polygons, size=size, how="left").collect()
        alone = set(range(36 * 36)) | {2000, 2001, 2002}
        assert sorted((r.id, -1 if r.rid is None else r.rid) for r in left) == sorted(want | {(n, -1) for n in alone - {n for n, _ in want}})


def test_points_in_boxes_need_no_other_test(spark, monkeypatch):
    """The test of the sides divides by zero here: boxes and points outside a polygon's bounds don't come to it."""
    monkeypatch.setattr(spatial.g, "within", lambda x, y, _: F.lit(1.0) / (x - x) > 0)
    rows = [(1, [[{"x": float(x), "y": float(y)} for x, y in box(0, 0, 40, 20)]]), (2, [[{"x": 60.0, "y": 60.0}, {"x": 70.0, "y": 60.0}, {"x": 60.0, "y": 70.0}, {"x": 60.0, "y": 60.0}]])]
    points = places(spark, [(n, float(n % 55), float(n // 55)) for n in range(55 * 55)])
    pairs = spatial.points_in_polygons(points, spark.createDataFrame(rows, f"rid int, polygon {RINGS}"), size=100.0)
    assert {(r.id, r.rid) for r in pairs.collect()} == {(x + 55 * y, 1) for x in range(1, 40) for y in range(1, 20)}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_a_crowded_cell_is_dealt_over_tasks(spark, how):
    rows = [(k, [[{"x": float(x), "y": float(y)} for x, y in box(k, k, 20 + k, 9)]]) for k in range(6)]
    polygons = spark.createDataFrame([*rows, (9, [[{"x": 90.0, "y": 1.0}, {"x": 99.0, "y": 1.0}, {"x": 90.0, "y": 9.0}, {"x": 90.0, "y": 1.0}]])], f"rid int, polygon {RINGS}")
    points = places(spark, [(n, float(n % 40), float(n // 40)) for n in range(1600)] + [(2000, 150.0, 5.0), (2001, None, 5.0), (2002, 92.0, 2.0)])
    whole = spatial.points_in_polygons(points, polygons, size=50.0, how=how)
    parts = spatial.points_in_polygons(points, polygons, size=50.0, how=how, crowd=100)
    assert parts.columns == whole.columns
    pairs = lambda df: sorted((r.id, -1 if r.rid is None else r.rid) for r in df.collect())
    assert pairs(parts) == pairs(whole) and len(pairs(parts)) > 500
    tasks = lambda df: df.where("rid < 6").select(F.spark_partition_id()).distinct().count()
    assert (tasks(whole), tasks(parts)) == (1, 4)


def test_building_match(spark):
    ring = "array(array(named_struct('x', 0D, 'y', 0D), named_struct('x', 10D, 'y', 0D), named_struct('x', 10D, 'y', 10D), named_struct('x', 0D, 'y', 10D), named_struct('x', 0D, 'y', 0D)))"
    buildings = spark.range(1).select(F.lit("p1").alias("pand_id"), F.expr(ring).alias("polygon"))
    points = places(spark, [(1, 5.0, 5.0), (2, 40.0, 5.0), (3, 400.0, 5.0)])
    got = {r.id: (r.pand_id, r.bag_match_type, r.bag_afstand_meter) for r in spatial.match_buildings(points, buildings, "id").collect()}
    assert got == {1: ("p1", "within", 0.0), 2: ("p1", "nearest", 30.0), 3: (None, "geen_match", None)}


def dijkstra(edges, seeds):
    back = {}
    for s, d, w in edges:
        back.setdefault(d, []).append((s, w))
    best, heap = {}, [(c, t, n) for n, c, t in seeds]
    heapq.heapify(heap)
    while heap:
        c, t, n = heapq.heappop(heap)
        if n in best:
            continue
        best[n] = (c, t)
        for s, w in back.get(n, ()):
            heapq.heappush(heap, (c + w, t, s))
    return best


@pytest.mark.parametrize("seed", [1, 2])
def test_shortest_paths_equal_dijkstra(spark, seed):
    random.seed(seed)
    edges = [(random.randrange(40), random.randrange(40), float(random.randint(1, 9))) for _ in range(120)]
    seeds = [(3, 0.0, 3), (17, 2.0, 17)]
    e = spark.createDataFrame(edges, "src bigint, dst bigint, weight double")
    s = spark.createDataFrame(seeds, "node bigint, cost double, target bigint")
    tree = network.shortest_paths(e, s).cache()
    want = dijkstra(edges, seeds)
    assert {r.node: (r.cost, r.target) for r in tree.collect()} == want
    cut = network.shortest_paths(e, s, cutoff=8.0)
    assert {r.node: r.cost for r in cut.collect()} == {n: c for n, (c, _) in want.items() if c <= 8}
    # flows: what starts anywhere ends at the seeds, and every edge carries its subtree
    starts = tree.select("node").withColumn("panden", F.lit(1).cast("bigint"))
    flows = {(r.src, r.dst): r.panden for r in network.flow_counts(starts, tree).collect()}
    hop = {r.node: r.next_node for r in tree.collect()}
    brute = {}
    for n in hop:
        while hop[n] is not None:
            brute[(n, hop[n])] = brute.get((n, hop[n]), 0) + 1
            n = hop[n]
    assert flows == brute
    steps = network.paths(tree.select(F.col("node").alias("id"), "node"), tree).groupBy("src", "dst").count().collect()
    assert {(r.src, r.dst): r["count"] for r in steps} == brute


def test_keys_share_one_search(spark):
    e = spark.createDataFrame([("a", 1, 2, 1.0), ("b", 1, 2, 5.0)], "k string, src bigint, dst bigint, weight double")
    s = spark.createDataFrame([("a", 2, 0.0, 2), ("b", 2, 0.0, 2)], "k string, node bigint, cost double, target bigint")
    got = {(r.k, r.node): r.cost for r in network.shortest_paths(e, s, ["k"]).collect()}
    assert got == {("a", 1): 1.0, ("a", 2): 0.0, ("b", 1): 5.0, ("b", 2): 0.0}


WAYS = "edge_id bigint, u bigint, v bigint, minutes double, length_m double, forward boolean, backward boolean, line array<struct<x:double,y:double>>"


def road(spark, rows):
    return access.RoadNetwork.of("lopen", spark.createDataFrame(rows, WAYS), 80.0)


def test_one_way_street(spark):
    net = road(spark, [(1, 1, 2, 10.0, 100.0, True, False, [(0.0, 0.0), (100.0, 0.0)])])
    target = spark.createDataFrame([(7, 80.0, 0.0)], "target bigint, x double, y double")
    seeds = network.seed_costs(access.on_network(target, net, "target"), F.lit(80.0)).collect()
    assert [(r.node, r.cost) for r in seeds] == [(1, 8.0)]
    home = spark.createDataFrame([("p", 20.0, 0.0)], "pand_id string, x double, y double")
    row = access.direct(home, target, net, "lopen", 15).first()
    assert row.total_min is None and row.within is False and row.reachable is False


def test_two_way_with_snap_and_resnap(spark):
    # the nearest way (1) is cut off; of the others, way 3 is farther than way 2 but quicker in all; the target lies 40 m off
    net = road(spark, [(1, 1, 2, 1.0, 100.0, True, True, [(0.0, 0.0), (100.0, 0.0)]), (2, 3, 4, 10.0, 100.0, True, True, [(0.0, 60.0), (100.0, 60.0)]), (3, 4, 5, 2.0, 50.0, True, True, [(100.0, 60.0), (150.0, 60.0)])])
    target = spark.createDataFrame([(7, 150.0, 100.0)], "target bigint, x double, y double")
    home = spark.createDataFrame([("p", 50.0, 5.0), ("q", 5000.0, 5.0)], "pand_id string, x double, y double")
    rows = {r.pand_id: r for r in access.direct(home, target, net, "lopen", 15).collect()}
    assert rows["p"].resnapped and rows["p"].target == 7
    assert rows["p"].network_min == 2.5 and rows["p"].total_min == round(2 + 0.5 + math.hypot(50, 55) / 80, 2) and rows["p"].within
    assert rows["q"].total_min is None


def test_parallel_edges(spark):
    ways = spark.createDataFrame([(1, 1, 2, 5.0, True, True), (2, 1, 2, 3.0, True, False)], "edge_id bigint, u bigint, v bigint, minutes double, forward boolean, backward boolean")
    got = {(r.src, r.dst): (r.weight, r.edge_id) for r in network.directed_edges(ways).collect()}
    assert got == {(1, 2): (3.0, 2), (2, 1): (5.0, 1)}


def test_parking_by_straight_line(spark):
    walk = road(spark, [(1, 1, 2, 9.0, 400.0, True, True, [(0.0, 0.0), (400.0, 0.0)])])
    shops = spark.createDataFrame([(9, 400.0, 0.0)], "target bigint, x double, y double")
    parking = spark.createDataFrame([(1, 0.0, 0.0), (2, -500.0, 0.0)], "parking bigint, x double, y double")
    rows = [(r.target, r.walk_min, r.facility, r.walk_source) for r in access.parking_targets(parking, shops, walk).collect()]
    assert rows == [(1, 5.0, 9, "luchtlijn_fallback")]
    car = access.RoadNetwork.of("auto", spark.createDataFrame([(1, 1, 2, 4.0, 1000.0, True, True, [(0.0, 0.0), (0.0, 1000.0)])], WAYS), 833.33)
    home = spark.createDataFrame([("p", 0.0, 1000.0)], "pand_id string, x double, y double")
    row = access.by_car(home, shops, parking, car, walk, 10).first()
    assert row.total_min == 9.0 and row.parking == 1 and row.target == 9 and row.within


def test_transit_profile(spark):
    # A 08:00 -> B 08:10, walk 2 min and at least 3 to C, C 08:16 -> D 08:20, egress 4 from D
    h = 3600
    rides = spark.createDataFrame([(8 * h, 8 * h + 600, 1, 2), (8 * h + 900 - 60, 8 * h + 1000, 3, 4), (8 * h + 960, 8 * h + 1200, 3, 4)], "dep bigint, arr bigint, src bigint, dst bigint")
    walks = spark.createDataFrame([(2, 3, 2.0)], "src bigint, dst bigint, minutes double")
    egress = spark.createDataFrame([(0, 4, 4.0, 77), (0, 1, 1.0, 77)], "key bigint, node bigint, minutes double, target bigint")
    day = profiles.departure_profiles(rides, walks, egress, 3.0).collect()
    got = {(r.node, r.sec): (round(r.minutes, 6), r.target) for r in day}
    # boarding at A must ride although walking from A takes one minute
    assert got[(1, 8 * h)] == (24.0, 77) and got[(3, 8 * h + 960)] == (8.0, 77)
    profile = spark.createDataFrame([(0, 1, 8 * h, 24.0, 77)], transit.PROFILE)
    row = transit.slot_profiles(profile, 7 * h + 50 * 60, 9 * h, 10).collect()
    assert [(r.aantal, r.min, r.mediaan) for r in row] == [(2, 24.0, 29.0)]


def test_transit_or_direct(spark):
    cols = "pand_id string, total_min double, network_min double, target bigint, min_min double, p90_min double, modus string"
    t = spark.createDataFrame([("a", 20.0, 19.0, 1, 18.0, 25.0, "ov_lopen"), ("b", None, None, None, None, None, "ov_lopen"), ("c", 9.0, 8.0, 1, 8.0, 10.0, "ov_lopen")], cols)
    d = spark.createDataFrame([("a", 12.0, 11.0, 5), ("b", 40.0, 39.0, 5), ("c", 10.0, 9.0, 5)], "pand_id string, total_min double, network_min double, target bigint")
    got = {r.pand_id: (r.total_min, r.target, r.reistijd_bron, r.within) for r in access.transit_or_direct(t, d, 15, 15).collect()}
    assert got == {"a": (12.0, 5, "direct_access", True), "b": (None, None, "geen_route", False), "c": (9.0, 1, "ov", True)}


def test_road_access(spark):
    flags = ", ".join(f"{s}_{d} string" for s in roads.VEHICLES.values() for d in "ht")
    none = ["N"] * 20
    car = list(none)
    car[10] = "J"
    rows = [(1, "B", ["a"], False, *car), (2, "H", None, False, *none), (3, "x", ["onbekend"], False, *none), (4, "B", ["straat"], False, *none), (5, "B", None, True, *none)]
    df = spark.createDataFrame(rows, f"wvk_id bigint, richting_bron string, wegcategorieen array<string>, op_water boolean, {flags}")
    got = {r.wvk_id: (r.heen_toegestaan, r.terug_toegestaan) for r in roads.access(df, "personenauto").collect()}
    assert got == {1: (True, False), 2: (True, False), 3: (True, True)}


def test_facility_rules(spark):
    rows = [({"amenity": "pharmacy", "name": "X"}, True), ({"name": "Dierenapotheek BENU"}, False), ({"brand": "BENU"}, True), ({}, False)]
    df = spark.createDataFrame([(r[0],) for r in rows], "tags map<string,string>")
    assert [r[0] for r in df.select(facilities.is_pharmacy(df)).collect()] == [r[1] for r in rows]
    shops = spark.createDataFrame([("supermarket", "ALDI", None), ("supermarket", "", "Jumbo Centrum"), ("supermarket", "Jumbo", "Jumbo Pick-up"), ("supermarket", "", "Jumbotron"), ("bakery", "Lidl", "Lidl")], "shop string, brand string, name string")
    assert [r[0] for r in shops.select(facilities.is_supermarket(shops)).collect()] == [True, True, False, False, False]


def test_school_matching(spark):
    key = "keys struct<exact:string,basic:string,town:string>, number bigint, postcode_key string, street_key string, town_key string"
    a = spark.createDataFrame([("p2", False, ("E", "B", "T"), 12, "P", "S", "W"), ("p1", True, ("E", "B", "T"), 12, "P", "S", "W"), ("p9", False, ("E9", "B9", "T9"), 40, "P", "S2", "W")], "pand_id string, heeft_onderwijsfunctie boolean, " + key)
    s = spark.createDataFrame([(1, ("E", "x", "x"), 12, "P", "S", "W"), (2, ("x", "B", "x"), 12, "P", "S", "W"), (3, ("x", "x", "x"), 30, "P", "Q", "W"), (4, ("x", "x", "x"), None, "Z", "Q", "Z")], "school_id bigint, " + key)
    got = {r.school_id: (r.pand_id, r.bag_match_type, r.bag_match_betrouwbaarheid) for r in facilities.match_schools(s, a).collect()}
    assert got == {1: ("p1", "adres_exact", "hoog"), 2: ("p1", "adres_postcode_huisnummer_meerdere_panden_gekozen", "controle_nodig"), 3: ("p9", "adres_postcode_huisnummer_nearest", "controle_nodig"), 4: (None, "geen_match", "controle_nodig")}


def test_services(spark):
    calendar = spark.createDataFrame([("w", *["1"] * 5, "0", "0", "20260101", "20261231")], "service_id string, monday string, tuesday string, wednesday string, thursday string, friday string, saturday string, sunday string, start_date string, end_date string")
    extra = spark.createDataFrame([("x", "20260616", "1"), ("w", "20260617", "2")], "service_id string, date string, exception_type string")
    day = lambda d: {r.service_id for r in relational.active_services(calendar, extra, d).collect()}
    assert (day("20260616"), day("20260617"), day("20260620")) == ({"w", "x"}, set(), set())


def test_isochrone_cells(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 3.0, True), (300.0, 0.0, 8.0, True), (900.0, 0.0, 4.0, False)], "x double, y double, total_min double, within boolean")
    banded = isochrones.building_bands(rows, [5.0, 10.0])
    assert {(r.band, r.aantal_panden) for r in isochrones.band_counts(banded).collect()} == {(1, 1), (2, 1)}
    cells = isochrones.band_cells(banded, reach=50.0, size=50.0)
    assert {(r.cx, r.cy): r.band for r in cells.collect()} == {(0, 0): 1, (1, 0): 1, (-1, 0): 1, (0, 1): 1, (0, -1): 1, (6, 0): 2, (7, 0): 2, (5, 0): 2, (6, 1): 2, (6, -1): 2}
    assert isochrones.cell_outlines(cells, size=50.0).count() == 24


def test_register_cascade_and_use(spark):
    relations = spark.createDataFrame([("12", "85", "2020-01-01", None, "definitief"), ("13", "85", "2024-06-01", None, "definitief"), ("14", "99", "2020-01-01", None, "definitief")], "woonplaats_id string, gemeentecode string, begin string, eind string, status string")
    assert [r[0] for r in register.towns_of(relations, ["85"], [2024]).collect()] == ["0012"]
    units = spark.createDataFrame([("p", "v1", "woonfunctie;winkelfunctie", "80", "Verblijfsobject in gebruik"), ("p", "v2", "winkelfunctie", "20,5", "Verblijfsobject gevormd"), ("q", "v3", None, "x", None)], "pand_id string, verblijfsobject_id string, gebruiksdoelen string, oppervlakte string, verblijfsobject_status string")
    got = {r.pand_id: (r.vbo_aantal, r.vbo_in_gebruik_aantal, r.vbo_woonfunctie_aantal, r.vbo_oppervlakte_totaal, r.vbo_woonoppervlakte_totaal, r.gebruiksdoelen, r.is_woonpand) for r in register.use_summary(units).collect()}
    assert got == {"p": (2, 1, 1, 100.5, 80.0, "winkelfunctie;woonfunctie", True), "q": (1, 0, 0, 0.0, 0.0, None, False)}
    history = spark.createDataFrame([("p", "v", "2020-01-01", "2024-01-01", 1), ("p", "v", "2024-01-01", "", 2), ("p", "v", "2027-01-01", None, 3)], "pand_id string, verblijfsobject_id string, vbo_begin_geldigheid string, vbo_eind_geldigheid string, vbo_voorkomen_id int")
    assert [r.vbo_voorkomen_id for r in register.current_units(history, 2026).collect()] == [2]
    with pytest.raises(ValueError):
        register.with_use(units.select("pand_id"), register.use_summary(units))


def test_garage_match(spark):
    ring = "array(array(named_struct('x', 0D, 'y', 0D), named_struct('x', 10D, 'y', 0D), named_struct('x', 10D, 'y', 10D), named_struct('x', 0D, 'y', 10D), named_struct('x', 0D, 'y', 0D)))"
    buildings = spark.range(1).select(F.lit("p1").alias("pand_id"), F.expr(ring).alias("polygon"))
    addresses = spark.createDataFrame([("A", "p1"), ("A", "p0"), ("B", "p9")], "adres_key string, pand_id string")
    points = spark.createDataFrame([(1, 5.0, 5.0, "A"), (2, 50.0, 5.0, "B"), (3, None, None, "A"), (4, None, None, "Z")], "garage_id bigint, x double, y double, adres_key string")
    got = {r.garage_id: (r.match_pand_id, r.bag_match_type, r.bag_adres_valideert_punt) for r in register.match_garages(points, buildings, addresses).collect()}
    assert got == {1: ("p1", "punt_binnen_pand", True), 2: ("p9", "adres_fallback_punt_niet_in_pand", None), 3: ("p0", "adres_fallback_geen_punt", None), 4: (None, "geen_match", None)}


def test_report_tables(spark):
    rows = [("f", m, p, 15.0, within) for p, inside in ((1, {"auto"}), (2, set()), (3, {"auto", "lopen", "fiets", "ov_lopen", "ov_fiets"})) for m in ("lopen", "fiets", "auto", "ov_lopen", "ov_fiets") for within in [m in inside]]
    df = spark.createDataFrame(rows, "facility string, modus string, pand_id int, norm_min double, within boolean").withColumn("buurtcode", F.lit("b"))
    table = {r.modus: r for r in reports.mode_table(df).collect()}
    assert table["auto"].binnen == 2 and table["auto"].positie == 5 and table["lopen"].positie == 1 and table["lopen"].norm == "15"
    assert {r.buiten: r.panden for r in reports.insufficient_counts(df).collect()} == {0: 1, 1: 0, 2: 0, 3: 0, 4: 1, 5: 1}
    figures = reports.key_figures(df).first()
    assert (figures.buiten_alle, figures.alleen_auto, figures.slechtste_modaliteit, figures.beste_modaliteit) == (1, 1, "lopen", "auto")
    weak = {r.modus: (r.zwakste_modaliteit, r.buiten_alle) for r in reports.weakest_modes(reports.mode_table(df), reports.insufficient_counts(df)).collect()}
    assert weak["lopen"] == ("Ja", 1) and weak["auto"] == ("Nee", 1)
    assert reports.complete_runs(df.where("modus <> 'auto'")).count() == 0
    assert reports.car_dependence(df, ["buurtcode"]).first().alleen_auto == 1


def test_lines_and_flows(spark):
    line = [(0.0, 0.0), (100.0, 0.0), (200.0, 0.0)]
    lines = spark.createDataFrame([(1, "bus", "007", "Arriva", "A - B", line), (2, "bus", "9", "Arriva", "x", line)], "fid bigint, mode string, line_id string, operator string, route_name string, line array<struct<x:double,y:double>>")
    c = spark.createDataFrame([(5, "bus", "7", "arriva nl", "t", 150.0, 10.0, 50.0, 0.0), (6, "bus", "7", "x", "t", 150.0, 900.0, 50.0, 0.0)], "connection_id bigint, mode string, line_id string, operator string, route_text string, ax double, ay double, bx double, by double")
    got = maplayers.line_candidates(c, lines).collect()
    assert [(r.connection_id, r.fid, [(p.x, p.y) for p in r.line]) for r in got] == [(5, 1, [(150, 0), (100, 0), (50, 0)])]
    routes = spark.createDataFrame([(1, "weg", 3, None, "b", True, 7, "S"), (1, "weg", 3, None, "b", True, 7, "S"), (2, "weg", 3, None, "b", False, 8, "T")], "pand_id bigint, segment_type string, edge_id bigint, line array<struct<x:double,y:double>>, area string, within boolean, target bigint, target_name string")
    row = maplayers.flow_segments(routes, "lopen").first()
    assert (row.aantal_panden, row.aantal_panden_binnen_norm, row.aantal_panden_buiten_norm, row.voorziening_ids, row.flow.klasse) == (2, 1, 1, "7, 8", "2-40 pandroutes")


def test_static_transit_needs_a_ride(spark):
    rides = spark.createDataFrame([(1, 2, 10.0), (1, 2, 8.0), (3, 4, 5.0), (None, 2, 1.0), (2, 2, 0.0)], "src bigint, dst bigint, minutes double")
    pairs = transit.stop_pairs(rides)
    assert {(r.src, r.dst): r.minutes for r in pairs.collect()} == {(1, 2): 8.0, (3, 4): 5.0}
    walks = spark.createDataFrame([(2, 3, 2.0)], "src bigint, dst bigint, minutes double")
    egress = spark.createDataFrame([(4, 4.0, 9), (1, 1.0, 9)], "node bigint, minutes double, target bigint")
    got = {r.node: (r.minutes, r.target) for r in transit.static_minutes(pairs, walks, egress).collect()}
    assert got == {1: (19.0, 9), 3: (9.0, 9)}


def test_merge_sources_and_samples(spark):
    osm = places(spark, [(1, 0.0, 0.0)])
    register_ = places(spark, [(10, 50.0, 0.0), (11, 500.0, 0.0)]).withColumn("naam", F.lit("n"))
    assert sorted(r.id for r in facilities.merge_sources(osm, register_, "id").collect()) == [1, 11]
    many = spark.range(1000)
    assert relational.sample_rows(many, "id", 5).collect() == relational.sample_rows(many.repartition(7), "id", 5).collect()
    assert relational.value_counts(spark.createDataFrame([("a",), (" ",), ("a",)], "k string"), "k").collect()[0].aantal == 2
    with pytest.raises(ValueError):
        relational.unique_or_fail(spark.createDataFrame([(1,), (1,)], "k int"), "k", "t")
    with pytest.raises(ValueError):
        relational.matched_or_fail(spark.createDataFrame([("1",), ("2",)], "k string"), spark.createDataFrame([("1.0", "x")], "k string, v string"), "k", "t")


def test_multimodal_summary_keeps_null_areas(spark):
    df = spark.createDataFrame([(1, None, "auto", 5.0, True), (2, "a", "fiets", 7.0, False), (3, "a", "fiets", 9.0, True)], "pand_id int, buurt string, modus string, minutes double, within boolean")
    got = {r.buurt: (r.panden_aantal, r.panden_binnen_norm, r.dominante_modus) for r in rollup.multimodal_summary(df, ["buurt"]).collect()}
    assert got == {None: (1, 1, "auto"), "a": (2, 1, "fiets")}
    assert rollup.published(df.withColumn("gekozen_naam", F.lit("x")).withColumn("snap_m", F.lit(1))).columns[-1] == "naam"


def test_whole_run(spark):
    """A small region end to end: all five modes of one facility, roll-ups, diagnosis and a what-if."""
    line = lambda a, b: [(float(a), 0.0), (float(b), 0.0)]
    ways = [(k, k, k + 1, 5.0, 400.0, True, True, line(400 * k, 400 * (k + 1))) for k in range(10)]
    quick = [(*w[:3], 1.0, *w[4:]) for w in ways]
    home = spark.createDataFrame([(f"p{k}", 400.0 * k + 10, 20.0, f"b{k // 4}", "g") for k in range(10)], "pand_id string, x double, y double, buurt string, gemeente string")
    shop = spark.createDataFrame([(1, 3990.0, 0.0)], "target bigint, x double, y double")
    stops = spark.createDataFrame([(100, 0.0, 0.0), (101, 4000.0, 0.0)], "node bigint, x double, y double")
    rides = spark.createDataFrame([(h * 3600, h * 3600 + 300, 100, 101) for h in range(24)], "dep bigint, arr bigint, src bigint, dst bigint")
    parking = spark.createDataFrame([(7, 3900.0, 0.0)], "parking bigint, x double, y double")
    net = lambda name, rows, speed: access.RoadNetwork.of(name, spark.createDataFrame(rows, WAYS), speed)
    inputs = run.Inputs(home, shop, net("lopen", ways, 80.0), net("fiets", quick, 250.0), net("auto", quick, 833.33), parking, stops, rides)
    facility = config.Facility("supermarkt")
    results = run.all_modes(inputs, facility).cache()
    rows = {(r.pand_id, r.modus): r for r in results.collect()}
    assert len(rows) == 50 and rows[("p9", "lopen")].within and not rows[("p0", "lopen")].within
    assert rows[("p0", "fiets")].total_min == round(10 - 0.025 - 0.025 + 20 / 250, 2)
    assert rows[("p9", "ov_lopen")].reistijd_bron == "direct_access" and rows[("p0", "ov_lopen")].reistijd_bron == "ov"
    assert rows[("p0", "ov_lopen")].target == 1 and rows[("p5", "auto")].target == 1
    made = run.products(results, home, "buurt", "gemeente", config.RunConfig().modes)
    assert made["buurten"].count() == 15 and made["diagnose"].count() == 3 and made["beste_modus"].count() == 10
    assert run.wide(results, "supermarkt", ("lopen", "auto")).columns[1] == "reistijd_supermarkt_lopen_min"
    moved = run.scenario(shop, F.col("target") == 1, spark.createDataFrame([(2, 10.0, 0.0)], "target bigint, x double, y double"))
    then = run.all_modes(run.Inputs(home, moved, inputs.walk), facility, config.RunConfig(modes=("lopen",)))
    changed = {r.pand_id: r.verschil_min for r in run.compare(results.where("modus = 'lopen'"), then).collect()}
    assert changed["p0"] < 0 < changed["p9"]


def test_legends_and_settings():
    assert len(legends.isochrones()) == len(config.NORMS) * 5 and "0-20%" in legends.basic()["buurten"]
    assert config.parse_modes("auto, lopen") == ("lopen", "auto") and config.parse_modes(None) == classes.MODES
    with pytest.raises(ValueError):
        config.parse_modes("vliegtuig")
    with pytest.raises(ValueError):
        config.Facility("onbekend").norm("auto")


def test_shared_with_a_straight_car_way(spark):
    """Car ways a hundred metres long between their points; ways beside, across, far from and on them."""
    line = lambda *p: [(float(x), float(y)) for x, y in p]
    kind = "array<struct<x:double,y:double>>"
    cars = spark.createDataFrame([(7, line((0, 0), (100, 0))), (9, line((0, 50), (100, 150)))], f"wvk_id bigint, line {kind}")
    rows = [(1, None, line((40, 0.9), (60, 0.9))), (2, None, line((50, -30), (50, 30))), (3, None, line((40, 10), (60, 10))), (4, None, line((40, 400), (60, 400))), (5, 9, line((500, 500), (501, 501))), (6, None, line((49, 101), (51, 99)))]
    got = {r.edge_id: r for r in roads.shared_with_cars(spark.createDataFrame(rows, f"edge_id bigint, wvk_id bigint, line {kind}"), cars).collect()}
    assert {k: (r.overlap_met_auto, r.overlap_auto_wvk_id, r.gedeeld_met_auto) for k, r in got.items()} == {1: (True, 7, True), 2: (True, 7, True), 3: (False, None, False), 4: (False, None, False), 5: (False, None, True), 6: (True, 9, True)}
    assert abs(got[1].afstand_tot_auto_m - 0.9) < 1e-9 and got[2].afstand_tot_auto_m == 0 and abs(got[3].afstand_tot_auto_m - 10) < 1e-9 and got[4].afstand_tot_auto_m is None


def test_dense_numbers(spark):
    rows = relational.dense_numbers(spark.range(1000).withColumn("k", (F.col("id") * 37) % 101), [F.col("k").desc(), F.col("id")], "nr").orderBy("nr").collect()
    assert [r.nr for r in rows] == list(range(1, 1001)) and [(-r.k, r.id) for r in rows] == sorted((-r.k, r.id) for r in rows)
    assert relational.dense_numbers(spark.range(0), [F.col("id")], "nr").count() == 0


def test_times_on_the_edge_of_rounding(spark):
    """Halves go to even by the hundredfold, also where a sum misses them by its last bit; shares of an edge are those of its one part."""
    values = [15.165000000000001, 9.585, 14.374999999999998, 7.195, None]
    rows = spark.createDataFrame([(v,) for v in values], "total_min double").withColumn("network_min", F.col("total_min"))
    got = [r.total_min for r in access.norm_tested(rows, F.lit(10)).collect()]
    assert got == [None if v is None else round(v * 100) / 100 for v in values]

    line = "array(named_struct('x', 0.0000, 'y', 0.0000), named_struct('x', 100.0000, 'y', 0.0000)) as line"
    ways = spark.range(1).selectExpr("id as edge_id", "1L as u", "2L as v", "3D as minutes", "100D as length_m", "true as forward", "true as backward", line)
    points = spark.range(1, 8000, 37).selectExpr("id", "cast(id / 100 as decimal(13,4)) as x", "cast(1 as decimal(13,4)) as y")
    placed = spatial.nearest_edges(points, ways, 60.0)
    costs = network.seed_costs(placed.withColumn("target", F.col("id")), F.lit(80.0)).where("node = 1").collect()
    assert len(costs) == 217
    for r in costs:
        assert r.cost == r.target / 10000 * 3 + 1 / 80


def test_pairs_of_small_tables_are_made_by_many_tasks(spark):
    """One partition of points and one of edges: the pairs are still dealt out by cell, whichever side is broadcast."""
    line = "array(named_struct('x', id * 100D, 'y', 0D), named_struct('x', id * 100D + 100D, 'y', 0D)) as line"
    ways = spark.range(200).coalesce(1).selectExpr("id as edge_id", line)
    points = spark.range(20_000).coalesce(1).selectExpr("id as pand_id", "id * 1D as x", "5D as y")
    got = spatial.nearest_edges(points, ways, 60.0)
    used = got.select(F.spark_partition_id().alias("p")).distinct().count()
    assert used > 1
    assert got.groupBy("pand_id").agg(F.min("snap_m").alias("m")).where("m = 5").count() == 20_000


def test_car_ways_near_many_ways_are_found_by_many_tasks(spark, monkeypatch):
    """The pairs of ways and car ways are dealt out by cell; the least distance and id stay those of all pairs."""
    used = []
    real = roads.dealt
    monkeypatch.setattr(roads, "dealt", lambda df, *cell: used.append(cell) or real(df, *cell))
    line = lambda y: f"array(named_struct('x', id * 10D, 'y', {y}D), named_struct('x', id * 10D + 3D, 'y', {y}D)) as line"
    ways = spark.range(300).coalesce(1).selectExpr("id as edge_id", "cast(null as bigint) as wvk_id", line(0.5))
    cars = spark.range(0, 300, 2).coalesce(1).selectExpr("id as wvk_id", line(0))
    rows = roads.shared_with_cars(ways, cars).collect()
    assert len(used) == 2
    assert {r.edge_id for r in rows if r.overlap_met_auto} == set(range(0, 300, 2))
    assert all(r.overlap_auto_wvk_id == (r.edge_id if r.edge_id % 2 == 0 else None) for r in rows)


def test_static_minutes_pairs_are_dealt_and_wrong_walks_hide_no_ride(spark):
    rides = spark.createDataFrame([(1, 2, 5.0), (1, 2, 7.0), (2, 3, 4.0)], "src bigint, dst bigint, minutes double")
    pairs = transit.stop_pairs(rides)
    # no task gets the pairs of several partitions, however small these are
    assert pairs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    walks = spark.createDataFrame([(2, 3, -1.0), (3, 4, 2.0)], "src bigint, dst bigint, minutes double")
    egress = spark.createDataFrame([(4, 1.0, 40), (4, 1.0, 39)], "node bigint, minutes double, target bigint")
    got = {r.node: (r.minutes, r.target) for r in transit.static_minutes(pairs, walks, egress).collect()}
    assert got == {1: (12.0, 39), 2: (7.0, 39)}
