"""A street network from map elements: ways of a kind become straight segments, chains of segments between junctions become edges.

Chains are followed by pointer doubling, so rounds grow with the logarithm of the longest chain. Places are degrees (x: longitude, y: latitude).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import geometry as g
from waymark.operators.profiles import followed
from waymark.operators.relational import dense_numbers, first_per_key
from waymark.operators.spatial import dealt
from waymark.session import checkpointed

#: The parsed form of an answer with nodes and ways.
ELEMENTS = "elements array<struct<type:string,id:bigint,lon:double,lat:double,nodes:array<bigint>,tags:map<string,string>>>"

#: Ways that a kind of network leaves out, by ``highway``, and the values of other tags that do so.
NEVER = ("abandoned", "bus_guideway", "construction", "corridor", "elevator", "escalator", "no", "planned", "platform", "proposed", "raceway", "razed", "rest_area", "services")
WITHOUT = {
    "walk": (*NEVER, "cycleway", "motor"),
    "bike": (*NEVER, "footway", "motor", "steps"),
    "drive": (*NEVER, "bridleway", "cycleway", "footway", "path", "pedestrian", "service", "steps", "track"),
}
FORBIDDEN = {
    "walk": {"foot": ("no",), "service": ("private",)},
    "bike": {"bicycle": ("no",), "service": ("private",)},
    "drive": {"motor_vehicle": ("no",), "motorcar": ("no",), "service": ("alley", "driveway", "emergency_access", "parking", "parking_aisle", "private")},
}
#: Kilometres an hour on foot and by bike, and kilometres in a mile.
SPEED = {"walk": 4.8, "bike": 15.0}
MILE = 1.609344


def _tag(name: str) -> Column:
    return F.lower(F.trim(F.try_element_at("tags", F.lit(name))))


def street_elements(json: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, x, y) and ways (way_id, nodes, tags) of parsed answers (``ELEMENTS``); what several answers have counts once."""
    e = json.select(F.explode("elements").alias("e")).select("e.*")
    nodes = e.where("type = 'node' and lon is not null and lat is not null").groupBy(F.col("id").alias("node")).agg(F.min(F.struct("lon", "lat")).alias("_p")).select("node", F.col("_p.lon").alias("x"), F.col("_p.lat").alias("y"))
    ways = first_per_key(e.where("type = 'way' and size(nodes) > 1").select(F.col("id").alias("way_id"), "nodes", "tags"), ["way_id"], [F.size("nodes").desc(), F.to_json("nodes")])
    return nodes, ways


def of_kind(ways: DataFrame, kind: str) -> DataFrame:
    """Ways open to ``walk``, ``bike`` or ``drive``, with ``highway``, ``maxspeed``, and where they may be gone: ``there`` and ``back``.

    On foot every way leads both ways; else ``oneway`` and roundabouts count, and -1 or reverse turns a way round.
    """
    rows = ways.where(_tag("highway").isNotNull() & ~_tag("highway").isin(*WITHOUT[kind]) & ~_tag("area").eqNullSafe("yes") & ~_tag("access").eqNullSafe("private"))
    for name, values in FORBIDDEN[kind].items():
        rows = rows.where(~F.coalesce(_tag(name).isin(*values), F.lit(False)))
    one_way = _tag("oneway")
    turned = F.coalesce(one_way.isin("-1", "reverse", "t"), F.lit(False))
    single = F.coalesce(one_way.isin("yes", "true", "1", "f"), F.lit(False)) | turned | (one_way.isNull() & _tag("junction").eqNullSafe("roundabout"))
    both = F.lit(kind == "walk") | ~single
    return rows.withColumn("highway", _tag("highway")).withColumn("maxspeed", _tag("maxspeed")).withColumn("there", both | ~turned).withColumn("back", both | turned)


def street_segments(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Directed straight segments of ways: (src, dst, way_id, length_m, ax, ay, bx, by), with the ways' other columns.

    Segments with an unknown node or without extent in nodes drop out; of several ways over the same two nodes the smallest id counts.
    """
    pairs = ways.withColumn("_p", F.explode(F.zip_with(F.slice("nodes", F.lit(1), F.size("nodes") - 1), F.slice("nodes", F.lit(2), F.size("nodes") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))).drop("nodes", "tags")
    a, b = (nodes.select(F.col("node").alias(f"_{e}"), F.col("x").alias(f"{e}x"), F.col("y").alias(f"{e}y")) for e in "ab")
    placed = pairs.join(a, F.col("_p.a") == F.col("_a")).join(b, F.col("_p.b") == F.col("_b")).where("_a <> _b")
    row = lambda s, t: F.struct(F.col(f"_{s}").alias("src"), F.col(f"_{t}").alias("dst"), F.col(f"{s}x").alias("ax"), F.col(f"{s}y").alias("ay"), F.col(f"{t}x").alias("bx"), F.col(f"{t}y").alias("by"))
    turns = F.array_compact(F.array(F.when(F.col("there"), row("a", "b")), F.when(F.col("back"), row("b", "a"))))
    each = placed.withColumn("_d", F.explode(turns)).select("_d.*", *[c for c in ways.columns if c not in ("nodes", "tags", "there", "back")])
    # dealt out first: few small files would sort all segments in as few tasks
    return first_per_key(dealt(each, F.col("src"), F.col("dst")), ["src", "dst"], [F.col("way_id")]).withColumn("length_m", g.haversine(F.col("ay"), F.col("ax"), F.col("by"), F.col("bx")))


def _between(segments: DataFrame) -> DataFrame:
    """Nodes that a chain only passes: two neighbours, and gone through from the one to the other, one way or both."""
    ends = segments.select(F.col("src").alias("node"), F.col("dst").alias("_other"), F.lit(1).alias("_out")).unionByName(segments.select(F.col("dst").alias("node"), F.col("src").alias("_other"), F.lit(0).alias("_out")))
    met = ends.groupBy("node", "_other").agg(F.sum("_out").alias("_out"), F.count("*").alias("_all")).groupBy("node").agg(F.count("*").alias("_n"), F.sum("_out").alias("_out"), F.sum("_all").alias("_all"))
    return met.where("_n = 2 and (_all = 4 or _all = 2 and _out = 1)").select("node")


def _ring_starts(ring: DataFrame, on: DataFrame) -> DataFrame:
    """Segments of closed rings with the least node of their ring: (src, dst, low), by doubling jumps around it."""
    now = checkpointed(ring.select("src", "dst").join(on, ["src", "dst"]).select("src", "dst", F.col("src").alias("low"), F.col("dst").alias("_js"), F.col("next").alias("_jd")))
    while True:
        there = now.select(F.col("src").alias("_js"), F.col("dst").alias("_jd"), F.col("low").alias("_low"), F.col("_js").alias("_ks"), F.col("_jd").alias("_kd"))
        moved = checkpointed(now.join(there, ["_js", "_jd"]).select("src", "dst", F.least("low", "_low").alias("low"), F.col("_ks").alias("_js"), F.col("_kd").alias("_jd"), (F.col("_low") < F.col("low")).alias("_less")))
        now = moved.drop("_less")
        if not moved.where("_less").head(1):
            return now.select("src", "dst", "low")


def contracted(segments: DataFrame) -> DataFrame:
    """Edges between junctions and dead ends: (edge_id, u, v, length_m, forward, backward, nodes, line, ways, highway, maxspeeds).

    ``segments`` comes from ``street_segments``. A chain that may be gone both ways is one edge; u is the end with the smaller id (of a ring, whose ends are its least
    node, the way round with the smaller second node). ``nodes`` holds all nodes passed, ``ways`` the ids of the ways, ``highway`` the first one's and ``maxspeeds`` all distinct texts.
    """
    segments = checkpointed(segments.where("src <> dst"))
    between = checkpointed(_between(segments))
    after = segments.select(F.col("src").alias("_n"), F.col("dst").alias("next"))
    on = segments.select("src", "dst").join(between, F.col("dst") == F.col("node")).join(after, (F.col("dst") == F.col("_n")) & (F.col("next") != F.col("src")))
    on = checkpointed(on.select("src", "dst", "next"))
    start = lambda df: df.select(F.struct("src", "dst").alias("id"), "src", "dst")
    way = followed(start(segments.join(between, F.col("src") == F.col("node"), "left_anti")), on, ["src", "dst"], ["dst", "next"])
    ring = checkpointed(segments.select("src", "dst").join(way.select("src", "dst"), ["src", "dst"], "left_anti"))
    if ring.head(1):
        low = _ring_starts(ring, on)
        inside = low.where("dst <> low").join(on, ["src", "dst"])
        way = way.unionByName(followed(start(low.where("src = low")), inside, ["src", "dst"], ["dst", "next"]))
    parts = way.join(segments, ["src", "dst"])
    step = F.struct("step", "src", "dst", "way_id", "highway", "maxspeed", g.point(F.col("ax"), F.col("ay")).alias("a"), g.point(F.col("bx"), F.col("by")).alias("b"))
    chains = parts.groupBy("id").agg(F.array_sort(F.collect_list(step)).alias("_s"), F.sum("length_m").alias("length_m"))
    s = F.col("_s")
    ends = chains.select("length_m", s, s[0]["src"].alias("_u"), s[0]["dst"].alias("_second"), F.element_at(s, -1)["src"].alias("_last"), F.element_at(s, -1)["dst"].alias("_v"))
    own, turned = F.struct("_u", "_second", "_last", "_v"), F.struct(F.col("_v").alias("_u"), F.col("_last").alias("_second"), F.col("_second").alias("_last"), F.col("_u").alias("_v"))
    keyed = ends.select("*", F.least(own, turned).alias("_key"), (own <= turned).alias("_own"))
    # of both directions the one that runs as the edge does describes it, if there is one
    pick = lambda c: F.min_by(c, F.when(F.col("_own"), 0).otherwise(1))
    both = keyed.groupBy("_key").agg(F.bool_or("_own").alias("forward"), F.bool_or(~F.col("_own")).alias("backward"), pick(F.struct("_s", "length_m")).alias("_d"))
    s = F.col("_d._s")
    nodes = F.concat(F.array(s[0]["src"]), F.transform(s, lambda p: p["dst"]))
    line = F.concat(F.array(s[0]["a"]), F.transform(s, lambda p: p["b"]))
    as_edge = lambda c: F.when(F.col("forward"), c).otherwise(F.reverse(c))
    edges = both.select(
        F.col("_key._u").alias("u"), F.col("_key._v").alias("v"), F.col("_d.length_m").alias("length_m"), "forward", "backward", as_edge(nodes).alias("nodes"), as_edge(line).alias("line"),
        F.array_sort(F.array_distinct(F.transform(s, lambda p: p["way_id"]))).alias("ways"), as_edge(F.transform(s, lambda p: p["highway"]))[0].alias("highway"),
        F.array_sort(F.array_distinct(F.array_compact(F.transform(s, lambda p: p["maxspeed"])))).alias("maxspeeds"), F.col("_key._second").alias("_second"),
    )
    return dense_numbers(checkpointed(edges), [F.col("u"), F.col("v"), F.col("_second")], "edge_id").drop("_second")


def largest_part(edges: DataFrame) -> DataFrame:
    """The edges of the connected part with the most nodes, passed ones included; of equal ones that with the least node.

    Parts are stars after rounds in which every node hands its neighbours to the least of them, larger and smaller ones in turn.
    """
    links = edges.select(F.greatest("u", "v").alias("_a"), F.least("u", "v").alias("_b")).distinct()
    told = None
    links = checkpointed(links)
    while True:
        around = links.unionByName(links.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
        low = around.groupBy("_a").agg(F.least(F.min("_b"), F.first("_a")).alias("_low"))
        large = around.join(low, "_a").where("_b > _a").select(F.col("_b").alias("_a"), F.col("_low").alias("_b")).distinct()
        loops = links.where("_a = _b")
        large = checkpointed(large.unionByName(loops))
        low = large.groupBy("_a").agg(F.min("_b").alias("_low"))
        held = large.join(low, "_a")
        small = held.where("_b <> _low").select(F.col("_b").alias("_a"), F.col("_low").alias("_b")).unionByName(low.select("_a", F.col("_low").alias("_b")))
        links = checkpointed(small.distinct())
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("_a", "_b").cast("decimal(38,0)"))).first())
        if now == told:
            break
        told = now
    part = links.where("_a <> _b").select(F.col("_a").alias("_node"), F.col("_b").alias("_part"))
    kept = edges.join(part, F.col("u") == F.col("_node"), "left").withColumn("_part", F.coalesce("_part", "u")).drop("_node")
    kept = checkpointed(kept)
    sizes = kept.select("_part", F.explode("nodes").alias("_n")).distinct().groupBy("_part").agg(F.count("*").alias("_size"))
    first = sizes.orderBy(F.desc("_size"), "_part").limit(1).select("_part")
    return kept.join(F.broadcast(first), "_part", "left_semi").drop("_part")


def with_travel_minutes(edges: DataFrame, kind: str) -> DataFrame:
    """``speed_kmh`` and ``minutes``. By car the mean of an edge's limits, else that of its ``highway``, else that of all edges."""
    if kind in SPEED:
        rows = edges.withColumn("speed_kmh", F.lit(SPEED[kind]))
    else:
        number = lambda t: F.try_to_number(F.nullif(F.regexp_extract(t, r"^(\d{1,3})(\s*(km/?h|kmh|kph|mph))?$", 1), F.lit("")), F.lit("999")).cast("double") * F.when(t.contains("mph"), MILE).otherwise(1.0)
        limits = F.array_compact(F.transform("maxspeeds", number))
        own = F.when(F.size(limits) > 0, F.aggregate(limits, F.lit(0.0), lambda a, b: a + b) / F.size(limits))
        rows = checkpointed(edges.withColumn("_own", own))
        by_kind = rows.groupBy(F.col("highway").alias("_h")).agg(F.avg("_own").alias("_usual"))
        every = rows.agg(F.avg("_own").alias("_mean"))
        # one row, whatever the input
        rows = rows.join(by_kind, F.col("highway") == F.col("_h"), "left").join(F.broadcast(every), F.lit(True), "left").withColumn("speed_kmh", F.coalesce("_own", "_usual", "_mean")).drop("_own", "_h", "_usual", "_mean")
    return rows.withColumn("minutes", F.col("length_m") / (F.col("speed_kmh") * 1000 / 60))


def street_network(json: DataFrame, kind: str, whole: bool = False, simplify: bool = True) -> DataFrame:
    """Edges of a network of a kind from parsed answers: ``contracted`` rows with ``speed_kmh`` and ``minutes``; unless ``whole``, of its largest part.

    Without ``simplify`` every segment is an edge of its own.
    """
    nodes, ways = street_elements(json)
    segments = street_segments(of_kind(ways, kind), nodes)
    edges = contracted(segments) if simplify else single_edges(segments)
    return with_travel_minutes(edges if whole else largest_part(edges), kind)


def single_edges(segments: DataFrame) -> DataFrame:
    """Segments as edges, in the form of ``contracted``."""
    first = (F.col("src") <= F.col("dst")).alias("_own")
    keyed = segments.select("*", first, F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))
    both = keyed.groupBy("u", "v").agg(F.bool_or("_own").alias("forward"), F.bool_or(~F.col("_own")).alias("backward"), F.min_by(F.struct("_own", "length_m", "way_id", "highway", "maxspeed", "ax", "ay", "bx", "by"), F.when(F.col("_own"), 0).otherwise(1)).alias("_d"))
    a, b = g.point(F.col("_d.ax"), F.col("_d.ay")), g.point(F.col("_d.bx"), F.col("_d.by"))
    rows = both.select("u", "v", F.col("_d.length_m").alias("length_m"), "forward", "backward", F.array("u", "v").alias("nodes"), F.when(F.col("_d._own"), F.array(a, b)).otherwise(F.array(b, a)).alias("line"), F.array("_d.way_id").alias("ways"), F.col("_d.highway").alias("highway"), F.array_compact(F.array("_d.maxspeed")).alias("maxspeeds"))
    return dense_numbers(checkpointed(rows), [F.col("u"), F.col("v")], "edge_id")
