"""Geometry as nested columns: a point is struct<x,y>, a line an array of points, a polygon an array of rings.

Everything is a column expression. Planar kernels count in metres; a few work on longitude and latitude.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
#: Lines may have decimal coordinates; what is cut from them has doubles.
LINE = "array<struct<x:double,y:double>>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def node_key(p: Column, digits: int = 2) -> Column:
    """A point rounded to 0.01 m: the key of a network node."""
    return F.struct(F.bround(p["x"], digits).alias("x"), F.bround(p["y"], digits).alias("y"))


def node_id(p: Column) -> Column:
    return F.xxhash64(node_key(p)["x"], node_key(p)["y"])


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres; null where a coordinate is."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(h))


def segments(line: Column) -> Column:
    """The straight parts of a line: array of struct(a, b)."""
    n = F.size(line)
    return F.when(n > 1, F.zip_with(F.slice(line, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(line, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))


def _sum(values: Column, of) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + of(v))


def length(line: Column) -> Column:
    return F.coalesce(_sum(segments(line), lambda s: distance(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])), F.lit(0.0))


def ring_area(ring: Column) -> Column:
    """Signed area of a closed ring."""
    return F.coalesce(_sum(segments(ring), lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]), F.lit(0.0)) / 2


def area(polygon: Column) -> Column:
    """Area of the shell less that of the holes."""
    return F.abs(ring_area(polygon[0])) - _sum(F.slice(polygon, F.lit(2), F.greatest(F.size(polygon) - 1, F.lit(0))), lambda r: F.abs(ring_area(r)))


def centroid(polygon: Column) -> Column:
    """Centre of mass of a polygon with holes."""

    def moments(ring: Column, sign: Column) -> Column:
        a = ring_area(ring)
        cross = lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]
        turn = F.when(a < 0, -sign).otherwise(sign)
        return F.struct(
            (turn * a).alias("a"),
            (turn * _sum(segments(ring), lambda s: (s["a"]["x"] + s["b"]["x"]) * cross(s)) / 6).alias("x"),
            (turn * _sum(segments(ring), lambda s: (s["a"]["y"] + s["b"]["y"]) * cross(s)) / 6).alias("y"),
        )

    each = F.transform(polygon, lambda ring, k: moments(ring, F.when(k == 0, 1.0).otherwise(-1.0)))
    total = _sum(each, lambda m: m["a"])
    return F.when(total != 0, point(_sum(each, lambda m: m["x"]) / total, _sum(each, lambda m: m["y"]) / total)).otherwise(polygon[0][0])


def bounds(polygon: Column) -> Column:
    """struct(xmin, ymin, xmax, ymax) of the shell."""
    shell = polygon[0]
    x, y = F.transform(shell, lambda p: p["x"]), F.transform(shell, lambda p: p["y"])
    return F.struct(F.array_min(x).alias("xmin"), F.array_min(y).alias("ymin"), F.array_max(x).alias("xmax"), F.array_max(y).alias("ymax"))


def within(px: Column, py: Column, polygon: Column) -> Column:
    """Whether a point lies inside a polygon by the even-odd rule over all rings; on the boundary it doesn't."""
    parts = F.flatten(F.transform(polygon, lambda r: F.coalesce(segments(r), F.array().cast("array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>"))))
    crosses = lambda s: ((s["a"]["y"] > py) != (s["b"]["y"] > py)) & (px < (s["b"]["x"] - s["a"]["x"]) * (py - s["a"]["y"]) / F.nullif(s["b"]["y"] - s["a"]["y"], F.lit(0.0)) + s["a"]["x"])
    on_edge = lambda s: ((s["b"]["x"] - s["a"]["x"]) * (py - s["a"]["y"]) == (s["b"]["y"] - s["a"]["y"]) * (px - s["a"]["x"])) & px.between(F.least(s["a"]["x"], s["b"]["x"]), F.greatest(s["a"]["x"], s["b"]["x"])) & py.between(F.least(s["a"]["y"], s["b"]["y"]), F.greatest(s["a"]["y"], s["b"]["y"]))
    odd = F.size(F.filter(parts, lambda s: F.coalesce(crosses(s), F.lit(False)))) % 2 == 1
    return odd & ~F.exists(parts, on_edge)


def is_box(polygon: Column) -> Column:
    """Whether a polygon is one closed ring of four sides along the axes: what lies within it is what lies between its bounds."""
    ring = F.get(polygon, F.lit(0))
    a, b, c, d, end = (F.get(ring, F.lit(k)) for k in range(5))
    same = lambda p, q, k: p[k] == q[k]
    across = same(a, b, "x") & same(b, c, "y") & same(c, d, "x") & same(d, a, "y")
    along = same(a, b, "y") & same(b, c, "x") & same(c, d, "y") & same(d, a, "x")
    numbers = ~F.isnan((a["x"] + a["y"] + c["x"] + c["y"]).cast("double"))
    return F.coalesce((F.size(polygon) == 1) & (F.size(ring) == 5) & same(a, end, "x") & same(a, end, "y") & (across | along) & numbers, F.lit(False))


def parts(line: Column) -> Column:
    """The straight parts of a line as numbers: array of struct(ax, ay, dx, dy, size)."""
    flat = F.transform(segments(line), lambda s: F.struct(s["a"]["x"].alias("ax"), s["a"]["y"].alias("ay"), (s["b"]["x"] - s["a"]["x"]).alias("dx"), (s["b"]["y"] - s["a"]["y"]).alias("dy"), distance(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]).alias("size")))
    return F.when(F.size(line) > 1, flat)


def project_parts(px: Column, py: Column, pieces: Column) -> Column:
    """struct(distance, position, before, share, size) of a point and a line's ``parts``: how far it is, the metres along to the nearest place, and those before that
    place's part, its share of the part, and the part's size. Every step binds its values, so nothing is worked out twice."""
    share = lambda s: F.when(s["size"] > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - s["ax"]) * s["dx"] + (py - s["ay"]) * s["dy"]) / (s["size"] * s["size"])))).otherwise(0.0)
    placed = F.transform(pieces, lambda s: F.struct(*[s[c].alias(c) for c in ("ax", "ay", "dx", "dy", "size")], share(s).alias("share")))
    tried = F.transform(placed, lambda s: F.struct(distance(px, py, s["ax"] + s["share"] * s["dx"], s["ay"] + s["share"] * s["dy"]).alias("far"), s["share"].alias("share"), s["size"].alias("size")))
    start = F.struct(F.lit(float("inf")).alias("distance"), F.lit(0.0).alias("before"), F.lit(0.0).alias("share"), F.lit(0.0).alias("size"), F.lit(0.0).alias("done"))

    def step(s: Column, part: Column) -> Column:
        took = lambda new, old: F.when(part["far"] < s["distance"], new).otherwise(old)
        return F.struct(took(part["far"], s["distance"]).alias("distance"), took(s["done"], s["before"]).alias("before"), took(part["share"], s["share"]).alias("share"), took(part["size"], s["size"]).alias("size"), (s["done"] + part["size"]).alias("done"))

    return F.aggregate(tried, start, step, lambda s: F.struct(s["distance"].alias("distance"), (s["before"] + s["share"] * s["size"]).alias("position"), s["before"].alias("before"), s["share"].alias("share"), s["size"].alias("size")))


def project(px: Column, py: Column, line: Column) -> Column:
    """struct(distance, position): how far a point is from a line, and the metres along it to the nearest place."""
    start = F.array(F.struct(F.lit(0)))
    found = F.transform(F.transform(start, lambda _: project_parts(px, py, parts(line))), lambda f: F.struct(f["distance"].alias("distance"), f["position"].alias("position")))
    return found[0]


def interpolate(line: Column, position: Column) -> Column:
    """The point at so many metres along a line, kept within its ends."""
    line = line.cast(LINE)
    start = F.struct(F.lit(0.0).alias("done"), line[0].alias("p"), F.lit(False).alias("found"))

    def step(s: Column, part: Column) -> Column:
        size = distance(part["a"]["x"], part["a"]["y"], part["b"]["x"], part["b"]["y"])
        here = ~s["found"] & (position <= s["done"] + size)
        share = F.when(size > 0, F.greatest(F.lit(0.0), position - s["done"]) / size).otherwise(0.0)
        inside = point(part["a"]["x"] + share * (part["b"]["x"] - part["a"]["x"]), part["a"]["y"] + share * (part["b"]["y"] - part["a"]["y"]))
        return F.struct((s["done"] + size).alias("done"), F.when(s["found"], s["p"]).when(here, inside).otherwise(part["b"]).alias("p"), (s["found"] | here).alias("found"))

    return F.when(F.size(line) == 1, line[0]).otherwise(F.aggregate(segments(line), start, step)["p"])


def substring(line: Column, start: Column, stop: Column) -> Column:
    """The part of a line between two positions; the other way round if stop lies before start."""
    line = line.cast(LINE)
    low, high = F.least(start, stop), F.greatest(start, stop)
    marked = F.aggregate(
        segments(line),
        F.struct(F.lit(0.0).alias("done"), F.array().cast("array<struct<x:double,y:double>>").alias("kept")),
        lambda s, part: F.struct(
            (s["done"] + distance(part["a"]["x"], part["a"]["y"], part["b"]["x"], part["b"]["y"])).alias("done"),
            F.when((s["done"] > low) & (s["done"] < high), F.array_append(s["kept"], part["a"])).otherwise(s["kept"]).alias("kept"),
        ),
    )["kept"]
    cut = F.concat(F.array(interpolate(line, low)), marked, F.array(interpolate(line, high)))
    return F.when(stop < start, F.reverse(cut)).otherwise(cut)


def ring_of(text: Column, dimension: int = 2) -> Column:
    """A closed ring from a list of coordinates in text, two or three to a point; null under four points."""
    numbers = F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != ""), lambda t: t.try_cast("double"))
    count = F.floor(F.size(numbers) / dimension).cast("int")
    points = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda k: point(F.get(numbers, k * dimension), F.get(numbers, k * dimension + 1))))
    closed = F.when(points[0] == F.element_at(points, -1), points).otherwise(F.array_append(points, points[0]))
    return F.when(F.size(closed) >= 4, closed)


def interior_point(polygon: Column) -> Column:
    """A point inside a polygon: the middle of the widest stretch of the horizontal line through its middle."""
    box = bounds(polygon)
    y = (box["ymin"] + box["ymax"]) / 2
    parts = F.flatten(F.transform(polygon, segments))
    hits = F.array_sort(F.transform(F.filter(parts, lambda s: (s["a"]["y"] > y) != (s["b"]["y"] > y)), lambda s: s["a"]["x"] + (y - s["a"]["y"]) * (s["b"]["x"] - s["a"]["x"]) / (s["b"]["y"] - s["a"]["y"])))
    spans = F.transform(F.sequence(F.lit(0), F.floor(F.size(hits) / 2).cast("int") - 1), lambda k: F.struct((F.get(hits, 2 * k + 1) - F.get(hits, 2 * k)).alias("w"), ((F.get(hits, 2 * k) + F.get(hits, 2 * k + 1)) / 2).alias("x")))
    return F.when(F.size(hits) >= 2, point(F.array_max(spans)["x"], y)).otherwise(centroid(polygon))


def representative(kind: Column, line: Column, polygon: Column, single: Column) -> Column:
    """A point for any geometry: the point, the middle of the line, or one inside the polygon."""
    return F.when(kind == "point", single).when(kind == "line", interpolate(line, length(line) / 2)).when(kind == "polygon", interior_point(polygon))


def rd_to_wgs84(x: Column, y: Column) -> Column:
    """struct(lon, lat) of metres in the national grid.

    Fixed values: the published power series around the grid's centre; it agrees with the exact transformation to
    within a few decimetres.
    """
    dx, dy = (x - 155000.0) * 1e-5, (y - 463000.0) * 1e-5
    lat = ((0, 1, 3235.65389), (2, 0, -32.58297), (0, 2, -0.2475), (2, 1, -0.84978), (0, 3, -0.0655), (2, 2, -0.01709), (1, 0, -0.00738), (4, 0, 0.0053), (2, 3, -0.00039), (4, 1, 0.00033), (1, 1, -0.00012))
    lon = ((1, 0, 5260.52916), (1, 1, 105.94684), (1, 2, 2.45656), (3, 0, -0.81885), (1, 3, 0.05594), (3, 1, -0.05607), (0, 1, 0.01199), (3, 2, -0.00256), (1, 4, 0.00128), (0, 2, 0.00022), (2, 0, -0.00022), (5, 0, 0.00026))
    return F.struct((5.38720621 + _series(lon, dx, dy) / 3600).alias("lon"), (52.1551744 + _series(lat, dx, dy) / 3600).alias("lat"))


def wgs84_to_rd(lon: Column, lat: Column) -> Column:
    """struct(x, y) in metres of longitude and latitude; the inverse series, with fixed values as published."""
    dl, dp = 0.36 * (lon - 5.38720621), 0.36 * (lat - 52.1551744)
    east = ((0, 1, 190094.945), (1, 1, -11832.228), (2, 1, -114.221), (0, 3, -32.391), (1, 0, -0.705), (3, 1, -2.34), (1, 3, -0.608), (0, 2, -0.008), (2, 3, 0.148))
    north = ((1, 0, 309056.544), (0, 2, 3638.893), (2, 0, 73.077), (1, 2, -157.984), (3, 0, 59.788), (0, 1, 0.433), (2, 2, -6.439), (1, 1, -0.032), (0, 4, 0.092), (1, 4, -0.054))
    return F.struct((155000.0 + _series(east, dp, dl)).alias("x"), (463000.0 + _series(north, dp, dl)).alias("y"))


def _series(terms, a: Column, b: Column) -> Column:
    out = F.lit(0.0)
    for p, q, k in terms:
        out = out + k * F.pow(a, F.lit(p)) * F.pow(b, F.lit(q))
    return out


def cell(x: Column, y: Column, size: float) -> Column:
    """Grid cell of a point."""
    return F.struct(F.floor(x / size).cast("bigint").alias("cx"), F.floor(y / size).cast("bigint").alias("cy"))


def diagonal(size: float) -> float:
    return size * math.sqrt(2)
