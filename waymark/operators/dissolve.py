"""Areas from the sides of their parts: inner sides cancel, what is left is stitched to rings, and rings become polygons with holes.

A side is a directed piece of boundary with the area on its left: (keys, ax, ay, bx, by). Rings are found by pointer doubling: in round k every side
knows the least side among the 2**k that follow it, and how far ahead it lies, so a ring of n sides takes about log2(n) rounds and is
never walked. Only the corners of a finished ring meet in one row, which is what a polygon is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import geometry as g
from waymark.operators.relational import first_per_key
from waymark.operators.spatial import points_in_polygons
from waymark.session import checkpointed, written

ENDS = ("ax", "ay", "bx", "by")


def polygon_sides(polygons: DataFrame, keys: Sequence[str], polygon: str = "polygon", digits: int = 2) -> DataFrame:
    """The sides of polygons, corners rounded to the key of a node; shells turn left and holes right, however they are given."""
    rings = polygons.select(*keys, F.posexplode(polygon).alias("_k", "_ring")).where(F.size("_ring") > 3)
    area = g.ring_area(F.col("_ring"))
    turned = F.when((F.col("_k") == 0) == (area > 0), F.col("_ring")).otherwise(F.reverse("_ring"))
    parts = rings.where(area != 0).select(*keys, F.explode(g.segments(turned)).alias("_s"))
    at = lambda p, c: F.bround(F.col(f"_s.{p}.{c}"), digits).alias(p + c)
    return parts.select(*keys, at("a", "x"), at("a", "y"), at("b", "x"), at("b", "y")).where("ax <> bx or ay <> by")


def outer_sides(sides: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sides without those that two neighbouring parts share, which run both ways. Parts must not overlap."""
    ahead = (F.col("ax") < F.col("bx")) | ((F.col("ax") == F.col("bx")) & (F.col("ay") < F.col("by")))
    pick = lambda x, y: F.when(ahead, F.col(x)).otherwise(F.col(y))
    lines = sides.select(*keys, pick("ax", "bx").alias("_px"), pick("ay", "by").alias("_py"), pick("bx", "ax").alias("_qx"), pick("by", "ay").alias("_qy"), F.when(ahead, 1).otherwise(-1).alias("_n"))
    net = lines.groupBy(*keys, "_px", "_py", "_qx", "_qy").agg(F.sum("_n").alias("_n")).where("_n <> 0")
    way = lambda a, b: F.when(F.col("_n") > 0, F.col(a)).otherwise(F.col(b))
    return net.select(*keys, way("_px", "_qx").alias("ax"), way("_py", "_qy").alias("ay"), way("_qx", "_px").alias("bx"), way("_qy", "_py").alias("by"))


def _turn(ux: Column, uy: Column, vx: Column, vy: Column) -> Column:
    return F.atan2(ux * vy - uy * vx, ux * vx + uy * vy)


def rings(sides: DataFrame, keys: Sequence[str], max_rounds: int = 40) -> DataFrame:
    """Closed rings of outer sides: (keys, ring, points, area); points close on the first one, area is signed.

    Where rings touch in a corner the way turns left, so that parts that only touch are rings of their own. Corners on a straight line are left out.
    """
    edge = written(sides.select(*keys, *ENDS).withColumn("id", F.monotonically_increasing_id()), "sides")
    after = edge.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(c).alias(f"_{c}") for c in ENDS], F.col("id").alias("next"))
    same = (F.col("bx") == F.col("_ax")) & (F.col("by") == F.col("_ay"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    turn = _turn(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("_bx") - F.col("_ax"), F.col("_by") - F.col("_ay"))
    linked = checkpointed(first_per_key(edge.join(after, same).select("id", "next", turn.alias("_turn")), ["id"], [F.col("_turn").desc(), F.col("next")]))
    state = linked.select("id", F.col("next").alias("jump"), F.col("id").alias("ring"), F.lit(0).cast("bigint").alias("ahead"))
    stride = 1
    for _ in range(max_rounds):
        far = state.select(F.col("id").alias("_id"), F.col("jump").alias("_jump"), F.col("ring").alias("_ring"), F.col("ahead").alias("_ahead"))
        less = F.col("_ring") < F.col("ring")
        both = state.join(far, F.col("jump") == F.col("_id"), "left")
        state = checkpointed(both.select("id", F.col("_jump").alias("jump"), F.when(less, F.col("_ring")).otherwise(F.col("ring")).alias("ring"), F.when(less, F.col("_ahead") + stride).otherwise(F.col("ahead")).alias("ahead"), F.coalesce(less, F.lit(False)).alias("_moved")))
        settled = not state.where("_moved").head(1)
        state, stride = state.drop("_moved"), stride * 2
        if settled:
            break
    else:
        raise RuntimeError("rings did not close")
    # the first side of a ring has 0 sides ahead of it, the next one as many as are left
    corner = linked.where(F.abs("_turn") > 1e-9).select(F.col("next").alias("_corner"))
    placed = edge.join(state.select(F.col("id").alias("_id"), "ring", "ahead"), F.col("id") == F.col("_id")).join(corner, F.col("id") == F.col("_corner"), "left_semi")
    order = F.when(F.col("ahead") == 0, F.lit(-(2**62))).otherwise(-F.col("ahead"))
    found = placed.groupBy(*keys, "ring").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("ax").alias("x"), F.col("ay").alias("y")))).alias("_p"))
    points = F.transform(F.concat("_p", F.slice("_p", 1, 1)), lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    return found.select(*keys, "ring", points.alias("points")).withColumn("area", g.ring_area(F.col("points")))


def polygons(found: DataFrame, keys: Sequence[str], size: float = 5_000.0) -> DataFrame:
    """Polygons of rings: (keys, part, polygon, area, holes): each shell with the holes whose smallest shell it is."""
    rows = checkpointed(found)
    shells = rows.where("area > 0").select(*keys, F.col("ring").alias("part"), F.col("points").alias("shell"), F.col("area").alias("shell_area"))
    a, b = F.col("points")[0], F.col("points")[1]
    inner = rows.where("area < 0").select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("ring").alias("hole"), F.col("points").alias("hole_points"), ((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y"))
    inside = points_in_polygons(inner, shells.withColumn("polygon", F.array("shell")), size=size)
    for k in keys:
        inside = inside.where(F.col(k).eqNullSafe(F.col(f"_{k}")))
    owned = first_per_key(inside.select("hole", "hole_points", "part", "shell_area"), ["hole"], [F.col("shell_area"), F.col("part")])
    holes = owned.groupBy(F.col("part").alias("_part")).agg(F.array_sort(F.collect_list(F.struct("hole", "hole_points"))).alias("_h"))
    empty = F.array().cast("array<array<struct<x:double,y:double>>>")
    full = shells.join(holes, F.col("part") == F.col("_part"), "left").select(*keys, "part", F.concat(F.array("shell"), F.coalesce(F.transform("_h", lambda h: h["hole_points"]), empty)).alias("polygon"))
    return full.withColumn("area", g.area(F.col("polygon"))).withColumn("holes", (F.size("polygon") - 1).cast("int"))


def dissolved(parts: DataFrame, keys: Sequence[str], polygon: str = "polygon") -> DataFrame:
    """The union of polygons that don't overlap, by ``keys``; neighbours must share whole sides, corner by corner."""
    return polygons(rings(outer_sides(polygon_sides(parts, keys, polygon), keys), keys), keys)


def without_holes(polygon: Column, least: float | None = None) -> Column:
    """A polygon without its holes, or without those of an area below ``least``."""
    if least is None:
        return F.slice(polygon, 1, 1)
    rest = F.slice(polygon, F.lit(2), F.greatest(F.size(polygon) - 1, F.lit(0)))
    return F.concat(F.slice(polygon, 1, 1), F.filter(rest, lambda r: F.abs(g.ring_area(r)) >= least))
