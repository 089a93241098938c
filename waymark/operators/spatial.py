"""Spatial joins as equi-joins on grid cells, refined by exact kernels.

The side that is looked up goes once into each cell its bounds (grown by the radius) touch; the other side
stays in its own cell. A cell is the join key, so Catalyst shuffles or broadcasts by size and AQE splits crowded cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import geometry as g
from waymark.operators.relational import first_per_key


def _cells(xmin: Column, ymin: Column, xmax: Column, ymax: Column, size: float) -> Column:
    """All cells that a box touches."""
    at = lambda v: F.floor(v / size).cast("bigint")
    return F.flatten(F.transform(F.sequence(at(xmin), at(xmax)), lambda cx: F.transform(F.sequence(at(ymin), at(ymax)), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


def _in_cells(df: DataFrame, x: str, y: str, size: float, prefix: str) -> DataFrame:
    c = g.cell(F.col(x), F.col(y), size)
    return df.withColumn(f"{prefix}cx", c["cx"]).withColumn(f"{prefix}cy", c["cy"])


def dealt(df: DataFrame, *cell: Column) -> DataFrame:
    """Rows dealt out by cell over all of the session's shuffle partitions: few small files make many pairs, whichever side is broadcast."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cell)


def within_distance(left: DataFrame, right: DataFrame, radius: float, left_xy: tuple[str, str] = ("x", "y"), right_xy: tuple[str, str] = ("rx", "ry"), out: str = "afstand_m") -> DataFrame:
    """Pairs of points at most ``radius`` apart with their distance. Column names of both sides must differ."""
    a = _in_cells(left, *left_xy, radius, "_l")
    rx, ry = F.col(right_xy[0]), F.col(right_xy[1])
    b = right.withColumn("_cell", F.explode(_cells(rx - radius, ry - radius, rx + radius, ry + radius, radius)))
    far = g.distance(F.col(left_xy[0]), F.col(left_xy[1]), rx, ry)
    a, b = dealt(a, F.col("_lcx"), F.col("_lcy")), dealt(b, F.col("_cell.cx"), F.col("_cell.cy"))
    near = a.join(b, (F.col("_lcx") == F.col("_cell.cx")) & (F.col("_lcy") == F.col("_cell.cy")))
    return near.withColumn(out, far).where(F.col(out) <= radius).drop("_lcx", "_lcy", "_cell")


def nearest(left: DataFrame, right: DataFrame, radius: float, left_id: str, right_id: str, left_xy: tuple[str, str] = ("x", "y"), right_xy: tuple[str, str] = ("rx", "ry"), out: str = "afstand_m") -> DataFrame:
    """For each left point the nearest right one within ``radius``, the smaller id where distances tie; others drop out."""
    return first_per_key(within_distance(left, right, radius, left_xy, right_xy, out), [left_id], [F.col(out), F.col(right_id)])


def points_in_polygons(points: DataFrame, polygons: DataFrame, polygon: str = "polygon", xy: tuple[str, str] = ("x", "y"), size: float = 500.0, how: str = "inner", crowd: int | None = None) -> DataFrame:
    """Points with the polygons they lie within; with ``how`` left, points in none stay with nulls.

    The bounds of all rings are tested first; of a polygon that is a box, nothing else. Each polygon is shuffled once: others for their test, boxes only if the result keeps them.
    With ``crowd``, points are read twice: those of a cell with more are dealt out over slices of about so many, each with the cell's polygons. Broadcast is a row for each
    crowded cell, so at most one for every ``crowd`` points.
    """
    x, y, shape = F.col(xy[0]), F.col(xy[1]), F.col(polygon)
    box = g.bounds(F.array(F.flatten(F.filter(shape, lambda r: r.isNotNull()))))
    low, high = (F.col("_x1"), F.col("_y1")), (F.col("_x2"), F.col("_y2"))
    known = {"_x1": box["xmin"], "_y1": box["ymin"], "_x2": box["xmax"], "_y2": box["ymax"], "_other": F.when(~g.is_box(shape), shape)}
    spread = polygons.withColumns({**known, polygon: F.when(g.is_box(shape), shape)}).withColumn("_cell", F.explode(_cells(*low, *high, size)))
    placed = _in_cells(points, *xy, size, "_p")
    cell, other = [F.col("_pcx"), F.col("_pcy")], [F.col("_cell.cx"), F.col("_cell.cy")]
    if crowd:
        crowded = F.broadcast(placed.groupBy(F.col("_pcx").alias("_x"), F.col("_pcy").alias("_y")).agg(F.ceil(F.count("*") / crowd).alias("_slices")).where("_slices > 1"))
        sliced = lambda df, c: df.join(crowded, (c[0] == F.col("_x")) & (c[1] == F.col("_y")), "left").withColumn("_slices", F.coalesce("_slices", F.lit(1))).drop("_x", "_y")
        placed = sliced(placed, cell).withColumn("_pslice", F.pmod(F.xxhash64(*points.columns), "_slices")).drop("_slices")
        spread = sliced(spread, other).withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_slices") - 1))).drop("_slices")
        cell, other = [*cell, F.col("_pslice")], [*other, F.col("_slice")]
    placed, spread = dealt(placed, *cell), dealt(spread, *other)
    near = (x > low[0]) & (x < high[0]) & (y > low[1]) & (y < high[1])
    inside = near & (F.col("_other").isNull() | g.within(x, y, F.col("_other")))
    pairs = placed.join(spread, [*(a == b for a, b in zip(cell, other, strict=True)), inside], how)
    return pairs.withColumn(polygon, F.coalesce("_other", polygon)).drop("_pcx", "_pcy", "_pslice", "_cell", "_slice", *known)


def nearest_edges(points: DataFrame, edges: DataFrame, radius: float, line: str = "line", xy: tuple[str, str] = ("x", "y"), size: float | None = None) -> DataFrame:
    """All (point, edge) pairs within ``radius`` with ``snap_m`` and ``position_m`` along the edge; where edges have a ``length_m``, also ``position_share`` of it.

    Both sides are dealt out by cell over all of the session's shuffle partitions, since few small files make many pairs, whichever side is broadcast.
    A box about the edge is tested in the join; what remains is projected once.
    """
    size = size or max(radius, 1.0)
    xs, ys = F.transform(F.col(line), lambda p: p["x"]), F.transform(F.col(line), lambda p: p["y"])
    low, high = (F.array_min(xs) - radius, F.array_min(ys) - radius), (F.array_max(xs) + radius, F.array_max(ys) + radius)
    slack = 1e-6 * radius + 1e-6
    boxes = {"_x1": low[0] - slack, "_y1": low[1] - slack, "_x2": high[0] + slack, "_y2": high[1] + slack}
    spread = edges.withColumns({**boxes, "_parts": g.parts(F.col(line))}).withColumn("_cell", F.explode(_cells(*low, *high, size)))
    placed = _in_cells(points, *xy, size, "_p")
    placed, spread = dealt(placed, F.col("_pcx"), F.col("_pcy")), dealt(spread, F.col("_cell.cx"), F.col("_cell.cy"))
    near = F.col(xy[0]).between(F.col("_x1"), F.col("_x2")) & F.col(xy[1]).between(F.col("_y1"), F.col("_y2"))
    pairs = placed.join(spread, (F.col("_pcx") == F.col("_cell.cx")) & (F.col("_pcy") == F.col("_cell.cy")) & near).drop("_pcx", "_pcy", "_cell", *boxes)
    hit = F.filter(F.array(g.project_parts(F.col(xy[0]), F.col(xy[1]), F.col("_parts"))), lambda h: h["distance"] <= radius)
    found = pairs.select("*", F.inline(hit)).drop("_parts").withColumnsRenamed({"distance": "snap_m", "position": "position_m"})
    if "length_m" in edges.columns:
        # a line of one part has exactly its share
        found = found.withColumn("position_share", F.when(F.col("length_m") > 0, F.col("before") / F.col("length_m") + F.col("share") * (F.col("size") / F.col("length_m"))).otherwise(0.0))
    return found.drop("before", "share", "size")


def snap(points: DataFrame, edges: DataFrame, point_id: str, edge_id: str = "edge_id", radius: float = 250.0, line: str = "line", xy: tuple[str, str] = ("x", "y")) -> DataFrame:
    """Each point on its nearest edge within ``radius``, the smaller edge id where distances tie; others drop out."""
    return first_per_key(nearest_edges(points, edges, radius, line, xy), [point_id], [F.col("snap_m"), F.col(edge_id)])


def match_buildings(points: DataFrame, buildings: DataFrame, point_id: str, building_id: str = "pand_id", polygon: str = "polygon", radius: float = 50.0) -> DataFrame:
    """Points with a building: the one they lie in, else the nearest within ``radius``, else none.

    Adds the building's id, ``bag_match_type`` (within, nearest, geen_match), ``bag_afstand_meter`` and ``bag_gevalideerd``.
    """
    only = buildings.select(building_id, polygon)
    inside = first_per_key(points_in_polygons(points, only, polygon), [point_id], [F.col(building_id)]).drop(polygon).withColumn("bag_match_type", F.lit("within")).withColumn("bag_afstand_meter", F.lit(0.0))
    rest = points.join(inside.select(F.col(point_id).alias("_done")), F.col(point_id) == F.col("_done"), "left_anti")
    shells = only.select(building_id, F.col(polygon)[0].alias("line"))
    close = first_per_key(nearest_edges(rest, shells, radius), [point_id], [F.col("snap_m"), F.col(building_id)]).withColumn("bag_match_type", F.lit("nearest")).withColumn("bag_afstand_meter", F.bround("snap_m", 2)).drop("line", "snap_m", "position_m")
    none = rest.join(close.select(F.col(point_id).alias("_done")), F.col(point_id) == F.col("_done"), "left_anti").withColumn("bag_match_type", F.lit("geen_match"))
    out = inside.unionByName(close).unionByName(none, allowMissingColumns=True)
    return out.withColumn("bag_gevalideerd", F.col(building_id).isNotNull())


def far_from(left: DataFrame, right: DataFrame, radius: float, left_id: str, left_xy: tuple[str, str] = ("x", "y"), right_xy: tuple[str, str] = ("rx", "ry")) -> DataFrame:
    """Left points without any right point within ``radius``: an anti-join by distance."""
    near = within_distance(left.select(left_id, *left_xy), right.select(*right_xy), radius, left_xy, right_xy).select(F.col(left_id).alias("_near")).distinct()
    return left.join(near, F.col(left_id) == F.col("_near"), "left_anti")


def bounding_filter(df: DataFrame, columns: Sequence[str], xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Rows whose box (four stored columns) meets the given one: comparisons that Parquet can push down."""
    a, b, c, d = (F.col(x) for x in columns)
    return df.where((a <= xmax) & (c >= xmin) & (b <= ymax) & (d >= ymin))
