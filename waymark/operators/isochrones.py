"""Isochrones: bands of buildings or edges by minutes, and their areas as grid cells or polygons.

Edges are cut where a band's limit falls on them, so the pieces of all bands are as long as what is reached. Areas are rasters. A cell belongs to a band if a building of it lies within the reach of the cell's middle, and to the first
band that has it. Counts and band limits are exact; outlines follow the grid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import geometry as g
from waymark.functions.classes import band_of
from waymark.operators import dissolve


#: Pieces of a smaller share of their way are rounding errors.
SHORTEST = 1e-9


def building_bands(access: DataFrame, limits: Sequence[float], minutes: str = "total_min", within: str = "within") -> DataFrame:
    """Buildings inside the norm with the band that first holds them, and the band's limits."""
    upper = F.array(*[F.lit(float(x)) for x in limits])
    rows = access.where(F.coalesce(F.col(within), F.lit(False))).withColumn("band", band_of(F.col(minutes), list(limits))).where("band is not null")
    return rows.withColumn("band_van_min", F.when(F.col("band") == 1, 0.0).otherwise(F.get(upper, F.col("band") - 2))).withColumn("band_tot_min", F.get(upper, F.col("band") - 1))


def band_counts(banded: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return banded.groupBy(*keys, "band", "band_van_min", "band_tot_min").agg(F.count("*").alias("aantal_panden"))


def band_cells(banded: DataFrame, keys: Sequence[str] = (), reach: float = 150.0, size: float = 50.0) -> DataFrame:
    """Cells (keys, cx, cy, band): each with the lowest band that reaches its middle."""
    steps = int(reach // size) + 1
    near = [(i, j) for i in range(-steps, steps + 1) for j in range(-steps, steps + 1) if (i * i + j * j) * size * size <= reach * reach]
    cx, cy = F.floor(F.col("x") / size).cast("bigint"), F.floor(F.col("y") / size).cast("bigint")
    # one row per cell and band before the spread: many buildings share a cell
    own = banded.select(*keys, cx.alias("_x"), cy.alias("_y"), "band").groupBy(*keys, "_x", "_y").agg(F.min("band").alias("band"))
    spread = own.select(*keys, "band", F.explode(F.array(*[F.struct((F.col("_x") + i).alias("cx"), (F.col("_y") + j).alias("cy")) for i, j in near])).alias("c"))
    return spread.groupBy(*keys, "c.cx", "c.cy").agg(F.min("band").alias("band"))


def cell_outlines(cells: DataFrame, keys: Sequence[str] = (), size: float = 50.0) -> DataFrame:
    """The unit edges between a band's cells and what isn't in it: (keys, band, ax, ay, bx, by), the outline of each band."""
    sides = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(ax).alias("ax"), F.lit(ay).alias("ay"), F.lit(bx).alias("bx"), F.lit(by).alias("by")) for dx, dy, ax, ay, bx, by in ((0, -1, 0, 0, 1, 0), (1, 0, 1, 0, 1, 1), (0, 1, 1, 1, 0, 1), (-1, 0, 0, 1, 0, 0))])
    rows = cells.select(*keys, "band", "cx", "cy", F.explode(sides).alias("s"))
    rows = rows.withColumn("nx", F.col("cx") + F.col("s.dx")).withColumn("ny", F.col("cy") + F.col("s.dy"))
    other = cells.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("band").alias("_band"), F.col("cx").alias("_cx"), F.col("cy").alias("_cy"))
    same = (F.col("nx") == F.col("_cx")) & (F.col("ny") == F.col("_cy")) & (F.col("band") == F.col("_band"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    border = rows.join(other, same, "left_anti")
    at = lambda c, s: ((F.col(c) + F.col(f"s.{s}")) * size).alias(s)
    return border.select(*keys, "band", at("cx", "ax"), at("cy", "ay"), at("cx", "bx"), at("cy", "by"))


def cell_polygons(cells: DataFrame, keys: Sequence[str] = (), size: float = 50.0) -> DataFrame:
    """The areas of each band's cells as polygons with holes: (keys, band, part, polygon, area, holes). Cells that only touch are parts of their own."""
    by = [*keys, "band"]
    return dissolve.polygons(dissolve.rings(cell_outlines(cells, keys, size), by), by, size * 100)


def cell_difference(cells: DataFrame, other: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Cells that ``other`` doesn't have, whatever their band there."""
    return cells.join(other.select(*keys, "cx", "cy").distinct(), [*keys, "cx", "cy"], "left_anti")


def reached_pieces(ways: DataFrame, costs: DataFrame, limits: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Pieces of ways by band: (keys, edge_id, band, via, van_m, tot_m, line), metres from u on.

    ``ways`` has edge_id, u, v, minutes, length_m, forward, backward and line, ``costs`` (keys, node, cost) the minutes from each node to a target, by ``shortest_paths`` or
    with what a ride takes added at its stops. A place on a way leaves it over u against its direction or over v along it, whichever is
    quicker; ``via`` tells, and both meet where they take the same. Bands go from a limit, exclusive, to the next, inclusive.
    """
    keys = list(keys)
    u, v = (costs.select(*[F.col(k).alias(f"_{end}{k}") for k in keys], F.col("node").alias(f"_{end}"), F.col("cost").alias(f"_c{end}")) for end in "uv")
    sides = []
    for end, costs_of, free in (("u", u, "backward"), ("v", v, "forward")):
        part = ways.where(F.col(free) & F.col("minutes").isNotNull()).join(costs_of, F.col(end) == F.col(f"_{end}"))
        sides.append(part.select(*[F.col(f"_{end}{k}").alias(k) for k in keys], "edge_id", F.lit(end).alias("_end"), F.col(f"_c{end}").alias("_c")))
    met = sides[0].unionByName(sides[1]).groupBy(*keys, "edge_id").agg(F.min(F.when(F.col("_end") == "u", F.col("_c"))).alias("_cu"), F.min(F.when(F.col("_end") == "v", F.col("_c"))).alias("_cv"))
    rows = met.join(ways.select("edge_id", "minutes", "length_m", "line"), "edge_id")
    m = F.col("minutes")

    def kept(share: Column, most: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(most, share))

    def within(limit: float, cost: Column) -> Column:
        """How much of a way, from one end on, takes at most ``limit`` minutes."""
        return F.when(m > 0, (F.lit(float(limit)) - cost) / m).otherwise(F.when(cost <= limit, 1.0).otherwise(0.0))

    both = F.when(m > 0, kept((F.col("_cv") + m - F.col("_cu")) / (2 * m), F.lit(1.0))).otherwise(F.when(F.col("_cu") <= F.col("_cv"), 1.0).otherwise(0.0))
    meet = F.when(F.col("_cv").isNull(), 1.0).when(F.col("_cu").isNull(), 0.0).otherwise(both)
    found = []
    for k, high in enumerate(limits):
        for via, cost, most in (("u", F.col("_cu"), F.col("_meet")), ("v", F.col("_cv"), 1 - F.col("_meet"))):
            near = F.lit(0.0) if k == 0 else kept(within(limits[k - 1], cost), most)
            far = kept(within(high, cost), most)
            low, top = (near, far) if via == "u" else (1 - far, 1 - near)
            found.append(F.when(cost.isNotNull() & (far - near > SHORTEST), F.struct(F.lit(k + 1).alias("band"), F.lit(via).alias("via"), low.alias("_low"), top.alias("_top"), (low * F.col("length_m")).alias("van_m"), (top * F.col("length_m")).alias("tot_m"))))
    pieces = rows.withColumn("_meet", meet).withColumn("_p", F.explode(F.array(*found))).where("_p is not null").select(*keys, "edge_id", "_p.*", "line")
    whole = g.length(F.col("line"))
    return pieces.withColumn("line", g.substring(F.col("line"), F.col("_low") * whole, F.col("_top") * whole)).drop("_low", "_top")


def multimodal(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The union over modes: each cell with the lowest band of any mode."""
    return cells.groupBy(*keys, "cx", "cy").agg(F.min("band").alias("band"))
