"""Travel times of buildings to their nearest facility by every mode, tested against the norm.

Results are long: facility, level, mode and building. Facilities and buildings lie on network edges (``spatial.snap``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators import network, regions
from waymark.operators.relational import first_per_key
from waymark.operators.spatial import nearest_edges, snap, within_distance


@dataclass(frozen=True)
class RoadNetwork:
    """A mode's ways (edge_id, u, v, minutes, length_m, forward, backward, line), its edges, and its speed off the network.

    With ``regions`` (node, region) searches go region by region, else by rounds over all nodes.
    """

    name: str
    ways: DataFrame
    edges: DataFrame
    snap_speed: float
    regions: DataFrame | None = None

    @staticmethod
    def of(name: str, ways: DataFrame, snap_speed: float, region_m: float | None = None) -> RoadNetwork:
        """A network of ways; ``region_m`` cuts it into squares of so many metres, by the ends of the ways' lines."""
        if region_m is None:
            return RoadNetwork(name, ways, network.directed_edges(ways), snap_speed)
        end = lambda node, at: F.struct(F.col(node).alias("node"), at["x"].alias("x"), at["y"].alias("y"))
        nodes = ways.select(F.explode(F.array(end("u", F.element_at("line", 1)), end("v", F.element_at("line", -1)))).alias("_n")).select("_n.*")
        return RoadNetwork(name, ways, network.directed_edges(ways), snap_speed, regions.node_regions(nodes, region_m))

    def search(self, seeds: DataFrame, cutoff: float | None = None) -> DataFrame:
        """Least costs from every node to its nearest seed, as ``network.shortest_paths`` has them."""
        if self.regions is None:
            return network.shortest_paths(self.edges, seeds, cutoff=cutoff)
        return regions.regional_paths(self.edges, seeds, self.regions, cutoff=cutoff)


def on_network(points: DataFrame, net: RoadNetwork, id_col: str, radius: float = 250.0) -> DataFrame:
    """Points on their nearest way, with what seeds and origins need."""
    return snap(points, net.ways, id_col, "edge_id", radius)


def two_decimals(minutes: Column) -> Column:
    """Rounded to two decimals, halves to even, by the hundredfold as pandas does it; by its written digits a half that a sum misses by its last bit would go the wrong way."""
    return F.rint(minutes * 100.0) / 100.0


def norm_tested(rows: DataFrame, norm: Column) -> DataFrame:
    """reachable, within (before rounding), and times rounded to two decimals."""
    total = F.col("total_min")
    return rows.withColumn("norm_min", norm.cast("double")).withColumn("reachable", total.isNotNull()).withColumn("within", F.coalesce(total <= F.col("norm_min"), F.lit(False))).withColumn("network_min", two_decimals(F.col("network_min"))).withColumn("total_min", two_decimals(total))


def direct(buildings: DataFrame, facilities: DataFrame, net: RoadNetwork, mode: str, norm: float, row_norm: Column | None = None, radius: float = 250.0, extra: str | None = None) -> DataFrame:
    """Walking, cycling or driving all the way: (pand_id, target, network_min, total_min, norm_min, reachable, within, modus).

    ``facilities`` has target, x, y (and ``extra`` minutes behind the target). Buildings beyond the radius or without a way have
    null times. Buildings without a time or above ``norm`` try every way within the radius once more.
    """
    speed = F.lit(net.snap_speed)
    seeds = network.seed_costs(on_network(facilities, net, "target", radius), speed, F.col(extra) if extra else None)
    costs = net.search(seeds)
    placed = on_network(buildings, net, "pand_id", radius)
    first = network.origin_costs(placed, costs, speed)
    candidates = nearest_edges(buildings, net.ways, radius)
    again = network.resnap(first, candidates, costs, speed, norm, "pand_id")
    found = again.select(F.col("pand_id").alias("_id"), "node", "target", "network_min", "total_min", "snap_m", "resnapped")
    rows = buildings.join(found, F.col("pand_id") == F.col("_id"), "left").drop("_id")
    return norm_tested(rows, row_norm if row_norm is not None else F.lit(norm)).withColumn("modus", F.lit(mode))


def parking_targets(parking: DataFrame, facilities: DataFrame, walk: RoadNetwork, most_min: float = 10.0, radius: float = 250.0) -> DataFrame:
    """Parking places with a facility within ``most_min`` on foot: (target, x, y, walk_min, facility, walk_source).

    Over the walking network, or in a straight line at walking speed where that is quicker or there is no way.
    """
    speed = F.lit(walk.snap_speed)
    seeds = network.seed_costs(on_network(facilities, walk, "target", radius), speed)
    costs = walk.search(seeds, most_min)
    placed = on_network(parking.select(F.col("parking").alias("pand_id"), "x", "y"), walk, "pand_id", radius)
    by_way = network.origin_costs(placed, costs, speed).select(F.col("pand_id").alias("parking"), F.col("total_min").alias("way_min"), F.col("target").alias("way_target"))
    other = facilities.select(F.col("target").alias("line_target"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    straight = first_per_key(within_distance(parking, other, most_min * walk.snap_speed), ["parking"], [F.col("afstand_m"), F.col("line_target")]).select(F.col("parking").alias("_p"), (F.col("afstand_m") / speed).alias("line_min"), "line_target")
    rows = parking.join(by_way, "parking", "left").join(straight, F.col("parking") == F.col("_p"), "left").drop("_p")
    line = F.col("line_min").isNotNull() & (F.col("way_min").isNull() | (F.col("line_min") < F.col("way_min")))
    minutes = F.when(line, F.col("line_min")).otherwise(F.col("way_min"))
    out = rows.select(F.col("parking").alias("target"), "x", "y", two_decimals(minutes).alias("walk_min"), F.when(line, F.col("line_target")).otherwise(F.col("way_target")).alias("facility"), F.when(line, "luchtlijn_fallback").otherwise("netwerk").alias("walk_source"))
    return out.where(F.col("walk_min").isNotNull() & (F.col("walk_min") <= most_min))


def by_car(buildings: DataFrame, facilities: DataFrame, parking: DataFrame, car: RoadNetwork, walk: RoadNetwork, norm: float, most_walk_min: float = 10.0, radius: float = 250.0) -> DataFrame:
    """Drive to a parking place and walk on: the walk is part of the target's cost. ``target`` becomes the facility, ``parking`` the place."""
    places = parking_targets(parking, facilities, walk, most_walk_min, radius)
    rows = direct(buildings, places, car, "auto", norm, radius=radius, extra="walk_min")
    ends = places.select(F.col("target").alias("_place"), "facility", "walk_min", "walk_source")
    return rows.join(ends, F.col("target") == F.col("_place"), "left").withColumn("parking", F.col("target")).withColumn("target", F.col("facility")).drop("_place", "facility")


def by_transit(buildings: DataFrame, stops: DataFrame, profiles: DataFrame, net: RoadNetwork, mode: str, norm: float, radius: float = 250.0) -> DataFrame:
    """To a stop and on by transit: stops (node, x, y) with profile rows (node, mediaan, min, p90, target).

    One search serves the median, the least and the 90th percentile, told apart by a key; the median is the result, the others are
    ``min_min`` and ``p90_min``.
    """
    speed = F.lit(net.snap_speed)
    at = stops.select(F.col("node").alias("target"), "x", "y")
    known = on_network(at, net, "target", radius).join(profiles.select(F.col("node").alias("_node"), "mediaan", "min", "p90"), F.col("target") == F.col("_node")).drop("_node")
    each = known.select("*", F.explode(F.create_map(F.lit("mediaan"), F.col("mediaan"), F.lit("min"), F.col("min"), F.lit("p90"), F.col("p90"))).alias("profiel", "rest"))
    seeds = network.seed_costs(each, speed, F.col("rest"), ["profiel"])
    edges = net.edges.select(F.explode(F.array(*[F.lit(p) for p in ("mediaan", "min", "p90")])).alias("profiel"), "src", "dst", "weight")
    costs = network.shortest_paths(edges, seeds, ["profiel"])
    placed = on_network(buildings, net, "pand_id", radius).select("*", F.explode(F.array(*[F.lit(p) for p in ("mediaan", "min", "p90")])).alias("profiel"))
    found = network.origin_costs(placed, costs, speed, ["profiel"])
    pick = lambda p, c: F.max(F.when(F.col("profiel") == p, F.col(c)))
    wide = found.groupBy(F.col("pand_id").alias("_id")).agg(pick("mediaan", "network_min").alias("network_min"), pick("mediaan", "total_min").alias("total_min"), pick("mediaan", "target").alias("stop"), pick("min", "total_min").alias("min_min"), pick("p90", "total_min").alias("p90_min"))
    ends = profiles.select(F.col("node").alias("_node"), F.col("target").alias("target"))
    rows = buildings.join(wide, F.col("pand_id") == F.col("_id"), "left").drop("_id").join(ends, F.col("stop") == F.col("_node"), "left").drop("_node")
    return norm_tested(rows, F.lit(norm)).withColumn("modus", F.lit(mode))


def transit_or_direct(transit: DataFrame, straight: DataFrame, direct_norm: float, norm: float) -> DataFrame:
    """Transit results, replaced by the direct way where that is within its own norm and quicker (or transit has none).

    ``reistijd_bron`` says ov, direct_access or geen_route; the three profile times become the direct one.
    """
    d = straight.select(F.col("pand_id").alias("_id"), F.col("total_min").alias("_total"), F.col("network_min").alias("_network"), F.col("target").alias("_target"))
    rows = transit.join(d, F.col("pand_id") == F.col("_id"), "left")
    better = F.coalesce((F.col("_total") <= direct_norm) & (F.col("total_min").isNull() | (F.col("_total") < F.col("total_min"))), F.lit(False))
    take = {"total_min": "_total", "network_min": "_network", "target": "_target", "min_min": "_total", "p90_min": "_total"}
    out = rows.select(*[F.when(better, F.col(take[c])).otherwise(F.col(c)).alias(c) if c in take else F.col(c) for c in transit.columns if c not in ("norm_min", "reachable", "within")], F.when(better, "direct_access").when(F.col("total_min").isNotNull(), "ov").otherwise("geen_route").alias("reistijd_bron"))
    return norm_tested(out, F.lit(norm))


def stop_egress(stops: DataFrame, facilities: DataFrame, walk: RoadNetwork, key: int = 0, radius: float = 250.0) -> DataFrame:
    """Minutes on foot from stops to the nearest facility: (key, node, minutes, target), for the departure profiles."""
    speed = F.lit(walk.snap_speed)
    costs = walk.search(network.seed_costs(on_network(facilities, walk, "target", radius), speed))
    placed = on_network(stops.select(F.col("node").alias("pand_id"), "x", "y"), walk, "pand_id", radius)
    found = network.origin_costs(placed, costs, speed).where("total_min is not null")
    return found.select(F.lit(key).cast("bigint").alias("key"), F.col("pand_id").alias("node"), F.col("total_min").alias("minutes"), "target")


def with_facility(rows: DataFrame, facilities: DataFrame, names: list[str]) -> DataFrame:
    """Attributes of the chosen facility: its name, the first filled of ``names``, and its place."""
    from waymark.functions.text import first_filled

    f = facilities.select(F.col("target").alias("_t"), first_filled(*[F.col(n) for n in names if n in facilities.columns]).alias("gekozen_naam"), F.col("x").alias("gekozen_x"), F.col("y").alias("gekozen_y"))
    return rows.join(f, F.col("target") == F.col("_t"), "left").drop("_t")
