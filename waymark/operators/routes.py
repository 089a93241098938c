"""Example routes over road networks: every leg from a building to its target, on foot, by bike, by car, or by car and then on foot.

A route starts on the end of its way that the search chose, follows the shortest-path forest by pointer doubling, and ends on the end of the
target's way from which the search began. Legs carry the walks to and from the network, so their minutes add up to the result's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators import network
from waymark.operators.access import RoadNetwork, on_network, parking_targets
from waymark.operators.profiles import followed
from waymark.operators.relational import first_per_key
from waymark.operators.spatial import nearest_edges
from waymark.session import checkpointed

LEG = ("id", "leg", "modus", "kind", "edge_id", "from_node", "to_node", "minutes")


def _ends(placed: DataFrame) -> Column:
    """Both ends of a target's way that may be used: (node, along_min), as ``seed_costs`` has them."""
    share = F.when(F.col("length_m") > 0, F.col("position_m") / F.col("length_m")).otherwise(0.0)
    return F.filter(
        F.array(
            F.when(F.col("forward"), F.struct(F.col("u").alias("node"), (share * F.col("minutes")).alias("along_min"))),
            F.when(F.col("backward"), F.struct(F.col("v").alias("node"), ((1 - share) * F.col("minutes")).alias("along_min"))),
        ),
        lambda e: e.isNotNull(),
    )


def legs(origins: DataFrame, tree: DataFrame, net: RoadNetwork, targets: DataFrame, extra: str | None = None) -> DataFrame:
    """The legs of routes: (id, leg, modus, kind, edge_id, from_node, to_node, minutes).

    ``origins`` (id, edge_id, u, v, minutes, length_m, position_m, snap_m, node, target) come from ``origin_costs``, ``tree`` from a ``search`` of ``net`` and ``targets`` from
    ``on_network`` (with the ``extra`` minutes that the search had behind the target). Kinds are aanloop, deel (a part of a way), weg and
    uitloop; extra minutes aren't a leg. Origins without a way have none.
    """
    c = F.col
    starts = checkpointed(origins.where("node is not null").select("id", "edge_id", "node", "target", (c("snap_m") / net.snap_speed).alias("_walk"), F.when(c("length_m") > 0, c("position_m") / c("length_m")).otherwise(0.0).alias("_share"), "minutes", (c("node") == c("u")).alias("_at_u")))
    way = followed(starts, tree, ["node"], ["next_node"])
    step = way.join(tree.select("node", "next_node"), "node")
    edges = net.edges.select(c("src").alias("_s"), c("dst").alias("_d"), "edge_id", "weight")
    none = F.lit(None).cast("bigint")

    def rows(df: DataFrame, order: Column, kind: str, edge: Column, a: Column, b: Column, minutes: Column) -> DataFrame:
        return df.select("id", order.cast("bigint").alias("_order"), F.lit(kind).alias("kind"), edge.cast("bigint").alias("edge_id"), a.cast("bigint").alias("from_node"), b.cast("bigint").alias("to_node"), minutes.cast("double").alias("minutes"))

    part = F.when(c("_at_u"), c("_share")).otherwise(1 - c("_share")) * c("minutes")
    first = rows(starts, F.lit(-2), "aanloop", none, none, none, c("_walk")).unionByName(rows(starts, F.lit(-1), "deel", c("edge_id"), none, c("node"), part))
    driven = step.where("next_node is not null").join(edges, (c("node") == c("_s")) & (c("next_node") == c("_d")))
    middle = rows(driven, c("step"), "weg", c("edge_id"), c("node"), c("next_node"), c("weight"))
    placed = targets.select(c("target").alias("_t"), c("edge_id").alias("_e"), (c("snap_m") / net.snap_speed).alias("_off"), (F.coalesce(c(extra), F.lit(0.0)) if extra else F.lit(0.0)).alias("_more"), F.explode(_ends(targets)).alias("_end"))
    arrived = step.where("next_node is null").select("id", "step", "node").join(starts.select(c("id").alias("_id"), "target"), c("id") == c("_id")).join(placed, (c("target") == c("_t")) & (c("node") == c("_end.node")))
    last = first_per_key(arrived, ["id"], [c("_end.along_min") + c("_off") + c("_more"), c("_e")])
    end = rows(last, c("step") + 1, "deel", c("_e"), c("node"), none, c("_end.along_min")).unionByName(rows(last, c("step") + 2, "uitloop", none, none, none, c("_off")))
    every = first.unionByName(middle).unionByName(end)
    return every.withColumn("leg", F.row_number().over(Window.partitionBy("id").orderBy("_order")).cast("int")).withColumn("modus", F.lit(net.name)).select(*LEG)


def direct_routes(buildings: DataFrame, facilities: DataFrame, net: RoadNetwork, radius: float = 250.0, norm: float | None = None) -> DataFrame:
    """The legs behind ``access.direct``: each building's way to its nearest facility; with ``norm`` after the second try of slow ones."""
    speed = F.lit(net.snap_speed)
    targets = checkpointed(on_network(facilities, net, "target", radius))
    tree = checkpointed(net.search(network.seed_costs(targets, speed)))
    return legs(_origins(buildings, net, tree, radius, norm), tree, net, targets)


def _origins(buildings: DataFrame, net: RoadNetwork, tree: DataFrame, radius: float, norm: float | None) -> DataFrame:
    """Buildings on the way, and at the end of it, that ``access.direct`` chooses."""
    speed = F.lit(net.snap_speed)
    first = network.origin_costs(on_network(buildings, net, "pand_id", radius), tree, speed)
    if norm is None:
        return first.withColumn("id", F.col("pand_id"))
    near = nearest_edges(buildings, net.ways, radius)
    again = network.origin_costs(near, tree, speed).where("total_min is not null")
    slow = first.where(F.col("network_min").isNull() | (F.col("total_min") > norm)).select("pand_id", F.col("total_min").alias("_had"))
    better = first_per_key(again.join(slow, "pand_id"), ["pand_id"], [F.col("total_min"), F.col("edge_id")]).where("_had is null or total_min < _had").drop("_had")
    return first.join(better.select("pand_id"), "pand_id", "left_anti").unionByName(better, allowMissingColumns=True).withColumn("id", F.col("pand_id"))


def car_routes(buildings: DataFrame, facilities: DataFrame, parking: DataFrame, car: RoadNetwork, walk: RoadNetwork, norm: float, most_walk_min: float = 10.0, radius: float = 250.0) -> DataFrame:
    """The legs behind ``access.by_car``: the drive, parkeren (a change of mode, no minutes) and the walk, over ways or straight."""
    c = F.col
    places = checkpointed(parking_targets(parking, facilities, walk, most_walk_min, radius))
    placed = checkpointed(on_network(places, car, "target", radius))
    tree = checkpointed(car.search(network.seed_costs(placed, F.lit(car.snap_speed), c("walk_min"))))
    starts = checkpointed(_origins(buildings, car, tree, radius, norm))
    drive = legs(starts, tree, car, placed, "walk_min")
    parked = starts.where("target is not null").select("id", c("target").alias("_place")).join(places.select(c("target").alias("_p"), "x", "y", "facility", "walk_min", "walk_source"), c("_place") == c("_p"))
    parked = checkpointed(parked)
    # every used place walks once, however many buildings park there
    used = parked.where("walk_source = 'netwerk'").select(c("_place").alias("pand_id"), "x", "y").dropDuplicates(["pand_id"])
    foot = direct_routes(used, facilities, walk, radius).withColumnRenamed("id", "_walker")
    on = parked.where("walk_source = 'netwerk'").select("id", "_place").join(foot, c("_place") == c("_walker")).drop("_place", "_walker")
    change = parked.select("id", F.lit(0).alias("leg"), F.lit(walk.name).alias("modus"), F.lit("parkeren").alias("kind"), F.lit(None).cast("bigint").alias("edge_id"), F.lit(None).cast("bigint").alias("from_node"), F.lit(None).cast("bigint").alias("to_node"), F.lit(0.0).alias("minutes"))
    straight = parked.where("walk_source <> 'netwerk'").select("id", F.lit(1).alias("leg"), F.lit(walk.name).alias("modus"), F.lit("luchtlijn").alias("kind"), F.lit(None).cast("bigint").alias("edge_id"), F.lit(None).cast("bigint").alias("from_node"), F.lit(None).cast("bigint").alias("to_node"), c("walk_min").alias("minutes"))
    second = change.unionByName(straight).unionByName(on).withColumn("_half", F.lit(2))
    every = drive.withColumn("_half", F.lit(1)).unionByName(second)
    return every.withColumn("leg", F.row_number().over(Window.partitionBy("id").orderBy("_half", "leg")).cast("int")).select(*LEG)
