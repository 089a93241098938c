"""Road networks as node and edge tables: directed edges, seeds, multi-source shortest paths, routes, flows.

Shortest paths relax in rounds: the rows improved in the last round meet the edges in a join, and the best offer per
(key, node) wins. All targets, modes and profiles go through one loop, told apart by a key. The loop
reads reliable checkpoints, so its lineage stays short and lost executors cost one round.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import geometry as g
from waymark.session import checkpointed

#: Metres a minute between a point and the network, by mode.
SNAP_SPEED = {"lopen": 80.0, "fiets": 250.0, "auto": 833.33}


def split_parts(ways: DataFrame, parts: str = "parts") -> DataFrame:
    """A row for each part of a multi-part line, with its share of the whole length as ``share``."""
    total = F.aggregate(F.col(parts), F.lit(0.0), lambda s, p: s + g.length(p))
    each = ways.withColumn("_total", total).select("*", F.posexplode(parts).alias("part", "line")).drop(parts)
    return each.withColumn("lengte_meter_deel", g.length(F.col("line"))).where("lengte_meter_deel > 0").withColumn("share", F.col("lengte_meter_deel") / F.col("_total")).drop("_total")


def with_minutes(ways: DataFrame, speed_kmh: Column) -> DataFrame:
    """``reistijd_min`` as given, else length by speed."""
    return ways.withColumn("reistijd_min", F.coalesce(F.col("reistijd_min"), F.col("lengte_meter") / (speed_kmh * 1000 / 60)))


def directed_edges(ways: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Edges (keys, src, dst, weight) of ways (edge_id, u, v, minutes, forward, backward); of parallel ones the quickest."""
    ways = ways.where("minutes is not null and minutes >= 0")
    there = ways.where("forward").select(*keys, F.col("u").alias("src"), F.col("v").alias("dst"), "minutes", "edge_id")
    back = ways.where("backward").select(*keys, F.col("v").alias("src"), F.col("u").alias("dst"), "minutes", "edge_id")
    best = there.unionByName(back).groupBy(*keys, "src", "dst").agg(F.min(F.struct("minutes", "edge_id")).alias("_best"))
    return best.select(*keys, "src", "dst", F.col("_best.minutes").alias("weight"), F.col("_best.edge_id").alias("edge_id"))


def _share(placed: DataFrame) -> Column:
    """What lies before a place, as a share of its edge: ``position_share`` where it is known, which has no rounding of metres in it."""
    if "position_share" in placed.columns:
        return F.col("position_share")
    return F.when(F.col("length_m") > 0, F.col("position_m") / F.col("length_m")).otherwise(0.0)


def seed_costs(snapped: DataFrame, speed: Column, extra: Column | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Seeds (keys, node, cost, target) of targets on edges: from u where the edge may be driven forward, from v backward.

    ``snapped`` has target, u, v, minutes, length_m, position_m, snap_m, forward and backward.
    """
    share = _share(snapped)
    last = F.col("snap_m") / speed + (F.lit(0.0) if extra is None else F.coalesce(extra, F.lit(0.0)))
    ends = F.array(
        F.when(F.col("forward"), F.struct(F.col("u").alias("node"), (share * F.col("minutes") + last).alias("cost"))),
        F.when(F.col("backward"), F.struct(F.col("v").alias("node"), ((1 - share) * F.col("minutes") + last).alias("cost"))),
    )
    rows = snapped.select(*keys, "target", F.explode(ends).alias("_end")).where("_end is not null")
    return rows.select(*keys, F.col("_end.node").alias("node"), F.col("_end.cost").alias("cost"), "target")


def shortest_paths(edges: DataFrame, seeds: DataFrame, keys: Sequence[str] = (), cutoff: float | None = None, max_rounds: int = 10_000) -> DataFrame:
    """Least cost from every node to its nearest target along directed edges: (keys, node, cost, target, next_node).

    ``edges`` has (keys, src, dst, weight), ``seeds`` (keys, node, cost, target). Nodes beyond ``cutoff`` or without a way
    don't occur. Ties go to the smaller target, then to the next node found in fewer rounds, then to the smaller one. ``next_node`` is null at seeds.
    """
    keys = list(keys)
    order = F.struct(F.col("cost"), F.col("target"), F.col("next_node"))
    # negative weights would never settle; as in the edge builder they don't count
    backward = checkpointed(edges.where("weight >= 0").select(*keys, F.col("dst").alias("node"), F.col("src").alias("_from"), "weight"))

    def best(offers: DataFrame) -> DataFrame:
        return offers.groupBy(*keys, "node").agg(F.min(order).alias("_best")).select(*keys, "node", "_best.*")

    start = seeds.where("cost is not null").select(*keys, "node", F.col("cost").cast("double").alias("cost"), "target", F.lit(None).cast("bigint").alias("next_node"))
    if cutoff is not None:
        start = start.where(F.col("cost") <= cutoff)
    known = checkpointed(best(start).withColumn("fresh", F.lit(True)))
    for _ in range(max_rounds):
        frontier = known.where("fresh").drop("fresh", "next_node")
        offers = frontier.join(backward, [*keys, "node"]).select(*keys, F.col("_from").alias("node"), (F.col("cost") + F.col("weight")).alias("cost"), "target", F.col("node").alias("next_node"))
        if cutoff is not None:
            offers = offers.where(F.col("cost") <= cutoff)
        # one shuffle: the old value and all offers of a node meet, the least wins, and it is fresh if it is an offer
        old = known.select(*keys, "node", "cost", "target", "next_node", F.lit(0).alias("_new"))
        both = old.unionByName(offers.withColumn("_new", F.lit(1)))
        ranked = both.groupBy(*keys, "node").agg(F.min(F.struct("cost", "target", "_new", "next_node")).alias("_best"))
        known = checkpointed(ranked.select(*keys, "node", "_best.cost", "_best.target", "_best.next_node", (F.col("_best._new") == 1).alias("fresh")))
        if not known.where("fresh").head(1):
            return known.drop("fresh")
    raise RuntimeError("shortest paths did not settle")


def origin_costs(origins: DataFrame, costs: DataFrame, speed: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Minutes of origins on edges: via u against the edge's direction, via v along it, u where both tie.

    ``origins`` has id, u, v, minutes, length_m, position_m, snap_m, forward, backward. Adds node, target, network_min and total_min;
    origins without a way have nulls.
    """
    keys = list(keys)
    share = _share(origins)
    u = costs.select(*[F.col(k).alias(f"_u{k}") for k in keys], F.col("node").alias("_un"), F.col("cost").alias("_uc"), F.col("target").alias("_ut"))
    v = costs.select(*[F.col(k).alias(f"_v{k}") for k in keys], F.col("node").alias("_vn"), F.col("cost").alias("_vc"), F.col("target").alias("_vt"))

    def same(prefix: str, node: str) -> Column:
        on = F.col(node) == F.col(f"_{prefix}n")
        for k in keys:
            on = on & (F.col(k) == F.col(f"_{prefix}{k}"))
        return on

    joined = origins.join(u, same("u", "u"), "left").join(v, same("v", "v"), "left")
    via_u = F.when(F.col("backward"), share * F.col("minutes") + F.col("_uc"))
    via_v = F.when(F.col("forward"), (1 - share) * F.col("minutes") + F.col("_vc"))
    take_u = via_u.isNotNull() & (via_v.isNull() | (via_u <= via_v))
    out = joined.withColumn("network_min", F.least(via_u, via_v)).withColumn("node", F.when(take_u, F.col("u")).when(via_v.isNotNull(), F.col("v"))).withColumn("target", F.when(take_u, F.col("_ut")).when(via_v.isNotNull(), F.col("_vt")))
    return out.withColumn("total_min", F.col("network_min") + F.col("snap_m") / speed).drop(*[f"_{p}{c}" for p in "uv" for c in (*keys, "n", "c", "t")])


def resnap(origins: DataFrame, candidates: DataFrame, costs: DataFrame, speed: Column, norm: float, id_col: str = "id", keys: Sequence[str] = ()) -> DataFrame:
    """A second try for origins without a way or above the norm: the best of all edges within the radius.

    ``origins`` comes from ``origin_costs``; ``candidates`` has all edges near each origin (``nearest_edges``). A new place counts
    only if the old one has no time or is strictly slower.
    """
    keys = list(keys)
    bad = origins.where(F.col("network_min").isNull() | (F.col("total_min") > norm)).select(id_col)
    tried = origin_costs(candidates.join(bad, id_col, "left_semi"), costs, speed, keys).where("total_min is not null")
    rank = F.struct("total_min", "edge_id")
    best = tried.groupBy(id_col).agg(F.min_by(F.struct("node", "target", "network_min", "total_min", "edge_id", "snap_m"), rank).alias("_again"))
    both = origins.join(best, id_col, "left")
    better = F.col("_again").isNotNull() & (F.col("total_min").isNull() | (F.col("_again.total_min") < F.col("total_min")))
    changed = ("node", "target", "network_min", "total_min", "edge_id", "snap_m")
    return both.select(*[F.when(better, F.col(f"_again.{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in origins.columns], better.alias("resnapped"))


def paths(starts: DataFrame, tree: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """The edges that each start takes to its target: (id, step, src, dst), following ``next_node`` of ``shortest_paths``."""
    hop = checkpointed(tree.where("next_node is not null").select(F.col("node").alias("src"), F.col("next_node").alias("dst")))
    at = starts.select("id", F.col("node").alias("src"), F.lit(1).alias("step"))
    done: DataFrame | None = None
    for _ in range(max_rounds):
        taken = checkpointed(at.join(hop, "src").select("id", "step", "src", "dst"))
        if not taken.head(1):
            break
        done = taken if done is None else done.unionByName(taken)
        at = taken.select("id", F.col("dst").alias("src"), (F.col("step") + 1).alias("step"))
    return done if done is not None else at.join(hop, "src").select("id", "step", "src", "dst")


def flow_counts(starts: DataFrame, tree: DataFrame, measures: Sequence[str] = ("panden",), max_rounds: int = 10_000) -> DataFrame:
    """How many starts use each edge of the shortest-path forest: (src, dst, measures), without routing any start.

    ``starts`` has (node, measures): what sets off at each node. Every round moves all that is under way one edge on and
    adds it to that edge, pre-aggregated by node, so the work follows the depth of the forest and not the number of starts.
    """
    measures = list(measures)
    hop = checkpointed(tree.where("next_node is not null").select(F.col("node").alias("src"), F.col("next_node").alias("dst")))
    total = lambda df, by: df.groupBy(*by).agg(*[F.sum(m).alias(m) for m in measures])
    moving = total(starts.select(F.col("node").alias("src"), *measures), ["src"])
    flows: DataFrame | None = None
    for _ in range(max_rounds):
        crossed = checkpointed(moving.join(hop, "src").select("src", "dst", *measures))
        if not crossed.head(1):
            break
        flows = crossed if flows is None else flows.unionByName(crossed)
        moving = total(crossed.select(F.col("dst").alias("src"), *measures), ["src"])
    if flows is None:
        return moving.join(hop, "src").select("src", "dst", *measures)
    return total(flows, ["src", "dst"])


def bands(costs: DataFrame, limits: Sequence[float], minutes: str = "cost") -> DataFrame:
    """``costs`` with the number of the band (from 1) that first holds them; beyond the last limit null."""
    from waymark.functions.classes import band_of

    return costs.withColumn("band", band_of(F.col(minutes), list(limits)))
