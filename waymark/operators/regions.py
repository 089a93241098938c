"""Shortest paths by regions: the network is cut into parts of bounded size, each searched whole in one task.

A round runs the regions that a better offer reached: a task settles its region by Dijkstra's rule, and what it improved at the border is offered
to the regions across. So rounds follow the regions that a path crosses, not its edges, and only regions with better offers are read again.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.session import checkpointed, ship_package

#: Squares are quartered at most so often; what still lies too close is dealt by node.
MOST_QUARTERINGS = 20
#: Rounds whose improvements lie in tables of their own before all labels are made one table again.
KEPT_ROUNDS = 8


def node_regions(nodes: DataFrame, size: float = 10_000.0, most: int = 50_000) -> DataFrame:
    """A region for each node (node, x, y): squares of ``size`` metres, quartered until none holds more than ``most`` nodes.

    Places shared by more nodes than that are dealt out by the node's hash, to parts of about half of ``most``. Nodes without a place are left out; of a node's places
    the least counts.
    """
    left = checkpointed(nodes.where("x is not null and y is not null and not isnan(x) and not isnan(y)").groupBy("node").agg(F.min(F.struct("x", "y")).alias("_p")).select("node", "_p.*"))
    out: DataFrame | None = None
    for level in range(MOST_QUARTERINGS + 1):
        side = size / 2**level
        cell = [F.floor(F.col("x") / side).alias("_cx"), F.floor(F.col("y") / side).alias("_cy")]
        crowded = checkpointed(left.groupBy(*cell).agg(F.count("*").alias("_n")).where(F.col("_n") > most))
        placed = left.select("*", *cell)
        name = F.xxhash64(F.lit(level), "_cx", "_cy")
        full = bool(crowded.head(1))
        done = placed.join(crowded, ["_cx", "_cy"], "left_anti") if full else placed
        rows = done.select("node", name.alias("region"))
        if full and level == MOST_QUARTERINGS:
            parts = F.ceil(F.col("_n") * 2 / most)
            dealt = placed.join(crowded, ["_cx", "_cy"]).select("node", F.xxhash64(name, F.pmod(F.xxhash64("node"), parts)).alias("region"))
            rows = rows.unionByName(dealt)
        out = rows if out is None else out.unionByName(rows)
        if not full:
            break
        left = checkpointed(placed.join(crowded, ["_cx", "_cy"], "left_semi").select("node", "x", "y"))
    return checkpointed(out)


def _settle(cutoff: float | None):
    """The task of one region: its edges and labels in, the labels that its offers improve out."""

    def run(edges: pa.Table, labels: pa.Table) -> pa.Table:
        wrap = lambda v: () if v is None else (v,)  # noqa: E731  nulls come first, as in Spark's order
        columns = ("node", "cost", "target", "next_node", "offer")
        best: dict[int, tuple] = {}
        heap: list[tuple] = []
        for node, cost, target, after, offer in zip(*(labels[c].to_pylist() for c in columns), strict=True):
            label = (cost, wrap(target))
            if offer:
                heap.append((*label, wrap(after), node))
            elif node not in best or label < best[node]:
                best[node] = label
        back: dict[int, list[tuple]] = {}
        for node, start, weight in zip(*(edges[c].to_pylist() for c in ("node", "_from", "weight")), strict=True):
            back.setdefault(node, []).append((start, weight))
        heapq.heapify(heap)
        better: dict[int, tuple] = {}
        while heap:
            cost, target, after, node = heapq.heappop(heap)
            if node in best and best[node] <= (cost, target):
                continue
            best[node] = (cost, target)
            better[node] = (cost, target, after)
            for start, weight in back.get(node, ()):
                offer = (cost + weight, target)
                if (cutoff is None or offer[0] <= cutoff) and (start not in best or offer < best[start]):
                    heapq.heappush(heap, (*offer, (node,), start))
        schema = pa.schema([f for f in labels.schema if f.name != "offer"])
        rows = {"node": list(better), "cost": [b[0] for b in better.values()], "target": [b[1][0] if b[1] else None for b in better.values()], "next_node": [b[2][0] if b[2] else None for b in better.values()]}
        return pa.table([pa.array(rows[f.name] if f.name in rows else labels[f.name][:1].to_pylist() * len(better), f.type) for f in schema], schema=schema)

    return run


def _merged(tables: Sequence[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def regional_paths(edges: DataFrame, seeds: DataFrame, regions: DataFrame, keys: Sequence[str] = (), cutoff: float | None = None, max_rounds: int = 10_000) -> DataFrame:
    """What ``network.shortest_paths`` gives, found region by region: (keys, node, cost, target, next_node).

    ``regions`` has a row (node, region) for each node, as by ``node_regions``; a node without one is a region of its own. A task holds the edges within one region
    and its labels, for one key; edges between regions are met in joins. Ties go to the smaller target, then to the next node found in
    fewer rounds, then to the smaller one. Negative and null weights and seeds without a cost or a node don't count.
    """
    ship_package(edges.sparkSession)
    keys = list(keys)
    home = checkpointed(regions.where("region is not null").groupBy("node").agg(F.min("region").cast("bigint").alias("region")))

    def at_home(df: DataFrame, node: str, name: str) -> DataFrame:
        return df.join(home.select(F.col("node").alias("_home"), F.col("region").alias(name)), F.col(node) == F.col("_home"), "left").drop("_home").withColumn(name, F.coalesce(F.col(name), F.xxhash64(F.col(node))))

    backward = edges.where("weight >= 0 and src is not null and dst is not null").select(*keys, F.col("dst").alias("node"), F.col("src").alias("_from"), F.col("weight").cast("double").alias("weight"))
    backward = checkpointed(at_home(at_home(backward, "node", "region"), "_from", "_across"))
    inner = backward.where("region = _across").drop("_across")
    border = backward.where("region <> _across").drop("region")
    best = F.min(F.struct("cost", "target", "next_node")).alias("_best")
    label = ("cost", "target", "next_node")

    start = at_home(seeds.where("cost is not null and node is not null").select(*keys, "node", F.col("cost").cast("double").alias("cost"), "target", F.lit(None).cast(edges.schema["dst"].dataType).alias("next_node")), "node", "region")
    if cutoff is not None:
        start = start.where(F.col("cost") <= cutoff)
    offers = checkpointed(start.groupBy(*keys, "region", "node").agg(best).select(*keys, "region", "node", "_best.*"))
    schema = offers.schema
    known: list[DataFrame] = [offers.limit(0)]
    for _ in range(max_rounds):
        if not offers.head(1):
            return _labels(known, keys).drop("region")
        active = offers.select(*keys, "region").distinct()
        labels = _merged(known).join(active, [*keys, "region"], "left_semi").withColumn("offer", F.lit(False)).unionByName(offers.withColumn("offer", F.lit(True)))
        mine = inner.join(active, [*keys, "region"], "left_semi")
        found = mine.groupBy(*keys, "region").cogroup(labels.groupBy(*keys, "region")).applyInArrow(_settle(cutoff), schema)
        found = checkpointed(found)
        known.append(found)
        if len(known) > KEPT_ROUNDS:
            known = [checkpointed(_labels(known, keys))]
        # an offer counts only if it is better than all that its node has had
        made = found.select(*keys, "node", "cost", "target").join(border, [*keys, "node"])
        made = made.select(*keys, F.col("_across").alias("region"), F.col("_from").alias("node"), (F.col("cost") + F.col("weight")).alias("cost"), "target", F.col("node").alias("next_node"))
        if cutoff is not None:
            made = made.where(F.col("cost") <= cutoff)
        made = made.groupBy(*keys, "region", "node").agg(best).select(*keys, "region", "node", "_best.*")
        o, k = made.alias("o"), _merged(known).alias("k")
        same = F.col("o.node") == F.col("k.node")
        for c in keys:
            same = same & (F.col(f"o.{c}") == F.col(f"k.{c}"))
        had = F.struct(F.col("k.cost"), F.col("k.target")) <= F.struct(F.col("o.cost"), F.col("o.target"))
        offers = checkpointed(o.join(k, same & had, "left_anti").select(*keys, "region", "node", *label))
    raise RuntimeError("shortest paths did not settle")


def _labels(known: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """The least label of each node; an improvement is always strictly less than what was there."""
    rows = _merged(known).groupBy(*keys, "region", "node").agg(F.min(F.struct("cost", "target", "next_node")).alias("_best"))
    return rows.select(*keys, "region", "node", "_best.*")
