"""Departure profiles of a day's timetable, and the journeys behind them.

A reverse connection scan, dealt out: the day is cut into slices of time, each with about as many rides, and read from the last slice to
the first. Labels, the best minutes from a departure of a stop, are handed on from slice to slice; a ride meets those of later slices in an
as-of join, for all target sets at once. What rides of one slice need of each other is scanned in one task for each target set and region of
stops, and regions exchange labels until none changes. No task or broadcast holds the whole day.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators.relational import asof_forward
from waymark.session import checkpointed, ensure_checkpoint_dir, ship_package, written

RIDE = ("dep", "arr", "src", "dst")
#: A slice has the rides of so many full tasks at most: longer ones have fewer jobs, but rides cross more regions in each.
SLICE_REGIONS = 8
#: A departure, its best minutes and target; the ride taken there (null: wait for a later one), and the departure after it (null: walk to the target).
EVENTS = "key bigint, node bigint, sec bigint, minutes double, target bigint, ride_dst bigint, ride_arr bigint, next_node bigint, next_sec bigint"


def stop_regions(stops: DataFrame, size: float = 10_000.0) -> DataFrame:
    """A region for each stop (node, x, y): the square of ``size`` metres that it lies in."""
    return stops.select("node", F.xxhash64(F.floor(F.col("x") / size), F.floor(F.col("y") / size)).alias("region"))


def _scan(key: tuple, rides: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """The departures of one region, slice and target set at which a ride is boarded, as nothing later from their stop is as quick.

    ``rides`` has the best option that later slices or the target itself leave (rest, target, and if it is a departure, next_node and next_sec), and ``vias`` and
    ``readies``, the places at which departures of this slice may follow. ``known`` has those of other regions, and with ``head`` the first of each own stop in later slices.
    """
    lines: dict[int, tuple[list[int], list[tuple]]] = {}  # by falling time: its negative, and the departure
    heads: dict[int, tuple] = {}
    known = known.sort_values("sec", ascending=False)
    for node, sec, minutes, target, head in zip(*[known[c].tolist() for c in ("node", "sec", "minutes", "target", "head")], strict=True):
        if head:
            heads[node] = (sec, minutes, target)
        else:
            times, line = lines.setdefault(node, ([], []))
            times.append(-sec)
            line.append((sec, minutes, target))
    own: set[int] = set()
    rides = rides.sort_values(list(RIDE), ascending=[False, False, True, True])
    columns = [rides[c].tolist() for c in (*RIDE, "rest", "target", "later", "next_node", "next_sec", "vias", "readies")]
    for dep, arr, src, dst, rest, target, later, next_node, next_sec, vias, readies in zip(*columns, strict=True):
        best = None if rest is None or rest != rest else (rest, target, *((next_node, next_sec) if later else (None, None)))
        for via, ready in zip(vias.tolist(), readies.tolist(), strict=True) if vias is not None else ():
            if (found := lines.get(via)) is not None and (at := bisect_right(found[0], -ready)):
                there = found[1][at - 1]
                option = ((there[0] - arr) / 60 + there[1], there[2], via, there[0])
                if best is None or option[:2] < best[:2]:
                    best = option
        if best is None:
            continue
        event = (dep, (arr - dep) / 60 + best[0], best[1], dst, arr, best[2], best[3])
        if src not in own:
            own.add(src)
            lines[src] = ([], [])
        times, line = lines[src]
        after = line[-1] if line else heads.get(src)
        if after is not None and (after[0] - dep) / 60 + after[1] <= event[1]:
            continue
        if line and after[0] == dep:
            line[-1] = event
        else:
            times.append(-dep)
            line.append(event)
    out = list(zip(*[(key[0], node, *e) for node in own for e in lines[node][1]], strict=True))
    names = [f.split()[0] for f in EVENTS.split(", ")]
    return pd.DataFrame({n: pd.array(out[i] if out else [], dtype="float64" if n == "minutes" else "Int64") for i, n in enumerate(names)})


def _undominated(rides: DataFrame) -> DataFrame:
    """Rides without one between the same stops that leaves later and is there no later; waiting for that one is as quick as to take the others."""
    later = Window.partitionBy("src", "dst").orderBy(F.col("dep").desc()).rangeBetween(Window.unboundedPreceding, -1)
    return rides.withColumn("_arr", F.min("arr").over(later)).where("_arr is null or arr < _arr").drop("_arr")


def _with_waits(found: DataFrame, rides: DataFrame, walks: DataFrame, goal: DataFrame, least: int) -> DataFrame:
    """``found`` and all other departures of ``rides`` from which a target is reached, each of which waits for its stop's next one in ``found``."""
    last = found.groupBy("key", "node").agg(F.max("sec").alias("sec"))
    # how late a ride to a stop may be there to lead on
    reach = goal.select("key", "node", F.lit((1 << 63) - 1).alias("sec")).unionByName(last)
    reach = reach.unionByName(last.join(walks, F.col("node") == F.col("via")).select("key", F.col("_from").alias("node"), (F.col("sec") - F.bround(F.col("minutes") * 60).cast("bigint") - least).alias("sec")))
    reach = reach.groupBy("key", F.col("node").alias("_goal")).agg(F.max("sec").alias("_last"))
    every = rides.join(reach, (F.col("dst") == F.col("_goal")) & (F.col("arr") <= F.col("_last"))).select("key", F.col("src").alias("node"), F.col("dep").alias("sec")).distinct()
    names = [f.split()[0] for f in EVENTS.split(", ")]
    full = every.join(found.withColumn("_own", F.lit(True)), ["key", "node", "sec"], "left")
    line = Window.partitionBy("key", "node").orderBy(F.col("sec").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = full.withColumn("_b", F.last(F.when(F.col("_own"), F.struct("sec", "minutes", "target")), ignorenulls=True).over(line))
    wait = {"minutes": (F.col("_b.sec") - F.col("sec")) / 60 + F.col("_b.minutes"), "target": F.col("_b.target"), "next_node": F.col("node"), "next_sec": F.col("_b.sec")}
    return full.select(*[F.when(F.col("_own"), F.col(n)).otherwise(wait[n]).alias(n) if n in wait else F.col(n) for n in names])


def _by_slice(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table whose slices are read one by one."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}.parquet"
    df.repartition("slice", "region").write.partitionBy("slice").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _slices(rides: DataFrame, slice_rides: int) -> list[int]:
    """Times that cut the day into slices of about ``slice_rides`` rides of the largest region, and ``SLICE_REGIONS`` times as many of all."""
    sizes = rides.groupBy("region").agg(F.count("*").alias("n")).agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
    count = max(-(-(sizes["most"] or 0) // slice_rides), -(-(sizes["all"] or 0) // (slice_rides * SLICE_REGIONS)))
    if count <= 1:
        return []
    cuts = rides.approxQuantile("dep", [k / count for k in range(1, count)], 0.25 / count)
    return sorted({int(c) for c in cuts})


def _options(own: DataFrame, hops: DataFrame, goal: DataFrame, labels: DataFrame | None, until: int | None) -> DataFrame:
    """The best that a slice's rides find outside of it: (key, RIDE, rest, target, next_node, next_sec)."""
    none = F.lit(None).cast("bigint")
    found = own.join(goal.withColumnRenamed("node", "_goal"), F.col("dst") == F.col("_goal")).select("key", *RIDE, F.col("minutes").alias("rest"), "target", none.alias("next_node"), none.alias("next_sec"))
    if labels is not None:
        stops = labels.select("key", F.col("node").alias("_node")).distinct()
        keyed = hops.join(stops, F.col("via") == F.col("_node")).select(F.struct("key", "via").alias("_at"), *RIDE, F.greatest("ready", F.lit(until)).alias("ready"))
        after = asof_forward(keyed, labels.select(F.struct("key", F.col("node").alias("via")).alias("_at"), "sec", "minutes", "target"), "_at", "ready", "sec", ["minutes", "target"])
        later = after.where("sec is not null").select("_at.key", *RIDE, ((F.col("sec") - F.col("arr")) / 60 + F.col("minutes")).alias("rest"), "target", F.col("_at.via").alias("next_node"), F.col("sec").alias("next_sec"))
        found = found.unionByName(later)
    return found.groupBy("key", *RIDE).agg(F.min(F.struct("rest", "target", "next_node", "next_sec")).alias("_b")).select("key", *RIDE, "_b.*")


def departure_profiles(rides: DataFrame, walks: DataFrame, egress: DataFrame, min_transfer_min: float = 3.0, regions: DataFrame | None = None, slice_rides: int = 100_000) -> DataFrame:
    """Minutes to the nearest target from every departure (key, node, sec) at which a ride is boarded: EVENTS rows.

    ``rides`` (dep, arr, src, dst) lead forward in time, ``walks`` (src, dst, minutes) between stops, ``egress`` (key, node, minutes, target) from stops to targets; a
    key is a set of targets, of which there are as many as facilities in a run. Staying at a stop costs the wait, changing to another one also the walk and the least
    transfer time. ``regions`` (node, region) deals the stops to tasks; a slice has about ``slice_rides`` rides of the largest region,
    which is one task for each key. A ride that another one of the same two stops makes needless isn't scanned: its departure waits, as do all at which a later one is as quick, for the next that is boarded.
    Rides without a way to a target have no row; null times and stops don't count; of equal minutes the smaller target wins within a ride.
    """
    spark = rides.sparkSession
    ship_package(spark)
    least = int(round(min_transfer_min * 60))
    goal = checkpointed(egress.where("node is not null and minutes is not null").groupBy("key", "node").agg(F.min(F.struct("minutes", "target")).alias("_b")).select("key", "node", "_b.minutes", "_b.target"))
    keys = sorted(int(r["key"]) for r in goal.select("key").distinct().collect())
    if not keys:
        return spark.createDataFrame([], EVENTS)
    # of the rides of one departure between two stops the quickest: who is there first can wait for all that the others reach
    rides = rides.select(*[F.col(c).cast("bigint").alias(c) for c in RIDE]).where("arr > dep and src is not null and dst is not null")
    rides = checkpointed(rides.groupBy("dep", "src", "dst").agg(F.min("arr").alias("arr")).select(*RIDE))
    day = _undominated(rides)
    if regions is None:
        day = day.withColumn("region", F.lit(0).cast("bigint"))
    else:
        where = regions.select(F.col("node").alias("_node"), F.col("region").cast("bigint").alias("region")).dropDuplicates(["_node"])
        day = day.join(where, F.col("src") == F.col("_node"), "left").drop("_node").withColumn("region", F.coalesce("region", F.lit(0).cast("bigint")))
    day = checkpointed(day)
    cuts = _slices(day, slice_rides)
    bounds = F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>")
    day = _by_slice(day.withColumn("slice", F.size(F.filter(bounds, lambda b: b <= F.col("dep")))), "rides")
    stops = checkpointed(day.select(F.col("src").alias("_stop"), F.col("region").alias("_home")).distinct())
    there = walks.select(F.col("src").alias("_from"), F.col("dst").cast("bigint").alias("via"), "minutes")
    stay = day.select("slice", "region", *RIDE, F.col("dst").alias("via"), F.col("arr").alias("ready"))
    change = day.join(there, F.col("dst") == F.col("_from")).select("slice", "region", *RIDE, "via", (F.col("arr") + F.bround(F.col("minutes") * 60).cast("bigint") + least).alias("ready"))
    # only stops that a ride leaves can be gone on from; whose region it is tells what regions exchange
    hops = _by_slice(stay.unionByName(change).join(stops, F.col("via") == F.col("_stop")).drop("_stop"), "hops")
    # one row for each slice: how late its rides look for a departure
    latest = {int(r["slice"]): int(r["t"]) for r in hops.groupBy("slice").agg(F.max("ready").alias("t")).collect()}
    out: DataFrame | None = None
    labels: DataFrame | None = None
    for k in range(len(cuts), -1, -1):
        until = cuts[k] if k < len(cuts) else None
        own, mine = day.where(F.col("slice") == k), hops.where(F.col("slice") == k)
        inner = mine if until is None else mine.where(F.col("ready") < until)
        onward = inner.groupBy(*RIDE).agg(F.collect_list(F.struct("via", "ready")).alias("_on")).select(*RIDE, F.col("_on.via").alias("vias"), F.col("_on.ready").alias("readies"))
        best = _options(own, mine, goal, labels, until)
        every = own.withColumn("key", F.explode(F.array(*[F.lit(x).cast("bigint") for x in keys])))
        rows = every.join(onward, list(RIDE), "left").join(best, ["key", *RIDE], "left").where("rest is not null or vias is not null")
        known_ids = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("target", "next_node", "next_sec")]
        rows = checkpointed(rows.select("key", "region", *RIDE, "rest", F.col("next_sec").isNotNull().alias("later"), *known_ids, "vias", "readies"))
        empty = spark.createDataFrame([], "key bigint, region bigint, node bigint, sec bigint, minutes double, target bigint, head boolean")
        heads = empty
        if labels is not None:
            first = labels.groupBy("key", "node").agg(F.min(F.struct("sec", "minutes", "target")).alias("_h"))
            heads = checkpointed(first.join(stops, F.col("node") == F.col("_stop")).select("key", F.col("_home").alias("region"), "node", "_h.*", F.lit(True).alias("head")))
        asked = checkpointed(inner.where("region <> _home").select(F.col("region").alias("_asks"), F.col("via").alias("_via")).distinct())
        crossing = bool(asked.head(1))
        foreign, told = empty, None
        while True:
            found = rows.groupBy("key", "region").cogroup(heads.unionByName(foreign).groupBy("key", "region")).applyInPandas(_scan, EVENTS)
            found = written(found, f"departures-{k}")
            if not crossing:
                break
            foreign = checkpointed(found.join(asked, F.col("node") == F.col("_via")).select("key", F.col("_asks").alias("region"), "node", "sec", "minutes", "target", F.lit(False).alias("head")))
            now = tuple(foreign.agg(F.count("*"), F.sum(F.xxhash64("key", "region", "node", "sec", "minutes", "target").cast("decimal(38,0)"))).first())
            if now == told or not now[0]:
                break
            told = now
        out = found if out is None else out.unionByName(found)
        if k:
            # earlier slices look no later than this: of what lies behind it, each stop's first departure is enough
            horizon = max((t for s, t in latest.items() if s < k), default=0)
            known = found.select("key", "node", "sec", "minutes", "target")
            known = known if labels is None else labels.unionByName(known)
            far = known.where(F.col("sec") > horizon).groupBy("key", "node").agg(F.min(F.struct("sec", "minutes", "target")).alias("_f")).select("key", "node", "_f.*")
            labels = checkpointed(known.where(F.col("sec") <= horizon).unionByName(far))
    return written(_with_waits(out, rides, there, goal, least), "profiles")


def followed(starts: DataFrame, pointers: DataFrame, at: Sequence[str], to: Sequence[str], most: int = 1 << 20) -> DataFrame:
    """All places on the way of each start: (id, step, ``at``), step 0 at its own place.

    ``pointers`` has a row for each place that leads on, from ``at`` to ``to``. Jumps double in every round, so a way of n places takes about log2(n) rounds.
    """
    names = [f"_j{i}" for i in range(len(at))]
    jump = checkpointed(pointers.where(" and ".join(f"{c} is not null" for c in to)).select(*[F.col(c).alias(n) for c, n in zip(at, names, strict=True)], *[F.col(c).alias(f"{n}_to") for c, n in zip(to, names, strict=True)]))
    ways = checkpointed(starts.select("id", F.lit(0).cast("bigint").alias("step"), *at))
    stride = 1
    while stride <= most:
        on = [F.col(c) == F.col(n) for c, n in zip(at, names, strict=True)]
        more = checkpointed(ways.join(jump, on).select("id", (F.col("step") + stride).alias("step"), *[F.col(f"{n}_to").alias(c) for c, n in zip(at, names, strict=True)]))
        if not more.head(1):
            return ways
        ways = ways.unionByName(more)
        second = jump.select(*[F.col(n).alias(f"{n}_to") for n in names], *[F.col(f"{n}_to").alias(f"{n}_on") for n in names])
        jump = checkpointed(jump.join(second, [f"{n}_to" for n in names]).select(*names, *[F.col(f"{n}_on").alias(f"{n}_to") for n in names]))
        stride *= 2
    raise RuntimeError("a way leads in a circle or is too long")


def journeys(starts: DataFrame, events: DataFrame) -> DataFrame:
    """The legs of each start (id, key, node, sec) from a stop at a time to its target: (id, leg, kind, from_node, to_node, start_sec, minutes).

    ``events`` comes from ``departure_profiles``. Kinds are wacht (at a stop), rit, overstap (the walk to another stop and the wait there) and
    lopen, from the last stop to the target, whose id is then ``to_node``. Minutes add up to the wait for the first departure and its profile minutes.
    Starts without a later departure have no legs.
    """
    line = starts.select("id", "key", "node", F.col("sec").alias("ready"), F.struct("key", "node").alias("_at"))
    first = asof_forward(line, events.select(F.struct("key", "node").alias("_at"), "sec"), "_at", "ready", "sec", []).where("sec is not null").drop("_at")
    first = checkpointed(first)
    way = followed(first, events, ["key", "node", "sec"], ["key", "next_node", "next_sec"])
    full = way.join(events, ["key", "node", "sec"])

    def leg(kind, a, b, start, minutes):
        return F.struct(F.lit(kind).alias("kind"), a.cast("bigint").alias("from_node"), b.cast("bigint").alias("to_node"), start.cast("bigint").alias("start_sec"), minutes.cast("double").alias("minutes"))

    c = F.col
    rode = c("ride_dst").isNotNull()
    gap = (c("next_sec") - c("ride_arr")) / 60
    parts = F.array(
        F.when(rode, leg("rit", c("node"), c("ride_dst"), c("sec"), (c("ride_arr") - c("sec")) / 60)),
        F.when(~rode, leg("wacht", c("node"), c("node"), c("sec"), (c("next_sec") - c("sec")) / 60)),
        F.when(rode & c("next_node").isNull(), leg("lopen", c("ride_dst"), c("target"), c("ride_arr"), c("minutes") - (c("ride_arr") - c("sec")) / 60)),
        F.when(rode & (c("next_node") != c("ride_dst")), leg("overstap", c("ride_dst"), c("next_node"), c("ride_arr"), gap)),
        F.when(rode & (c("next_node") == c("ride_dst")) & (gap > 0), leg("wacht", c("ride_dst"), c("ride_dst"), c("ride_arr"), gap)),
    )
    legs = full.select("id", c("step").alias("_step"), F.posexplode(F.filter(parts, lambda p: p.isNotNull())).alias("_part", "_leg"))
    waits = first.where("sec > ready").select("id", F.lit(-1).cast("bigint").alias("_step"), F.lit(0).alias("_part"), leg("wacht", c("node"), c("node"), c("ready"), (c("sec") - c("ready")) / 60).alias("_leg"))
    ranked = legs.unionByName(waits).select("id", (c("_step") * 8 + c("_part")).alias("_order"), "_leg.*")
    return ranked.withColumn("leg", F.row_number().over(Window.partitionBy("id").orderBy("_order"))).select("id", "leg", "kind", "from_node", "to_node", "start_sec", "minutes")
