"""Public transport: timetable tables to stop-to-stop edges, summaries, and travel-time profiles over a day.

Profiles come from the scan of ``profiles``; here they become statistics over departure slots.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geometry as g
from waymark.functions import text, times
from waymark.operators.relational import groups_with_hit
from waymark.operators.spatial import dealt, nearest, within_distance
from waymark.session import checkpointed

#: Route types with their modes, operators that count, and the seconds that replace a bus ride of none.
ROUTE_MODES = {"2": "train", "3": "bus", "4": "ferry"}
OPERATORS = ("Arriva", "NS", "Qbuzz", "Wagenborg Passagiersdiensten", "Rederij Doeksen")
BUS_ZERO_SECONDS = 30


def routes(routes_raw: DataFrame, agency: DataFrame, operators: Sequence[str] = OPERATORS) -> DataFrame:
    """Routes of the known types and operators, with mode, operator and line id (short name, else the route's id)."""
    kind = F.col("route_type").try_cast("int").cast("string")
    table = F.create_map(*[F.lit(x) for p in ROUTE_MODES.items() for x in p])
    names = agency.select(F.col("agency_id").alias("_agency"), "agency_name")
    named = routes_raw.join(names, F.col("agency_id") == F.col("_agency"), "left").drop("_agency")
    out = named.withColumn("mode", F.try_element_at(table, kind)).withColumn("operator", F.coalesce("agency_name", "agency_id")).withColumn("line_id", text.first_filled(F.col("route_short_name"), F.col("route_id")))
    return out.where(F.col("mode").isNotNull() & F.col("operator").isin(*operators))


def trips(trips_raw: DataFrame, routes_df: DataFrame) -> DataFrame:
    """Trips of the kept routes."""
    return trips_raw.join(routes_df.select("route_id", "mode", "operator", "line_id", "route_long_name"), "route_id")


def stops_with_official(stops: DataFrame, official: DataFrame, radius: float = 250.0) -> DataFrame:
    """Stops (stop_id, x, y) with the nearest official stop (halte_id, rx, ry) within ``radius``, if any; ``in_regio`` tells."""
    near = nearest(stops.select("stop_id", "x", "y"), official, radius, "stop_id", "halte_id", out="afstand_halte_m")
    found = near.drop("x", "y", "rx", "ry").withColumnRenamed("stop_id", "_stop")
    return stops.join(found, F.col("stop_id") == F.col("_stop"), "left").drop("_stop").withColumn("in_regio", F.col("halte_id").isNotNull())


def stop_times(raw: DataFrame, trips_df: DataFrame, stops_df: DataFrame) -> DataFrame:
    """Stop times with seconds, trip and stop attributes, for all stops of the trips that touch the region."""
    rows = raw.withColumn("stop_sequence", F.col("stop_sequence").try_cast("bigint")).withColumn("arrival_seconds", times.seconds_of(F.col("arrival_time"))).withColumn("departure_seconds", times.seconds_of(F.col("departure_time")))
    full = rows.join(trips_df, "trip_id").join(stops_df, "stop_id", "left")
    return groups_with_hit(full, "trip_id", F.coalesce(F.col("in_regio"), F.lit(False)))


def stop_edges(st: DataFrame, trip: str = "trip_id", order: str = "stop_sequence", departure: str = "departure_seconds", arrival: str = "arrival_seconds", carry: Sequence[str] = ("stop_id",), keep: Sequence[str] = ()) -> DataFrame:
    """Stop-to-stop edges: each row of a trip with the next one. ``carry`` columns come as from_ and to_."""
    line = Window.partitionBy(trip).orderBy(order)
    nxt = [F.lead(c).over(line).alias(f"to_{c}") for c in (*carry, arrival)]
    rows = st.select(trip, order, *keep, F.col(departure).alias(f"from_{departure}"), *[F.col(c).alias(f"from_{c}") for c in carry], *nxt, F.lead(F.lit(1)).over(line).alias("_more"))
    return rows.where("_more = 1").drop("_more").withColumn("seconds", F.col(f"to_{arrival}") - F.col(f"from_{departure}"))


def regional_edges(edges: DataFrame, from_flag: str, to_flag: str, both: bool = False) -> DataFrame:
    """Edges with either (or both) ends in the region."""
    a, b = F.coalesce(F.col(from_flag), F.lit(False)), F.coalesce(F.col(to_flag), F.lit(False))
    return edges.where(a & b if both else a | b)


def corrected_edges(edges: DataFrame, seconds: str = "seconds", mode: str = "mode") -> DataFrame:
    """Bus rides of no time last half a minute; the original time, the difference and both in minutes stay visible."""
    fixed = F.when((F.col(mode) == "bus") & (F.col(seconds) == 0), F.lit(BUS_ZERO_SECONDS)).otherwise(F.col(seconds))
    return edges.withColumn("original_seconds", F.col(seconds)).withColumn(seconds, fixed.cast("bigint")).withColumn("delta_seconds", F.col(seconds) - F.col("original_seconds")).withColumn("travel_time_min", F.col(seconds) / 60.0)


def manual_times(edges: DataFrame, corrections: Sequence[dict], minutes: str = "travel_time_min") -> DataFrame:
    """Minutes set by hand between two stops of an operator's lines, in either direction; the last correction that fits counts.

    A correction has operator, line_ids, halte_a, halte_b (parts of stop names, compared by their plain words), travel_time_min and reden.
    Adds ``travel_time_source`` (manual_correction, else as it was or null) and ``travel_time_correction_note``.
    """
    a, b = text.simple_words(F.col("stop_name")), text.simple_words(F.col("next_stop_name"))
    time, source, note = F.col(minutes), F.col("travel_time_source") if "travel_time_source" in edges.columns else F.lit(None).cast("string"), F.lit(None).cast("string")
    for c in corrections:
        one, other = text.simple_words(F.lit(c["halte_a"])), text.simple_words(F.lit(c["halte_b"]))
        between = (a.contains(one) & b.contains(other)) | (a.contains(other) & b.contains(one))
        fits = F.coalesce((F.col("operator") == c["operator"]) & F.col("line_id").cast("string").isin(*c["line_ids"]) & between, F.lit(False))
        time, source, note = F.when(fits, float(c["travel_time_min"])).otherwise(time), F.when(fits, "manual_correction").otherwise(source), F.when(fits, c["reden"]).otherwise(note)
    return edges.withColumns({minutes: time, "travel_time_source": source, "travel_time_correction_note": note})


def edge_distance(edges: DataFrame) -> DataFrame:
    """Straight-line metres between from and to coordinates, and an edge id."""
    return edges.withColumn("distance_m", g.haversine(F.col("from_stop_lat"), F.col("from_stop_lon"), F.col("to_stop_lat"), F.col("to_stop_lon"))).withColumn("edge_id", F.concat_ws("_", "trip_id", "stop_sequence", "from_stop_id", "to_stop_id"))


def segment_summary(edges: DataFrame, keys: Sequence[str], minutes: str = "travel_time_min", trip: str = "trip_id", names: Column | None = None) -> DataFrame:
    """Trips, least, most, median and mean minutes per segment, and the set of names; null keys form groups too."""
    return edges.groupBy(*keys).agg(F.count_distinct(trip).alias("trips"), F.min(minutes).alias("min_min"), F.max(minutes).alias("max_min"), F.median(minutes).alias("median_min"), F.avg(minutes).alias("mean_min"), text.text_set(names if names is not None else F.col(keys[0])).alias("names"))


def trip_totals(st: DataFrame, edges: DataFrame, trip: str = "trip_id", order: str = "stop_sequence") -> DataFrame:
    """First and last stop, stops and seconds of each trip, with the corrections of its edges added."""
    base = st.groupBy(trip).agg(F.min_by("stop_id", order).alias("first_stop_id"), F.max_by("stop_id", order).alias("last_stop_id"), F.count("*").alias("stops"), F.min_by("departure_seconds", order).alias("start_seconds"), F.max_by("arrival_seconds", order).alias("end_seconds"))
    fixes = edges.where("delta_seconds <> 0").groupBy(trip).agg(F.sum("delta_seconds").alias("correction_seconds"))
    both = base.join(fixes, trip, "left")
    total = F.col("end_seconds") - F.col("start_seconds")
    return both.withColumn("correction_seconds", F.coalesce("correction_seconds", F.lit(0).cast("bigint"))).withColumn("total_seconds", total + F.col("correction_seconds"))


def time_quality(df: DataFrame, seconds: str, original: str | None = None) -> DataFrame:
    """Counts of null, negative, zero and corrected times with least, most and median."""
    c = F.col(seconds)
    changed = F.count_if(F.coalesce(c != F.col(original), F.lit(True))) if original else F.lit(0).cast("bigint")
    return df.agg(F.count("*").alias("rows"), F.count_if(c.isNull()).alias("nulls"), F.count_if(c < 0).alias("negative"), F.count_if(c == 0).alias("zero"), changed.alias("corrected"), times.clock(F.min(c)).alias("least"), times.clock(F.max(c)).alias("most"), F.median(c).alias("median_seconds"))


def connections(edges: DataFrame, services: DataFrame | None, nodes: DataFrame, start: int, end: int) -> DataFrame:
    """Rides of a day (dep, arr, src, dst): running services, inside the window, forward in time, between known stops.

    ``edges`` has service_id, from_stop_id, to_stop_id and departure and arrival seconds; ``nodes`` maps stop_id to node.
    """
    rows = edges.where(F.col("departure").between(start, end) & (F.col("arrival") > F.col("departure")))
    if services is not None:
        rows = rows.join(services, "service_id", "left_semi")
    a = nodes.select(F.col("stop_id").alias("_a"), F.col("node").alias("src"))
    b = nodes.select(F.col("stop_id").alias("_b"), F.col("node").alias("dst"))
    return rows.join(a, F.col("from_stop_id") == F.col("_a")).join(b, F.col("to_stop_id") == F.col("_b")).select(F.col("departure").alias("dep"), F.col("arrival").alias("arr"), "src", "dst").distinct()


def stop_nodes(stops: DataFrame, node: str = "node_id", ids: str = "stop_ids") -> DataFrame:
    """stop_id to node from a node's list of stop ids; of a repeated stop id the last node counts, in the order of the table's rows."""
    each = stops.withColumn("_row", F.monotonically_increasing_id()).select(F.col(node).alias("node"), "_row", F.posexplode(F.split(F.col(ids), ",")).alias("_pos", "_id"))
    named = each.select(F.trim("_id").alias("stop_id"), "node", F.struct("_row", "_pos").alias("_at")).where("stop_id <> ''")
    return named.groupBy("stop_id").agg(F.max_by("node", "_at").alias("node"))


def transfers(stops: DataFrame, radius: float = 250.0, speed: float = 80.0) -> DataFrame:
    """Walks between different stops (node, x, y) within ``radius``: (src, dst, minutes)."""
    other = stops.select(F.col("node").alias("dst"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    pairs = within_distance(stops.select(F.col("node").alias("src"), "x", "y"), other, radius)
    return pairs.where("src <> dst").select("src", "dst", (F.col("afstand_m") / speed).alias("minutes"))


PROFILE = "key bigint, node bigint, sec bigint, minutes double, target bigint"


def slot_profiles(profile: DataFrame, start: int, end: int, step_min: int = 15) -> DataFrame:
    """Statistics per stop over departure slots: each slot takes the first event at or after it, wait included.

    Slots without a later event don't count. Returns key, node, mediaan, min, p90, aantal and the most frequent target.
    """
    step = step_min * 60
    # an event serves the slots after the event before it and up to itself
    before = F.lag("sec").over(Window.partitionBy("key", "node").orderBy("sec"))
    first = F.greatest(F.lit(start), F.lit(start) + F.ceil((F.coalesce(before + 1, F.lit(start)) - start) / step) * step)
    last = F.least(F.lit(end), F.lit(start) + F.floor((F.col("sec") - start) / step) * step)
    each = profile.withColumn("_first", first).withColumn("_last", last).where("_first <= _last and sec >= " + str(start))
    slots = each.withColumn("slot", F.explode(F.sequence(F.col("_first"), F.col("_last"), F.lit(step)))).withColumn("total", (F.col("sec") - F.col("slot")) / 60.0 + F.col("minutes"))
    return slots.groupBy("key", "node").agg(F.median("total").alias("mediaan"), F.min("total").alias("min"), F.percentile("total", 0.9).alias("p90"), F.count("*").alias("aantal"), F.mode("target", True).alias("target"))


def shapes(points: DataFrame) -> DataFrame:
    """Lines of ordered shape points (shape_id, line), two points at least."""
    p = F.struct(F.col("shape_pt_sequence").try_cast("bigint").alias("seq"), F.col("shape_pt_lon").try_cast("double").alias("x"), F.col("shape_pt_lat").try_cast("double").alias("y"))
    rows = points.groupBy("shape_id").agg(F.array_sort(F.collect_list(p)).alias("_p"))
    return rows.where(F.size("_p") >= 2).select("shape_id", F.transform("_p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("line"))


def lookup(df: DataFrame, from_col: str, to_col: str | None, from_text: str, to_text: str | None = None, equal: dict[str, str] | None = None, order: Sequence[str] = (), most: int = 30) -> DataFrame:
    """Interactive search: names that contain the texts in any case, equal line or mode, first ``most`` rows in order."""
    rows = df.where(F.lower(from_col).contains(from_text.lower()))
    if to_col and to_text:
        rows = rows.where(F.lower(to_col).contains(to_text.lower()))
    for c, v in (equal or {}).items():
        rows = rows.where(F.col(c) == v)
    return rows.orderBy(*order).limit(most) if order else rows.limit(most)


def stop_pairs(edges: DataFrame, line: str | None = None) -> DataFrame:
    """The least minutes between two known stop nodes, with the quickest ride's geometry if there is one.

    ``edges`` has src, dst and minutes; pairs without nodes, without minutes or with none above zero drop out.
    """
    usable = edges.where("src is not null and dst is not null and minutes is not null and minutes > 0")
    # pairs are nearly as many as edges: dealt out over all partitions, none merged, so a task's hash table stays small
    usable = dealt(usable, F.col("src"), F.col("dst"))
    if line is None:
        return usable.groupBy("src", "dst").agg(F.min("minutes").alias("minutes"))
    best = usable.where(F.col(line).isNotNull()).groupBy("src", "dst").agg(F.min_by(line, F.struct("minutes", line)).alias(line))
    return usable.groupBy("src", "dst").agg(F.min("minutes").alias("minutes")).join(best, ["src", "dst"], "left")


def static_minutes(pairs: DataFrame, walks: DataFrame, egress: DataFrame) -> DataFrame:
    """Least minutes from each stop to a target with at least one ride, by the quickest ride of each pair: (node, minutes, target)."""
    from waymark.operators.network import shortest_paths

    # behind the first ride the search goes over stops, with rides and walks alike; the ride itself is one step from its result
    pairs = checkpointed(pairs.select("src", "dst", F.col("minutes").alias("weight")))
    behind = shortest_paths(pairs.unionByName(walks.select("src", "dst", F.col("minutes").alias("weight"))), egress.select("node", F.col("minutes").alias("cost"), "target"))
    first = pairs.join(behind.select("node", "cost", "target"), F.col("dst") == F.col("node")).groupBy("src").agg(F.min(F.struct((F.col("cost") + F.col("weight")).alias("minutes"), "target")).alias("_best"))
    return first.select(F.col("src").alias("node"), "_best.minutes", "_best.target")
