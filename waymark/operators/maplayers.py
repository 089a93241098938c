"""Map layers of a timetable network and of flows: geometry by priority, stop points, tooltips, segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import classes, text
from waymark.functions import geometry as g
from waymark.operators.relational import first_per_key

#: Fixed value: metres between a stop and a line for the line to count.
LINE_DISTANCE = 250.0


def between(line: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """struct(line, from_m, to_m, score) of the stretch of a line between two points, in their order; score is the sum of distances."""
    a, b = g.project(ax, ay, line), g.project(bx, by, line)
    return F.struct(g.substring(line, a["position"], b["position"]).alias("line"), a["distance"].alias("from_m"), b["distance"].alias("to_m"), (a["distance"] + b["distance"]).alias("score"))


def line_candidates(connections: DataFrame, lines: DataFrame, id_col: str = "connection_id", most_m: float = LINE_DISTANCE) -> DataFrame:
    """The best official line for each connection: (id, fid, line, score).

    ``connections`` has mode, line_id, operator, route_text, ax, ay, bx, by; ``lines`` fid, mode, line_id, operator, route_name, line.
    Lines are of the same mode; those with the same number go before others, then those whose operator's name holds the other's.
    Without a number a word of the route's name has to occur in the connection's text. Both ends lie within ``most_m``.
    """
    c = connections.select(id_col, "ax", "ay", "bx", "by", F.col("mode").alias("_mode"), text.line_number(F.col("line_id")).alias("_number"), text.simple_words(F.col("operator")).alias("_operator"), text.simple_words(F.col("route_text")).alias("_text"))
    x = lines.select("fid", "mode", text.line_number(F.col("line_id")).alias("number"), text.simple_words(F.col("operator")).alias("operator"), text.simple_words(F.col("route_name")).alias("route"), "line")
    pairs = c.join(x, F.col("_mode") == F.col("mode"))
    same_number = F.col("_number") == F.col("number")
    same_operator = (F.col("_operator") != "") & (F.col("_operator").contains(F.col("operator")) | F.col("operator").contains(F.col("_operator")))
    words = F.filter(F.split("route", " "), lambda w: F.length(w) >= 4)
    named = (F.col("_number") != "") | (F.size(words) == 0) | F.exists(words, lambda w: F.col("_text").contains(w))
    cut = pairs.where(named).withColumn("_cut", between(F.col("line"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))).where((F.col("_cut.from_m") <= most_m) & (F.col("_cut.to_m") <= most_m))
    best = first_per_key(cut.withColumn("_n", same_number).withColumn("_o", same_operator), [id_col], [F.col("_n").desc(), F.col("_o").desc(), F.col("_cut.score"), F.col("fid")])
    return best.select(id_col, "fid", F.col("_cut.line").alias("line"), F.col("_cut.score").alias("score"))


def chosen_geometry(df: DataFrame, shape: str, official: str, stops: str) -> DataFrame:
    """The line of a connection: along the timetable's shape, else the official line, else straight between stops; and which it is."""
    line = F.coalesce(shape, official, stops)
    source = F.when(F.col(shape).isNotNull(), "shape").when(F.col(official).isNotNull(), "ov_lijn").when(F.col(stops).isNotNull(), "haltes")
    return df.withColumn("line", line).withColumn("geometry_source", source).where("line is not null")


def stop_points(connections: DataFrame) -> DataFrame:
    """Unique stop points of both ends of all connections with their sets of names, modes, operators and lines."""
    ends = None
    for side in ("from", "to"):
        official = text.blank_to_null(F.col(f"{side}_halte_id"))
        has = official.isNotNull() & ~F.lower(official).isin(*text.MISSING_WORDS) & F.col(f"{side}_halte_x").isNotNull() & F.col(f"{side}_halte_y").isNotNull()
        at = g.rd_to_wgs84(F.col(f"{side}_halte_x"), F.col(f"{side}_halte_y"))
        rows = connections.select(
            F.when(has, F.concat(F.lit("ov_halte_"), official)).when(F.col(f"{side}_stop_lon").isNotNull() & F.col(f"{side}_stop_lat").isNotNull(), F.concat(F.lit("gtfs_stop_"), F.col(f"{side}_stop_id"))).alias("node_id"),
            F.col(f"{side}_stop_id").alias("stop_id"),
            F.col(f"{side}_stop_name").alias("stop_name"),
            F.when(has, official).alias("halte_id"),
            F.col(f"{side}_halte_naam").alias("halte_naam"),
            "mode",
            "operator",
            "line_id",
            "route_id",
            F.when(has, at["lon"]).otherwise(F.col(f"{side}_stop_lon")).alias("lon"),
            F.when(has, at["lat"]).otherwise(F.col(f"{side}_stop_lat")).alias("lat"),
            F.when(has, "ov_halte").otherwise("gtfs_stop_coords").alias("geometry_source"),
        )
        ends = rows if ends is None else ends.unionByName(rows)
    first = lambda c: F.min_by(c, F.struct("stop_id", c)).alias(c)
    out = ends.where("node_id is not null").groupBy("node_id").agg(
        text.text_set(F.col("stop_id")).alias("stop_ids"),
        text.text_set(F.col("stop_name")).alias("stop_names"),
        first("halte_id"),
        first("halte_naam"),
        text.text_set(F.col("mode")).alias("modes"),
        text.text_set(F.col("operator")).alias("operators"),
        text.text_set(F.col("line_id")).alias("line_ids"),
        F.count_distinct("line_id").alias("aantal_lijnen"),
        F.count_distinct("route_id").alias("aantal_routes"),
        F.count("route_id").alias("aantal_verbindingen"),
        first("geometry_source"),
        first("lon"),
        first("lat"),
    )
    return out.withColumn("tooltip", tooltip((None, F.coalesce(text.blank_to_null(F.col("halte_naam")), F.col("stop_names"))), ("Lijnen", F.col("line_ids")), ("Modes", F.col("modes"))))


def tooltip(*parts: tuple[str | None, Column]) -> Column:
    """Lines of HTML: label and value, the label left out where it is None; null values as empty."""
    return F.concat_ws("<br>", *[F.concat(F.lit(f"{label}: " if label else ""), F.coalesce(value.cast("string"), F.lit(""))) for label, value in parts])


def connection_tooltip() -> Column:
    c = F.col
    return tooltip((None, F.concat(F.lit("Lijn "), c("line_id"))), ("Richting", c("trip_headsign")), ("Van", c("from_stop_name")), ("Naar", c("to_stop_name")), ("Reistijd verbinding", F.concat(c("total_travel_time_min").cast("string"), F.lit(" min"))), ("Aantal ritten", c("aantal_trips")))


def flow_segments(routes: DataFrame, mode: str) -> DataFrame:
    """Segments of routes (pand_id, segment_type, edge_id or line, area, within, target, target_name), each once per route.

    Counts buildings inside and outside the norm, collects the facilities, and adds class and style by the number of buildings.
    """
    key = F.coalesce(F.col("edge_id").cast("string"), F.to_json("line"), F.lit(""))
    rows = routes.withColumn("_key", key)
    once = first_per_key(rows, ["pand_id", "segment_type", "_key", "area"], [F.col("within").desc_nulls_last()])
    out = once.groupBy("segment_type", "_key", "area").agg(
        F.count("*").alias("aantal_panden"),
        F.count_if(F.coalesce("within", F.lit(False))).alias("aantal_panden_binnen_norm"),
        F.count_distinct("target").alias("voorzieningen_aantal"),
        text.text_set(F.col("target")).alias("voorziening_ids"),
        text.text_set(F.col("target_name")).alias("voorziening_namen"),
        F.min("line").alias("line"),
    )
    style = classes.flow_style(F.col("aantal_panden"))
    return out.withColumn("aantal_panden_buiten_norm", F.col("aantal_panden") - F.col("aantal_panden_binnen_norm")).withColumn("modus", F.lit(mode)).withColumn("flow", style).withColumn("flow_label", F.concat(F.col("aantal_panden").cast("string"), F.lit(" pandroutes over dit segment"))).drop("_key")


def route_lines(steps: DataFrame, ways: DataFrame) -> DataFrame:
    """Geometry of route steps (id, step, src, dst): the way's line, turned where it is driven backward; straight where none is known.

    ``ways`` has u, v, minutes and line; of parallel ones the quickest counts. Adds the segment's length.
    """
    both = ways.select(F.col("u").alias("_s"), F.col("v").alias("_d"), "minutes", "line").unionByName(ways.select(F.col("v").alias("_s"), F.col("u").alias("_d"), "minutes", F.reverse("line").alias("line")))
    best = first_per_key(both, ["_s", "_d"], [F.col("minutes"), F.col("line")])
    rows = steps.join(best, (F.col("src") == F.col("_s")) & (F.col("dst") == F.col("_d")), "left").drop("_s", "_d")
    return rows.withColumn("lengte_meter", g.length(F.col("line")))


def snap_legs(line: Column, position: Column, to_end: bool) -> Column:
    """The part of a way between a snapped place and one of its ends."""
    return g.substring(line, position, g.length(line)) if to_end else g.substring(line, position, F.lit(0.0))


def hub(stops: DataFrame, ids: Sequence[str]) -> DataFrame:
    """The middle of the distinct places of some stops, as one facility."""
    at = stops.where(F.col("stop_id").isin(*ids)).select("x", "y").distinct()
    return at.agg(F.avg("x").alias("x"), F.avg("y").alias("y")).where("x is not null")
