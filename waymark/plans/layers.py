"""Layers of an accessibility run, read from written files: buildings of a year, facilities, mode networks, parking places, timetables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions import geometry as g
from waymark.functions import text
from waymark.operators import access, network, relational, transit
from waymark.sources import files

#: Which buildings a run can take, and their columns.
SELECTIONS = ("woonpanden", "alle_panden")
BUILDING_COLUMNS = {"jaar": "string", "pand_id": "string", "is_woonpand": "string", "buurtcode": "string", "buurtnaam": "string", "gemeentecode": "string", "gemeentenaam": "string"}
WAY_COLUMNS = {"heen_toegestaan": "string", "terug_toegestaan": "string", "reistijd_min": "double"}
SHAPE = ("kind", "x", "y", "line", "polygon")


def layer(spark: SparkSession, path: str, columns: dict[str, str], optional: dict[str, str] | None = None, name: str | None = None) -> DataFrame:
    """A GeoJSON, Parquet or GeoPackage layer: declared columns, optional ones null where the file has none, part, kind, x, y, line and polygon in metres.

    Of a GeoPackage file or folder ``name`` is the layer, if there are several. Degrees are projected.
    """
    optional = optional or {}
    wanted = columns | optional
    if path.endswith((".geojson", ".json")):
        rows = files.geojson(spark, path, ", ".join(f"`{c}`: {t}" for c, t in wanted.items()))
    elif path.rstrip("/").endswith(".parquet"):
        rows = relational.require_columns(spark.read.parquet(path), columns, path)
        for c, t in (optional | {"part": "int", "kind": "string", "x": "double", "y": "double", "line": "array<struct<x:double,y:double>>", "polygon": "array<array<struct<x:double,y:double>>>"}).items():
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit("point") if c == "kind" else F.lit(0) if c == "part" else F.lit(None).cast(t))
        rows = rows.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in wanted.items()], "part", *SHAPE)
    else:
        rows = files.geopackage(spark, path, wanted, name, optional=tuple(optional))
    return _in_metres(rows)


def _in_metres(rows: DataFrame) -> DataFrame:
    probe = rows.where("kind is not null").select(_place(rows)["x"].alias("x"))
    if not probe.head(1) or files.is_metric(probe):
        return rows
    at = lambda p: g.wgs84_to_rd(p["x"], p["y"])
    ring = lambda r: F.transform(r, at)
    single = g.wgs84_to_rd(F.col("x"), F.col("y"))
    return rows.withColumns({"x": F.when(F.col("kind") == "point", single["x"]), "y": F.when(F.col("kind") == "point", single["y"]), "line": ring(F.col("line")), "polygon": F.transform("polygon", ring)})


def _place(rows: DataFrame) -> Column:
    return g.representative(rows["kind"], rows["line"], rows["polygon"], g.point(rows["x"], rows["y"]))


def points(rows: DataFrame) -> DataFrame:
    """Rows with one place each (x, y) instead of their geometry."""
    keep = [c for c in rows.columns if c not in ("part", *SHAPE)]
    return rows.where("kind is not null").select(*keep, _place(rows).alias("_p")).select(*keep, F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))


def buildings(spark: SparkSession, path: str, year: int, selection: str = "woonpanden") -> DataFrame:
    """Buildings as points, each once: of several parts the largest counts. The layer must be of the year and no other."""
    if selection not in SELECTIONS:
        raise ValueError(f"selection: {selection}; {' or '.join(SELECTIONS)}")
    rows = layer(spark, path, BUILDING_COLUMNS)
    years = rows.select(F.col("jaar").try_cast("double").cast("int").alias("jaar")).agg(F.min("jaar"), F.max("jaar")).first()
    if tuple(years) != (year, year):
        raise ValueError(f"{path}: buildings of {years[0]} to {years[1]}, not of {year}")
    if selection == "woonpanden":
        rows = rows.where(text.text_flag(F.col("is_woonpand")))
    one = relational.first_per_key(rows, ["pand_id"], [F.coalesce(g.area(F.col("polygon")), F.lit(0.0)).desc(), F.col("part"), F.col("x"), F.col("y")])
    return points(one)


def facilities(spark: SparkSession, path: str, names: Sequence[str] = ("naam", "name"), level: tuple[str, str] | None = None, layer_name: str | None = None) -> DataFrame:
    """Facilities (target, x, y, naam), numbered from 1 by their place; ``level`` keeps those whose column has a value, such as a level of education."""
    optional = dict.fromkeys([*names, *(level[:1] if level else ())], "string")
    rows = layer(spark, path, {}, optional, layer_name)
    if level:
        rows = rows.where(text.plain(F.col(level[0])) == text.plain(F.lit(level[1])))
    named = points(rows.where("part = 0")).select(text.first_filled(*[F.col(f"`{n}`") for n in names]).alias("naam"), "x", "y")
    return relational.dense_numbers(named, [F.col("x"), F.col("y"), F.col("naam")], "target")


def road_network(spark: SparkSession, path: str, mode: str, key: str = "edge_id", region_m: float | None = None) -> access.RoadNetwork:
    """A mode's ways: parts of a multi-part line share its minutes by length; without minutes the length at walking, cycling or driving pace counts."""
    speed = network.SNAP_SPEED[mode]
    rows = layer(spark, path, WAY_COLUMNS, {key: "string", "lengte_meter": "double"}).where("kind = 'line'").withColumn("_m", g.length(F.col("line"))).where("_m > 0")
    if rows.where(F.col(key).isNull()).head(1):
        raise ValueError(f"{path}: ways without {key}")
    whole = F.sum("_m").over(Window.partitionBy(key))
    minutes = F.coalesce(F.col("reistijd_min"), F.coalesce("lengte_meter", whole) / speed)
    parts = rows.withColumn("minutes", minutes * F.col("_m") / whole)
    allowed = lambda c: F.coalesce(F.col(c).isNull() | text.text_flag(F.col(c)), F.lit(True))
    ways = relational.dense_numbers(parts, [F.col(key), F.col("part")], "_edge").select(
        F.col("_edge").alias("edge_id"), F.col(key).alias("bron_id"), g.node_id(F.element_at("line", 1)).alias("u"), g.node_id(F.element_at("line", -1)).alias("v"),
        "minutes", F.col("_m").alias("length_m"), allowed("heen_toegestaan").alias("forward"), allowed("terug_toegestaan").alias("backward"), "line",
    )
    return access.RoadNetwork.of(mode, ways, speed, region_m)


def parking(spark: SparkSession, path: str, garages: str | None = None) -> DataFrame:
    """Parking places (parking, x, y, parkeer_bron): those of roads, and garages if there are any."""
    rows = points(layer(spark, path, {})).withColumn("parkeer_bron", F.lit("NWB_parkeren"))
    if garages:
        rows = rows.unionByName(points(layer(spark, garages, {})).withColumn("parkeer_bron", F.lit("RDW_parkeergarage")))
    return relational.dense_numbers(rows, [F.col("parkeer_bron"), F.col("x"), F.col("y")], "parking")


def timetable(spark: SparkSession, folder: str, day: str, start: int, end: int, operators: Sequence[str] = transit.OPERATORS) -> tuple[DataFrame, DataFrame]:
    """Stops (node, x, y, stop_id) and a day's rides (dep, arr, src, dst) of a timetable folder; bus rides of no time are corrected."""
    t = files.gtfs(spark, folder)
    at = g.wgs84_to_rd(F.col("stop_lon").try_cast("double"), F.col("stop_lat").try_cast("double"))
    placed = t["stops"].select("stop_id", at.alias("_p")).select("stop_id", F.col("_p.x").alias("x"), F.col("_p.y").alias("y")).where("x is not null")
    stops = relational.dense_numbers(relational.first_per_key(placed, ["stop_id"], [F.col("x"), F.col("y")]), [F.col("stop_id")], "node")
    trips = transit.trips(t["trips"], transit.routes(t["routes"], t["agency"], operators))
    times = transit.stop_times(t["stop_times"], trips, stops.select("stop_id").withColumn("in_regio", F.lit(True)))
    edges = transit.corrected_edges(transit.stop_edges(times, keep=("service_id", "mode")))
    rides = edges.select("service_id", "from_stop_id", "to_stop_id", F.col("from_departure_seconds").alias("departure"), (F.col("from_departure_seconds") + F.col("seconds")).alias("arrival"))
    services = relational.active_services(t["calendar"], t["calendar_dates"], day)
    return stops, transit.connections(rides, services, stops, start, end)
