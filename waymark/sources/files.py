"""Tables in files and services: discovery by name, text tables with pruned columns, GeoJSON, timetables, address registers, paged answers.

Readers go through Spark's file sources wherever the format allows, so paths may lie in any store and reads split. Zipped XML is read
by member, GeoPackage layers by row range, services by page.
"""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import text
from waymark.operators.relational import available, first_per_key
from waymark.session import ship_package, written
from waymark.sources import datasources

#: Columns kept of each timetable file, and the files that must be there.
GTFS_COLUMNS = {
    "agency": ("agency_id", "agency_name"),
    "routes": ("agency_id", "route_id", "route_short_name", "route_long_name", "route_type"),
    "trips": ("route_id", "service_id", "trip_id", "trip_headsign", "direction_id", "shape_id"),
    "stops": ("stop_id", "stop_name", "stop_lat", "stop_lon", "platform_code"),
    "stop_times": ("trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence"),
    "calendar_dates": ("service_id", "date", "exception_type"),
    "calendar": ("service_id", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "start_date", "end_date"),
    "shapes": ("shape_id", "shape_pt_lat", "shape_pt_lon", "shape_pt_sequence"),
}
GTFS_REQUIRED = ("agency", "routes", "trips", "stops", "stop_times", "calendar_dates")


def listing(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Paths under a folder whose last part matches a pattern, by any file system that Spark knows."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    return sorted(s.getPath().toString() for s in fs.listStatus(path) if re.search(pattern, s.getPath().getName()))


def matches(spark: SparkSession, paths: str | Sequence[str]) -> list[str]:
    """Files that paths, patterns or folders stand for; a path without any is an error."""
    jvm = spark._jvm
    out = []
    for given in [paths] if isinstance(paths, str) else paths:
        path = jvm.org.apache.hadoop.fs.Path(given)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files = []
        for found in fs.globStatus(path) or []:
            files += [s for s in (fs.listStatus(found.getPath()) if found.isDirectory() else [found]) if s.isFile() and not s.getPath().getName().startswith((".", "_"))]
        if not files:
            raise FileNotFoundError(given)
        out += sorted(s.getPath().toString() for s in files)
    return out


def newest(spark: SparkSession, folder: str, pattern: str, year: int | None = None) -> str:
    """The file whose name has the requested year, else the largest one, as the pattern's first group."""
    found = {int(re.search(pattern, p.rsplit("/", 1)[-1])[1]): p for p in listing(spark, folder, pattern)}
    if not found or (year is not None and year not in found):
        raise FileNotFoundError(f"no file {pattern!r} for {year or 'any year'} in {folder}")
    return found[year if year is not None else max(found)]


def text_table(spark: SparkSession, path: str, columns: Sequence[str] = (), separator: str = ",", encodings: Sequence[str] = ("UTF-8",)) -> DataFrame:
    """A delimited file, all columns as text; of the wanted ones those that exist. The first encoding without broken characters counts."""
    for k, encoding in enumerate(encodings):
        df = spark.read.csv(path, header=True, sep=separator, encoding=encoding, inferSchema=False, multiLine=False, escape='"')
        df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
        if k + 1 == len(encodings) or not df.where(F.concat_ws(" ", *[F.col(f"`{c}`") for c in df.columns]).contains("�")).head(1):
            break
    return available(df, columns) if columns else df


def gtfs(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All tables of a timetable folder; required files must exist, optional ones are empty if they don't."""
    out = {}
    for name, columns in GTFS_COLUMNS.items():
        path = f"{folder}/{name}.txt"
        if listing(spark, folder, f"^{name}\\.txt$"):
            df = text_table(spark, path, columns)
            for c in columns:
                if c not in df.columns:
                    df = df.withColumn(c, F.lit(None).cast("string"))
            out[name] = df.select(*columns)
        elif name in GTFS_REQUIRED:
            raise FileNotFoundError(path)
        else:
            out[name] = spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
    return out


def file_control(spark: SparkSession, folder: str) -> DataFrame:
    """Which timetable files are there and which have to be."""
    rows = [(n, n in GTFS_REQUIRED, bool(listing(spark, folder, f"^{n}\\.txt$"))) for n in GTFS_COLUMNS]
    return spark.createDataFrame(rows, "bestand string, verplicht boolean, aanwezig boolean")


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A whole JSON file as one row of a declared schema; a file that isn't JSON raises with its start."""
    rows = spark.read.text(path, wholetext=True).select("value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("d"))
    bad = rows.where("d is null").select(F.substring("value", 1, 200)).head(1)
    if bad:
        raise ValueError(f"{path} isn't the expected JSON: {bad[0][0]}")
    return rows.select("d.*")


GEOMETRY = "struct<type:string,coordinates:string>"


def geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features with declared properties (DDL), ``kind`` (point, line, polygon), ``x``, ``y``, ``line`` and ``polygon``; multi-geometries a row per part."""
    doc = json_document(spark, path, f"features array<struct<{_feature_type(properties)}>>")
    return _parts(doc.select(F.explode("features").alias("f")))


def _feature_type(properties: str) -> str:
    return f"properties:struct<{properties}>,geometry:{GEOMETRY}"


def _parts(features: DataFrame) -> DataFrame:
    f = features.where("f.geometry is not null")
    p = "array<double>"
    kind = F.col("f.geometry.type")
    raw = F.col("f.geometry.coordinates")
    as_array = lambda depth: F.from_json(raw, "array<" * depth + p + ">" * depth)
    point = lambda c: F.struct(c[0].alias("x"), c[1].alias("y"))
    line = lambda c: F.transform(c, point)
    rings = lambda c: F.transform(c, line)
    nothing = F.lit(None)
    part = lambda k, pt, ln, pg: F.struct(F.lit(k).alias("kind"), pt.alias("point"), ln.alias("line"), pg.alias("polygon"))
    pt0, ln0, pg0 = nothing.cast("struct<x:double,y:double>"), nothing.cast("array<struct<x:double,y:double>>"), nothing.cast("array<array<struct<x:double,y:double>>>")
    parts = (
        F.when(kind == "Point", F.array(part("point", point(F.from_json(raw, p)), ln0, pg0)))
        .when(kind == "MultiPoint", F.transform(as_array(1), lambda c: part("point", point(c), ln0, pg0)))
        .when(kind == "LineString", F.array(part("line", pt0, line(as_array(1)), pg0)))
        .when(kind == "MultiLineString", F.transform(as_array(2), lambda c: part("line", pt0, line(c), pg0)))
        .when(kind == "Polygon", F.array(part("polygon", pt0, ln0, rings(as_array(2)))))
        .when(kind == "MultiPolygon", F.transform(as_array(3), lambda c: part("polygon", pt0, ln0, rings(c))))
    )
    rows = f.select("f.properties.*", F.posexplode(parts).alias("part", "g"))
    return rows.select(*[c for c in rows.columns if c != "g"], F.col("g.kind").alias("kind"), F.col("g.point.x").alias("x"), F.col("g.point.y").alias("y"), F.col("g.line").alias("line"), F.col("g.polygon").alias("polygon"))


def is_metric(df: DataFrame, x: str = "x") -> bool:
    """Whether coordinates are metres and not degrees: some lie beyond 1000."""
    return bool(df.where(F.abs(F.col(x)) > 1000).head(1))


def _loaded(spark: SparkSession, source, plan: dict, schema: str = "value string") -> DataFrame:
    ship_package(spark)
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(plan=json.dumps(plan), schema=schema).load()


def register_objects(spark: SparkSession, paths: str | Sequence[str], name: str, fields: dict[str, str], lists: Sequence[str] = (), most: int | None = None, origin: tuple[str, str] | None = None, bundle: int = datasources.BUNDLE_BYTES) -> DataFrame:
    """Objects ``name`` from XML files in zip archives: a row per object, a column per field.

    ``fields`` maps columns to local element names, found at any depth and in any namespace: the first with text;
    those in ``lists`` collect all texts. Paths may be patterns or folders. A task streams the members of one archive that ``bundle`` compressed
    bytes hold, or a larger one. ``most`` caps the files per archive; ``origin`` names two more columns, for the archive and the file in it.
    """
    schema = ", ".join(f"`{c}` array<string>" if c in lists else f"`{c}` string" for c in [*(origin or ()), *fields])
    plan = {"paths": matches(spark, paths), "name": name, "fields": fields, "lists": list(lists), "most": most, "origin": bool(origin), "bundle": bundle}
    return _loaded(spark, datasources.RegisterObjects, plan, schema)


def first_object(objects: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    return first_per_key(objects.where(text.blank_to_null(F.col(key)).isNotNull()), [key], order)


def geopackage(spark: SparkSession, path: str | Sequence[str], columns: dict[str, str], layer: str | None = None, rows: int = 100_000, optional: Sequence[str] = ()) -> DataFrame:
    """A layer of GeoPackage files: declared columns (name to type), kind, x, y, line and polygon as in ``geojson``.

    Without a layer name the file must have one feature layer. A column that it lacks is an error, or null if it is ``optional``. On a mounted file system every ``rows`` row numbers are a task; a file in
    another store is read by one task from a copy on its disk.
    """
    p = "struct<x:double,y:double>"
    schema = ", ".join([*(f"`{c}` {t}" for c, t in columns.items()), "part int", "kind string", "x double", "y double", f"line array<{p}>", f"polygon array<array<{p}>>"])
    return _loaded(spark, datasources.GeoPackage, {"paths": matches(spark, path), "columns": list(columns), "optional": list(optional), "layer": layer, "rows": rows}, schema)


def paged(
    spark: SparkSession,
    urls: str | Sequence[str],
    schema: str,
    records: Sequence[str] = (),
    size: int | None = 50_000,
    readers: int = 4,
    parameters: tuple[str, str] = ("$offset", "$limit"),
    query: dict[str, str] | None = None,
    timeout: float = 60,
    waits: Sequence[float] = (),
    optional: bool = False,
) -> DataFrame:
    """Records of a JSON service as rows of ``schema``, by page: each of ``readers`` tasks asks every so many-th page until one isn't full.

    ``records`` leads to the list in an answer, ``parameters`` name offset and limit; without a size there is one request. Pages must come in a
    fixed order, which services give by a parameter in ``query``. The first of ``urls`` that answers counts; all are asked again after each wait in ``waits``.
    An optional service that fails gives an empty table, never a part of one: its rows are written to the shared folder first.
    """
    plan = {"urls": [urls] if isinstance(urls, str) else list(urls), "records": list(records), "size": size, "readers": readers, "offset": parameters[0], "limit": parameters[1], "query": query or {}, "timeout": timeout, "waits": list(waits)}
    rows = _loaded(spark, datasources.Pages, plan)
    if optional:
        try:
            rows = written(rows, "pages")
        except PySparkException as error:
            warnings.warn(f"{plan['urls'][0]} left out: {str(error)[:500]}", stacklevel=2)
            rows = spark.createDataFrame([], "value string")
    return rows.select(F.from_json("value", schema).alias("r")).select("r.*")


def feature_service(spark: SparkSession, urls: str | Sequence[str], properties: str, size: int | None = None, optional: bool = True, **options) -> DataFrame:
    """Features of a GeoJSON service, as rows of ``geojson``."""
    features = paged(spark, urls, f"struct<{_feature_type(properties)}>", ("features",), size, parameters=("startIndex", "count"), optional=optional, **options)
    return _parts(features.select(F.struct("properties", "geometry").alias("f")))


def first_answer(urls: Sequence[str], ask):
    """The answer of the first endpoint that gives one; the errors of all if none does."""
    errors = []
    for url in urls:
        try:
            return ask(url)
        except (OSError, ValueError) as error:
            errors.append(f"{url}: {error}")
    raise ConnectionError("; ".join(errors))
