"""Writers: Parquet tables, GeoJSON and XML as text rows or one document, CSV per sheet, and legends. Nothing half-written becomes visible."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.session import ship_package
from waymark.sources import datasources


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def replace(df: DataFrame, path: str, kind: str = "parquet", partition_by: Sequence[str] = (), **options) -> None:
    """Writes beside ``path`` and then takes its place. The old table is moved aside and goes only once the new one is there.

    Between the two renames there is no table for a moment; readers never see a half-written one, and if the
    second fails the old one comes back.
    """
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    writer = df.write.format(kind).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(staged)
    _swap(spark, staged, path)


def _swap(spark: SparkSession, staged: str, path: str) -> None:
    target, fs = _fs(spark, path)
    aside = _fs(spark, f"{staged}.old")[0]
    moved = fs.exists(target) and fs.rename(target, aside)
    if not fs.rename(_fs(spark, staged)[0], target):
        if moved:
            fs.rename(aside, target)
        raise OSError(f"can't move {staged} to {path}")
    if moved:
        fs.delete(aside, True)


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Overwrites only the partitions (facility, level, mode) that ``df`` has; the others stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def document(df: DataFrame, value: Column, path: str, order: Sequence[Column], head: str, foot: str, between: str = "") -> None:
    """One text file of a head, a text ``value`` per row in an explicit order, with ``between`` in front of all but the first, and a foot.

    Tasks write parts; the commit streams them, a megabyte at a time, into one file beside ``path``, which then takes its place in one step. If
    anything fails before that, the old file stays, and what was written beside it goes.
    """
    from waymark.operators.relational import dense_numbers

    spark = df.sparkSession
    staged = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    parts, fs = _fs(spark, staged)
    one, target = _fs(spark, f"{staged}.one")[0], _fs(spark, path)[0]
    hadoop = spark._jvm.org.apache.hadoop
    try:
        numbered = dense_numbers(df, order, "_number")
        numbered.select(F.when(F.col("_number") == 1, value).otherwise(F.concat(F.lit(between), value)).alias("value")).write.text(staged)
        out = fs.create(one)
        try:
            out.write(bytearray(head.encode()))
            for name in sorted(f.getPath().getName() for f in fs.listStatus(parts)):
                if name.startswith("part-"):
                    part = fs.open(hadoop.fs.Path(parts, name))
                    try:
                        hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
                    finally:
                        part.close()
            out.write(bytearray(foot.encode()))
        finally:
            out.close()
        _overwrite(spark, fs, one, target)
    finally:
        fs.delete(parts, True)
        fs.delete(one, False)


def _overwrite(spark: SparkSession, fs, one, target) -> None:
    """Renames one file to another's place in one step."""
    hadoop = spark._jvm.org.apache.hadoop
    kind = getattr(hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    context = hadoop.fs.FileContext.getFileContext(fs.makeQualified(target).toUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(one), fs.makeQualified(target), options)


def geopackage(df: DataFrame, path: str, layer: str, srs: int = 28992, files: int | None = None) -> None:
    """A layer as a folder of GeoPackages, a file for each task: columns kind, x, y, line and polygon as read, all others as attributes.

    ``files`` deals the rows anew; one file, which a task then makes alone, stands at ``path`` itself. What stood there goes only once the new layer is whole.
    """
    spark = df.sparkSession
    p = "struct<x:double,y:double>"
    for c, kind in (("x", "double"), ("y", "double"), ("line", f"array<{p}>"), ("polygon", f"array<array<{p}>>")):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(kind))
    rows = df.repartition(files) if files else df
    target, fs = _fs(spark, path)
    staged = fs.makeQualified(_fs(spark, f"{path.rstrip('/')}.{uuid.uuid4().hex}")[0])
    ship_package(spark)
    spark.dataSource.register(datasources.GeoPackage)
    plan = json.dumps({"layer": layer, "srs": srs, "staged": staged.toString()})
    try:
        rows.write.format(datasources.GeoPackage.name()).mode("append").options(plan=plan, schema=rows.schema.simpleString()).save()
        parts = [s.getPath() for s in fs.listStatus(staged) if s.getPath().getName().endswith(".gpkg")]
        if files == 1:
            _overwrite(spark, fs, parts[0], target)
        else:
            _swap(spark, staged.toString(), path)
    finally:
        fs.delete(staged, True)


def geojson_document(df: DataFrame, path: str, geometry: Column, order: Sequence[Column], properties: Sequence[str] | None = None, members: dict | None = None) -> None:
    """One GeoJSON document of all features; ``members`` stand in front of them, as a name or a reference system does."""
    start = json.dumps({"type": "FeatureCollection", **(members or {})}, ensure_ascii=False)[:-1]
    document(df, _feature(geometry, properties if properties is not None else df.columns), path, order, f'{start}, "features": [\n', "]}\n", ",")


def xml_document(df: DataFrame, path: str, root: str, name: str, order: Sequence[Column]) -> None:
    """One XML document: a ``root`` element with an element per row."""
    document(df, _record(name, df.columns), path, order, f'<?xml version="1.0" encoding="UTF-8"?>\n<{root}>\n', f"</{root}>\n")


def csv(df: DataFrame, path: str) -> None:
    replace(df, path, "csv", header=True)


def _feature(geometry: Column, properties: Sequence[str]) -> Column:
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry")))


def geojson_features(df: DataFrame, geometry: Column, properties: Sequence[str] | None = None) -> DataFrame:
    """A row of GeoJSON text per feature (``value``): newline-delimited, so that a table of any size can be written in parts."""
    return df.select(_feature(geometry, properties if properties is not None else df.columns).alias("value"))


def point_geometry(x: Column, y: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))


def line_geometry(line: Column) -> Column:
    return F.struct(F.lit("LineString").alias("type"), F.transform(line, lambda p: F.array(p["x"], p["y"])).alias("coordinates"))


def polygon_geometry(polygon: Column) -> Column:
    return F.struct(F.lit("Polygon").alias("type"), F.transform(polygon, lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))).alias("coordinates"))


def unique_feature_ids(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """A new dense ``id`` by an explicit order; the old one stays as ``bron_id``."""
    from waymark.operators.relational import dense_numbers

    named = df.withColumnRenamed("id", "bron_id") if "id" in df.columns else df
    return dense_numbers(named, order, "id")


def _record(name: str, columns: Sequence[str]) -> Column:
    def element(c: str) -> Column:
        safe = F.replace(F.replace(F.replace(F.col(f"`{c}`").cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        return F.coalesce(F.concat(F.lit(f"<{c}>"), safe, F.lit(f"</{c}>")), F.lit(""))

    return F.concat(F.lit(f"<{name}>"), *[element(c) for c in columns], F.lit(f"</{name}>"))


def xml_rows(df: DataFrame, name: str) -> DataFrame:
    """A row of XML text per record (``value``), elements in column order, nulls left out."""
    return df.select(_record(name, df.columns).alias("value"))


#: Fixed value: the longest name of a sheet.
SHEET = 31


def sheet_name(name: str) -> str:
    return "".join("_" if c in "[]:*?/\\" else c for c in name)[:SHEET]


def sheet_rows(df: DataFrame) -> DataFrame:
    """Texts without control characters, doubles without NaN and infinities."""
    def safe(c: str, kind: str) -> Column:
        if kind == "string":
            return F.regexp_replace(F.col(c), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
        return F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c)) if kind in ("double", "float") else F.col(c)

    return df.select(*[safe(c, k).alias(c) for c, k in df.dtypes])


def workbook(tables: dict[str, DataFrame], path: str) -> None:
    """One CSV folder per sheet, in as many files as the table has partitions."""
    for name, df in tables.items():
        csv(sheet_rows(df), f"{path.rstrip('/')}/{sheet_name(name)}")


def legend(title: str, items: Sequence[tuple[str, str]], width: int = 320) -> str:
    """An SVG legend: a coloured box and a label for each item."""
    rows = [f'<rect x="16" y="{44 + 26 * k}" width="20" height="16" fill="{colour}" stroke="#444"/><text x="46" y="{57 + 26 * k}" font-size="13">{escape(label)}</text>' for k, (label, colour) in enumerate(items)]
    height = 56 + 26 * len(items)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif"><rect width="100%" height="100%" fill="#fff"/><text x="16" y="28" font-size="16" font-weight="bold">{escape(title)}</text>{"".join(rows)}</svg>'
