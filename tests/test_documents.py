"""Whole documents: read back equal, in order, and never half there."""

from __future__ import annotations

import json
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from waymark.sources import files, sinks


def rows(spark, n=500):
    return spark.range(n).repartition(7).select(((F.col("id") * 37) % n).alias("nr"), F.concat(F.lit('"é,\n&<'), F.col("id").cast("string")).alias("naam"), F.when(F.col("id") % 3 > 0, F.col("id") / 7).alias("maat"), (F.col("id") * 1.5).alias("x"), F.lit(2.0).alias("y"))


def beside(tmp_path):
    return sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc"))


def test_geojson_document(spark, tmp_path):
    df, path = rows(spark), f"{tmp_path}/laag.geojson"
    for _ in range(2):
        sinks.geojson_document(df, path, sinks.point_geometry(F.col("x"), F.col("y")), [F.col("nr")], ["nr", "naam", "maat"], {"name": "laag"})
        doc = json.loads((tmp_path / "laag.geojson").read_text())
        assert list(doc) == ["type", "name", "features"] and beside(tmp_path) == ["laag.geojson"]
    want = sorted((r.nr, r.naam, r.maat, r.x, r.y) for r in df.collect())
    got = [(f["properties"]["nr"], f["properties"]["naam"], f["properties"].get("maat"), *f["geometry"]["coordinates"]) for f in doc["features"]]
    assert got == want
    back = files.geojson(spark, path, "nr bigint, naam string, maat double")
    assert sorted((r.nr, r.naam, r.maat, r.x, r.y) for r in back.collect()) == want
    sinks.geojson_document(df.where("nr < 0"), path, sinks.point_geometry(F.col("x"), F.col("y")), [F.col("nr")])
    assert json.loads((tmp_path / "laag.geojson").read_text()) == {"type": "FeatureCollection", "features": []}


def test_xml_document(spark, tmp_path):
    df = rows(spark)
    sinks.xml_document(df.select("nr", "naam", "maat"), f"{tmp_path}/laag.xml", "lagen", "laag", [F.col("nr").desc()])
    root = ElementTree.parse(tmp_path / "laag.xml").getroot()
    got = [(int(e.findtext("nr")), e.findtext("naam"), e.findtext("maat")) for e in root]
    assert root.tag == "lagen" and got == sorted(((r.nr, r.naam, None if r.maat is None else str(r.maat)) for r in df.collect()), reverse=True)


def test_a_failed_commit_leaves_the_old_file(spark, tmp_path):
    df, path = rows(spark, 20), f"{tmp_path}/laag.geojson"
    point = sinks.point_geometry(F.col("x"), F.col("y"))
    sinks.geojson_document(df, path, point, [F.col("nr")])
    old = (tmp_path / "laag.geojson").read_bytes()
    broken = df.withColumn("nr", F.when(F.col("nr") == 13, F.raise_error(F.lit("stop"))).otherwise(F.col("nr")).cast("bigint"))
    with pytest.raises(Exception, match="stop"):
        sinks.geojson_document(broken, path, point, [F.col("nr")])
    assert (tmp_path / "laag.geojson").read_bytes() == old and beside(tmp_path) == ["laag.geojson"]
    # the commit itself fails: a folder with files stands at the path
    (tmp_path / "map" / "in").mkdir(parents=True)
    with pytest.raises(Exception, match="map"):
        sinks.geojson_document(df, f"{tmp_path}/map", point, [F.col("nr")])
    assert beside(tmp_path) == ["laag.geojson", "map"] and (tmp_path / "map" / "in").is_dir()
