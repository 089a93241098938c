"""Readers and writers on small files."""

from __future__ import annotations

import json
import sqlite3
import struct
import zipfile

from pyspark.sql import functions as F

from waymark.operators import facilities, register
from waymark.sources import files, sinks
from waymark.streaming import slots


def test_newest_and_text_table(spark, tmp_path):
    (tmp_path / "buurten_2024.csv").write_text("a;b\n1;x\n")
    (tmp_path / "buurten_2026.csv").write_text("﻿a;b;c\n2;y;z\n")
    path = files.newest(spark, str(tmp_path), r"^buurten_(\d{4})\.csv$")
    assert path.endswith("buurten_2026.csv")
    assert [tuple(r) for r in files.text_table(spark, path, ["b", "q", "a"], ";").collect()] == [("y", "2")]


def test_geojson(spark, tmp_path):
    features = [
        {"type": "Feature", "properties": {"naam": "p"}, "geometry": {"type": "Point", "coordinates": [1.5, 2]}},
        {"type": "Feature", "properties": {"naam": "m"}, "geometry": {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[2, 2], [3, 3]]]}},
        {"type": "Feature", "properties": {"naam": "v"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}},
    ]
    (tmp_path / "f.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    rows = files.geojson(spark, str(tmp_path / "f.geojson"), "naam:string").orderBy("naam", "part").collect()
    assert [(r.naam, r.kind, r.part) for r in rows] == [("m", "line", 0), ("m", "line", 1), ("p", "point", 0), ("v", "polygon", 0)]
    assert (rows[2].x, rows[2].y) == (1.5, 2.0) and rows[3].polygon[0][1].x == 1


def test_geopackage(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "l.gpkg")
    db.execute("create table gpkg_contents (table_name text, data_type text)")
    db.execute("create table gpkg_geometry_columns (table_name text, column_name text)")
    db.execute("insert into gpkg_contents values ('wegen', 'features')")
    db.execute("insert into gpkg_geometry_columns values ('wegen', 'geom')")
    db.execute("create table wegen (id text, geom blob)")
    line = struct.pack("<BIIdddd", 1, 2, 2, 0.0, 0.0, 3.0, 4.0)
    db.execute("insert into wegen values ('a', ?)", (b"GP\x00\x01" + struct.pack("<i", 28992) + line,))
    db.commit()
    db.close()
    row = files.geopackage(spark, str(tmp_path / "l.gpkg"), {"id": "string"}).first()
    assert (row.id, row.kind, [(p.x, p.y) for p in row.line]) == ("a", "line", [(0, 0), (3, 4)])


def test_zipped_register(spark, tmp_path):
    xml = '<r xmlns:o="u"><o:Obj><o:id> 1 </o:id><o:doel>a</o:doel><o:doel>b</o:doel></o:Obj><o:Obj><o:id>2</o:id></o:Obj></r>'
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("x.xml", xml)
    rows = files.register_objects(spark, str(tmp_path / "b.zip"), "Obj", {"id": "id", "doelen": "doel"}, ["doelen"]).orderBy("id").collect()
    assert [(r.id, r.doelen) for r in rows] == [("1", ["a", "b"]), ("2", [])]


def test_building_rows(spark, tmp_path):
    one = "<x:Pand><x:identificatie>{}</x:identificatie><x:oorspronkelijkBouwjaar>1999</x:oorspronkelijkBouwjaar><x:tijdstipRegistratieLV>t</x:tijdstipRegistratieLV><g><posList>1 2 3 4</posList></g></x:Pand>"
    with zipfile.ZipFile(tmp_path / "pnd.zip", "w") as z:
        for k in (1, 2):
            z.writestr(f"{k}.xml", '<r xmlns:x="u">' + "".join(one.format(10 * k + n) for n in range(2)) + "</r>")
    df = register.building_rows(spark, str(tmp_path / "pnd.zip"))
    rows = df.orderBy("pand_id").collect()
    assert len(df.columns) == 16 and df.columns[:3] == ["zip_bestand", "xml_bestand", "pand_id"]
    assert [(r.zip_bestand, r.xml_bestand, r.pand_id) for r in rows] == [("pnd.zip", "1.xml", "10"), ("pnd.zip", "1.xml", "11"), ("pnd.zip", "2.xml", "20"), ("pnd.zip", "2.xml", "21")]
    assert (rows[0].bouwjaar, rows[0].pand_geometrie_poslist, rows[0].pand_tijdstip_registratie_lv, rows[0].pand_status) == ("1999", "1 2 3 4", "t", None)


def test_replace_keeps_the_old_table_until_the_new_one_is_there(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace(spark.range(3), path)
    sinks.replace(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["t"]
    long = sinks.sheet_rows(spark.range(1).select(F.repeat(F.lit("a"), 40_000).alias("x"))).first().x
    assert len(long) == 40_000


def test_gtfs_folder(spark, tmp_path):
    for name in files.GTFS_REQUIRED:
        (tmp_path / f"{name}.txt").write_text(",".join(files.GTFS_COLUMNS[name][:2]) + ",other\n1,2,3\n")
    tables = files.gtfs(spark, str(tmp_path))
    assert tables["stops"].columns == list(files.GTFS_COLUMNS["stops"]) and tables["shapes"].count() == 0
    assert files.file_control(spark, str(tmp_path)).where("verplicht and not aanwezig").count() == 0


def test_elements(spark, tmp_path):
    doc = {"elements": [{"type": "node", "id": 1, "lon": 5.0, "lat": 53.0, "tags": {"name": "a"}}, {"type": "way", "id": 2, "center": {"lon": 6.0, "lat": 53.5}, "tags": {"name": "b"}}, {"type": "node", "id": 1, "lon": 9.0, "lat": 9.0}, {"type": "node", "id": 3}]}
    (tmp_path / "o.json").write_text(json.dumps(doc))
    got = facilities.elements(files.json_document(spark, str(tmp_path / "o.json"), facilities.ELEMENTS)).orderBy("element_id").collect()
    assert [(r.element_id, r.lon, r.tags["name"]) for r in got] == [(1, 5.0, "a"), (2, 6.0, "b")]


def test_endpoints():
    def ask(url):
        if url == "bad":
            raise OSError("down")
        return url

    assert files.first_answer(["bad", "good"], ask) == "good"


def test_replace_and_features(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace(spark.range(3), path)
    sinks.replace(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5
    line = sinks.geojson_features(spark.range(1).select(F.lit("a").alias("naam")), sinks.point_geometry(F.lit(1.0), F.lit(2.0))).first().value
    assert json.loads(line) == {"type": "Feature", "properties": {"naam": "a"}, "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}}
    assert sinks.legend("T", [("a<b", "#fff")]).count("<rect") == 2
    assert sinks.sheet_name("a/b" * 20) == "a_b" * 10 + "a"


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "user_id", "value")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = slots.slot_counts(stream, "user_id").writeStream.outputMode("append").format("memory").queryName("slot_test").start()
    query.processAllAvailable()
    query.stop()
    got = {(r.slot, r.user_id): r.aantal for r in spark.table("slot_test").collect()}
    want = {(r.slot, r.user_id): r.aantal for r in slots.slot_counts(events, "user_id").collect()}
    assert got.items() <= want.items()
