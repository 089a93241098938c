"""Archives by member, GeoPackage layers by row range, services by page: against written files and a local server."""

from __future__ import annotations

import json
import sqlite3
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from waymark.operators import register
from waymark.sources import files, sinks


def archive(path, members: dict[str, str]) -> str:
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, xml in members.items():
            z.writestr(name, xml)
    return str(path)


def test_members_are_tasks(spark, tmp_path):
    members = {f"{k:02}.xml": '<r xmlns:o="u">' + "".join(f"<o:Obj><o:id>{k}-{n}</o:id></o:Obj>" for n in range(3)) + "</r>" for k in range(20)}
    archive(tmp_path / "a.zip", members | {"lees.txt": "x"})
    archive(tmp_path / "b.zip", {"z.xml": "<r><Obj><id>b</id></Obj></r>"})
    (tmp_path / "c.xml").write_text("<r><Obj><id>c</id></Obj></r>")
    fine = files.register_objects(spark, str(tmp_path), "Obj", {"id": "id"}, origin=("zip", "xml"), bundle=1)
    assert fine.rdd.getNumPartitions() == 22
    rows = sorted((r.zip, r.xml, r.id) for r in fine.collect())
    assert len(rows) == 62 and rows[0] == ("a.zip", "00.xml", "0-0") and rows[-2:] == [("b.zip", "z.xml", "b"), ("c.xml", "c.xml", "c")]
    whole = files.register_objects(spark, f"{tmp_path}/*.zip", "Obj", {"id": "id"}, origin=("zip", "xml"))
    assert whole.rdd.getNumPartitions() == 2 and sorted((r.zip, r.xml, r.id) for r in whole.collect()) == rows[:-1]
    assert files.register_objects(spark, f"{tmp_path}/a.zip", "Obj", {"id": "id"}, most=2, bundle=1).count() == 6
    with pytest.raises(FileNotFoundError):
        files.register_objects(spark, f"{tmp_path}/none*.zip", "Obj", {"id": "id"})


def test_register_of_a_municipality(spark, tmp_path):
    objects = {
        "WPL": [("Woonplaats", "<identificatie>0017</identificatie><naam>Grou</naam>"), ("Woonplaats", "<identificatie>2222</identificatie><naam>Elders</naam>")],
        "OPR": [("OpenbareRuimte", "<identificatie>s1</identificatie><naam>Kade</naam><type>Weg</type><ligtIn><WoonplaatsRef>0017</WoonplaatsRef></ligtIn>"), ("OpenbareRuimte", "<identificatie>s2</identificatie><naam>Ver</naam><WoonplaatsRef>2222</WoonplaatsRef>")],
        "NUM": [("Nummeraanduiding", "<identificatie>n1</identificatie><huisnummer>4</huisnummer><huisletter> a </huisletter><postcode>9001AB</postcode><status>Naamgeving uitgegeven</status><OpenbareRuimteRef>s1</OpenbareRuimteRef>")],
        "VBO": [("Verblijfsobject", "<identificatie>v1</identificatie><NummeraanduidingRef>n1</NummeraanduidingRef><gebruiksdoel>woonfunctie</gebruiksdoel><gebruiksdoel>winkelfunctie</gebruiksdoel><oppervlakte>80</oppervlakte><PandRef>p1</PandRef><PandRef>p2</PandRef><pos>180000.5 560000 1.0</pos>"), ("Verblijfsobject", "<identificatie>v2</identificatie><NummeraanduidingRef>n9</NummeraanduidingRef><PandRef>p3</PandRef>")],
        "PND": [("Pand", f"<identificatie>p{k}</identificatie><oorspronkelijkBouwjaar>19{k}0</oorspronkelijkBouwjaar>") for k in (1, 2, 3)],
    }
    for kind, rows in objects.items():
        archive(tmp_path / f"9999{kind}08012026.zip", {"1.xml": '<b xmlns="u">' + "".join(f"<{n}>{x}</{n}>" for n, x in rows) + "</b>"})
    relations = spark.createDataFrame([("17", "80", "2010-01-01", None, "definitief"), ("2222", "99", "2010-01-01", None, "definitief")], "woonplaats_id string, gemeentecode string, begin string, eind string, status string")
    got = register.register_of(spark, str(tmp_path), relations, ["80"], [2026])
    links = sorted((r.pand_id, r.verblijfsobject_id, r.gebruiksdoelen, r.huisnummer, r.huisletter, r.openbare_ruimte_naam, r.woonplaats_naam, r.vbo_x, r.vbo_y) for r in got["koppeltabel"].collect())
    assert links == [(p, "v1", "woonfunctie;winkelfunctie", "4", "a", "Kade", "Grou", 180000.5, 560000.0) for p in ("p1", "p2")]
    assert [r.pand_id for r in got["panden"].orderBy("pand_id").collect()] == ["p1", "p2"] and got["openbare_ruimtes"].count() == 1


def shapes(spark, n: int):
    """Points, lines, polygons with a hole and rows without a geometry, in turn."""
    at = lambda dx, dy: F.struct((F.col("id") + dx).cast("double").alias("x"), F.lit(float(dy)).alias("y"))
    k = F.col("id") % 4
    ring = lambda *p: F.array(*[at(*q) for q in p])
    return spark.range(n).select(
        F.col("id").alias("nr"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("é'\"-"), F.col("id").cast("string"))).alias("naam"),
        F.when(k == 0, "point").when(k == 1, "line").when(k == 2, "polygon").alias("kind"),
        F.when(k == 0, F.col("id").cast("double")).alias("x"),
        F.when(k == 0, F.lit(0.5)).alias("y"),
        F.when(k == 1, F.array(at(0, 0), at(2, 3))).alias("line"),
        F.when(k == 2, F.array(ring((0, 0), (9, 0), (9, 9), (0, 0)), ring((5, 2), (6, 2), (6, 3), (5, 2)))).alias("polygon"),
    )


def plain(df):
    return sorted(json.dumps(r.asDict(True), sort_keys=True) for r in df.drop("part").collect())


def test_geopackage_round_trip(spark, tmp_path):
    df = shapes(spark, 200)
    want = plain(df.where("kind is not null"))
    for count in (3, 1, 1):
        path = f"{tmp_path}/laag{count}"
        sinks.geopackage(df, path, "mijn laag", files=count)
        back = files.geopackage(spark, path, {"nr": "bigint", "naam": "string"}, rows=20)
        assert plain(back) == want and back.rdd.getNumPartitions() >= 10
    with sqlite3.connect(f"{tmp_path}/laag1") as db:
        assert db.execute("pragma application_id").fetchone()[0] == int.from_bytes(b"GPKG", "big")
        assert db.execute("select min_x, min_y, max_x, max_y, srs_id from gpkg_contents").fetchone() == (0.0, 0.0, 207.0, 9.0, 28992)
        assert db.execute('select count(*), count(geom) from "mijn laag"').fetchone() == (200, 150)
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["laag1", "laag3"]
    with pytest.raises(Exception, match="mijn laag"):
        files.geopackage(spark, f"{tmp_path}/laag1", {"nr": "bigint"}, layer="andere").collect()
    sinks.geopackage(df.where("nr < 0").select("nr", "kind", "x", "y"), f"{tmp_path}/leeg", "leeg", files=1)
    assert files.geopackage(spark, f"{tmp_path}/leeg", {"nr": "bigint"}).count() == 0


def test_a_failed_layer_leaves_the_old_one(spark, tmp_path):
    df, path = shapes(spark, 40), f"{tmp_path}/laag"
    sinks.geopackage(df, path, "laag", files=2)
    broken = df.withColumn("nr", F.when(F.col("nr") == 13, F.raise_error(F.lit("stop"))).otherwise(F.col("nr")).cast("bigint"))
    with pytest.raises(Exception, match="stop"):
        sinks.geopackage(broken, path, "laag", files=2)
    assert files.geopackage(spark, path, {"nr": "bigint"}).count() == 30 and [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["laag"]


@pytest.fixture
def service():
    """A JSON service: ``/rows`` pages of at most ``cap`` of ``data``, ``/features`` a collection, ``/down`` errors, ``/late`` fails from an offset on."""
    state = {"data": [{"id": str(k), "naam": f"é{k}", "diep": {"a": k}} for k in range(23)], "cap": 1000, "asked": []}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            url = urlparse(self.path)
            q = {k: v[0] for k, v in parse_qs(url.query).items()}
            state["asked"].append((url.path, q))
            start, n = int(q.get("$offset", q.get("startIndex", 0))), int(q.get("$limit", q.get("count", 10**9)))
            if url.path == "/down" or (url.path == "/late" and start >= 10):
                self.send_error(503)
                return
            rows = state["data"][start : start + min(n, state["cap"])]
            if url.path == "/features":
                rows = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"id": r["id"]}, "geometry": {"type": "Point", "coordinates": [int(r["id"]), 1]}} for r in rows]}
            body = json.dumps(rows).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    state["url"] = f"http://127.0.0.1:{server.server_port}"
    yield state
    server.shutdown()
    server.server_close()


def test_pages_are_shared_by_readers(spark, service):
    url, schema = service["url"], "id string, naam string, diep struct<a:int>"
    for size, readers in ((5, 4), (23, 3), (1, 2), (100, 4)):
        df = files.paged(spark, [f"{url}/down", f"{url}/rows"], schema, size=size, readers=readers, query={"$order": "id"})
        assert df.rdd.getNumPartitions() == readers
        service["asked"].clear()
        assert sorted((int(r.id), r.naam, r.diep.a) for r in df.collect()) == [(k, f"é{k}", k) for k in range(23)]
        offsets = [int(q["$offset"]) for path, q in service["asked"] if path == "/rows"]
        assert len(offsets) == len(set(offsets)) and all(q["$order"] == "id" for path, q in service["asked"])
    service["data"].clear()
    assert files.paged(spark, f"{url}/rows", schema, size=5).count() == 0


def test_short_pages_and_failures_are_not_taken_for_the_end(spark, service):
    url = service["url"]
    service["cap"] = 4
    with pytest.raises(Exception, match="pages of 4 rows where 10 were asked for"):
        files.paged(spark, f"{url}/rows", "id string", size=10, readers=1).collect()
    service["cap"] = 1000
    with pytest.raises(Exception, match="503"):
        files.paged(spark, f"{url}/late", "id string", size=5).collect()
    with pytest.warns(UserWarning, match="left out"):
        part = files.paged(spark, f"{url}/late", "id string", size=5, optional=True)
    assert part.columns == ["id"] and part.count() == 0
    asked = sum(path == "/down" for path, _ in service["asked"])
    with pytest.raises(Exception, match="503"):
        files.paged(spark, f"{url}/down", "id string", size=5, readers=1, waits=(0.01, 0.01)).collect()
    assert sum(path == "/down" for path, _ in service["asked"]) - asked >= 3


def test_feature_service(spark, service):
    url = service["url"]
    for size in (None, 7):
        got = files.feature_service(spark, f"{url}/features", "id:string", size)
        assert sorted((int(r.id), r.kind, r.x, r.y) for r in got.collect()) == [(k, "point", float(k), 1.0) for k in range(23)]
    with pytest.warns(UserWarning, match="left out"):
        assert files.feature_service(spark, f"{url}/down", "id:string").count() == 0
