"""A run from written layers to written products, and its settings."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from waymark.plans import job, layers
from waymark.sources import files, sinks

LINE = "array<struct<x:double,y:double>>"
X0, Y0 = 180_000.0, 560_000.0


def line(a: float, b: float) -> list[tuple[float, float]]:
    return [(X0 + a, Y0), (X0 + b, Y0)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Ten homes along a road of ten ways, a shop at its end, a garage, a bus from the start to the shop."""
    root = tmp_path_factory.mktemp("lagen")
    box = lambda x, y: [[(X0 + x + dx, Y0 + y + dy) for dx, dy in ((-5, -5), (5, -5), (5, 5), (-5, 5), (-5, -5))]]
    homes = [("2026", f"p{k}", "ja" if k else "nee", f"b{k // 5}", f"Buurt {k // 5}", "80", "Leeuwarden", "polygon", box(400 * k + 10, 20)) for k in range(10)]
    # p3 has a second, smaller part far away
    homes.append((*homes[3][:8], [[(X0, Y0 + 900.0), (X0 + 1, Y0 + 900), (X0 + 1, Y0 + 901), (X0, Y0 + 900)]]))
    columns = "jaar string, pand_id string, is_woonpand string, buurtcode string, buurtnaam string, gemeentecode string, gemeentenaam string, kind string, polygon array<array<struct<x:double,y:double>>>"
    sinks.geopackage(spark.createDataFrame(homes, columns), f"{root}/bag_panden.gpkg", "panden", files=1)
    shop = spark.createDataFrame([("Winkel", X0 + 3990, Y0), (None, X0 + 90_000, Y0)], "naam string, px double, py double")
    sinks.geojson_document(shop, f"{root}/supermarkt.geojson", sinks.point_geometry(F.col("px"), F.col("py")), [F.col("px")], ["naam"])
    ways = [(f"w{k}", "true", "true" if k else None, m, None, "line", line(400 * k, 400 * (k + 1))) for k, m in [(k, 5.0) for k in range(10)]]
    kind = f"edge_id string, heen_toegestaan string, terug_toegestaan string, reistijd_min double, lengte_meter double, kind string, line {LINE}"
    sinks.geopackage(spark.createDataFrame(ways, kind), f"{root}/lopen", "wegen", files=2)
    spark.createDataFrame([(*w[:3], None, *w[4:]) for w in ways], kind).write.parquet(f"{root}/auto.parquet")
    spark.createDataFrame([(X0 + 3900, Y0)], "x double, y double").write.parquet(f"{root}/parkeren.parquet")
    gtfs = root / "gtfs"
    gtfs.mkdir()
    at = lambda x: spark.range(1).select(layers.g.rd_to_wgs84(F.lit(X0 + x), F.lit(Y0)).alias("p")).select("p.lon", "p.lat").first()
    a, b = at(0), at(4000)
    (gtfs / "agency.txt").write_text("agency_id,agency_name\n1,Arriva\n")
    (gtfs / "routes.txt").write_text("agency_id,route_id,route_short_name,route_long_name,route_type\n1,r,51,Lijn,3\n")
    (gtfs / "trips.txt").write_text("route_id,service_id,trip_id,trip_headsign,direction_id,shape_id\n" + "".join(f"r,s,t{h},,0,\n" for h in range(24)) + "r,weg,x,,0,\n")
    (gtfs / "stops.txt").write_text(f"stop_id,stop_name,stop_lat,stop_lon,platform_code\nA,Begin,{a.lat},{a.lon},\nB,Eind,{b.lat},{b.lon},\n")
    (gtfs / "stop_times.txt").write_text("trip_id,arrival_time,departure_time,stop_id,stop_sequence\n" + "".join(f"t{h},{h:02}:00:00,{h:02}:00:00,A,1\nt{h},{h:02}:05:00,{h:02}:05:00,B,2\n" for h in range(24)) + "x,12:30:00,12:30:00,A,1\nx,12:31:00,12:31:00,B,2\n")
    (gtfs / "calendar_dates.txt").write_text("service_id,date,exception_type\ns,20260616,1\nweg,20260616,2\n")
    return root


def settings_of(root, **more) -> dict:
    return {"panden": f"{root}/bag_panden.gpkg", "voorzieningen": f"{root}/supermarkt.geojson", "netwerken": {"lopen": f"{root}/lopen", "auto": f"{root}/auto.parquet"}, "parkeren": f"{root}/parkeren.parquet", "dienstregeling": f"{root}/gtfs", "jaar": 2026, "voorziening": "supermarkt", "uitvoer": f"{root}/uit", **more}


def test_layers(spark, folder):
    homes = {r.pand_id: r for r in layers.buildings(spark, f"{folder}/bag_panden.gpkg", 2026, "alle_panden").collect()}
    assert len(homes) == 10 and abs(homes["p3"].x - X0 - 1210) < 1e-6 and abs(homes["p3"].y - Y0 - 20) < 1e-6 and homes["p3"].buurtcode == "b0"
    assert layers.buildings(spark, f"{folder}/bag_panden.gpkg", 2026).count() == 9
    with pytest.raises(ValueError, match="not of 2025"):
        layers.buildings(spark, f"{folder}/bag_panden.gpkg", 2025)
    with pytest.raises(ValueError, match="woonpanden or alle_panden"):
        layers.buildings(spark, f"{folder}/bag_panden.gpkg", 2026, "huizen")
    with pytest.raises(Exception, match="missing columns niets"):
        files.geopackage(spark, f"{folder}/bag_panden.gpkg", {"niets": "string"}).collect()
    assert files.geopackage(spark, f"{folder}/bag_panden.gpkg", {"niets": "string"}, optional=["niets"]).where("niets is null").count() == 11
    ways = layers.road_network(spark, f"{folder}/auto.parquet", "auto").ways.orderBy("bron_id").collect()
    assert [round(w.minutes, 6) for w in ways] == [round(400 / 833.33, 6)] * 10 and all(w.forward and w.backward for w in ways) and ways[0].v == ways[1].u
    stops, rides = layers.timetable(spark, f"{folder}/gtfs", "20260616", 0, 86_399)
    assert stops.count() == 2 and sorted((r.dep, r.arr) for r in rides.collect()) == [(h * 3600, h * 3600 + 300) for h in range(24)]


def test_run_from_settings(spark, folder):
    (folder / "instellingen.json").write_text(json.dumps(settings_of(folder)))
    job.main([f"{folder}/instellingen.json", "--modi", "lopen,auto,ov_lopen"])
    root = f"{folder}/uit/supermarkt"
    rows = {(r.pand_id, r.modus): r for r in spark.read.parquet(f"{root}/resultaten.parquet").collect()}
    assert len(rows) == 27 and rows["p9", "lopen"].gekozen_naam == "Winkel" and rows["p9", "lopen"].within and not rows["p1", "lopen"].within
    assert rows["p1", "lopen"].total_min == 45.0 and rows["p1", "ov_lopen"].reistijd_bron == "ov" and rows["p9", "ov_lopen"].reistijd_bron == "direct_access"
    assert rows["p1", "auto"].reachable and rows["p1", "auto"].total_min < 8
    wide = spark.read.parquet(f"{root}/panden.parquet")
    assert wide.count() == 9 and "reistijd_supermarkt_ov_lopen_min" in wide.columns
    kaart = files.geopackage(spark, f"{root}/panden_kaart", {"pand_id": "string", "reistijd_supermarkt_lopen_min": "double"})
    assert {r.pand_id: r.reistijd_supermarkt_lopen_min for r in kaart.collect()} == {p: r.total_min for (p, m), r in rows.items() if m == "lopen"}
    assert spark.read.parquet(f"{root}/buurten.parquet").count() == 6 and spark.read.parquet(f"{root}/gemeenten.parquet").count() == 3


def test_settings_are_checked(folder):
    with pytest.raises(ValueError, match="missing panden"):
        job.checked({})
    with pytest.raises(ValueError, match="unknown kleur"):
        job.checked(settings_of(folder, kleur="rood"))
    with pytest.raises(ValueError, match="needs lopen"):
        job.checked(settings_of(folder, netwerken={"fiets": "x"}))
    assert job.config_of({"modi": "auto", "instellingen": {"max_snap_m": 100.0, "cycling_exceptions": ["0080"]}}).cycling_exceptions == ("0080",)
