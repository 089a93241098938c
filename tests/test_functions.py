"""Scalar functions on hand-made values."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from waymark.functions import classes, geometry, text, times


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column).first()[0]


@pytest.mark.parametrize(("value", "want"), [("25:10:00", 90600), ("08:00:05", 28805), ("", None), ("8:00", None), ("a:b:c", None), (None, None)])
def test_seconds(spark, value, want):
    assert one(spark, times.seconds_of(F.col("v")), v=value) == want


def test_clock(spark):
    assert one(spark, times.clock(F.lit(90600))) == "25:10:00"
    assert one(spark, times.clock(F.lit(None).cast("bigint"))) == ""


@pytest.mark.parametrize(("end", "valid"), [("2026-12-31", False), ("2027-01-01", True), ("", True), (None, True)])
def test_validity(spark, end, valid):
    assert one(spark, times.valid_on(F.lit("2026-12-31"), F.col("e"), F.lit("2026-12-31")), e=end) is valid


@pytest.mark.parametrize(("value", "want"), [("GM85", "0085"), (" 1900 ", "1900"), ("123456", "123456")])
def test_municipality(spark, value, want):
    assert one(spark, text.municipality_code(F.col("v")), v=value) == want


def test_address_keys_agree(spark):
    a = one(spark, text.address_keys(F.lit("Stationsstr"), F.lit("12-a"), F.lit("8911 ab"), F.lit("Súdwest")))
    b = one(spark, text.address_keys(F.lit("Stationsstraat"), F.lit("12 A"), F.lit("8911AB"), F.lit("Sudwest")))
    assert a == b
    assert one(spark, text.street(F.lit("J. de Vriesln"))) == "johan de vrieslaan"
    assert one(spark, text.street(F.lit("Dijkstrjitte"))) == "dykstraat"


def test_text_set(spark):
    df = spark.createDataFrame([("b",), ("a",), ("nan",), ("",), ("a",), (None,)], "v string")
    assert df.agg(text.text_set(F.col("v"))).first()[0] == "a, b"


def test_list_text(spark):
    assert one(spark, text.list_text(F.col("v")), v="['Path', 'steps']") == ["path", "steps"]
    assert one(spark, text.list_text(F.col("v")), v="Path") == ["path"]


@pytest.mark.parametrize(("p", "want"), [(19.99, "0-20%"), (20.0, "20-40%"), (80.0, "80-100%"), (100.0, "80-100%")])
def test_bands(spark, p, want):
    assert one(spark, classes.area_band(F.col("p"))["klasse"], p=p) == want


def test_band_without_data(spark):
    assert one(spark, classes.area_band(F.lit(None).cast("double"))["klasse"]) == "geen data"


def test_isochrone_limits():
    assert classes.isochrone_limits(15) == [5.0, 10.0, 15.0]
    assert classes.isochrone_limits(30) == [10.0, 20.0, 30.0]
    assert classes.isochrone_limits(25) == [8.3, 16.7, 25.0]


def test_missing_mode_is_no_shortage(spark):
    n = F.lit(None).cast("double")
    row = spark.range(1).select(classes.problem_type(F.lit(90.0), n, F.lit(85.0), n, n, F.lit(0)).alias("p"), classes.severity(F.lit(90.0), F.lit(85.0), F.lit(0)).alias("s")).first()
    assert (row.p, row.s) == ("voldoende", "voldoende")


def test_best_mode_ties(spark):
    times_ = {"lopen": F.lit(5.0), "fiets": F.lit(5.0), "auto": F.lit(3.0)}
    assert one(spark, classes.best_mode(times_, {"lopen": F.lit(True), "fiets": F.lit(True), "auto": F.lit(False)})) == "lopen"


def polygon(points):
    return F.array(F.array(*[geometry.point(F.lit(float(x)), F.lit(float(y))) for x, y in points]))


def test_polygon_kernels(spark):
    square = polygon([(0, 0), (4, 0), (4, 2), (0, 2), (0, 0)])
    row = spark.range(1).select(geometry.area(square).alias("a"), geometry.centroid(square).alias("c"), geometry.within(F.lit(1.0), F.lit(1.0), square).alias("i"), geometry.within(F.lit(4.0), F.lit(1.0), square).alias("b"), geometry.within(F.lit(5.0), F.lit(1.0), square).alias("o"), geometry.interior_point(square).alias("p")).first()
    assert row.a == 8 and (row.c.x, row.c.y) == (2, 1) and (row.i, row.b, row.o) == (True, False, False) and 0 < row.p.x < 4


def test_line_kernels(spark):
    line = F.array(*[geometry.point(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (3.0, 4.0), (3.0, 10.0))])
    row = spark.range(1).select(geometry.length(line).alias("l"), geometry.project(F.lit(5.0), F.lit(6.0), line).alias("p"), geometry.interpolate(line, F.lit(7.0)).alias("i"), geometry.substring(line, F.lit(9.0), F.lit(2.5)).alias("s")).first()
    assert row.l == 11 and (row.p.distance, row.p.position) == (2, 7) and (row.i.x, row.i.y) == (3, 6)
    assert [(round(p.x, 6), round(p.y, 6)) for p in row.s] == [(3, 8), (3, 4), (1.5, 2)]


def test_grid_round_trip(spark):
    random.seed(2)
    rows = [(random.uniform(120000, 220000), random.uniform(540000, 610000)) for _ in range(50)]
    df = spark.createDataFrame(rows, "x double, y double").withColumn("w", geometry.rd_to_wgs84(F.col("x"), F.col("y")))
    for r in df.withColumn("b", geometry.wgs84_to_rd(F.col("w.lon"), F.col("w.lat"))).collect():
        assert math.hypot(r.b.x - r.x, r.b.y - r.y) < 1
    centre = spark.range(1).select(geometry.rd_to_wgs84(F.lit(155000.0), F.lit(463000.0)).alias("c")).first().c
    assert abs(centre.lon - 5.38720621) < 1e-9 and abs(centre.lat - 52.1551744) < 1e-9


def test_ring_of(spark):
    ring = spark.range(1).select(geometry.ring_of(F.lit("0 0 9 1 0 9 1 1 9"), 3).alias("r")).first().r
    assert [(p.x, p.y) for p in ring] == [(0, 0), (1, 0), (1, 1), (0, 0)]
