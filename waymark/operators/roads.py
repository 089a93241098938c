"""Road networks per vehicle: who may use a way in which direction, at what speed, and how sources are merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import geometry as g
from waymark.functions import text
from waymark.operators.spatial import _cells, dealt, points_in_polygons

#: Flag columns of each vehicle, forward and backward.
VEHICLES = {"voetganger": "vtgngr", "fiets": "fiets", "snorfiets": "snrfts", "bromfiets": "brmfts", "motorfiets": "mtrfts", "personenauto": "auto", "motorvoertuigen_met_aanhanger": "aanhngr", "vrachtauto": "vrchtt", "autobus": "autobs", "landbouwvoertuigen": "lndbw"}
#: Vehicles that go by the road's own speed and lanes, and those for which parking counts.
MOTORISED = ("motorfiets", "personenauto", "motorvoertuigen_met_aanhanger", "vrachtauto", "autobus")
PARKING = ("motorfiets", "personenauto", "motorvoertuigen_met_aanhanger")
#: km/h where the road has no speed of its own.
SPEED_KMH = {"voetganger": 4.8, "voetganger_osm": 4.8, "fiets": 15.0, "fiets_osm": 15.0, "snorfiets": 25.0, "bromfiets": 45.0, "motorfiets": 50.0, "personenauto": 50.0, "motorvoertuigen_met_aanhanger": 50.0, "vrachtauto": 50.0, "autobus": 50.0, "landbouwvoertuigen": 25.0}
#: Map tags of ways for walking and cycling.
WALK_TAGS = ("footway", "path", "pedestrian", "steps", "track")
CYCLE_TAGS = ("cycleway", "path", "track", "living_street", "residential", "service", "unclassified", "tertiary", "secondary", "primary")


def _yes(column: str) -> Column:
    return F.coalesce(text.yes_no(F.col(column)) == "J", F.lit(False))


def flags_per_segment(df: DataFrame, key: str = "wvk_id") -> DataFrame:
    """One row per segment: a flag holds if any of its rows says so."""
    columns = [f"{stem}_{d}" for stem in VEHICLES.values() for d in "ht"]
    return df.groupBy(key).agg(*[F.when(F.bool_or(_yes(c)), "J").otherwise("N").alias(c) for c in columns if c in df.columns])


def categories_per_segment(df: DataFrame, key: str = "wvk_id", category: str = "weg_cat") -> DataFrame:
    """The sorted distinct categories of a segment as a list and as text."""
    rows = df.groupBy(key).agg(F.array_sort(F.collect_set(text.blank_to_null(F.col(category)))).alias("wegcategorieen"))
    return rows.withColumn("wegcategorie", F.array_join("wegcategorieen", "; "))


def road_speed(df: DataFrame, *columns: str) -> DataFrame:
    """``max_snelheid_kmh``: the largest of the speed columns that exist, nulls aside."""
    numbers = [text.decimal_number(F.col(c)) for c in columns if c in df.columns]
    return df.withColumn("max_snelheid_kmh", F.greatest(*numbers) if len(numbers) > 1 else numbers[0])


def parking_counts(points: DataFrame, areas: DataFrame, key: str = "wvk_id") -> DataFrame:
    """Parking points and areas per segment: a full outer join of both counts."""
    a = points.groupBy(key).agg(F.count("*").alias("parkeerpunten_aantal"))
    b = areas.groupBy(key).agg(F.count("*").alias("parkeervlakken_aantal"), F.sum(text.decimal_number(F.col("oppervlak"))).alias("parkeervlakken_oppervlak_m2"))
    zero = F.lit(0)
    return a.join(b, key, "full_outer").select(key, F.coalesce("parkeerpunten_aantal", zero).alias("parkeerpunten_aantal"), F.coalesce("parkeervlakken_aantal", zero).alias("parkeervlakken_aantal"), F.coalesce("parkeervlakken_oppervlak_m2", F.lit(0.0)).alias("parkeervlakken_oppervlak_m2"))


def with_attributes(base: DataFrame, *others: DataFrame, key: str = "wvk_id") -> DataFrame:
    """Left joins of attribute tables by segment."""
    for other in others:
        base = base.join(other, key, "left")
    return base


def unknown_base_road() -> Column:
    """No vehicle has access and no category says anything."""
    columns = [f"{stem}_{d}" for stem in VEHICLES.values() for d in "ht"]
    nobody = ~_any([_yes(c) for c in columns])
    known = F.exists(F.coalesce("wegcategorieen", F.array().cast("array<string>")), lambda c: ~F.lower(F.trim(c)).isin("", "onbekend"))
    return nobody & ~known


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def access(df: DataFrame, vehicle: str, on_water: str = "op_water") -> DataFrame:
    """Ways a vehicle may use, with ``heen_toegestaan``, ``terug_toegestaan`` and where the right comes from.

    Flags decide. A road that no vehicle's flags and no category know is added in the direction of its source (B, H, T;
    anything else both ways). Nothing on water counts.
    """
    stem = VEHICLES[vehicle]
    there, back = _yes(f"{stem}_h"), _yes(f"{stem}_t")
    wet = F.coalesce(F.col(on_water), F.lit(False))
    extra = unknown_base_road() & ~wet
    direction = F.coalesce(text.yes_no(F.col("richting_bron")), F.lit(""))
    open_ = ~direction.isin("B", "H", "T")
    rows = df.withColumn("_in", (there | back | extra) & ~wet).where("_in").drop("_in")
    return rows.withColumn("heen_toegestaan", there | (extra & (direction.isin("B", "H") | open_))).withColumn("terug_toegestaan", back | (extra & (direction.isin("B", "T") | open_))).withColumn("selectie_bron", F.when(there | back, "toegang").otherwise("aanvulling_onbekend")).withColumn("verkeerstype", F.lit(vehicle))


def costs(df: DataFrame, vehicle: str) -> DataFrame:
    """Length (the source's, else the geometry's), speed and minutes."""
    length = F.coalesce(text.decimal_number(F.col("lengte_meter")), g.length(F.col("line"))) if "lengte_meter" in df.columns else g.length(F.col("line"))
    usual = F.lit(SPEED_KMH.get(vehicle, 50.0))
    speed = F.coalesce(F.col("max_snelheid_kmh"), usual) if vehicle in MOTORISED and "max_snelheid_kmh" in df.columns else usual
    rows = df.withColumn("lengte_meter", length).withColumn("snelheid_kmh_gebruikt", speed)
    return rows.withColumn("reistijd_min", F.col("lengte_meter") / (F.col("snelheid_kmh_gebruikt") * 1000 / 60))


def vehicle_columns(df: DataFrame, vehicle: str) -> DataFrame:
    """Lane and parking columns only for the vehicles they matter to, filled there."""
    parking = ["parkeerpunten_aantal", "parkeervlakken_aantal", "parkeervlakken_oppervlak_m2"]
    if vehicle not in MOTORISED:
        df = df.drop("rijstroken_aantal")
    elif "rijstroken_aantal" in df.columns:
        df = df.fillna({"rijstroken_aantal": 0})
    if vehicle not in PARKING:
        return df.drop(*parking, "parkeren_gekoppeld")
    have = [c for c in parking if c in df.columns]
    df = df.fillna(dict.fromkeys(have, 0))
    counts = [F.col(c) for c in have if c.endswith("aantal")]
    return df.withColumn("parkeren_gekoppeld", sum(counts, F.lit(0)) > 0)


def on_water(ways: DataFrame, water: DataFrame, key: str = "wvk_id") -> DataFrame:
    """``op_water``: whether the middle of a way lies within a water polygon."""
    middle = g.interpolate(F.col("line"), g.length(F.col("line")) / 2)
    points = ways.select(F.col(key).alias("_key"), middle["x"].alias("x"), middle["y"].alias("y"))
    wet = points_in_polygons(points, water.select("polygon")).select("_key").distinct()
    return ways.join(wet, F.col(key) == F.col("_key"), "left").withColumn("op_water", F.col("_key").isNotNull()).drop("_key")


def map_ways(df: DataFrame, tags: tuple[str, ...], vehicle: str, two_way: bool = True) -> DataFrame:
    """Ways of a map source with one of the tags; one way where oneway:bicycle or else oneway says so."""
    rows = df.where(F.arrays_overlap(text.list_text(F.col("highway")), F.array(*[F.lit(t) for t in tags])))
    one_way = F.lit(False)
    for column in ("oneway", "oneway:bicycle"):
        if column in df.columns:
            values = text.list_text(F.col(f"`{column}`"))
            yes, no = (F.arrays_overlap(values, F.array(*[F.lit(w) for w in words])) for words in (("yes", "true", "1"), ("no", "false", "0")))
            one_way = F.when(yes, True).when(no, False).otherwise(one_way)
    back = ~one_way if two_way else F.lit(False)
    return costs(rows.withColumn("verkeerstype", F.lit(vehicle)).withColumn("heen_toegestaan", F.lit(True)).withColumn("terug_toegestaan", back), vehicle)


def merged(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Roads and map ways together; nothing is taken out."""
    return base.unionByName(extra, allowMissingColumns=True)


def _apart(s: Column, t: Column) -> Column:
    """Distance of two straight segments: 0 where they cross, else the least of their ends from the other one."""
    turn = lambda p, q, r: (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])
    crosses = (turn(s["a"], s["b"], t["a"]) * turn(s["a"], s["b"], t["b"]) < 0) & (turn(t["a"], t["b"], s["a"]) * turn(t["a"], t["b"], s["b"]) < 0)
    ends = [g.project(p["x"], p["y"], F.array(o["a"], o["b"]))["distance"] for p, o in ((s["a"], t), (s["b"], t), (t["a"], s), (t["b"], s))]
    return F.when(crosses, 0.0).otherwise(F.least(*ends))


def shared_with_cars(ways: DataFrame, cars: DataFrame, near: float = 1.0, most: float = 25.0) -> DataFrame:
    """Whether ways are shared with cars: the same segment id, or any part of them within ``near`` metres of a car way.

    Adds ``afstand_tot_auto_m`` (null beyond ``most``), ``overlap_met_auto``, ``overlap_auto_wvk_id`` (the smallest id of the car ways that near)
    and ``gedeeld_met_auto``. Straight parts of both meet on grid cells, parts of long lines in each cell that their box touches.
    """
    size = max(4 * most, 1.0)

    def spread(df: DataFrame, name: str, grow: float) -> DataFrame:
        each = df.withColumn(name, F.explode(g.segments(F.col("line")))).drop("line")
        a, b = F.col(f"{name}.a"), F.col(f"{name}.b")
        return each.withColumn(f"_{name}_cell", F.explode(_cells(F.least(a["x"], b["x"]) - grow, F.least(a["y"], b["y"]) - grow, F.greatest(a["x"], b["x"]) + grow, F.greatest(a["y"], b["y"]) + grow, size)))

    left = spread(ways.select(F.col("edge_id").alias("_e"), "line"), "s", 0.0)
    right = spread(cars.select(F.col("wvk_id").alias("_auto"), "line"), "t", most)
    met = dealt(left, F.col("_s_cell")).join(dealt(right, F.col("_t_cell")), F.col("_s_cell") == F.col("_t_cell"))
    # generated, so that the distance is worked out once and not again for each use
    pairs = met.select("_e", "_auto", F.explode(F.array(_apart(F.col("s"), F.col("t")))).alias("_far")).where(F.col("_far") <= most)
    close = pairs.groupBy("_e").agg(F.min("_far").alias("afstand_tot_auto_m"), F.min(F.when(F.col("_far") <= near, F.col("_auto"))).alias("overlap_auto_wvk_id"), F.bool_or(F.col("_far") <= near).alias("_over"))
    ids = cars.select(F.col("wvk_id").alias("_car")).where("_car is not null").distinct()
    rows = ways.join(ids, F.col("wvk_id") == F.col("_car"), "left").join(close, F.col("edge_id") == F.col("_e"), "left").withColumn("overlap_met_auto", F.coalesce("_over", F.lit(False)))
    return rows.withColumn("gedeeld_met_auto", F.col("_car").isNotNull() | F.col("overlap_met_auto")).drop("_car", "_e", "_over")
