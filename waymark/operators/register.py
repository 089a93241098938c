"""Building and address register: from towns down to buildings, and what buildings are used for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import geometry as g
from waymark.functions import text
from waymark.operators.relational import best_candidate, cascade, first_per_key, latest_valid, split_set, valid_in_years
from waymark.operators.spatial import points_in_polygons
from waymark.sources.files import register_objects

#: States of buildings that count, and the use code of dwellings.
IN_USE = ("Pand in gebruik", "Verbouwing pand")
DWELLING = "woonfunctie"


def towns_of(relations: DataFrame, municipalities: Sequence[str], years: Sequence[int]) -> DataFrame:
    """Towns of the municipalities on the first of January of any of the years; only definitive relations."""
    wanted = [m.rjust(4, "0") for m in municipalities]
    r = relations.select(text.padded(F.col("woonplaats_id"), 4).alias("woonplaats_id"), text.padded(F.col("gemeentecode"), 4).alias("gemeentecode"), F.expr("try_to_timestamp(begin)").alias("begin"), F.expr("try_to_timestamp(eind)").alias("eind"), "status")
    each = r.where(F.col("gemeentecode").isin(*wanted) & (F.col("status") == "definitief")).withColumn("_day", F.explode(F.array(*[F.make_timestamp(F.lit(y), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) for y in years])))
    return each.where((F.col("begin") <= F.col("_day")) & (F.col("eind").isNull() | (F.col("eind") > F.col("_day")))).select("woonplaats_id").distinct()


def selection(towns: DataFrame, town_table: DataFrame, streets: DataFrame, addresses: DataFrame, units: DataFrame, buildings: DataFrame) -> dict[str, DataFrame]:
    """Town, street, address, unit and building rows of the chosen towns, each kept by a semi-join with its parents.

    Of a town, street or address that occurs more than once one row stays; units come with a row per building.
    """
    one = lambda df, key: first_per_key(df, [key], [F.struct(*[c for c in df.columns])])
    kept = cascade([(town_table, "woonplaats_id", "woonplaats_id"), (streets, "woonplaats_id", "openbare_ruimte_id"), (addresses, "openbare_ruimte_id", "nummeraanduiding_id"), (units, "nummeraanduiding_id", "pand_id"), (buildings, "pand_id", "pand_id")], towns, "woonplaats_id")
    return {"woonplaatsen": one(kept[0], "woonplaats_id"), "openbare_ruimtes": one(kept[1], "openbare_ruimte_id"), "nummeraanduidingen": one(kept[2], "nummeraanduiding_id"), "verblijfsobjecten": kept[3], "panden": kept[4]}


def units_per_building(units: DataFrame, buildings: str = "pand_refs", uses: str = "gebruiksdoelen") -> DataFrame:
    """A row per unit and building; use codes as one text; the position as two numbers."""
    at = F.split(F.trim("positie"), r"\s+")
    rows = units.withColumn("pand_id", F.explode(buildings)).drop(buildings).withColumn(uses, F.array_join(uses, ";"))
    return rows.withColumn("vbo_x", F.get(at, F.lit(0)).try_cast("double")).withColumn("vbo_y", F.get(at, F.lit(1)).try_cast("double")).drop("positie") if "positie" in units.columns else rows


def link_table(units: DataFrame, addresses: DataFrame, streets: DataFrame, towns: DataFrame) -> DataFrame:
    """Units with address, street and town: left joins, each distinct row once."""
    named = streets.join(towns.select("woonplaats_id", "woonplaats_naam"), "woonplaats_id", "left")
    return units.join(addresses, "nummeraanduiding_id", "left").join(named, "openbare_ruimte_id", "left").distinct()


def buildings_by_year(buildings: DataFrame, units: DataFrame, years: Sequence[int]) -> DataFrame:
    """Buildings valid at the end of each year, with their units' links."""
    return valid_in_years(buildings, "pand_begin_geldigheid", "pand_eind_geldigheid", years).join(units, "pand_id", "left")


def current_units(units: DataFrame, year: int) -> DataFrame:
    """Unit relations valid at the end of a year, the latest record of each building and unit."""
    timed = units.withColumn("_b", F.expr("try_to_timestamp(vbo_begin_geldigheid)")).withColumn("_e", F.expr("try_to_timestamp(nullif(vbo_eind_geldigheid, ''))"))
    day = F.make_timestamp(F.lit(year), F.lit(12), F.lit(31), F.lit(0), F.lit(0), F.lit(0))
    return latest_valid(timed, ["pand_id", "verblijfsobject_id"], "_b", "_e", day, [F.col("_b").desc_nulls_last(), F.col("vbo_voorkomen_id").desc_nulls_last()]).drop("_b", "_e")


def use_summary(units: DataFrame) -> DataFrame:
    """Per building: units, units in use, dwellings, areas, the set of use codes, and whether anyone lives there."""
    area = text.decimal_number(F.col("oppervlakte"))
    lives = F.coalesce(F.lower("gebruiksdoelen").contains(DWELLING), F.lit(False))
    used = F.coalesce(F.lower("verblijfsobject_status").startswith("verblijfsobject in gebruik"), F.lit(False))
    exact = lambda c: F.bround(F.coalesce(F.sum(c), F.lit(0.0)), 2)
    rows = units.groupBy("pand_id").agg(
        F.count_distinct("verblijfsobject_id").alias("vbo_aantal"),
        F.count_if(used).alias("vbo_in_gebruik_aantal"),
        F.count_if(lives).alias("vbo_woonfunctie_aantal"),
        exact(area).alias("vbo_oppervlakte_totaal"),
        exact(F.when(lives, area)).alias("vbo_woonoppervlakte_totaal"),
    )
    codes = split_set(units.where("gebruiksdoelen is not null"), "gebruiksdoelen", ";", ["pand_id"], "gebruiksdoelen")
    return rows.join(codes, "pand_id", "left").withColumn("is_woonpand", F.col("vbo_woonfunctie_aantal") > 0)


def with_use(buildings: DataFrame, summary: DataFrame) -> DataFrame:
    """Buildings with their use, once each: a building that occurs twice in either table is an error."""
    for df, name in ((buildings, "buildings"), (summary, "summary")):
        if df.groupBy("pand_id").count().where("count > 1").head(1):
            raise ValueError(f"{name}: pand_id isn't unique")
    new = [c for c in summary.columns if c != "pand_id"]
    rows = buildings.drop(*new).join(summary, "pand_id", "left")
    return rows.fillna(False, ["is_woonpand"]).fillna(0.0, ["vbo_oppervlakte_totaal", "vbo_woonoppervlakte_totaal"])


def centroids(buildings: DataFrame, states: Sequence[str] = IN_USE[:1]) -> DataFrame:
    """Area, centre and its longitude and latitude of building polygons in the given states."""
    rows = buildings.where(F.col("pand_status").isin(*states) & F.col("polygon").isNotNull()).withColumn("_c", g.centroid(F.col("polygon")))
    at = g.rd_to_wgs84(F.col("_c.x"), F.col("_c.y"))
    return rows.select(*buildings.columns, F.bround(g.area(F.col("polygon")), 2).alias("pand_oppervlakte_m2"), F.bround("_c.x", 3).alias("pand_x"), F.bround("_c.y", 3).alias("pand_y"), F.bround(at["lon"], 8).alias("pand_lon"), F.bround(at["lat"], 8).alias("pand_lat"))


def with_neighbourhood(points: DataFrame, neighbourhoods: DataFrame, id_col: str = "pand_id") -> DataFrame:
    """Each building in the neighbourhood its centre lies in; one without any is an error, of several the first by code counts."""
    found = points_in_polygons(points.select(id_col, F.col("pand_x").alias("x"), F.col("pand_y").alias("y")), neighbourhoods)
    one = first_per_key(found, [id_col], [F.col("buurtcode")]).drop("x", "y", "polygon")
    rows = points.join(one, id_col, "left")
    if rows.where("buurtcode is null").head(1):
        raise ValueError("buildings without a neighbourhood")
    return rows


def checked_neighbourhoods(df: DataFrame, municipalities: int) -> DataFrame:
    """``df`` if its neighbourhood codes are unique and filled and it has so many municipalities."""
    row = df.agg(F.count("*").alias("n"), F.count_distinct("buurtcode").alias("codes"), F.count_distinct("gemeentecode").alias("gemeenten"), F.count_if(F.col("polygon").isNull()).alias("leeg")).first()
    if not row.n or row.n != row.codes or row.leeg or row.gemeenten != municipalities:
        raise ValueError(f"neighbourhoods: {row.asDict()}")
    return df


def garages(areas: DataFrame, exits: DataFrame, positions: DataFrame, addresses: DataFrame) -> DataFrame:
    """Entrances of parking garages with their position and address: areas named as garages, exits by both area keys.

    References of positions and addresses count only where they are of the kind I-O.
    """
    named = areas.where(F.lower(F.coalesce("areadesc", F.lit(""))).rlike("garage|parkeergarage|parking"))
    at = positions.where("locationreferencetype = 'I-O'").select(F.col("locationreference").alias("_l"), F.col("longitude").try_cast("double").alias("longitude"), F.col("latitude").try_cast("double").alias("latitude"))
    where = addresses.where("parkingaddressreferencetype = 'I-O'").select(F.col("parkingaddressreference").alias("_a"), "streetname", "housenumber", "zipcode")
    rows = exits.join(named.select("areamanagerid", "areaid", "areadesc"), ["areamanagerid", "areaid"])
    return rows.join(at, F.col("entranceexitid") == F.col("_l"), "left").join(where, F.col("entranceexitid") == F.col("_a"), "left").drop("_l", "_a")


def match_garages(garage_points: DataFrame, buildings: DataFrame, addresses: DataFrame) -> DataFrame:
    """Garages (garage_id, x, y, adres_key) to buildings: by the building around the point, else by address.

    ``addresses`` has adres_key and pand_id. Adds match_pand_id, bag_match_type and, where both are known, whether the address
    confirms the point.
    """
    known = addresses.where("adres_key <> ''").groupBy("adres_key").agg(F.array_sort(F.collect_set("pand_id")).alias("_ids"))
    inside = first_per_key(points_in_polygons(garage_points.where("x is not null and y is not null").select("garage_id", "x", "y"), buildings.select(F.col("pand_id").alias("punt_pand_id"), "polygon")), ["garage_id"], [F.col("punt_pand_id")]).select(F.col("garage_id").alias("_g"), "punt_pand_id")
    rows = garage_points.join(known, "adres_key", "left").join(inside, F.col("garage_id") == F.col("_g"), "left")
    by_address = F.get("_ids", F.lit(0))
    placed = F.col("x").isNotNull() & F.col("y").isNotNull()
    out = best_candidate(rows, [("punt_binnen_pand", F.col("punt_pand_id").isNotNull(), F.col("punt_pand_id")), ("adres_fallback_punt_niet_in_pand", by_address.isNotNull() & placed, by_address), ("adres_fallback_geen_punt", by_address.isNotNull(), by_address)])
    confirmed = F.when(F.col("punt_pand_id").isNotNull() & F.col("_ids").isNotNull(), F.array_contains("_ids", F.col("punt_pand_id")))
    return out.select(*garage_points.columns, F.col("match").alias("match_pand_id"), F.col("match_type").alias("bag_match_type"), confirmed.alias("bag_adres_valideert_punt"), F.col("match").isNotNull().alias("bag_gevalideerd"))


def still_valid(df: DataFrame, end: str, day: str) -> DataFrame:
    """Rows without an end or with one on or behind a day (yyyy-mm-dd); all rows if there is no such column."""
    if end not in df.columns:
        return df
    when = F.expr(f"try_to_timestamp(nullif(cast(`{end}` as string), ''))")
    return df.where(when.isNull() | (when >= F.lit(day).cast("timestamp")))


#: Columns of a building and the register's elements they come from.
BUILDING_FIELDS = {
    "pand_id": "identificatie",
    "bouwjaar": "oorspronkelijkBouwjaar",
    "pand_status": "status",
    "pand_documentdatum": "documentdatum",
    "pand_documentnummer": "documentnummer",
    "pand_geconstateerd": "geconstateerd",
    "pand_voorkomen_id": "voorkomenidentificatie",
    "pand_begin_geldigheid": "beginGeldigheid",
    "pand_eind_geldigheid": "eindGeldigheid",
    "pand_tijdstip_registratie": "tijdstipRegistratie",
    "pand_eind_registratie": "eindRegistratie",
    "pand_tijdstip_registratie_lv": "tijdstipRegistratieLV",
    "pand_tijdstip_eind_registratie_lv": "tijdstipEindRegistratieLV",
    "pand_geometrie_poslist": "posList",
}


#: The same for towns, streets, addresses and units.
TOWN_FIELDS = {"woonplaats_id": "identificatie", "woonplaats_naam": "naam"}
STREET_FIELDS = {"openbare_ruimte_id": "identificatie", "openbare_ruimte_naam": "naam", "openbare_ruimte_type": "type", "woonplaats_id": "WoonplaatsRef"}
ADDRESS_FIELDS = {
    "nummeraanduiding_id": "identificatie",
    "openbare_ruimte_id": "OpenbareRuimteRef",
    "huisnummer": "huisnummer",
    "huisletter": "huisletter",
    "huisnummertoevoeging": "huisnummertoevoeging",
    "postcode": "postcode",
    "nummeraanduiding_status": "status",
}
UNIT_FIELDS = {
    "pand_refs": "PandRef",
    "verblijfsobject_id": "identificatie",
    "nummeraanduiding_id": "NummeraanduidingRef",
    "gebruiksdoelen": "gebruiksdoel",
    "oppervlakte": "oppervlakte",
    "verblijfsobject_status": "status",
    "vbo_voorkomen_id": "voorkomenidentificatie",
    "vbo_begin_geldigheid": "beginGeldigheid",
    "vbo_eind_geldigheid": "eindGeldigheid",
    "vbo_tijdstip_registratie": "tijdstipRegistratie",
    "vbo_eind_registratie": "eindRegistratie",
    "positie": "pos",
}


def register_tables(spark: SparkSession, folder: str, most: int | None = None) -> dict[str, DataFrame]:
    """Towns, streets, addresses, units (a row per building) and buildings of a folder of register archives, told by their names."""
    def rows(kind: str, name: str, fields: dict[str, str], lists: Sequence[str] = ()) -> DataFrame:
        return register_objects(spark, f"{folder.rstrip('/')}/9999{kind}*.zip", name, fields, lists, most)

    towns = rows("WPL", "Woonplaats", TOWN_FIELDS).withColumn("woonplaats_id", text.padded(F.coalesce("woonplaats_id", F.lit("")), 4))
    units = units_per_building(rows("VBO", "Verblijfsobject", UNIT_FIELDS, ["pand_refs", "gebruiksdoelen"]))
    return {
        "woonplaatsen": towns,
        "openbare_ruimtes": rows("OPR", "OpenbareRuimte", STREET_FIELDS),
        "nummeraanduidingen": rows("NUM", "Nummeraanduiding", ADDRESS_FIELDS),
        "verblijfsobjecten": units,
        "panden": building_rows(spark, f"{folder.rstrip('/')}/9999PND*.zip", most),
    }


def register_of(spark: SparkSession, folder: str, relations: DataFrame, municipalities: Sequence[str], years: Sequence[int], most: int | None = None) -> dict[str, DataFrame]:
    """The register's tables for the towns of some municipalities, and ``koppeltabel``, their units with address, street and town."""
    t = register_tables(spark, folder, most)
    kept = selection(towns_of(relations, municipalities, years), t["woonplaatsen"], t["openbare_ruimtes"], t["nummeraanduidingen"], t["verblijfsobjecten"], t["panden"])
    return kept | {"koppeltabel": link_table(kept["verblijfsobjecten"], kept["nummeraanduidingen"], kept["openbare_ruimtes"], kept["woonplaatsen"])}


def building_rows(spark: SparkSession, paths: str | Sequence[str], most: int | None = None) -> DataFrame:
    """Buildings of the register's archives: the archive and the file that each comes from, and ``BUILDING_FIELDS``."""
    return register_objects(spark, paths, "Pand", BUILDING_FIELDS, most=most, origin=("zip_bestand", "xml_bestand"))


def town_per_building(links: DataFrame) -> DataFrame:
    """The town of each building from the link table, by normalised id; of several the first by name, empty ones don't count."""
    rows = links.select(text.plain_id(F.col("pand_id")).alias("_pand"), F.col("pand_id"), text.blank_to_null(F.col("woonplaats_naam")).alias("woonplaats_naam"))
    return rows.where("_pand <> '' and woonplaats_naam is not null").groupBy("_pand").agg(F.min(F.struct("woonplaats_naam", "pand_id")).alias("_first")).select("_first.pand_id", "_first.woonplaats_naam")


def in_municipalities(buildings: DataFrame, codes: Sequence[str], column: str = "gemeentecode") -> DataFrame:
    """Buildings of some municipalities, their codes written in any form; without codes all of them."""
    wanted = [c.strip().upper().removeprefix("GM").rjust(4, "0") for c in codes]
    return buildings.where(text.municipality_code(F.col(column)).isin(*wanted)) if wanted else buildings
