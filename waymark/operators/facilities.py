"""Facilities: which tagged places count, where their data comes from, and how schools find their building."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import text
from waymark.operators.relational import best_candidate, dense_numbers, first_per_key
from waymark.operators.spatial import nearest_edges

#: Words that make or break a facility of each kind.
PHARMACY_NAMES = ("benu", "service apotheek", "alphega", "mediq", "plinthos", "apotheek")
PHARMACY_NOT = ("dierenapotheek", "afhaalkluis", "medicijnkluis")
GP_NAMES = ("huisarts", "huisartsen", "huisartsenpraktijk", "huisartsenmaatschap", "gezondheidscentrum", "medisch centrum", "dokter", "dokters", "praktijk", "maatschap")
GP_NOT = ("tandarts", "dierenarts", "fysiotherapie", "fysio", "huidtherapie", "orthodontie", "logopedie", "psycholoog", "acupunctuur", "podotherapie", "dierenkliniek", "kliniek voor gezelschapsdieren", "oogarts", "verloskundigen", "ehbo", "ggd", "ggz", "neuropsychiatrie", "pedicure", "voetverzorging", "voetzorg", "leren", "pynter", "ziekenhuis", "ambulance")
GREEN_NOT = ("privé", "private", "achtertuin", "volkstuinvereniging")
GREEN_TYPES = ("leisure_park", "landuse_recreation_ground", "leisure_garden", "leisure_playground", "boundary_national_park", "leisure_nature_reserve")
SPORT_NOT = ("privé", "private", "achtertuin", "prive")
SPORT_TYPES = ("sports_centre", "pitch", "sports_hall", "stadium", "track", "swimming_pool", "horse_riding")
SUPERMARKETS = ("Albert Heijn", "Albert Heijn XL", "ALDI", "Dirk", "Jumbo", "Lidl", "PLUS", "Poiesz", "SPAR", "Coop")
SUPERMARKET_NOT = ("pick-up", "pickup")
#: Words that name each level of secondary education.
SECONDARY_LEVELS = {"vmbo": ("vbo", "vmbo"), "mavo": ("mavo",), "havo": ("havo",), "vwo": ("vwo", "ath", "atheneum"), "pro": ("pro",), "brugjaar": ("brugjaar",)}


def decide(exclude: Column, include: Sequence[Column]) -> Column:
    """Whether something counts: not if excluded, else if one of the conditions holds; nulls hold nothing."""
    out = F.lit(False)
    for c in include:
        out = out | F.coalesce(c, F.lit(False))
    return out & ~F.coalesce(exclude, F.lit(False))


def tag(df: DataFrame, name: str) -> Column:
    """A tag as plain text, from its own column or from a map column ``tags``; empty where there is neither."""
    if name in df.columns:
        return text.plain(F.col(f"`{name}`"))
    return text.plain(F.try_element_at(F.col("tags"), F.lit(name))) if "tags" in df.columns else F.lit("")


def is_pharmacy(df: DataFrame) -> Column:
    name = tag(df, "name")
    return decide(text.contains_any(name, PHARMACY_NOT), [tag(df, "amenity") == "pharmacy", tag(df, "healthcare") == "pharmacy", text.contains_any(F.concat_ws(" ", name, tag(df, "brand")), PHARMACY_NAMES)])


def is_general_practice(df: DataFrame) -> Column:
    name = tag(df, "name")
    return decide(text.contains_any(name, GP_NOT), [tag(df, "healthcare:speciality").contains("general"), text.contains_any(name, GP_NAMES), tag(df, "amenity") == "doctors", tag(df, "healthcare") == "doctor"])


def is_supermarket(df: DataFrame) -> Column:
    name, brand, chains = tag(df, "name"), tag(df, "brand"), [c.lower() for c in SUPERMARKETS]
    known = brand.isin(*chains) | name.isin(*chains)
    for c in chains:
        known = known | name.startswith(c + " ")
    return decide((tag(df, "shop") != "supermarket") | text.contains_any(name, SUPERMARKET_NOT), [known])


def is_public_green(df: DataFrame) -> Column:
    name, kind = tag(df, "name"), tag(df, "match_type")
    garden = F.coalesce(F.nullif(tag(df, "garden:type"), F.lit("")), tag(df, "garden_type"))
    closed = tag(df, "access").isin("private", "no", "members_only") | tag(df, "private").isin("yes", "true") | garden.isin("private", "residential")
    return decide(closed | text.contains_any(name, GREEN_NOT) | ((kind == "leisure_garden") & (name == "")), [kind.isin(*GREEN_TYPES)])


def is_public_sport(df: DataFrame) -> Column:
    closed = tag(df, "access").isin("private", "no", "members_only", "membership") | tag(df, "private").isin("yes", "true")
    municipal = (tag(df, "osm_type") == "municipal_wfs") | (tag(df, "source") == "gemeente_swf")
    return decide(closed | text.contains_any(tag(df, "name"), SPORT_NOT), [municipal, tag(df, "leisure").isin(*SPORT_TYPES)])


RULES = {"apotheek": is_pharmacy, "huisarts": is_general_practice, "supermarkt": is_supermarket, "recreatief_groen": is_public_green, "sport": is_public_sport}


def validated(df: DataFrame, near: bool, radius: float = 50.0) -> Column:
    """Whether a building stands behind a facility; with ``near`` the match must lie within it or ``radius``.

    Registers named beside the map count as validation too, or the reliability classes gold and silver.
    """
    flag = text.text_flag(F.col("bag_gevalideerd"))
    if not near:
        return flag
    if "bronnen" in df.columns:
        named = F.filter(F.transform(F.split(F.coalesce("bronnen", F.lit("")), ","), lambda t: F.trim(t)), lambda s: (s != "") & (s != "osm"))
        flag = F.size(named) > 0
    elif "betrouwbaarheid" in df.columns:
        flag = flag | F.coalesce(F.col("betrouwbaarheid").isin("Goud", "Zilver"), F.lit(False))
    return flag & ((F.col("bag_match_type") == "within") | ((F.col("bag_match_type") == "nearest") & (F.col("bag_afstand_meter") <= radius)))


def select_facilities(df: DataFrame, kind: str, extra: DataFrame | None = None, id_col: str | None = None) -> DataFrame:
    """Facilities of a kind that count and are validated; columns only ``extra`` has come along by id."""
    if extra is not None and id_col:
        more = [c for c in extra.columns if c not in df.columns]
        df = df.join(extra.select(F.col(id_col).cast("string").alias("_id"), *more), F.col(id_col).cast("string") == F.col("_id"), "left").drop("_id")
    return df.where(RULES[kind](df) & F.coalesce(validated(df, kind in ("recreatief_groen", "sport")), F.lit(False)))


def elements(json: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """Map elements of a parsed document (column ``elements``) as points: element_type, element_id, lon, lat, tags.

    Nodes have their own place, ways and relations their centre; without one they drop out, as do those in ``skip``. Of
    an element that occurs twice the first in the list counts.
    """
    e = json.select(F.posexplode("elements").alias("_pos", "e"))
    rows = e.select("_pos", F.col("e.type").alias("element_type"), F.col("e.id").alias("element_id"), F.coalesce("e.lon", "e.center.lon").alias("lon"), F.coalesce("e.lat", "e.center.lat").alias("lat"), F.col("e.tags").alias("tags")).where("lon is not null and lat is not null")
    if skip is not None:
        rows = rows.join(skip, ["element_type", "element_id"], "left_anti")
    return first_per_key(rows, ["element_type", "element_id"], [F.col("_pos")]).drop("_pos")


ELEMENTS = "elements array<struct<type:string,id:bigint,lon:double,lat:double,center:struct<lon:double,lat:double>,tags:map<string,string>>>"


def match_type(tags: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """The first of (key, value) tags that is set, as ``key_value``."""
    out = F.lit("overig")
    for k, v in reversed(list(pairs)):
        out = F.when(F.try_element_at(tags, F.lit(k)) == v, F.lit(f"{k}_{v}")).otherwise(out)
    return out


def school_level(df: DataFrame) -> DataFrame:
    """Level of education from source and structure, and the secondary levels that the structure names."""
    source, structure = text.plain(F.col("bron")), text.plain(F.col("ONDERWIJSSTRUCTUUR"))
    level = F.when(source.isin("basisonderwijs", "vo", "mbo"), source).when((source == "hbo_wo") & structure.isin("hbo", "wo"), structure)
    comparable = text.comparable(F.col("ONDERWIJSSTRUCTUUR"))
    named = [F.when(comparable.rlike(r"\b(" + "|".join(words) + r")\b"), F.lit(k)) for k, words in SECONDARY_LEVELS.items()]
    subs = F.when(source == "vo", F.concat_ws(";", *named)).otherwise("")
    return df.withColumn("onderwijs_niveau", level).withColumn("vo_subniveaus", subs)


def address_groups(addresses: DataFrame, key: str, building: str = "pand_id", preferred: str = "heeft_onderwijsfunctie") -> DataFrame:
    """Per address key the number of buildings and the one to take: with the preferred use first, then the smallest id."""
    rank = F.struct((~F.coalesce(F.col(preferred), F.lit(False))).alias("a"), F.col(building).alias("b"))
    return addresses.groupBy(key).agg(F.count_distinct(building).alias("n"), F.min(rank).alias("_r"), F.array_join(F.array_sort(F.collect_set(building)), ";").alias("ids")).select(key, "n", F.col("_r.b").alias("best"), "ids")


def nearest_house_number(wanted: DataFrame, addresses: DataFrame, id_col: str, equal: Sequence[str], number: str, candidate_number: str, candidate_id: str, tie: Sequence[Column] = ()) -> DataFrame:
    """For each wanted row the candidate with equal keys whose number is nearest; ties by ``tie`` (ascending), then by id.

    Of each number one candidate can win; they and the wanted numbers go on one line per key, where the nearest from below
    and from above are filled in. So a key costs a sort of its rows, however many pairs it has.
    """
    keys = [F.col(c) for c in equal]
    rank = F.struct(*[t.alias(f"t{k}") for k, t in enumerate(tie)], F.col(candidate_id).alias("id"))
    best = addresses.where(F.col(candidate_number).isNotNull()).groupBy(*keys, F.col(candidate_number).cast("bigint").alias("_n")).agg(F.min(rank).alias("_best"))
    kind = best.schema["_best"].dataType
    asks = wanted.where(F.col(number).isNotNull()).select(*keys, F.col(number).cast("bigint").alias("_n"), F.lit(1).alias("_ask"), F.col(id_col).alias("_id"), F.lit(None).cast(kind).alias("_best"))
    line = asks.unionByName(best.withColumn("_ask", F.lit(0)).withColumn("_id", F.lit(None).cast(asks.schema["_id"].dataType)))
    found = F.when(F.col("_ask") == 0, F.struct("_n", "_best"))

    def nearest(order: Column) -> Column:
        return F.last(found, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order, "_ask").rowsBetween(Window.unboundedPreceding, Window.currentRow))

    sides = [F.struct(F.abs(side["_n"] - F.col("_n")).alias("afstand"), side["_best"].alias("best")) for side in (F.col("_below"), F.col("_above"))]
    filled = line.withColumn("_below", nearest(F.col("_n").asc())).withColumn("_above", nearest(F.col("_n").desc())).where("_ask = 1")
    chosen = filled.withColumn("_pick", F.array_min(F.filter(F.array(*sides), lambda x: x["afstand"].isNotNull()))).where("_pick is not null")
    return chosen.select(F.col("_id").alias(id_col), F.col("_pick.best.id").alias(candidate_id), F.col("_pick.afstand").alias("afstand"))


def match_schools(schools: DataFrame, addresses: DataFrame) -> DataFrame:
    """Schools to buildings, from the surest kind of match to the least.

    ``schools`` has school_id, keys (struct exact, basic, town), number, postcode_key, street_key, town_key; ``addresses``
    pand_id, heeft_onderwijsfunctie and the same. In order: the exact address; town, street and number; postcode and number
    with one building, then with several; the nearest number in postcode and street, in the postcode, in the town. An exact match is sure,
    others ask for a check.
    """
    rows = schools
    for name in ("exact", "town", "basic"):
        keyed = address_groups(addresses.withColumn("_key", F.col(f"keys.{name}")), "_key")
        rows = rows.join(keyed.select(F.col("_key").alias(f"_{name}_key"), F.col("n").alias(f"_{name}_n"), F.col("best").alias(f"_{name}")), F.col(f"keys.{name}") == F.col(f"_{name}_key"), "left")
    # one nearest-number candidate per widening set; each is an equi-join on its keys
    base = schools.select("school_id", "number", "postcode_key", "street_key", "town_key").where("number is not null")
    other = addresses.select("pand_id", F.col("number").alias("_number"), "postcode_key", "street_key", "town_key", "heeft_onderwijsfunctie").where("_number is not null")
    tie = [~F.coalesce("heeft_onderwijsfunctie", F.lit(False))]
    near = {"adres_postcode_straat_huisnummer_nearest": ("postcode_key", "street_key"), "adres_postcode_huisnummer_nearest": ("postcode_key",), "adres_woonplaats_huisnummer_nearest": ("town_key",)}
    for k, (name, equal) in enumerate(near.items()):
        found = nearest_house_number(base.select("school_id", "number", *equal), other.select("pand_id", "_number", "heeft_onderwijsfunctie", *equal), "school_id", equal, "number", "_number", "pand_id", tie)
        rows = rows.join(found.select(F.col("school_id").alias(f"_s{k}"), F.col("pand_id").alias(f"_near{k}")), F.col("school_id") == F.col(f"_s{k}"), "left")
    chosen = best_candidate(
        rows,
        [
            ("adres_exact", F.col("_exact_n") > 0, F.col("_exact")),
            ("adres_plaats_straat_huisnummer", F.col("_town_n") > 0, F.col("_town")),
            ("adres_postcode_huisnummer_straat_overgenomen", F.col("_basic_n") == 1, F.col("_basic")),
            ("adres_postcode_huisnummer_meerdere_panden_gekozen", F.col("_basic_n") > 1, F.col("_basic")),
            *[(name, F.col(f"_near{k}").isNotNull(), F.col(f"_near{k}")) for k, name in enumerate(near)],
        ],
    )
    out = chosen.select(*schools.columns, F.col("match").alias("pand_id"), F.col("match_type").alias("bag_match_type"))
    return out.withColumn("bag_match_betrouwbaarheid", F.when(F.col("bag_match_type") == "adres_exact", "hoog").otherwise("controle_nodig")).withColumn("bag_gevalideerd", F.col("bag_match_type") != "geen_match")


def coordinate_fallback(matched: DataFrame, buildings: DataFrame, radius: float = 250.0, id_col: str = "school_id") -> DataFrame:
    """Schools without a building take the nearest one within ``radius`` of their coordinates (x, y)."""
    rest = matched.where("pand_id is null and x is not null and y is not null").select(id_col, "x", "y")
    shells = buildings.select(F.col("pand_id").alias("_pand"), F.col("polygon")[0].alias("line"))
    near = first_per_key(nearest_edges(rest, shells, radius), [id_col], [F.col("snap_m"), F.col("_pand")]).select(F.col(id_col).alias("_id"), "_pand")
    both = matched.join(near, F.col(id_col) == F.col("_id"), "left")
    return both.withColumn("bag_match_type", F.when(F.col("_pand").isNotNull(), "coordinaat_nearest").otherwise(F.col("bag_match_type"))).withColumn("pand_id", F.coalesce("pand_id", "_pand")).drop("_id", "_pand").withColumn("bag_gevalideerd", F.col("pand_id").isNotNull())


def corrected_addresses(schools: DataFrame, corrections: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Address fields replaced by a correction with the same normalised name and town; the last correction of a pair counts."""
    keys = [text.comparable(F.col("VESTIGINGSNAAM")).alias("_name"), text.comparable(F.col("PLAATSNAAM")).alias("_town")]
    c = corrections.select(text.comparable(F.col("vestigingsnaam")).alias("_cname"), text.comparable(F.col("plaatsnaam")).alias("_ctown"), "order", *[F.col(f).alias(f"_{f}") for f in fields])
    last = first_per_key(c, ["_cname", "_ctown"], [F.col("order").desc()]).drop("order")
    rows = schools.select("*", *keys).join(last, (F.col("_name") == F.col("_cname")) & (F.col("_town") == F.col("_ctown")), "left")
    changed = F.col("_cname").isNotNull().alias("adres_gecorrigeerd")
    return rows.select(*[F.coalesce(F.nullif(F.trim(f"_{c}"), F.lit("")), F.col(c)).alias(c) if c in fields else F.col(c) for c in schools.columns], *[F.col(f).alias(f"bron_{f}") for f in fields], changed)


def merge_sources(map_points: DataFrame, register_points: DataFrame, register_id: str, radius: float = 100.0) -> DataFrame:
    """Map facilities and those of a municipal register that no map facility lies within ``radius`` of; columns by name."""
    from waymark.operators.spatial import far_from

    extra = far_from(register_points, map_points.select(F.col("x").alias("rx"), F.col("y").alias("ry")), radius, register_id)
    return map_points.unionByName(extra, allowMissingColumns=True)


def stops_as_facilities(stops: DataFrame) -> DataFrame:
    """Transit stop points as facilities: id, name (its own, else the id) and place."""
    return stops.select(F.col("node_id").alias("ov_id"), text.first_filled(F.col("halte_naam"), F.col("stop_names"), F.col("node_id")).alias("name"), "modes", F.bround("lon", 8).alias("ov_lon"), F.bround("lat", 8).alias("ov_lat"))


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Facilities with a place, numbered from 1 in an explicit order; longitude and latitude to eight decimals."""
    rows = df.where("lon is not null and lat is not null")
    return dense_numbers(rows, order, f"{name}_id").withColumn(f"{name}_lon", F.bround("lon", 8)).withColumn(f"{name}_lat", F.bround("lat", 8))


#: Columns that may hold a facility's place or address, in their order.
PLACE_COLUMNS = {
    "onderwijs": ("bag_gekozen_woonplaats", "woonplaats_naam", "PLAATSNAAM", "bag_basis_woonplaats_naam"),
    "ov": ("ov_adres", "officiele_halte_naam", "stop_names", "naam"),
}
OTHER_PLACE_COLUMNS = ("addr:city", "woonplaats_naam", "bag_gekozen_woonplaats", "PLAATSNAAM", "name", "naam")
ADDRESS_COLUMNS = {"onderwijs": ("bag_basis_straatnaam", "bag_basis_huisnummer", "bag_basis_woonplaats_naam", "STRAATNAAM", "HUISNUMMER-TOEVOEGING", "PLAATSNAAM")}
OTHER_ADDRESS_COLUMNS = ("addr:street", "addr:housenumber", "addr:city")


def with_place(df: DataFrame, name: str, towns: DataFrame | None = None) -> DataFrame:
    """``<name>_plaats``: the town of the facility's building (towns: pand_id, woonplaats_naam, each building once), else its first filled column; empty if there is none.

    ``<name>_adres``: the register's address where the layer has that column, else the filled address columns in a row.
    """
    there = lambda columns: [F.col(f"`{c}`") for c in columns if c in df.columns]
    own = there(PLACE_COLUMNS.get(name, OTHER_PLACE_COLUMNS))
    rows, place = df, text.first_filled(*own) if own else F.lit(None).cast("string")
    if towns is not None and "pand_id" in df.columns:
        known = towns.select(text.plain_id(F.col("pand_id")).alias("_pand"), text.blank_to_null(F.col("woonplaats_naam")).alias("_town"))
        rows = df.join(known, text.plain_id(F.col("pand_id")) == F.col("_pand"), "left").drop("_pand")
        place = F.coalesce(F.col("_town"), place)
    parts = there(ADDRESS_COLUMNS.get(name, OTHER_ADDRESS_COLUMNS))
    address = F.trim("adres_bag") if "adres_bag" in df.columns else F.regexp_replace(text.address_line(*parts), r"\s+", " ") if parts else F.lit("")
    return rows.withColumn(f"{name}_plaats", F.trim(F.coalesce(place, F.lit("")))).withColumn(f"{name}_adres", F.coalesce(address, F.lit(""))).drop("_town")
