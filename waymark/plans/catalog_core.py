"""More driver queries: address keys, facility rules, register, roads, snapping and access, transit; each beside its SQL.

Written texts (streets, numbers, names) come from short fixed lists, dealt to rows by their keys. Suppliers are crossings
of a street grid, ten to a row and a hundred metres apart; customers are buildings beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import classes, geometry, text, times
from waymark.operators import access, facilities, maplayers, network, register, relational, roads, rollup, spatial, transit
from waymark.plans import catalog
from waymark.plans.catalog import query, table

STREETS = ("Burg. Tónstr", "  De Vries-ln ", "Hoofdstrjitte", "J. vd Wijk wg", "Dijkstraat", "Lange  Str.", "B W plein", "Kerkwg")
NUMBERS = ("12", "12 a", "7-B", "105/2 boven", "9bis", "noord", "31-c 2", "")
POSTCODES = ("8911 ab", "8912AB ", " 8913 Cd", "8914 x y")
TOWNS = ("Ljouwert", "Sneek-Noord", "'t Wild", "Tytsjerk")
CODES = ("gm80", " GM0080", "1900", "59", "x12")
LINES = ("007", "Lijn 7", "nan", " 12 ", "x5", "00")
VEHICLE_TEXTS = ("Stadsbus 3", "Trein NS", "Veerboot", "Taxi", "Snelbus/trein", "FERRY west")


def _of(values: tuple[str, ...], key: str, shift: int = 0) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), ((F.col(key) + shift) % len(values) + 1).cast("int"))


def _sql_of(values: tuple[str, ...], key: str, shift: int = 0) -> str:
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{listed}])[({key} + {shift}) % {len(values)} + 1]"


def _plain(x: str) -> str:
    return f"lower(trim(coalesce({x}, '')))"


def _comparable(x: str) -> str:
    return f"regexp_replace(regexp_replace(strip_accents({_plain(x)}), '[-.''’]', ' ', 'g'), '\\s+', ' ', 'g')"


def _street(x: str) -> str:
    words = f"list_filter(string_split({_comparable(x)}, ' '), lambda w: w <> '')"
    whole = "CASE w WHEN 'burg' THEN 'burgemeester' WHEN 'str' THEN 'straat' WHEN 'wg' THEN 'weg' WHEN 'ln' THEN 'laan' WHEN 'strjitte' THEN 'straat' ELSE w END"
    ends = "CASE WHEN len(w) > 9 AND w LIKE '%strjitte' THEN w[:-9] || 'straat' WHEN len(w) > 7 AND w LIKE '%straat' THEN w WHEN len(w) > 4 AND w LIKE '%str' THEN w[:-4] || 'straat' WHEN len(w) > 3 AND w LIKE '%wg' THEN w[:-3] || 'weg' WHEN len(w) > 3 AND w LIKE '%ln' THEN w[:-3] || 'laan' ELSE w END"
    short = "CASE w WHEN 'b' THEN 'bartholomeus' WHEN 'j' THEN 'johan' WHEN 'w' THEN 'willem' WHEN 'vd' THEN 'van der' WHEN 'v' THEN 'van' ELSE w END"
    return f"replace(array_to_string(list_transform(list_transform(list_transform({words}, lambda w: {whole}), lambda w: {ends}), lambda w: {short}), ' '), 'ij', 'y')"


_NUMBER = r"^(\d+)\s*[-/]?\s*([A-Za-z]?)\s*[-/]?\s*(.*)$"


def _number(x: str) -> tuple[str, str, str]:
    at = f"trim(coalesce({x}, ''))"
    hit, part = f"regexp_matches({at}, '{_NUMBER}')", lambda k: f"regexp_extract({at}, '{_NUMBER}', {k})"
    return (f"CASE WHEN {hit} THEN {part(1)} ELSE {_comparable(x)} END", f"CASE WHEN {hit} THEN upper({part(2)}) ELSE '' END", f"CASE WHEN {hit} THEN {_comparable(part(3))} ELSE '' END")


_WRITTEN = f"""w AS (SELECT c_custkey, {_sql_of(STREETS, 'c_custkey')} AS straat, {_sql_of(NUMBERS, 'c_custkey', 3)} AS nr, {_sql_of(POSTCODES, 'c_custkey', 1)} AS pc, {_sql_of(TOWNS, 'c_custkey', 2)} AS plaats FROM customer),
n AS (SELECT *, {_street('straat')} AS s, {_number('nr')[0]} AS n1, {_number('nr')[1]} AS n2, {_number('nr')[2]} AS n3, regexp_replace(upper(pc), '\\s+', '', 'g') AS p, {_comparable('plaats')} AS t FROM w)"""


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", _of(STREETS, "c_custkey").alias("straat"), _of(NUMBERS, "c_custkey", 3).alias("nr"), _of(POSTCODES, "c_custkey", 1).alias("pc"), _of(TOWNS, "c_custkey", 2).alias("plaats"))


@query(f"""WITH {_WRITTEN} SELECT c_custkey, s AS straat_norm, n1 AS nummer, n2 AS letter, n3 AS toevoeging, p AS postcode_norm, t AS plaats_norm,
  concat_ws('|', p, n1, n2, n3, s) AS exact, concat_ws('|', p, n1, n2, n3) AS basis, concat_ws('|', t, s, n1, n2, n3) AS plaats_sleutel FROM n""")
def address_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    number, keys = text.house_number(F.col("nr")), text.address_keys(F.col("straat"), F.col("nr"), F.col("pc"), F.col("plaats"))
    return _written(spark, sf_dir).select("c_custkey", text.street(F.col("straat")).alias("straat_norm"), number["number"].alias("nummer"), number["letter"].alias("letter"), number["addition"].alias("toevoeging"), text.postcode(F.col("pc")).alias("postcode_norm"), text.comparable(F.col("plaats")).alias("plaats_norm"), keys["exact"].alias("exact"), keys["basic"].alias("basis"), keys["town"].alias("plaats_sleutel"))


@query(f"""WITH w AS (SELECT c_custkey, upper(trim({_sql_of(CODES, 'c_custkey')})) AS c, c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '.0' ELSE '' END AS id, {_sql_of(NUMBERS, 'c_custkey', 1)} AS nr, nullif(trim({_sql_of(STREETS, 'c_custkey', 2)}), '') AS straat,
  CASE c_custkey % 4 WHEN 0 THEN '1,5 km' WHEN 1 THEN 'x -2.25' WHEN 2 THEN 'geen' END AS getal, CASE c_custkey % 3 WHEN 0 THEN ' j' WHEN 1 THEN 'n ' END AS vlag, CASE c_custkey % 3 WHEN 0 THEN '["Path", ''track'']' WHEN 1 THEN ' Steps ' END AS tag FROM customer),
k AS (SELECT *, regexp_replace(c, '^GM', '') AS code FROM w)
SELECT c_custkey, CASE WHEN len(code) < 4 THEN lpad(code, 4, '0') ELSE code END AS gemeente, CASE WHEN regexp_matches(CASE WHEN len(code) < 4 THEN lpad(code, 4, '0') ELSE code END, '^[0-9]+$') THEN CASE WHEN len(code) < 4 THEN lpad(code, 4, '0') ELSE code END END AS gemeente_cijfers,
  lpad(CAST(c_custkey AS VARCHAR), 16, '0') AS pand_id, TRY_CAST(nullif(regexp_extract(nr, '(\\d+)', 1), '') AS BIGINT) AS eerste_getal, CAST(TRY_CAST(nullif(regexp_extract(replace(getal, ',', '.'), '(-?\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) AS DOUBLE) AS maat,
  upper(trim(vlag)) AS vlag_norm, CASE WHEN upper(trim(vlag)) = 'J' THEN 'Ja' ELSE 'Nee' END AS vlag_tekst, nullif(concat_ws(' ', straat, nullif(trim(nr), '')), '') AS adresregel,
  CASE WHEN tag IS NULL THEN '' WHEN tag LIKE '[%' THEN 'path;track' ELSE 'steps' END AS tags FROM k""")
def identifier_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey")
    k = F.col("c_custkey")
    code, nr, street = _of(CODES, "c_custkey"), _of(NUMBERS, "c_custkey", 1), _of(STREETS, "c_custkey", 2)
    ident = F.concat(k.cast("string"), F.when(k % 2 == 0, ".0").otherwise(""))
    size = F.when(k % 4 == 0, "1,5 km").when(k % 4 == 1, "x -2.25").when(k % 4 == 2, "geen")
    flag = F.when(k % 3 == 0, " j").when(k % 3 == 1, "n ")
    tag = F.when(k % 3 == 0, "[\"Path\", 'track']").when(k % 3 == 1, " Steps ")
    return rows.select("c_custkey", text.municipality_code(code).alias("gemeente"), text.municipality_code(code, digits_only=True).alias("gemeente_cijfers"), text.plain_id(ident, 16).alias("pand_id"), text.first_number(nr).alias("eerste_getal"), text.decimal_number(size).alias("maat"), text.yes_no(flag).alias("vlag_norm"), text.shown_yes_no(text.yes_no(flag) == "J").alias("vlag_tekst"), text.address_line(street, nr).alias("adresregel"), F.array_join(text.list_text(tag), ";").alias("tags"))


@query(f"""WITH w AS (SELECT s_suppkey, {_sql_of(LINES, 's_suppkey')} AS l, trim(regexp_replace({_plain(_sql_of(VEHICLE_TEXTS, 's_suppkey', 2))}, '[^a-z0-9]+', ' ', 'g')) AS v FROM supplier)
SELECT s_suppkey, v AS woorden, CASE WHEN contains(v, 'bus') THEN 'bus' WHEN contains(v, 'trein') THEN 'train' WHEN regexp_matches(v, 'veer|boot|ferry') THEN 'ferry' ELSE 'unknown' END AS modaliteit,
  CASE WHEN lower(trim(l)) IN ('nan', 'none', '<na>') THEN '' WHEN regexp_matches(trim(l), '^[0-9]+$') THEN CAST(CAST(trim(l) AS BIGINT) AS VARCHAR) ELSE upper(trim(l)) END AS lijn FROM w""")
def line_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = _of(VEHICLE_TEXTS, "s_suppkey", 2)
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.simple_words(kind).alias("woorden"), text.vehicle_mode(kind).alias("modaliteit"), text.line_number(_of(LINES, "s_suppkey")).alias("lijn"))


NAMES = ("Benu Apotheek", "Dierenapotheek Zuid", "Huisartsenpraktijk Oost", "Fysio Huisarts", "Albert Heijn XL", "Jumbo Pick-up", "Stadspark", "Achtertuin 5", "Zwembad", "")
AMENITIES = ("pharmacy", "doctors", "", "cafe")
SHOPS = ("supermarket", "", "kiosk")
KINDS = ("leisure_park", "leisure_garden", "landuse_forest")
ACCESSES = ("", "private", "yes")
LEISURE = ("pitch", "track", "garden")
_TAGS = f"""w AS (SELECT p_partkey, {_plain(_sql_of(NAMES, 'p_partkey'))} AS name, {_sql_of(AMENITIES, 'p_partkey', 1)} AS amenity, {_sql_of(SHOPS, 'p_partkey')} AS shop, {_sql_of(KINDS, 'p_partkey')} AS kind, {_sql_of(ACCESSES, 'p_partkey', 2)} AS access, {_sql_of(LEISURE, 'p_partkey', 1)} AS leisure,
  p_size % 4 = 0 AS flag, CASE p_size % 3 WHEN 0 THEN 'within' WHEN 1 THEN 'nearest' ELSE 'geen_match' END AS bag, p_size * 3.0 AS far FROM part)"""


@query(f"""WITH {_TAGS} SELECT p_partkey,
  NOT regexp_matches(name, 'dierenapotheek|afhaalkluis|medicijnkluis') AND (amenity = 'pharmacy' OR contains(name, 'apotheek') OR contains(name, 'benu')) AS apotheek,
  NOT contains(name, 'fysio') AND (contains(name, 'huisarts') OR contains(name, 'praktijk') OR amenity = 'doctors') AS huisarts,
  shop = 'supermarket' AND name NOT LIKE '%pick-up%' AND (name IN ('albert heijn xl') OR name LIKE 'albert heijn %' OR name LIKE 'jumbo %') AS supermarkt,
  access <> 'private' AND name NOT LIKE '%achtertuin%' AND NOT (kind = 'leisure_garden' AND name = '') AND kind IN ('leisure_park', 'leisure_garden') AS groen,
  access <> 'private' AND name NOT LIKE '%achtertuin%' AND leisure IN ('pitch', 'track') AS sport,
  flag AS gevalideerd, flag AND (bag = 'within' OR (bag = 'nearest' AND far <= 50)) AS gevalideerd_nabij FROM w""")
def facility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", _of(NAMES, "p_partkey").alias("name"), _of(AMENITIES, "p_partkey", 1).alias("amenity"), _of(SHOPS, "p_partkey").alias("shop"), _of(KINDS, "p_partkey").alias("match_type"), _of(ACCESSES, "p_partkey", 2).alias("access"), _of(LEISURE, "p_partkey", 1).alias("leisure"), F.when(F.col("p_size") % 4 == 0, "Ja").otherwise("nee").alias("bag_gevalideerd"), F.when(F.col("p_size") % 3 == 0, "within").when(F.col("p_size") % 3 == 1, "nearest").otherwise("geen_match").alias("bag_match_type"), (F.col("p_size") * 3.0).alias("bag_afstand_meter"))
    rules = (("apotheek", "apotheek"), ("huisarts", "huisarts"), ("supermarkt", "supermarkt"), ("groen", "recreatief_groen"), ("sport", "sport"))
    return p.select("p_partkey", *[facilities.RULES[rule](p).alias(name) for name, rule in rules], facilities.validated(p, False).alias("gevalideerd"), facilities.validated(p, True).alias("gevalideerd_nabij"))


@query(f"""WITH {_TAGS} SELECT p_partkey, name FROM w WHERE flag AND NOT regexp_matches(name, 'dierenapotheek|afhaalkluis|medicijnkluis') AND (amenity = 'pharmacy' OR contains(name, 'apotheek') OR contains(name, 'benu'))""")
def pharmacies_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", _of(NAMES, "p_partkey").alias("name"), F.when(F.col("p_size") % 4 == 0, "1").otherwise("0").alias("bag_gevalideerd"))
    tags = table(spark, sf_dir, "part").select("p_partkey", _of(AMENITIES, "p_partkey", 1).alias("amenity"))
    return facilities.select_facilities(p, "apotheek", tags, "p_partkey").select("p_partkey", text.plain(F.col("name")).alias("name"))


STRUCTURES = ("HAVO/VWO", "VBO-MAVO", "Pro", "brugjaar ath", "hbo", "")
SOURCES = ("vo", "mbo", "hbo_wo", "basisonderwijs", "anders")


@query(f"""WITH w AS (SELECT s_suppkey, {_sql_of(SOURCES, 's_suppkey')} AS bron, {_sql_of(STRUCTURES, 's_suppkey', 2)} AS st FROM supplier),
c AS (SELECT *, lower(trim(st)) AS s, {_comparable('st')} AS cs FROM w)
SELECT s_suppkey, CASE WHEN bron IN ('basisonderwijs', 'vo', 'mbo') THEN bron WHEN bron = 'hbo_wo' AND s IN ('hbo', 'wo') THEN s END AS onderwijs_niveau,
  CASE WHEN bron = 'vo' THEN concat_ws(';', CASE WHEN regexp_matches(cs, '\\b(vbo|vmbo)\\b') THEN 'vmbo' END, CASE WHEN regexp_matches(cs, '\\bmavo\\b') THEN 'mavo' END, CASE WHEN regexp_matches(cs, '\\bhavo\\b') THEN 'havo' END, CASE WHEN regexp_matches(cs, '\\b(vwo|ath|atheneum)\\b') THEN 'vwo' END, CASE WHEN regexp_matches(cs, '\\bpro\\b') THEN 'pro' END, CASE WHEN regexp_matches(cs, '\\bbrugjaar\\b') THEN 'brugjaar' END) ELSE '' END AS vo_subniveaus FROM c""")
def school_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", _of(SOURCES, "s_suppkey").alias("bron"), _of(STRUCTURES, "s_suppkey", 2).alias("ONDERWIJSSTRUCTUUR"))
    return facilities.school_level(rows).select("s_suppkey", "onderwijs_niveau", "vo_subniveaus")


_SCHOOLS = """s AS (SELECT s_suppkey AS id, s_suppkey % 9 AS pc, s_suppkey % 5 AS st, s_suppkey % 4 AS pl, s_suppkey % 23 AS nr FROM supplier),
a AS (SELECT c_custkey AS pand, c_custkey % 4 = 0 AS ok, c_custkey % 11 AS pc, c_custkey % 6 AS st, c_custkey % 5 AS pl, c_custkey * 7 % 311 AS nr FROM customer WHERE c_custkey % 3 <> 1)"""


def _best_of(keys: str, name: str) -> str:
    on = " AND ".join(f"s.{k} = a.{k}" for k in keys.split())
    return f"{name} AS (SELECT s.id, count(DISTINCT a.pand) AS n, arg_min(a.pand, CAST(NOT a.ok AS INT) * 1000000000 + a.pand) AS best FROM s JOIN a ON {on} GROUP BY s.id)"


def _near_of(keys: str, name: str) -> str:
    on = " AND ".join(f"s.{k} = a.{k}" for k in keys.split())
    return f"{name} AS (SELECT s.id, arg_min(a.pand, abs(a.nr - s.nr) * 10000000000 + CAST(NOT a.ok AS INT) * 1000000000 + a.pand) AS best FROM s JOIN a ON {on} GROUP BY s.id)"


@query(f"""WITH {_SCHOOLS}, {_best_of('pc nr st', 'e')}, {_best_of('pl st nr', 't')}, {_best_of('pc nr', 'b')}, {_near_of('pc st', 'n1')}, {_near_of('pc', 'n2')}, {_near_of('pl', 'n3')},
m AS (SELECT s.id, CASE WHEN e.n > 0 THEN 'adres_exact' WHEN t.n > 0 THEN 'adres_plaats_straat_huisnummer' WHEN b.n = 1 THEN 'adres_postcode_huisnummer_straat_overgenomen' WHEN b.n > 1 THEN 'adres_postcode_huisnummer_meerdere_panden_gekozen'
    WHEN n1.best IS NOT NULL THEN 'adres_postcode_straat_huisnummer_nearest' WHEN n2.best IS NOT NULL THEN 'adres_postcode_huisnummer_nearest' WHEN n3.best IS NOT NULL THEN 'adres_woonplaats_huisnummer_nearest' ELSE 'geen_match' END AS bag_match_type,
  coalesce(e.best, t.best, b.best, n1.best, n2.best, n3.best) AS pand_id FROM s LEFT JOIN e USING (id) LEFT JOIN t USING (id) LEFT JOIN b USING (id) LEFT JOIN n1 USING (id) LEFT JOIN n2 USING (id) LEFT JOIN n3 USING (id))
SELECT id AS school_id, pand_id, bag_match_type, CASE WHEN bag_match_type = 'adres_exact' THEN 'hoog' ELSE 'controle_nodig' END AS bag_match_betrouwbaarheid, bag_match_type <> 'geen_match' AS bag_gevalideerd FROM m""")
def school_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda *c: F.concat_ws("|", *[F.col(x).cast("string") for x in c])
    parts = [F.struct(key("pc", "nr", "st").alias("exact"), key("pc", "nr").alias("basic"), key("pl", "st", "nr").alias("town")).alias("keys"), F.col("nr").alias("number"), F.col("pc").cast("string").alias("postcode_key"), F.col("st").cast("string").alias("street_key"), F.col("pl").cast("string").alias("town_key")]
    k = lambda c, m: (F.col(c) % m)
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("school_id"), k("s_suppkey", 9).alias("pc"), k("s_suppkey", 5).alias("st"), k("s_suppkey", 4).alias("pl"), k("s_suppkey", 23).alias("nr")).select("school_id", *parts)
    a = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 1").select(F.col("c_custkey").alias("pand_id"), (k("c_custkey", 4) == 0).alias("heeft_onderwijsfunctie"), k("c_custkey", 11).alias("pc"), k("c_custkey", 6).alias("st"), k("c_custkey", 5).alias("pl"), (F.col("c_custkey") * 7 % 311).alias("nr")).select("pand_id", "heeft_onderwijsfunctie", *parts)
    return facilities.match_schools(s, a).select("school_id", "pand_id", "bag_match_type", "bag_match_betrouwbaarheid", "bag_gevalideerd")


@query("""WITH c AS (SELECT DISTINCT ON (n, t) lower(c_mktsegment) AS n, CAST(c_nationkey AS VARCHAR) AS t, c_name AS tel FROM customer ORDER BY n, t, c_custkey DESC)
SELECT s_suppkey, coalesce(tel, s_name) AS TELEFOON, s_name AS bron_TELEFOON, tel IS NOT NULL AS adres_gecorrigeerd FROM supplier LEFT JOIN c ON n = CASE s_suppkey % 3 WHEN 0 THEN 'building' WHEN 1 THEN 'machinery' ELSE 'onbekend' END AND t = CAST(s_nationkey AS VARCHAR)""")
def corrected_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, " BUILDING ").when(F.col("s_suppkey") % 3 == 1, "Machinery").otherwise("onbekend").alias("VESTIGINGSNAAM"), F.col("s_nationkey").cast("string").alias("PLAATSNAAM"), F.col("s_name").alias("TELEFOON"))
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("vestigingsnaam"), F.col("c_nationkey").cast("string").alias("plaatsnaam"), F.col("c_custkey").alias("order"), F.col("c_name").alias("TELEFOON"))
    return facilities.corrected_addresses(s, c, ["TELEFOON"]).select("s_suppkey", "TELEFOON", "bron_TELEFOON", "adres_gecorrigeerd")


_UNITS = """u AS (SELECT l_orderkey AS pand, l_linenumber AS unit, l_suppkey AS vk, strftime(l_shipdate, '%Y-%m-%d') AS b, CASE WHEN l_returnflag = 'R' THEN strftime(l_shipdate + INTERVAL 200 DAY, '%Y-%m-%d') END AS e FROM lineitem)"""


@query(f"""WITH {_UNITS} SELECT pand AS pand_id, unit AS verblijfsobject_id, vk AS vbo_voorkomen_id FROM u WHERE b <= '1996-12-31' AND (e IS NULL OR e > '1996-12-31') QUALIFY row_number() OVER (PARTITION BY pand, unit ORDER BY b DESC, vk DESC) = 1""")
def current_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    u = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pand_id"), F.col("l_linenumber").alias("verblijfsobject_id"), F.col("l_suppkey").alias("vbo_voorkomen_id"), day("l_shipdate").alias("vbo_begin_geldigheid"), F.when(F.col("l_returnflag") == "R", day(F.date_add(F.to_date("l_shipdate"), 200))).alias("vbo_eind_geldigheid"))
    return register.current_units(u, 1996).select("pand_id", "verblijfsobject_id", "vbo_voorkomen_id")


@query("""WITH r AS (SELECT lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS woonplaats_id, lpad(CAST(n_regionkey AS VARCHAR), 4, '0') AS gemeente, n_nationkey % 4 AS k FROM nation)
SELECT DISTINCT woonplaats_id FROM r WHERE gemeente IN ('0001', '0003') AND k <> 3 AND (k <> 2)""")
def towns_of_municipalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey") % 4
    r = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("woonplaats_id"), F.col("n_regionkey").cast("string").alias("gemeentecode"), F.lit("2010-01-01").alias("begin"), F.when(k == 2, "2019-06-01").alias("eind"), F.when(k == 3, "voorlopig").otherwise("definitief").alias("status"))
    return register.towns_of(r, ["1", "0003"], [2020, 2024])


_CASCADE = """t AS (SELECT n_nationkey AS woonplaats_id, n_name AS woonplaats_naam FROM nation WHERE n_regionkey = 2),
st AS (SELECT c_custkey AS openbare_ruimte_id, c_nationkey AS woonplaats_id, c_mktsegment AS openbare_ruimte_naam FROM customer JOIN t ON c_nationkey = woonplaats_id),
ad AS (SELECT o_orderkey AS nummeraanduiding_id, o_custkey AS openbare_ruimte_id, o_orderkey % 90 AS huisnummer FROM orders JOIN st ON o_custkey = openbare_ruimte_id),
un AS (SELECT l_linenumber AS verblijfsobject_id, l_orderkey AS nummeraanduiding_id, l_partkey AS pand_id FROM lineitem JOIN ad ON l_orderkey = nummeraanduiding_id)"""


def _register(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    towns = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("woonplaats_id"), F.col("n_name").alias("woonplaats_naam"), "n_regionkey")
    streets = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("openbare_ruimte_id"), F.col("c_nationkey").alias("woonplaats_id"), F.col("c_mktsegment").alias("openbare_ruimte_naam"))
    addresses = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("nummeraanduiding_id"), F.col("o_custkey").alias("openbare_ruimte_id"), (F.col("o_orderkey") % 90).alias("huisnummer"))
    units = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("verblijfsobject_id"), F.col("l_orderkey").alias("nummeraanduiding_id"), F.col("l_partkey").alias("pand_id"))
    buildings = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pand_id"), "p_size")
    return register.selection(towns.where("n_regionkey = 2").select("woonplaats_id"), towns.drop("n_regionkey"), streets, addresses, units, buildings)


@query(f"""WITH {_CASCADE} SELECT 'woonplaatsen' AS tabel, count(*) AS n, CAST(sum(woonplaats_id) AS BIGINT) AS som FROM t UNION ALL SELECT 'openbare_ruimtes', count(*), CAST(sum(openbare_ruimte_id) AS BIGINT) FROM st UNION ALL SELECT 'nummeraanduidingen', count(*), CAST(sum(nummeraanduiding_id) AS BIGINT) FROM ad
UNION ALL SELECT 'verblijfsobjecten', count(*), CAST(sum(pand_id) AS BIGINT) FROM un UNION ALL SELECT 'panden', count(*), CAST(sum(p_partkey) AS BIGINT) FROM part WHERE p_partkey IN (SELECT pand_id FROM un)""")
def register_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, keys = _register(spark, sf_dir), {"woonplaatsen": "woonplaats_id", "openbare_ruimtes": "openbare_ruimte_id", "nummeraanduidingen": "nummeraanduiding_id", "verblijfsobjecten": "pand_id", "panden": "pand_id"}
    return relational.union_all(*[kept[t].agg(F.lit(t).alias("tabel"), F.count("*").alias("n"), F.sum(k).alias("som")) for t, k in keys.items()])


@query(f"""WITH {_CASCADE} SELECT DISTINCT verblijfsobject_id, nummeraanduiding_id, pand_id, huisnummer, openbare_ruimte_id, openbare_ruimte_naam, woonplaats_id, woonplaats_naam FROM un LEFT JOIN ad USING (nummeraanduiding_id) LEFT JOIN st USING (openbare_ruimte_id) LEFT JOIN t USING (woonplaats_id)""")
def register_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _register(spark, sf_dir)
    return register.link_table(kept["verblijfsobjecten"], kept["nummeraanduidingen"], kept["openbare_ruimtes"], kept["woonplaatsen"])


@query(f"""WITH {_CASCADE}, f AS (SELECT pand_id, woonplaats_naam, nummeraanduiding_id, verblijfsobject_id FROM un JOIN ad USING (nummeraanduiding_id) JOIN st USING (openbare_ruimte_id) JOIN t USING (woonplaats_id))
SELECT pand_id, woonplaats_naam FROM f QUALIFY row_number() OVER (PARTITION BY pand_id ORDER BY woonplaats_naam) = 1""")
def town_of_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register.town_per_building(register_links(spark, sf_dir))


@query("""WITH x AS (SELECT s_suppkey AS areaid, s_suppkey % 7 AS areamanagerid, CASE s_suppkey % 4 WHEN 0 THEN 'Parkeergarage Oost' WHEN 1 THEN 'Straat' WHEN 2 THEN 'P+R Parking' END AS areadesc FROM supplier),
e AS (SELECT c_custkey AS id, c_custkey % 100 AS areaid, c_custkey % 100 % 7 AS areamanagerid, c_custkey % 2 = 0 AS io FROM customer)
SELECT e.id AS entranceexitid, e.areaid, x.areadesc, CASE WHEN io THEN CAST(e.id AS DOUBLE) / 8 END AS longitude, CASE WHEN NOT io THEN 'straat ' || e.id END AS streetname
FROM e JOIN x USING (areaid, areamanagerid) WHERE regexp_matches(lower(coalesce(areadesc, '')), 'garage|parkeergarage|parking')""")
def garage_entrances(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("areaid"), (F.col("s_suppkey") % 7).alias("areamanagerid"), F.when(F.col("s_suppkey") % 4 == 0, "Parkeergarage Oost").when(F.col("s_suppkey") % 4 == 1, "Straat").when(F.col("s_suppkey") % 4 == 2, "P+R Parking").alias("areadesc"))
    c, io = table(spark, sf_dir, "customer"), F.when(F.col("c_custkey") % 2 == 0, "I-O").otherwise("A")
    exits = c.select(F.col("c_custkey").alias("entranceexitid"), (F.col("c_custkey") % 100).alias("areaid"), (F.col("c_custkey") % 100 % 7).alias("areamanagerid"))
    positions = c.select(F.col("c_custkey").alias("locationreference"), io.alias("locationreferencetype"), (F.col("c_custkey") / 8).cast("string").alias("longitude"), F.lit("1").alias("latitude"))
    addresses = c.select(F.col("c_custkey").alias("parkingaddressreference"), F.when(F.col("c_custkey") % 2 == 1, "I-O").otherwise("A").alias("parkingaddressreferencetype"), F.concat(F.lit("straat "), F.col("c_custkey")).alias("streetname"), F.lit("1").alias("housenumber"), F.lit("x").alias("zipcode"))
    return register.garages(areas, exits, positions, addresses).select("entranceexitid", "areaid", "areadesc", "longitude", "streetname")


@query("""SELECT l_suppkey AS wvk_id, CASE WHEN bool_or(l_returnflag = 'R') THEN 'J' ELSE 'N' END AS auto_h, CASE WHEN bool_or(l_linestatus = 'F' AND l_quantity > 49) THEN 'J' ELSE 'N' END AS fiets_t, string_agg(DISTINCT l_returnflag || l_linestatus, '; ' ORDER BY l_returnflag || l_linestatus) AS wegcategorie FROM lineitem GROUP BY 1""")
def segment_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("wvk_id"), F.when(F.col("l_returnflag") == "R", " j").otherwise("N").alias("auto_h"), F.when((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 49), "J").alias("fiets_t"), F.concat(F.lit(" "), "l_returnflag", "l_linestatus").alias("weg_cat"))
    return roads.with_attributes(roads.flags_per_segment(lines), roads.categories_per_segment(lines).drop("wegcategorieen"))


@query("""WITH a AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_quantity = 1 GROUP BY 1), b AS (SELECT s_suppkey AS k, count(*) AS n, sum(s_acctbal) AS opp FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS wvk_id, coalesce(a.n, 0) AS parkeerpunten_aantal, coalesce(b.n, 0) AS parkeervlakken_aantal, CAST(coalesce(opp, 0) AS DOUBLE) AS parkeervlakken_oppervlak_m2 FROM a FULL JOIN b ON a.k = b.k""")
def parking_per_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "lineitem").where("l_quantity = 1").select(F.col("l_suppkey").alias("wvk_id"))
    areas = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("wvk_id"), F.col("s_acctbal").cast("string").alias("oppervlak"))
    got = roads.parking_counts(points, areas)
    return got.withColumn("parkeerpunten_aantal", F.col("parkeerpunten_aantal").cast("bigint")).withColumn("parkeervlakken_aantal", F.col("parkeervlakken_aantal").cast("bigint"))


@query("""SELECT s_suppkey AS wvk_id, CAST(greatest(CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey % 8 * 10.0 END, s_suppkey % 5 * 15.0) AS DOUBLE) AS max_snelheid_kmh, CAST(CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE 0 END AS BIGINT) AS parkeerpunten_aantal, s_suppkey % 2 = 0 AND s_suppkey > 0 AS parkeren_gekoppeld FROM supplier""")
def vehicle_speed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k.alias("wvk_id"), F.when(k % 3 == 0, "onbekend").otherwise(F.concat((k % 8 * 10).cast("string"), F.lit(" km/u"))).alias("a"), (k % 5 * 15).cast("string").alias("b"), F.when(k % 2 == 0, k).alias("parkeerpunten_aantal"))
    return roads.vehicle_columns(roads.road_speed(rows, "a", "b", "c"), "personenauto").select("wvk_id", "max_snelheid_kmh", "parkeerpunten_aantal", "parkeren_gekoppeld")


@query("""WITH w AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Footway' WHEN 1 THEN '[''residential'', ''path'']' WHEN 2 THEN 'motorway' ELSE 'steps' END AS h, CASE p_partkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS o, CASE p_partkey % 5 WHEN 0 THEN 'no' END AS ob, p_size * 10 AS m FROM part)
SELECT p_partkey, NOT (CASE WHEN ob = 'no' THEN false WHEN o = 'yes' THEN true ELSE false END) AS terug_toegestaan, CAST(round(m / (4.8 * 1000 / 60) * 1000) AS BIGINT) AS milli_min FROM w WHERE h <> 'motorway'""")
def map_walkways(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    ways = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 4 == 0, "Footway").when(k % 4 == 1, "['residential', 'path']").when(k % 4 == 2, "motorway").otherwise("steps").alias("highway"), F.when(k % 3 == 0, "yes").when(k % 3 == 1, "no").alias("oneway"), F.when(k % 5 == 0, "no").alias("oneway:bicycle"), (F.col("p_size") * 10).cast("string").alias("lengte_meter"), F.array(geometry.point(F.lit(0), F.lit(0)), geometry.point(F.lit(1), F.lit(0))).alias("line"))
    got = roads.map_ways(ways, roads.WALK_TAGS, "voetganger")
    return got.select("p_partkey", "terug_toegestaan", F.round(F.col("reistijd_min") * 1000).cast("bigint").alias("milli_min"))


#: The street grid: a way to the right of every crossing and one upwards, if the other crossing exists.
_GRID = """g AS (SELECT s_suppkey AS k, s_suppkey % 10 * 100.0 AS x, s_suppkey // 10 * 100.0 AS y FROM supplier),
ways AS (SELECT a.k * 10 + d.range AS edge_id, a.k AS u, b.k AS v, CAST(1 + a.k % 5 AS DOUBLE) AS minutes, a.k % 7 <> 0 AS forward, a.k % 3 <> 0 AS backward, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM g a, range(2) d, g b WHERE b.k = a.k + CASE WHEN d.range = 0 THEN 1 ELSE 10 END AND (d.range = 1 OR a.k % 10 <> 9)),
c AS (SELECT c_custkey AS id, c_custkey * 37 % 1000 + c_custkey % 7 * 0.1373 + 0.29 AS x, c_custkey * 53 % 1000 + 0.53 + c_custkey // 1500 * 1000 AS y FROM customer),
near AS (SELECT c.id, w.*, greatest(0.0, least(1.0, ((c.x - ax) * (bx - ax) + (c.y - ay) * (by_ - ay)) / 10000.0)) AS share, c.x AS px, c.y AS py FROM c, ways w),
found AS (SELECT *, sqrt((px - (ax + share * (bx - ax))) * (px - (ax + share * (bx - ax))) + (py - (ay + share * (by_ - ay))) * (py - (ay + share * (by_ - ay)))) AS snap_m FROM near),
placed AS (SELECT * FROM found WHERE snap_m <= 60 QUALIFY row_number() OVER (PARTITION BY id ORDER BY snap_m, edge_id) = 1)"""


#: Coordinates are decimals, as in SQL; doubles would differ in their last digits, which decide where times lie on the edge of rounding.
METRES = "decimal(13,4)"


def _grid(spark: SparkSession, sf_dir: str) -> access.RoadNetwork:
    k = F.col("s_suppkey")
    at = lambda c: F.struct((c % 10 * 100).cast(METRES).alias("x"), (F.floor(c / 10) * 100).cast(METRES).alias("y"))
    s = table(spark, sf_dir, "supplier").select(k)
    both = s.withColumn("d", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("v", F.when(F.col("d") == 0, k + 1).otherwise(k + 10)).where((F.col("d") == 1) | (k % 10 != 9))
    there = both.join(s.select(k.alias("_v")), F.col("v") == F.col("_v"))
    ways = there.select((k * 10 + F.col("d")).alias("edge_id"), k.alias("u"), "v", (1 + k % 5).cast("double").alias("minutes"), F.lit(100.0).alias("length_m"), (k % 7 != 0).alias("forward"), (k % 3 != 0).alias("backward"), F.array(at(k), at(F.col("v"))).alias("line"))
    return access.RoadNetwork.of("lopen", ways, 80.0)


def _buildings(spark: SparkSession, sf_dir: str, name: str = "pand_id") -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias(name), (k * 37 % 1000 + k % 7 * 0.1373 + 0.29).cast(METRES).alias("x"), (k * 53 % 1000 + 0.53 + F.floor(k / 1500) * 1000).cast(METRES).alias("y"))


def _fine(c: Column) -> Column:
    """Hundred-millionths as whole numbers, so that both engines' last bits don't matter."""
    return F.round(c * 100000000).cast("bigint")


@query(f"WITH {_GRID} SELECT id AS pand_id, edge_id, CAST(round(snap_m * 100000000) AS BIGINT) AS snap, CAST(round(share * 100 * 100000000) AS BIGINT) AS plaats FROM placed")
def snapped_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = _grid(spark, sf_dir)
    got = access.on_network(_buildings(spark, sf_dir), net, "pand_id", 60.0)
    return got.select("pand_id", "edge_id", _fine(F.col("snap_m")).alias("snap"), _fine(F.col("position_m")).alias("plaats"))


#: Facilities stand where every 40th building does. Costs are whole thousandths of a minute, so sums are exact.
_SEEDS = """fac AS (SELECT id AS target, u, v, minutes, forward, backward, share, snap_m FROM placed WHERE id % 40 = 0),
seeds AS (SELECT node, min({'c': cost, 't': target}) AS k FROM (SELECT u AS node, target, share * minutes + snap_m / 80.0 AS cost FROM fac WHERE forward UNION ALL SELECT v, target, (1 - share) * minutes + snap_m / 80.0 FROM fac WHERE backward) GROUP BY node),
e AS (SELECT src, dst, min(w) AS w FROM (SELECT u AS src, v AS dst, minutes AS w FROM ways WHERE forward UNION ALL SELECT v, u, minutes FROM ways WHERE backward) GROUP BY ALL)"""
_COSTS = """d(node, cost, target) USING KEY (node) AS (SELECT node, k.c, k.t FROM seeds
  UNION SELECT src, k.c, k.t FROM (SELECT e.src, min({'c': d.cost + e.w, 't': d.target}) AS k FROM d JOIN e ON e.dst = d.node GROUP BY e.src) x
  LEFT JOIN recurring.d r ON r.node = x.src WHERE r.node IS NULL OR k.c < r.cost OR (k.c = r.cost AND k.t < r.target))"""


def _origin(rows: str) -> str:
    return f"""SELECT p.id, p.edge_id, p.snap_m, least(CASE WHEN backward THEN share * minutes + a.cost END, CASE WHEN forward THEN (1 - share) * minutes + b.cost END) AS network_min,
  least(CASE WHEN backward THEN share * minutes + a.cost END, CASE WHEN forward THEN (1 - share) * minutes + b.cost END) + snap_m / 80.0 AS total_min FROM {rows} p LEFT JOIN d a ON a.node = p.u LEFT JOIN d b ON b.node = p.v"""


@query(f"WITH {_GRID}, {_SEEDS} SELECT node, CAST(round(k.c * 100000000) AS BIGINT) AS kosten, k.t AS target FROM seeds")
def edge_snap_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = _grid(spark, sf_dir)
    seeds = network.seed_costs(access.on_network(_buildings(spark, sf_dir, "target").where("target % 40 = 0"), net, "target", 60.0), F.lit(80.0))
    return relational.first_per_key(seeds, ["node"], [F.col("cost"), F.col("target")]).select("node", _fine(F.col("cost")).alias("kosten"), "target")


@query(f"WITH RECURSIVE {_GRID}, {_SEEDS}, {_COSTS}, o AS ({_origin('placed')}) SELECT id AS pand_id, edge_id, CAST(round(network_min * 100000000) AS BIGINT) AS netwerk, CAST(round(total_min * 100000000) AS BIGINT) AS totaal FROM o")
def origin_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = _grid(spark, sf_dir)
    seeds = network.seed_costs(access.on_network(_buildings(spark, sf_dir, "target").where("target % 40 = 0"), net, "target", 60.0), F.lit(80.0))
    costs = network.shortest_paths(net.edges, seeds)
    got = network.origin_costs(access.on_network(_buildings(spark, sf_dir), net, "pand_id", 60.0), costs, F.lit(80.0))
    return got.select("pand_id", "edge_id", _fine(F.col("network_min")).alias("netwerk"), _fine(F.col("total_min")).alias("totaal"))


@query(f"""WITH RECURSIVE {_GRID}, {_SEEDS}, {_COSTS}, o AS ({_origin('placed')}), again AS (SELECT id, min(total_min) AS t FROM ({_origin('(SELECT * FROM found WHERE snap_m <= 60)')}) GROUP BY id),
r AS (SELECT c.id, CASE WHEN o.id IS NULL THEN NULL WHEN (o.total_min IS NULL OR o.total_min > 4) AND (o.total_min IS NULL OR again.t < o.total_min) THEN again.t ELSE o.total_min END AS t FROM c LEFT JOIN o ON o.id = c.id LEFT JOIN again ON again.id = c.id)
SELECT id AS pand_id, CAST(round(round_even(t, 2) * 100) AS BIGINT) AS honderdsten, t IS NOT NULL AS reachable, coalesce(t <= 4, false) AS within, 'lopen' AS modus FROM r""")
def direct_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = _buildings(spark, sf_dir, "target").where("target % 40 = 0")
    got = access.direct(_buildings(spark, sf_dir), places, _grid(spark, sf_dir), "lopen", 4.0, radius=60.0)
    return got.select("pand_id", F.round(F.col("total_min") * 100).cast("bigint").alias("honderdsten"), "reachable", "within", "modus")


@query("""WITH RECURSIVE l AS (SELECT l_suppkey AS u, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS v, l_quantity AS w FROM lineitem),
e AS (SELECT src, dst, min(w) AS w FROM (SELECT u AS src, v AS dst, CAST(w AS BIGINT) * 1000000 + (u * 7919 + v * 104729) % 999983 AS w FROM l WHERE v IS NOT NULL AND u <> v UNION ALL SELECT v, u, CAST(w AS BIGINT) * 1000000 + (u * 7919 + v * 104729) % 999983 FROM l WHERE v IS NOT NULL AND u <> v AND w % 2 = 0) GROUP BY ALL),
d(node, cost) USING KEY (node) AS (SELECT s_suppkey, CAST(s_suppkey AS BIGINT) FROM supplier WHERE s_acctbal > 4500
  UNION SELECT x.src, x.c FROM (SELECT e.src, min(d.cost + e.w) AS c FROM d JOIN e ON e.dst = d.node GROUP BY e.src) x LEFT JOIN recurring.d r ON r.node = x.src WHERE r.node IS NULL OR x.c < r.cost),
hop AS (SELECT e.src, arg_min(e.dst, e.w + b.cost) AS dst, min(e.w + b.cost) AS c, any_value(a.cost) AS own FROM e JOIN d a ON a.node = e.src JOIN d b ON b.node = e.dst GROUP BY e.src HAVING min(e.w + b.cost) <= any_value(a.cost)),
walk(start, src, dst) AS (SELECT src, src, dst FROM hop UNION ALL SELECT w.start, h.src, h.dst FROM walk w JOIN hop h ON h.src = w.dst),
n AS (SELECT l_suppkey AS start, count(*) AS panden FROM lineitem GROUP BY 1)
SELECT src, dst, CAST(sum(panden) AS BIGINT) AS panden FROM walk JOIN n USING (start) GROUP BY src, dst""")
def flow_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights are told apart in their lower digits, so that every node has one best way on."""
    edges = catalog._lines(spark, sf_dir).withColumn("minutes", (F.col("minutes").cast("bigint") * 1000000 + (F.col("u") * 7919 + F.col("v") * 104729) % 999983).cast("double"))
    seeds = table(spark, sf_dir, "supplier").where("s_acctbal > 4500").select(F.col("s_suppkey").alias("node"), F.col("s_suppkey").cast("double").alias("cost"), F.col("s_suppkey").alias("target"))
    tree = network.shortest_paths(network.directed_edges(edges), seeds)
    starts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("node")).agg(F.count("*").alias("panden"))
    return network.flow_counts(starts, tree).select("src", "dst", "panden")


@query(f"""WITH {_GRID}, w AS (SELECT DISTINCT edge_id, ax, ay, bx, by_ FROM ways WHERE edge_id % 20 < 10 AND edge_id % 10 = 0), k AS (SELECT id, x, y, x + 3 AS x2, y FROM c)
SELECT k.id AS edge_id, min(w.edge_id) AS overlap_auto_wvk_id FROM k JOIN w ON abs(k.y - w.ay) <= 1.0 AND k.x2 >= w.ax - 1.0 AND k.x <= w.bx + 1.0 WHERE greatest(0.0, w.ax - k.x2, k.x - w.bx) * greatest(0.0, w.ax - k.x2, k.x - w.bx) + (k.y - w.ay) * (k.y - w.ay) <= 1.0 GROUP BY k.id""")
def shared_with_cars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short ways beside long straight car ways, whose points are a hundred metres apart."""
    cars = _grid(spark, sf_dir).ways.where("edge_id % 20 < 10 and edge_id % 10 = 0").select(F.col("edge_id").alias("wvk_id"), "line")
    ways = _buildings(spark, sf_dir, "edge_id").select("edge_id", F.lit(None).cast("bigint").alias("wvk_id"), F.array(geometry.point(F.col("x"), F.col("y")), geometry.point(F.col("x") + 3, F.col("y"))).alias("line"))
    return roads.shared_with_cars(ways, cars).where("overlap_met_auto").select("edge_id", "overlap_auto_wvk_id")


_DAY = f"""{catalog._STOPS}, t AS (SELECT trip_id, stop_sequence, stop_id, departure_seconds, lead(stop_id) OVER w AS to_stop, lead(arrival_seconds) OVER w AS arr FROM st WINDOW w AS (PARTITION BY trip_id ORDER BY stop_sequence))"""


@query(f"""WITH {_DAY}, n(stop_id, node) AS (VALUES ('purchase', 1), ('click', 2), ('view', 3), ('cart', 4)), a AS (SELECT * FROM t WHERE departure_seconds BETWEEN 21600 AND 72000 AND arr > departure_seconds AND trip_id % 100000 % 3 <> 0)
SELECT DISTINCT departure_seconds AS dep, arr, CAST(x.node AS INTEGER) AS src, CAST(y.node AS INTEGER) AS dst FROM a JOIN n x ON x.stop_id = a.stop_id JOIN n y ON y.stop_id = a.to_stop""")
def day_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = transit.stop_edges(catalog._stops(spark, sf_dir)).select((F.col("trip_id") % 100000).alias("service_id"), "from_stop_id", "to_stop_id", F.col("from_departure_seconds").alias("departure"), F.col("to_arrival_seconds").alias("arrival"))
    services = edges.select("service_id").distinct().where("service_id % 3 <> 0")
    nodes = transit.stop_nodes(spark.createDataFrame([(9, "purchase, click"), (1, "purchase"), (2, " click"), (3, "view"), (4, "cart,")], "node_id int, stop_ids string"))
    return transit.connections(edges, services, nodes, 21600, 72000)


@query(f"""{catalog._FIXED} SELECT from_stop_id, to_stop_id, mode, count(DISTINCT trip_id) AS trips, CAST(round(avg(seconds / 60.0) * 100000000) AS BIGINT) AS gemiddeld FROM fixed WHERE from_stop_id = 'purchase' OR to_stop_id = 'purchase' GROUP BY ALL""")
def regional_segment_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = transit.corrected_edges(transit.stop_edges(catalog._stops(spark, sf_dir), keep=["mode"])).withColumn("a", F.col("from_stop_id") == "purchase").withColumn("b", F.col("to_stop_id") == "purchase")
    got = transit.segment_summary(transit.regional_edges(edges, "a", "b"), ["from_stop_id", "to_stop_id", "mode"])
    return got.select("from_stop_id", "to_stop_id", "mode", "trips", _fine(F.col("mean_min")).alias("gemiddeld"))


@query(f"""{catalog._FIXED}, q AS (SELECT count(*) AS rows, count(*) FILTER (WHERE seconds IS NULL) AS nulls, count(*) FILTER (WHERE seconds < 0) AS negative, count(*) FILTER (WHERE seconds = 0) AS zero, count(*) FILTER (WHERE seconds <> original_seconds) AS corrected, max(seconds) AS m, median(seconds) AS median_seconds FROM fixed)
SELECT * EXCLUDE (m), printf('%02d:%02d:%02d', m // 3600, m % 3600 // 60, m % 60) AS most FROM q""")
def travel_time_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = transit.corrected_edges(transit.stop_edges(catalog._stops(spark, sf_dir), keep=["mode"]))
    return transit.time_quality(edges, "seconds", "original_seconds").drop("least")


@query("""WITH r AS (SELECT p_partkey AS route_id, CAST(p_size % 5 AS VARCHAR) AS route_type, p_size % 4 AS agency_id, CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE p_brand END AS kort FROM part), a(agency_id, naam) AS (VALUES (0, 'Arriva'), (1, 'NS'), (2, 'Onbekend'))
SELECT r.route_id, CASE CAST(route_type AS INT) WHEN 2 THEN 'train' WHEN 3 THEN 'bus' WHEN 4 THEN 'ferry' END AS mode, naam AS operator, coalesce(nullif(trim(kort), ''), CAST(r.route_id AS VARCHAR)) AS line_id, count(l_orderkey) AS trips
FROM r JOIN a ON a.agency_id = r.agency_id LEFT JOIN lineitem ON l_partkey = r.route_id WHERE naam IN ('Arriva', 'NS') AND CAST(route_type AS INT) IN (2, 3, 4) GROUP BY ALL HAVING count(l_orderkey) > 0""")
def routes_and_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    raw = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("route_id"), (size % 5).cast("string").alias("route_type"), (size % 4).cast("string").alias("agency_id"), F.when(F.col("p_partkey") % 3 == 0, " ").otherwise(F.col("p_brand")).alias("route_short_name"), F.col("p_name").alias("route_long_name"))
    agency = spark.createDataFrame([("0", "Arriva"), ("1", "NS"), ("2", "Onbekend")], "agency_id string, agency_name string")
    trips = transit.trips(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("route_id"), "l_orderkey"), transit.routes(raw, agency))
    return trips.groupBy("route_id", "mode", "operator", "line_id").agg(F.count("*").alias("trips"))


@query("""WITH RECURSIVE p AS (SELECT l_suppkey AS src, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS dst, l_quantity AS w FROM lineitem),
r AS (SELECT src, dst, min(w) AS w FROM p WHERE dst IS NOT NULL AND src <> dst GROUP BY ALL),
e AS (SELECT src * 2 AS src, dst * 2 + 1 AS dst, w FROM r UNION ALL SELECT src * 2 + 1, dst * 2 + 1, w FROM r UNION ALL SELECT s_suppkey * 2 + 1, (s_suppkey + 1) * 2 + 1, 4 FROM supplier),
m AS (SELECT src, dst, min(w) AS w FROM e GROUP BY ALL),
d(node, cost, target) USING KEY (node) AS (SELECT s_suppkey * 2 + 1, CAST(s_suppkey % 4 AS DOUBLE), s_suppkey FROM supplier WHERE s_acctbal > 7500
  UNION SELECT src, k.c, k.t FROM (SELECT m.src, min({'c': d.cost + m.w, 't': d.target}) AS k FROM d JOIN m ON m.dst = d.node GROUP BY m.src) x LEFT JOIN recurring.d q ON q.node = x.src WHERE q.node IS NULL OR k.c < q.cost OR (k.c = q.cost AND k.t < q.target))
SELECT node // 2 AS node, cost AS minutes, target FROM d WHERE node % 2 = 0""")
def transit_static_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = transit.stop_pairs(catalog._lines(spark, sf_dir).select(F.col("u").alias("src"), F.col("v").alias("dst"), F.col("minutes").cast("double").alias("minutes")))
    s = table(spark, sf_dir, "supplier")
    walks = s.select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") + 1).alias("dst"), F.lit(4.0).alias("minutes"))
    egress = s.where("s_acctbal > 7500").select(F.col("s_suppkey").alias("node"), (F.col("s_suppkey") % 4).cast("double").alias("minutes"), F.col("s_suppkey").alias("target"))
    return transit.static_minutes(pairs, walks, egress)


@query(f"""WITH {_GRID} SELECT a.id AS src, b.id AS dst, CAST(round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 80.0 * 100000000) AS BIGINT) AS minuten FROM c a JOIN c b ON a.id <> b.id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 40""")
def transfer_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transit.transfers(_buildings(spark, sf_dir, "node"), 40.0).select("src", "dst", _fine(F.col("minutes")).alias("minuten"))


@query(f"""WITH {_GRID}, s AS (SELECT g.k AS stop_id, c.id AS halte_id, sqrt((g.x - c.x) * (g.x - c.x) + (g.y - c.y) * (g.y - c.y)) AS m FROM g LEFT JOIN c ON sqrt((g.x - c.x) * (g.x - c.x) + (g.y - c.y) * (g.y - c.y)) <= 30 QUALIFY row_number() OVER (PARTITION BY g.k ORDER BY m, c.id) = 1)
SELECT stop_id, halte_id, halte_id IS NOT NULL AS in_regio FROM s""")
def official_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    stops = table(spark, sf_dir, "supplier").select(k.alias("stop_id"), (k % 10 * 100).cast("double").alias("x"), (F.floor(k / 10) * 100).cast("double").alias("y"))
    official = _buildings(spark, sf_dir, "halte_id").withColumnsRenamed({"x": "rx", "y": "ry"})
    return transit.stops_with_official(stops, official, 30.0).select("stop_id", "halte_id", "in_regio")


@query(f"""WITH {_GRID}, f AS (SELECT * FROM c WHERE id % 4 = 0), r AS (SELECT * FROM c WHERE id % 4 = 1) SELECT id, 'kaart' AS bron FROM f UNION ALL SELECT id, 'register' FROM r WHERE NOT EXISTS (SELECT 1 FROM f WHERE sqrt((f.x - r.x) * (f.x - r.x) + (f.y - r.y) * (f.y - r.y)) <= 25)""")
def merged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _buildings(spark, sf_dir, "id")
    return facilities.merge_sources(rows.where("id % 4 = 0").withColumn("bron", F.lit("kaart")), rows.where("id % 4 = 1").withColumn("bron", F.lit("register")), "id", 25.0).select("id", "bron")


_BOXES = "b AS (SELECT k AS pand_id, x + 10 AS x1, y + 10 AS y1, x + 60 AS x2, y + 60 AS y2 FROM g)"


@query(f"""WITH {_GRID}, {_BOXES}, i AS (SELECT c.id, min(pand_id) AS pand_id FROM c JOIN b ON x > x1 AND x < x2 AND y > y1 AND y < y2 GROUP BY c.id),
o AS (SELECT c.id, b.pand_id, sqrt(pow(greatest(x1 - x, 0, x - x2), 2) + pow(greatest(y1 - y, 0, y - y2), 2)) AS m FROM c JOIN b ON c.id NOT IN (SELECT id FROM i) WHERE m <= 15 QUALIFY row_number() OVER (PARTITION BY c.id ORDER BY m, b.pand_id) = 1)
SELECT c.id, coalesce(i.pand_id, o.pand_id) AS pand_id, CASE WHEN i.id IS NOT NULL THEN 'within' WHEN o.id IS NOT NULL THEN 'nearest' ELSE 'geen_match' END AS bag_match_type, CASE WHEN i.id IS NOT NULL THEN 0 ELSE CAST(round(round_even(o.m, 2) * 100) AS BIGINT) END AS cm FROM c LEFT JOIN i ON i.id = c.id LEFT JOIN o ON o.id = c.id""")
def points_to_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    x, y = k % 10 * 100 + 10, F.floor(k / 10) * 100 + 10
    ring = F.array(*[geometry.point(x + dx, y + dy) for dx, dy in ((0, 0), (50, 0), (50, 50), (0, 50), (0, 0))])
    boxes = table(spark, sf_dir, "supplier").select(k.alias("pand_id"), F.array(ring).alias("polygon"))
    got = spatial.match_buildings(_buildings(spark, sf_dir, "id"), boxes, "id", radius=15.0)
    return got.select("id", "pand_id", "bag_match_type", F.round(F.col("bag_afstand_meter") * 100).cast("bigint").alias("cm"))


@query(f"""WITH {catalog._ACCESS}, s AS (SELECT pand_id, regel, CASE WHEN minutes IS NULL THEN 'geen_betrouwbare_route' WHEN within THEN 'binnen_norm' ELSE 'buiten_norm' END AS status, regel % 7 AS n FROM access)
SELECT pand_id, regel, status, CASE status WHEN 'binnen_norm' THEN '#2ca25f' WHEN 'buiten_norm' THEN '#de2d26' ELSE '#9e9e9e' END AS kleur,
  CASE WHEN n = 6 THEN 'datacontrole_uitvoeren' WHEN n = 1 THEN '1_modaliteit_onvoldoende' ELSE n || '_modaliteiten_onvoldoende' END AS categorie,
  CASE WHEN n = 6 THEN 'Geen woningen' WHEN n = 0 THEN 'Alle modaliteiten voldoen' WHEN n = 1 THEN '1 modaliteit onvoldoende' WHEN n = 5 THEN 'Geen modaliteit voldoet' ELSE n || ' modaliteiten onvoldoende' END AS label,
  CASE WHEN regel <= 1 THEN 1 WHEN regel <= 5 THEN 2 ELSE 3 END AS band FROM s""")
def building_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.access(spark, sf_dir)
    status = classes.norm_status(F.col("minutes"), F.col("within"))
    style = classes.bottleneck(F.when(F.col("regel") % 7 != 6, F.col("regel") % 7))
    return rows.select("pand_id", "regel", status.alias("status"), classes.status_colour(status).alias("kleur"), style["categorie"].alias("categorie"), style["label"].alias("label"), classes.band_of(F.col("regel").cast("double"), [1.0, 5.0, 10.0]).alias("band"))


@query(f"""{catalog._BEST}, a AS (SELECT buurt, count(pand_id) AS panden_aantal, count(minutes) AS panden_met_reistijd, count(*) FILTER (WHERE within) AS panden_binnen_norm, CAST(median(minutes) AS DOUBLE) AS reistijd_mediaan_min FROM chosen GROUP BY buurt),
q AS (SELECT buurt, modus, count(*) AS n FROM chosen WHERE modus IS NOT NULL GROUP BY buurt, modus), m AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY buurt ORDER BY n DESC, modus) = 1),
z AS (SELECT a.*, m.modus AS dominante_modus, panden_binnen_norm * 100.0 / panden_aantal AS pct FROM a LEFT JOIN m USING (buurt))
SELECT * EXCLUDE (pct), {catalog._BAND.format(p="pct")} AS klasse, CASE WHEN pct < 20 THEN '#d73027' WHEN pct < 40 THEN '#fc8d59' WHEN pct < 60 THEN '#fee08b' WHEN pct < 80 THEN '#d9ef8b' ELSE '#1a9850' END AS kleur FROM z""")
def multimodal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = rollup.best_of_modes(catalog.access(spark, sf_dir), ["pand_id", "buurt"], catalog.MODES)
    return rollup.multimodal_summary(chosen, ["buurt"]).select("buurt", "panden_aantal", "panden_met_reistijd", "panden_binnen_norm", "reistijd_mediaan_min", "dominante_modus", "klasse", "kleur")


@query("""SELECT coalesce(nullif(trim(CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE c_mktsegment END), ''), '(leeg)') AS segment, count(*) AS aantal FROM customer GROUP BY 1""")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.value_counts(table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 5 == 0, " ").otherwise(F.col("c_mktsegment")).alias("segment")), "segment")


@query("""SELECT o_orderkey AS pand_id, strftime(o_orderdate, '%Y-%m-%d') AS eind FROM orders WHERE o_orderstatus <> 'F' OR strftime(o_orderdate, '%Y-%m-%d') >= '1995-01-01'""")
def still_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pand_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("dag"), F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("").alias("eind"))
    return register.still_valid(rows, "eind", "1995-01-01").select("pand_id", F.col("dag").alias("eind"))


@query("""WITH c AS (SELECT o_custkey AS service_id, min(strftime(o_orderdate, '%Y%m%d')) AS a, max(strftime(o_orderdate, '%Y%m%d')) AS b FROM orders GROUP BY 1), x AS (SELECT o_custkey AS service_id, o_orderstatus AS s FROM orders WHERE strftime(o_orderdate, '%Y%m%d') = '19960605')
SELECT service_id FROM (SELECT service_id FROM c WHERE service_id % 2 = 0 AND '19960605' BETWEEN a AND b UNION SELECT service_id FROM x WHERE s <> 'F') WHERE service_id NOT IN (SELECT service_id FROM x WHERE s = 'F')""")
def weekday_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even services run on Wednesdays between their first and last day; 5 June 1996 was one."""
    day = F.date_format("o_orderdate", "yyyyMMdd")
    o = table(spark, sf_dir, "orders")
    runs = F.when(F.col("service_id") % 2 == 0, "1").otherwise("0")
    c = o.groupBy(F.col("o_custkey").alias("service_id")).agg(F.min(day).alias("start_date"), F.max(day).alias("end_date")).select("*", *[(runs if d == "wednesday" else F.lit("0")).alias(d) for d in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")])
    x = o.select(F.col("o_custkey").alias("service_id"), day.alias("date"), F.when(F.col("o_orderstatus") == "F", "2").otherwise("1").alias("exception_type"))
    return relational.active_services(c, x, "19960605")


@query("""WITH s AS (SELECT o_orderpriority AS klasse, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS l, count(*) AS segmenten FROM orders GROUP BY 1) SELECT klasse, segmenten, CAST(round(l * 1000000 / sum(l) OVER ()) AS BIGINT) AS miljoensten FROM s""")
def network_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("klasse"), F.col("o_totalprice").cast("decimal(18,2)").alias("lengte"))
    return rollup.length_shares(rows, "klasse", "lengte").select("klasse", "segmenten", F.round(F.col("aandeel").cast("double") * 1000000).cast("bigint").alias("miljoensten"))


@query("""SELECT s_suppkey AS shape_id, CAST(4 AS INTEGER) AS punten, s_suppkey % 10 + 0.0 AS x0, s_suppkey % 10 + 3.0 AS x3 FROM supplier WHERE s_suppkey % 5 <> 0""")
def shape_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four points in falling order of rows, one point where the id is a fifth."""
    k = F.col("s_suppkey")
    points = table(spark, sf_dir, "supplier").withColumn("n", F.explode(F.when(k % 5 == 0, F.array(F.lit(1))).otherwise(F.array(*[F.lit(n) for n in (11, 10, 9, 2)])))).select(k.alias("shape_id"), F.col("n").cast("string").alias("shape_pt_sequence"), (k % 10 + F.when(F.col("n") == 2, 0).otherwise(F.col("n") - 8)).cast("string").alias("shape_pt_lon"), F.lit("53").alias("shape_pt_lat"))
    return transit.shapes(points).select("shape_id", F.size("line").alias("punten"), F.col("line")[0]["x"].alias("x0"), F.col("line")[3]["x"].alias("x3"))


@query("""SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '#00000001') AND c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 30""")
def text_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transit.lookup(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_name", None, "#00000001", equal={"c_mktsegment": "BUILDING"}, order=["c_custkey"]).select("c_custkey", "c_name")


@query("""SELECT s_suppkey AS ov_id, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN s_name END, CASE WHEN s_suppkey % 3 = 1 THEN 'Halte ' || s_name END, CAST(s_suppkey AS VARCHAR)) AS name FROM supplier""")
def transit_facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    stops = table(spark, sf_dir, "supplier").select(k.alias("node_id"), F.when(k % 3 == 0, F.col("s_name")).otherwise(" ").alias("halte_naam"), F.when(k % 3 == 1, F.concat(F.lit("Halte "), "s_name")).alias("stop_names"), F.lit("bus").alias("modes"), F.lit(5.1).alias("lon"), F.lit(53.1).alias("lat"))
    return facilities.stops_as_facilities(stops).select("ov_id", "name")


@query("""SELECT CAST(row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS klant_id, c_custkey FROM customer""")
def numbered_facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.lit(5.0).alias("lon"), F.lit(53.0).alias("lat"))
    return facilities.numbered(rows, [F.col("c_acctbal").desc(), F.col("c_custkey")], "klant").select("klant_id", "c_custkey")


@query(f"""WITH {catalog._ACCESS}, a AS (SELECT gemeente, buurt, count(pand_id) AS panden_aantal FROM access WHERE modus = 'auto' GROUP BY ALL), p AS (SELECT n_name AS buurt, r_name AS gemeente, n_nationkey % 5 = 0 AS water FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT p.buurt, p.gemeente, a.panden_aantal, a.panden_aantal IS NOT NULL AS heeft_analyse, 'aut' AS modaliteit_code FROM p LEFT JOIN a USING (gemeente, buurt) WHERE NOT water""")
def area_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = rollup.area_summary(catalog.access(spark, sf_dir).where("modus = 'auto'"), ["gemeente", "buurt"])
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    layer = nations.select(F.col("n_name").alias("buurt"), F.col("r_name").alias("gemeente"), (F.col("n_nationkey") % 5 == 0).alias("is_waterbuurt"))
    return rollup.area_layer(layer, areas, ["gemeente", "buurt"], "auto").select("buurt", "gemeente", "panden_aantal", "heeft_analyse", "modaliteit_code")


@query("""SELECT o_orderkey AS pand_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey IN (3, 8)""")
def municipality_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    buildings = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pand_id"), "o_custkey").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("pand_id", F.concat(F.lit("GM"), F.col("c_nationkey")).alias("gemeentecode"))
    return register.in_municipalities(buildings, ["gm8", "0003"]).select("pand_id")
