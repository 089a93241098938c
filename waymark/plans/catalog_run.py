"""Driver queries of what a run consists of: stops and transit, register rows, garages, water, areas of reports; each beside its SQL.

Ways, buildings and facilities are those of ``catalog_core``'s street grid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import geometry
from waymark.operators import access, facilities, maplayers, register, reports, roads, spatial, transit
from waymark.plans import catalog, catalog_core
from waymark.plans.catalog import query, table
from waymark.plans.catalog_core import _BOXES, _COSTS, _GRID, _SEEDS, _buildings, _grid, _origin

#: Stops stand at every 30th building; what is left behind a stop follows from its number.
_TRANSIT = f"""{_GRID}, {_SEEDS}, {_COSTS},
rest AS (SELECT id AS stop, unnest([{{'p': 'mediaan', 'm': 4.0 + id % 7}}, {{'p': 'min', 'm': 2.0 + id % 5}}, {{'p': 'p90', 'm': 9.0 + id % 11}}], recursive := true) FROM c WHERE id % 30 = 0),
seeds3 AS (SELECT p, node, min({{'c': cost, 't': stop}}) AS k FROM (SELECT p, u AS node, stop, share * minutes + (snap_m / 80.0 + m) AS cost FROM placed JOIN rest ON stop = id WHERE forward UNION ALL SELECT p, v, stop, (1 - share) * minutes + (snap_m / 80.0 + m) FROM placed JOIN rest ON stop = id WHERE backward) GROUP BY p, node),
d3(p, node, cost, target) USING KEY (p, node) AS (SELECT p, node, k.c, k.t FROM seeds3
  UNION SELECT x.p, src, k.c, k.t FROM (SELECT d3.p, e.src, min({{'c': d3.cost + e.w, 't': d3.target}}) AS k FROM d3 JOIN e ON e.dst = d3.node GROUP BY d3.p, e.src) x
  LEFT JOIN recurring.d3 r ON r.p = x.p AND r.node = x.src WHERE r.node IS NULL OR k.c < r.cost OR (k.c = r.cost AND k.t < r.target)),
each AS (SELECT q.id, n.p, least(CASE WHEN backward THEN share * minutes + a.cost END, CASE WHEN forward THEN (1 - share) * minutes + b.cost END) + snap_m / 80.0 AS t
  FROM placed q CROSS JOIN (SELECT DISTINCT p FROM rest) n LEFT JOIN d3 a ON a.p = n.p AND a.node = q.u LEFT JOIN d3 b ON b.p = n.p AND b.node = q.v),
ov AS (SELECT c.id, max(t) FILTER (WHERE p = 'mediaan') AS t, max(t) FILTER (WHERE p = 'min') AS lo, max(t) FILTER (WHERE p = 'p90') AS hi FROM c LEFT JOIN each ON each.id = c.id GROUP BY c.id),
o AS ({_origin('placed')}), again AS (SELECT id, min(total_min) AS t FROM ({_origin('(SELECT * FROM found WHERE snap_m <= 60)')}) GROUP BY id),
foot AS (SELECT c.id, round_even(CASE WHEN o.id IS NULL THEN NULL WHEN (o.total_min IS NULL OR o.total_min > 4) AND (o.total_min IS NULL OR again.t < o.total_min) THEN again.t ELSE o.total_min END, 2) AS t FROM c LEFT JOIN o ON o.id = c.id LEFT JOIN again ON again.id = c.id)"""


def _stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _buildings(spark, sf_dir, "node").where("node % 30 = 0")


def _by_transit(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("node")
    rest = _stops(spark, sf_dir).select("node", (4.0 + n % 7).alias("mediaan"), (2.0 + n % 5).alias("min"), (9.0 + n % 11).alias("p90"), (n % 40).alias("target"))
    return access.by_transit(_buildings(spark, sf_dir), _stops(spark, sf_dir), rest, _grid(spark, sf_dir), "ov_lopen", 12.0, 60.0)


@query(f"WITH RECURSIVE {_GRID}, {_SEEDS}, {_COSTS}, o AS ({_origin('(SELECT * FROM placed WHERE id % 30 = 0)')}) SELECT CAST(5 AS BIGINT) AS key, id AS node, CAST(round(total_min * 1000000 + 0.1) AS BIGINT) AS miljoensten FROM o WHERE total_min IS NOT NULL")
def stop_egress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes on foot from stops to the nearest facility."""
    places = _buildings(spark, sf_dir, "target").where("target % 40 = 0")
    got = access.stop_egress(_stops(spark, sf_dir), places, _grid(spark, sf_dir), 5, 60.0)
    return got.select("key", "node", F.round(F.col("minutes") * 1000000 + 0.1).cast("bigint").alias("miljoensten"))


@query(f"""WITH RECURSIVE {_TRANSIT} SELECT id AS pand_id, CAST(round(round_even(t, 2) * 100) AS BIGINT) AS honderdsten, CAST(round(lo * 1000000 + 0.1) AS BIGINT) AS kortste, CAST(round(hi * 1000000 + 0.1) AS BIGINT) AS langste, t IS NOT NULL AS reachable, coalesce(t <= 12, false) AS within FROM ov""")
def transit_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To a stop on foot and on by transit, by the median, the least and the 90th percentile of what is left there."""
    fine = lambda c: F.round(F.col(c) * 1000000 + 0.1).cast("bigint")
    return _by_transit(spark, sf_dir).select("pand_id", F.round(F.col("total_min") * 100).cast("bigint").alias("honderdsten"), fine("min_min").alias("kortste"), fine("p90_min").alias("langste"), "reachable", "within")


@query(f"""WITH RECURSIVE {_TRANSIT}, b AS (SELECT ov.id, round_even(ov.t, 2) AS t, foot.t AS f, coalesce(foot.t <= 4 AND (ov.t IS NULL OR foot.t < round_even(ov.t, 2)), false) AS better FROM ov JOIN foot USING (id))
SELECT id AS pand_id, CAST(round(CASE WHEN better THEN f ELSE t END * 100) AS BIGINT) AS honderdsten, CASE WHEN better THEN 'direct_access' WHEN t IS NOT NULL THEN 'ov' ELSE 'geen_route' END AS reistijd_bron, coalesce(CASE WHEN better THEN f ELSE t END <= 12, false) AS within FROM b""")
def transit_or_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transit, or walking all the way where that is within its own norm and quicker."""
    places = _buildings(spark, sf_dir, "target").where("target % 40 = 0")
    straight = access.direct(_buildings(spark, sf_dir), places, _grid(spark, sf_dir), "lopen", 4.0, radius=60.0)
    got = access.transit_or_direct(_by_transit(spark, sf_dir), straight, 4.0, 12.0)
    return got.select("pand_id", F.round(F.col("total_min") * 100).cast("bigint").alias("honderdsten"), "reistijd_bron", "within")


@query("""WITH p AS (SELECT o_orderkey AS pand_id, y.jaar FROM orders, (VALUES (1994), (1996)) y(jaar) WHERE strftime(o_orderdate, '%Y-%m-%d') <= y.jaar || '-12-31' AND (o_orderstatus <> 'F' OR strftime(o_orderdate + INTERVAL 400 DAY, '%Y-%m-%d') > y.jaar || '-12-31'))
SELECT p.pand_id, p.jaar, l_linenumber AS verblijfsobject_id FROM p LEFT JOIN lineitem ON l_orderkey = p.pand_id AND l_quantity > 25""")
def buildings_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings valid at the end of a year, with their units."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    homes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pand_id"), day("o_orderdate").alias("pand_begin_geldigheid"), F.when(F.col("o_orderstatus") == "F", day(F.date_add(F.to_date("o_orderdate"), 400))).alias("pand_eind_geldigheid"))
    units = table(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("pand_id"), F.col("l_linenumber").alias("verblijfsobject_id"))
    return register.buildings_by_year(homes, units, [1994, 1996]).select("pand_id", "jaar", "verblijfsobject_id")


def _squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square of 50 m beside every crossing."""
    k = F.col("s_suppkey")
    x, y = k % 10 * 100 + 10, F.floor(k / 10) * 100 + 10
    ring = F.array(*[geometry.point(x + dx, y + dy) for dx, dy in ((0, 0), (50, 0), (50, 50), (0, 50), (0, 0))])
    return table(spark, sf_dir, "supplier").select(k.alias("pand_id"), F.array(ring).alias("polygon"))


@query(f"""WITH {_GRID} SELECT k AS pand_id, CAST(250000 AS BIGINT) AS dm2, CAST(x + 35 AS BIGINT) AS px, CAST(y + 35 AS BIGINT) AS py, CAST(CAST(x + 35 AS BIGINT) // 500 AS VARCHAR) || '-' || CAST(CAST(y + 35 AS BIGINT) // 500 AS VARCHAR) AS buurtcode FROM g WHERE k % 5 <> 0""")
def building_neighbourhoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings in use with their area, centre and the neighbourhood around it."""
    homes = _squares(spark, sf_dir).withColumn("pand_status", F.when(F.col("pand_id") % 5 == 0, "Pand gesloopt").otherwise("Pand in gebruik"))
    centres = register.centroids(homes)
    cx, cy = F.floor(F.col("x") / 500), F.floor(F.col("y") / 500)
    cells = _squares(spark, sf_dir).select((F.col("pand_id") % 10 * 100 + 35).alias("x"), (F.floor(F.col("pand_id") / 10) * 100 + 35).alias("y")).select(cx.alias("cx"), cy.alias("cy")).distinct()
    corner = lambda dx, dy: geometry.point((F.col("cx") + dx) * 500, (F.col("cy") + dy) * 500)
    areas = cells.select(F.concat_ws("-", "cx", "cy").alias("buurtcode"), F.array(F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0))).alias("polygon"))
    whole = lambda c, by: F.round(F.col(c) * by).cast("bigint")
    got = register.with_neighbourhood(centres.drop("polygon"), areas)
    return got.select("pand_id", whole("pand_oppervlakte_m2", 100).alias("dm2"), whole("pand_x", 1).alias("px"), whole("pand_y", 1).alias("py"), "buurtcode")


@query(f"""WITH {_GRID}, {_BOXES}, a AS (SELECT 'k' || k % 40 AS sleutel, min(k) AS eerste, list(DISTINCT k) AS alle FROM g WHERE k % 3 = 0 GROUP BY 1),
i AS (SELECT c.id, min(pand_id) AS pand_id FROM c JOIN b ON c.id % 5 <> 0 AND x > x1 AND x < x2 AND y > y1 AND y < y2 GROUP BY c.id)
SELECT c.id AS garage_id, coalesce(i.pand_id, a.eerste) AS match_pand_id, CASE WHEN i.id IS NOT NULL THEN 'punt_binnen_pand' WHEN a.eerste IS NULL THEN 'geen_match' WHEN c.id % 5 <> 0 THEN 'adres_fallback_punt_niet_in_pand' ELSE 'adres_fallback_geen_punt' END AS bag_match_type,
  CASE WHEN i.id IS NOT NULL AND a.alle IS NOT NULL THEN list_contains(a.alle, i.pand_id) END AS bevestigd FROM c LEFT JOIN a ON a.sleutel = CASE WHEN c.id % 7 <> 0 THEN 'k' || c.id % 60 END LEFT JOIN i ON i.id = c.id""")
def garage_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garages to buildings by place, else by address; every fifth has no place and every seventh no address."""
    g = F.col("garage_id")
    there = g % 5 != 0
    rows = _buildings(spark, sf_dir, "garage_id").select("garage_id", F.when(there, F.col("x")).alias("x"), F.when(there, F.col("y")).alias("y"), F.when(g % 7 != 0, F.concat(F.lit("k"), g % 60)).otherwise("").alias("adres_key"))
    k = F.col("s_suppkey")
    addresses = table(spark, sf_dir, "supplier").where(k % 3 == 0).select(F.concat(F.lit("k"), k % 40).alias("adres_key"), k.alias("pand_id"))
    return register.match_garages(rows, _squares(spark, sf_dir), addresses).select("garage_id", "match_pand_id", "bag_match_type", F.col("bag_adres_valideert_punt").alias("bevestigd"))


@query(f"""WITH {_GRID}, {_BOXES} SELECT edge_id AS wvk_id, EXISTS (SELECT 1 FROM b WHERE pand_id % 4 = 0 AND (ax + bx) / 2 > x1 AND (ax + bx) / 2 < x2 AND (ay + by_) / 2 > y1 - 20 AND (ay + by_) / 2 < y2 - 20) AS op_water FROM ways""")
def ways_on_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways whose middle lies on water: squares about every fourth way to the right."""
    down = lambda ring: F.transform(ring, lambda p: geometry.point(p["x"], p["y"] - 20))
    water = _squares(spark, sf_dir).where("pand_id % 4 = 0").select(F.transform("polygon", down).alias("polygon"))
    ways = _grid(spark, sf_dir).ways.select(F.col("edge_id").alias("wvk_id"), "line")
    return roads.on_water(ways, water).select("wvk_id", "op_water")


@query(f"""WITH {_GRID} SELECT id FROM c WHERE NOT EXISTS (SELECT 1 FROM c s WHERE s.id % 40 = 0 AND (s.x - c.x) * (s.x - c.x) + (s.y - c.y) * (s.y - c.y) <= 6400)""")
def far_from_facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings without a facility within 80 m."""
    places = _buildings(spark, sf_dir, "target").where("target % 40 = 0").select(F.col("x").alias("rx"), F.col("y").alias("ry"))
    return spatial.far_from(_buildings(spark, sf_dir, "id"), places, 80.0, "id").select("id")


@query(f"""WITH {_GRID} SELECT CAST(round(avg(x) * 1000000) AS BIGINT) AS x, CAST(round(avg(y) * 1000000) AS BIGINT) AS y FROM (SELECT DISTINCT x, y FROM c WHERE CAST(id AS VARCHAR) IN ('3', '8', '20'))""")
def hub_of_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    stops = _buildings(spark, sf_dir, "id").withColumn("stop_id", F.col("id").cast("string"))
    fine = lambda c: F.round(F.col(c) * 1000000).cast("bigint").alias(c)
    return maplayers.hub(stops.unionAll(stops), ["3", "8", "20"]).select(fine("x"), fine("y"))


#: Areas by mode: neighbourhoods are nations, municipalities are regions; shares in millionths.
_AREAS = """small AS (SELECT modus, gemeente, buurt, count(*) AS n, count(*) FILTER (WHERE within) AS w FROM access GROUP BY ALL), large AS (SELECT modus, gemeente, sum(n) AS n, sum(w) AS w FROM small GROUP BY ALL),
stats AS (SELECT modus, gemeente, count(*) AS buurten, count(*) FILTER (WHERE w * 100.0 / n < 80) AS onder FROM small GROUP BY ALL)"""


def _areas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = catalog._report(spark, sf_dir).withColumn("gemeentecode", F.col("gemeente")).withColumn("buurtcode", F.col("buurt"))
    return reports.area_table(rows, ["gemeentecode", "buurtcode"]), reports.area_table(rows, ["gemeentecode"])


@query(f"""WITH {catalog._ACCESS}, {_AREAS} SELECT modus, gemeente AS gemeentecode, buurt AS buurtcode, n AS panden_aantal, w AS panden_binnen_norm, n - w AS panden_buiten_norm, CAST(round(w * 100.0 / n * 1000000) AS BIGINT) AS binnen, CAST(round((100 - w * 100.0 / n) * 1000000) AS BIGINT) AS buiten, w * 100.0 / n < 80 AS onder_80 FROM small""")
def report_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _areas(spark, sf_dir)[0]
    return rows.select("modus", "gemeentecode", "buurtcode", "panden_aantal", "panden_binnen_norm", "panden_buiten_norm", F.round(F.col("percentage_binnen") * 1000000).cast("bigint").alias("binnen"), F.round(F.col("percentage_buiten") * 1000000).cast("bigint").alias("buiten"), "onder_80")


@query(f"""WITH {catalog._ACCESS}, {_AREAS} SELECT modus, gemeente AS gemeentecode, CAST(n AS BIGINT) AS panden_aantal, buurten, onder AS buurten_onder_80, CAST(round(onder * 100.0 / buurten * 1000000) AS BIGINT) AS aandeel,
CASE WHEN w * 100.0 / n >= 80 THEN 'Goed' WHEN w * 100.0 / n >= 60 THEN 'Vereist aandacht' WHEN w * 100.0 / n >= 40 THEN 'Knelpunt' ELSE 'Ernstig knelpunt' END AS klasse FROM large JOIN stats USING (modus, gemeente)""")
def report_municipalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Municipalities with how many of their neighbourhoods stay under 80 percent."""
    small, large = _areas(spark, sf_dir)
    got = reports.municipalities_with_neighbourhoods(large, small)
    return got.select("modus", "gemeentecode", "panden_aantal", "buurten", "buurten_onder_80", F.round(F.col("percentage_buurten_onder_80") * 1000000).cast("bigint").alias("aandeel"), "klasse")


@query(f"""WITH {catalog._ACCESS}, s AS (SELECT CASE WHEN pand_id % 2 = 0 THEN 'nu' ELSE 'straks' END AS casus, modus, buurt, count(*) AS n, count(*) FILTER (WHERE within) AS w FROM access GROUP BY ALL)
SELECT casus, modus, CAST(sum(n) AS BIGINT) AS panden, CAST(sum(w) AS BIGINT) AS binnen, count(*) FILTER (WHERE w * 100.0 / n < 80) AS buurten_onder_80, CAST(round(sum(w) * 100.0 / sum(n) * 1000000) AS BIGINT) AS aandeel FROM s GROUP BY ALL""")
def report_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two cases side by side: even and odd buildings."""
    rows = catalog._report(spark, sf_dir).withColumn("casus", F.when(F.col("pand_id") % 2 == 0, "nu").otherwise("straks")).withColumn("buurtcode", F.col("buurt"))
    return reports.case_overview(rows).select("casus", "modus", "panden", "binnen", "buurten_onder_80", F.round(F.col("percentage_binnen") * 1000000).cast("bigint").alias("aandeel"))


#: Priorities are facilities; only those that have all five modes count.
_PLACES = f"""{catalog._ACCESS}, q AS (SELECT o_orderpriority AS facility, a.* FROM access a JOIN orders ON o_orderkey = pand_id WHERE NOT (o_orderpriority LIKE '5%' AND modus = 'fiets')), whole AS (SELECT facility FROM q GROUP BY 1 HAVING count(DISTINCT modus) = 5),
t AS (SELECT facility, modus, count(*) AS n, count(*) FILTER (WHERE NOT within) AS out, CASE modus WHEN 'lopen' THEN 1 WHEN 'fiets' THEN 2 WHEN 'auto' THEN 3 WHEN 'ov_lopen' THEN 4 ELSE 5 END AS k FROM q SEMI JOIN whole USING (facility) GROUP BY ALL),
z AS (SELECT facility, count(*) FILTER (WHERE b = 5) * 100.0 / count(*) AS nergens FROM (SELECT facility, pand_id, count(*) FILTER (WHERE NOT within) AS b FROM q GROUP BY ALL) GROUP BY 1)"""


@query(f"""WITH {_PLACES} SELECT facility, modus, CASE WHEN row_number() OVER (PARTITION BY facility ORDER BY CAST(out * 100.0 / n AS DOUBLE) DESC, out DESC, k) = 1 THEN 'Ja' ELSE 'Nee' END AS zwakste_modaliteit,
CAST(row_number() OVER (PARTITION BY modus ORDER BY CAST(out * 100.0 / n AS DOUBLE) DESC, out DESC, CAST(nergens AS DOUBLE) DESC, facility) AS INTEGER) AS positie_binnen_modaliteit FROM t JOIN z USING (facility)""")
def report_weakest_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pand_id"), F.col("o_orderpriority").alias("facility"))
    rows = catalog._report(spark, sf_dir).drop("facility").join(names, "pand_id").where("not (facility like '5%' and modus = 'fiets')")
    whole = reports.complete_runs(rows)
    got = reports.weakest_modes(reports.mode_table(whole), reports.insufficient_counts(whole))
    return got.select("facility", "modus", "zwakste_modaliteit", "positie_binnen_modaliteit")


#: Corrections of the made stops below; the second overrules the first between stops 1 and 2.
_BY_HAND = (
    {"operator": "Arriva", "line_ids": ["1", "2", "3"], "halte_a": "Halte 1", "halte_b": "halte", "travel_time_min": 7, "reden": "ruim"},
    {"operator": "Arriva", "line_ids": ["2"], "halte_a": "HALTE, 2", "halte_b": "halte 1", "travel_time_min": 2.5, "reden": "krap"},
)


@query("""WITH e AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 3 = 0 THEN 'NS' ELSE 'Arriva' END AS operator, CAST(l_partkey % 5 AS VARCHAR) AS line_id, CAST(l_partkey % 4 AS VARCHAR) AS a, CASE WHEN l_suppkey % 11 <> 0 THEN CAST(l_suppkey % 4 AS VARCHAR) END AS b, CAST(l_quantity AS DOUBLE) AS t FROM lineitem),
f AS (SELECT *, coalesce(operator = 'Arriva' AND line_id IN ('1', '2', '3') AND (a = '1' OR b = '1') AND b IS NOT NULL, false) AS ruim, coalesce(operator = 'Arriva' AND line_id = '2' AND (a = '1' AND b = '2' OR a = '2' AND b = '1'), false) AS krap FROM e)
SELECT l_orderkey, l_linenumber, line_id, a, b, CASE WHEN krap THEN 2.5 WHEN ruim THEN 7.0 ELSE t END AS travel_time_min, CASE WHEN krap OR ruim THEN 'manual_correction' ELSE 'dienstregeling' END AS travel_time_source, CASE WHEN krap THEN 'krap' WHEN ruim THEN 'ruim' END AS travel_time_correction_note FROM f""")
def manual_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rides between four stops, some set by hand."""
    s, p = F.col("l_suppkey"), F.col("l_partkey")
    other = F.when(s % 11 != 0, (s % 4).cast("string"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(s % 3 == 0, "NS").otherwise("Arriva").alias("operator"), (p % 5).alias("line_id"), (p % 4).cast("string").alias("a"), other.alias("b"), F.col("l_quantity").cast("double").alias("travel_time_min"), F.concat(F.lit(" Halte-"), p % 4).alias("stop_name"), F.concat(F.lit("HALTE  "), other).alias("next_stop_name"), F.lit("dienstregeling").alias("travel_time_source"))
    return transit.manual_times(rows, _BY_HAND).drop("operator", "stop_name", "next_stop_name").withColumn("line_id", F.col("line_id").cast("string"))


@query("""WITH t AS (SELECT s_suppkey AS pand_id, CASE WHEN s_suppkey % 4 <> 0 THEN s_name END AS plaats FROM supplier)
SELECT c_custkey AS id, coalesce(t.plaats, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, c_name) AS apotheek_plaats, concat_ws(' ', CASE WHEN c_custkey % 2 = 0 THEN 'Lange Straat' END, CAST(c_custkey % 90 AS VARCHAR), CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END) AS apotheek_adres FROM customer LEFT JOIN t ON t.pand_id = c_custkey""")
def places_of_facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are facilities, in a building of a supplier's number if there is one."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), F.concat(k.cast("string"), F.lit(".0")).alias("pand_id"), F.when(k % 3 == 0, F.concat(F.lit(" "), "c_mktsegment")).otherwise(" ").alias("addr:city"), F.col("c_name").alias("name"), F.when(k % 2 == 0, "Lange  Straat ").alias("addr:street"), (k % 90).cast("string").alias("addr:housenumber"))
    s = F.col("s_suppkey")
    towns = table(spark, sf_dir, "supplier").select(s.cast("string").alias("pand_id"), F.when(s % 4 != 0, F.col("s_name")).otherwise("").alias("woonplaats_naam"))
    return facilities.with_place(rows, "apotheek", towns).select("id", "apotheek_plaats", "apotheek_adres")
