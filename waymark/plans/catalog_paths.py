"""Driver queries of departure profiles, journeys, searches by regions, car access, example routes, network isochrones and dissolved areas; each beside its SQL.

Events are rides: each leaves its user's stop at its time of day and takes between five minutes and half an hour. Ways, buildings and
facilities are those of ``catalog_core``'s street grid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import geometry
from waymark.operators import access, isochrones, network, profiles, regions, routes, streets, validity
from waymark.plans import catalog, catalog_core
from waymark.plans.catalog import query, table

STOPS, LEAST_MIN, WALK_MIN = 40, 3, 2
GOALS = ((0, 3, 4.0, 103), (0, 17, 6.0, 117), (1, 30, 1.0, 130))
#: Rides in SQL are searched in so many rounds; more change nothing on these tables.
SQL_ROUNDS = 12


def _rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    dep = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    rows = e.select(dep.cast("bigint").alias("dep"), (F.col("user_id") % STOPS).alias("src"), ((F.col("user_id") * 3 + F.col("event_id")) % STOPS).alias("dst"), (300 + F.col("event_id") % 7 * 240).alias("_t"))
    return rows.where("src <> dst").select("dep", (F.col("dep") + F.col("_t")).alias("arr"), "src", "dst")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    stops = spark.range(STOPS).select(F.col("id").alias("node"), F.floor(F.col("id") / 10).alias("region"))
    walks = stops.where("node % 4 = 0").select(F.explode(F.array(F.struct(F.col("node").alias("src"), (F.col("node") + 1).alias("dst")), F.struct((F.col("node") + 1).alias("src"), F.col("node").alias("dst")))).alias("w")).select("w.*", F.lit(float(WALK_MIN)).alias("minutes"))
    egress = spark.createDataFrame(GOALS, "key bigint, node bigint, minutes double, target bigint")
    return profiles.departure_profiles(_rides(spark, sf_dir), walks, egress, LEAST_MIN, stops)


def _profiles_sql() -> str:
    """Arrivals at a target in whole seconds, by ride, in rounds of an as-of join; ``m`` is the least one that a stop's later rides have."""
    goals = ", ".join(f"({k}, {n}, {int(60 * m)})" for k, n, m, _ in GOALS)
    sql = f"""
r AS MATERIALIZED (SELECT DISTINCT CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT) AS dep, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) + 300 + event_id % 7 * 240 AS BIGINT) AS arr, user_id % {STOPS} AS src, (user_id * 3 + event_id) % {STOPS} AS dst FROM events WHERE user_id % {STOPS} <> (user_id * 3 + event_id) % {STOPS}),
goal(key, node, sec) AS (VALUES {goals}), keys AS (SELECT DISTINCT key FROM goal),
hop AS MATERIALIZED (SELECT *, dst AS via, arr AS ready FROM r UNION ALL SELECT *, dst + 1, arr + {60 * (WALK_MIN + LEAST_MIN)} FROM r WHERE dst % 4 = 0 UNION ALL SELECT *, dst - 1, arr + {60 * (WALK_MIN + LEAST_MIN)} FROM r WHERE dst % 4 = 1),
g AS MATERIALIZED (SELECT k.key, r.dep, r.arr, r.src, r.dst, r.arr + goal.sec AS eta FROM keys k, r LEFT JOIN goal ON goal.node = r.dst AND goal.key = k.key),
a0 AS MATERIALIZED (SELECT * FROM g WHERE eta IS NOT NULL)"""
    for n in range(SQL_ROUNDS):
        sql += f""",
m{n} AS MATERIALIZED (SELECT key, src, dep, min(min(eta)) OVER (PARTITION BY key, src ORDER BY dep DESC) AS eta FROM a{n} GROUP BY key, src, dep),
a{n + 1} AS MATERIALIZED (SELECT key, dep, arr, src, dst, min(eta) AS eta FROM (SELECT * FROM a0 UNION ALL SELECT h.key, h.dep, h.arr, h.src, h.dst, m.eta FROM (SELECT * FROM keys, hop) h ASOF JOIN m{n} m ON m.key = h.key AND m.src = h.via AND m.dep >= h.ready) GROUP BY ALL)"""
    return sql + f""",
profile AS MATERIALIZED (SELECT key, src, dep, min(min(eta)) OVER (PARTITION BY key, src ORDER BY dep DESC) AS eta FROM a{SQL_ROUNDS} GROUP BY key, src, dep)"""


@query(f"WITH {_profiles_sql()} SELECT key, src AS node, dep AS sec, eta - dep AS seconds FROM profile")
def departure_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("key", "node", "sec", F.round(F.col("minutes") * 60).cast("bigint").alias("seconds"))


@query(f"""WITH {_profiles_sql()}, s AS (SELECT s_suppkey AS id, s_suppkey % 2 AS key, s_suppkey % {STOPS} AS node, s_suppkey * 617 % 80000 AS sec FROM supplier)
SELECT s.id, p.eta - s.sec AS seconds, true AS by_ride, true AS joined FROM s ASOF JOIN profile p ON p.key = s.key AND p.src = s.node AND p.dep >= s.sec""")
def transit_journeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Example routes by transit: what their legs take, whether there is a ride, and whether every leg starts where and when the one before it ends."""
    k = F.col("s_suppkey")
    starts = table(spark, sf_dir, "supplier").select(k.alias("id"), (k % 2).alias("key"), (k % STOPS).alias("node"), (k * 617 % 80000).alias("sec"))
    legs = profiles.journeys(starts, _events(spark, sf_dir))
    one = F.array_sort(F.collect_list(F.struct("leg", "from_node", "to_node", "start_sec", F.round(F.col("minutes") * 60).cast("bigint").alias("took"))))
    rows = legs.groupBy("id").agg(one.alias("l"), F.sum("minutes").alias("m"), F.bool_or(F.col("kind") == "rit").alias("by_ride"))
    pairs = F.zip_with(F.slice("l", F.lit(1), F.size("l") - 1), F.slice("l", F.lit(2), F.size("l") - 1), lambda a, b: (a["to_node"] == b["from_node"]) & (a["start_sec"] + a["took"] == b["start_sec"]))
    return rows.select("id", F.round(F.col("m") * 60).cast("bigint").alias("seconds"), "by_ride", F.forall(pairs, lambda p: p).alias("joined"))


@query(f"""WITH RECURSIVE {catalog_core._GRID}, {catalog_core._SEEDS}, {catalog_core._COSTS},
w AS (SELECT w.edge_id, w.minutes AS m, CASE WHEN backward THEN a.cost END AS cu, CASE WHEN forward THEN b.cost END AS cv FROM ways w LEFT JOIN d a ON a.node = w.u LEFT JOIN d b ON b.node = w.v),
q AS (SELECT *, CASE WHEN cv IS NULL THEN 1.0 WHEN cu IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, (cv + m - cu) / (2 * m))) END AS meet FROM w WHERE cu IS NOT NULL OR cv IS NOT NULL),
lim(band, low, high) AS (VALUES (1, -1.0, 3.0), (2, 3.0, 6.0), (3, 6.0, 9.0)),
p AS (SELECT edge_id, band, 'u' AS via, CASE WHEN band = 1 THEN 0.0 ELSE greatest(0.0, least(meet, (low - cu) / m)) END AS near, greatest(0.0, least(meet, (high - cu) / m)) AS far FROM q, lim WHERE cu IS NOT NULL
  UNION ALL SELECT edge_id, band, 'v', CASE WHEN band = 1 THEN 0.0 ELSE greatest(0.0, least(1 - meet, (low - cv) / m)) END, greatest(0.0, least(1 - meet, (high - cv) / m)) FROM q, lim WHERE cv IS NOT NULL)
SELECT edge_id, band, via, CAST(round(100 * CASE WHEN via = 'u' THEN near ELSE 1 - far END * 100000000 + 0.25) AS BIGINT) AS van, CAST(round(100 * CASE WHEN via = 'u' THEN far ELSE 1 - near END * 100000000 + 0.25) AS BIGINT) AS tot FROM p WHERE far - near > 0.000000001""")
def isochrone_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = catalog_core._grid(spark, sf_dir)
    places = catalog_core._buildings(spark, sf_dir, "target").where("target % 40 = 0")
    costs = network.shortest_paths(net.edges, network.seed_costs(access.on_network(places, net, "target", 60.0), F.lit(80.0)), cutoff=9.0)
    fine = lambda c: F.round(c * 100000000 + 0.25).cast("bigint")  # noqa: E731  halves, which are frequent, aren't on the edge of rounding
    got = isochrones.reached_pieces(net.ways, costs, [3.0, 6.0, 9.0])
    return got.select("edge_id", "band", "via", fine(F.col("van_m")).alias("van"), fine(F.col("tot_m")).alias("tot"))


_CELLS = catalog.SQL["isochrone_cells"]


@query(f"""WITH RECURSIVE c AS MATERIALIZED ({_CELLS}),
side AS MATERIALIZED (SELECT a.band, a.cx, a.cy, b.cx AS nx, b.cy AS ny FROM c a JOIN c b ON b.band = a.band AND abs(a.cx - b.cx) + abs(a.cy - b.cy) = 1),
part(cx, cy, eta) USING KEY (cx, cy) AS (SELECT cx, cy, cx * 1000000 + cy FROM c
  UNION SELECT x.cx, x.cy, x.eta FROM (SELECT s.cx, s.cy, min(part.eta) AS eta FROM part JOIN side s ON s.nx = part.cx AND s.ny = part.cy GROUP BY ALL) x JOIN recurring.part r ON r.cx = x.cx AND r.cy = x.cy WHERE x.eta < r.eta),
n AS (SELECT band, count(DISTINCT eta) AS parts, count(*) AS cells FROM c JOIN part USING (cx, cy) GROUP BY band),
e AS (SELECT band, count(*) AS sides FROM side GROUP BY band),
f AS (SELECT a.band, count(*) AS four FROM c a JOIN c b ON b.band = a.band AND b.cx = a.cx + 1 AND b.cy = a.cy JOIN c p ON p.band = a.band AND p.cx = a.cx AND p.cy = a.cy + 1 JOIN c q ON q.band = a.band AND q.cx = a.cx + 1 AND q.cy = a.cy + 1 GROUP BY a.band)
SELECT n.band, CAST(parts AS BIGINT) AS vlakken, CAST(parts - (cells - coalesce(sides, 0) // 2 + coalesce(four, 0)) AS BIGINT) AS gaten, CAST(cells * 1000000 AS BIGINT) AS oppervlak, CAST((4 * cells - coalesce(sides, 0)) * 1000 AS BIGINT) AS omtrek
FROM n LEFT JOIN e USING (band) LEFT JOIN f USING (band)""")
def isochrone_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a band dissolved: polygons, holes, area and length of all rings. In SQL holes follow from Euler's formula."""
    found = isochrones.cell_polygons(catalog.isochrone_cells(spark, sf_dir), size=1000.0)
    around = F.aggregate("polygon", F.lit(0.0), lambda s, ring: s + geometry.length(ring))
    return found.groupBy("band").agg(F.count("*").alias("vlakken"), F.sum("holes").alias("gaten"), F.round(F.sum("area")).cast("bigint").alias("oppervlak"), F.round(F.sum(around)).cast("bigint").alias("omtrek"))


def _car(spark: SparkSession, sf_dir: str) -> tuple[access.RoadNetwork, access.RoadNetwork]:
    walk = catalog_core._grid(spark, sf_dir)
    return walk, access.RoadNetwork.of("auto", walk.ways.withColumn("minutes", F.col("minutes") / 4), 833.33)


#: Facilities stand at every 40th building and parking places at every 25th; cars take a quarter of the time.
_CAR = f"""{catalog_core._GRID}, {catalog_core._SEEDS}, {catalog_core._COSTS}, shop AS (SELECT id AS target, x, y FROM c WHERE id % 40 = 0),
byway AS (SELECT id, total_min AS way FROM ({catalog_core._origin('(SELECT * FROM placed WHERE id % 25 = 0)')})),
line AS (SELECT c.id, min(sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y))) / 80.0 AS line FROM c JOIN shop s ON c.id % 25 = 0 AND (c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y) <= 640000 GROUP BY c.id),
lot AS (SELECT c.id AS target, round_even(CASE WHEN line IS NOT NULL AND (way IS NULL OR way > 10 OR line < way) THEN line ELSE way END, 2) AS walk_min, line IS NOT NULL AND (way IS NULL OR way > 10 OR line < way) AS straight FROM c LEFT JOIN byway ON byway.id = c.id LEFT JOIN line ON line.id = c.id WHERE c.id % 25 = 0),
lots AS (SELECT * FROM lot WHERE walk_min <= 10),
seeds2 AS (SELECT node, min({{'c': cost, 't': target}}) AS k FROM (SELECT u AS node, target, share * minutes / 4 + (snap_m / 833.33 + walk_min) AS cost FROM placed JOIN lots ON target = id WHERE forward UNION ALL SELECT v, target, (1 - share) * minutes / 4 + (snap_m / 833.33 + walk_min) FROM placed JOIN lots ON target = id WHERE backward) GROUP BY node),
d2(node, cost, target) USING KEY (node) AS (SELECT node, k.c, k.t FROM seeds2
  UNION SELECT src, k.c, k.t FROM (SELECT e.src, min({{'c': d2.cost + e.w / 4, 't': d2.target}}) AS k FROM d2 JOIN e ON e.dst = d2.node GROUP BY e.src) x
  LEFT JOIN recurring.d2 r ON r.node = x.src WHERE r.node IS NULL OR k.c < r.cost OR (k.c = r.cost AND k.t < r.target)),
tried AS (SELECT p.id, p.edge_id, p.snap_m, least(CASE WHEN backward THEN share * minutes / 4 + a.cost END, CASE WHEN forward THEN (1 - share) * minutes / 4 + b.cost END) + snap_m / 833.33 AS t FROM (SELECT * FROM found WHERE snap_m <= 60) p LEFT JOIN d2 a ON a.node = p.u LEFT JOIN d2 b ON b.node = p.v),
own AS (SELECT p.id, t FROM tried JOIN placed p ON p.id = tried.id AND p.edge_id = tried.edge_id), best AS (SELECT id, min(t) AS t FROM tried GROUP BY id),
car AS (SELECT c.id, CASE WHEN own.id IS NULL THEN NULL WHEN (own.t IS NULL OR own.t > 5) AND (own.t IS NULL OR best.t < own.t) THEN best.t ELSE own.t END AS t FROM c LEFT JOIN own ON own.id = c.id LEFT JOIN best ON best.id = c.id)"""


@query(f"WITH RECURSIVE {_CAR} SELECT target AS parking, CAST(round(walk_min * 100) AS BIGINT) AS honderdsten, CASE WHEN straight THEN 'luchtlijn_fallback' ELSE 'netwerk' END AS walk_source FROM lots")
def parking_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    walk, _ = _car(spark, sf_dir)
    got = access.parking_targets(*_lots_and_shops(spark, sf_dir), walk, 10.0, 60.0)
    return got.select(F.col("target").alias("parking"), F.round(F.col("walk_min") * 100).cast("bigint").alias("honderdsten"), "walk_source")


def _lots_and_shops(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return catalog_core._buildings(spark, sf_dir, "parking").where("parking % 25 = 0"), catalog_core._buildings(spark, sf_dir, "target").where("target % 40 = 0")


@query(f"WITH RECURSIVE {_CAR} SELECT id AS pand_id, CAST(round(round_even(t, 2) * 100) AS BIGINT) AS honderdsten, t IS NOT NULL AS reachable, coalesce(t <= 5, false) AS within FROM car")
def car_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    walk, car = _car(spark, sf_dir)
    lots, shops = _lots_and_shops(spark, sf_dir)
    got = access.by_car(catalog_core._buildings(spark, sf_dir), shops, lots, car, walk, 5.0, 10.0, 60.0)
    return got.select("pand_id", F.round(F.col("total_min") * 100).cast("bigint").alias("honderdsten"), "reachable", "within")


@query(f"WITH RECURSIVE {_CAR} SELECT id AS pand_id, CAST(round(t * 1000000) AS BIGINT) AS miljoensten, true AS loopt FROM car WHERE t IS NOT NULL")
def car_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes by car and on foot: the drive's legs and the walk add up to the search's result, and the walk's own legs to its rounded minutes."""
    walk, car = _car(spark, sf_dir)
    lots, shops = _lots_and_shops(spark, sf_dir)
    homes = catalog_core._buildings(spark, sf_dir)
    sums = routes.car_routes(homes, shops, lots, car, walk, 5.0, 10.0, 60.0).groupBy("id").agg(F.sum(F.when(F.col("modus") == "auto", F.col("minutes"))).alias("drive"), F.sum(F.when(F.col("modus") != "auto", F.col("minutes"))).alias("foot"))
    found = access.by_car(homes, shops, lots, car, walk, 5.0, 10.0, 60.0).select("pand_id", "walk_min")
    both = sums.join(found, F.col("id") == F.col("pand_id"))
    return both.select("pand_id", F.round((F.col("drive") + F.col("walk_min")) * 1000000).cast("bigint").alias("miljoensten"), (F.abs(F.col("foot") - F.col("walk_min")) < 0.00501).alias("loopt"))


@query(f"WITH RECURSIVE {catalog_core._GRID}, {catalog_core._SEEDS}, {catalog_core._COSTS}, o AS ({catalog_core._origin('placed')}) SELECT id AS pand_id, CAST(round(total_min * 1000000 + 0.1) AS BIGINT) AS miljoensten, CAST(1 AS BIGINT) AS aanlopen, CAST(1 AS BIGINT) AS uitlopen FROM o WHERE total_min IS NOT NULL")
def walking_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Example routes on foot: the minutes of all legs, and how many lead to and from the network."""
    got = routes.direct_routes(catalog_core._buildings(spark, sf_dir), _lots_and_shops(spark, sf_dir)[1], catalog_core._grid(spark, sf_dir), 60.0)
    return got.groupBy(F.col("id").alias("pand_id")).agg(F.round(F.sum("minutes") * 1000000 + 0.1).cast("bigint").alias("miljoensten"), F.count_if(F.col("kind") == "aanloop").alias("aanlopen"), F.count_if(F.col("kind") == "uitloop").alias("uitlopen"))


@query(catalog.SQL["sssp_multi_source"])
def regional_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The multi-source search, with the suppliers of a nation as a region."""
    nations = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").cast("bigint").alias("region"))
    return regions.regional_paths(catalog._graph(spark, sf_dir), catalog._seeds(spark, sf_dir), nations).select("node", "cost", "target")


@query(catalog.SQL["direct_access"])
def regional_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walking times on the street grid, cut into squares of 400 m."""
    net = access.RoadNetwork.of("lopen", catalog_core._grid(spark, sf_dir).ways, 80.0, 400.0)
    places = catalog_core._buildings(spark, sf_dir, "target").where("target % 40 = 0")
    got = access.direct(catalog_core._buildings(spark, sf_dir), places, net, "lopen", 4.0, radius=60.0)
    return got.select("pand_id", F.round(F.col("total_min") * 100).cast("bigint").alias("honderdsten"), "reachable", "within", "modus")


def _street_elements(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers are crossings: ways of ten of them in a row, every fifth one way, with byways between rows; parts lie on rings of four, every other one way."""
    k, p, far = F.col("c_custkey"), F.col("p_partkey"), 1_000_000_000
    customer, part = table(spark, sf_dir, "customer").select(k), table(spark, sf_dir, "part").select(p)
    at = lambda c, base: (c.alias("node"), (base + c % 100 * 0.001).alias("x"), (53 + F.floor(c / 100) * 0.001).alias("y"))
    nodes = customer.select(*at(k, 5.0)).unionByName(part.select((p + far).alias("node"), *at(p, 6.0)[1:]))
    tags = lambda name, one: F.create_map(F.lit("highway"), F.lit(name), F.lit("oneway"), F.when(one, "yes").otherwise("no")).alias("tags")
    row = F.floor(k / 10)
    rows = customer.select(row.alias("way_id")).distinct().select("way_id", F.sequence(F.col("way_id") * 10, F.col("way_id") * 10 + 10).alias("nodes"), tags("residential", F.col("way_id") % 5 == 0))
    byways = customer.where(k % 35 == 0).select((far + k).alias("way_id"), F.array(k, k + 77).alias("nodes"), tags("path", F.lit(False)))
    q = F.col("_q")
    rings = part.select(F.floor(p / 4).alias("_q")).groupBy("_q").agg(F.count("*").alias("_n")).where("_n = 4").select((2 * far + q).alias("way_id"), F.transform(F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(3), F.lit(0)), lambda i: far + q * 4 + i).alias("nodes"), tags("cycleway", q % 2 == 0))
    return nodes, rows.unionByName(byways).unionByName(rings)


@query("""WITH RECURSIVE raw AS (SELECT a.c_custkey AS a, b.c_custkey AS b, a.c_custkey // 10 AS way, a.c_custkey // 10 % 5 = 0 AS one FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1
  UNION ALL SELECT a.c_custkey, b.c_custkey, 1000000000 + a.c_custkey, false FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 77 WHERE a.c_custkey % 35 = 0
  UNION ALL SELECT 1000000000 + p_partkey, 1000000000 + CASE WHEN p_partkey % 4 = 3 THEN p_partkey - 3 ELSE p_partkey + 1 END, 2000000000 + p_partkey // 4, p_partkey // 4 % 2 = 0 FROM (SELECT p_partkey FROM part QUALIFY count(*) OVER (PARTITION BY p_partkey // 4) = 4)),
place AS (SELECT c_custkey AS n, 5.0 + c_custkey % 100 * 0.001 AS x, 53 + c_custkey // 100 * 0.001 AS y FROM customer UNION ALL SELECT 1000000000 + p_partkey, 6.0 + p_partkey % 100 * 0.001, 53 + p_partkey // 100 * 0.001 FROM part),
s AS MATERIALIZED (SELECT d.*, 2 * 6371000.0 * asin(sqrt(pow(sin(radians(CAST(q.y - p.y AS DOUBLE)) / 2), 2) + cos(radians(CAST(p.y AS DOUBLE))) * cos(radians(CAST(q.y AS DOUBLE))) * pow(sin(radians(CAST(q.x - p.x AS DOUBLE)) / 2), 2))) AS m
  FROM (SELECT a AS src, b AS dst, way FROM raw UNION SELECT b, a, way FROM raw WHERE NOT one) d JOIN place p ON p.n = d.src JOIN place q ON q.n = d.dst),
met AS (SELECT n, count(DISTINCT o) AS near, sum(out) AS outs, count(*) AS every FROM (SELECT src AS n, dst AS o, 1 AS out FROM s UNION ALL SELECT dst, src, 0 FROM s) GROUP BY n),
between_ AS MATERIALIZED (SELECT n FROM met WHERE near = 2 AND (every = 4 OR every = 2 AND outs = 1) AND NOT (n >= 1000000000 AND n % 4 = 0)),
walk(u, second, src, dst, m, n) AS (SELECT src, dst, src, dst, m, 1 FROM s WHERE src NOT IN (SELECT n FROM between_)
  UNION ALL SELECT w.u, w.second, s.src, s.dst, w.m + s.m, w.n + 1 FROM walk w JOIN between_ b ON b.n = w.dst JOIN s ON s.src = w.dst AND s.dst <> w.src),
done AS (SELECT u, second, src AS last, dst AS v, m, n FROM walk WHERE dst NOT IN (SELECT n FROM between_)),
k AS (SELECT *, (u, second, last, v) <= (v, last, second, u) AS own FROM done)
SELECT CASE WHEN own THEN u ELSE v END AS u, CASE WHEN own THEN second ELSE last END AS tweede, CASE WHEN own THEN v ELSE u END AS v, CAST(max(n) AS BIGINT) AS delen, CAST(round(max(m) * 100 + 0.23) AS BIGINT) AS centimeters, bool_or(own) AS forward, bool_or(NOT own) AS backward FROM k GROUP BY ALL""")
def street_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways open to cyclists, contracted to edges between junctions; rings without a junction start at their least node."""
    nodes, ways = _street_elements(spark, sf_dir)
    got = streets.contracted(streets.street_segments(streets.of_kind(ways, "bike"), nodes))
    return got.select("u", F.col("nodes")[1].alias("tweede"), "v", (F.size("nodes") - 1).cast("bigint").alias("delen"), F.round(F.col("length_m") * 100 + 0.23).cast("bigint").alias("centimeters"), "forward", "backward")


@query("""WITH line AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey % 50, (l_suppkey * 7 + l_linenumber * 13) % 50) AS k, CAST(l_partkey % 50 AS BIGINT) AS x, CAST((l_suppkey * 7 + l_linenumber * 13) % 50 AS BIGINT) AS y FROM lineitem),
raw AS (SELECT o, 0 AS ring, k, x, y FROM line UNION ALL SELECT o, 0, 1000000, x, y FROM line WHERE k = 1 AND o % 11 <> 0
  UNION ALL SELECT o, 1, i.k, o % 50 + i.dx * (1 + o % 3), o * 3 % 50 + i.dy * (1 + o % 3) FROM (SELECT DISTINCT o FROM line WHERE o % 3 = 0), (VALUES (1, 0, 0), (2, 1, 0), (3, 0, 1), (4, 0, 0)) i(k, dx, dy)),
p AS MATERIALIZED (SELECT o, ring, x, y, row_number() OVER w AS k, count(*) OVER (PARTITION BY o, ring) AS n FROM (SELECT * FROM raw WINDOW w AS (PARTITION BY o, ring ORDER BY k) QUALIFY NOT coalesce(lag(x) OVER w = x AND lag(y) OVER w = y, false)) WINDOW w AS (PARTITION BY o, ring ORDER BY k)),
s AS MATERIALIZED (SELECT * FROM (SELECT o, ring, k, n, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS by_ FROM p WINDOW w AS (PARTITION BY o, ring ORDER BY k)) WHERE bx IS NOT NULL),
j AS (SELECT s.o, s.ring AS r1, t.ring AS r2, s.k AS k1, t.k AS k2, s.n, s.ax, s.ay, s.bx, s.by_, t.ax AS cx, t.ay AS cy, t.bx AS dx, t.by_ AS dy,
  sign((s.bx - s.ax) * (t.ay - s.ay) - (s.by_ - s.ay) * (t.ax - s.ax)) AS abc, sign((s.bx - s.ax) * (t.by_ - s.ay) - (s.by_ - s.ay) * (t.bx - s.ax)) AS abd,
  sign((t.bx - t.ax) * (s.ay - t.ay) - (t.by_ - t.ay) * (s.ax - t.ax)) AS cda, sign((t.bx - t.ax) * (s.by_ - t.ay) - (t.by_ - t.ay) * (s.bx - t.ax)) AS cdb
  FROM s JOIN s t ON t.o = s.o AND (s.ring < t.ring OR s.ring = t.ring AND s.k < t.k)),
b AS (SELECT *, least(greatest(ax, bx), greatest(cx, dx)) - greatest(least(ax, bx), least(cx, dx)) AS wx, least(greatest(ay, by_), greatest(cy, dy)) - greatest(least(ay, by_), least(cy, dy)) AS wy,
  k1 = 1 AND k2 = n - 1 AND ax = dx AND ay = dy AS closing, k2 = k1 + 1 AS next,
  abd = 0 AND (ax - bx) * (dx - bx) + (ay - by_) * (dy - by_) > 0 AS back, abc = 0 AND (bx - ax) * (cx - ax) + (by_ - ay) * (cy - ay) > 0 AS turned FROM j),
f AS (SELECT o, r2 AS ring, CASE WHEN r1 < r2 THEN CASE WHEN abc * abd < 0 AND cda * cdb < 0 OR abc = 0 AND abd = 0 AND wx >= 0 AND wy >= 0 AND greatest(wx, wy) > 0 THEN 'ringen_kruisen' END
  WHEN CASE WHEN next THEN back OR closing AND turned WHEN closing THEN turned ELSE wx >= 0 AND wy >= 0 AND abc * abd <= 0 AND cda * cdb <= 0 END THEN 'zelfdoorsnijding' END AS fault FROM b),
h AS (SELECT p.o, p.x, p.y, count(*) FILTER ((s.ay > p.y) <> (s.by_ > p.y) AND p.x < (s.bx - s.ax) * CAST(p.y - s.ay AS DOUBLE) / (s.by_ - s.ay) + s.ax) AS crossed,
  count(*) FILTER ((s.bx - s.ax) * (p.y - s.ay) = (s.by_ - s.ay) * (p.x - s.ax) AND p.x BETWEEN least(s.ax, s.bx) AND greatest(s.ax, s.bx) AND p.y BETWEEN least(s.ay, s.by_) AND greatest(s.ay, s.by_)) AS touched
  FROM (SELECT DISTINCT o, x, y FROM p WHERE ring = 1) p JOIN s ON s.o = p.o AND s.ring = 0 GROUP BY ALL)
SELECT o AS id, CAST(ring AS BIGINT) AS ring, fault FROM (SELECT DISTINCT * FROM f WHERE fault IS NOT NULL UNION ALL SELECT DISTINCT o, 1, 'gat_buiten' FROM h WHERE crossed % 2 = 0 AND touched = 0 UNION ALL SELECT DISTINCT o, ring, 'te_kort' FROM p WHERE n < 4
  UNION ALL SELECT o, ring, 'open' FROM p WHERE n > 1 GROUP BY o, ring HAVING arg_min(x, k) <> arg_max(x, k) OR arg_min(y, k) <> arg_max(y, k))""")
def polygon_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines are the points of a ring, left open in every 11th order; every third order has a triangle as its hole."""
    o = F.col("l_orderkey")
    at = geometry.point(F.col("l_partkey") % 50, (F.col("l_suppkey") * 7 + F.col("l_linenumber") * 13) % 50)
    rings = table(spark, sf_dir, "lineitem").groupBy(o).agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), at.alias("p")))).alias("_l"))
    shell = F.transform("_l", lambda v: v["p"])
    shell = F.when(o % 11 == 0, shell).otherwise(F.concat(shell, F.slice(shell, 1, 1)))
    corner = lambda dx, dy: geometry.point(o % 50 + dx * (1 + o % 3), o * 3 % 50 + dy * (1 + o % 3))
    hole = F.array(corner(0, 0), corner(1, 0), corner(0, 1), corner(0, 0))
    polygons = rings.select(o.alias("id"), F.when(o % 3 == 0, F.array(shell, hole)).otherwise(F.array(shell)).alias("polygon"))
    return validity.ring_faults(polygons, "id").select("id", F.col("ring").cast("bigint").alias("ring"), "fault")
