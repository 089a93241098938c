"""Driver queries: the library's operators over the driver's tables, each beside the same result in SQL.

An order line stands for a building: its minutes are the days from order to shipping, its norm follows the order's
priority, its neighbourhood is the customer's nation and its municipality the region; the line number modulo 5
is its mode. Events of a user are the stops of a trip, suppliers of consecutive order lines are network nodes, and the
first two components of an embedding are a place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions import classes, geometry, text, times
from waymark.operators import facilities, isochrones, maplayers, network, register, relational, reports, roads, rollup, spatial, transit

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

MODES = classes.MODES
_MODE_SQL = "CASE l_linenumber % 5 WHEN 0 THEN 'lopen' WHEN 1 THEN 'fiets' WHEN 2 THEN 'auto' WHEN 3 THEN 'ov_lopen' ELSE 'ov_fiets' END"


def query(sql: str | None = None):
    """Registers a query under its name, and its SQL if it has any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mode(c: Column) -> Column:
    out = F.lit(MODES[4])
    for k in range(4):
        out = F.when(c % 5 == k, MODES[k]).otherwise(out)
    return out


def access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access results in long form: pand_id, modus, minutes, norm, within, buurt, gemeente."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    minutes = F.abs(F.datediff("l_shipdate", "o_orderdate"))
    norm = F.when(F.col("o_orderpriority").startswith("1"), 400).when(F.col("o_orderpriority").startswith("2"), 600).otherwise(900)
    return rows.select(F.col("l_orderkey").alias("pand_id"), _mode(F.col("l_linenumber")).alias("modus"), F.col("l_linenumber").alias("regel"), F.when(minutes % 11 != 0, minutes).alias("minutes"), norm.alias("norm"), F.col("n_name").alias("buurt"), F.col("r_name").alias("gemeente")).withColumn("within", F.coalesce(F.col("minutes") <= F.col("norm"), F.lit(False)))


_ACCESS = f"""
access AS (
  SELECT *, coalesce(minutes <= norm, false) AS within FROM (
    SELECT l_orderkey AS pand_id, {_MODE_SQL} AS modus, l_linenumber AS regel,
           CASE WHEN m % 11 <> 0 THEN m END AS minutes,
           CASE WHEN o_orderpriority LIKE '1%' THEN 400 WHEN o_orderpriority LIKE '2%' THEN 600 ELSE 900 END AS norm,
           n_name AS buurt, r_name AS gemeente
    FROM (SELECT *, abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS m
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
          JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)))
"""
_PCT = "CASE WHEN {b} > 0 THEN {a} * 100.0 / {b} ELSE 0.0 END"
_BAND = "CASE WHEN {p} >= 0 AND {p} < 20 THEN '0-20%' WHEN {p} >= 20 AND {p} < 40 THEN '20-40%' WHEN {p} >= 40 AND {p} < 60 THEN '40-60%' WHEN {p} >= 60 AND {p} < 80 THEN '60-80%' WHEN {p} >= 80 AND {p} <= 100 THEN '80-100%' ELSE 'geen data' END"
_COLOUR = "CASE WHEN {p} >= 0 AND {p} < 20 THEN '#d73027' WHEN {p} >= 20 AND {p} < 40 THEN '#fc8d59' WHEN {p} >= 40 AND {p} < 60 THEN '#fee08b' WHEN {p} >= 60 AND {p} < 80 THEN '#d9ef8b' WHEN {p} >= 80 AND {p} <= 100 THEN '#1a9850' ELSE '#bdbdbd' END"
_AGG = """count(pand_id) AS panden_aantal, count(minutes) AS panden_met_reistijd, count(*) FILTER (WHERE within) AS panden_binnen_norm,
       CAST(median(minutes) AS DOUBLE) AS reistijd_mediaan_min, CAST(quantile_cont(minutes, 0.9) AS DOUBLE) AS reistijd_p90_min"""


def _areas(by: str) -> str:
    return f"""areas AS (SELECT {by}, {_AGG} FROM access GROUP BY {by})"""


@query(f"""WITH {_ACCESS}, {_areas("gemeente, buurt, modus")}
SELECT *, CAST({_PCT.format(a="panden_met_reistijd", b="panden_aantal")} AS DOUBLE) AS percentage_met_reistijd,
       CAST({_PCT.format(a="panden_binnen_norm", b="panden_aantal")} AS DOUBLE) AS percentage_binnen_norm,
       {_BAND.format(p="(panden_binnen_norm * 100.0 / panden_aantal)")} AS klasse, {_COLOUR.format(p="(panden_binnen_norm * 100.0 / panden_aantal)")} AS kleur FROM areas""")
def area_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.area_summary(access(spark, sf_dir), ["gemeente", "buurt", "modus"])


@query(f"""WITH {_ACCESS}, areas AS (
  SELECT gemeente, buurt, CASE WHEN grouping(buurt) = 1 THEN 'groot' ELSE 'klein' END AS niveau, {_AGG}
  FROM access GROUP BY GROUPING SETS ((gemeente, buurt), (gemeente)))
SELECT *, CAST({_PCT.format(a="panden_met_reistijd", b="panden_aantal")} AS DOUBLE) AS percentage_met_reistijd,
       CAST({_PCT.format(a="panden_binnen_norm", b="panden_aantal")} AS DOUBLE) AS percentage_binnen_norm,
       {_BAND.format(p="(panden_binnen_norm * 100.0 / panden_aantal)")} AS klasse, {_COLOUR.format(p="(panden_binnen_norm * 100.0 / panden_aantal)")} AS kleur FROM areas""")
def area_rollup_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.area_rollup(access(spark, sf_dir), "buurt", "gemeente")


_RANKED = f"""WITH {_ACCESS}, areas AS (SELECT modus, buurt, count(pand_id) AS panden_aantal, count(*) FILTER (WHERE within) AS panden_binnen_norm FROM access GROUP BY modus, buurt),
o AS (SELECT *, panden_aantal - panden_binnen_norm AS buiten, CAST((panden_aantal - panden_binnen_norm) * 100.0 / panden_aantal AS DOUBLE) AS percentage_buiten FROM areas WHERE panden_aantal > 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY modus ORDER BY percentage_buiten DESC, buiten DESC, buurt) AS INTEGER) AS rang_relatief,
  CAST(row_number() OVER (PARTITION BY modus ORDER BY buiten DESC, percentage_buiten DESC, buurt) AS INTEGER) AS rang_absoluut FROM o)"""


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = access(spark, sf_dir).groupBy("modus", "buurt").agg(F.count("pand_id").alias("panden_aantal"), F.count_if("within").alias("panden_binnen_norm"))
    return rollup.ranks(rows, ["modus"], "buurt")


@query(f"{_RANKED} SELECT * FROM ranked")
def area_rank_dual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir)


@query(f"""{_RANKED}, n AS (SELECT *, count(*) OVER (PARTITION BY modus) AS n FROM ranked)
SELECT * EXCLUDE (n), 'slechtste' AS soort, rang_relatief AS positie FROM n WHERE rang_relatief <= 10
UNION ALL SELECT * EXCLUDE (n), 'beste' AS soort, CAST(n - rang_relatief + 1 AS INTEGER) AS positie FROM n WHERE rang_relatief > n - 10""")
def top10_best_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.best_and_worst(_ranked(spark, sf_dir), ["modus"], 10)


_BEST = f"""WITH {_ACCESS}, p AS (SELECT *, CASE modus WHEN 'lopen' THEN 1 WHEN 'fiets' THEN 2 WHEN 'auto' THEN 3 WHEN 'ov_lopen' THEN 4 ELSE 5 END AS k FROM access),
b AS (SELECT pand_id, any_value(buurt) AS buurt, count(minutes) AS aantal_bereikbaar, count(*) FILTER (WHERE within) AS aantal_binnen_norm FROM p GROUP BY pand_id),
r AS (SELECT pand_id, modus, minutes, row_number() OVER (PARTITION BY pand_id ORDER BY within DESC, minutes, k) AS rn FROM p WHERE minutes IS NOT NULL),
chosen AS (SELECT b.pand_id, b.buurt, r.modus, r.minutes, b.aantal_binnen_norm > 0 AS within, aantal_bereikbaar, aantal_binnen_norm,
  CASE WHEN aantal_binnen_norm > 0 THEN 'binnen_norm' WHEN aantal_bereikbaar > 0 THEN 'bereikbaar' ELSE 'geen_route' END AS keuze
  FROM b LEFT JOIN r ON r.pand_id = b.pand_id AND rn = 1)"""


@query(f"{_BEST} SELECT * EXCLUDE (buurt) FROM chosen")
def best_mode_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.best_of_modes(access(spark, sf_dir), ["pand_id"], MODES).withColumn("minutes", F.col("minutes").cast("bigint"))


@query(f"""{_BEST}, c AS (SELECT buurt, modus, count(*) AS panden FROM chosen WHERE modus IS NOT NULL GROUP BY buurt, modus)
SELECT buurt, modus AS dominante_modus, panden FROM c QUALIFY row_number() OVER (PARTITION BY buurt ORDER BY panden DESC, modus) = 1""")
def dominant_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.dominant_mode(rollup.best_of_modes(access(spark, sf_dir), ["pand_id", "buurt"], MODES), ["buurt"])


@query(f"""WITH {_ACCESS}, a AS (SELECT buurt, regel % 7 AS groep, modus, CAST(count(*) FILTER (WHERE minutes <= 60 + 30 * (regel % 7)) * 100.0 / count(*) AS DOUBLE) AS p FROM access GROUP BY ALL),
w AS (SELECT buurt, groep, max(p) FILTER (WHERE modus = 'lopen') AS lopen, max(p) FILTER (WHERE modus = 'fiets') AS fiets, max(p) FILTER (WHERE modus = 'auto') AS auto,
  max(p) FILTER (WHERE modus = 'ov_lopen') AS ov_lopen, max(p) FILTER (WHERE modus = 'ov_fiets') AS ov_fiets FROM a GROUP BY buurt, groep),
x AS (SELECT *, greatest(lopen, fiets, auto, ov_lopen, ov_fiets) AS beste_percentage, least(lopen, fiets, auto, ov_lopen, ov_fiets) AS slechtste_percentage,
  CAST(coalesce(CAST(lopen < 80 AS INT), 0) + coalesce(CAST(fiets < 80 AS INT), 0) + coalesce(CAST(auto < 80 AS INT), 0) + coalesce(CAST(ov_lopen < 80 AS INT), 0) + coalesce(CAST(ov_fiets < 80 AS INT), 0) AS BIGINT) AS aantal_modaliteiten_onvoldoende,
  concat_ws(', ', CASE WHEN lopen < 80 THEN 'lopen' END, CASE WHEN fiets < 80 THEN 'fiets' END, CASE WHEN auto < 80 THEN 'auto' END, CASE WHEN ov_lopen < 80 THEN 'ov_lopen' END, CASE WHEN ov_fiets < 80 THEN 'ov_fiets' END) AS modaliteiten_onvoldoende,
  greatest(lopen, fiets) AS act, greatest(ov_lopen, ov_fiets) AS ov FROM w)
SELECT * EXCLUDE (act, ov), CASE WHEN coalesce(act, ov, auto) IS NULL THEN 'geen data' WHEN aantal_modaliteiten_onvoldoende = 0 THEN 'voldoende'
  WHEN act < 60 AND ov < 60 AND auto < 60 THEN 'multimodaal_tekort' WHEN act < 80 AND auto >= 80 THEN 'nabijheid_actieve_mobiliteit_tekort'
  WHEN ov < 80 AND act >= 80 THEN 'ov_tekort' WHEN auto < 80 AND act >= 80 THEN 'auto_tekort' ELSE 'gemengd_tekort' END AS probleemtype,
  CASE WHEN beste_percentage IS NULL THEN 'geen data' WHEN aantal_modaliteiten_onvoldoende = 0 THEN 'voldoende' WHEN beste_percentage < 60 THEN 'ernstig tekort'
  WHEN slechtste_percentage >= 60 THEN 'licht tekort' WHEN aantal_modaliteiten_onvoldoende <= 2 THEN 'matig tekort' ELSE 'ernstig tekort' END AS ernstklasse FROM x""")
def shortage_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = access(spark, sf_dir).withColumn("groep", F.col("regel") % 7)
    share = rows.groupBy("buurt", "groep", "modus").agg((F.count_if(F.col("minutes") <= 60 + 30 * F.col("groep")) * 100.0 / F.count("*")).alias("percentage_binnen_norm"))
    return rollup.diagnosis(share, ["buurt", "groep"])


_FLAGS = f"""WITH {_ACCESS}, w AS (SELECT pand_id, coalesce(bool_or(within) FILTER (WHERE modus = 'lopen'), false) AS l, coalesce(bool_or(within) FILTER (WHERE modus = 'fiets'), false) AS f,
  coalesce(bool_or(within) FILTER (WHERE modus = 'auto'), false) AS a, coalesce(bool_or(within) FILTER (WHERE modus = 'ov_lopen'), false) AS ol, coalesce(bool_or(within) FILTER (WHERE modus = 'ov_fiets'), false) AS of_ FROM access GROUP BY pand_id),
flags AS (SELECT *, CAST(CAST(l AS INT) + CAST(f AS INT) + CAST(a AS INT) + CAST(ol AS INT) + CAST(of_ AS INT) AS BIGINT) AS n FROM w)"""


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.building_flags(access(spark, sf_dir), ["pand_id"], complete=False)


@query(f"""{_FLAGS} SELECT r.range AS aantal, coalesce(c.panden, 0) AS panden, CAST(coalesce(c.panden, 0) * 100.0 / (SELECT count(*) FROM flags) AS DOUBLE) AS percentage
FROM range(6) r LEFT JOIN (SELECT n, count(*) AS panden FROM flags GROUP BY n) c ON c.n = r.range""")
def mode_histogram_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.mode_histogram(_flags(spark, sf_dir), "aantal_voldoende")


@query(f"""{_FLAGS}, s AS (SELECT count(*) AS totaal, count(*) FILTER (WHERE n = 0) AS geen, count(*) FILTER (WHERE n = 5) AS alle, count(*) FILTER (WHERE a AND n = 1) AS alleen_auto,
  count(*) FILTER (WHERE a AND NOT (l OR f OR ol OR of_)) AS autoafhankelijk, count(*) FILTER (WHERE l OR f) AS lopen_of_fiets, count(*) FILTER (WHERE (ol OR of_) AND NOT (l OR f) AND NOT a) AS alleen_ov FROM flags)
SELECT profiel, panden, CAST(panden * 100.0 / (SELECT totaal FROM s) AS DOUBLE) AS percentage FROM (UNPIVOT s ON totaal, geen, alle, alleen_auto, autoafhankelijk, lopen_of_fiets, alleen_ov INTO NAME profiel VALUE panden)""")
def profile_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.profiles(_flags(spark, sf_dir))


@query(f"""WITH {_ACCESS}, m AS (SELECT modus, count(*) AS panden, count(*) FILTER (WHERE NOT within) AS buiten, CASE modus WHEN 'lopen' THEN 1 WHEN 'fiets' THEN 2 WHEN 'auto' THEN 3 WHEN 'ov_lopen' THEN 4 ELSE 5 END AS k FROM access GROUP BY modus),
p AS (SELECT *, CAST(buiten * 100.0 / panden AS DOUBLE) AS percentage_buiten FROM m), r AS (SELECT *, CAST(row_number() OVER (ORDER BY percentage_buiten DESC, buiten DESC, k) AS INTEGER) AS positie FROM p)
SELECT modus, panden, buiten, percentage_buiten, positie, percentage_buiten - min(percentage_buiten) OVER () AS verschil_met_beste, positie = 1 AS zwakste FROM r""")
def mode_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.mode_ranking(access(spark, sf_dir))


def _stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stop times: a trip per user and day, a stop per event type, seconds of the day."""
    e = table(spark, sf_dir, "events")
    sec = (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("bigint")
    return e.select((F.col("user_id") * 100000 + F.datediff("ts", F.lit("1970-01-01"))).alias("trip_id"), F.col("event_id").alias("stop_sequence"), F.col("event_type").alias("stop_id"), sec.alias("departure_seconds"), sec.alias("arrival_seconds"), "user_id", F.when(F.col("event_id") % 3 == 0, "bus").otherwise("train").alias("mode"))


_STOPS = """st AS (SELECT user_id * 100000 + date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS trip_id, event_id AS stop_sequence, event_type AS stop_id,
  CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT) AS departure_seconds, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT) AS arrival_seconds, user_id,
  CASE WHEN event_id % 3 = 0 THEN 'bus' ELSE 'train' END AS mode FROM events)"""
_EDGES = f"""WITH {_STOPS}, e AS (SELECT trip_id, stop_sequence, mode, departure_seconds AS from_departure_seconds, stop_id AS from_stop_id, lead(stop_id) OVER w AS to_stop_id, lead(arrival_seconds) OVER w AS to_arrival_seconds, lead(1) OVER w AS more
  FROM st WINDOW w AS (PARTITION BY trip_id ORDER BY stop_sequence)),
edges AS (SELECT * EXCLUDE (more), to_arrival_seconds - from_departure_seconds AS seconds FROM e WHERE more = 1)"""


@query(f"{_EDGES} SELECT * FROM edges")
def stop_edges_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transit.stop_edges(_stops(spark, sf_dir), keep=["mode"])


_FIXED = f"""{_EDGES}, fixed AS (SELECT * REPLACE (CASE WHEN mode = 'bus' AND seconds = 0 THEN 30 ELSE seconds END AS seconds), seconds AS original_seconds FROM edges)"""


@query(f"""{_FIXED} SELECT from_stop_id, to_stop_id, mode, count(DISTINCT trip_id) AS trips, min(seconds / 60.0) AS min_min, max(seconds / 60.0) AS max_min, median(seconds / 60.0) AS median_min,
  string_agg(DISTINCT CAST(trip_id % 7 AS VARCHAR), ', ' ORDER BY CAST(trip_id % 7 AS VARCHAR)) AS names FROM fixed GROUP BY from_stop_id, to_stop_id, mode""")
def edge_summary_textset(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = transit.corrected_edges(transit.stop_edges(_stops(spark, sf_dir), keep=["mode"]))
    return transit.segment_summary(edges, ["from_stop_id", "to_stop_id", "mode"], names=F.col("trip_id") % 7).drop("mean_min")


@query(f"""{_FIXED}, f AS (SELECT trip_id, sum(seconds - original_seconds) AS c FROM fixed WHERE seconds <> original_seconds GROUP BY trip_id),
b AS (SELECT trip_id, arg_min(stop_id, stop_sequence) AS first_stop_id, arg_max(stop_id, stop_sequence) AS last_stop_id, count(*) AS stops, arg_min(departure_seconds, stop_sequence) AS start_seconds, arg_max(arrival_seconds, stop_sequence) AS end_seconds FROM st GROUP BY trip_id)
SELECT b.*, CAST(coalesce(c, 0) AS BIGINT) AS correction_seconds, CAST(end_seconds - start_seconds + coalesce(c, 0) AS BIGINT) AS total_seconds FROM b LEFT JOIN f USING (trip_id)""")
def trip_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = _stops(spark, sf_dir)
    return transit.trip_totals(st, transit.corrected_edges(transit.stop_edges(st, keep=["mode"])))


@query(f"WITH {_STOPS} SELECT trip_id, count(*) AS stops FROM st GROUP BY trip_id HAVING count(*) < 2")
def short_trips_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stops(spark, sf_dir).groupBy("trip_id").agg(F.count("*").alias("stops")).where("stops < 2")


@query(f"WITH {_STOPS} SELECT trip_id, stop_sequence, stop_id FROM st WHERE trip_id IN (SELECT trip_id FROM st WHERE stop_id = 'purchase')")
def regional_trip_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.groups_with_hit(_stops(spark, sf_dir), "trip_id", F.col("stop_id") == "purchase").select("trip_id", "stop_sequence", "stop_id")


@query("""WITH e AS (SELECT user_id % 50 AS node, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT) AS sec, max(event_id) AS event_id FROM events GROUP BY ALL),
s AS (SELECT node, slot.range AS slot FROM (SELECT DISTINCT node FROM e) CROSS JOIN range(0, 86400, 900) slot),
j AS (SELECT s.node, s.slot, e.sec, e.event_id FROM s ASOF JOIN e ON e.node = s.node AND e.sec >= s.slot)
SELECT node, slot, sec, event_id, sec - slot AS wait FROM j""")
def departure_slot_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("node"), (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("bigint").alias("sec"), "event_id").groupBy("node", "sec").agg(F.max("event_id").alias("event_id"))
    slots = e.select("node").distinct().withColumn("slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(86399).cast("bigint"), F.lit(900).cast("bigint"))))
    return relational.asof_forward(slots, e, "node", "slot", "sec", ["event_id"]).where("sec is not null").withColumn("wait", F.col("sec") - F.col("slot"))


@query("""WITH e AS (SELECT user_id % 50 AS node, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT) AS sec, event_id % 9 AS line FROM events),
p AS (SELECT node, sec, CAST(5 + line AS DOUBLE) AS minutes, CAST(line AS BIGINT) AS target, row_number() OVER (PARTITION BY node, sec ORDER BY line) AS rn FROM e),
s AS (SELECT node, slot.range AS slot FROM (SELECT DISTINCT node FROM e) CROSS JOIN range(0, 86400, 900) slot),
j AS (SELECT s.node, (p.sec - s.slot) / 60.0 + p.minutes AS total, p.target FROM s ASOF JOIN (SELECT * FROM p WHERE rn = 1) p ON p.node = s.node AND p.sec >= s.slot),
m AS (SELECT node, target, row_number() OVER (PARTITION BY node ORDER BY count(*) DESC, target) AS rn FROM j GROUP BY node, target)
SELECT CAST(0 AS BIGINT) AS key, j.node, median(total) AS mediaan, min(total) AS min, quantile_cont(total, 0.9) AS p90, count(*) AS aantal, any_value(m.target) AS target FROM j JOIN m ON m.node = j.node AND m.rn = 1 GROUP BY j.node""")
def slot_profile_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("node"), (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("bigint").alias("sec"), (F.col("event_id") % 9).alias("line"))
    p = relational.first_per_key(e, ["node", "sec"], [F.col("line")]).select(F.lit(0).cast("bigint").alias("key"), "node", "sec", (5 + F.col("line")).cast("double").alias("minutes"), F.col("line").alias("target"))
    return transit.slot_profiles(p, 0, 86399, 15)


@query("""WITH e AS (SELECT user_id % 50 AS node, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT) AS sec, event_id FROM events),
l AS (SELECT event_id, (node + 1) % 50 AS other, sec + 300 AS ready FROM e), r AS (SELECT node, sec, max(event_id) AS next_id FROM e GROUP BY ALL)
SELECT l.event_id, l.other, l.ready, r.sec, r.next_id FROM l ASOF JOIN r ON r.node = l.other AND r.sec >= l.ready""")
def transfer_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("node"), (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("bigint").alias("sec"), "event_id")
    left = e.select("event_id", ((F.col("node") + 1) % 50).alias("other"), (F.col("sec") + 300).alias("ready"))
    right = e.groupBy("node", "sec").agg(F.max("event_id").alias("next_id")).withColumnRenamed("node", "other")
    return relational.asof_forward(left, right, "other", "ready", "sec", ["next_id"]).where("sec is not null")


@query("""WITH c AS (SELECT o_custkey AS service_id, strftime(o_orderdate, '%Y%m%d') AS date, CASE WHEN o_orderstatus = 'F' THEN '2' ELSE '1' END AS exception_type FROM orders),
d AS (SELECT min(date) AS day FROM c)
SELECT DISTINCT service_id FROM c, d WHERE date = day AND exception_type = '1' AND service_id NOT IN (SELECT service_id FROM c, d WHERE date = day AND exception_type = '2')""")
def service_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("service_id"), F.date_format("o_orderdate", "yyyyMMdd").alias("date"), F.when(F.col("o_orderstatus") == "F", "2").otherwise("1").alias("exception_type"))
    return relational.active_services(None, c, c.agg(F.min("date")).first()[0])


@query("""WITH v AS (SELECT l_partkey, l_orderkey, l_linenumber, CAST(o_orderdate AS DATE) AS b, CASE WHEN l_returnflag <> 'N' THEN CAST(l_shipdate AS DATE) END AS e FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT l_partkey, l_orderkey, l_linenumber, CAST(b AS VARCHAR) AS begin_geldigheid, CAST(e AS VARCHAR) AS eind_geldigheid FROM v WHERE b <= DATE '1996-12-31' AND (e IS NULL OR e > DATE '1996-12-31')
QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY b DESC, l_orderkey DESC, l_linenumber DESC) = 1""")
def validity_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("begin_geldigheid"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_partkey", "l_orderkey", "l_linenumber", "begin_geldigheid", F.when(F.col("l_returnflag") != "N", F.to_date("l_shipdate")).alias("eind_geldigheid"))
    found = relational.latest_valid(rows, ["l_partkey"], "begin_geldigheid", "eind_geldigheid", F.lit("1996-12-31").cast("date"), [F.col(c).desc() for c in ("begin_geldigheid", "l_orderkey", "l_linenumber")])
    return found.withColumns({c: F.col(c).cast("string") for c in ("begin_geldigheid", "eind_geldigheid")})


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN
  (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'EUROPE'))))""")
def selection_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "region").where("r_name = 'EUROPE'")
    steps = [(table(spark, sf_dir, n), p, k) for n, p, k in (("nation", "n_regionkey", "n_nationkey"), ("customer", "c_nationkey", "c_custkey"), ("orders", "o_custkey", "o_orderkey"), ("lineitem", "l_orderkey", "l_orderkey"))]
    return relational.cascade(steps, regions, "r_regionkey")[-1].select("l_orderkey", "l_linenumber", "l_partkey")


@query("""WITH w AS (SELECT p_brand, p_size, unnest(string_split(p_type, ' ')) AS part FROM part)
SELECT p_brand, string_agg(DISTINCT trim(part), ' ' ORDER BY trim(part)) FILTER (WHERE trim(part) <> '') AS gebruiksdoelen FROM w GROUP BY p_brand""")
def use_codes_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.split_set(table(spark, sf_dir, "part"), "p_type", " ", ["p_brand"], "gebruiksdoelen")


@query("""WITH a AS (SELECT s_suppkey, s_nationkey AS postcode, s_suppkey % 40 AS nummer FROM supplier), c AS (SELECT c_custkey, c_nationkey AS postcode, c_custkey % 40 AS nummer FROM customer),
e AS (SELECT postcode, nummer, count(*) AS n, min(s_suppkey) AS id FROM a GROUP BY ALL), p AS (SELECT postcode, min(s_suppkey) AS id, count(*) AS n FROM a GROUP BY ALL)
SELECT c_custkey, CASE WHEN e.n = 1 THEN e.id WHEN e.n > 1 THEN e.id WHEN p.n > 0 THEN p.id END AS match,
  CASE WHEN e.n = 1 THEN 'adres_exact' WHEN e.n > 1 THEN 'adres_meerdere' WHEN p.n > 0 THEN 'postcode' ELSE 'geen_match' END AS match_type
FROM c LEFT JOIN e USING (postcode, nummer) LEFT JOIN p USING (postcode)""")
def address_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("postcode"), (F.col("s_suppkey") % 40).alias("nummer"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("postcode"), (F.col("c_custkey") % 40).alias("nummer"))
    e = a.groupBy("postcode", "nummer").agg(F.count("*").alias("_en"), F.min("s_suppkey").alias("_e"))
    p = a.groupBy("postcode").agg(F.count("*").alias("_pn"), F.min("s_suppkey").alias("_p"))
    rows = c.join(e, ["postcode", "nummer"], "left").join(p, "postcode", "left")
    return relational.best_candidate(rows, [("adres_exact", F.col("_en") == 1, F.col("_e")), ("adres_meerdere", F.col("_en") > 1, F.col("_e")), ("postcode", F.col("_pn") > 0, F.col("_p"))]).select("c_custkey", "match", "match_type")


@query("""WITH w AS (SELECT s_suppkey AS id, s_nationkey AS land, CAST(floor(s_acctbal) AS BIGINT) AS nummer FROM supplier), a AS (SELECT c_custkey, c_nationkey AS land, CAST(floor(c_acctbal) AS BIGINT) AS n FROM customer)
SELECT w.id, a.c_custkey, abs(a.n - w.nummer) AS afstand FROM w JOIN a USING (land) QUALIFY row_number() OVER (PARTITION BY w.id ORDER BY abs(a.n - w.nummer), a.c_custkey) = 1""")
def nearest_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("land"), F.floor("c_acctbal").alias("n"))
    wanted = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("land"), F.floor("s_acctbal").alias("nummer"))
    return facilities.nearest_house_number(wanted, a, "id", ["land"], "nummer", "n", "c_custkey")


@query("""SELECT p_partkey, lower(trim(p_name)) AS naam, CASE WHEN contains(lower(p_type), 'brushed') THEN false WHEN contains(lower(p_type), 'brass') OR contains(lower(p_type), 'steel') THEN true WHEN p_size >= 40 THEN true ELSE false END AS geschikt,
  lower(trim(CASE WHEN p_size % 3 = 0 THEN ' Ja ' WHEN p_size % 3 = 1 THEN '1' ELSE 'nee' END)) IN ('true', '1', 'ja', 'yes') AS gevalideerd FROM part""")
def tag_filter_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = text.plain(F.col("p_type"))
    ok = facilities.decide(exclude=text.contains_any(kind, ["brushed"]), include=[text.contains_any(kind, ["brass", "steel"]), F.col("p_size") >= 40])
    flag = F.when(F.col("p_size") % 3 == 0, " Ja ").when(F.col("p_size") % 3 == 1, "1").otherwise("nee")
    return table(spark, sf_dir, "part").select("p_partkey", text.plain(F.col("p_name")).alias("naam"), ok.alias("geschikt"), text.text_flag(flag).alias("gevalideerd"))


@query("""SELECT event_id, json_extract_string(props, '$.' || (json_keys(props))[1]) AS first_value, CAST(len(json_keys(props)) AS INTEGER) AS tags FROM events""")
def json_tags_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").select("event_id", F.get(F.map_values(tags), F.lit(0)).alias("first_value"), F.size(tags).alias("tags"))


@query("""SELECT c_custkey AS id, c_name AS naam, 'klant' AS bron, c_mktsegment AS segment, c_acctbal AS saldo FROM customer UNION ALL BY NAME SELECT s_suppkey AS id, s_name AS naam, 'leverancier' AS bron, s_acctbal AS saldo FROM supplier""")
def union_missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("naam"), F.lit("klant").alias("bron"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("saldo"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("naam"), F.lit("leverancier").alias("bron"), F.col("s_acctbal").alias("saldo"))
    return relational.union_all(a, b)


@query("""WITH b AS (SELECT c_custkey AS id, c_nationkey AS land FROM customer WHERE c_nationkey < 15) SELECT * FROM b UNION ALL SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey NOT IN (SELECT land FROM b)""")
def anti_join_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer").where("c_nationkey < 15").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("land"))
    more = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("land"))
    return relational.append_unmatched(base, more, base.land == more.land)


def _places(spark: SparkSession, sf_dir: str, prefix: str = "") -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    at = lambda k: F.floor(F.col("embedding")[k].cast("double") * 100000).cast("double")
    names = ("vec_id", "x", "y") if not prefix else (f"{prefix}id", f"{prefix}x", f"{prefix}y")
    return e.select(F.col("vec_id").alias(names[0]), at(0).alias(names[1]), at(1).alias(names[2]))


_PLACES = "p AS (SELECT vec_id, floor(CAST(embedding[1] AS DOUBLE) * 100000) AS x, floor(CAST(embedding[2] AS DOUBLE) * 100000) AS y FROM embeddings)"


@query(f"WITH {_PLACES} SELECT a.vec_id, b.vec_id AS rid, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS afstand_m FROM p a JOIN p b ON a.vec_id < b.vec_id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 800")
def grid_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spatial.within_distance(_places(spark, sf_dir), _places(spark, sf_dir, "r"), 800.0)
    return pairs.where("vec_id < rid").select("vec_id", "rid", "afstand_m")


@query(f"""WITH {_PLACES}, d AS (SELECT a.vec_id, b.vec_id AS rid, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS afstand_m FROM p a JOIN p b ON a.vec_id <> b.vec_id)
SELECT * FROM d WHERE afstand_m <= 2500 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY afstand_m, rid) = 1""")
def knn1_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spatial.within_distance(_places(spark, sf_dir), _places(spark, sf_dir, "r"), 2500.0).where("vec_id <> rid")
    return relational.first_per_key(pairs, ["vec_id"], [F.col("afstand_m"), F.col("rid")]).select("vec_id", "rid", "afstand_m")


@query(f"""WITH {_PLACES}, r AS (SELECT vec_id AS buurt, x AS xmin, y AS ymin, x + 1000 + vec_id % 7 * 500 AS xmax, y + 2000 AS ymax FROM p)
SELECT p.vec_id, r.buurt FROM p JOIN r ON p.x > xmin AND p.x < xmax AND p.y > ymin AND p.y < ymax""")
def pip_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _places(spark, sf_dir, "r").withColumn("xm", F.col("rx") + 1000 + F.col("rid") % 7 * 500).withColumn("ym", F.col("ry") + 2000)
    corner = lambda a, b: geometry.point(F.col(a), F.col(b))
    polygons = r.select(F.col("rid").alias("buurt"), F.array(F.array(corner("rx", "ry"), corner("xm", "ry"), corner("xm", "ym"), corner("rx", "ym"), corner("rx", "ry"))).alias("polygon"))
    return spatial.points_in_polygons(_places(spark, sf_dir), polygons, size=2000.0, crowd=8192).select("vec_id", "buurt")


@query("""WITH e AS (SELECT l_orderkey, l_linenumber, 52.5 + l_suppkey % 100 / 100.0 AS a, 5.0 + l_suppkey % 70 / 50.0 AS b, 52.5 + l_partkey % 100 / 100.0 AS c, 5.0 + l_partkey % 70 / 50.0 AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(floor(2 * 6371000.0 * asin(sqrt(pow(sin((radians(c) - radians(a)) / 2), 2) + cos(radians(a)) * cos(radians(c)) * pow(sin(radians(d - b) / 2), 2))) + 0.5) AS BIGINT) AS meter FROM e""")
def haversine_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda k, m, q, base: F.lit(base) + F.col(k) % m / float(q)
    meter = geometry.haversine(c("l_suppkey", 100, 100, 52.5), c("l_suppkey", 70, 50, 5.0), c("l_partkey", 100, 100, 52.5), c("l_partkey", 70, 50, 5.0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.floor(meter + 0.5).cast("bigint").alias("meter"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of consecutive lines of an order are joined by a way, open both ways where quantities are even, else one way."""
    line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("u"), F.lead("l_suppkey").over(line).alias("v"), F.col("l_quantity").alias("minutes"))
    return rows.where("v is not null and u <> v").select("u", "v", "minutes", F.lit(True).alias("forward"), (F.col("minutes") % 2 == 0).alias("backward"), (F.col("u") * 1000000 + F.col("v")).alias("edge_id"))


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.directed_edges(_lines(spark, sf_dir))


def _seeds(spark: SparkSession, sf_dir: str, but: int = -1) -> DataFrame:
    """Suppliers with a large balance are the facilities; ``but`` closes those of one nation."""
    return table(spark, sf_dir, "supplier").where(f"s_acctbal > 4500 and s_nationkey <> {but}").select(F.col("s_suppkey").alias("node"), (F.col("s_suppkey") % 4).cast("double").alias("cost"), F.col("s_suppkey").alias("target"))


_GRAPH = """l AS (SELECT l_suppkey AS u, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS v, l_quantity AS w FROM lineitem),
e AS (SELECT src, dst, min(w) AS w FROM (SELECT u AS src, v AS dst, w FROM l WHERE v IS NOT NULL AND u <> v UNION ALL SELECT v, u, w FROM l WHERE v IS NOT NULL AND u <> v AND w % 2 = 0) GROUP BY ALL)"""


def _search(but: int = -1, name: str = "d", cutoff: str = "") -> str:
    """Recursive least costs with the nearest target: states (node, cost, target) until nothing gets better."""
    return f"""{name}(node, cost, target) USING KEY (node) AS (
  SELECT s_suppkey, CAST(s_suppkey % 4 AS DOUBLE), s_suppkey FROM supplier WHERE s_acctbal > 4500 AND s_nationkey <> {but}
  UNION SELECT src, k.c, k.t FROM (SELECT e.src, min({{'c': {name}.cost + e.w, 't': {name}.target}}) AS k FROM {name} JOIN e ON e.dst = {name}.node GROUP BY e.src) x
  LEFT JOIN recurring.{name} r ON r.node = x.src WHERE (r.node IS NULL OR k.c < r.cost OR (k.c = r.cost AND k.t < r.target)) {cutoff})"""


@query(f"WITH RECURSIVE {_GRAPH}, {_search()} SELECT node, cost, target FROM d")
def sssp_multi_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.shortest_paths(_graph(spark, sf_dir), _seeds(spark, sf_dir)).select("node", "cost", "target")


@query(f"WITH RECURSIVE {_GRAPH}, {_search(cutoff='AND k.c <= 9')} SELECT node, cost, target, CAST(CASE WHEN cost <= 3 THEN 1 WHEN cost <= 6 THEN 2 WHEN cost <= 9 THEN 3 END AS INTEGER) AS band FROM d")
def sssp_cutoff_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = network.shortest_paths(_graph(spark, sf_dir), _seeds(spark, sf_dir), cutoff=9.0).select("node", "cost", "target")
    return network.bands(found, (3.0, 6.0, 9.0))


@query()
def path_flow_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = network.shortest_paths(_graph(spark, sf_dir), _seeds(spark, sf_dir))
    starts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("node")).agg(F.count("*").alias("panden"))
    flows = network.flow_counts(starts, tree)
    style = classes.flow_style(F.col("panden"))
    return flows.select("src", "dst", "panden", style["klasse"].alias("klasse"))


@query(f"""WITH RECURSIVE {_GRAPH}, {_search()}, {_search(but=9, name="n")}
SELECT d.node, d.cost AS cost_nu, n.cost AS cost_straks, n.cost - d.cost AS verschil FROM d LEFT JOIN n ON n.node = d.node WHERE n.cost IS NULL OR n.cost <> d.cost""")
def scenario_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = network.checkpointed(_graph(spark, sf_dir))
    now = network.shortest_paths(edges, _seeds(spark, sf_dir)).select("node", F.col("cost").alias("cost_nu"))
    then = network.shortest_paths(edges, _seeds(spark, sf_dir, but=9)).select(F.col("node").alias("_n"), F.col("cost").alias("cost_straks"))
    both = now.join(then, F.col("node") == F.col("_n"), "left").drop("_n")
    return both.where("cost_straks is null or cost_straks <> cost_nu").withColumn("verschil", F.col("cost_straks") - F.col("cost_nu"))


@query("""SELECT onderwerp, CAST(0 AS BIGINT) AS verwacht, werkelijk, CASE WHEN werkelijk = 0 THEN 'OK' ELSE 'FOUT' END AS status FROM (
  SELECT 'klanten zonder land' AS onderwerp, count(*) FILTER (WHERE c_nationkey IS NULL) AS werkelijk FROM customer
  UNION ALL SELECT 'negatief saldo', count(*) FILTER (WHERE s_acctbal < 0) FROM supplier
  UNION ALL SELECT 'verzonden voor besteld', count(*) FILTER (WHERE l_shipdate < o_orderdate) FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  UNION ALL SELECT 'lege tekst', count(*) FILTER (WHERE coalesce(trim(text), '') = '') FROM documents)""")
def dq_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    shipped = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    rules = [
        ("klanten zonder land", table(spark, sf_dir, "customer"), F.col("c_nationkey").isNull()),
        ("negatief saldo", table(spark, sf_dir, "supplier"), F.col("s_acctbal") < 0),
        ("verzonden voor besteld", shipped, F.col("l_shipdate") < F.col("o_orderdate")),
        ("lege tekst", table(spark, sf_dir, "documents"), text.blank_to_null(F.col("text")).isNull()),
    ]
    return relational.checks(rules)


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, CAST(l_orderkey * 37 % 100000 AS BIGINT) AS sec FROM lineitem)
SELECT l_orderkey, l_linenumber, printf('%02d:%02d:%02d', sec // 3600, sec % 3600 // 60, sec % 60) AS tijd, sec AS terug FROM s""")
def station_time_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    sec = (F.col("l_orderkey") * 37 % 100000).cast("bigint")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", times.clock(sec).alias("tijd")).withColumn("terug", times.seconds_of(F.col("tijd")))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS titel, CAST(len(regexp_extract_all(html, '<p>')) AS INTEGER) AS alineas FROM pages")
def xml_text_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("titel"), F.size(F.regexp_extract_all("html", F.lit("<p>"), F.lit(0))).alias("alineas"))


@query(f"""WITH {_ACCESS} SELECT gemeente, modus, CASE WHEN count(DISTINCT norm) = 1 THEN CAST(max(norm) AS VARCHAR) ELSE 'varieert' END AS norm, count(*) AS panden,
  CASE WHEN p >= 80 THEN 'Goed' WHEN p >= 60 THEN 'Vereist aandacht' WHEN p >= 40 THEN 'Knelpunt' ELSE 'Ernstig knelpunt' END AS oordeel
FROM (SELECT *, count(*) FILTER (WHERE within) OVER (PARTITION BY gemeente, modus) * 100.0 / count(*) OVER (PARTITION BY gemeente, modus) AS p FROM access) GROUP BY gemeente, modus, p""")
def municipality_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = access(spark, sf_dir).groupBy("gemeente", "modus").agg(rollup.norm_label(F.col("norm")).alias("norm"), F.count("*").alias("panden"), F.count_if("within").alias("_in"))
    return rows.select("gemeente", "modus", "norm", "panden", classes.reach_class(F.col("_in") * 100.0 / F.col("panden")).alias("oordeel"))


@query("""SELECT o_orderpriority AS klasse, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS lengte_meter, count(*) AS segmenten FROM orders GROUP BY 1""")
def network_quality_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("klasse"), F.col("o_totalprice").cast("decimal(18,2)").alias("lengte"))
    return rollup.length_shares(rows, "klasse", "lengte").drop("aandeel").withColumn("lengte_meter", F.col("lengte_meter").cast("double"))


_REPORT = f"""WITH {_ACCESS}, r AS (SELECT 'f' AS facility, modus, pand_id, norm, within FROM access),
t AS (SELECT facility, modus, count(*) AS totaal, count(*) FILTER (WHERE within) AS binnen, count(*) FILTER (WHERE NOT within) AS buiten,
  'varieert: ' || string_agg(DISTINCT CAST(norm AS VARCHAR), '/' ORDER BY CAST(norm AS VARCHAR)) AS norm, CASE modus WHEN 'lopen' THEN 1 WHEN 'fiets' THEN 2 WHEN 'auto' THEN 3 WHEN 'ov_lopen' THEN 4 ELSE 5 END AS k FROM r GROUP BY facility, modus),
p AS (SELECT *, CAST(binnen * 100.0 / totaal AS DOUBLE) AS percentage_binnen, CAST(buiten * 100.0 / totaal AS DOUBLE) AS percentage_buiten FROM t),
m AS (SELECT facility, modus, totaal, binnen, buiten, norm, percentage_binnen, percentage_buiten, k, CASE WHEN percentage_binnen >= 80 THEN 'Goed' WHEN percentage_binnen >= 60 THEN 'Vereist aandacht' WHEN percentage_binnen >= 40 THEN 'Knelpunt' ELSE 'Ernstig knelpunt' END AS klasse,
  CAST(row_number() OVER (ORDER BY percentage_buiten DESC, buiten DESC, k) AS INTEGER) AS positie, percentage_buiten - min(percentage_buiten) OVER () AS verschil_met_beste FROM p)"""


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access(spark, sf_dir).select(F.lit("f").alias("facility"), "modus", "pand_id", F.col("norm").alias("norm_min"), "within", "buurt", "gemeente")


@query(f"{_REPORT} SELECT * EXCLUDE (k) FROM m")
def report_mode_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.mode_table(_report(spark, sf_dir))


@query(f"""{_REPORT}, e AS (SELECT pand_id, count(*) FILTER (WHERE NOT within) AS buiten FROM r GROUP BY pand_id), c AS (SELECT least(buiten, 99) AS buiten, count(*) AS n FROM e GROUP BY 1)
SELECT 'f' AS facility, g.range AS buiten, coalesce(c.n, 0) AS panden, CAST(coalesce(c.n, 0) * 100.0 / sum(coalesce(c.n, 0)) OVER () AS DOUBLE) AS percentage FROM range(6) g LEFT JOIN c ON c.buiten = g.range""")
def report_insufficient_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.insufficient_counts(_report(spark, sf_dir))


@query(f"""{_REPORT}, w AS (SELECT pand_id, count(*) AS n, bool_or(within AND modus = 'auto') AS a, bool_or(within AND modus <> 'auto') AS o FROM r GROUP BY pand_id HAVING count(*) = 5),
s AS (SELECT count(*) FILTER (WHERE NOT a AND NOT o) AS buiten_alle, count(*) FILTER (WHERE a AND NOT o) AS alleen_auto FROM w)
SELECT 'f' AS facility, max(totaal) AS totaal, arg_max(modus, positie * -1) AS slechtste_modaliteit, arg_min(modus, percentage_buiten * 1000000000 + buiten * 10 + k) AS beste_modaliteit, any_value(buiten_alle) AS buiten_alle, any_value(alleen_auto) AS alleen_auto,
  CAST(any_value(buiten_alle) * 100.0 / max(totaal) AS DOUBLE) AS percentage_buiten_alle, CAST(any_value(alleen_auto) * 100.0 / max(totaal) AS DOUBLE) AS percentage_alleen_auto FROM m, s""")
def report_key_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.key_figures(_report(spark, sf_dir))


@query(f"""WITH {_ACCESS}, w AS (SELECT pand_id, gemeente, buurt, coalesce(bool_or(within) FILTER (WHERE modus = 'auto'), false) AS a, coalesce(bool_or(within) FILTER (WHERE modus <> 'auto'), false) AS o FROM access GROUP BY ALL HAVING count(*) = 5)
SELECT gemeente, buurt, count(*) AS panden, count(*) FILTER (WHERE a AND NOT o) AS alleen_auto, count(*) FILTER (WHERE a AND NOT o) AS autoafhankelijk,
  CAST(count(*) FILTER (WHERE a AND NOT o) * 100.0 / count(*) AS DOUBLE) AS percentage_alleen_auto, CAST(count(*) FILTER (WHERE a AND NOT o) * 100.0 / count(*) AS DOUBLE) AS percentage_autoafhankelijk FROM w GROUP BY gemeente, buurt""")
def report_car_dependence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.car_dependence(_report(spark, sf_dir), ["gemeente", "buurt"])


@query("""WITH u AS (SELECT l_orderkey AS pand_id, l_linenumber AS v, CASE WHEN l_returnflag = 'N' THEN 'woonfunctie;winkelfunctie' WHEN l_returnflag = 'A' THEN 'winkelfunctie' END AS d, l_quantity AS m, l_linestatus = 'O' AS b FROM lineitem),
c AS (SELECT pand_id, string_agg(DISTINCT x, ';' ORDER BY x) AS gebruiksdoelen FROM (SELECT pand_id, unnest(string_split(d, ';')) AS x FROM u) GROUP BY pand_id)
SELECT u.pand_id, count(DISTINCT v) AS vbo_aantal, count(*) FILTER (WHERE b) AS vbo_in_gebruik_aantal, count(*) FILTER (WHERE d LIKE '%woonfunctie%') AS vbo_woonfunctie_aantal, CAST(sum(m) AS DOUBLE) AS vbo_oppervlakte_totaal,
  CAST(coalesce(sum(m) FILTER (WHERE d LIKE '%woonfunctie%'), 0) AS DOUBLE) AS vbo_woonoppervlakte_totaal, any_value(c.gebruiksdoelen) AS gebruiksdoelen, count(*) FILTER (WHERE d LIKE '%woonfunctie%') > 0 AS is_woonpand FROM u LEFT JOIN c USING (pand_id) GROUP BY u.pand_id""")
def building_use_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = F.when(F.col("l_returnflag") == "N", "woonfunctie;winkelfunctie").when(F.col("l_returnflag") == "A", "winkelfunctie")
    state = F.when(F.col("l_linestatus") == "O", "Verblijfsobject in gebruik").otherwise("Verblijfsobject gevormd")
    units = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pand_id"), F.col("l_linenumber").alias("verblijfsobject_id"), uses.alias("gebruiksdoelen"), F.col("l_quantity").cast("string").alias("oppervlakte"), state.alias("verblijfsobject_status"))
    return register.use_summary(units)


@query("""WITH b AS (SELECT o_orderkey AS pand_id, strftime(o_orderdate, '%Y-%m-%d') AS b, CASE WHEN o_orderstatus <> 'O' THEN strftime(o_orderdate + INTERVAL 500 DAY, '%Y-%m-%d') END AS e FROM orders)
SELECT pand_id, b AS begin, e AS eind, j.jaar FROM b CROSS JOIN (VALUES (1995), (1996), (1997)) j(jaar) WHERE b <= j.jaar || '-12-31' AND (e IS NULL OR e > j.jaar || '-12-31')""")
def validity_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    end = F.when(F.col("o_orderstatus") != "O", F.date_format(F.date_add(F.to_date("o_orderdate"), 500), "yyyy-MM-dd"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pand_id"), day.alias("begin"), end.alias("eind"))
    return relational.valid_in_years(rows, "begin", "eind", (1995, 1996, 1997))


@query(f"""WITH {_PLACES}, b AS (SELECT floor(x / 1000) AS cx, floor(y / 1000) AS cy, CASE WHEN vec_id % 30 <= 10 THEN 1 WHEN vec_id % 30 <= 20 THEN 2 ELSE 3 END AS band FROM p),
n AS (SELECT dx.range - 2 AS dx, dy.range - 2 AS dy FROM range(5) dx, range(5) dy), c AS (SELECT CAST(cx + dx AS BIGINT) AS cx, CAST(cy + dy AS BIGINT) AS cy, min(band) AS band FROM b, n WHERE (dx * dx + dy * dy) * 1000000 <= 2250000 GROUP BY 1, 2)
SELECT cx, cy, CAST(band AS INTEGER) AS band FROM c""")
def isochrone_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _places(spark, sf_dir).select("x", "y", (F.col("vec_id") % 30).cast("double").alias("total_min"), F.lit(True).alias("within"))
    return isochrones.band_cells(isochrones.building_bands(rows, [10.0, 20.0, 30.0]), reach=1500.0, size=1000.0)


@query("""WITH w AS (SELECT l_orderkey * 10 + l_linenumber AS wvk_id, l_returnflag, l_linestatus, l_quantity FROM lineitem),
a AS (SELECT *, l_returnflag = 'A' AS h, l_returnflag = 'R' AS t, l_returnflag = 'N' AND l_quantity % 2 = 0 AS extra, l_linestatus AS d FROM w)
SELECT wvk_id, h OR (extra AND d <> 'F') AS heen_toegestaan, t OR (extra AND d <> 'O') AS terug_toegestaan, CASE WHEN h OR t THEN 'toegang' ELSE 'aanvulling_onbekend' END AS selectie_bron,
  CAST(floor(l_quantity * 10 / (30 * 1000 / 60.0) * 1000000) AS BIGINT) AS micro_min FROM a WHERE (h OR t OR extra)""")
def road_access_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("wvk_id"), "l_returnflag", "l_linestatus", "l_quantity")
    flags = [F.lit("N").alias(f"{s}_{d}") for s in roads.VEHICLES.values() for d in "ht" if s != "auto"]
    ways = lines.select("wvk_id", F.when(F.col("l_returnflag") == "A", "J").otherwise("N").alias("auto_h"), F.when(F.col("l_returnflag") == "R", "j ").otherwise("N").alias("auto_t"), *flags, F.when(F.col("l_quantity") % 2 == 0, F.array(F.lit("Onbekend"))).otherwise(F.array(F.lit("straat"))).alias("wegcategorieen"), F.when(F.col("l_linestatus") == "O", "H").otherwise("T").alias("richting_bron"), F.lit(False).alias("op_water"), (F.col("l_quantity") * 10).cast("string").alias("lengte_meter"), F.lit(30.0).alias("max_snelheid_kmh"), F.array(geometry.point(F.lit(0), F.lit(0)), geometry.point(F.lit(1), F.lit(0))).alias("line"))
    got = roads.costs(roads.access(ways, "personenauto"), "personenauto")
    return got.select("wvk_id", "heen_toegestaan", "terug_toegestaan", "selectie_bron", F.floor(F.col("reistijd_min") * 1000000).cast("bigint").alias("micro_min"))


@query("""WITH s AS (SELECT c_custkey % 500 AS pand_id, c_mktsegment AS segment_type, c_nationkey AS edge_id, CAST(c_custkey % 3 AS VARCHAR) AS area, c_acctbal > 0 AS within, c_custkey % 7 AS target FROM customer),
o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY pand_id, segment_type, edge_id, area ORDER BY within DESC, target) = 1)
SELECT segment_type, area, edge_id, count(*) AS aantal_panden, count(*) FILTER (WHERE within) AS aantal_panden_binnen_norm FROM o GROUP BY ALL""")
def flow_segments_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    routes = c.select((F.col("c_custkey") % 500).alias("pand_id"), F.col("c_mktsegment").alias("segment_type"), F.col("c_nationkey").alias("edge_id"), F.array(geometry.point(F.col("c_nationkey"), F.lit(0))).alias("line"), (F.col("c_custkey") % 3).cast("string").alias("area"), (F.col("c_acctbal") > 0).alias("within"), (F.col("c_custkey") % 7).alias("target"), F.lit("x").alias("target_name"))
    got = maplayers.flow_segments(routes, "lopen")
    return got.select("segment_type", "area", F.col("line")[0]["x"].cast("int").alias("edge_id"), "aantal_panden", "aantal_panden_binnen_norm")
