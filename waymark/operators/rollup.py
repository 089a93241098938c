"""Roll-ups of access results to areas, best-of-modes choices, shortage diagnosis and ranked report tables.

Results are kept long: a row per facility, mode and building. What the wide products need is pivoted from it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import classes
from waymark.operators.relational import first_per_key


def percent(part: Column, whole: Column) -> Column:
    """Part of the whole in percent; 0 without a whole."""
    return F.when(whole > 0, part * 100.0 / whole).otherwise(0.0)


def area_aggregates(minutes: str = "minutes", within: str = "within", id_col: str = "pand_id") -> list[Column]:
    """Counts, median and 90th percentile of an area's buildings."""
    m = F.col(minutes)
    return [
        F.count(id_col).alias("panden_aantal"),
        F.count(m).alias("panden_met_reistijd"),
        F.count_if(F.coalesce(F.col(within), F.lit(False))).alias("panden_binnen_norm"),
        F.median(m).alias("reistijd_mediaan_min"),
        F.percentile(m, 0.9).alias("reistijd_p90_min"),
    ]


def with_percentages(df: DataFrame) -> DataFrame:
    """Shares of the buildings with a time and within the norm, and the class and colour of the latter."""
    out = df.withColumn("percentage_met_reistijd", percent(F.col("panden_met_reistijd"), F.col("panden_aantal"))).withColumn("percentage_binnen_norm", percent(F.col("panden_binnen_norm"), F.col("panden_aantal")))
    band = classes.area_band(F.col("percentage_binnen_norm"))
    return out.withColumn("klasse", band["klasse"]).withColumn("kleur", band["kleur"])


def area_summary(access: DataFrame, area: Sequence[str], keep_null_areas: bool = False, minutes: str = "minutes", within: str = "within", id_col: str = "pand_id") -> DataFrame:
    """One roll-up per area; rows without an area drop out unless asked for."""
    rows = access if keep_null_areas else access.dropna(subset=list(area))
    return with_percentages(rows.groupBy(*area).agg(*area_aggregates(minutes, within, id_col)))


def area_rollup(access: DataFrame, small: str, large: str, minutes: str = "minutes", within: str = "within", id_col: str = "pand_id") -> DataFrame:
    """Neighbourhoods and municipalities from one pass: grouping sets instead of two group-bys. ``niveau`` tells them apart."""
    sets = access.groupingSets([[F.col(large), F.col(small)], [F.col(large)]], F.col(large), F.col(small))
    rows = sets.agg(F.grouping(small).alias("_g"), *area_aggregates(minutes, within, id_col))
    return with_percentages(rows).withColumn("niveau", F.when(F.col("_g") == 1, "groot").otherwise("klein")).drop("_g")


def best_of_modes(access: DataFrame, keys: Sequence[str], modes: Sequence[str], mode: str = "modus", minutes: str = "minutes", within: str = "within") -> DataFrame:
    """Per building the fastest mode within the norm, else the fastest at all; ties go to the earlier mode.

    Adds modus, minutes, within, aantal_bereikbaar, aantal_binnen_norm and keuze (binnen_norm, bereikbaar, geen_route).
    """
    place = F.array_position(F.array(*[F.lit(m) for m in modes]), F.col(mode))
    inside = F.coalesce(F.col(within), F.lit(False))
    rank = F.struct(F.when(inside, 0).otherwise(1).alias("a"), F.col(minutes).alias("b"), place.alias("c"), F.col(mode).alias("m"))
    rows = access.where(place > 0).groupBy(*keys).agg(F.min(F.when(F.col(minutes).isNotNull(), rank)).alias("_best"), F.count(minutes).alias("aantal_bereikbaar"), F.count_if(inside).alias("aantal_binnen_norm"))
    choice = F.when(F.col("aantal_binnen_norm") > 0, "binnen_norm").when(F.col("aantal_bereikbaar") > 0, "bereikbaar").otherwise("geen_route")
    return rows.select(*keys, F.col("_best.m").alias("modus"), F.col("_best.b").alias("minutes"), (F.col("aantal_binnen_norm") > 0).alias("within"), "aantal_bereikbaar", "aantal_binnen_norm", choice.alias("keuze"))


def dominant_mode(chosen: DataFrame, area: Sequence[str], mode: str = "modus") -> DataFrame:
    """The mode most buildings of an area choose, the alphabetically first where counts tie."""
    counts = chosen.where(F.col(mode).isNotNull()).groupBy(*area, mode).agg(F.count("*").alias("panden"))
    return first_per_key(counts, area, [F.col("panden").desc(), F.col(mode)]).withColumnRenamed(mode, "dominante_modus")


def diagnosis(areas: DataFrame, area: Sequence[str], modes: Sequence[str] = classes.MODES, mode: str = "modus", value: str = "percentage_binnen_norm") -> DataFrame:
    """A row per area with each mode's percentage, best and worst, modes below the signal, problem type and severity.

    A pivot of the long roll-ups; a mode without a row is null and isn't counted as insufficient.
    """
    wide = areas.groupBy(*area).pivot(mode, list(modes)).agg(F.max(value))
    shares = [F.col(m) for m in modes]
    low = [F.when(F.col(m) < classes.SIGNAL, F.lit(m)) for m in modes]
    few = F.size(F.filter(F.array(*low), lambda m: m.isNotNull())).cast("bigint")
    out = wide.withColumn("beste_percentage", F.array_max(F.array(*shares))).withColumn("slechtste_percentage", F.array_min(F.array(*shares))).withColumn("aantal_modaliteiten_onvoldoende", few).withColumn("modaliteiten_onvoldoende", F.concat_ws(", ", *low))
    kinds = classes.problem_type(*[F.col(m) for m in ("lopen", "fiets", "auto", "ov_lopen", "ov_fiets")], few) if set(classes.MODES) <= set(modes) else F.lit(None).cast("string")
    return out.withColumn("probleemtype", kinds).withColumn("ernstklasse", classes.severity(F.col("beste_percentage"), F.col("slechtste_percentage"), few))


def ranks(areas: DataFrame, within: Sequence[str], name: str, total: str = "panden_aantal", inside: str = "panden_binnen_norm") -> DataFrame:
    """Two ranks per group, worst first: by the share outside the norm and by the number; areas without buildings drop out."""
    rows = areas.where(F.col(total) > 0).withColumn("buiten", F.col(total) - F.col(inside)).withColumn("percentage_buiten", percent(F.col("buiten"), F.col(total)))
    relative = Window.partitionBy(*within).orderBy(F.col("percentage_buiten").desc(), F.col("buiten").desc(), F.col(name))
    absolute = Window.partitionBy(*within).orderBy(F.col("buiten").desc(), F.col("percentage_buiten").desc(), F.col(name))
    return rows.withColumn("rang_relatief", F.row_number().over(relative)).withColumn("rang_absoluut", F.row_number().over(absolute))


def best_and_worst(ranked: DataFrame, within: Sequence[str], k: int, rank: str = "rang_relatief") -> DataFrame:
    """The first and last ``k`` of each group with ``soort`` (slechtste, beste) and ``positie`` from 1."""
    size = F.count("*").over(Window.partitionBy(*within))
    rows = ranked.withColumn("_n", size)
    worst = rows.where(F.col(rank) <= k).withColumn("soort", F.lit("slechtste")).withColumn("positie", F.col(rank))
    best = rows.where(F.col(rank) > F.col("_n") - k).withColumn("soort", F.lit("beste")).withColumn("positie", (F.col("_n") - F.col(rank) + 1).cast("int"))
    return worst.unionByName(best).drop("_n")


def mode_histogram(per_building: DataFrame, count: str, most: int = 5) -> DataFrame:
    """Buildings by the number of sufficient modes, with zeros where there are none."""
    spark = per_building.sparkSession
    every = spark.range(most + 1).select(F.col("id").cast("bigint").alias("aantal"))
    found = per_building.groupBy(F.col(count).cast("bigint").alias("_n")).agg(F.count("*").alias("_panden"))
    total = per_building.agg(F.count("*").alias("_totaal"))
    rows = every.join(F.broadcast(found), F.col("aantal") == F.col("_n"), "left").join(F.broadcast(total))
    return rows.select("aantal", F.coalesce("_panden", F.lit(0).cast("bigint")).alias("panden"), percent(F.coalesce("_panden", F.lit(0)), F.col("_totaal")).alias("percentage"))


def building_flags(access: DataFrame, keys: Sequence[str], mode: str = "modus", within: str = "within", modes: Sequence[str] = classes.MODES, complete: bool = True) -> DataFrame:
    """Per building: number of sufficient modes, none, all, only car, not without car, on foot or by bike, only transit.

    With ``complete`` only buildings that all modes have count, as in an inner join of the modes' results.
    """
    wide = access.groupBy(*keys).agg(F.count("*").alias("_rows"), *[F.max(F.when(F.col(mode) == m, F.coalesce(F.col(within), F.lit(False)))).alias(f"_{m}") for m in modes])
    if complete:
        wide = wide.where(F.col("_rows") == len(modes))
    has = {m: F.coalesce(F.col(f"_{m}"), F.lit(False)) for m in modes}
    n = sum((h.cast("bigint") for h in has.values()), F.lit(0).cast("bigint"))
    has |= {m: F.lit(False) for m in classes.MODES if m not in has}
    active, transit = has["lopen"] | has["fiets"], has["ov_lopen"] | has["ov_fiets"]
    return wide.select(*keys, n.alias("aantal_voldoende"), (n == 0).alias("geen"), (n == len(modes)).alias("alle"), (has["auto"] & (n == 1)).alias("alleen_auto"), (has["auto"] & ~active & ~transit).alias("autoafhankelijk"), active.alias("lopen_of_fiets"), (transit & ~active & ~has["auto"]).alias("alleen_ov"))


def profiles(flags: DataFrame) -> DataFrame:
    """Named conditional counts over ``building_flags``: rows (profiel, panden, percentage)."""
    names = ("geen", "alle", "alleen_auto", "autoafhankelijk", "lopen_of_fiets", "alleen_ov")
    sums = flags.agg(F.count("*").alias("totaal"), *[F.count_if(F.col(n)).alias(n) for n in names])
    pairs = ", ".join(f"'{n}', {n}" for n in ("totaal", *names))
    return sums.selectExpr("totaal as _alle", f"stack({len(names) + 1}, {pairs}) as (profiel, panden)").select("profiel", "panden", percent(F.col("panden"), F.col("_alle")).alias("percentage"))


def mode_ranking(access: DataFrame, mode: str = "modus", within: str = "within", modes: Sequence[str] = classes.MODES) -> DataFrame:
    """Modes from worst to best by the share outside the norm, with the difference to the best one."""
    place = F.array_position(F.array(*[F.lit(m) for m in modes]), F.col(mode))
    rows = access.groupBy(mode).agg(F.count("*").alias("panden"), F.count_if(~F.coalesce(F.col(within), F.lit(False))).alias("buiten")).withColumn("percentage_buiten", percent(F.col("buiten"), F.col("panden"))).withColumn("_place", place)
    order = Window.orderBy(F.col("percentage_buiten").desc(), F.col("buiten").desc(), F.col("_place"))
    return rows.withColumn("positie", F.row_number().over(order)).withColumn("verschil_met_beste", F.col("percentage_buiten") - F.min("percentage_buiten").over(Window.partitionBy())).withColumn("zwakste", F.col("positie") == 1).drop("_place")


def norm_label(c: Column) -> Column:
    """Aggregate: the one norm of a group as text, or that it varies."""
    return F.when(F.count_distinct(c) == 1, F.max(c).cast("string")).otherwise("varieert")


def length_shares(segments: DataFrame, by: str, length: str) -> DataFrame:
    """Length, share of the total and number of segments by class."""
    rows = segments.groupBy(by).agg(F.sum(length).alias("lengte_meter"), F.count("*").alias("segmenten"))
    return rows.withColumn("aandeel", F.col("lengte_meter") / F.sum("lengte_meter").over(Window.partitionBy()))


def multimodal_summary(chosen: DataFrame, area: Sequence[str]) -> DataFrame:
    """The roll-up of best-of-modes results (null areas too) with the mode that most buildings of an area choose."""
    areas = area_summary(chosen, area, keep_null_areas=True)
    names = {a: f"_{a}" for a in area}
    top = dominant_mode(chosen, area).select(*[F.col(a).alias(n) for a, n in names.items()], "dominante_modus")
    same = F.lit(True)
    for a, n in names.items():
        same = same & F.col(a).eqNullSafe(F.col(n))
    return areas.join(top, same, "left").drop(*names.values())


def published(df: DataFrame, internal: Sequence[str] = (), prefixes: Sequence[str] = ("snap_", "_"), strip: str = "gekozen_") -> DataFrame:
    """Result columns for publication: without internal ones, and without the prefix of chosen attributes."""
    keep = [c for c in df.columns if c not in internal and not c.startswith(tuple(prefixes))]
    taken = set(keep)
    return df.select(*[F.col(c).alias(c[len(strip) :] if c.startswith(strip) and c[len(strip) :] not in taken else c) for c in keep])


def area_layer(areas: DataFrame, summary: DataFrame, keys: Sequence[str], mode: str, water: str = "is_waterbuurt") -> DataFrame:
    """Area polygons with their roll-up, whether there is one, and the mode's code; areas of water are left out."""
    rows = areas.join(summary, list(keys), "left").withColumn("heeft_analyse", F.col("panden_aantal").isNotNull()).withColumn("modaliteit_code", F.lit(classes.MODE_CODES.get(mode, "mul")))
    return rows.where(~F.coalesce(F.col(water), F.lit(False))).drop(water) if water in areas.columns else rows
