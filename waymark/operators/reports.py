"""Report tables over long results: per facility and mode, by municipality and neighbourhood, with ranks and key figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import classes
from waymark.operators import rollup

#: Labels of modes in reports.
MODE_LABELS = {"lopen": "Lopen", "fiets": "Fiets", "auto": "Auto", "ov_lopen": "OV met lopen", "ov_fiets": "OV met fiets"}


def complete_runs(results: DataFrame, modes: tuple[str, ...] = classes.MODES) -> DataFrame:
    """Results of the facilities that have all modes."""
    whole = results.groupBy("facility").agg(F.count_distinct("modus").alias("_n")).where(F.col("_n") == len(modes)).select(F.col("facility").alias("_f"))
    return results.join(whole, F.col("facility") == F.col("_f"), "left_semi")


def norm_label(norm: Column) -> Column:
    """Aggregate: the norm of a group, or all of them where it varies."""
    values = F.transform(F.array_sort(F.collect_set(norm)), lambda v: F.regexp_replace(v.cast("string"), r"\.0$", ""))
    return F.when(F.size(values) == 0, "").when(F.size(values) == 1, F.get(values, F.lit(0))).otherwise(F.concat(F.lit("varieert: "), F.array_join(values, "/")))


def mode_position(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in classes.MODES]), c)


def mode_table(results: DataFrame) -> DataFrame:
    """Per facility and mode: norm, buildings inside and outside, shares, class, place from worst to best, distance to the best."""
    rows = results.groupBy("facility", "modus").agg(norm_label(F.col("norm_min")).alias("norm"), F.count("*").alias("totaal"), F.count_if("within").alias("binnen"))
    rows = rows.withColumn("buiten", F.col("totaal") - F.col("binnen")).withColumn("percentage_binnen", rollup.percent(F.col("binnen"), F.col("totaal"))).withColumn("percentage_buiten", rollup.percent(F.col("buiten"), F.col("totaal")))
    order = Window.partitionBy("facility").orderBy(F.col("percentage_buiten").desc(), F.col("buiten").desc(), mode_position(F.col("modus")))
    best = F.min("percentage_buiten").over(Window.partitionBy("facility"))
    return rows.withColumn("klasse", classes.reach_class(F.col("percentage_binnen"))).withColumn("positie", F.row_number().over(order)).withColumn("verschil_met_beste", F.col("percentage_buiten") - best)


def insufficient_counts(results: DataFrame) -> DataFrame:
    """Per facility the buildings by number of modes outside the norm, 0 to 5, with zeros."""
    each = results.groupBy("facility", "pand_id").agg(F.count_if(~F.coalesce("within", F.lit(False))).alias("buiten"))
    counts = each.groupBy("facility", "buiten").agg(F.count("*").alias("_n"))
    grid = results.select("facility").distinct().withColumn("buiten", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint"))))
    rows = grid.join(counts, ["facility", "buiten"], "left").withColumn("panden", F.coalesce("_n", F.lit(0).cast("bigint"))).drop("_n")
    return rows.withColumn("percentage", rollup.percent(F.col("panden"), F.sum("panden").over(Window.partitionBy("facility"))))


def weakest_modes(modes: DataFrame, insufficient: DataFrame) -> DataFrame:
    """Facilities ranked within each mode, the weakest mode of each and the facility to look at marked."""
    nowhere = insufficient.where("buiten = 5").select(F.col("facility").alias("_f"), F.col("panden").alias("buiten_alle"), F.col("percentage").alias("percentage_buiten_alle"))
    rows = modes.join(nowhere, F.col("facility") == F.col("_f"), "left").drop("_f")
    order = Window.partitionBy("modus").orderBy(F.col("percentage_buiten").desc(), F.col("buiten").desc(), F.col("percentage_buiten_alle").desc(), F.col("facility"))
    return rows.withColumn("zwakste_modaliteit", F.when(F.col("positie") == 1, "Ja").otherwise("Nee")).withColumn("positie_binnen_modaliteit", F.row_number().over(order)).withColumn("aandachtsvoorziening", F.when(F.col("positie_binnen_modaliteit") == 1, "Ja").otherwise("Nee"))


def key_figures(results: DataFrame) -> DataFrame:
    """One row per facility: buildings, none and only-car counts with shares, worst and best mode."""
    modes = mode_table(results).groupBy("facility").agg(
        F.max("totaal").alias("totaal"),
        F.max_by("modus", F.struct("percentage_buiten", "buiten", (-mode_position(F.col("modus"))).alias("p"))).alias("slechtste_modaliteit"),
        F.min_by("modus", F.struct("percentage_buiten", "buiten", mode_position(F.col("modus")).alias("p"))).alias("beste_modaliteit"),
    )
    flags = rollup.building_flags(results, ["facility", "pand_id"]).groupBy("facility").agg(F.count_if("geen").alias("buiten_alle"), F.count_if("alleen_auto").alias("alleen_auto"))
    rows = modes.join(flags, "facility", "left")
    return rows.withColumn("percentage_buiten_alle", rollup.percent(F.col("buiten_alle"), F.col("totaal"))).withColumn("percentage_alleen_auto", rollup.percent(F.col("alleen_auto"), F.col("totaal")))


def car_dependence(results: DataFrame, area: list[str]) -> DataFrame:
    """Per area (null areas too) the buildings that only the car serves within the norm."""
    flags = rollup.building_flags(results, ["pand_id", *area])
    rows = flags.groupBy(*area).agg(F.count("*").alias("panden"), F.count_if("alleen_auto").alias("alleen_auto"), F.count_if("autoafhankelijk").alias("autoafhankelijk"))
    return rows.withColumn("percentage_alleen_auto", rollup.percent(F.col("alleen_auto"), F.col("panden"))).withColumn("percentage_autoafhankelijk", rollup.percent(F.col("autoafhankelijk"), F.col("panden")))


def area_table(results: DataFrame, area: list[str]) -> DataFrame:
    """Areas of every facility and mode in one grouping: counts, shares outside, and whether under 80 percent."""
    rows = results.groupBy("facility", "modus", *area).agg(F.count("*").alias("panden_aantal"), F.count_if("within").alias("panden_binnen_norm"))
    rows = rows.withColumn("panden_buiten_norm", F.col("panden_aantal") - F.col("panden_binnen_norm")).withColumn("percentage_binnen", rollup.percent(F.col("panden_binnen_norm"), F.col("panden_aantal")))
    return rows.withColumn("percentage_buiten", 100.0 - F.col("percentage_binnen")).withColumn("onder_80", F.col("percentage_binnen") < classes.SIGNAL)


def municipalities_with_neighbourhoods(large: DataFrame, small: DataFrame, code: str = "gemeentecode") -> DataFrame:
    """Municipality rows with the number and share of their neighbourhoods under 80 percent."""
    stats = small.where("panden_aantal > 0").groupBy("facility", "modus", code).agg(F.count_distinct("buurtcode").alias("buurten"), F.count_if("onder_80").alias("buurten_onder_80"))
    rows = large.join(stats, ["facility", "modus", code], "left").fillna(0, ["buurten", "buurten_onder_80"])
    return rows.withColumn("percentage_buurten_onder_80", rollup.percent(F.col("buurten_onder_80"), F.col("buurten"))).withColumn("klasse", classes.reach_class(F.col("percentage_binnen")))


def case_overview(results: DataFrame, cases: str = "casus") -> DataFrame:
    """What-if cases side by side: buildings inside, share, and areas under 80 percent."""
    areas = results.groupBy(cases, "modus", "buurtcode").agg(F.count("*").alias("n"), F.count_if("within").alias("w"))
    rows = areas.groupBy(cases, "modus").agg(F.sum("n").alias("panden"), F.sum("w").alias("binnen"), F.count_if(F.col("w") * 100.0 / F.col("n") < classes.SIGNAL).alias("buurten_onder_80"))
    return rows.withColumn("percentage_binnen", rollup.percent(F.col("binnen"), F.col("panden")))
