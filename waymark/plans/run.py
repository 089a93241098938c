"""The accessibility run: all modes of a facility in one long table, its roll-ups, diagnosis and scenarios."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.text import municipality_code
from waymark.operators import access, profiles, rollup, transit
from waymark.plans.config import CYCLING_EXCEPTION, Facility, RunConfig, column_name
from waymark.session import written


@dataclass(frozen=True)
class Inputs:
    """What a run needs; transit parts may be missing.

    buildings: pand_id, x, y and areas; facilities: target, x, y; parking: parking, x, y; stops: node, x, y; rides: dep, arr, src, dst.
    """

    buildings: DataFrame
    facilities: DataFrame
    walk: access.RoadNetwork
    cycle: access.RoadNetwork | None = None
    car: access.RoadNetwork | None = None
    parking: DataFrame | None = None
    stops: DataFrame | None = None
    rides: DataFrame | None = None


KEEP = ("pand_id", "target", "network_min", "total_min", "norm_min", "reachable", "within", "modus")


def cycling_norm(facility: Facility, config: RunConfig, area: str = "gemeentecode") -> Column:
    """The cycling norm of each building, with its municipality's exception."""
    usual = F.lit(float(facility.norm("fiets")))
    if facility.name not in CYCLING_EXCEPTION["facilities"] or not config.cycling_exceptions:
        return usual
    return F.when(municipality_code(F.col(area)).isin(*config.cycling_exceptions), float(CYCLING_EXCEPTION["minutes"])).otherwise(usual)


def all_modes(inputs: Inputs, facility: Facility, config: RunConfig = RunConfig()) -> DataFrame:
    """Results of every configured mode that the inputs allow: KEEP columns and ``reistijd_bron``, a row per building and mode."""
    out: dict[str, DataFrame] = {}
    nets = {"lopen": inputs.walk, "fiets": inputs.cycle}
    for mode, net in nets.items():
        if net is not None and (mode in config.modes or f"ov_{mode}" in config.modes):
            row_norm = cycling_norm(facility, config) if mode == "fiets" else None
            out[mode] = written(access.direct(inputs.buildings, inputs.facilities, net, mode, facility.norm(mode), row_norm, config.max_snap_m), f"access-{mode}").withColumn("reistijd_bron", F.when(F.col("reachable"), "netwerk").otherwise("geen_route"))
    if "auto" in config.modes and inputs.car is not None and inputs.parking is not None:
        out["auto"] = access.by_car(inputs.buildings, inputs.facilities, inputs.parking, inputs.car, inputs.walk, facility.norm("auto"), config.max_parking_walk_min, config.max_snap_m).withColumn("reistijd_bron", F.when(F.col("reachable"), "netwerk").otherwise("geen_route"))
    wanted = [m for m in ("ov_lopen", "ov_fiets") if m in config.modes and nets[m[3:]] is not None]
    if wanted and inputs.stops is not None and inputs.rides is not None:
        egress = access.stop_egress(inputs.stops, inputs.facilities, inputs.walk, radius=config.max_snap_m)
        walks = transit.transfers(inputs.stops, config.max_transfer_m)
        day = profiles.departure_profiles(inputs.rides, walks, egress, config.min_transfer_min, profiles.stop_regions(inputs.stops))
        by_slot = written(transit.slot_profiles(day, config.window_start, config.window_end, config.step_min), "profiles")
        for mode in wanted:
            by_stop = access.by_transit(inputs.buildings, inputs.stops, by_slot, nets[mode[3:]], mode, facility.norm(mode), config.max_snap_m)
            out[mode] = access.transit_or_direct(by_stop, out[mode[3:]], facility.norm(mode[3:]), facility.norm(mode))
    rows = None
    for mode in config.modes:
        if mode in out:
            part = out[mode].select(*KEEP, "reistijd_bron")
            rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        raise ValueError("no mode can be run on these inputs")
    return rows.withColumn("facility", F.lit(facility.name))


def products(results: DataFrame, buildings: DataFrame, small: str, large: str, modes: tuple[str, ...]) -> dict[str, DataFrame]:
    """Roll-ups by area and mode, best of modes, diagnosis, flags and ranks of one long result."""
    rows = results.join(buildings.select("pand_id", small, large), "pand_id").withColumn("minutes", F.col("total_min"))
    areas = rollup.area_summary(rows, [small, "modus"])
    best = rollup.best_of_modes(rows, ["pand_id", small, large], modes)
    return {
        "buurten": areas,
        "gemeenten": rollup.area_summary(rows, [large, "modus"]),
        "beste_modus": best,
        "dominante_modus": rollup.dominant_mode(best, [small]),
        "diagnose": rollup.diagnosis(areas, [small], modes),
        "ranglijst": rollup.ranks(areas, ["modus"], small),
        "profielen": rollup.profiles(rollup.building_flags(rows, ["pand_id"], modes=modes)),
    }


def wide(results: DataFrame, facility: str, modes: tuple[str, ...]) -> DataFrame:
    """The published form: a row per building, generated columns per mode."""
    one = results.groupBy("pand_id").agg(*[F.max(F.when(F.col("modus") == m, F.col(c))).alias(column_name(k, facility, m)) for m in modes for k, c in (("tijd", "total_min"), ("binnen", "within"), ("bereikbaar", "reachable"), ("norm", "norm_min"))])
    return one


def scenario(facilities: DataFrame, closed: Column, opened: DataFrame | None = None) -> DataFrame:
    """Another facility layer: some closed, some opened; run it like the present one and compare."""
    rest = facilities.where(~F.coalesce(closed, F.lit(False)))
    return rest if opened is None else rest.unionByName(opened, allowMissingColumns=True)


def compare(now: DataFrame, then: DataFrame) -> DataFrame:
    """Buildings and modes whose minutes or verdict change between two results."""
    b = then.select(F.col("pand_id").alias("_p"), F.col("modus").alias("_m"), F.col("total_min").alias("straks_min"), F.col("within").alias("straks_binnen"))
    both = now.join(b, (F.col("pand_id") == F.col("_p")) & (F.col("modus") == F.col("_m")), "left")
    changed = ~F.col("total_min").eqNullSafe(F.col("straks_min")) | (F.col("within") != F.col("straks_binnen"))
    return both.where(changed).select("pand_id", "modus", F.col("total_min").alias("nu_min"), "straks_min", F.col("within").alias("nu_binnen"), "straks_binnen", (F.col("straks_min") - F.col("total_min")).alias("verschil_min"))
