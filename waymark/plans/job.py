"""Entry point of a run: ``python -m waymark.plans.job settings.json`` reads layers, searches every mode and writes the products.

Settings are a JSON object. ``panden``, ``voorzieningen`` and ``netwerken`` (mode to path) are paths of layers, ``jaar`` the buildings' year,
``voorziening`` the facility, ``uitvoer`` the folder of the products. The rest may be left out: ``parkeren``, ``parkeergarages``,
``dienstregeling`` and ``vervoerders`` (transit), ``modi`` (a comma list), ``selectie``, ``niveau`` (column and value), ``normen`` (mode to minutes),
``regio_m`` and ``instellingen``, fields of ``RunConfig`` by name.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import access, transit
from waymark.plans import layers, run
from waymark.plans.config import Facility, RunConfig, parse_modes
from waymark.session import written
from waymark.sources import sinks

NEEDED = ("panden", "voorzieningen", "netwerken", "jaar", "voorziening", "uitvoer")
ALLOWED = (*NEEDED, "parkeren", "parkeergarages", "dienstregeling", "vervoerders", "modi", "selectie", "niveau", "normen", "regio_m", "instellingen")


def checked(settings: dict) -> dict:
    """Settings without gaps and unknown names."""
    if lacking := [k for k in NEEDED if k not in settings]:
        raise ValueError(f"settings: missing {', '.join(lacking)}")
    if unknown := sorted(set(settings) - set(ALLOWED)):
        raise ValueError(f"settings: unknown {', '.join(unknown)}")
    if "lopen" not in settings["netwerken"]:
        raise ValueError("settings: netwerken needs lopen")
    return settings


def config_of(settings: dict) -> RunConfig:
    return RunConfig(modes=parse_modes(settings.get("modi")), **{k: tuple(v) if isinstance(v, list) else v for k, v in settings.get("instellingen", {}).items()})


def inputs_of(spark: SparkSession, settings: dict, config: RunConfig) -> run.Inputs:
    """All layers that the settings name."""
    nets = {m: layers.road_network(spark, p, m, region_m=settings.get("regio_m")) for m, p in settings["netwerken"].items()}
    level = settings.get("niveau")
    stops = rides = None
    if "dienstregeling" in settings:
        stops, rides = layers.timetable(spark, settings["dienstregeling"], config.transit_date, config.window_start, config.window_end, settings.get("vervoerders", transit.OPERATORS))
    parking = layers.parking(spark, settings["parkeren"], settings.get("parkeergarages")) if "parkeren" in settings else None
    return run.Inputs(
        written(layers.buildings(spark, settings["panden"], settings["jaar"], settings.get("selectie", "woonpanden")), "panden"),
        written(layers.facilities(spark, settings["voorzieningen"], level=tuple(level) if level else None), "voorzieningen"),
        nets["lopen"], nets.get("fiets"), nets.get("auto"), parking, stops, rides,
    )


def execute(spark: SparkSession, settings: dict) -> dict[str, str]:
    """Runs and writes; gives the path of each product."""
    config = config_of(checked(settings))
    facility = Facility(settings["voorziening"], norms=settings.get("normen", {}))
    inputs = inputs_of(spark, settings, config)
    named = access.with_facility(run.all_modes(inputs, facility, config), inputs.facilities, ["naam"])
    results = written(named, "resultaten")
    present = tuple(r.modus for r in results.select("modus").distinct().collect())
    modes = tuple(m for m in config.modes if m in present)
    tables: dict[str, DataFrame] = {"resultaten": results, "panden": inputs.buildings.join(run.wide(results, facility.name, modes), "pand_id", "left")}
    tables |= run.products(results, inputs.buildings, "buurtcode", "gemeentecode", modes)
    root = f"{settings['uitvoer'].rstrip('/')}/{facility.name}"
    out = {}
    for name, df in tables.items():
        out[name] = f"{root}/{name}.parquet"
        sinks.replace(df, out[name], partition_by=("modus",) if name == "resultaten" else ())
    out["panden_kaart"] = f"{root}/panden_kaart"
    sinks.geopackage(tables["panden"].withColumn("kind", F.lit("point")), out["panden_kaart"], "panden")
    return out


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Travel times of buildings to a facility by every mode")
    parser.add_argument("settings", help="a JSON file of settings")
    parser.add_argument("--modi", help="modes instead of those in the settings")
    chosen = parser.parse_args(arguments)
    settings = json.loads(Path(chosen.settings).read_text())
    if chosen.modi:
        settings["modi"] = chosen.modi
    spark = SparkSession.builder.appName("waymark").getOrCreate()
    for name, path in execute(spark, settings).items():
        print(f"{name}\t{path}")


if __name__ == "__main__":
    main()
