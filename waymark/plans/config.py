"""Settings of a run as plain values: facilities, their norms by mode, and the parameters of the search."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from waymark.functions.classes import MODES

#: Norms in minutes by facility and mode.
NORMS: dict[str, dict[str, int]] = {
    "supermarkt": {"auto": 10, "fiets": 10, "ov_fiets": 15, "ov_lopen": 15, "lopen": 15},
    "apotheek": {"auto": 10, "fiets": 10, "ov_fiets": 20, "ov_lopen": 20, "lopen": 15},
    "huisarts": {"auto": 10, "fiets": 10, "ov_fiets": 20, "ov_lopen": 20, "lopen": 15},
    "ziekenhuis": {"auto": 20, "fiets": 25, "ov_fiets": 30, "ov_lopen": 30, "lopen": 20},
    "recreatief_groen": {"auto": 15, "fiets": 15, "ov_fiets": 15, "ov_lopen": 15, "lopen": 15},
    "ov": {"auto": 15, "fiets": 15, "ov_fiets": 15, "ov_lopen": 15, "lopen": 15},
    "sport": {"auto": 30, "fiets": 30, "ov_fiets": 30, "ov_lopen": 30, "lopen": 30},
    "basisonderwijs": {"auto": 10, "fiets": 10, "ov_fiets": 10, "ov_lopen": 10, "lopen": 10},
    "vo": {"auto": 15, "fiets": 25, "ov_fiets": 30, "ov_lopen": 30, "lopen": 25},
    "vmbo": {"auto": 15, "fiets": 25, "ov_fiets": 30, "ov_lopen": 30, "lopen": 25},
    "mavo": {"auto": 15, "fiets": 25, "ov_fiets": 30, "ov_lopen": 30, "lopen": 25},
    "havo": {"auto": 15, "fiets": 25, "ov_fiets": 30, "ov_lopen": 30, "lopen": 25},
    "vwo": {"auto": 15, "fiets": 25, "ov_fiets": 30, "ov_lopen": 30, "lopen": 25},
    "pro": {"auto": 15, "fiets": 25, "ov_fiets": 30, "ov_lopen": 30, "lopen": 25},
    "brugjaar": {"auto": 15, "fiets": 25, "ov_fiets": 30, "ov_lopen": 30, "lopen": 25},
    "mbo": {"auto": 25, "fiets": 25, "ov_fiets": 40, "ov_lopen": 40, "lopen": 25},
    "hbo": {"auto": 35, "fiets": 25, "ov_fiets": 45, "ov_lopen": 45, "lopen": 15},
    "wo": {"auto": 35, "fiets": 25, "ov_fiets": 45, "ov_lopen": 45, "lopen": 15},
}
#: Facilities for which some municipalities have a cycling norm of their own, in minutes.
CYCLING_EXCEPTION = {"facilities": ("ov", "recreatief_groen", "sport"), "minutes": 10}


@dataclass(frozen=True)
class RunConfig:
    """Parameters of an accessibility run; their defaults are the usual ones."""

    max_snap_m: float = 250.0
    max_parking_walk_min: float = 10.0
    max_transfer_m: float = 250.0
    transit_date: str = "20260616"
    window_start: int = 0
    window_end: int = 86_399
    step_min: int = 15
    min_transfer_min: float = 3.0
    modes: tuple[str, ...] = MODES
    #: Municipalities whose cycling norm is the exceptional one, as four digits.
    cycling_exceptions: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if unknown := set(self.modes) - set(MODES):
            raise ValueError(f"unknown modes: {', '.join(sorted(unknown))}")


@dataclass(frozen=True)
class Facility:
    """A facility or level of education to run for; an own one brings its own norms."""

    name: str
    label: str = ""
    norms: dict[str, int] = field(default_factory=dict)

    def norm(self, mode: str) -> int:
        known = self.norms or NORMS.get(self.name)
        if known is None:
            raise ValueError(f"no norms for {self.name}")
        return known[mode]


def parse_modes(value: str | None) -> tuple[str, ...]:
    """Modes from a comma list; all of them for nothing or ``alle``."""
    if not value or value.strip().lower() == "alle":
        return MODES
    chosen = tuple(m.strip() for m in value.split(",") if m.strip())
    if unknown := set(chosen) - set(MODES):
        raise ValueError(f"unknown modes: {', '.join(sorted(unknown))}")
    return tuple(m for m in MODES if m in chosen)


def norms_table(spark: SparkSession) -> DataFrame:
    """All norms as rows, to join with long results."""
    return spark.createDataFrame([(f, m, v) for f, modes in NORMS.items() for m, v in modes.items()], "facility string, modus string, norm_min int")


def column_name(kind: str, facility: str, mode: str) -> str:
    """Names of the published wide columns, such as reistijd_supermarkt_auto_min."""
    pattern = {"tijd": "reistijd_{f}_{m}_min", "netwerk": "netwerktijd_{f}_{m}_min", "bereikbaar": "{f}_bereikbaar_{m}", "binnen": "{f}_binnen_norm_{m}", "norm": "norm_{f}_{m}_min", "bron": "reistijd_bron_{f}_{m}"}[kind]
    return pattern.format(f=facility, m=mode)
