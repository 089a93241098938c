"""Legends of all map layers as SVG, from the same tables that style the layers."""

from __future__ import annotations

from waymark.functions import classes
from waymark.plans.config import NORMS
from waymark.sources.sinks import legend

#: Shades of isochrone bands, nearest first.
BAND_SHADES = ("#1a9850", "#fee08b", "#d73027")


def minutes(value: float) -> str:
    return f"{value:g}"


def basic() -> dict[str, str]:
    """Legends of building states, area bands, bottlenecks and flows."""
    return {
        "pandstatus": legend("Pandstatus", [(k.replace("_", " "), v) for k, v in classes.STATUS_COLOURS.items()]),
        "buurten": legend("Binnen de norm", [(label, colour) for _, _, label, colour in classes.AREA_BANDS] + [(classes.NO_DATA, classes.NO_DATA_COLOUR)]),
        "knelpunten": legend("Modaliteiten onvoldoende", [(str(k), c[0]) for k, c in enumerate(classes.BOTTLENECK_COLOURS)] + [("datacontrole", classes.UNKNOWN_COLOURS[0])]),
        "stromen": legend("Pandroutes", [(name, colour) for name, _, colour, _ in classes.FLOW_STYLES]),
    }


def isochrones() -> dict[str, str]:
    """A legend for each facility and mode: its bands up to the norm."""
    out = {}
    for facility, norms in NORMS.items():
        for mode, norm in norms.items():
            limits = classes.isochrone_limits(norm)
            lows = [0.0, *limits[:-1]]
            out[f"{facility}_{mode}"] = legend(f"{facility} {mode}", [(f"{minutes(a)}-{minutes(b)} min", s) for a, b, s in zip(lows, limits, BAND_SHADES, strict=False)])
    return out
