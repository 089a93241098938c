"""Classes, bands, labels and styles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Modes in their order, with their codes.
MODES = ("lopen", "fiets", "auto", "ov_lopen", "ov_fiets")
MODE_CODES = {"lopen": "lop", "fiets": "fie", "auto": "aut", "ov_lopen": "ovl", "ov_fiets": "ovf"}
#: Percentage bands [from, to) of an area, the last one closed, with their colours.
AREA_BANDS = ((0, 20, "0-20%", "#d73027"), (20, 40, "20-40%", "#fc8d59"), (40, 60, "40-60%", "#fee08b"), (60, 80, "60-80%", "#d9ef8b"), (80, 100, "80-100%", "#1a9850"))
NO_DATA, NO_DATA_COLOUR = "geen data", "#bdbdbd"
#: Flow classes by the largest number of buildings in them.
FLOW_LIMITS = (1, 40, 100, 250, 500)
#: Limits in percent for a signal and for a severe shortage.
SIGNAL, SEVERE = 80, 60


def area_band(percent: Column) -> Column:
    """struct(klasse, kleur) of a percentage."""
    name, colour = F.lit(NO_DATA), F.lit(NO_DATA_COLOUR)
    for low, high, label, shade in AREA_BANDS:
        inside = (percent >= low) & ((percent <= high) if high == 100 else (percent < high))
        name, colour = F.when(inside, label).otherwise(name), F.when(inside, shade).otherwise(colour)
    return F.struct(name.alias("klasse"), colour.alias("kleur"))


def reach_class(percent: Column) -> Column:
    """Class of the share within the norm."""
    return F.when(percent.isNull(), "Onvoldoende gegevens").when(percent >= 80, "Goed").when(percent >= 60, "Vereist aandacht").when(percent >= 40, "Knelpunt").otherwise("Ernstig knelpunt")


def norm_status(minutes: Column, within: Column) -> Column:
    """Whether a building is inside or outside the norm, or has no route."""
    return F.when(minutes.isNull(), "geen_betrouwbare_route").when(F.coalesce(within, F.lit(False)), "binnen_norm").otherwise("buiten_norm")


def flow_class(count: Column) -> Column:
    """1 to 6 by the number of buildings on a segment."""
    out = F.lit(len(FLOW_LIMITS) + 1)
    for k, limit in reversed(list(enumerate(FLOW_LIMITS, 1))):
        out = F.when(count <= limit, k).otherwise(out)
    return out


def severity(best: Column, worst: Column, insufficient: Column) -> Column:
    """How severe a shortage is, from the best and worst mode's percentage and the number of modes below the signal."""
    return F.when(best.isNull(), "geen data").when(insufficient == 0, "voldoende").when(best < SEVERE, "ernstig tekort").when(worst >= SEVERE, "licht tekort").when(insufficient <= 2, "matig tekort").otherwise("ernstig tekort")


def problem_type(walk: Column, cycle: Column, car: Column, transit_walk: Column, transit_cycle: Column, insufficient: Column) -> Column:
    """What kind of shortage it is; missing modes don't count, the better one of a pair does."""
    active, transit = F.greatest(walk, cycle), F.greatest(transit_walk, transit_cycle)
    all_missing = F.coalesce(active, transit, car).isNull()
    is_ = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(all_missing, "geen data")
        .when(insufficient == 0, "voldoende")
        .when(is_((active < SEVERE) & (transit < SEVERE) & (car < SEVERE)), "multimodaal_tekort")
        .when(is_((active < SIGNAL) & (car >= SIGNAL)), "nabijheid_actieve_mobiliteit_tekort")
        .when(is_((transit < SIGNAL) & (active >= SIGNAL)), "ov_tekort")
        .when(is_((car < SIGNAL) & (active >= SIGNAL)), "auto_tekort")
        .otherwise("gemengd_tekort")
    )


def best_mode(times: dict[str, Column], valid: dict[str, Column] | None = None) -> Column:
    """The mode with the least time among the valid ones, the earlier one where times tie; null if none is."""
    entries = [F.when(F.coalesce((valid or {}).get(m, F.lit(True)), F.lit(False)) & t.isNotNull(), F.struct(t.alias("t"), F.lit(k).alias("k"), F.lit(m).alias("m"))) for k, (m, t) in enumerate(times.items())]
    return F.array_min(F.filter(F.array(*entries), lambda e: e.isNotNull()))["m"]


def isochrone_limits(norm: float) -> list[float]:
    """Upper limits of the bands of a norm: whole fives up to 15 minutes, whole tens up to 30, else thirds."""
    for most, step in ((15, 5), (30, 10)):
        if norm <= most and norm % step == 0:
            return [float(step * k) for k in range(1, int(norm) // step + 1)]
    return [round(norm / 3, 1), round(norm * 2 / 3, 1), float(norm)]


def band_of(minutes: Column, limits: list[float]) -> Column:
    """The number (from 1) of the first limit that isn't below the minutes; null beyond the last."""
    out = F.lit(None).cast("int")
    for k, limit in reversed(list(enumerate(limits, 1))):
        out = F.when(minutes <= limit, k).otherwise(out)
    return out


#: Names, widths, colours and opacities of the flow classes.
FLOW_STYLES = (("1 pandroute", 0.35, "#9e9e9e", 0.22), ("2-40 pandroutes", 1.1, "#00c853", 0.60), ("41-100 pandroutes", 2.2, "#8eea32", 0.78), ("101-250 pandroutes", 3.6, "#ffd400", 0.90), ("251-500 pandroutes", 5.0, "#ff7a1a", 0.97), (">500 pandroutes", 6.5, "#ff1a1a", 1.0))
#: Colours of building states, and fill and edge by the number of modes below the signal.
STATUS_COLOURS = {"binnen_norm": "#2ca25f", "buiten_norm": "#de2d26", "geen_betrouwbare_route": "#9e9e9e"}
BOTTLENECK_COLOURS = (("#2ca25f", "#176c3c"), ("#ffd84d", "#9b7b1c"), ("#fdae61", "#a85f1d"), ("#f46d43", "#9f3d25"), ("#d73027", "#7f1d1d"), ("#7f0000", "#4d0000"))
UNKNOWN_COLOURS = ("#79706e", "#4f4a48")


def _pick(key: Column, values, default) -> Column:
    out = F.lit(default)
    for k, v in values:
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def flow_style(count: Column) -> Column:
    """struct(klasse, lijndikte, kleur, opacity) of a segment."""
    k = flow_class(count)
    return F.struct(*[_pick(k, enumerate((s[i] for s in FLOW_STYLES), 1), FLOW_STYLES[-1][i]).alias(n) for i, n in enumerate(("klasse", "lijndikte", "kleur", "opacity"))])


def status_colour(status: Column) -> Column:
    return _pick(status, STATUS_COLOURS.items(), STATUS_COLOURS["geen_betrouwbare_route"])


def bottleneck(insufficient: Column) -> Column:
    """struct(categorie, label, fill, stroke) of the number of modes below the signal; null asks for a data check."""
    category = F.when(insufficient.isNull(), "datacontrole_uitvoeren").when(insufficient == 1, "1_modaliteit_onvoldoende").otherwise(F.concat(insufficient.cast("string"), F.lit("_modaliteiten_onvoldoende")))
    label = F.when(insufficient.isNull(), "Geen woningen").when(insufficient == 0, "Alle modaliteiten voldoen").when(insufficient == 1, "1 modaliteit onvoldoende").when(insufficient == 5, "Geen modaliteit voldoet").otherwise(F.concat(insufficient.cast("string"), F.lit(" modaliteiten onvoldoende")))
    fill, edge = (_pick(insufficient, enumerate(c[i] for c in BOTTLENECK_COLOURS), UNKNOWN_COLOURS[i]) for i in (0, 1))
    return F.struct(category.alias("categorie"), label.alias("label"), fill.alias("fill"), edge.alias("stroke"))
