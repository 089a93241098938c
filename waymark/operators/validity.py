"""Validity of polygons: rings closed, long enough and simple, rings that don't cross each other, holes within the shell.

Segments of a polygon with many of them meet on the cells of a grid of its own, sized by its extent and its number of segments, so a long ring is not compared
pair by pair. Where they are few, all pairs are made in the row itself and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import geometry as g
from waymark.operators.spatial import _cells
from waymark.session import checkpointed

#: Faults: a coordinate that isn't a finite number, fewer than four points (repeated ones count once), ends apart, a ring that meets itself,
#: rings that cross or share a stretch, a hole with a point outside the shell.
FAULTS = ("niet_eindig", "te_kort", "open", "zelfdoorsnijding", "ringen_kruisen", "gat_buiten")
RING = "array<struct<x:double,y:double>>"
PARTS = "array<struct<ring:int,m:int,k:int,ax:double,ay:double,bx:double,by:double,lx:double,ly:double,hx:double,hy:double>>"
#: A segment: its place in the polygon, its ring and the number of its segments, its place in the ring, its ends and its box.
FIELDS = ("i", "ring", "m", "k", "ax", "ay", "bx", "by", "lx", "ly", "hx", "hy")
#: Polygons of up to so many segments are compared within their row, at most 2,016 pairs each; others by a grid.
FEW = 64


def _same(p: Column, q: Column) -> Column:
    return (p["x"] == q["x"]) & (p["y"] == q["y"])


def without_repeats(ring: Column) -> Column:
    """A ring without points equal to the one before."""
    return F.filter(ring, lambda p, k: (k == 0) | ~_same(p, F.get(ring, F.greatest(k - 1, F.lit(0)))))


def _outside(p: Column, parts: Column) -> Column:
    """Whether a point lies beyond the segments (ax, ay, bx, by) of a shell, their line not counted as beyond."""
    crosses = lambda s: ((s["ay"] > p["y"]) != (s["by"] > p["y"])) & (p["x"] < (s["bx"] - s["ax"]) * (p["y"] - s["ay"]) / F.nullif(s["by"] - s["ay"], F.lit(0.0)) + s["ax"])
    on = lambda s: (F.signum((s["bx"] - s["ax"]) * (p["y"] - s["ay"]) - (s["by"] - s["ay"]) * (p["x"] - s["ax"])) == 0) & p["x"].between(F.least(s["ax"], s["bx"]), F.greatest(s["ax"], s["bx"])) & p["y"].between(F.least(s["ay"], s["by"]), F.greatest(s["ay"], s["by"]))
    even = F.size(F.filter(parts, lambda s: F.coalesce(crosses(s), F.lit(False)))) % 2 == 0
    return even & ~F.exists(parts, on)


def _fault(pairs: DataFrame) -> DataFrame:
    """(_key, ring, fault) of pairs of segments, the one before (s..) and the one behind (t..), with what they share beyond what is allowed.

    Two segments of a ring may share the point between neighbours and no more; those of two rings may touch, but neither cross nor share a stretch.
    Columns are plain numbers and signs are worked out once: from nested points the step's code was 28,000 bytes a method, far beyond the 8,000 that the JVM compiles; now 11,000.
    """
    c = F.col
    low, high = F.least, F.greatest
    point = {"a": ("sax", "say"), "b": ("sbx", "sby"), "c": ("tax", "tay"), "d": ("tbx", "tby")}

    def by(p: str, q: str, r: str, of) -> Column:
        (px, py), (qx, qy), (rx, ry) = ([c(z) for z in point[n]] for n in (p, q, r))
        return of(qx - px, qy - py, rx - px, ry - py)

    turn = lambda p, q, r: F.signum(by(p, q, r, lambda ux, uy, vx, vy: ux * vy - uy * vx))
    ahead = lambda p, q, r: by(p, q, r, lambda ux, uy, vx, vy: ux * vx + uy * vy) > 0
    shared = lambda z: low(f"sh{z}", f"th{z}") - high(f"sl{z}", f"tl{z}")
    one_ring = c("sring") == c("tring")
    met = pairs.withColumns({"wx": shared("x"), "wy": shared("y")}).where("wx >= 0 and wy >= 0")
    met = met.withColumns({"abc": turn("a", "b", "c"), "abd": turn("a", "b", "d"), "cda": turn("c", "d", "a"), "cdb": turn("c", "d", "b")})
    met = met.withColumns({"next": one_ring & (c("tk") == c("sk") + 1), "closing": one_ring & (c("sk") == 0) & (c("tk") == c("sm") - 1) & (c("sax") == c("tbx")) & (c("say") == c("tby"))})
    back, turned = (turn("b", "a", "d") == 0) & ahead("b", "a", "d"), (c("abc") == 0) & ahead("a", "b", "c")
    meets = F.when(c("next"), back | (c("closing") & turned)).when(c("closing"), turned).otherwise((c("abc") * c("abd") <= 0) & (c("cda") * c("cdb") <= 0))
    crosses = ((c("abc") * c("abd") < 0) & (c("cda") * c("cdb") < 0)) | ((c("abc") == 0) & (c("abd") == 0) & (high("wx", "wy") > 0))
    fault = F.when(one_ring & meets, "zelfdoorsnijding").when(~one_ring & crosses, "ringen_kruisen")
    return met.select("_key", c("tring").alias("ring"), fault.alias("fault")).where("fault is not null")


def ring_faults(df: DataFrame, key: str, polygon: str = "polygon") -> DataFrame:
    """A row (key, ring, fault) for each fault of each ring (0: the shell), of the kinds in ``FAULTS``.

    Polygons that are null or without a ring have none; keys are to be unique. Of rings that cross, the later one has the fault. Rings that aren't finite have no other one.
    Whether holes lie in each other, and whether touching holes cut a polygon in two, is not tested. Signs are those of doubles, exact for coordinates of up to 26 bits.
    """
    c = F.col
    finite = lambda p: F.coalesce(~F.isnan(p["x"]) & ~F.isnan(p["y"]) & (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")), F.lit(False))
    nothing = F.array().cast(RING)
    # each step binds its value to a name, so that no expression is evaluated twice
    whole = F.transform(polygon, lambda ring, k: F.struct(k.alias("ring"), F.coalesce(ring, nothing).alias("raw")))
    whole = F.transform(whole, lambda w: F.struct(w["ring"].alias("ring"), w["raw"].alias("raw"), F.forall(w["raw"], finite).alias("finite")))
    whole = F.transform(whole, lambda w: F.struct(w["ring"].alias("ring"), w["finite"].alias("finite"), F.when(w["finite"], without_repeats(w["raw"])).otherwise(nothing).alias("r")))
    segments = lambda w: F.coalesce(F.transform(g.segments(w["r"]), lambda s, k: F.struct(w["ring"].alias("ring"), (F.size(w["r"]) - 1).alias("m"), k.alias("k"), *[s[e][z].alias(e + z) for e in "ab" for z in "xy"], *[f(s["a"][z], s["b"][z]).alias(n + z) for n, f in (("l", F.least), ("h", F.greatest)) for z in "xy"])), F.array().cast(PARTS))
    whole = F.transform(whole, lambda w: F.struct(w["ring"].alias("ring"), w["finite"].alias("finite"), w["r"].alias("r"), segments(w).alias("parts")))
    polygons = df.where(c(polygon).isNotNull()).select(c(key).alias("_key"), whole.alias("_rings")).where(F.size("_rings") > 0)
    polygons = checkpointed(polygons.withColumn("_flat", F.transform(F.flatten(F.transform("_rings", lambda w: w["parts"])), lambda s, i: F.struct(i.alias("i"), *[s[z].alias(z) for z in FIELDS[1:]]))).withColumn("_all", F.size("_flat")))

    n, closed = F.size("w.r"), _same(c("w.r")[0], F.element_at("w.r", -1))
    own = F.array_compact(F.array(F.when(~c("w.finite"), "niet_eindig"), F.when(c("w.finite") & (n < 4), "te_kort"), F.when(c("w.finite") & (n > 1) & ~closed, "open")))
    plain = polygons.select("_key", F.explode("_rings").alias("w")).select("_key", c("w.ring").alias("ring"), F.explode(own).alias("fault"))

    # few segments: every two of them within the row
    first = polygons.where(c("_all").between(2, FEW)).select("_key", "_flat", F.inline("_flat")).toDF("_key", "_flat", *[f"s{z}" for z in FIELDS])
    pairs = first.select("_key", *[f"s{z}" for z in FIELDS], F.inline(F.slice("_flat", c("si") + 2, F.lit(FEW)))).toDF("_key", *[f"{e}{z}" for e in "st" for z in FIELDS])

    # many: the grid of each polygon, as many cells as segments, over its extent
    many = polygons.where(c("_all") > FEW)
    ends = lambda n, z: F.transform("_flat", lambda s: s[n + z])
    low, high = {z: F.array_min(ends("l", z)) for z in "xy"}, {z: F.array_max(ends("h", z)) for z in "xy"}
    side = F.greatest(high["x"] - low["x"], high["y"] - low["y"]) / F.ceil(F.sqrt(c("_all")))
    each = many.select("_key", "_flat", low["x"].alias("_x0"), low["y"].alias("_y0"), side.alias("_side")).select("_key", "_x0", "_y0", "_side", F.inline("_flat"))
    box = [c(n + z) - c(f"_{z}0") for n in "lh" for z in "xy"]
    placed = each.withColumn("_cell", F.explode(_cells(*box, c("_side")))).drop("_x0", "_y0", "_side")
    one, two = (placed.select(c("_key").alias(f"{e}_key"), c("_cell").alias(f"{e}_cell"), *[c(z).alias(f"{e}{z}") for z in FIELDS]) for e in "st")
    met = one.join(two, (c("s_key") == c("t_key")) & (c("s_cell") == c("t_cell")) & (c("si") < c("ti"))).select(c("s_key").alias("_key"), *[f"{e}{z}" for e in "st" for z in FIELDS])

    crossed = _fault(pairs.unionByName(met)).distinct()

    shell = c("_rings")[0]
    holes = polygons.where((F.size("_rings") > 1) & (F.size(shell["r"]) > 1)).select("_key", shell["parts"].alias("_shell"), F.explode(F.slice("_rings", F.lit(2), F.size("_rings"))).alias("w"))
    beyond = holes.where(F.exists("w.r", lambda p: _outside(p, c("_shell")))).select("_key", c("w.ring").alias("ring"), F.lit("gat_buiten").alias("fault"))
    return plain.unionByName(crossed).unionByName(beyond).withColumnRenamed("_key", key)


def valid_only(df: DataFrame, key: str, polygon: str = "polygon", source: str = "polygons") -> DataFrame:
    """``df`` without null and empty polygons; faulty ones raise, with how many there are and the first five by key, with their faults."""
    rows = df.where(F.col(polygon).isNotNull() & (F.size(polygon) > 0) & (F.size(F.col(polygon)[0]) > 0))
    bad = checkpointed(ring_faults(rows, key, polygon).groupBy(key).agg(F.array_sort(F.collect_set("fault")).alias("faults")))
    first = bad.orderBy(key).head(5)
    if first:
        raise ValueError(f"{bad.count()} invalid {source}: " + "; ".join(f"{r[key]} ({', '.join(r['faults'])})" for r in first))
    return rows
