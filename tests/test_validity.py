"""Faults of polygons: named cases, long rings against pairs, and the check that rejects them."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from waymark.operators import validity

POLYGON = "id bigint, polygon array<array<struct<x:double,y:double>>>"
SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
CASES = {
    "square": ([SQUARE], set()),
    "repeated points": ([[(0, 0), (0, 0), (10, 0), (10, 10), (10, 10), (0, 10), (0, 0), (0, 0)]], set()),
    "triangle": ([[(0, 0), (4, 0), (0, 4), (0, 0)]], set()),
    "straight on": ([[(0, 0), (5, 0), (10, 0), (10, 10), (0, 0)]], set()),
    "open": ([[(0, 0), (10, 0), (10, 10), (0, 10)]], {(0, "open")}),
    "bow tie": ([[(0, 0), (10, 10), (10, 0), (0, 10), (0, 0)]], {(0, "zelfdoorsnijding")}),
    "touches itself": ([[(0, 0), (10, 0), (10, 10), (5, 0), (0, 10), (0, 0)]], {(0, "zelfdoorsnijding")}),
    "spike": ([[(0, 0), (10, 0), (15, 0), (10, 0), (10, 10), (0, 0)]], {(0, "zelfdoorsnijding")}),
    "spike at the start": ([[(0, 0), (10, 0), (10, 10), (-5, 0), (0, 0)][:3] + [(0, 10), (0, -5), (0, 0)]], {(0, "zelfdoorsnijding")}),
    "there and back": ([[(0, 0), (10, 0), (0, 0)]], {(0, "te_kort"), (0, "zelfdoorsnijding")}),
    "a point": ([[(1, 1), (1, 1), (1, 1), (1, 1)]], {(0, "te_kort")}),
    "not a number": ([[(0, 0), (float("nan"), 0), (1, 1), (0, 0)]], {(0, "niet_eindig")}),
    "null": ([[(0, 0), (None, 0), (1, 1), (0, 0)]], {(0, "niet_eindig")}),
    "empty ring": ([[]], {(0, "te_kort")}),
    "hole": ([SQUARE, [(2, 2), (4, 2), (2, 4), (2, 2)]], set()),
    "hole touches": ([SQUARE, [(0, 5), (4, 2), (4, 8), (0, 5)]], set()),
    "hole along the shell": ([SQUARE, [(0, 2), (4, 5), (0, 8), (0, 2)]], {(1, "ringen_kruisen")}),
    "hole crosses": ([SQUARE, [(5, 5), (15, 5), (5, 8), (5, 5)]], {(1, "ringen_kruisen"), (1, "gat_buiten")}),
    "hole outside": ([SQUARE, [(2, 2), (4, 2), (2, 4), (2, 2)], [(20, 20), (24, 20), (20, 24), (20, 20)]], {(2, "gat_buiten")}),
    "holes cross": ([SQUARE, [(2, 2), (6, 2), (2, 6), (2, 2)], [(3, 1), (3, 7), (4, 7), (3, 1)]], {(2, "ringen_kruisen")}),
    "none": (None, set()),
    "no rings": ([], set()),
}


def floats(rings):
    return None if rings is None else [[tuple(None if v is None else float(v) for v in p) for p in r] for r in rings]


def test_named_cases(spark):
    names = list(CASES)
    df = spark.createDataFrame([(k, floats(CASES[n][0])) for k, n in enumerate(names)], POLYGON)
    got = {n: set() for n in names}
    rows = validity.ring_faults(df, "id").collect()
    for r in rows:
        got[names[r.id]].add((r.ring, r.fault))
    assert got == {n: CASES[n][1] for n in names}
    assert len(rows) == len(set(rows))


def test_long_rings(spark):
    n = 20_000
    circle = [(1000 * math.cos(2 * math.pi * k / n), 1000 * math.sin(2 * math.pi * k / n)) for k in range(n)]
    fine = [*circle, circle[0]]
    # one point of the far side lies beyond the near one
    pierced = [*circle[:100], (0.0, -2000.0), *circle[100:], circle[0]]
    df = spark.createDataFrame([(1, [fine]), (2, [pierced])], POLYGON)
    assert {(r.id, r.ring, r.fault) for r in validity.ring_faults(df, "id").collect()} == {(2, 0, "zelfdoorsnijding")}


def test_invalid_ones_are_named(spark):
    good = spark.createDataFrame([(1, floats([SQUARE])), (2, None), (3, [])], POLYGON)
    assert [r.id for r in validity.valid_only(good, "id").collect()] == [1]
    bad = good.unionByName(spark.createDataFrame([(9, floats(CASES["bow tie"][0]))], POLYGON))
    with pytest.raises(ValueError, match=r"1 invalid buildings: 9 \(zelfdoorsnijding\)"):
        validity.valid_only(bad, "id", source="buildings")
    assert not validity.ring_faults(good.where(F.lit(False)), "id").collect()


def test_few_segments_are_compared_in_their_row(spark, monkeypatch):
    """Nothing is shuffled by cells where polygons are small, and both ways find the same."""
    df = spark.createDataFrame([(k, floats(rings)) for k, (rings, _) in enumerate(CASES.values())], POLYGON)
    found = {}
    for few in (64, 1):
        monkeypatch.setattr(validity, "FEW", few)
        found[few] = {(r.id, r.ring, r.fault) for r in validity.ring_faults(df, "id").collect()}
    assert found[64] == found[1]
    monkeypatch.setattr(validity, "FEW", 64)
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    zero, far = F.lit(0), F.col("id") + 1
    rows = spark.range(200).select("id", F.array(F.array(at(zero, zero), at(far, far), at(far, zero), at(zero, far), at(zero, zero))).alias("polygon"))
    checkpoints = []
    real = validity.checkpointed
    monkeypatch.setattr(validity, "checkpointed", lambda d: checkpoints.append(d.columns) or real(d))
    assert validity.ring_faults(rows, "id").count() == 200
    assert checkpoints == [["_key", "_rings", "_flat", "_all"]]
