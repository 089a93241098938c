"""Departure profiles by slices and regions against one loop over the day, and the journeys behind them."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from waymark.operators import profiles


def plain_scan(rides, walks, egress, least, key):
    """The whole day in one loop, by falling departure: {(key, node, sec): minutes}."""
    goal = {n: (m, t) for k, n, m, t in egress if k == key}
    onward = {}

    def at(node, sec):
        line = onward.get(node)
        if not line:
            return None
        low, high = 0, len(line)  # falling departure: later ones first
        while low < high:
            mid = (low + high) // 2
            if line[mid][0] >= sec:
                low = mid + 1
            else:
                high = mid
        if not low:
            return None
        dep, minutes, target = line[low - 1]
        return (dep - sec) / 60 + minutes, target

    for dep, arr, src, dst in sorted(set(rides), key=lambda r: (-r[0], -r[1], r[2], r[3])):
        options = []
        if dst in goal:
            options.append(goal[dst])
        if (same := at(dst, arr)) is not None:
            options.append(same)
        for other, walk in walks.get(dst, ()):
            ready = arr + round(walk * 60) + least
            if (there := at(other, ready)) is not None:
                options.append(((ready - arr) / 60 + there[0], there[1]))
        if not options:
            continue
        rest, target = min(options)
        minutes = (arr - dep) / 60 + rest
        line = onward.setdefault(src, [])
        if line:
            # waiting for the next event at this stop may be better than this ride
            wait = (line[-1][0] - dep) / 60 + line[-1][1]
            if wait <= minutes and line[-1][0] != dep:
                minutes, target = wait, line[-1][2]
        if line and line[-1][0] == dep:
            if minutes < line[-1][1]:
                line[-1] = (dep, minutes, target)
        else:
            line.append((dep, minutes, target))
    return {(key, node, sec): minutes for node, line in onward.items() for sec, minutes, _ in line}


def timetable(seed):
    rng = random.Random(seed)
    rides = []
    for _ in range(60):
        t, stop = rng.randrange(0, 6000), rng.randrange(12)
        for _ in range(rng.randrange(1, 6)):
            to = rng.choice([s for s in range(12) if s != stop])
            arr = t + rng.choice([30, 120, 300, 1500])
            rides.append((t, arr, stop, to))
            t, stop = arr + rng.choice([0, 20]), to
    walks = [(a, b, rng.choice([0.5, 1.25, 4.0])) for a in range(12) for b in ((a + 1) % 12, (a + 5) % 12)]
    egress = [(0, 3, 4.0, 100), (0, 3, 5.0, 90), (0, 7, 1.5, 101), (5, 9, 2.0, 102), (5, 99, 0.0, 103)]
    return rides, walks, egress


@pytest.mark.parametrize("slices, regions", [(1, 1), (4, 1), (3, 4)])
def test_profiles_equal_one_loop(spark, slices, regions):
    rides, walks, egress = timetable(slices * 7 + regions)
    want = {k: v for key in (0, 5) for k, v in plain_scan(rides, {a: [(y, m) for x, y, m in walks if x == a] for a in range(12)}, [(0, 3, 4.0, 100), *egress[2:]], 60, key).items()}
    r = spark.createDataFrame([*rides, (50, 50, 1, 2), (None, 60, 1, 2)], "dep bigint, arr bigint, src bigint, dst bigint")
    w, e = spark.createDataFrame(walks, "src bigint, dst bigint, minutes double"), spark.createDataFrame(egress, "key bigint, node bigint, minutes double, target bigint")
    of = spark.createDataFrame([(n, n % regions) for n in range(11)], "node bigint, region bigint") if regions > 1 else None
    events = profiles.departure_profiles(r, w, e, 1.0, of, slice_rides=-(-len(set(rides)) // slices))
    got = {(x.key, x.node, x.sec): x.minutes for x in events.collect()}
    assert got.keys() == want.keys() and len(got) > 50
    assert all(abs(got[k] - want[k]) < 1e-6 for k in got)
    # every start's legs lead on from each other and take the minutes of the profile
    starts = [(i, key, node, sec) for i, (key, node, sec) in enumerate((k, n, s - 45 * (n % 2)) for k, n, s in sorted(got)[::3])]
    legs = profiles.journeys(spark.createDataFrame([*starts, (10_000, 0, 3, 99_999)], "id bigint, key bigint, node bigint, sec bigint"), events).collect()
    by_start = defaultdict(list)
    for leg in sorted(legs, key=lambda x: (x.id, x.leg)):
        by_start[leg.id].append(leg)
    taken = set(rides)
    assert by_start.keys() == {s[0] for s in starts}
    for i, key, node, sec in starts:
        mine = by_start[i]
        depart = min(s for k, n, s in got if (k, n) == (key, node) and s >= sec)
        assert abs(sum(x.minutes for x in mine) - ((depart - sec) / 60 + got[key, node, depart])) < 1e-6
        assert mine[0].from_node == node and mine[0].start_sec == sec and mine[-1].kind == "lopen"
        for a, b in zip(mine, mine[1:], strict=False):
            assert a.to_node == b.from_node and abs(a.start_sec + a.minutes * 60 - b.start_sec) < 1e-6
        assert all((x.start_sec, round(x.start_sec + x.minutes * 60), x.from_node, x.to_node) in taken for x in mine if x.kind == "rit")


def test_profiles_without_targets(spark):
    rides, walks, egress = timetable(1)
    r = spark.createDataFrame(rides, "dep bigint, arr bigint, src bigint, dst bigint")
    w, e = spark.createDataFrame(walks, "src bigint, dst bigint, minutes double"), spark.createDataFrame(egress, "key bigint, node bigint, minutes double, target bigint")
    assert not profiles.departure_profiles(r, w, e.limit(0)).count()
    assert not profiles.departure_profiles(r.limit(0), w, e).count()
    assert profiles.departure_profiles(r, w.limit(0), e).count()


def test_stop_regions(spark):
    stops = spark.createDataFrame([(1, 10.0, 10.0), (2, 9_999.0, 5.0), (3, 10_001.0, 5.0)], "node bigint, x double, y double")
    got = {r.node: r.region for r in profiles.stop_regions(stops).collect()}
    assert got[1] == got[2] != got[3]


def test_needless_rides_wait_for_a_boarded_departure(spark):
    """Forty slow rides before a quick one, and one after all targets: only the quick one is scanned, and each departure waits for it in one step."""
    slow = [(10 * n, 1000 + n, 1, 2) for n in range(40)]
    rides = [*slow, (500, 600, 1, 2), (500, 590, 1, 3), (2000, 2100, 1, 3)]
    r = spark.createDataFrame(rides, "dep bigint, arr bigint, src bigint, dst bigint")
    kept = {tuple(x) for x in profiles._undominated(r).select("dep", "arr", "src", "dst").collect()}
    assert kept == {a for a in rides if not any(b[2:] == a[2:] and b[0] > a[0] and b[1] <= a[1] for b in rides)} and len(kept) == 3
    w = spark.createDataFrame([], "src bigint, dst bigint, minutes double")
    far = (1 << 60) + 1  # ids beyond what a double holds
    e = spark.createDataFrame([(0, 2, 1.0, far)], "key bigint, node bigint, minutes double, target bigint")
    got = {x.sec: x for x in profiles.departure_profiles(r, w, e, 1.0, slice_rides=1).collect()}
    assert set(got) == {10 * n for n in range(40)} | {500} and all(x.target == far for x in got.values())
    assert got[500].ride_arr == 600 and got[500].next_node is None
    assert all(x.ride_dst is None and (x.next_node, x.next_sec) == (1, 500) and abs(x.minutes - ((600 - s) / 60 + 1)) < 1e-9 for s, x in got.items() if s < 500)


def test_slices_follow_the_largest_region_and_the_quickest_rides(spark, monkeypatch):
    """Four regions of a hundred rides fill four tasks of one slice; of forty rides of one departure only the quickest is scanned."""
    day = spark.range(400).select(F.col("id").alias("dep"), (F.col("id") % 4).alias("region"))
    assert profiles._slices(day, 100) == []
    assert len(profiles._slices(day, 50)) == 1
    # many small regions: the rides of a slice stay bounded
    assert len(profiles._slices(spark.range(400).select(F.col("id").alias("dep"), F.col("id").alias("region")), 10)) == -(-400 // (10 * profiles.SLICE_REGIONS)) - 1
    seen = []
    plain = profiles._undominated
    monkeypatch.setattr(profiles, "_undominated", lambda rides: seen.append(rides.count()) or plain(rides))
    rides = spark.createDataFrame([*[(0, 1000 - 10 * n, 1, 2) for n in range(40)], (500, 900, 1, 2)], "dep bigint, arr bigint, src bigint, dst bigint")
    egress = spark.createDataFrame([(0, 2, 1.0, 9)], "key bigint, node bigint, minutes double, target bigint")
    walks = spark.createDataFrame([], "src bigint, dst bigint, minutes double")
    got = {x.sec: (x.minutes, x.ride_arr) for x in profiles.departure_profiles(rides, walks, egress, 1.0).collect()}
    assert seen == [2] and got == {0: (610 / 60 + 1, 610), 500: (400 / 60 + 1, 900)}
