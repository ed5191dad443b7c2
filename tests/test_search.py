"""Journey search by days against a plain search by hand."""

import random

import pytest
from pyspark.sql import functions as F

from farandole.operators import search

TIMES = "trip_id long, rank int, stop_id long, arrival long, departure long, pick_up boolean, drop_off boolean, zone int"
DAY = 86_400


def tables(spark, times, days, walks):
    rides = search.runs(spark.createDataFrame(times, TIMES), spark.createDataFrame(days, "trip_id long, day string").withColumn("day", F.to_date("day")), "2024-01-10", 2)
    return rides, spark.createDataFrame(walks, "from_stop long, to_stop long, duration long")


def by_hand(times, days, walks, start, t0, bound, rounds):
    """Earliest arrival of each stop with at most k rides."""
    trips = {}
    for t, *x in times:
        trips.setdefault(t, []).append(x)
    dated = [[(s, a + d * DAY, p + d * DAY, up, off, z) for _, s, a, p, up, off, z in sorted(trips[t])] for t, d in days]
    best, out = {start: t0}, [{start: t0}]
    for _ in range(rounds):
        new = {}
        for run in dated:
            for i, (s, _, dep, up, _, z) in enumerate(run):
                if up and s in out[-1] and dep >= out[-1][s]:
                    for q, arr, _, _, off, y in run[i + 1 :]:
                        if off and not (z and y and z == y):
                            new[q] = min(new.get(q, arr), arr)
        for a, b, w in walks:
            if a in new:
                pass
        walked = dict(new)
        for a, b, w in walks:
            if a in new:
                walked[b] = min(walked.get(b, new[a] + w), new[a] + w)
        walked = {q: a for q, a in walked.items() if a <= bound and a < best.get(q, 1 << 60)}
        if not walked:
            break
        best |= walked
        out.append(walked)
    return {(q, k, a) for k, r in enumerate(out) for q, a in r.items()}


@pytest.fixture(scope="module")
def network():
    rng = random.Random(11)
    times, days = [], []
    for t in range(1, 60):
        at, stops = rng.randrange(20_000, 80_000), rng.sample(range(1, 15), rng.randrange(2, 6))
        for k, s in enumerate(stops):
            times.append((t, k, s, at, at + 60, rng.random() < 0.9, rng.random() < 0.9, rng.choice((0, 0, 0, 1, 2))))
            at += rng.randrange(300, 3000)
        days += [(t, d) for d in (-1, 0, 1) if rng.random() < 0.6]
    walks = [(a, b, rng.randrange(60, 600)) for a in range(1, 15) for b in rng.sample(range(1, 15), 2) if a != b]
    return times, days, walks


def test_labels(spark, network):
    times, days, walks = network
    rides, legs = tables(spark, times, [(t, f"2024-01-{10 + d:02d}") for t, d in days], walks)
    seeds = spark.createDataFrame([("x", 1, 25_000, 120_000), ("y", 5, 40_000, 90_000)], "search string, stop_id long, arrival long, bound long")
    found = search.labels(rides, seeds, legs, 6).cache()
    for key, start, t0, bound in (("x", 1, 25_000, 120_000), ("y", 5, 40_000, 90_000)):
        assert {(r.stop_id, r.round, r.arrival) for r in found.where(F.col("search") == key).collect()} == by_hand(times, days, walks, start, t0, bound, 6)
    targets = spark.createDataFrame([("x", s) for s in range(2, 15)], "search string, stop_id long")
    read = {}
    for r in search.journeys(found, targets).collect():
        read.setdefault((r.stop_id, r.round), []).append(r)
    assert set(read) == {(r.stop_id, r.round) for r in found.where("search = 'x' and round > 0 and stop_id > 1").collect()}
    walk = {(a, b): w for a, b, w in walks}
    for (stop, rounds), parts in read.items():
        parts.sort(key=lambda r: -r.leg)
        assert len(parts) == rounds and parts[0].board_stop == 1 and parts[0].board_at >= 25_000 and parts[-1].to_stop == stop
        for a, b in zip(parts, parts[1:]):
            assert a.to_stop == b.board_stop and a.alight_at + (walk[a.via_stop, a.to_stop] if a.via_stop != a.to_stop else 0) <= b.board_at
        assert parts[-1].arrival == parts[-1].alight_at + (walk[parts[-1].via_stop, stop] if parts[-1].via_stop != stop else 0)
    assert search.labels(rides, seeds.where("false"), legs, 3).count() == 0


def test_both_directions_agree(spark, network):
    """The latest departure found backwards leads to the arrival by a forward search, a second later doesn't."""
    times, days, walks = network
    rides, legs = tables(spark, times, [(t, f"2024-01-{10 + d:02d}") for t, d in days], [])
    seeds = spark.createDataFrame([("x", 1, 25_000, 120_000)], "search string, stop_id long, arrival long, bound long")
    targets = spark.createDataFrame([("x", s) for s in (4, 7, 9)], "search string, stop_id long")
    got = search.two_passes(rides, seeds, targets, legs, 5).collect()
    assert got
    for r in got:
        for later, fine in ((0, True), (1, False)):
            reach = by_hand(times, days, [], 1, r.departure + later, 120_000, r.round)
            assert any(s == r.stop_id and a <= r.arrival for s, _, a in reach) == fine


def test_zones_and_stay_in(spark):
    times = [(1, 0, 1, 100, 100, True, True, 5), (1, 1, 2, 200, 200, True, True, 5), (1, 2, 3, 300, 300, True, True, 0), (2, 0, 3, 310, 310, True, True, 0), (2, 1, 4, 400, 400, True, True, 0)]
    rides, walks = tables(spark, times, [(1, "2024-01-10"), (2, "2024-01-10")], [])
    seeds = spark.createDataFrame([("x", 1, 0, 1000)], "search string, stop_id long, arrival long, bound long")
    stay = spark.createDataFrame([("1/0", "2/0")], "run string, next_run string")
    plain = {(r.stop_id, r.round) for r in search.labels(rides, seeds, walks).collect()}
    assert plain == {(1, 0), (3, 1), (4, 2)}  # stop 2 is in the zone that was boarded in
    kept = {(r.stop_id, r.round, r.rides) for r in search.labels(rides, seeds, walks, stay_in=stay).collect()}
    assert kept == {(1, 0, 0), (3, 1, 1), (4, 1, 2)}


def test_orders_and_rules(spark):
    rows = spark.createDataFrame([(1, 100, 10, 2, 0), (2, 300, 20, 0, 500), (3, 300, 30, 0, 400)], "id long, arrival long, departure long, transfers int, walking long")
    assert [r.id for r in rows.orderBy(*search.better_on_time()).collect()] == [3, 2, 1]
    assert [r.id for r in rows.orderBy(*search.better_on_walking()).collect()] == [1, 3, 2]
    legs = spark.createDataFrame([(1, 0, 10, 20, False, True), (1, 1, 30, 40, True, False), (2, 0, 10, 20, False, True), (2, 1, 30, 40, False, False), (3, 0, 10, 200, False, False)], "journey_id long, leg int, board_at long, alight_at long, board_estimated boolean, alight_estimated boolean")
    assert {r.journey_id for r in search.valid_solutions(legs, 5, 100).collect()} == {2}
    assert [search.keep_going(*x) for x in ((0, 1, 3, None, None), (1, 1, 3, None, None), (1, 3, 3, None, None), (1, 3, None, 5, True), (1, 5, None, 5, True), (1, 3, None, None, False))] == [False, True, False, True, False, False]
