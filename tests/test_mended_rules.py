"""Rules that lost rows once: far latitudes, open ends, caps, other scripts, cycles."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from farandole.functions import columns as C
from farandole.operators import disruptions, geo, requests, routing, text


def metres(a, b):
    p, q = (math.radians(x[1]) for x in (a, b))
    h = math.sin((p - q) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(a[0] - b[0]) / 2) ** 2
    return 2 * 6372797.560856 * math.asin(min(1, math.sqrt(h)))


@pytest.fixture(scope="module")
def places():
    rng = random.Random(3)
    at = [(rng.uniform(-180, 180), rng.choice((-89.98, -78.0, -60.0, 0.0, 47.0, 78.0, 89.95, 90.0)) + rng.uniform(-0.02, 0)) for _ in range(300)]
    at += [(x + rng.uniform(-0.08, 0.08), max(-90.0, min(90.0, y + rng.uniform(-0.05, 0.05)))) for x, y in at]
    at += [(179.999, 10.0), (-179.999, 10.0), (180.0, 10.0), (-180.0, 10.0)]
    return [((x + 180) % 360 - 180 if abs(x) != 180 else x, y) for x, y in at]


def test_radius_anywhere(spark, places):
    rows = [(i, *p) for i, p in enumerate(places)]
    points = spark.createDataFrame(rows, "id long, lon double, lat double")
    for radius in (10_000.0, 400.0, 2_000_000.0):
        some = rows[::7] + [rows[-1]] if radius > 1e6 else rows
        assert len({r[0] for r in some}) == len(some)
        asked = spark.createDataFrame(some, "query_id long, lon double, lat double")
        want = {(i, j) for i, *p in some for j, *q in rows if metres(p, q) <= radius}
        got = [(r.query_id, r.id) for r in geo.radius_join(asked, points, radius).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    for k, radius in ((3, 900_000.0), (1, 10_000.0)):
        got = {(r.query_id, r.nth): r.distance for r in geo.nearest(asked, points, radius, k).collect()}
        for i, *p in some:
            near = sorted(metres(p, q) for j, *q in rows if metres(p, q) <= radius)[:k]
            told = [got[i, n + 1] for n in range(k) if (i, n + 1) in got]
            assert told == pytest.approx(near, abs=0.1)


def test_circles_of_any_radius(spark):
    rng = random.Random(4)
    rows = [(i, rng.uniform(-3, 3), rng.uniform(47, 50), rng.choice((300.0, 5_000.0, 60_000.0, 200_000.0))) for i in range(120)]
    got = {r.id for r in geo.uncovered_circles(spark.createDataFrame(rows, "id long, lon double, lat double, radius double")).collect()}
    assert got == {i for i, x, y, r in rows if not any(metres((x, y), (u, v)) + r < s for j, u, v, s in rows if j != i)}
    assert 0 < len(got) < len(rows)


def test_zones(spark):
    objects = spark.createDataFrame([(1, 2.0, 48.0), (2, 3.0, 48.0), (3, 2.001, 48.0)], "id long, lon double, lat double")
    zones = spark.createDataFrame([(2.0, 48.0, 50.0), (3.0, 48.01, 2_000.0)], "zone_lon double, zone_lat double, radius double")
    assert {r.id for r in requests.outside_zones(objects, zones).collect()} == {3}
    assert requests.outside_zones(objects, zones.where("false")).count() == 3


def test_open_ends(spark):
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(n)
    kind = "long, key string, begin timestamp_ntz, end timestamp_ntz"
    trips = spark.createDataFrame([(1, "r", day(1), day(2)), (2, "r", day(400), day(401)), (3, "r", day(5), None), (4, "s", day(1), day(2))], f"id {kind}")
    impacts = spark.createDataFrame([(10, "r", day(3), None), (11, "r", None, day(2)), (12, "r", None, None), (13, "r", day(2), day(3))], f"impact_id {kind}")
    got = [(r.id, r.impact_id) for r in disruptions.impacted(trips, impacts, "key").collect()]
    assert sorted(got) == [(1, 11), (1, 12), (2, 10), (2, 12), (3, 10), (3, 12)]
    assert disruptions.impacted(trips.where("false"), impacts.where("false"), "key").count() == 0
    passages = spark.createDataFrame([(1, 7, day(1)), (1, 8, day(1)), (2, 7, day(9))], "trip_id long, stop_id long, ts timestamp_ntz")
    closures = spark.createDataFrame([(7, day(5), None), (8, None, day(2))], "stop_id long, begin timestamp_ntz, end timestamp_ntz")
    assert [tuple(r)[:2] for r in disruptions.without_closed_stops(passages, closures).collect()] == [(1, 7)]


def test_long_numbers_and_scripts(spark):
    codes = ["B2", "B10", "B1234567890123", "B1234567890129", "B0007", "A", "", "12", "9"]
    rows = spark.createDataFrame([(c,) for c in codes], "code string")
    got = [r.code for r in rows.orderBy(requests.natural_order(F.col("code"))).collect()]
    assert got == ["", "9", "12", "A", "B2", "B0007", "B10", "B1234567890123", "B1234567890129"]
    words = spark.range(1).select(C.words(F.lit("Stra\u00dfe \u0141\u00f3d\u017a, \u6771\u4eac \u041c\u043e\u0441\u043a\u0432\u0430 e\u0301t\u00e9"))).first()[0]
    assert words == ["strasse", "lodz", "\u6771\u4eac", "\u043c\u043e\u0441\u043a\u0432\u0430", "ete"]


def test_longest_common(spark):
    names = ["Gare du Nord", "", None, "xx", "nord gare", "GARE"]
    rows = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    for query in ("gare no", "x", ""):
        for r in text.longest_common(rows, query).collect():
            s, best = (names[r.id] or "").lower(), (0, -1)
            for i in range(len(s)):
                for j in range(i + 1, len(s) + 1):
                    if s[i:j] in query and (j - i > best[0] or j - i == best[0] and j - 1 < best[1]):
                        best = (j - i, j - 1)
            assert (r.lcs, r.position) == best


def test_paths_raise_and_are_read_back(spark):
    edges = spark.createDataFrame([(k, k + 1, 1) for k in range(1, 8)] + [(1, 4, 3), (3, 1, 1)], "a long, b long, cost long")
    origins = spark.createDataFrame([(1, 1)], "origin long, node long")
    with pytest.raises(RuntimeError):
        routing.shortest_paths(edges, origins, 100, rounds=3)
    paths = routing.shortest_paths(edges, origins, 6, compact=2)
    assert {(r.node, r.cost) for r in paths.collect()} == {(k, k - 1) for k in range(1, 8)}
    ends = spark.createDataFrame([(1, 5), (1, 99)], "origin long, node long")
    assert [r["at"] for r in routing.path_nodes(paths, ends).orderBy("nth").collect()] in ([5, 4, 3, 2, 1], [5, 4, 1])


def test_thermometer_of_a_cycle(spark):
    lists = spark.createDataFrame([(1, 1, [1, 2, 3]), (1, 2, [3, 1, 4]), (2, 3, [5]), (2, 4, [])], "route_id long, trip_id long, stops array<long>")
    got = {(r.route_id, r.place): r.stop_id for r in routing.thermometer(lists).collect()}
    assert got == {(1, 0): 1, (1, 1): 2, (1, 2): 3, (1, 3): 4, (2, 0): 5}
