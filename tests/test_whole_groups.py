"""Operators on what earlier cuts left out."""

import datetime

import __spark_entry__

SF = "/root/testdata/sf0.001"


def test_overtaking_at_later_stops(spark):
    """The registered query: no trip of a part overtakes another one at any stop."""
    from farandole.plans.feed import Feed

    got = {r.trip_id: r.part for r in __spark_entry__.queries()["overtake_split"](spark, SF).collect()}
    feed, times = Feed(spark, SF), {}
    for r in feed.stop_time.select("trip_id", "rank", "arrival", "departure").collect():
        stay = r["rank"] * (r.trip_id % 5 * 211)
        times.setdefault(r.trip_id, []).append((r["rank"], r.arrival + stay, r.departure + stay))
    times = {t: [y for x in sorted(v) for y in x[1:]] for t, v in times.items()}
    route = {r.id: r.route_id for r in feed.trip.select("id", "route_id").collect()}
    parts = {}
    for t in got:
        parts.setdefault((route[t], len(times[t]), got[t]), []).append(t)
    assert set(got) == {t for t in times if t in route} and max(map(len, times.values())) > 4
    for trips in parts.values():
        for a in trips:
            for b in trips:
                if a < b:
                    assert len({x < y for x, y in zip(times[a], times[b], strict=True)}) == 1 and all(x != y for x, y in zip(times[a], times[b], strict=True))


def test_calendars_years_apart(spark):
    from farandole.operators import periods

    day = lambda n: datetime.date(1992, 1, 1) + datetime.timedelta(n)
    sets = {1: range(0, 400), 2: range(0, 390), 3: [*range(0, 100), *range(2000, 2300)], 6: range(5000, 5010), 7: range(5000, 5006), 4: range(3000, 3010), 5: range(3000, 3011)}
    rows = spark.createDataFrame([("g", k, day(n)) for k, x in sets.items() for n in x], "group string, object long, day date")
    got = {tuple(r) for r in periods.similar_calendars(rows, rows.withColumnRenamed("object", "calendar"), "group", 0.5).collect()}
    want = {(a, b, len(set(x) ^ set(y))) for a, x in sets.items() for b, y in sets.items() if len(set(x) ^ set(y)) <= round(len(y) * 0.5)}
    assert got == want and (4, 5, 1) in want and {(a, b) for a, b, _ in want} != {(b, a) for a, b, _ in want}
