"""Operators that SQL can't express against brute force, and edge cases of the others."""

import itertools

from pyspark.sql import functions as F

from farandole.functions import columns as C
from farandole.operators import fares, routing, timetable
from farandole.sources import feeds


def test_ranked_pairs(spark):
    rows = [(1, 0, 1, 10), (1, 1, 2, 20), (1, 2, 3, 30), (2, 0, 1, 11), (2, 1, 2, 19), (2, 2, 3, 29), (3, 0, 1, 9), (3, 1, 2, 21), (4, 0, 9, 5)]
    times = spark.createDataFrame(rows, "trip_id long, rank int, stop_id long, arrival long")
    trips = spark.createDataFrame([(1, 7, 10), (2, 7, 11), (3, 7, 9), (4, 8, 5)], "id long, route_id long, start long")
    votes = routing.pairwise_votes(times, trips, ["route_id"])
    assert {tuple(r) for r in votes.collect()} == {(7, 2, 1, 1)}
    got = {(r.route_id, r.place): r.trip_id for r in routing.ranked_pairs(votes, trips, ["route_id"], "route_id long").collect()}
    assert got == {(7, 0): 3, (7, 1): 2, (7, 2): 1, (8, 0): 4}


def test_thermometer_keeps_every_order(spark):
    lists = [(1, 1, [1, 2, 4, 6]), (2, 1, [1, 3, 4, 5, 6]), (3, 2, [9, 8, 9])]
    got = routing.thermometer(spark.createDataFrame(lists, "trip_id long, route_id long, stops array<long>")).collect()
    line = [r.stop_id for r in sorted(got, key=lambda r: r.place) if r.route_id == 1]
    for _, _, stops in lists[:2]:
        assert [s for s in line if s in stops] == stops
    assert sorted(r.stop_id for r in got if r.route_id == 2) == [8, 9]


def best_fare_by_hand(rides):
    best = None
    for buys in itertools.product((True, False), repeat=len(rides)):
        cost, tickets, changes, held = 0, 0, 0, None
        for buy, (at, kind) in zip(buys, rides, strict=True):
            if kind == "signup":
                cost, tickets, held = cost + 900, tickets + 1, None
            elif buy:
                cost, tickets, held = cost + 170, tickets + 1, (at, 0)
            elif held and at - held[0] <= 5400 and held[1] < 2:
                held, changes = (held[0], held[1] + 1), changes + 1
            else:
                break
        else:
            best = min(best or (cost, tickets, changes), (cost, tickets, changes))
    return best


def test_best_fares(spark):
    journeys = {"a": [(0, "view"), (3000, "view"), (5400, "click"), (5500, "view"), (9000, "view")], "b": [(0, "signup"), (10, "view"), (20, "signup"), (30, "view"), (40, "view")], "c": [(0, "view")]}
    rows = [(j, n, at, kind) for j, rides in journeys.items() for n, (at, kind) in enumerate(rides)]
    got = {r.journey_id: (r.cost, r.tickets, r.changes) for r in fares.best_fares(spark.createDataFrame(rows, "journey_id string, nth int, at long, kind string")).collect()}
    assert got == {j: best_fare_by_hand(rides) for j, rides in journeys.items()}


def test_rounds_with_connections(spark):
    times = spark.createDataFrame([(1, 0, 1, 90, 100), (1, 1, 2, 200, 210), (2, 0, 3, 250, 260), (2, 1, 4, 300, 310), (3, 0, 2, 190, 205), (3, 1, 4, 400, 400)], "trip_id long, rank int, stop_id long, arrival long, departure long")
    seeds = spark.createDataFrame([(1, 80)], "stop_id long, arrival long")
    walks = spark.createDataFrame([(2, 3, 40)], "from_stop long, to_stop long, duration long")
    got = {(r.stop_id, r.round): r.arrival for r in routing.earliest_arrivals(times, seeds, walks, 5, 1000).collect()}
    assert got == {(1, 0): 80, (2, 1): 200, (3, 1): 240, (4, 2): 300}


def test_columns(spark):
    row = spark.range(1).select(
        C.time_to_int(F.lit("25:01:02")).alias("a"), C.time_to_int(F.lit("7:00")).alias("b"), C.time_to_int(F.lit("x:00:00")).alias("c"), C.words(F.lit("Gare de l'Évêché  GARE")).alias("d"), C.bigrams(F.lit("abc")).alias("e"), C.bigrams(F.lit("a")).alias("f"),
        C.postal_range(F.array(F.lit("75001"), F.lit("75020"))).alias("g"), C.postal_range(F.array(F.lit("75001"))).alias("h"), C.postal_range(F.array(F.lit("b"), F.lit("a1"))).alias("i"), C.open_at(F.lit(100), F.lit(80_000), F.lit(200)).alias("j"), C.shifted(F.lit(90_000), F.lit(100)).alias("k"), C.shifted(F.lit(90_000), F.lit(100), False).alias("l"),
    ).first()
    assert tuple(row) == (90_062, -1, None, ["gare", "de", "l", "eveche"], ["ab", "bc"], ["a"], "75001-75020", "75001", "a1;b", True, 172_900, 86_500)


def test_feed(spark, tmp_path):
    files = {
        "stops": "stop_id,stop_name,stop_lat,stop_lon,location_type,parent_station\na,A,48.0,2.0,,z\na,A again,1,1,,\nb,B,48.001,2.0,0,\nz,Z,48,2,1,\nbad,X,999,2,0,\n",
        "routes": "route_id,route_short_name,route_type\nr,R,3\n",
        "trips": "route_id,service_id,trip_id\nr,s,t\n",
        "stop_times": "trip_id,arrival_time,departure_time,stop_id,stop_sequence,pickup_type,drop_off_type\nt,08:00:00,08:01:00,a,1,0,1\nt,24:10:00,24:11:00,b,2,2,0\nt,25:00:00,25:00:00,b,3,3,3\n",
        "calendar": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\ns,1,0,0,0,0,0,1,20240101,20240110\n",
        "calendar_dates": "service_id,date,exception_type\ns,20240103,1\ns,20240108,2\n",
        "transfers": "from_stop_id,to_stop_id,transfer_type,min_transfer_time\nz,b,2,90\nb,a,2,\nb,b,2,soon\na,a,2,90000\n",
        "frequencies": "trip_id,start_time,end_time,headway_secs\nt,06:00:00,07:00:00,600\n",
        "shapes": "shape_id,shape_pt_lat,shape_pt_lon,shape_pt_sequence\nq,2,1,2\nq,4,3,1\n",
    }
    for name, content in files.items():
        (tmp_path / f"{name}.txt").write_text(content)
    feed = feeds.read_feed(spark, str(tmp_path))
    stops = feeds.stop_points(feed["stops"])
    assert {(r.stop_id, r.area_id) for r in stops.collect()} == {("a", "z"), ("b", "area:b")}
    assert {r.stop_id for r in feeds.stop_points(feed["stops"], keep_orphans=False).collect()} == {"a"}
    days = feeds.service_days(feed["calendar"], feed["calendar_dates"])
    assert sorted(str(r.day) for r in days.collect()) == ["2024-01-01", "2024-01-03", "2024-01-07"]
    assert [str(x) for x in feeds.production_period(days, feed["trips"]).first()] == ["2024-01-01", "2024-01-08"]
    times = feeds.stop_times(feed["stop_times"], 3600)
    assert [(r.sequence, r.arrival, r.pick_up, r.drop_off, r.on_demand) for r in times.orderBy("sequence").collect()] == [(1, 25_200, True, False, False), (2, 83_400, True, True, True)]
    assert {tuple(r) for r in feeds.transfers(feed["transfers"], stops).collect()} == {("a", "b", 90, 90), ("b", "b", 120, 240)}
    assert [(r.sequence, r.departure) for r in feeds.frequencies(feed["frequencies"], times).orderBy("sequence").collect()] == [(1, 21_600), (2, 21_600 + 58_200)]
    assert [tuple(p) for p in feeds.shapes(feed["shapes"]).first().points] == [(3.0, 4.0), (1.0, 2.0)]
    assert {(r.from_stop, r.to_stop, r.display_duration) for r in feeds.default_transfers(stops).collect()} == {("a", "a", 0), ("b", "b", 0)}
    feeds.write_snapshot({"stops": stops, "days": days}, str(tmp_path / "snap"), 15)
    assert feeds.read_snapshot(spark, str(tmp_path / "snap"), 15)["days"].count() == 3
    for wrong in (lambda: feeds.read_snapshot(spark, str(tmp_path / "snap"), 14), lambda: feeds.read_feed(spark, str(tmp_path / "none"))):
        try:
            wrong()
            raise AssertionError("no error")
        except ValueError:
            pass


def test_frequencies_wrap_midnight(spark):
    rows = spark.createDataFrame([(1, 86_000, 500, 400)], "id long, start int, end int, headway int")
    assert sorted(r.at for r in timetable.expanded_frequencies(rows, "id").collect()) == [0, 400, 86_000]


def test_split_overtaking(spark):
    from farandole.operators import details

    times = {1: [(0, 0), (100, 100)], 2: [(10, 10), (90, 95)], 3: [(20, 20), (120, 120)], 4: [(30, 30), (110, 110)], 5: [(20, 20), (130, 130)]}
    rows = [(t, k, a, d) for t, xs in times.items() for k, (a, d) in enumerate(xs)]
    stop_times = spark.createDataFrame(rows, "trip_id long, rank int, arrival long, departure long")
    patterns = spark.createDataFrame([(t, "p") for t in times], "trip_id long, pattern string")
    got = {r.trip_id: r.part for r in details.split_overtaking(stop_times, patterns).collect()}
    # 2 overtakes 1; 5 leaves together with 3, but follows 2; 4 overtakes 3 and 5.
    assert got == {1: 0, 2: 1, 3: 0, 5: 1, 4: 2}
    for a in times:
        for b in times:
            if a != b and got[a] == got[b]:
                x, y = sum(times[a], ()), sum(times[b], ())
                assert all(p < q for p, q in zip(x, y, strict=True)) or all(p > q for p, q in zip(x, y, strict=True))
