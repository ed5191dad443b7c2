"""Fare graphs, predicates, realtime rules and journey filters on small tables."""

import pytest
from pyspark.sql import functions as F

from farandole.functions import columns
from farandole.operators import disruptions, fares, journeys, periods, requests, sets, text


def test_conditions():
    assert fares.parse_conditions("") == fares.parse_conditions(None) == fares.parse_conditions("True") == []
    assert fares.parse_conditions("duration<=90 & ticket=T & zone != 3") == [("duration", "<=", "90"), ("ticket", "=", "T"), ("zone", "!=", "3")]
    assert fares.parse_state("*") == {} and fares.parse_state("mode=metro&line = 1") == {"mode": "metro", "line": "1"}
    for wrong in ("duration", "a=1&", "=3"):
        with pytest.raises(ValueError):
            fares.parse_conditions(wrong)
    for wrong in ("a<1", "a=1&a=2"):
        with pytest.raises(ValueError):
            fares.parse_state(wrong)
    assert fares.holds(9, "<", "10") and not fares.holds("9", ">=", "10") and fares.holds("b", "!=", "10") and not fares.holds(None, "=", "x")
    assert fares.elapsed(100, 50) == 50 and fares.elapsed(50, 100) == 86_350


def test_fare_graph(spark, tmp_path):
    (tmp_path / "transitions.csv").write_text(
        "before;conditions;after;conditions;global;ticket\n*;true;mode=bus;;;bus\n*;;mode=metro;;;metro\nmode=metro;duration<=3600&ticket=metro;mode=metro;;;\n"
        "mode=bus;nb_changes<1;mode=bus;duration<=5400;;\n*;;mode=coach;;exclusive;coach\nmode=bus;x=1;mode=tram;y=2;symetric;bus\nbad;row\n*;;mode=x;;;unknown\n"
    )
    graph = fares.transitions(spark, str(tmp_path / "transitions.csv"), {"bus", "metro", "coach"})
    assert graph.count() == 7 and {(r.start_conditions, r.end_conditions) for r in graph.where("global_condition = 'symetric'").collect()} == {("x=1", "y=2"), ("y=2", "x=1")}
    prices = spark.createDataFrame([("bus", 100), ("metro", 190), ("coach", 900)], "ticket string, price long")
    rides = {
        "a": [(0, 600, "bus"), (700, 1300, "bus"), (1400, 2000, "bus")],  # one change, then anew
        "b": [(0, 600, "metro"), (700, 1300, "metro"), (4000, 4600, "metro")],
        "c": [(0, 600, "bus"), (700, 800, "coach"), (900, 1000, "bus")],
        "d": [(0, 600, "bus"), (700, 800, "boat")],
        "e": [(86_000, 86_300, "metro"), (100, 200, "metro")],  # past midnight
    }
    rows = [(j, n, s, e, m) for j, x in rides.items() for n, (s, e, m) in enumerate(x)]
    got = {r.journey_id: (r.cost, r.tickets, r.changes) for r in fares.graph_fares(spark.createDataFrame(rows, "journey_id string, nth int, start long, end long, mode string"), graph, prices).collect()}
    assert got == {"a": (200, 2, 1), "b": (380, 2, 1), "c": (1100, 3, 0), "d": (None, None, None), "e": (190, 1, 1)}


def test_origin_destination_file(spark, tmp_path):
    (tmp_path / "od.csv").write_text("1;stop;A;2;zone;B;t1;t9\n1;stop;A;2;zone;B;t2;t1\n3;mode;C;4;stop;D;t9\n5;stop;E\n")
    got = fares.origin_destination_fares(spark, str(tmp_path / "od.csv"), {"t1", "t2"}).collect()
    assert [(r.o_mode, r.o, r.d_mode, r.d, r.tickets) for r in got] == [("stop", "1", "zone", "2", ["t2", "t1"])]


def test_empty_sets(spark):
    rows = spark.range(1)
    assert sets.required(rows).count() == 1
    with pytest.raises(LookupError):
        sets.required(rows.where("false"))
    lines = spark.createDataFrame([(1, False, False), (2, True, False), (3, True, True)], "id long, on_demand boolean, zonal boolean")
    assert [sorted(r.id for r in sets.of_odt_level(lines, x).collect()) for x in ("scheduled", "with_stops", "zonal", "all")] == [[1], [1, 2], [3], [1, 2, 3]]


def test_realtime_rules(spark):
    stop = "array<struct<stop_id: long, added: boolean, arrival: long>>"
    updates = spark.createDataFrame([(1, 10, False, [(5, False, 100)]), (2, 99, False, [(5, False, 1)]), (3, 10, False, [(6, False, 1)]), (4, 10, False, [(5, True, 1)]), (5, 77, True, [(5, False, 1)]), (6, 10, False, [(5, False, -1)])], f"id long, trip_id long, added boolean, stops {stop}")
    trips, stops = spark.createDataFrame([(10,)], "id long"), spark.createDataFrame([(5,)], "id long")
    got = [sorted(r.id for r in disruptions.handleable(updates, trips, stops, s, t).collect()) for s, t in ((True, True), (False, True), (True, False))]
    assert got == [[1, 4, 5], [1, 5], [1, 4]]
    messages = spark.createDataFrame([(1, None, None, "m"), (2, 7, "c", "m"), (3, 8, "c", "m"), (4, 7, "x", None)], "id long, route_id long, company_id string, mode_id string")
    known = lambda *ids: spark.createDataFrame([(i,) for i in ids], f"id {'long' if isinstance(ids[0], int) else 'string'}")
    got = {tuple(r) for r in disruptions.added_trips(messages, known(7), known("c"), known("m")).collect()}
    assert got == {(1, "route:added:1", True, "default_company", "m"), (2, "7", False, "c", "m")}
    told = spark.createDataFrame([("d", "works", [("i", "NO_SERVICE", [("line", "l"), (None, "z")]), ("j", None, [("stop", "s")])])], "id string, cause string, impacts array<struct<id: string, severity: string, entities: array<struct<kind: string, id: string>>>>")
    assert {tuple(r) for r in disruptions.from_messages(told).collect()} == {("d", "works", "i", "NO_SERVICE", "line", "l"), ("d", "works", "j", "UNKNOWN_EFFECT", "stop", "s")}


def test_journey_sets(spark):
    rows = spark.createDataFrame([(1, "q", False, 50), (2, "q", False, 40), (3, "q", True, 90), (4, "q", False, 10), (5, "p", False, 1)], "journey_id long, request_id string, must_keep boolean, pseudo_duration long")
    sections = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "c"), (4, "c"), (5, "a")], "journey_id long, section string")
    assert {tuple(r) for r in journeys.culled(rows, sections, "request_id", 2).collect()} == {("q", 3), ("q", 2), ("p", 5)}
    two = journeys.merged([rows.select("journey_id"), rows.select("journey_id", "must_keep")]).collect()
    assert len({r.journey_id for r in two}) == 10
    assert {r.journey_id for r in journeys.referenced(rows, sections.where("section = 'c'"), "journey_id").collect()} == {3, 4}
    told = spark.createDataFrame([(1, 100, 10), (2, 90, 5), (3, 90, 8)], "journey_id long, arrival long, departure long")
    assert [[r.journey_id for r in journeys.in_request_order(told, c).collect()] for c in (True, False)] == [[3, 2, 1], [1, 3, 2]]
    assert [r[0] for r in told.orderBy("journey_id").select(journeys.pseudo_duration(F.lit(20), F.col("departure"), F.col("arrival"), False)).collect()] == [10, 15, 12]


def test_small_rules(spark):
    days = spark.createDataFrame([("a", d) for d in ("2024-03-29", "2024-03-30", "2024-03-31")] + [("b", "2024-07-01"), ("c", "2030-01-01")], "key string, day string").select("key", F.to_date("day").alias("day"))
    offsets = spark.createDataFrame([("2024-01-01", "2024-03-30", 60), ("2024-03-31", "2024-12-31", 120)], "b string, e string, offset int").select(F.to_date("b").alias("begin"), F.to_date("e").alias("end"), "offset")
    assert {tuple(r) for r in periods.pattern_offset(days, offsets, "key").collect()} == {("a", 60), ("b", 120), ("c", 0)}
    told = spark.createDataFrame([(1, "walking", 5.0, None), (2, "car", 2000.0, None), (3, "car", 1.0, 7.0)], "id long, mode string, length double, emission double")
    assert [r.emission for r in requests.with_missing_emission(told, 184.0).orderBy("id").collect()] == [None, 368.0, 7.0]
    boxes = spark.createDataFrame([("a", 0, True, 0, 0, 9, 9), ("b", 0, False, 0, 0, 9, 9), ("c", 5, True, 0, 0, 9, 9), ("d", 9, True, 5, 5, 9, 9)], "name string, priority int, free boolean, west int, south int, east int, north int")
    assert [r.name for r in requests.coverage(boxes, F.lit(2), F.lit(3)).collect()] == ["c", "b", "a"]
    names = spark.createDataFrame([(1, "Gare du Nord"), (2, "Nord Gare"), (3, "Garage Nord"), (4, "Rue")], "id long, name string")
    scores = spark.createDataFrame([(1, 5), (2, 5), (3, 9), (4, 99)], "id long, score int")
    got = text.exact_search(text.token_index(names), ["gar", "nord"], scores, names).collect()
    assert [(r.id, r.quality) for r in got][0] == (3, 100) and {r.id for r in got} == {1, 2, 3} and [r.lcs for r in got[1:]] == sorted((r.lcs for r in got[1:]), reverse=True)
    near = spark.range(1).select(columns.any_near_day(F.array(F.lit(3), F.lit(9)), F.lit(4)).alias("a"), columns.any_near_day(F.array(F.lit(3)), F.lit(5)).alias("b")).first()
    assert tuple(near) == (True, False)
