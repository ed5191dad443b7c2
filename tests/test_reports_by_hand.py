"""Reports and schedule points against rows told by hand, with nulls, repeated rows and empty tables."""

from datetime import datetime

from pyspark.sql import functions as F

from farandole.operators import disruptions, requests, timetable


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_an_impact_of_area_and_stops_is_told_once(spark):
    impacts = spark.createDataFrame([(1, "A", None), (1, None, 10), (1, None, 11), (1, None, 11), (2, None, 10), (3, None, 99), (4, None, None)], "impact_id long, area string, stop_id long")
    stops = spark.createDataFrame([(10, "A"), (10, "A"), (11, "A"), (12, "B"), (None, "B")], "stop_id long, area string")
    assert rows(disruptions.stop_area_report(impacts, stops)) == [("A", 1, True, 2), ("A", 2, False, 1)]
    assert rows(disruptions.stop_area_report(impacts.limit(0), stops)) == []


def test_only_valid_stops_of_service_are_told_of_trips(spark):
    day = lambda d: datetime(2024, 1, d)
    told = [(1, 5, "NO_SERVICE", day(1), day(3)), (2, 5, "NO_SERVICE", day(1), None), (2, 5, "NO_SERVICE", day(1), None), (3, 5, "NO_SERVICE", day(3), None),
            (4, 5, "NO_SERVICE", day(1), day(2)), (5, 6, "DETOUR", day(1), None), (6, None, "NO_SERVICE", day(1), None), (7, 7, None, day(1), None)]
    impacts = spark.createDataFrame(told, "impact_id long, trip_id long, effect string, begin timestamp, end timestamp")
    trips = spark.createDataFrame([(5, 1), (6, 1), (7, None)], "trip_id long, network_id long")
    assert rows(disruptions.trip_report(impacts, trips, F.lit(day(2)))) == [(1, 5, 2, 1)]


def test_impacts_of_a_mode_come_from_its_trips(spark):
    impacts = spark.createDataFrame([(1, 5), (1, 6), (2, 6), (3, None)], "impact_id long, trip_id long")
    times = spark.createDataFrame([(5, "bus"), (5, "bus"), (6, "metro"), (None, "bus"), (6, None)], "trip_id long, mode string")
    assert rows(disruptions.impacts_of_mode(impacts, times, "bus")) == [(1,)]


def test_empty_points_go_where_a_sibling_has_times(spark):
    points = spark.createDataFrame([(1, 1, True), (1, 2, False), (1, 3, None), (2, 5, False), (2, 4, None), (None, 6, False)], "route long, point_id long, has_times boolean")
    assert rows(timetable.without_empty_points(points, "route").select("route", "point_id")) == [(1, 1), (2, 4), (None, 6)]


def test_task_spans_count_from_the_request(spark):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    logs = spark.createDataFrame([(1, "a", at(5)), (1, "a", at(7)), (1, "b", at(6)), (1, "b", None), (2, "a", None)], "request_id long, task string, ts timestamp")
    assert rows(requests.task_spans(logs)) == [(1, "a", 0, 2_000_000), (1, "b", 1_000_000, 0), (2, "a", None, None)]


def test_on_demand_stops_of_admins_come_once(spark):
    stops = spark.createDataFrame([(1, "X"), (1, "X"), (2, "X"), (3, None)], "stop_id long, admin string")
    served = spark.createDataFrame([(7, 1), (8, 1), (8, 3), (9, 2), (None, 2)], "route_id long, stop_id long")
    routes = spark.createDataFrame([(7, True), (8, True), (9, None)], "route_id long, zonal boolean")
    assert rows(requests.on_demand_by_admin(stops, served, routes)) == [("X", 1)]
