"""Tables of many copies: what operators move grows with the rows, not with their pairs, and nothing large is broadcast."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from farandole import queries
from farandole.operators import geo, periods, requests, rules

from plan_rows import broadcasts, most_rows, nodes


@pytest.fixture
def crowd(spark):
    """3,000 points at ten places in reach of each other, and three far away."""
    at = lambda c: (F.col("id") % 10 / 10_000).alias(c)
    return spark.range(3000).select("id", at("lon"), at("lat")).unionByName(spark.createDataFrame([(9000 + k, 50.0 + k, 0.0) for k in range(3)], "id long, lon double, lat double"))


def test_nearest_of_one_place_meet_once(spark, crowd, monkeypatch):
    monkeypatch.setattr(geo, "stored", lambda df, name: df)
    queries = crowd.withColumnRenamed("id", "query_id")
    for k in (1, 5):
        found = geo.nearest(queries, crowd, 10_000.0, k)
        assert broadcasts(found) == []
        assert most_rows(found) <= 12 * k * queries.count()
        got = {(r.query_id, r.nth): (r.id, r.distance) for r in found.collect()}
        assert len(got) == 3000 * k + 3
        assert all(got[q, n + 1] == (q % 10 + 10 * n, 0.0) for q in range(3000) for n in range(k))
        assert all(got[9000 + j, 1] == (9000 + j, 0.0) for j in range(3))


def test_repeated_queries_share_one_ranking(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.001, 0.0), (3, 0.002, 0.0)], "id long, lon double, lat double")
    queries = spark.createDataFrame([(7, 0.0, 0.0), (7, 0.002, 0.0), (8, None, 0.0), (9, 0.001, 0.0)], "query_id long, lon double, lat double")
    got = sorted((r.query_id, r.nth, r.id) for r in geo.nearest(queries, points, 1000.0, 2).collect())
    assert got == [(7, 1, 1), (7, 2, 3), (9, 1, 2), (9, 2, 1)] or got == [(7, 1, 1), (7, 2, 3), (9, 1, 2), (9, 2, 3)]


def test_zones_meet_places(spark, crowd):
    zones = spark.createDataFrame([(0.0, 0.0, 5_000)], "zone_lon double, zone_lat double, radius int")
    objects = crowd.unionByName(spark.createDataFrame([(9999, None, 0.0)], "id long, lon double, lat double"))
    out = requests.outside_zones(objects, zones)
    assert broadcasts(out) == []
    assert most_rows(out) <= 2 * objects.count()
    assert {r.id for r in out.collect()} == {9000, 9001, 9002, 9999}


def test_pairs_of_places_are_found_once(spark, crowd, monkeypatch):
    monkeypatch.setattr(geo, "TOGETHER", 64)
    asked = crowd.where("id < 300 or id >= 9000").withColumnRenamed("id", "query_id")
    found = geo.radius_join(asked, crowd, 5_000.0)
    assert not any(name.endswith("Join") and rows > 20_000 for name, rows in nodes(found) if rows)
    got = [(r.query_id, r.id) for r in found.collect()]
    assert len(got) == len(set(got)) == 300 * 3000 + 3


def test_circles_of_one_place_meet_once(spark, crowd, monkeypatch):
    monkeypatch.setattr(geo, "stored", lambda df, name: df)
    circles = crowd.withColumn("radius", F.when(F.col("id") < 2999, 400.0 + F.col("id") % 2).otherwise(900.0))
    kept = geo.uncovered_circles(circles)
    assert most_rows(kept) <= 2 * circles.count()
    assert {r.id for r in kept.collect()} == {2999, 9000, 9001, 9002}


def test_impacts_on_one_object_are_not_compared(spark):
    trips = spark.range(1000).select(F.col("id").alias("trip_id"), F.lit(1).cast("long").alias("network_id"), (F.col("id") % 10).alias("line_id"), (F.col("id") % 100).alias("route_id"))
    told = [(1000, "network", 1), (1000, "line", 3), (1000, "trip", 7), (1000, "trip", 7), (1001, "route", 5), (None, "trip", 8), (1002, "line", None)]
    impacts = spark.range(400).select(F.col("id").alias("impact_id"), F.lit("network").alias("kind"), F.lit(1).cast("long").alias("uri")).unionByName(spark.createDataFrame(told, "impact_id long, kind string, uri long"))
    found = rules.informed_trips(impacts, trips.unionByName(trips.where("trip_id < 5")))
    assert max(rows or 0 for name, rows in nodes(found) if "Aggregate" in name) <= 20_000
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(i, t) for i in (*range(400), 1000) for t in range(1000)} | {(1001, t) for t in range(5, 1000, 100)} | {(None, 8)}


def test_pairs_of_impacts_take_little_room(spark, tmp_path):
    """Rows that follow each other repeat few ids, and one object's pairs are many tasks'."""
    trips = spark.range(403).select((F.col("id") * 7919 % 100_003).alias("trip_id"), *[F.lit(k).cast("long").alias(f"{c}_id") for k, c in enumerate(("network", "line", "route"))])
    impacts = spark.range(5003).select((F.col("id") * 104_729 % 6_000_011).alias("impact_id"), F.lit("network").alias("kind"), F.lit(0).cast("long").alias("uri"))
    found = rules.informed_trips(impacts, trips)
    found.write.parquet(str(tmp_path / "pairs"))
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 0.5 * 403 * 5003
    counts = spark.read.parquet(str(tmp_path / "pairs")).agg(F.count(F.lit(1)), F.countDistinct("impact_id"), F.countDistinct("trip_id"), F.countDistinct("impact_id", "trip_id")).collect()
    assert [tuple(r) for r in counts] == [(403 * 5003, 5003, 403, 403 * 5003)]
    assert found.groupBy(F.spark_partition_id()).count().count() > 1


@pytest.mark.parametrize(("n_trips", "n_impacts", "few"), [(900, 70, 100_000), (70, 900, 100_000), (1, 3000, 0), (3000, 1, 0)])
def test_objects_of_many_pairs_are_dealt_into_parts(spark, monkeypatch, n_trips, n_impacts, few):
    monkeypatch.setattr(rules, "PART_PAIRS", 500)
    monkeypatch.setattr(rules, "TOGETHER", 20)
    monkeypatch.setattr(rules, "REPEATED", 8)
    monkeypatch.setattr(rules, "FEW", few)
    of = lambda k: [F.lit(k + j).cast("long").alias(f"{c}_id") for j, c in enumerate(("network", "line", "route"))]
    trips = spark.range(n_trips).select(F.col("id").alias("trip_id"), *of(1)).unionByName(spark.createDataFrame([(None, 1, 8, 9), (9000, 6, 2, None), (0, 1, 2, 3)], "trip_id long, network_id long, line_id long, route_id long"))
    told = [(9000, "line", 2), (9000, "network", 1), (None, "network", 1), (9001, "trip", None), (9002, None, 1), (9003, "route", 77), (0, "network", 1)]
    impacts = spark.range(n_impacts).select(F.col("id").alias("impact_id"), F.lit("network").alias("kind"), F.lit(1).cast("long").alias("uri")).unionByName(spark.createDataFrame(told, "impact_id long, kind string, uri long"))
    found = rules.informed_trips(impacts, trips).withColumn("task", F.spark_partition_id()).collect()
    got = [(r.impact_id, r.trip_id) for r in found]
    assert len(got) == len(set(got))
    assert set(got) == {(i, t) for i in (*range(n_impacts), None, 9000) for t in (*range(n_trips), None)} | {(9000, 9000)}
    assert len({r.task for r in found if r.impact_id != 9000}) > 3


def test_impacts_or_trips_without_rows(spark):
    trips = spark.createDataFrame([(1, 1, 1, 1)], "trip_id long, network_id long, line_id long, route_id long")
    impacts = spark.createDataFrame([(1, "trip", 1)], "impact_id long, kind string, uri long")
    assert [tuple(r) for r in rules.informed_trips(impacts, trips).collect()] == [(1, 1)]
    assert rules.informed_trips(impacts.limit(0), trips).collect() == []
    assert rules.informed_trips(impacts, trips.limit(0)).collect() == []


@pytest.mark.parametrize("threshold", [0.0, 0.1, 0.4, 0.9, 1.0, 1.7])
def test_calendars_against_all_pairs(spark, threshold):
    rng = random.Random(5)
    one = lambda: {rng.randrange(40) + 200 * rng.randrange(2) for _ in range(rng.choice((1, 2, 5, 12, 30)))}
    sets = {k: one() for k in range(60)}
    for k in range(60, 120):  # near copies
        sets[k] = set(sets[k - 60]) ^ {rng.randrange(40) for _ in range(rng.randrange(3))} or {1}
    row = lambda k, d: (k % 3, k, datetime.date(2024, 1, 1) + datetime.timedelta(d))
    rows = spark.createDataFrame([row(k, d) for k, s in sets.items() for d in s], "group long, object long, day date")
    calendars = rows.where("object % 2 = 0").withColumnRenamed("object", "calendar")
    got = sorted(tuple(r) for r in periods.similar_calendars(rows.unionByName(rows.limit(5)), calendars, "group", threshold).collect())
    most = {c: math.floor(threshold * len(s) + 0.5) for c, s in sets.items()}
    assert got == sorted((o, c, len(sets[o] ^ sets[c])) for o in sets for c in sets if c % 2 == 0 and o % 3 == c % 3 and len(sets[o] ^ sets[c]) <= most[c])


def test_calendars_of_other_days_do_not_meet(spark):
    rows = spark.range(1000).select(F.lit(1).alias("group"), F.col("id").alias("object"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k"))
    day = lambda c: F.date_add(F.lit("2024-01-01").cast("date"), F.when(F.col("k") < 3, F.col("k")).otherwise(F.pmod(F.hash(c, "k"), F.lit(4000))).cast("int")).alias("day")
    rows = rows.select("group", "object", day("object"))
    found = periods.similar_calendars(rows, rows.withColumnRenamed("object", "calendar"), "group", 0.2)
    assert most_rows(found) < 200_000
    assert {(r.object, r.calendar) for r in found.collect()} == {(k, k) for k in range(1000)}


def test_pairs_are_written_out_by_many_tasks(spark):
    """Few bytes meet, but many pairs come of them."""
    at = spark.range(2000).select("id", (F.col("id") * 7 % 100 / 100 + 2).alias("lon"), (F.col("id") * 13 % 100 / 100 + 48).alias("lat"))
    found = geo.radius_join(at.withColumnRenamed("id", "query_id"), at, 5_000.0)
    rows = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(rows) >= 12 and max(rows) < sum(rows) / 4


def test_distances_are_rounded_once_for_all_pairs_of_two_places(spark):
    plan = queries.QUERIES["radius_join"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    assert min(k for k, line in enumerate(lines) if "round(" in line) > max(k for k, line in enumerate(lines) if "Generate explode(query_ids" in line)


@pytest.mark.parametrize(("n_asked", "n_held"), [(2000, 300), (300, 2000), (1, 5000), (6000, 1)])
def test_crowded_cells_are_shared_out(spark, monkeypatch, n_asked, n_held):
    monkeypatch.setattr(geo, "PART_PAIRS", 500)
    monkeypatch.setattr(geo, "TOGETHER", 64)
    place = lambda n, key: spark.range(n).select(F.col("id").alias(key), F.lit(2.0).alias("lon"), F.lit(48.0).alias("lat"))
    asked = place(n_asked, "query_id").unionByName(spark.createDataFrame([(9000, None, 48.0), (9001, 2.01, 48.0), (9002, 5.0, 48.0)], "query_id long, lon double, lat double"))
    held = place(n_held, "id").unionByName(spark.createDataFrame([(9000, None, 48.0), (9001, 2.0, None), (9002, 5.0, 48.0)], "id long, lon double, lat double"))
    found = geo.radius_join(asked, held, 5_000.0).withColumn("task", F.spark_partition_id()).collect()
    got = [(r.query_id, r.id) for r in found]
    assert len(got) == len(set(got)) == (n_asked + 1) * n_held + 1
    assert (9002, 9002) in got and {q for q, _ in got} == {*range(n_asked), 9001, 9002}
    assert len({r.task for r in found}) >= 8
