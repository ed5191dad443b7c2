"""Queries of further rules on searches, amended trips, labels and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farandole.functions import columns as C
from farandole.more_queries import ORACLE_SQL, QUERIES
from farandole.operators import routing, rules, timetable
from farandole.plans.feed import Feed
from farandole.queries import _distance, _edges, _EDGES, query

__all__ = ["ORACLE_SQL", "QUERIES"]


@query("SELECT id FROM trip WHERE headsign IN ('1-URGENT', '2-HIGH') AND status <> 'P' AND route_id NOT IN (1, 2, 3)")
def search_space(f: Feed) -> DataFrame:
    return rules.valid_trips(f.trip, {"headsign": ["1-URGENT", "2-HIGH"]}, {"status": ["P"], "route_id": [1, 2, 3]}).select("id")


@query("""WITH a AS (SELECT id, route_id, list_value(id % 5, id % 7) AS days FROM trip WHERE id % 4 = 0), b AS (SELECT id AS base_id, route_id, list_value(id % 6, id % 9) AS base_days FROM trip WHERE id % 4 <> 0)
    SELECT id, min(base_id) AS base_id FROM a JOIN b USING (route_id) WHERE list_has_any(days, base_days) GROUP BY 1""")
def base_version(f: Feed) -> DataFrame:
    k = F.col("id")
    amended = f.trip.where("id % 4 = 0").select("id", "route_id", F.array(k % 5, k % 7).alias("days"))
    base = f.trip.where("id % 4 <> 0").select(k.alias("base_id"), "route_id", F.array(k % 6, k % 9).alias("base_days"))
    return rules.base_versions(amended, base, "route_id")


@query("""WITH a AS (SELECT trip_id, min(rank) AS r FROM stop_time WHERE stop_id = 5 GROUP BY 1), b AS (SELECT trip_id, max(rank) AS r FROM stop_time JOIN stop_point p ON p.id = stop_id WHERE area = 'Brand#4' GROUP BY 1)
    SELECT DISTINCT route_id FROM trip WHERE id IN (SELECT trip_id FROM a JOIN b USING (trip_id) WHERE b.r >= a.r)""")
def matching_routes(f: Feed) -> DataFrame:
    codes = f.stop_point.where("area = 'Brand#4'").select(F.col("id").alias("stop_id"))
    return rules.matching_routes(f.stop_time, f.trip, 5, codes)


@query("SELECT stop_id, min(company_id * 10 % 900 + 120 + floor(rank * 100 * sqrt(2.0e0) / 1.1e0))::BIGINT AS duration FROM stop_time GROUP BY 1")
def park_and_walk(f: Feed) -> DataFrame:
    drives = f.company.select(F.col("id").alias("park_id"), (F.col("id") * 10 % 900).alias("seconds"))
    walks = f.stop_time.select(F.col("company_id").alias("park_id"), "stop_id", (F.col("rank") * 100).alias("metres"))
    return rules.park_and_walk(drives, walks, 120, 1.1)


@query("SELECT id FROM trip WHERE start >= 80000 OR start <= 5000")
def calendar_window(f: Feed) -> DataFrame:
    return f.trip.where(rules.in_window(F.col("start"), 80_000, 5_000)).select("id")


@query("""WITH g AS (SELECT id, size % 6 AS type_group FROM stop_point), s AS (SELECT type_group, count(*) AS n FROM g GROUP BY 1), b AS (SELECT type_group, coalesce(sum(n) OVER (ORDER BY type_group ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
    SELECT id, type_group FROM g JOIN b USING (type_group) WHERE before < 90""")
def type_groups(f: Feed) -> DataFrame:
    return rules.cut_after_groups(f.stop_point.select("id", (F.col("size") % 6).alias("type_group")), 90).select("id", "type_group")



@query("""WITH u AS (SELECT id, lon, lat, greatest(0, least(1, ((lon - 2.1e0) * 0.4e0 + (lat - 48.2e0) * 0.3e0) / 0.25e0)) AS a, greatest(0, least(1, ((lon - 2.5e0) * 0.4e0 + (lat - 48.5e0) * -0.1e0) / 0.17e0)) AS b FROM stop_point),
    q AS (SELECT id, lon, lat, 2.1e0 + a * 0.4e0 AS x1, 48.2e0 + a * 0.3e0 AS y1, 2.5e0 + b * 0.4e0 AS x2, 48.5e0 + b * -0.1e0 AS y2 FROM u)
    SELECT id, round(sqrt(least(pow((lat - y1) * 0.01745329238 * 6372797.560856, 2) + pow((lon - x1) * 0.01745329238 * 6372797.560856 * cos(lat * 0.01745329238), 2), pow((lat - y2) * 0.01745329238 * 6372797.560856, 2) + pow((lon - x2) * 0.01745329238 * 6372797.560856 * cos(lat * 0.01745329238), 2))), 2) AS metres FROM q""")
def line_distance(f: Feed) -> DataFrame:
    line = [(2.1, 48.2), (2.5, 48.5), (2.9, 48.4)]
    return f.stop_point.select("id", F.round(rules.distance_to_line(F.col("lon"), F.col("lat"), line), 2).alias("metres"))


@query("""WITH e AS (SELECT trip_id, min(CASE WHEN rank % 3 <> 2 THEN departure END) AS begin, max(CASE WHEN rank % 3 <> 1 THEN arrival END) AS "end" FROM stop_time GROUP BY 1)
    SELECT trip_id, day, begin, "end" FROM e JOIN trip ON trip.id = trip_id""")
def execution_period(f: Feed) -> DataFrame:
    times = f.stop_time.withColumn("pick_up", F.col("rank") % 3 != 2).withColumn("drop_off", F.col("rank") % 3 != 1)
    return rules.execution_periods(times, f.trip.select(F.col("id").alias("trip_id"), "day"))


@query("SELECT id, day + floor((start * 2 - 50000) / 86400)::INT AS day, ((start * 2 - 50000) % 86400 + 86400) % 86400 AS first FROM trip")
def day_shift(f: Feed) -> DataFrame:
    return rules.day_shifted(f.trip.select("id", "day", (F.col("start") * 2 - 50_000).alias("first")))


@query("""WITH i AS (SELECT id AS impact_id, k % 4 AS kind, CASE WHEN k % 4 = 0 THEN id % 40 ELSE id % 1000 END AS uri FROM event WHERE kind = 'error'),
    t AS (SELECT trip.id AS trip_id, route_id, line_id, network_id FROM trip JOIN route ON route.id = route_id JOIN line ON line.id = line_id)
    SELECT impact_id, trip_id FROM i JOIN t ON uri = network_id WHERE kind = 0 UNION SELECT impact_id, trip_id FROM i JOIN t ON uri = line_id WHERE kind = 1
    UNION SELECT impact_id, trip_id FROM i JOIN t ON uri = route_id WHERE kind = 2 UNION SELECT impact_id, trip_id FROM i JOIN t ON uri = trip_id WHERE kind = 3""")
def informed_trips(f: Feed) -> DataFrame:
    k = F.col("k")
    kind = F.element_at(F.array(*map(F.lit, ("network", "line", "route", "trip"))), (k % 4 + 1).cast("int"))
    impacts = f.event.where("kind = 'error'").select(F.col("id").alias("impact_id"), kind.alias("kind"), F.when(k % 4 == 0, F.col("id") % 40).otherwise(F.col("id") % 1000).alias("uri"))
    lines = f.line.select(F.col("id").alias("line_id"), "network_id")
    trips = f.trip.select(F.col("id").alias("trip_id"), "route_id").join(f.route.select(F.col("id").alias("route_id"), "line_id"), "route_id").join(lines, "line_id")
    return rules.informed_trips(impacts, trips)


@query("""WITH u AS (SELECT trip_id, rank, CASE WHEN stop_id % 2 = 0 THEN stop_id % 600 END AS ad, CASE WHEN stop_id % 2 = 0 THEN stop_id % 500 END AS dd, stop_id % 3 = 0 AS deleted FROM stop_time WHERE stop_id % 5 = 0),
    r AS (SELECT s.trip_id, s.rank, s.stop_id, s.arrival, s.departure, ad, dd, deleted, coalesce(last_value(dd IGNORE NULLS) OVER (PARTITION BY s.trip_id ORDER BY s.rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM stop_time s LEFT JOIN u USING (trip_id, rank))
    SELECT trip_id, rank, stop_id, arrival + coalesce(ad, c) AS arrival, departure + coalesce(dd, c) AS departure FROM r WHERE NOT coalesce(deleted, false)""")
def amended_times(f: Feed) -> DataFrame:
    even = F.col("stop_id") % 2 == 0
    updates = f.stop_time.where("stop_id % 5 = 0").select("trip_id", "rank", F.when(even, F.col("stop_id") % 600).alias("arrival_delay"), F.when(even, F.col("stop_id") % 500).alias("departure_delay"), (F.col("stop_id") % 3 == 0).alias("deleted"))
    return rules.amended(f.stop_time.select("trip_id", "rank", "stop_id", "arrival", "departure"), updates)


@query("SELECT id FROM event WHERE (CASE WHEN k % 5 = 0 THEN ts <= TIMESTAMP '2024-01-20' ELSE ts < TIMESTAMP '2024-01-20' AND ts + to_hours(k) > TIMESTAMP '2024-01-10' END) AND k <> 7")
def publishable(f: Feed) -> DataFrame:
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    begin, end = F.when(F.col("k") != 7, F.col("ts")), F.when(F.col("k") % 5 != 0, F.col("ts") + F.make_dt_interval(hours=F.col("k")))
    return f.event.where(rules.publishable(begin, end, at("2024-01-10"), at("2024-01-20"))).select("id")


@query("WITH j AS (SELECT route_id, start // 7200 AS arrival, start AS departure FROM trip) SELECT route_id, max(departure) + 1 AS again_at FROM (SELECT *, min(arrival) OVER (PARTITION BY route_id) AS best FROM j) WHERE arrival = best GROUP BY 1")
def next_request(f: Feed) -> DataFrame:
    return rules.next_request(f.trip.select("route_id", F.floor(F.col("start") / 7200).alias("arrival"), F.col("start").alias("departure")), "route_id")


@query("SELECT id, greatest(start, 100000 - 86400) AS begin, greatest(0, least(start + 20000, 90000) - greatest(start, 100000 - 86400)) AS duration FROM trip")
def period_clamp(f: Feed) -> DataFrame:
    begin, duration = rules.clamped(F.col("start"), F.lit(20_000), F.lit(100_000), F.lit(90_000))
    return f.trip.select("id", begin.alias("begin"), duration.alias("duration"))


@query("SELECT r.id, CASE WHEN l.name IS NULL OR l.name = r.name THEN r.name ELSE r.name || ' (' || l.name || ')' END AS label FROM route r LEFT JOIN line l ON l.id = CASE WHEN r.id % 4 > 0 THEN r.line_id END")
def place_label(f: Feed) -> DataFrame:
    places = f.route.select("id", "name", F.when(F.col("id") % 4 > 0, F.col("line_id")).alias("admin_id"))
    return rules.with_admins(places, f.line.select(F.col("id").alias("admin_id"), F.col("name").alias("admin_name")))


@query(f"""WITH RECURSIVE {_EDGES}, g AS (SELECT 'bike:' || a AS a, 'bike:' || b AS b, cost // 3 AS cost FROM step WHERE (a + b) % 2 = 0 UNION ALL SELECT 'walking:' || a, 'walking:' || b, cost FROM step WHERE (a + b) % 2 = 1 UNION ALL SELECT 'walking:' || id, 'bike:' || id, 60 FROM stop_point WHERE id % 3 = 0 UNION ALL SELECT 'bike:' || id, 'walking:' || id, 30 FROM stop_point WHERE id % 3 = 0),
    walk(node, cost) AS (SELECT 'walking:3', 0::BIGINT UNION SELECT g.b, walk.cost + g.cost FROM walk JOIN g ON node = g.a WHERE walk.cost + g.cost <= 700) SELECT node, min(cost)::BIGINT AS cost FROM walk GROUP BY 1""")
def layered_paths(f: Feed) -> DataFrame:
    bike = (F.col("a") + F.col("b")) % 2 == 0
    edges = _edges(f).select("a", "b", F.when(bike, F.floor(F.col("cost") / 3)).otherwise(F.col("cost")).alias("cost"), F.when(bike, "bike").otherwise("walking").alias("mode"))
    at = f.stop_point.where("id % 3 = 0").select(F.col("id").alias("node"))
    change = lambda a, b, cost: at.select("node", F.lit(a).alias("from_mode"), F.lit(b).alias("to_mode"), F.lit(cost).cast("long").alias("cost"))
    graph = rules.layered(edges, ["bike", "walking"], change("walking", "bike", 60).unionByName(change("bike", "walking", 30)))
    origin = f.spark.createDataFrame([("walking:3", "walking:3")], "origin string, node string")
    return routing.shortest_paths(graph, origin, 700).select("node", "cost")


@query("SELECT id FROM route WHERE id = 4 OR line_id = 4 OR id % 25 = 4")
def admin_filter(f: Feed) -> DataFrame:
    return rules.within_admin(f.route.select("id", F.array("line_id", F.col("id") % 25).alias("admins")), 4).select("id")


@query(f"SELECT id, floor({_distance('lon', 'lat', '2.4', '48.4')} / 1.12e0)::BIGINT AS duration FROM route WHERE floor({_distance('lon', 'lat', '2.4', '48.4')} / 1.12e0) <= 15000")
def crow_fly(f: Feed) -> DataFrame:
    return rules.crow_fly(f.route, 2.4, 48.4, 1.12, 15_000)


@query("SELECT trip.id, headsign AS network, array_to_string(list_sort(list(DISTINCT mode)), ',') AS modes FROM trip JOIN (SELECT trip_id, mode FROM stop_time) s ON s.trip_id = trip.id GROUP BY 1, 2")
def trip_modes(f: Feed) -> DataFrame:
    modes = f.stop_time.groupBy("trip_id").agg(F.array_join(F.sort_array(F.collect_set("mode")), ",").alias("modes"))
    return f.trip.join(modes, F.col("id") == F.col("trip_id")).select("id", F.col("headsign").alias("network"), "modes")


@query("SELECT trip_id, rank, stop_id, nth FROM (SELECT trip_id, rank, stop_id, row_number() OVER (PARTITION BY trip_id, stop_id ORDER BY rank)::INT AS nth FROM stop_time) WHERE nth > 1")
def repeated_visits(f: Feed) -> DataFrame:
    return timetable.occurrences(f.stop_time.select("trip_id", "rank", "stop_id")).where("nth > 1")


@query("SELECT id, (start + 7200) % 86400 AS local_hour FROM trip")
def hour_in_day(f: Feed) -> DataFrame:
    return f.trip.select("id", C.hour_in_day(F.col("start") + 7200).alias("local_hour"))
