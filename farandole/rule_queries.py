"""Queries of predicates, realtime rules, reports, journey filters and searches by days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farandole.functions import columns as C
from farandole.further_queries import ORACLE_SQL, QUERIES
from farandole.operators import disruptions, journeys, requests, search, sets, timetable
from farandole.plans.feed import Feed
from farandole.queries import _distance, query
from farandole.scratch import stored

__all__ = ["ORACLE_SQL", "QUERIES"]


@query("SELECT id FROM trip WHERE headsign = '1-URGENT' UNION SELECT trip_id FROM stop_time WHERE headsign = '1-URGENT'")
def ptref_headsign(f: Feed) -> DataFrame:
    return sets.with_headsign(f.trip, f.stop_time, "1-URGENT")


@query("SELECT DISTINCT trip_id AS id FROM stop_time WHERE headsign = 'R'")
def ptref_stop_headsign(f: Feed) -> DataFrame:
    return sets.with_headsign(f.trip, f.stop_time, "R")


@query("SELECT id FROM trip WHERE id IN (SELECT entity_id FROM event WHERE kind = 'error')")
def ptref_disrupted(f: Feed) -> DataFrame:
    informed = f.event.select(F.col("entity_id").alias("trip_id"), F.when(F.col("kind") == "error", "NO_SERVICE").otherwise("DETOUR").alias("effect"))
    return sets.with_disruption(f.trip, informed)


@query("SELECT id FROM route WHERE id % 2 <> 0 AND id % 3 <> 0")
def ptref_odt_level(f: Feed) -> DataFrame:
    return sets.of_odt_level(f.route.select("id", (F.col("id") % 2 == 0).alias("on_demand"), (F.col("id") % 3 == 0).alias("zonal")), "scheduled")


@query("""WITH i AS (SELECT entity_id % 25 AS line_id, min(k) AS priority FROM event WHERE kind = 'error' GROUP BY 1)
    SELECT id, network_id, row_number() OVER (PARTITION BY network_id ORDER BY priority NULLS LAST, name, id) - 1 AS place FROM line LEFT JOIN i ON line_id = id""")
def traffic_report_order(f: Feed) -> DataFrame:
    impacts = f.event.where("kind = 'error'").select((F.col("entity_id") % 25).alias("line_id"), F.col("k").alias("priority"))
    lines = f.line.select(F.col("id").alias("line_id"), F.col("network_id").alias("network_idx"), F.col("name").alias("code"), "name")
    return disruptions.report_order(lines, impacts).select(F.col("line_id").alias("id"), F.col("network_idx").alias("network_id"), F.col("place").cast("long").alias("place"))


@query("SELECT id, row_number() OVER (PARTITION BY entity_id ORDER BY ts, id)::INT AS nth FROM event")
def impacts_in_order(f: Feed) -> DataFrame:
    rows = f.event.select("id", "entity_id", F.col("ts").alias("updated_at"), F.col("id").alias("uri"))
    return disruptions.in_order_of_change(rows, "entity_id").select("id", "nth")


@query("SELECT trip_id, rank, stop_id FROM stop_time WHERE NOT (rank BETWEEN 1 AND 4 AND NOT (rank IN (1, 4) AND stop_id % 3 <> 0))")
def reduced_rail_section(f: Feed) -> DataFrame:
    rows = f.stop_time.select("trip_id", "rank", "stop_id")
    blocked = rows.groupBy("trip_id").agg(F.collect_set(F.when(F.col("stop_id") % 3 == 0, F.col("stop_id"))).alias("blocked"))
    return disruptions.reduced_section(rows, blocked.select("trip_id", F.lit(1).alias("from_rank"), F.lit(4).alias("to_rank"), "blocked"))


@query("""SELECT DISTINCT trip_id FROM stop_time WHERE stop_id % 10 = 0 AND stop_id % 4 > 0""")
def relevant_delays(f: Feed) -> DataFrame:
    updates = f.stop_time.where("stop_id % 10 = 0").select("trip_id", "rank", (F.col("arrival") + F.col("stop_id") % 4).alias("arrival"), "departure")
    return disruptions.relevant_delays(updates, f.stop_time)


@query("""WITH t AS (SELECT id, id % 97 = 0 AS flagged FROM trip), l AS (SELECT trip_id, min(arrival) - 5000 AS least FROM stop_time GROUP BY 1)
    SELECT id FROM t LEFT JOIN l ON trip_id = id WHERE flagged OR least IS NULL OR least < 0 OR id NOT IN (SELECT id FROM trip WHERE status <> 'P')""")
def erasable_trips(f: Feed) -> DataFrame:
    times = f.stop_time.select("trip_id", (F.col("arrival") - 5000).alias("arrival"), "departure")
    return disruptions.erasable_trips(f.trip.select("id", (F.col("id") % 97 == 0).alias("to_delete")), times, f.trip.where("status <> 'P'").select(F.col("id").alias("trip_id")))


@query("""WITH j AS (SELECT id, route_id, id % 3 = 0 AS direct, ['walking', 'bike', 'car'][(id % 7 % 3 + 1)::INT] AS mode, start AS duration FROM trip),
    p AS (SELECT * FROM j WHERE NOT direct OR route_id IN (SELECT route_id FROM j WHERE NOT direct))
    SELECT id FROM p WHERE NOT direct OR (mode IN ('walking', 'bike') AND duration <= CASE mode WHEN 'walking' THEN 40000 ELSE 60000 END)""")
def direct_paths(f: Feed) -> DataFrame:
    mode = F.element_at(F.array(*map(F.lit, ("walking", "bike", "car"))), (F.col("id") % 7 % 3 + 1).cast("int"))
    rows = f.trip.select("id", F.col("route_id").alias("request_id"), (F.col("id") % 3 == 0).alias("direct"), mode.alias("direct_mode"), F.col("start").alias("duration"))
    kept = journeys.allowed_direct_modes(journeys.by_direct_path(rows, "only_with_alternatives"), ["walking", "bike"])
    return journeys.short_direct_paths(kept, {"walking": 40_000, "bike": 60_000}).select("id")


@query("""SELECT id FROM trip WHERE id NOT IN (SELECT trip_id FROM stop_time WHERE mode = 'F' AND stop_id % 5 > 0 GROUP BY trip_id HAVING sum(length) < 60)""")
def heavy_modes_long_enough(f: Feed) -> DataFrame:
    sections = f.stop_time.select(F.col("trip_id").alias("journey_id"), "mode", F.col("length").alias("duration"), (F.col("stop_id") % 5 == 0).alias("shared"))
    return journeys.long_enough(f.trip.select(F.col("id").alias("journey_id")), sections, {"F": 60}).select(F.col("journey_id").alias("id"))


@query("SELECT id, list_filter([CASE WHEN start >= 80000 THEN 'late' END, CASE WHEN price <= 1000 THEN 'cheap' END], lambda x: x IS NOT NULL)::VARCHAR AS dropped_by FROM trip")
def journey_filters_debug(f: Feed) -> DataFrame:
    rows = journeys.all_filters(f.trip, [("late", F.col("start") < 80_000), ("cheap", F.col("price") > 1000)], debug=True)
    return rows.select("id", F.concat(F.lit("["), F.array_join("dropped_by", ", "), F.lit("]")).alias("dropped_by"))


_RUNS = """WITH RECURSIVE run AS (SELECT t.id AS run, s.rank, s.stop_id, s.arrival + d.nth * 86400 AS arrival, s.departure + d.nth * 86400 AS departure, s.stop_id % 11 > 0 AS pick_up, s.stop_id % 13 > 0 AS drop_off, CASE WHEN s.stop_id % 4 > 0 THEN s.stop_id % 4 END AS zone
        FROM stop_time s JOIN trip t ON t.id = s.trip_id JOIN (SELECT id, (day - DATE '1995-06-01')::INT AS nth FROM trip) d ON d.id = t.id WHERE d.nth BETWEEN -1 AND 364),
    reach(stop_id, round, arrival) AS (SELECT (SELECT arg_min(stop_id, (departure, run)) FROM run WHERE departure >= 0 AND rank = 0 AND pick_up), 0, 0::BIGINT
        UNION SELECT got.stop_id, reach.round + 1, got.arrival FROM reach JOIN run b ON b.stop_id = reach.stop_id AND b.departure >= reach.arrival AND b.pick_up JOIN run got ON got.run = b.run AND got.rank > b.rank AND got.drop_off AND (b.zone IS NULL OR got.zone IS NULL OR b.zone <> got.zone) WHERE got.arrival <= 31536000 AND reach.round < 6),
    first AS (SELECT stop_id, round, min(arrival) AS arrival FROM reach GROUP BY 1, 2),
    label AS (SELECT stop_id, round, arrival FROM (SELECT *, min(arrival) OVER (PARTITION BY stop_id ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM first) WHERE before IS NULL OR arrival < before)"""


@query(f"{_RUNS} SELECT stop_id, round, arrival FROM label")
def search_by_days(f: Feed) -> DataFrame:
    """Labels of a search over a year of dated trips, with boarding rules and local zones."""
    stop = F.col("stop_id")
    times = f.stop_time.select("trip_id", "rank", "stop_id", "arrival", "departure", (stop % 11 > 0).alias("pick_up"), (stop % 13 > 0).alias("drop_off"), (stop % 4).alias("zone"))
    rides = stored(search.runs(times, f.trip.select(F.col("id").alias("trip_id"), "day"), "1995-06-01", 365), "runs")
    first = rides.where("departure >= 0 and rank = 0 and pick_up").agg(F.min_by("stop_id", F.struct("departure", F.col("trip_id"))).alias("stop_id"))
    seeds = first.select(F.lit("x").alias("search"), "stop_id", F.lit(0).cast("long").alias("arrival"), F.lit(365 * C.DAY).cast("long").alias("bound"))
    walks = f.spark.createDataFrame([], "from_stop long, to_stop long, duration long")
    return search.labels(rides, seeds, walks, 6).select("stop_id", "round", "arrival")


@query("SELECT id, unnest(generate_series(start, CASE WHEN (start + 40000) % 86400 < start THEN (start + 40000) % 86400 + 86400 ELSE (start + 40000) % 86400 END, 600 + id % 7 * 900)) % 86400 AS at FROM trip")
def frequency_times(f: Feed) -> DataFrame:
    rows = f.trip.select("id", "start", ((F.col("start") + 40_000) % C.DAY).alias("end"), (600 + F.col("id") % 7 * 900).alias("headway"))
    return timetable.frequency_times(rows)


_POINTS = "p AS (SELECT DISTINCT route_id, stop_id, stop_id % 3 = 0 AS has_times FROM stop_time JOIN trip ON trip.id = trip_id)"


@query(f"WITH {_POINTS}, w AS (SELECT *, bool_or(has_times) OVER (PARTITION BY route_id) AS anyt, row_number() OVER (PARTITION BY route_id ORDER BY stop_id) AS nth FROM p) SELECT route_id, stop_id FROM w WHERE has_times OR (NOT anyt AND nth = 1)")
def empty_siblings(f: Feed) -> DataFrame:
    points = f.stop_time.join(f.trip.select(F.col("id").alias("trip_id"), "route_id"), "trip_id").select("route_id", "stop_id", (F.col("stop_id") % 3 == 0).alias("has_times")).distinct()
    return timetable.without_empty_siblings(points).select("route_id", "stop_id")


@query("SELECT id, name FROM stop_point WHERE code = 'ECONOMY' AND id % 2 = 0")
def place_by_code(f: Feed) -> DataFrame:
    codes = f.stop_point.select(F.col("id").alias("object_id"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("system"), "code")
    return requests.by_code(f.stop_point, codes, "even", "ECONOMY").select("id", "name")


@query(f"SELECT id FROM stop_point WHERE {_distance('lon', 'lat', '2.4', '48.4')} <= 15000 AND id IN (SELECT stop_id FROM stop_time WHERE mode = 'O')")
def on_demand_stops(f: Feed) -> DataFrame:
    return requests.on_demand_stops(f.stop_point, f.stop_time.where("mode = 'O'").select("stop_id"), F.lit(2.4), F.lit(48.4), 15_000).select("id")


@query("""SELECT id, (day - DATE '1992-01-01') * 86400 + start AS flat, DATE '1992-01-01' + to_seconds((day - DATE '1992-01-01') * 86400 + start) AS at, start - id % 3 * 86400 AS base,
    floor(start * sqrt(2.0e0) / 1.1e0)::BIGINT AS walk, id % 2 = 0 AS same FROM trip""")
def time_columns(f: Feed) -> DataFrame:
    day0 = F.lit("1992-01-01").cast("date")
    flat = C.flat(F.datediff("day", day0), F.col("start"))
    lon, lat = F.lit(2.0), F.lit(48.0)
    near = C.same_place(lon, lat, lon + F.when(F.col("id") % 2 == 0, 1e-7).otherwise(1e-4), lat)
    at = C.to_timestamp_of(day0, flat)
    return f.trip.select("id", C.to_flat(day0, at).alias("flat"), at.alias("at"), C.base_time(F.col("start"), F.col("id") % 3).alias("base"), C.manhattan_duration(F.col("start"), 1.1).alias("walk"), near.alias("same"))


@query("""WITH h AS (SELECT id, CASE WHEN id % 4 > 0 THEN (id % 500)::VARCHAR || ' ' ELSE '' END || name AS text, id % 4 > 0 AS has, id % 500 AS n, name FROM stop_point) SELECT id, CASE WHEN has THEN n END::INT AS number, name AS rest FROM h""")
def house_numbers(f: Feed) -> DataFrame:
    text_ = F.concat(F.when(F.col("id") % 4 > 0, F.concat((F.col("id") % 500).cast("string"), F.lit(" "))).otherwise(""), "name")
    return f.stop_point.select("id", C.house_number(text_).alias("number"), C.without_house_number(text_).alias("rest"))


@query("SELECT trip_id, min(least(arrival - stop_id % 700, departure)) AS earliest FROM stop_time GROUP BY 1")
def earliest_times(f: Feed) -> DataFrame:
    stops = F.collect_list(F.struct((F.col("arrival") - F.col("stop_id") % 700).alias("boarding"), F.col("departure").alias("arrival")))
    return f.stop_time.groupBy("trip_id").agg(C.earliest_time(stops).alias("earliest"))


@query("""WITH i AS (SELECT id AS impact_id, CASE WHEN kind = 'error' THEN 'Brand#' || (entity_id % 5 + 1) || (entity_id % 4 + 1) END AS area, entity_id AS stop_id FROM event),
    met AS (SELECT area, impact_id, NULL AS stop_id FROM i WHERE area IS NOT NULL UNION ALL SELECT p.area, impact_id, stop_id FROM i JOIN stop_point p ON p.id = stop_id WHERE i.area IS NULL)
    SELECT area, impact_id, bool_or(stop_id IS NULL) AS on_area, count(DISTINCT stop_id) AS stops FROM met GROUP BY 1, 2""")
def stop_area_report(f: Feed) -> DataFrame:
    digit = lambda n: (F.col("entity_id") % n + 1).cast("string")
    impacts = f.event.select(F.col("id").alias("impact_id"), F.when(F.col("kind") == "error", F.concat(F.lit("Brand#"), digit(5), digit(4))).alias("area"), F.col("entity_id").alias("stop_id"))
    return disruptions.stop_area_report(impacts, f.stop_point.select(F.col("id").alias("stop_id"), "area"))


@query("""WITH i AS (SELECT entity_id AS trip_id, count(DISTINCT id) AS impacts, min(id) AS first_impact FROM event WHERE kind = 'error' AND ts <= (SELECT max(ts) FROM event) AND (k % 3 = 0 OR k IS NULL OR ts + to_days(k) > (SELECT max(ts) FROM event)) GROUP BY 1)
    SELECT network_id, trip_id, impacts, first_impact FROM i JOIN trip ON trip.id = trip_id JOIN route ON route.id = route_id JOIN line ON line.id = line_id""")
def trip_report(f: Feed) -> DataFrame:
    now = f.event.agg(F.max("ts")).first()[0]
    ends = F.when(F.col("k") % 3 != 0, F.col("ts") + F.make_interval(days=F.col("k")))
    impacts = f.event.select(F.col("id").alias("impact_id"), F.col("entity_id").alias("trip_id"), F.when(F.col("kind") == "error", "NO_SERVICE").otherwise("DETOUR").alias("effect"), F.col("ts").alias("begin"), ends.alias("end"))
    routes = f.route.select(F.col("id").alias("route_id"), "line_id").join(f.line.select(F.col("id").alias("line_id"), "network_id"), "line_id")
    return disruptions.trip_report(impacts, f.trip.select(F.col("id").alias("trip_id"), "route_id").join(routes, "route_id"), F.lit(now))


@query("SELECT DISTINCT id AS impact_id FROM event WHERE entity_id IN (SELECT trip_id FROM stop_time WHERE mode = 'O')")
def impacts_of_mode(f: Feed) -> DataFrame:
    return disruptions.impacts_of_mode(f.event.select(F.col("id").alias("impact_id"), F.col("entity_id").alias("trip_id")), f.stop_time, "O")


@query("""WITH p AS (SELECT id AS point_id, line_id, id IN (SELECT route_id FROM trip WHERE line_id % 2 = 0) AS has_times FROM route), g AS (SELECT *, max(has_times::INT) OVER (PARTITION BY line_id) AS n, min(point_id) OVER (PARTITION BY line_id) AS least FROM p)
    SELECT line_id, point_id, has_times FROM g WHERE has_times OR (n = 0 AND point_id = least)""")
def terminus_points(f: Feed) -> DataFrame:
    told = f.trip.select(F.col("route_id").alias("point_id"), F.lit(True).alias("told")).distinct()
    points = f.route.select(F.col("id").alias("point_id"), "line_id").join(told, "point_id", "left")
    return timetable.without_empty_points(points.select("line_id", "point_id", (F.col("told").isNotNull() & (F.col("line_id") % 2 == 0)).alias("has_times")), "line_id")


@query("""WITH s AS (SELECT entity_id AS request_id, kind AS task, min(ts) AS b, max(ts) AS e FROM event GROUP BY 1, 2)
    SELECT request_id, task, epoch_us(b) - min(epoch_us(b)) OVER (PARTITION BY request_id) AS starts, epoch_us(e) - epoch_us(b) AS lasts FROM s""")
def task_spans(f: Feed) -> DataFrame:
    return requests.task_spans(f.event.select(F.col("entity_id").alias("request_id"), F.col("kind").alias("task"), "ts"))


@query("SELECT DISTINCT p.area AS admin, p.id AS stop_id FROM stop_point p JOIN stop_time ON stop_id = p.id JOIN trip ON trip.id = trip_id WHERE route_id % 3 = 0")
def on_demand_by_admin(f: Feed) -> DataFrame:
    served = f.stop_time.select("trip_id", "stop_id").join(f.trip.select(F.col("id").alias("trip_id"), "route_id"), "trip_id")
    return requests.on_demand_by_admin(f.stop_point.select(F.col("id").alias("stop_id"), F.col("area").alias("admin")), served, f.route.select(F.col("id").alias("route_id"), (F.col("id") % 3 == 0).alias("zonal")))
