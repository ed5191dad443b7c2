"""Registered queries of the transit operators and their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farandole.functions import columns as C
from farandole.operators import disruptions, fares, geo, journeys, periods, requests, routing, sets, text, timetable
from farandole.plans.feed import SQL, Feed
from farandole.streaming import realtime

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function of a Feed under its name; sql may use the feed's entities."""

    def register(f: Callable[[Feed], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Feed(spark, sf_dir))
        if sql:
            text = sql.strip()
            rest = text[5:].lstrip() if text.startswith("WITH ") else None
            recursive = bool(rest) and rest.startswith("RECURSIVE ")
            rest = rest[10:] if recursive else rest
            ORACLE_SQL[f.__name__] = f"WITH {'RECURSIVE ' * recursive}{SQL.strip()}" + (f", {rest}" if rest else f" {text}")
        return f

    return register


# Sets, predicates and paths


@query("SELECT id FROM line")
def ptref_all(f: Feed) -> DataFrame:
    return sets.ids(f.line)


@query("SELECT id FROM line WHERE false")
def ptref_empty(f: Feed) -> DataFrame:
    return sets.ids(f.line, F.lit(False))


@query("SELECT id FROM route WHERE id = 7")
def ptref_id(f: Feed) -> DataFrame:
    return sets.ids(f.route, F.col("id") == 7)


@query("SELECT id FROM network WHERE name = 'ASIA'")
def ptref_name(f: Feed) -> DataFrame:
    return sets.ids(f.network, F.col("name") == "ASIA")


@query("SELECT id FROM route WHERE direction_type IN ('BUILDING', 'MACHINERY')")
def ptref_direction_type(f: Feed) -> DataFrame:
    return sets.ids(f.route, F.col("direction_type").isin("BUILDING", "MACHINERY"))


@query("SELECT id FROM stop_point WHERE code = 'ECONOMY' AND size > 20")
def ptref_and(f: Feed) -> DataFrame:
    return sets.both(sets.ids(f.stop_point, F.col("code") == "ECONOMY"), sets.ids(f.stop_point, F.col("size") > 20))


@query("SELECT id FROM stop_point WHERE code = 'ECONOMY' OR size > 40")
def ptref_or(f: Feed) -> DataFrame:
    return sets.either(sets.ids(f.stop_point, F.col("code") == "ECONOMY"), sets.ids(f.stop_point, F.col("size") > 40))


@query("SELECT id FROM stop_point WHERE NOT (area = 'Brand#3')")
def ptref_diff(f: Feed) -> DataFrame:
    return sets.without(sets.ids(f.stop_point), sets.ids(f.stop_point, F.col("area") == "Brand#3"))


@query("SELECT DISTINCT line.id FROM line JOIN network ON network_id = network.id WHERE network.name = 'ASIA' AND line.id IN (SELECT line_id FROM route JOIN trip ON route.id = trip.route_id)")
def ptref_get(f: Feed) -> DataFrame:
    """Lines of one network that some trip runs on."""
    of_network = sets.reached(f, sets.ids(f.network, F.col("name") == "ASIA"), ["network", "line"])
    return sets.both(of_network, sets.reached(f, sets.ids(f.trip), ["trip", "route", "line"]))


@query("SELECT DISTINCT stop_id AS id FROM network JOIN line ON network_id = network.id JOIN route ON line_id = line.id JOIN trip ON route_id = route.id JOIN stop_time ON trip_id = trip.id WHERE network.name = 'EUROPE'")
def ptref_path_multihop(f: Feed) -> DataFrame:
    return sets.reached(f, sets.ids(f.network, F.col("name") == "EUROPE"), ["network", "line", "route", "trip", "stop_point"])


@query("SELECT DISTINCT network_id AS id FROM stop_point s JOIN stop_time ON stop_id = s.id JOIN trip ON trip_id = trip.id JOIN route ON route_id = route.id JOIN line ON line_id = line.id WHERE area = 'Brand#7'")
def ptref_path_backwards(f: Feed) -> DataFrame:
    return sets.reached(f, sets.ids(f.stop_point, F.col("area") == "Brand#7"), ["stop_point", "trip", "route", "line", "network"])


@query("SELECT id FROM route WHERE id NOT IN (SELECT id FROM route WHERE line_id IN (3, 5) OR direction_type = 'HOUSEHOLD')")
def ptref_forbidden(f: Feed) -> DataFrame:
    forbidden = sets.either(sets.ids(f.route, F.col("line_id").isin(3, 5)), sets.ids(f.route, F.col("direction_type") == "HOUSEHOLD"))
    return sets.without(sets.ids(f.route), forbidden)


@query("SELECT id FROM stop_point WHERE area = 'Brand#2'")
def ptref_has_code(f: Feed) -> DataFrame:
    codes = f.stop_point.select("id", F.lit("area").alias("system"), F.col("area").alias("value"))
    return sets.with_codes(f.stop_point, codes, ["area"], "Brand#2")


@query("SELECT id FROM stop_point WHERE size % 3 = 0 OR size % 5 = 0")
def ptref_has_code_type(f: Feed) -> DataFrame:
    system = F.when(F.col("size") % 3 == 0, "three").when(F.col("size") % 5 == 0, "five").otherwise("none")
    return sets.with_codes(f.stop_point, f.stop_point.select("id", system.alias("system"), F.col("area").alias("value")), ["three", "five"])


@query("SELECT id FROM stop_point WHERE len(list_intersect(string_split(name, ' '), ['red', 'ring'])) > 0")
def ptref_tags(f: Feed) -> DataFrame:
    return sets.with_any_tag(f.stop_point.withColumn("tags", F.split("name", " ")), ["red", "ring"])


@query("SELECT id FROM trip WHERE day + to_seconds(start) < TIMESTAMP '1998-03-01 00:00:01' AND day + to_seconds(start + 3600) > TIMESTAMP '1998-02-01'")
def ptref_between(f: Feed) -> DataFrame:
    return sets.between(_trip_periods(f), F.lit("1998-02-01").cast("timestamp_ntz"), F.lit("1998-03-01").cast("timestamp_ntz")).select("id")


@query("SELECT id FROM trip WHERE day + to_seconds(start) <= TIMESTAMP '1998-03-14 06:00:00' AND day + to_seconds(start + 3600) > TIMESTAMP '1998-03-14 06:00:00'")
def ptref_active_at(f: Feed) -> DataFrame:
    now = F.lit("1998-03-14 06:00:00").cast("timestamp_ntz")
    return _trip_periods(f).where((F.col("begin") <= now) & (F.col("end") > now)).select("id")


_HAVERSINE = "2 * 6372797.560856 * asin(least(1.0, sqrt(pow(sin(({1} - {3}) * 0.01745329238 / 2), 2) + cos({3} * 0.01745329238) * cos({1} * 0.01745329238) * pow(sin(({0} - {2}) * 0.01745329238 / 2), 2))))"


def _distance(a: str, b: str, c: str, d: str) -> str:
    return _HAVERSINE.format(a, b, c, d)


@query(f"SELECT id, round({_distance('lon', 'lat', '2.5', '48.5')}, 3) AS distance FROM route WHERE {_distance('lon', 'lat', '2.5', '48.5')} <= 20000")
def ptref_within(f: Feed) -> DataFrame:
    return sets.within(f.route, 2.5, 48.5, 20_000).select("id", F.round("distance", 3).alias("distance"))


@query("SELECT id, name FROM line ORDER BY id LIMIT 10 OFFSET 10")
def page_2(f: Feed) -> DataFrame:
    return sets.page(f.line.select("id", "name"), 1, 10)


@query("SELECT id FROM trip WHERE (status_bits & 5) = 5")
def accessible_trips(f: Feed) -> DataFrame:
    bits = (F.col("id") % 8).cast("int")
    return f.trip.withColumn("bits", bits).where(C.accessible(5, F.col("bits"))).select("id")


ORACLE_SQL["accessible_trips"] = ORACLE_SQL["accessible_trips"].replace("(status_bits & 5) = 5", "((id % 8)::INT & 5) = 5")


def _trip_periods(f: Feed) -> DataFrame:
    begin = F.col("day").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("start"))
    return f.trip.select("id", "route_id", begin.alias("begin"), (begin + F.expr("interval 1 hour")).alias("end"))


_TRIP_PERIODS = "trip_period AS (SELECT id, route_id, day + to_seconds(start) AS begin, day + to_seconds(start + 3600) AS \"end\" FROM trip)"


# Days and calendars


def _periods(f: Feed) -> DataFrame:
    return f.trip.where("status = 'F'").select(F.col("route_id"), F.col("day").alias("begin"), F.date_add("day", 20).alias("end"), (F.col("id") % 127 + 1).cast("int").alias("mask"))


_PERIODS = """period AS (SELECT route_id, day AS begin, day + 20 AS "end", (id % 127 + 1)::INT AS mask FROM trip WHERE status = 'F'),
    valid AS (SELECT DISTINCT route_id, d::DATE AS day FROM (SELECT route_id, mask, unnest(generate_series(begin::TIMESTAMP, "end"::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM period) WHERE (mask >> (isodow(d) - 1)::INT) & 1 = 1)"""


@query(f"WITH {_PERIODS} SELECT route_id, count(*)::BIGINT AS days, min(day) AS first_day, max(day) AS last_day FROM valid GROUP BY 1")
def validity_build(f: Feed) -> DataFrame:
    days = periods.days_of(_periods(f), "route_id", F.col("mask"))
    return days.groupBy("route_id").agg(F.count(F.lit(1)).alias("days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query(f"WITH {_PERIODS}, near AS (SELECT DISTINCT route_id, day + x AS day FROM valid, (VALUES (-1), (0), (1)) v(x)) SELECT route_id, count(*)::BIGINT AS days FROM near GROUP BY 1")
def validity_check2(f: Feed) -> DataFrame:
    return periods.near_days(periods.days_of(_periods(f), "route_id", F.col("mask")), "route_id").groupBy("route_id").agg(F.count(F.lit(1)).alias("days"))


_EXCEPTIONS = "exception AS (SELECT route_id, day, CASE WHEN status = 'O' THEN 1 ELSE 2 END AS type FROM trip WHERE status <> 'F')"


@query(f"WITH {_PERIODS}, {_EXCEPTIONS} SELECT * FROM (SELECT route_id, day FROM valid UNION SELECT route_id, day FROM exception WHERE type = 1) EXCEPT SELECT route_id, day FROM exception WHERE type = 2")
def calendar_build(f: Feed) -> DataFrame:
    exceptions = f.trip.where("status <> 'F'").select("route_id", "day", F.when(F.col("status") == "O", 1).otherwise(2).alias("type"))
    return periods.calendar_days(_periods(f), exceptions, "route_id", F.col("mask"))


@query(f"WITH {_PERIODS}, s AS (SELECT route_id, string_agg(day::VARCHAR, ',' ORDER BY day) AS days FROM valid GROUP BY 1) SELECT route_id, min(route_id) OVER (PARTITION BY days) AS pattern FROM s")
def validity_interned(f: Feed) -> DataFrame:
    return periods.interned(periods.days_of(_periods(f), "route_id", F.col("mask")), "route_id")


@query(f"""WITH {_PERIODS}, o AS (SELECT DISTINCT line_id AS "group", route_id AS object, day FROM valid JOIN route ON route.id = route_id),
    c AS (SELECT line_id AS "group", route_id AS calendar, day FROM valid JOIN route ON route.id = route_id WHERE direction_type = 'BUILDING' AND isodow(day) < 6),
    shared AS (SELECT object, calendar, count(*) AS shared FROM o JOIN c USING ("group", day) GROUP BY 1, 2), n AS (SELECT "group", object, count(*) AS n FROM o GROUP BY 1, 2), m AS (SELECT "group", calendar, count(*) AS m FROM c GROUP BY 1, 2)
    SELECT object, calendar, (n + m - 2 * coalesce(shared, 0))::INT AS differing FROM n JOIN m USING ("group") LEFT JOIN shared USING (object, calendar) WHERE n + m - 2 * coalesce(shared, 0) <= round(m * 0.4)""")
def calendar_match(f: Feed) -> DataFrame:
    """Calendars are the working days of some routes."""
    days = periods.days_of(_periods(f), "route_id", F.col("mask"))
    of = f.route.select(F.col("id").alias("route_id"), F.col("line_id").alias("group"), "direction_type")
    rows = days.join(of, "route_id")
    calendars = rows.where("direction_type = 'BUILDING' and weekday(day) < 5").select("group", F.col("route_id").alias("calendar"), "day")
    return periods.similar_calendars(rows.select("group", F.col("route_id").alias("object"), "day"), calendars, "group", 0.4)


@query("""WITH d AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2025-12-31', INTERVAL 1 DAY))::DATE AS day),
    o AS (SELECT day, CASE WHEN day >= DATE '2024-03-31' AND day < DATE '2024-10-27' OR day >= DATE '2025-03-30' AND day < DATE '2025-10-26' THEN 120 ELSE 60 END AS "offset" FROM d),
    i AS (SELECT *, (day - DATE '2000-01-01')::INT - row_number() OVER (PARTITION BY "offset" ORDER BY day) AS island FROM o)
    SELECT "offset", min(day) AS begin, max(day) AS "end" FROM i GROUP BY "offset", island""")
def dst_split(f: Feed) -> DataFrame:
    days = f.spark.range(1).select(F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2025-12-31").cast("date"))).alias("day"))
    return periods.offset_periods(days, "Europe/Paris").select("offset", "begin", "end")


@query("""WITH d AS (SELECT DISTINCT route_id, day FROM trip), s AS (SELECT route_id, min(day) AS begin, max(day) AS "end" FROM d GROUP BY 1),
    e AS (SELECT route_id, begin, "end", w, (SELECT count(*) FROM d WHERE d.route_id = s.route_id AND isodow(day) - 1 = w) AS n, greatest(0, floor(("end" - (begin + ((w - (isodow(begin) - 1) + 7) % 7)::INT)) / 7.0) + 1) AS occurs FROM s, range(7) r(w))
    SELECT route_id, begin, "end", sum(CASE WHEN n * 2 >= occurs AND occurs > 0 THEN 1 << w::INT ELSE 0 END)::INT AS mask, sum(CASE WHEN n * 2 >= occurs AND occurs > 0 THEN occurs - n ELSE n END)::BIGINT AS cost FROM e GROUP BY ALL""")
def week_pattern(f: Feed) -> DataFrame:
    return periods.week_pattern(f.trip.select("route_id", "day").distinct(), "route_id")


@query("""WITH v AS (SELECT route_id AS trip_id, day, (id % 3)::INT AS level, id AS version FROM trip)
    SELECT * FROM v QUALIFY level = 0 OR row_number() OVER (PARTITION BY trip_id, day, level ORDER BY version DESC) = 1""")
def version_precedence(f: Feed) -> DataFrame:
    return periods.version_precedence(f.trip.select(F.col("route_id").alias("trip_id"), "day", (F.col("id") % 3).cast("int").alias("level"), F.col("id").alias("version")))


# Timetable


@query("""WITH b AS (SELECT trip_id, l_linenumber AS sequence, stop_id, arrival - rank * 600 + l_linenumber * 700 AS arrival, arrival - rank * 600 + l_linenumber * 700 + l_quantity::INT * 30 AS departure FROM (SELECT l_orderkey AS trip_id, l_linenumber, l_partkey AS stop_id, l_quantity, l_orderkey * 37 % 86400 + rank * 600 AS arrival, rank FROM stop_time0)),
    s AS (SELECT *, row_number() OVER w::INT - 1 AS rank, lag(sequence) OVER w = sequence OR lag(departure) OVER w > arrival OR departure < arrival AS bad FROM b WINDOW w AS (PARTITION BY trip_id ORDER BY sequence, arrival, stop_id))
    SELECT trip_id, count(*)::BIGINT AS stops, max(departure)::BIGINT AS last_departure FROM s WHERE trip_id NOT IN (SELECT trip_id FROM s WHERE bad) GROUP BY 1""")
def stop_time_clean(f: Feed) -> DataFrame:
    start = F.col("l_orderkey") * 37 % C.DAY + F.col("l_linenumber") * 700
    rows = f.table("lineitem").select(F.col("l_orderkey").alias("trip_id"), F.col("l_linenumber").alias("sequence"), F.col("l_partkey").alias("stop_id"), start.alias("arrival"), (start + F.col("l_quantity").cast("int") * 30).alias("departure"))
    return timetable.clean_stop_times(rows).groupBy("trip_id").agg(F.count(F.lit(1)).alias("stops"), F.max("departure").alias("last_departure"))


_ASKED = "asked AS (SELECT id AS query_id, entity_id, ts + to_seconds(id % 3600) AS since FROM event WHERE kind = 'view'), held AS (SELECT id, entity_id, ts FROM event WHERE kind <> 'view')"


def _asked(f: Feed) -> tuple[DataFrame, DataFrame]:
    asked = f.event.where("kind = 'view'").select(F.col("id").alias("query_id"), "entity_id", (F.col("ts") + F.make_dt_interval(secs=F.col("id") % 3600)).alias("since"))
    return asked, f.event.where("kind <> 'view'").select("id", "entity_id", "ts")


@query(f"""WITH {_ASKED}, m AS (SELECT query_id, since, h.id, h.ts FROM asked a ASOF LEFT JOIN held h ON a.entity_id = h.entity_id AND a.since <= h.ts)
    SELECT query_id, CASE WHEN ts < since + INTERVAL 1 DAY THEN id END AS passage_id, CASE WHEN ts < since + INTERVAL 1 DAY THEN ts END AS ts FROM m""")
def next_departures_asof(f: Feed) -> DataFrame:
    return timetable.next_passages(*_asked(f), "entity_id")


@query(f"""WITH {_ASKED}, m AS (SELECT query_id, since, h.id, h.ts FROM asked a ASOF LEFT JOIN held h ON a.entity_id = h.entity_id AND a.since >= h.ts)
    SELECT query_id, CASE WHEN ts > since - INTERVAL 1 DAY THEN id END AS passage_id, CASE WHEN ts > since - INTERVAL 1 DAY THEN ts END AS ts FROM m""")
def prev_departures_asof(f: Feed) -> DataFrame:
    return timetable.previous_passages(*_asked(f), "entity_id")


@query("SELECT id, entity_id, ts FROM event WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12' ORDER BY ts, id LIMIT 20")
def next_k(f: Feed) -> DataFrame:
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return timetable.first_passages(f.event.select("id", "entity_id", "ts"), at("2024-01-10"), at("2024-01-12"), 20)


@query("SELECT entity_id, kind, id, ts, row_number() OVER (PARTITION BY entity_id, kind ORDER BY ts, id)::INT AS nth FROM event QUALIFY nth <= 3")
def stop_schedule_topk(f: Feed) -> DataFrame:
    return timetable.schedules(f.event.select("entity_id", "kind", "id", "ts"), ["entity_id", "kind"], ["ts", "id"], 3)


@query("""WITH p AS (SELECT entity_id, ts, (CASE WHEN epoch(ts) - epoch(date_trunc('day', ts)) < 14400 - 1 THEN ts::DATE - 1 ELSE ts::DATE END)::DATE AS service_day FROM (SELECT entity_id, date_trunc('second', ts) AS ts FROM event))
    SELECT entity_id, service_day, min(ts) AS first, max(ts) AS last, count(*)::BIGINT AS passages FROM p GROUP BY 1, 2""")
def first_last_service_day(f: Feed) -> DataFrame:
    rows = f.event.select("entity_id", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"), F.lit(14_400).alias("opening"))
    return timetable.first_and_last(rows, "entity_id")


def _frequencies(f: Feed) -> DataFrame:
    k = F.col("id")
    return f.company.select("id", (k * 977 % C.DAY).alias("start"), ((k * 977 + 20_000) % C.DAY).alias("end"), (k % 7 * 300 + 600).alias("headway"))


@query("""WITH q AS (SELECT id, id * 977 % 86400 AS s, (id * 977 + 20000) % 86400 AS e, id % 7 * 300 + 600 AS h FROM company)
    SELECT id, t % 86400 AS at FROM (SELECT id, unnest(range(s, CASE WHEN e < s THEN e + 86400 ELSE e END + 1, h)) AS t FROM q)""")
def frequency_expand(f: Feed) -> DataFrame:
    return timetable.expanded_frequencies(_frequencies(f), "id")


@query("""WITH q AS (SELECT id, id * 977 % 86400 AS s, id * 977 % 86400 + 20000 AS e, id % 7 * 300 + 600 AS h FROM company), n AS (SELECT id, s, e, h, 40000 AS now FROM q)
    SELECT id, CASE WHEN s + greatest(0, ceil((now - s) / h)) * h <= e THEN (s + greatest(0, ceil((now - s) / h)) * h)::BIGINT END AS next_at, CASE WHEN now >= s THEN (s + floor((least(now, e) - s) / h) * h)::BIGINT END AS previous_at FROM n""")
def frequency_next(f: Feed) -> DataFrame:
    start, end, headway, now = F.col("start"), F.col("start") + 20_000, F.col("headway"), F.lit(40_000)
    return _frequencies(f).select("id", C.frequency_next(now, start, end, headway).cast("long").alias("next_at"), C.frequency_previous(now, start, end, headway).cast("long").alias("previous_at"))


@query("""SELECT trip.id, NOT (CASE WHEN opening <= closing THEN start BETWEEN opening AND closing ELSE start >= opening OR start <= closing END) AS closed FROM trip JOIN route ON route_id = route.id JOIN line ON line_id = line.id""")
def line_closed(f: Feed) -> DataFrame:
    lines = f.line.select(F.col("id").alias("line_id"), "opening", "closing")
    routes = f.route.select(F.col("id").alias("route_id"), "line_id").join(lines, "line_id")
    return f.trip.select("id", "route_id", "start").join(routes, "route_id").select("id", (~C.open_at(F.col("start"), F.col("opening"), F.col("closing"))).alias("closed"))


@query("""WITH o AS (SELECT trip_id, rank, stop_id, row_number() OVER (PARTITION BY trip_id, stop_id ORDER BY rank)::INT AS nth FROM stop_time),
    a AS (SELECT trip_id, rank, stop_id, row_number() OVER (PARTITION BY trip_id, stop_id ORDER BY rank)::INT AS nth FROM stop_time WHERE rank % 3 <> 1)
    SELECT a.trip_id, a.rank, a.stop_id, a.nth, o.rank AS base_rank FROM a LEFT JOIN o USING (trip_id, stop_id, nth)""")
def occurrence_match(f: Feed) -> DataFrame:
    base = f.stop_time.select("trip_id", "rank", "stop_id")
    return timetable.matched_occurrences(base.where("rank % 3 <> 1"), base).select("trip_id", "rank", "stop_id", "nth", "base_rank")


@query("""WITH e AS (SELECT id, entity_id, k % 4 AS first_stop, (k // 4) % 4 AS last_stop, epoch(date_trunc('second', ts))::BIGINT AS start, epoch(date_trunc('second', ts))::BIGINT + 7200 AS "end" FROM event)
    SELECT id, CASE WHEN lead(start) OVER w >= "end" AND lead(first_stop) OVER w = last_stop THEN lead(id) OVER w END AS next_id FROM e WINDOW w AS (PARTITION BY entity_id ORDER BY start, id)""")
def block_chain(f: Feed) -> DataFrame:
    start = F.unix_seconds(F.col("ts").cast("timestamp"))
    trips = f.event.select("id", "entity_id", (F.col("k") % 4).alias("first_stop"), (F.floor(F.col("k") / 4) % 4).alias("last_stop"), start.alias("start"), (start + 7200).alias("end"))
    return timetable.chained_blocks(trips, "entity_id").select("id", "next_id")


@query("SELECT trip_id, rank, last_value(headsign IGNORE NULLS) OVER (PARTITION BY trip_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS shown FROM stop_time")
def headsign_forward(f: Feed) -> DataFrame:
    return timetable.carried_headsigns(f.stop_time).select("trip_id", "rank", "shown")


@query("SELECT trip_id, rank, rank <> max(rank) OVER (PARTITION BY trip_id) AS pick_up, rank <> min(rank) OVER (PARTITION BY trip_id) AS drop_off FROM stop_time")
def border_flags(f: Feed) -> DataFrame:
    return timetable.border_flags(f.stop_time).select("trip_id", "rank", "pick_up", "drop_off")


@query("""WITH i AS (SELECT entity_id, kind, row_number() OVER (PARTITION BY entity_id ORDER BY ts, id) - row_number() OVER (PARTITION BY entity_id, kind ORDER BY ts, id) AS island FROM event),
    r AS (SELECT entity_id, kind, island, count(*)::BIGINT AS n FROM i GROUP BY ALL) SELECT entity_id, kind, max(n)::BIGINT AS longest FROM r GROUP BY 1, 2""")
def max_successive(f: Feed) -> DataFrame:
    return timetable.longest_runs(f.event, "entity_id", ["ts", "id"], "kind")


@query("""WITH l AS (SELECT trip_id, arg_max(stop_id, rank) AS stop_id FROM stop_time GROUP BY 1), n AS (SELECT route_id, area, count(*)::BIGINT AS n FROM l JOIN trip ON trip.id = trip_id JOIN stop_point s ON s.id = stop_id GROUP BY 1, 2)
    SELECT route_id, area AS destination, n AS trips FROM n QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY n DESC, area) = 1""")
def route_destination(f: Feed) -> DataFrame:
    last = f.stop_time.groupBy("trip_id").agg(F.max_by("stop_id", "rank").alias("stop_id"))
    rows = last.join(f.trip.select(F.col("id").alias("trip_id"), "route_id"), "trip_id").join(f.stop_point.select(F.col("id").alias("stop_id"), "area"), "stop_id")
    return timetable.route_destinations(rows)


@query("""WITH s AS (SELECT trip_id, string_agg(stop_id::VARCHAR, ',' ORDER BY rank) AS stops FROM stop_time GROUP BY 1)
    SELECT route_id, stops, count(*)::BIGINT AS trips, min(id) AS first_trip FROM s JOIN trip ON id = trip_id GROUP BY 1, 2""")
def pattern_group(f: Feed) -> DataFrame:
    return timetable.journey_patterns(f.stop_time, f.trip.select("id", "route_id"))


@query("""SELECT trip_id, rank, arrival % 86400 + 86400 * max(CASE WHEN arrival % 86400 < 14400 THEN 1 ELSE 0 END) OVER (PARTITION BY trip_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS cumulative FROM stop_time""")
def schedule_cumulative(f: Feed) -> DataFrame:
    cells = f.stop_time.select("trip_id", "rank", C.hour_in_day(F.col("arrival")).alias("time"))
    return timetable.cumulative_days(cells, "trip_id", "rank", 14_400).select("trip_id", "rank", "cumulative")


@query("SELECT trip_id, stop_id, day + (departure // 86400)::INT AS on_day, departure % 86400 AS at FROM stop_time JOIN trip ON trip.id = trip_id")
def two_day_table(f: Feed) -> DataFrame:
    return timetable.two_day_table(f.trip.select(F.col("id").alias("trip_id"), "day"), f.stop_time.select("trip_id", "stop_id", "departure"))


@query("SELECT id AS stop_id FROM stop_point WHERE id NOT IN (SELECT stop_id FROM stop_time WHERE mode = 'O' AND length > 40)")
def empty_points(f: Feed) -> DataFrame:
    return timetable.empty_points(f.stop_point.select(F.col("id").alias("stop_id")), f.stop_time.where("mode = 'O' and length > 40"), ["stop_id"])


@query("""WITH r AS (SELECT entity_id, id, ts FROM event WHERE kind = 'error') SELECT entity_id, id, ts FROM event WHERE kind = 'view' AND entity_id NOT IN (SELECT entity_id FROM r WHERE id % 50 = 0) UNION ALL SELECT entity_id, id, ts FROM r WHERE id % 50 = 0""")
def realtime_overlay(f: Feed) -> DataFrame:
    rows = f.event.select("entity_id", "id", "ts", "kind")
    return timetable.overlaid(rows.where("kind = 'view'").drop("kind"), rows.where("kind = 'error' and id % 50 = 0").drop("kind"), ["entity_id"])


# Space


@query(f"""SELECT c.id AS query_id, r.id, round({_distance('c.lon', 'c.lat', 'r.lon', 'r.lat')}, 3) AS distance FROM company c JOIN route r ON {_distance('c.lon', 'c.lat', 'r.lon', 'r.lat')} <= 5000""")
def radius_join(f: Feed) -> DataFrame:
    queries = f.company.select(F.col("id").alias("query_id"), "lon", "lat")
    met = geo.place_pairs(queries, f.route, 5000).withColumn("distance", F.round("distance", 3))  # once for all pairs of two places
    return geo.written_out(met)


@query(f"""WITH m AS (SELECT c.id AS query_id, r.id, {_distance('c.lon', 'c.lat', 'r.lon', 'r.lat')} AS d FROM company c JOIN route r ON {_distance('c.lon', 'c.lat', 'r.lon', 'r.lat')} <= 20000)
    SELECT query_id, id, round(d, 3) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY d, id)::INT AS nth FROM m QUALIFY nth <= 5""")
def nearest_k(f: Feed) -> DataFrame:
    queries = f.company.select(F.col("id").alias("query_id"), "lon", "lat")
    return geo.nearest(queries, f.route, 20_000, 5).withColumn("distance", F.round("distance", 3))


@query(f"""WITH m AS (SELECT p.id, r.id AS address, {_distance('p.lon', 'p.lat', 'r.lon', 'r.lat')} AS d FROM stop_point p JOIN route r ON {_distance('p.lon', 'p.lat', 'r.lon', 'r.lat')} <= 10000)
    SELECT id, address, round(d, 3) AS distance FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, address) = 1""")
def nearest_address(f: Feed) -> DataFrame:
    found = geo.nearest(f.stop_point.select(F.col("id").alias("query_id"), "lon", "lat"), f.route, 10_000, 1)
    return found.select(F.col("query_id").alias("id"), F.col("id").alias("address"), F.round("distance", 3).alias("distance"))


@query("""SELECT id FROM stop_point WHERE ((CASE WHEN (lat < 48.1) <> (lat < 48.2) AND lon < (lat - 48.1) * ((2.9 - 2.1) / (48.2 - 48.1)) + 2.1 THEN 1 ELSE 0 END) + (CASE WHEN (lat < 48.2) <> (lat < 48.9) AND lon < (lat - 48.2) * ((2.5 - 2.9) / (48.9 - 48.2)) + 2.9 THEN 1 ELSE 0 END) + (CASE WHEN (lat < 48.9) <> (lat < 48.1) AND lon < (lat - 48.9) * ((2.1 - 2.5) / (48.1 - 48.9)) + 2.5 THEN 1 ELSE 0 END)) % 2 = 1""")
def point_in_polygon(f: Feed) -> DataFrame:
    return f.stop_point.where(C.inside(F.col("lon"), F.col("lat"), [(2.1, 48.1), (2.9, 48.2), (2.5, 48.9)])).select("id")


@query("SELECT greatest(0, least(19, floor((lon - 2.1e0) / ((2.9e0 - 2.1e0) / 20))))::INT AS x, greatest(0, least(19, floor((lat - 48.1e0) / ((48.9e0 - 48.1e0) / 20))))::INT AS y, count(*)::BIGINT AS n FROM route GROUP BY 1, 2")
def heat_grid(f: Feed) -> DataFrame:
    return geo.heat_grid(f.route, (2.1, 48.1, 2.9, 48.9), 20)


@query("SELECT id, round(greatest(0, least(1, ((lon - 2.2) * 0.6 + (lat - 48.3) * 0.4) / 0.52)), 6) AS along FROM stop_point")
def project_segment(f: Feed) -> DataFrame:
    return f.stop_point.select("id", F.round(C.along_segment(F.col("lon"), F.col("lat"), (2.2, 48.3), (2.8, 48.7)), 6).alias("along"))


@query(f"""WITH c AS (SELECT id, lon, lat, (id * 131 % 9000 + 500)::DOUBLE AS radius FROM company)
    SELECT a.id FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE a.id <> b.id AND {_distance('a.lon', 'a.lat', 'b.lon', 'b.lat')} + a.radius < b.radius)""")
def circles_kept(f: Feed) -> DataFrame:
    return geo.uncovered_circles(f.company.select("id", "lon", "lat", (F.col("id") * 131 % 9000 + 500).cast("double").alias("radius"))).select("id")


# Text


@query("WITH w AS (SELECT DISTINCT id, unnest(string_split_regex(lower(name), '[^a-z0-9]+')) AS word FROM stop_point) SELECT id FROM w GROUP BY id HAVING bool_or(starts_with(word, 're')) AND bool_or(starts_with(word, 'w'))")
def text_prefix_and(f: Feed) -> DataFrame:
    return text.prefix_search(text.token_index(f.stop_point), ["re", "w"])


@query("""WITH w AS (SELECT DISTINCT id, unnest(string_split_regex(lower(name), '[^a-z0-9]+')) AS word FROM stop_point), g AS (SELECT DISTINCT id, substr(word, k, 2) AS gram FROM (SELECT id, word, unnest(range(1, greatest(length(word), 2))) AS k FROM w WHERE word <> '')),
    n AS (SELECT id, count(DISTINCT gram)::BIGINT AS found FROM g WHERE gram IN ('wi', 'id', 'dg', 'ge', 'et', 'ts') GROUP BY 1) SELECT id, found FROM n WHERE floor((6 - found) * 100 / 6) <= 25""")
def text_fuzzy_bigram(f: Feed) -> DataFrame:
    return text.fuzzy_search(text.token_index(f.stop_point), "widgets")


@query("""WITH q AS (SELECT unnest(range(1, 10)) AS a), s AS (SELECT DISTINCT substr('red gizmo', a, n) AS sub, length(substr('red gizmo', a, n)) AS n FROM q, range(1, 10) r(n)),
    names AS (SELECT DISTINCT lower(name) AS name FROM stop_point), hits AS (SELECT name, s.n, max(p + s.n - 2) FILTER (WHERE substr(name, p, s.n) = sub) AS last, min(p + s.n - 2) FILTER (WHERE substr(name, p, s.n) = sub) AS first FROM names, s, range(1, 41) r(p) WHERE length(sub) = s.n AND p + s.n - 1 <= length(name) GROUP BY 1, 2),
    best AS (SELECT name, max(n)::INT AS lcs, arg_max(first, n)::INT AS position FROM hits WHERE first IS NOT NULL GROUP BY 1)
    SELECT id, coalesce(lcs, 0) AS lcs, coalesce(position, -1) AS position FROM stop_point LEFT JOIN best ON best.name = lower(stop_point.name)""")
def text_lcs_score(f: Feed) -> DataFrame:
    return text.longest_common(f.stop_point, "red gizmo")


@query("SELECT id, name, score FROM (SELECT id, name, id % 3 AS type_order, floor(price / 10)::BIGINT AS score, size AS quality FROM stop_point) ORDER BY type_order, score DESC, quality DESC, lower(name), id LIMIT 25")
def place_rank(f: Feed) -> DataFrame:
    places = f.stop_point.select("id", "name", (F.col("id") % 3).alias("type_order"), F.floor(F.col("price") / 10).alias("score"), F.col("size").alias("quality"))
    return text.ranked_places(places, 25).select("id", "name", "score")


@query("SELECT line_id, floor(ln(count(*) + 2) * 10)::INT AS score FROM route GROUP BY 1")
def admin_score(f: Feed) -> DataFrame:
    return f.route.groupBy("line_id").agg(text.admin_score(F.count(F.lit(1))).alias("score"))


@query("WITH a AS (SELECT area, count(*)::BIGINT AS stops FROM stop_point GROUP BY 1) SELECT area, (floor(ln(stops + 2) * 10) + floor(stops * 100 / (SELECT max(stops) FROM a)))::INT AS score FROM a")
def stop_area_score(f: Feed) -> DataFrame:
    areas = f.stop_point.groupBy("area").agg(F.count(F.lit(1)).alias("stops")).withColumn("admin_score", text.admin_score(F.col("stops")))
    return text.stop_area_scores(areas).select("area", "score")


@query("WITH a AS (SELECT area, list(DISTINCT (10000 + size * 7)::VARCHAR) AS codes FROM stop_point GROUP BY 1) SELECT area, CASE WHEN list_min(codes) = list_max(codes) THEN list_min(codes) ELSE list_min(codes) || '-' || list_max(codes) END AS codes FROM a")
def postal_range(f: Feed) -> DataFrame:
    return f.stop_point.groupBy("area").agg(C.postal_range(F.collect_set((10_000 + F.col("size") * 7).cast("string"))).alias("codes"))


# Routing


_REACH = """WITH RECURSIVE reach(stop_id, round, arrival) AS (SELECT 1::BIGINT, 0, 30000::BIGINT
        UNION SELECT got.stop_id, reach.round + 1, got.arrival FROM reach JOIN stop_time b ON b.stop_id = reach.stop_id AND b.departure >= reach.arrival JOIN stop_time got ON got.trip_id = b.trip_id AND got.rank > b.rank WHERE got.arrival <= 70000 AND reach.round < 10),
    first AS (SELECT stop_id, round, min(arrival) AS arrival FROM reach GROUP BY 1, 2),
    label AS (SELECT stop_id, round, arrival FROM (SELECT *, min(arrival) OVER (PARTITION BY stop_id ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM first) WHERE before IS NULL OR arrival < before)"""


@query(f"{_REACH} SELECT stop_id, round, arrival FROM label")
def raptor_rounds(f: Feed) -> DataFrame:
    return routing.earliest_arrivals(f.stop_time, _seed(f), None, 10, 70_000)


def _seed(f: Feed) -> DataFrame:
    return f.spark.createDataFrame([(1, 30_000)], "stop_id long, arrival long")


@query(f"{_REACH} SELECT stop_id, min(arrival) - 30000 AS duration, greatest(0, arg_min(round, arrival) - 1)::INT AS transfers FROM label GROUP BY 1")
def isochrone_rows(f: Feed) -> DataFrame:
    return routing.isochrone(routing.earliest_arrivals(f.stop_time, _seed(f), None, 10, 70_000), 30_000, 40_000)


_EDGES = "edge AS (SELECT stop_id AS a, lead(stop_id) OVER (PARTITION BY trip_id ORDER BY rank) AS b FROM stop_time), step AS (SELECT a, b, min(300 + (a * 7 + b * 13) % 600)::BIGINT AS cost FROM edge WHERE b IS NOT NULL AND a <> b GROUP BY 1, 2)"


def _edges(f: Feed) -> DataFrame:
    rows = f.stop_time.select(F.col("stop_id").alias("a"), F.lead("stop_id").over(Window.partitionBy("trip_id").orderBy("rank")).alias("b")).where("b is not null and a <> b").distinct()
    return rows.withColumn("cost", 300 + (F.col("a") * 7 + F.col("b") * 13) % 600)


@query(f"""WITH RECURSIVE {_EDGES}, walk(origin, node, cost) AS (SELECT a, a, 0::BIGINT FROM (VALUES (1::BIGINT), (2), (3)) v(a) UNION SELECT origin, b, walk.cost + step.cost FROM walk JOIN step ON node = a WHERE walk.cost + step.cost <= 1000)
    SELECT origin, node, min(cost)::BIGINT AS cost FROM walk GROUP BY 1, 2""")
def street_shortest(f: Feed) -> DataFrame:
    origins = f.spark.createDataFrame([(k, k) for k in (1, 2, 3)], "origin long, node long")
    return routing.shortest_paths(_edges(f), origins, 1000).select("origin", "node", "cost")


@query("SELECT id, size, price FROM stop_point a WHERE NOT EXISTS (SELECT 1 FROM stop_point b WHERE b.size <= a.size AND b.price <= a.price AND (b.size < a.size OR b.price < a.price))")
def pareto_skyline(f: Feed) -> DataFrame:
    return routing.skyline(f.stop_point.select("id", "size", "price"), "size", "price")


@query("""WITH j AS (SELECT id, route_id, start, price, (id % 5)::INT AS transfers FROM trip)
    SELECT id, route_id FROM j a WHERE NOT EXISTS (SELECT 1 FROM j b WHERE a.route_id = b.route_id AND b.start <= a.start AND b.price <= a.price AND b.transfers <= a.transfers AND (b.start < a.start OR b.price < a.price OR b.transfers < a.transfers))""")
def second_pass_starts(f: Feed) -> DataFrame:
    rows = f.trip.select("id", "route_id", "start", "price", (F.col("id") % 5).cast("int").alias("transfers"))
    return routing.undominated(rows, "route_id", "id", ["start", "price", "transfers"]).select("id", "route_id")


@query("""WITH r AS (SELECT line_id, day, stop_id % 50 AS stop, trip_id, min(arrival) AS arrival FROM stop_time JOIN trip ON trip.id = trip_id JOIN route ON route.id = route_id GROUP BY 1, 2, 3, 4)
    SELECT a.line_id, a.day, a.trip_id AS a, b.trip_id AS b, sum(sign(b.arrival - a.arrival))::BIGINT AS votes FROM r a JOIN r b ON a.line_id = b.line_id AND a.day = b.day AND a.stop = b.stop AND a.trip_id <> b.trip_id GROUP BY 1, 2, 3, 4 HAVING votes > 0""")
def pairwise_votes(f: Feed) -> DataFrame:
    """A page holds a line's trips of one day."""
    return routing.pairwise_votes(f.stop_time.withColumn("stop_id", F.col("stop_id") % 50), _line_trips(f), ["line_id", "day"])


def _line_trips(f: Feed) -> DataFrame:
    return f.trip.select("id", "route_id", "day", "start").join(f.route.select(F.col("id").alias("route_id"), "line_id"), "route_id").select("id", "line_id", "day", "start")


@query()
def ranked_pairs(f: Feed) -> DataFrame:
    return routing.ranked_pages(f.stop_time.withColumn("stop_id", F.col("stop_id") % 50), _line_trips(f), ["line_id", "day"])


@query()
def thermometer(f: Feed) -> DataFrame:
    lists = f.stop_time.groupBy("trip_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "stop_id"))), lambda s: s["stop_id"]).alias("stops"))
    return routing.thermometer(lists.join(f.trip.select(F.col("id").alias("trip_id"), "route_id"), "trip_id"))


# Fares


_RIDES = """ride AS (SELECT id, (id * 7 % 40)::VARCHAR AS o_stop, kind AS o_mode, (k % 5)::VARCHAR AS o_zone, (id * 11 % 40)::VARCHAR AS d_stop, CASE WHEN k % 2 = 0 THEN 'click' ELSE 'view' END AS d_mode, (k % 3)::VARCHAR AS d_zone FROM event),
    fare(o_level, o_key, d_level, d_key, ticket) AS (VALUES (0, '7', 0, '11', 1), (0, '14', 1, 'view', 2), (1, 'click', 2, '1', 3), (2, '3', 2, '2', 4), (1, 'error', 1, 'click', 5), (2, '0', 0, '22', 6)),
    o AS (SELECT id, unnest([{'l': 0, 'k': o_stop}, {'l': 1, 'k': o_mode}, {'l': 2, 'k': o_zone}]) AS o, d_stop, d_mode, d_zone FROM ride), d AS (SELECT id, o, unnest([{'l': 0, 'k': d_stop}, {'l': 1, 'k': d_mode}, {'l': 2, 'k': d_zone}]) AS d FROM o)"""


@query(f"WITH {_RIDES} SELECT id, ticket, o_level, d_level FROM d JOIN fare ON o.l = o_level AND o.k = o_key AND d.l = d_level AND d.k = d_key QUALIFY row_number() OVER (PARTITION BY id ORDER BY o_level, d_level, ticket) = 1")
def fare_od(f: Feed) -> DataFrame:
    s = lambda c: c.cast("string")
    id_, k = F.col("id"), F.col("k")
    rides = f.event.select("id", s(id_ * 7 % 40).alias("o_stop"), F.col("kind").alias("o_mode"), s(k % 5).alias("o_zone"), s(id_ * 11 % 40).alias("d_stop"), F.when(k % 2 == 0, "click").otherwise("view").alias("d_mode"), s(k % 3).alias("d_zone"))
    told = f.spark.createDataFrame([(0, "7", 0, "11", 1), (0, "14", 1, "view", 2), (1, "click", 2, "1", 3), (2, "3", 2, "2", 4), (1, "error", 1, "click", 5), (2, "0", 0, "22", 6)], "o_level int, o_key string, d_level int, d_key string, ticket int")
    return fares.od_tickets(rides, told)


@query("""WITH price(ticket, begin, "end", price) AS (VALUES ('1-URGENT', DATE '1995-01-01', DATE '1997-01-01', 100), ('1-URGENT', DATE '1996-06-01', DATE '2002-01-01', 120), ('2-HIGH', DATE '1995-01-01', DATE '2002-01-01', 90))
    SELECT id, ticket, day, price.price FROM trip JOIN price ON ticket = headsign AND day >= begin AND day < "end" QUALIFY row_number() OVER (PARTITION BY id ORDER BY begin, price.price) = 1""")
def fare_dated_price(f: Feed) -> DataFrame:
    told = f.spark.sql("SELECT * FROM VALUES ('1-URGENT', DATE '1995-01-01', DATE '1997-01-01', 100), ('1-URGENT', DATE '1996-06-01', DATE '2002-01-01', 120), ('2-HIGH', DATE '1995-01-01', DATE '2002-01-01', 90) AS t(ticket, begin, end, price)")
    return fares.dated_prices(f.trip.select("id", F.col("headsign").alias("ticket"), "day"), told)


@query()
def fare_best(f: Feed) -> DataFrame:
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    journey = F.concat_ws("/", F.col("entity_id").cast("string"), F.to_date("ts").cast("string"))
    nth = F.row_number().over(Window.partitionBy("journey_id").orderBy("ts", "id"))
    return fares.best_fares(f.event.withColumn("journey_id", journey).withColumn("nth", nth).select("journey_id", "nth", at.alias("at"), "kind"))


@query("SELECT id, route_id FROM trip QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY id % 2, price, id % 3, id % 4, id) = 1")
def fare_cheapest(f: Feed) -> DataFrame:
    k = F.col("id")
    options = f.trip.select("id", "route_id", (k % 2).alias("undefined"), F.col("price").alias("cost"), (k % 3).alias("tickets"), (k % 4).alias("changes"))
    return fares.cheapest(options, "route_id").select("id", "route_id")


# Disruptions and realtime


_IMPACTS = """impact AS (SELECT id AS impact_id, entity_id * 10 AS route_id, ts - INTERVAL 10000 DAY AS begin, ts - INTERVAL 9940 DAY AS "end" FROM event WHERE kind = 'error')"""


def _impacts(f: Feed) -> DataFrame:
    return f.event.where("kind = 'error'").select(F.col("id").alias("impact_id"), (F.col("entity_id") * 10).alias("route_id"), (F.col("ts") - F.expr("interval 10000 days")).alias("begin"), (F.col("ts") - F.expr("interval 9940 days")).alias("end"))


@query(f'WITH {_TRIP_PERIODS}, {_IMPACTS} SELECT t.id, impact_id FROM trip_period t JOIN impact i ON t.route_id = i.route_id AND t.begin < i."end" AND t."end" > i.begin')
def disruption_interval_join(f: Feed) -> DataFrame:
    return disruptions.impacted(_trip_periods(f), _impacts(f), "route_id", slot_hours=24 * 14)


@query(f'WITH {_TRIP_PERIODS}, {_IMPACTS} SELECT id, day FROM trip WHERE id NOT IN (SELECT t.id FROM trip_period t JOIN impact i ON t.route_id = i.route_id AND t.begin < i."end" AND t."end" > i.begin)')
def trip_day_cancel(f: Feed) -> DataFrame:
    hits = disruptions.impacted(_trip_periods(f), _impacts(f), "route_id", slot_hours=24 * 14)
    return disruptions.cancelled_days(f.trip.select("id", "day"), hits)


@query("""WITH p AS (SELECT trip_id, stop_id, day + to_seconds(departure) AS ts FROM stop_time JOIN trip ON trip.id = trip_id), c AS (SELECT entity_id AS stop_id, ts - INTERVAL 9000 DAY AS begin, ts - INTERVAL 8970 DAY AS "end" FROM event WHERE kind = 'signup')
    SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.stop_id = p.stop_id AND p.ts >= begin AND p.ts < "end")""")
def stop_closure(f: Feed) -> DataFrame:
    ts = F.col("day").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("departure"))
    passages = f.stop_time.join(f.trip.select(F.col("id").alias("trip_id"), "day"), "trip_id").select("trip_id", "stop_id", ts.alias("ts"))
    closures = f.event.where("kind = 'signup'").select(F.col("entity_id").alias("stop_id"), (F.col("ts") - F.expr("interval 9000 days")).alias("begin"), (F.col("ts") - F.expr("interval 8970 days")).alias("end"))
    return disruptions.without_closed_stops(passages, closures)


_AREAS = "s AS (SELECT trip_id, rank, area FROM stop_time JOIN stop_point p ON p.id = stop_id)"


@query(f"""WITH {_AREAS}, m AS (SELECT *, last_value(CASE WHEN area < 'Brand#15' THEN rank END IGNORE NULLS) OVER (PARTITION BY trip_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS from_rank FROM s)
    SELECT trip_id, from_rank, min(rank) AS to_rank FROM m WHERE area >= 'Brand#15' AND from_rank IS NOT NULL GROUP BY 1, 2""")
def line_section(f: Feed) -> DataFrame:
    rows = _stop_areas(f).withColumn("area", F.when(F.col("area") < "Brand#15", "A").otherwise("B"))
    return disruptions.section_ranks(rows, "A", "B")


def _stop_areas(f: Feed) -> DataFrame:
    return f.stop_time.select("trip_id", "rank", "stop_id").join(f.stop_point.select(F.col("id").alias("stop_id"), "area"), "stop_id").select("trip_id", "rank", "area")


@query(f"WITH {_AREAS} SELECT * FROM s QUALIFY rank >= min(CASE WHEN area = 'Brand#9' THEN rank END) OVER (PARTITION BY trip_id)")
def no_service_tail(f: Feed) -> DataFrame:
    return disruptions.no_service_tail(_stop_areas(f), "Brand#9")


@query("WITH e AS (SELECT route_id, (id % 9)::INT AS n FROM trip) SELECT route_id, ['NO_SERVICE', 'REDUCED_SERVICE', 'SIGNIFICANT_DELAYS', 'DETOUR', 'ADDITIONAL_SERVICE', 'MODIFIED_SERVICE', 'OTHER_EFFECT', 'UNKNOWN_EFFECT', 'STOP_MOVED'][min(n) + 1] AS effect FROM e GROUP BY 1")
def worst_effect(f: Feed) -> DataFrame:
    effect = F.element_at(F.array(*map(F.lit, disruptions.EFFECTS)), (F.col("id") % 9 + 1).cast("int"))
    return disruptions.worst_effects(f.trip.select("route_id", effect.alias("effect")), "route_id")


@query("SELECT id, CASE WHEN ts <= TIMESTAMP '2024-01-15' AND TIMESTAMP '2024-01-15' < ts + to_hours(k) THEN 'active' WHEN ts >= TIMESTAMP '2024-01-15' THEN 'future' ELSE 'past' END AS status FROM event")
def impact_status(f: Feed) -> DataFrame:
    end = F.col("ts") + F.make_dt_interval(hours=F.col("k"))
    return f.event.select("id", C.status_at(F.lit("2024-01-15").cast("timestamp_ntz"), F.col("ts"), end).alias("status"))


_LATEST = "SELECT id, ts, entity_id, kind, value FROM event QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, id DESC) = 1"


@query(_LATEST)
def rt_latest_wins(f: Feed) -> DataFrame:
    return disruptions.latest(f.event.drop("k"))


@query(f"SELECT * FROM ({_LATEST}) WHERE kind <> 'signup'")
def rt_tombstone(f: Feed) -> DataFrame:
    return disruptions.surviving(f.event.drop("k"), "signup")


@query("""SELECT id, ts, entity_id, kind, value FROM event QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY (kind = 'purchase') DESC, ts DESC, id DESC) = 1""")
def rt_upsert(f: Feed) -> DataFrame:
    rows = f.event.drop("k")
    return disruptions.upserted(disruptions.latest(rows.where("kind <> 'purchase'")), rows.where("kind = 'purchase'"))


@query(_LATEST)
def rt_stream_latest(f: Feed) -> DataFrame:
    return realtime.latest_by_stream(f.spark, f"{f.dir}/event[s].parquet")  # a pattern: file or folder


@query("SELECT kind, floor(min(date_diff('microsecond', ts, TIMESTAMP '2024-02-01')) / 1e6)::BIGINT AS youngest, floor(avg(date_diff('microsecond', ts, TIMESTAMP '2024-02-01')) / 1e6)::BIGINT AS mean, floor(max(date_diff('microsecond', ts, TIMESTAMP '2024-02-01')) / 1e6)::BIGINT AS oldest FROM event GROUP BY 1")
def rt_ages(f: Feed) -> DataFrame:
    return disruptions.message_ages(f.event, F.lit("2024-02-01").cast("timestamp_ntz"))


_REPORT = """impacts AS (SELECT e.id AS impact_id, network_id, line.id AS line_id, CASE e.k % 3 WHEN 0 THEN 'network' WHEN 1 THEN 'line' ELSE 'route' END AS object_kind FROM event e JOIN line ON line.id = e.entity_id % 25 WHERE kind = 'error')"""


def _report(f: Feed) -> DataFrame:
    lines = f.line.select(F.col("id").alias("line_id"), "network_id")
    kind = F.when(F.col("k") % 3 == 0, "network").when(F.col("k") % 3 == 1, "line").otherwise("route")
    return f.event.where("kind = 'error'").select(F.col("id").alias("impact_id"), (F.col("entity_id") % 25).alias("line_id"), kind.alias("object_kind")).join(lines, "line_id")


@query(f"WITH {_REPORT} SELECT network_id, object_kind, string_agg(DISTINCT impact_id::VARCHAR, ',' ORDER BY lpad(impact_id::VARCHAR, 20, '0')) AS impacts FROM impacts GROUP BY 1, 2".replace("string_agg(DISTINCT impact_id::VARCHAR, ',' ORDER BY lpad(impact_id::VARCHAR, 20, '0'))", "string_agg(impact_id::VARCHAR, ',' ORDER BY impact_id)"))
def traffic_report(f: Feed) -> DataFrame:
    return disruptions.traffic_report(_report(f))


@query(f"WITH {_REPORT} SELECT line_id, count(DISTINCT impact_id) FILTER (WHERE object_kind = 'network')::BIGINT AS network_impacts, count(DISTINCT impact_id) FILTER (WHERE object_kind = 'line')::BIGINT AS line_impacts, count(DISTINCT impact_id) FILTER (WHERE object_kind = 'route')::BIGINT AS route_impacts FROM impacts GROUP BY 1")
def line_report(f: Feed) -> DataFrame:
    return disruptions.line_report(f.line.select(F.col("id").alias("line_id")), _report(f).drop("network_id"))


@query("""WITH s AS (SELECT DISTINCT line_id, area, stop_id FROM stop_time JOIN trip ON trip.id = trip_id JOIN route ON route.id = route_id JOIN stop_point p ON p.id = stop_id WHERE size > 45)
    SELECT line_id, area, string_agg(stop_id::VARCHAR, ',' ORDER BY stop_id) AS stops FROM s GROUP BY 1, 2""")
def equipment_report(f: Feed) -> DataFrame:
    stops = f.stop_point.where("size > 45").select(F.col("id").alias("stop_id"), "area")
    trips = f.trip.select(F.col("id").alias("trip_id"), "route_id").join(f.route.select(F.col("id").alias("route_id"), "line_id"), "route_id")
    return disruptions.equipment_report(f.stop_time.select("trip_id", "stop_id").join(stops, "stop_id").join(trips, "trip_id"))


@query(f"""WITH {_TRIP_PERIODS} SELECT line_id, count(*)::BIGINT AS trips, min(t.id) AS first_trip FROM trip_period t JOIN route ON route.id = t.route_id WHERE begin <= TIMESTAMP '1998-03-14 06:00:00' AND "end" > TIMESTAMP '1998-03-14 06:00:00' GROUP BY 1""")
def vehicle_positions(f: Feed) -> DataFrame:
    now = F.lit("1998-03-14 06:00:00").cast("timestamp_ntz")
    active = _trip_periods(f).where((F.col("begin") <= now) & (F.col("end") > now)).join(f.route.select(F.col("id").alias("route_id"), "line_id"), "route_id")
    return active.groupBy("line_id").agg(F.count(F.lit(1)).alias("trips"), F.min("id").alias("first_trip"))


# Journeys


@query("SELECT id, route_id FROM trip QUALIFY row_number() OVER (PARTITION BY route_id, headsign, status ORDER BY start, price, id) = 1")
def journey_similar(f: Feed) -> DataFrame:
    return journeys.best_of_similar(f.trip, "route_id", ["headsign", "status"], ["start", "price", "id"]).select("id", "route_id")


@query("SELECT id, route_id FROM (SELECT *, min(CASE WHEN status <> 'P' THEN start END) OVER (PARTITION BY route_id) AS best FROM trip) WHERE status <> 'P' OR best IS NULL OR start < best")
def journey_odt(f: Feed) -> DataFrame:
    rows = f.trip.select("id", "route_id", F.col("start").alias("arrival"), (F.col("status") == "P").alias("on_demand"))
    return journeys.on_demand_kept(rows, "route_id").select("id", "route_id")


@query("SELECT id, route_id FROM (SELECT *, id % 6 AS c, min(id % 6) OVER (PARTITION BY route_id) AS best FROM trip) WHERE c <= best + 1")
def journey_connections(f: Feed) -> DataFrame:
    return journeys.few_connections(f.trip.withColumn("connections", F.col("id") % 6), "route_id", 1).select("id", "route_id")


@query("SELECT id, route_id FROM (SELECT *, min(start) OVER (PARTITION BY route_id) AS best FROM trip) WHERE start <= best * 1.5 + 3600")
def late_filter(f: Feed) -> DataFrame:
    return journeys.not_late(f.trip.withColumn("pseudo_duration", F.col("start")), "route_id", 1.5, 3600).select("id", "route_id")


@query("""SELECT route_id, 'best' AS type, arg_min(id, struct_pack(start, price, id)) AS id FROM trip GROUP BY 1 UNION ALL SELECT route_id, 'cheap', arg_min(id, struct_pack(price, start, id)) FROM trip WHERE status <> 'P' GROUP BY 1
    UNION ALL SELECT route_id, 'comfort', arg_min(id, struct_pack(c := id % 6, start, id)) FROM trip WHERE id % 6 <= 2 GROUP BY 1""")
def journey_type(f: Feed) -> DataFrame:
    rows = f.trip.withColumn("connections", F.col("id") % 6)
    return journeys.typed(rows, "route_id", {"best": (F.lit(True), ["start", "price"]), "cheap": (F.col("status") != "P", ["price", "start"]), "comfort": (F.col("connections") <= 2, ["connections", "start"])})


@query("""SELECT trip_id, sum(CASE WHEN mode = 'F' THEN length * 2 ELSE 0 END) AS duration_f, sum(CASE WHEN mode = 'O' THEN length * 2 ELSE 0 END) AS duration_o, sum(length) AS length, round(sum(CASE WHEN mode = 'O' THEN length / 1000 * 0.2 END), 6) AS emission FROM stop_time GROUP BY 1""")
def journey_totals(f: Feed) -> DataFrame:
    sections = f.stop_time.select("trip_id", "mode", "length", (F.col("length") * 2).alias("duration"), F.when(F.col("mode") == "O", F.col("length") / 1000 * 0.2).alias("emission"))
    return journeys.totals(sections, "trip_id", ["F", "O"]).withColumn("emission", F.round("emission", 6))


@query("WITH s AS (SELECT trip_id, company_id % 5 AS mode, sum(length) AS weight FROM stop_time GROUP BY 1, 2) SELECT trip_id, mode FROM s QUALIFY row_number() OVER (PARTITION BY trip_id ORDER BY weight DESC, mode) = 1")
def heaviest_mode(f: Feed) -> DataFrame:
    weights = f.stop_time.groupBy("trip_id", (F.col("company_id") % 5).alias("mode")).agg(F.sum("length").alias("weight"))
    return journeys.heaviest_mode(weights, "trip_id")


@query("SELECT trip_id FROM stop_time GROUP BY 1 HAVING coalesce(max(CASE WHEN mode = 'F' THEN length END), 0) < 30")
def waiting_filter(f: Feed) -> DataFrame:
    sections = f.stop_time.select("trip_id", F.when(F.col("mode") == "F", "waiting").otherwise("ride").alias("kind"), F.col("length").alias("duration"))
    return journeys.waiting_within(sections, "trip_id", 30)


@query("WITH p AS (SELECT trip_id, string_agg((company_id % 3)::VARCHAR, '>' ORDER BY rank) AS path FROM stop_time GROUP BY 1) SELECT path, min(trip_id) AS trip_id, count(*)::BIGINT AS journeys FROM p GROUP BY 1")
def journey_aggregate(f: Feed) -> DataFrame:
    return journeys.aggregated(f.stop_time.select("trip_id", "rank", (F.col("company_id") % 3).alias("section")), "trip_id")


# Remaining answers


@query("SELECT 'network' AS kind, count(*)::BIGINT AS n FROM network UNION ALL SELECT 'line', count(*) FROM line UNION ALL SELECT 'route', count(*) FROM route UNION ALL SELECT 'stop_point', count(*) FROM stop_point")
def geo_status(f: Feed) -> DataFrame:
    return requests.geo_status(network=f.network, line=f.line, route=f.route, stop_point=f.stop_point)


@query("""WITH a AS (SELECT stop_id, min(rank * 60)::BIGINT AS duration, 0 AS priority FROM stop_time WHERE mode = 'O' GROUP BY 1 UNION ALL SELECT id, (id % 900)::BIGINT, 1 FROM stop_point)
    SELECT stop_id, duration, priority FROM a QUALIFY row_number() OVER (PARTITION BY stop_id ORDER BY priority) = 1""")
def access_stops(f: Feed) -> DataFrame:
    own = f.stop_time.where("mode = 'O'").select("stop_id", (F.col("rank") * 60).cast("long").alias("duration"))
    return requests.access_stops([own, f.stop_point.select(F.col("id").alias("stop_id"), (F.col("id") % 900).alias("duration"))])


@query("SELECT id, CASE WHEN id < 10 THEN 'network' WHEN id < 100 THEN 'company' ELSE 'route' END AS kind FROM route WHERE id >= 100 UNION ALL SELECT id, 'network' FROM network UNION ALL SELECT id, 'company' FROM company WHERE id NOT IN (SELECT id FROM network) UNION ALL SELECT id, 'route' FROM route WHERE id < 100 AND id NOT IN (SELECT id FROM network) AND id NOT IN (SELECT id FROM company)")
def place_uri(f: Feed) -> DataFrame:
    return requests.first_found([t.select("id", F.lit(k).alias("kind")) for k, t in (("network", f.network), ("company", f.company), ("route", f.route))], "id").select("id", "kind")


ORACLE_SQL["place_uri"] = ORACLE_SQL["place_uri"].replace("SELECT id, CASE WHEN id < 10 THEN 'network' WHEN id < 100 THEN 'company' ELSE 'route' END AS kind FROM route WHERE id >= 100 UNION ALL", "SELECT id, 'route' AS kind FROM route WHERE id >= 100 AND id NOT IN (SELECT id FROM company) UNION ALL")


@query(f"SELECT id, round(coalesce(CASE WHEN id % 2 = 0 THEN id * 100.0e0 END, {_distance('lon', 'lat', '2.5', '48.5')} * 1.35) / 1000 * 184, 3) AS emission FROM route")
def car_co2(f: Feed) -> DataFrame:
    given = F.when(F.col("id") % 2 == 0, F.col("id") * 100.0)
    return f.route.select("id", F.round(requests.car_emission(F.col("lon"), F.col("lat"), F.lit(2.5), F.lit(48.5), given, 184.0), 3).alias("emission"))


@query("WITH n AS (SELECT entity_id, arg_max(kind, ts) AS status FROM event WHERE k < 50 GROUP BY 1) SELECT id, coalesce(status, 'unknown') AS status FROM stop_point LEFT JOIN n ON entity_id = id")
def equipment_overlay(f: Feed) -> DataFrame:
    status = f.event.where("k < 50").select(F.col("entity_id").alias("id"), F.col("kind").alias("status"), F.col("ts").alias("updated"))
    return requests.overlaid_status(f.stop_point.select("id"), status, "id")


@query("SELECT entity_id, id, ts, row_number() OVER (PARTITION BY entity_id ORDER BY ts, id)::INT AS nth FROM event WHERE ts >= TIMESTAMP '2024-01-20' AND ts <= TIMESTAMP '2024-01-22' QUALIFY nth <= 2")
def realtime_window(f: Feed) -> DataFrame:
    return requests.realtime_window(f.event.select("entity_id", "id", "ts"), "entity_id", F.lit("2024-01-20").cast("timestamp_ntz"), 172_800, 2)


@query(f"WITH z AS (SELECT lon AS zl, lat AS za FROM route WHERE id IN (1, 2, 3)) SELECT id FROM stop_point WHERE NOT EXISTS (SELECT 1 FROM z WHERE {_distance('lon', 'lat', 'zl', 'za')} <= 8000)")
def excluded_zones(f: Feed) -> DataFrame:
    zones = f.route.where("id in (1, 2, 3)").select(F.col("lon").alias("zone_lon"), F.col("lat").alias("zone_lat"), F.lit(8000).alias("radius"))
    return requests.outside_zones(f.stop_point.select("id", "lon", "lat"), zones).select("id")


@query("SELECT line.id, concat_ws(' ', CASE WHEN network.name <> line.name THEN network.name END, line.name, line.id::VARCHAR) AS label FROM line JOIN network ON network.id = network_id")
def line_label(f: Feed) -> DataFrame:
    rows = f.line.join(f.network.select(F.col("id").alias("network_id"), F.col("name").alias("network")), "network_id")
    return rows.select("id", requests.line_label(F.col("network"), F.col("name"), F.col("id").cast("string"), F.col("name")).alias("label"))


@query("SELECT id, row_number() OVER (ORDER BY network_id, split_part(name, '_', 1), split_part(name, '_', 2)::INT, id) - 1 AS idx FROM line")
def natural_line_order(f: Feed) -> DataFrame:
    return sets.indexed(f.line.withColumn("code", requests.natural_order(F.col("name"))), "network_id", "code", "id").select("id", "idx")


@query("SELECT id, entity_id FROM event QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, id DESC) > 10 AND kind <> 'view'")
def dataset_purge(f: Feed) -> DataFrame:
    rows = f.event.select("id", "entity_id", F.col("ts").alias("created"), (F.col("kind") == "view").alias("running"))
    return requests.stale(rows, "entity_id", 10).select("id", "entity_id")


@query("SELECT stop_id, min(rank * 60 + company_id % 300)::BIGINT AS duration FROM stop_time GROUP BY 1 HAVING min(rank * 60 + company_id % 300) < 120")
def access_by_entrance(f: Feed) -> DataFrame:
    ways = f.stop_time.select("stop_id", F.col("company_id").alias("entrance_id"), (F.col("rank") * 60).cast("long").alias("duration"))
    return requests.access_by_entrance(ways, f.company.select(F.col("id").alias("entrance_id"), (F.col("id") % 300).alias("traversal_time")), 120)


@query("WITH b AS (SELECT line_id, bit_or((id % 4 & (id // 7 % 4))::INT) AS bits FROM route GROUP BY 1) SELECT line_id, CASE WHEN bits = 0 THEN 'scheduled' WHEN bits & 2 = 0 THEN 'with_stops' ELSE 'zonal' END AS odt_level FROM b")
def odt_level(f: Feed) -> DataFrame:
    bits = (F.col("id") % 4).bitwiseAND(F.floor(F.col("id") / 7) % 4).cast("int")
    return requests.odt_level(f.route.select("line_id", bits.alias("bits")), "line_id")


@query("WITH s AS (SELECT line_id AS component, count(*)::BIGINT AS n FROM route GROUP BY 1) SELECT component, n FROM s WHERE n >= (SELECT max(n) FROM s) * 0.6")
def large_components(f: Feed) -> DataFrame:
    return requests.large_components(f.route.select(F.col("line_id").alias("component"), F.col("id").alias("node")), 0.6)
