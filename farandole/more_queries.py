"""Further registered queries of the transit operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farandole.functions import columns as C
from farandole.operators import details, routing, sets, text
from farandole.plans.feed import Feed
from farandole.queries import ORACLE_SQL, QUERIES, _edges, _EDGES, query

__all__ = ["ORACLE_SQL", "QUERIES"]


def _statuses(f: Feed) -> DataFrame:
    told = F.when(F.col("k") % 11 == 0, "ADDED_FOR_DETOUR")
    relationship = F.when(F.col("kind") == "error", "SKIPPED").when(F.col("kind") == "signup", "ADDED")
    return f.event.select("id", "entity_id", details.event_status(told, F.coalesce(relationship, F.lit("SCHEDULED")), F.when(F.col("k") % 3 > 0, F.col("k") % 3 - 1)).alias("status"))


_STATUS = "status AS (SELECT id, entity_id, CASE WHEN k % 11 = 0 THEN 'ADDED_FOR_DETOUR' WHEN kind = 'error' THEN 'DELETED' WHEN kind = 'signup' THEN 'ADDED' WHEN k % 3 <> 1 THEN 'DELAYED' ELSE 'UNCHANGED' END AS status FROM event)"


@query(f"WITH {_STATUS} SELECT id, entity_id, status FROM status")
def rt_event_status(f: Feed) -> DataFrame:
    return _statuses(f)


@query(f"""WITH {_STATUS}, d AS (SELECT s.*, e.ts::DATE AS day FROM status s JOIN event e USING (id)), w AS (SELECT entity_id * 1000 + dayofyear(day) AS trip_id, max(list_position(['UNCHANGED', 'ADDED', 'ADDED_FOR_DETOUR', 'DELETED', 'DELETED_FOR_DETOUR', 'DELAYED'], status)) AS n FROM d GROUP BY 1)
    SELECT trip_id, ['UNCHANGED', 'ADDED', 'ADDED_FOR_DETOUR', 'DELETED', 'DELETED_FOR_DETOUR', 'DELAYED'][n] AS status, ['UNKNOWN_EFFECT', 'MODIFIED_SERVICE', 'DETOUR', 'REDUCED_SERVICE', 'DETOUR', 'SIGNIFICANT_DELAYS'][n] AS effect FROM w""")
def rt_trip_effect(f: Feed) -> DataFrame:
    days = f.event.select("id", F.dayofyear("ts").alias("doy"))
    rows = _statuses(f).join(days, "id").withColumn("trip_id", F.col("entity_id") * 1000 + F.col("doy"))
    return details.trip_effects(rows, "trip_id")


@query("""WITH a AS (SELECT trip_id, list('B' || (stop_id % 4)::VARCHAR ORDER BY rank) AS areas FROM stop_time GROUP BY 1)
    SELECT trip_id FROM a WHERE list_position(areas, 'B1') > 0 AND list_slice(areas, list_position(areas, 'B1'), list_position(areas, 'B1') + 1) = ['B1', 'B3']""")
def rail_section(f: Feed) -> DataFrame:
    area = F.concat(F.lit("B"), (F.col("stop_id") % 4).cast("string"))
    areas = f.stop_time.groupBy("trip_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", area.alias("area")))), lambda s: s["area"]).alias("areas"))
    return areas.where(details.matches_from_first(F.col("areas"), ["B1", "B3"])).select("trip_id")


@query("""WITH c AS (SELECT id, lon, lat, lat * 0.01745329238 AS la, (id % 5000 + 100) / 6372797.560856 AS d, k, k * (2 * pi() / 180) AS b FROM company, range(180) r(k)),
    p AS (SELECT id, lon, k, b, d, la, asin(sin(la) * cos(d) + cos(la) * sin(d) * cos(b)) AS t FROM c)
    SELECT id, k::INT AS corner, round(lon + atan2(sin(b) * sin(d) * cos(la), cos(d) - sin(la) * sin(t)) / 0.01745329238, 7) AS lon, round(t / 0.01745329238, 7) AS lat FROM p""")
def circle_polygon(f: Feed) -> DataFrame:
    ring = details.circle(F.col("lon"), F.col("lat"), F.col("id") % 5000 + 100)
    rows = f.company.select("id", F.posexplode(ring).alias("corner", "p"))
    return rows.select("id", "corner", F.round("p.lon", 7).alias("lon"), F.round("p.lat", 7).alias("lat"))


@query("""WITH h AS (SELECT line_id AS way_id, id % 200 AS number, min(lon) AS lon, min(lat) AS lat FROM route GROUP BY 1, 2), q AS (SELECT id AS query_id, line_id AS way_id, id * 7 % 230 AS wanted FROM company),
    l AS (SELECT query_id, arg_max(struct_pack(n := number, lon, lat), number) AS e FROM q JOIN h USING (way_id) WHERE number % 2 = wanted % 2 AND number <= wanted GROUP BY 1),
    u AS (SELECT query_id, arg_min(struct_pack(n := number, lon, lat), number) AS e FROM q JOIN h USING (way_id) WHERE number % 2 = wanted % 2 AND number >= wanted GROUP BY 1),
    b AS (SELECT query_id, wanted, coalesce(l.e, u.e) AS lo, coalesce(u.e, l.e) AS hi FROM q LEFT JOIN l USING (query_id) LEFT JOIN u USING (query_id) WHERE l.e IS NOT NULL OR u.e IS NOT NULL)
    SELECT query_id, round(lo.lon + (hi.lon - lo.lon) * CASE WHEN hi.n > lo.n THEN (wanted - lo.n) / (hi.n - lo.n) ELSE 0 END, 7) AS lon, round(lo.lat + (hi.lat - lo.lat) * CASE WHEN hi.n > lo.n THEN (wanted - lo.n) / (hi.n - lo.n) ELSE 0 END, 7) AS lat FROM b""")
def house_number(f: Feed) -> DataFrame:
    houses = f.route.groupBy(F.col("line_id").alias("way_id"), (F.col("id") % 200).alias("number")).agg(F.min("lon").alias("lon"), F.min("lat").alias("lat"))
    asked = f.company.select(F.col("id").alias("query_id"), F.col("line_id").alias("way_id"), (F.col("id") * 7 % 230).alias("number"))
    return details.house_positions(asked, houses).select("query_id", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"))


@query("SELECT id, route_id, start AS at, row_number() OVER (PARTITION BY route_id ORDER BY (start - 50000 + 86400) % 86400, id)::INT AS nth FROM trip")
def rotated_times(f: Feed) -> DataFrame:
    return details.rotated(f.trip.select("id", "route_id", F.col("start").alias("at")), "route_id", 50_000)


@query("""WITH w AS (SELECT route_id, date_trunc('week', day)::DATE AS week, bit_or(1 << (isodow(day) - 1)::INT)::INT AS mask FROM trip GROUP BY 1, 2),
    i AS (SELECT *, (week - DATE '2000-01-03') // 7 - row_number() OVER (PARTITION BY route_id, mask ORDER BY week) AS island FROM w)
    SELECT route_id, mask, min(week) AS begin, count(*)::BIGINT AS weeks FROM i GROUP BY route_id, mask, island""")
def week_groups(f: Feed) -> DataFrame:
    return details.week_groups(f.trip.select("route_id", "day").distinct(), "route_id")


@query(f"""WITH RECURSIVE {_EDGES}, walk(origin, node, cost) AS (SELECT a, a, 0::BIGINT FROM (VALUES (1::BIGINT), (2), (3)) v(a) UNION SELECT origin, b, walk.cost + step.cost FROM walk JOIN step ON node = a WHERE walk.cost + step.cost <= 800),
    best AS (SELECT origin, node, min(cost)::BIGINT AS cost FROM walk GROUP BY 1, 2), d AS (SELECT unnest([1::BIGINT, 5, 17, 42, 99, -1]) AS destination)
    SELECT o.origin, destination, cost, CASE WHEN cost IS NOT NULL THEN 'reached' WHEN destination IN (SELECT a FROM step UNION SELECT b FROM step) THEN 'unreached' ELSE 'unknown' END AS status
    FROM (VALUES (1::BIGINT), (2), (3)) o(origin) CROSS JOIN d LEFT JOIN best ON best.origin = o.origin AND best.node = destination""")
def distance_matrix(f: Feed) -> DataFrame:
    origins = f.spark.createDataFrame([(k, k) for k in (1, 2, 3)], "origin long, node long")
    destinations = f.spark.createDataFrame([(k,) for k in (1, 5, 17, 42, 99, -1)], "destination long")
    edges = _edges(f)
    known = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node")))
    return details.distance_matrix(routing.shortest_paths(edges, origins, 800), origins, destinations, known)


@query("SELECT trip_id, rank, greatest(0, lead(arrival) OVER (PARTITION BY trip_id ORDER BY rank) - departure - stop_id % 900) AS waiting FROM stop_time")
def transfer_wait(f: Feed) -> DataFrame:
    gap = F.lead("arrival").over(Window.partitionBy("trip_id").orderBy("rank")) - F.col("departure")
    rows = f.stop_time.withColumn("gap", gap)
    return rows.select("trip_id", "rank", F.when(F.col("gap").isNull(), 0).otherwise(details.waiting(F.col("stop_id") % 900, F.col("gap"))).alias("waiting"))


@query("SELECT trip_id, bool_and(mode = 'F' AND stop_id % 7 <> 0) AS reliable FROM stop_time GROUP BY 1")
def reliable_tag(f: Feed) -> DataFrame:
    return details.reliable(f.stop_time.select("trip_id", "mode", (F.col("stop_id") % 7 == 0).alias("disrupted")), "trip_id", ["F"])


@query("SELECT id, CASE WHEN id % 5 = 0 THEN false WHEN id % 3 = 0 THEN true ELSE price < price * (id % 7) * 0.5 END AS ecologic FROM trip")
def ecologic_tag(f: Feed) -> DataFrame:
    own, car = F.when(F.col("id") % 3 != 0, F.col("price")), F.when(F.col("id") % 5 != 0, F.col("price") * (F.col("id") % 7))
    return f.trip.select("id", details.ecologic(own, car).alias("ecologic"))


@query("""WITH s AS (SELECT trip_id, rank, stop_id, lead(stop_id) OVER (PARTITION BY trip_id ORDER BY rank) AS to_stop FROM stop_time), p AS (SELECT id AS p_from, id * 3 % (SELECT count(*) FROM stop_point) AS p_to, CASE id % 3 WHEN 0 THEN 'FRONT' WHEN 1 THEN 'MIDDLE' ELSE 'BACK' END AS position FROM stop_point)
    SELECT trip_id, rank, stop_id, to_stop, position FROM s LEFT JOIN p ON stop_id = p_from AND to_stop = p_to""")
def boarding_positions(f: Feed) -> DataFrame:
    n = f.stop_point.count()
    position = F.when(F.col("id") % 3 == 0, "FRONT").when(F.col("id") % 3 == 1, "MIDDLE").otherwise("BACK")
    positions = f.stop_point.select(F.col("id").alias("p_from"), (F.col("id") * 3 % n).alias("p_to"), position.alias("position"))
    return details.boarding_positions(f.stop_time.select("trip_id", "rank", "stop_id"), positions, "trip_id")


@query()
def overtake_split(f: Feed) -> DataFrame:
    """Stays vary by trip here, so that trips of one pattern do overtake each other."""
    stay = F.col("rank") * (F.col("trip_id") % 5 * 211)
    rows = f.stop_time.select("trip_id", "rank", (F.col("arrival") + stay).alias("arrival"), (F.col("departure") + stay).alias("departure"))
    full = rows.groupBy("trip_id").agg(F.count(F.lit(1)).alias("stops"))
    patterns = full.join(f.trip.select(F.col("id").alias("trip_id"), "route_id"), "trip_id").select("trip_id", F.concat_ws("/", "route_id", "stops").alias("pattern"))
    return details.split_overtaking(rows, patterns)


@query("SELECT * FROM (VALUES ('walking', 'walking'), ('bike', 'walking'), ('car', 'walking'), ('bike', 'bike')) a(first, last) WHERE first IN ('walking', 'bike') AND last IN ('walking', 'bss')")
def mode_combinations(f: Feed) -> DataFrame:
    modes = lambda name, *xs: f.spark.createDataFrame([(x,) for x in xs], f"{name} string")
    allowed = f.spark.createDataFrame([("walking", "walking"), ("bike", "walking"), ("car", "walking"), ("bike", "bike")], "first string, last string")
    return details.mode_combinations(modes("first", "walking", "bike"), modes("last", "walking", "bss"), allowed)


@query("SELECT id, row_number() OVER (ORDER BY area, name, id) - 1 AS idx FROM stop_point")
def index_assignment(f: Feed) -> DataFrame:
    return sets.indexed(f.stop_point.select("id", "area", "name"), "area", "name", "id").select("id", "idx")


@query("SELECT DISTINCT ON (name) name, id FROM stop_point ORDER BY name, id")
def access_points_distinct(f: Feed) -> DataFrame:
    return f.stop_point.groupBy("name").agg(F.min("id").alias("id"))


@query("WITH w AS (SELECT DISTINCT id, unnest(string_split_regex(lower(name), '[^a-z0-9]+')) AS word FROM stop_point) SELECT word, count(*)::BIGINT AS objects FROM w WHERE word <> '' GROUP BY 1")
def text_index(f: Feed) -> DataFrame:
    return text.token_index(f.stop_point).groupBy("word").agg(F.count(F.lit(1)).alias("objects"))


@query("SELECT id, (100 - (id % 3) * 10 - abs(length(name) - 9) - floor((95 - size) / 10))::BIGINT AS quality FROM stop_point")
def text_quality(f: Feed) -> DataFrame:
    q = text.quality(F.col("id") % 3, F.length("name") - 9, F.col("size"), F.lit(95))
    return f.stop_point.select("id", q.cast("long").alias("quality"))


@query("SELECT id, start // 3600 * 3600 + start % 3600 AS seconds FROM trip")
def time_parse(f: Feed) -> DataFrame:
    part = lambda n: F.lpad(n.cast("string"), 2, "0")
    clock = F.concat_ws(":", part(F.floor(F.col("start") / 3600)), part(F.floor(F.col("start") % 3600 / 60)), part(F.col("start") % 60))
    return f.trip.select("id", C.time_to_int(clock).cast("long").alias("seconds"))


@query("SELECT id, least((start // 86400) * 86400 + 30000, (start // 86400) * 86400 + 30000) + CASE WHEN start > 30000 THEN 86400 ELSE 0 END AS next_at, 30000 - CASE WHEN start < 30000 THEN 86400 ELSE 0 END AS previous_at FROM trip")
def time_shift(f: Feed) -> DataFrame:
    at = F.lit(30_000)
    return f.trip.select("id", C.shifted(F.col("start"), at).alias("next_at"), C.shifted(F.col("start"), at, False).alias("previous_at"))
