"""Further rules on searches, amended trips, labels and requests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farandole.functions.columns import DAY, along_segment, approximate_square, haversine, overlaps
from farandole.scratch import stored

#: Trips, and impacts, of one object that travel together, about.
TOGETHER, TOLD_TOGETHER = 1024, 64
#: Trips of a list that are written out with impact after impact: a multiple of 8, so that column files pack them alike each time.
REPEATED = 128
#: Pairs of one object for which a part of it is worth while, about.
PART_PAIRS = 2**18
#: Objects with impacts that may be broadcast, so that trips of others aren't shuffled.
FEW = 100_000


def valid_trips(trips: DataFrame, allowed: dict[str, list], forbidden: dict[str, list]) -> DataFrame:
    """Trips that a search may use: in the allowed values of every level that is mentioned, and in
    no forbidden one."""
    keep = [F.col(c).isin(v) for c, v in allowed.items()] + [~F.coalesce(F.col(c).isin(v), F.lit(False)) for c, v in forbidden.items()]
    return trips.where(reduce(Column.__and__, keep, F.lit(True)))


def base_versions(amended: DataFrame, base: DataFrame, trip: str) -> DataFrame:
    """For each amended version (id, trip, days) the first base version (base_id, base_days) that
    shares a day with it."""
    met = amended.join(base, trip).where(F.arrays_overlap("days", "base_days"))
    return met.groupBy("id").agg(F.min("base_id").alias("base_id"))


def matching_routes(stop_times: DataFrame, trips: DataFrame, start: int, codes: DataFrame) -> DataFrame:
    """Routes with a trip that calls at the start stop and, there or later, at a stop of the codes
    (stop_id)."""
    first = stop_times.where(F.col("stop_id") == start).groupBy("trip_id").agg(F.min("rank").alias("from_rank"))
    later = stop_times.join(codes, "stop_id", "left_semi").groupBy("trip_id").agg(F.max("rank").alias("to_rank"))
    hit = first.join(later, "trip_id").where("to_rank >= from_rank").select("trip_id")
    return trips.join(hit, F.col("id") == F.col("trip_id"), "left_semi").select("route_id").distinct()


def park_and_walk(drives: DataFrame, walks: DataFrame, parking: int, speed: float) -> DataFrame:
    """(stop_id, duration): the quickest drive to a car park (park_id, seconds), parking, and walk
    (park_id, stop_id, metres) on to the stop."""
    walk = F.floor(F.col("metres") * F.sqrt(F.lit(2.0)) / speed)
    return drives.join(walks, "park_id").groupBy("stop_id").agg(F.min(F.col("seconds") + parking + walk).cast("long").alias("duration"))


def in_window(at: Column, begin: int, end: int) -> Column:
    """A time of day in [begin, end], over midnight if the end isn't after the beginning."""
    return at.between(begin, end) if begin < end else (at >= begin) | (at <= end)


def cut_after_groups(results: DataFrame, n: int) -> DataFrame:
    """Results of type groups in order, up to and with the first group that brings them to n."""
    sizes = results.groupBy("type_group").agg(F.count(F.lit(1)).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("type_group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = sizes.withColumn("before", before).where(F.col("before") < n).select("type_group")  # a row per group
    return results.join(F.broadcast(kept), "type_group", "left_semi")


def distance_to_line(lon: Column, lat: Column, line: list[tuple[float, float]]) -> Column:
    """Metres to the nearest point of a line of a few corners."""

    def one(a: tuple[float, float], b: tuple[float, float]) -> Column:
        u = along_segment(lon, lat, a, b)
        return approximate_square(lon, lat, F.lit(a[0]) + u * (b[0] - a[0]), F.lit(a[1]) + u * (b[1] - a[1]))

    return F.sqrt(F.least(*squares) if len(squares := [one(a, b) for a, b in zip(line, line[1:], strict=False)]) > 1 else squares[0])


def execution_periods(stop_times: DataFrame, days: DataFrame) -> DataFrame:
    """(trip_id, day, begin, end): from the first boarding where one may, to the last alighting
    where one may, in seconds of the day."""
    ends = stop_times.groupBy("trip_id").agg(F.min(F.when(F.col("pick_up"), F.col("departure"))).alias("begin"), F.max(F.when(F.col("drop_off"), F.col("arrival"))).alias("end"))
    return days.join(ends, "trip_id").select("trip_id", "day", "begin", "end")


def day_shifted(rows: DataFrame) -> DataFrame:
    """Rows (day, first, ...) whose first time lies before 0 or past 24 h, moved to the day it
    falls on."""
    shift = F.floor(F.col("first") / DAY).cast("int")
    return rows.withColumn("day", F.date_add("day", shift)).withColumn("first", F.pmod("first", F.lit(DAY)))


def _listed(rows: DataFrame, key: str, together: int, n: str, deals: Column) -> DataFrame:
    """(kind, uri, part, ids, and what else rows have): the keys of each object, each once, in lists of
    about so many. The side that deals has a list in one of the object's parts, the other one in all."""
    parts = F.col("parts")
    lists = F.when(deals, parts * F.ceil(F.col(n) / parts / together)).otherwise(F.ceil(F.col(n) / together))
    dealt = rows.withColumn("list", F.pmod(F.xxhash64(key), lists)).withColumn("part", F.when(deals, F.pmod("list", parts)))
    ids, empty = F.collect_set(key), F.array(F.lit(None).cast(rows.schema[key].dataType))  # a set leaves null out
    ids = F.when(F.max(F.col(key).isNull()), F.concat(ids, empty)).otherwise(ids)
    found = dealt.groupBy([c for c in dealt.columns if c not in (key, "n_trips", "n_impacts", "deals_trips")]).agg(ids.alias("ids"))
    stands = F.when(F.col("part").isNull(), F.sequence(F.lit(0).cast("long"), parts - 1)).otherwise(F.array("part"))
    return found.withColumn("part", F.explode(stands)).drop("list", "parts")


def informed_trips(impacts: DataFrame, trips: DataFrame) -> DataFrame:
    """(impact_id, trip_id), each once, of impacts (impact_id, kind, uri) on networks, lines, routes or
    trips: every kind meets the trips by the column of that name.

    Lists of an object's trips meet lists of its impacts, and pairs are only written out, list by list: rows
    that follow each other repeat the ids of two short lists, so that they take little room where they
    are stored. An object of many pairs is dealt into parts, at most twice as many as tasks. An
    impact on one object finds each trip once; only pairs of impacts on several ones are compared.
    """
    told_of = ["kind", "uri"]
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_id").alias("uri")) for k in ("network", "line", "route", "trip")])).alias("l")
    keyed = trips.select("trip_id", levels).select("trip_id", "l.kind", "l.uri")
    told = impacts.select("impact_id", *told_of).distinct().withColumn("several", F.count(F.lit(1)).over(Window.partitionBy("impact_id")) > 1)
    spark = trips.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    named = stored(told.groupBy(*told_of).agg(F.count(F.lit(1)).alias("n_impacts")), "named-objects")
    how = "broadcast" if named.count() <= FEW else "merge"
    met = keyed.join(named.hint(how), told_of).groupBy(*told_of, "n_impacts").agg(F.count(F.lit(1)).alias("n_trips"))
    parts = F.least(F.ceil(F.col("n_trips").cast("double") * F.col("n_impacts") / PART_PAIRS), F.lit(2 * tasks))
    sizes = stored(met.withColumn("parts", parts).withColumn("deals_trips", F.col("n_trips") >= F.col("n_impacts")), "object-sizes").hint(how)
    deals = F.col("deals_trips")
    held = _listed(sizes.join(keyed, told_of), "trip_id", TOGETHER, "n_trips", deals).repartition(tasks, *told_of, "part")
    begins = F.explode(F.sequence(F.lit(1), F.size("ids"), F.lit(REPEATED)))
    held = held.withColumn("begin", begins).withColumn("trip_ids", F.slice("ids", F.col("begin"), F.lit(REPEATED))).drop("ids", "begin")
    asked = _listed(sizes.join(told, told_of), "impact_id", TOLD_TOGETHER, "n_impacts", ~deals).repartition(tasks, *told_of, "part").withColumnRenamed("ids", "impact_ids")

    def pairs(some: Column) -> DataFrame:
        # Nothing is merged by coalesce: it ends the join's loop, which else holds all pairs of a list.
        lists = held.join(asked.where(some).hint("shuffle_hash"), [*told_of, "part"]).select("impact_ids", "trip_ids").coalesce(tasks)
        return lists.select(F.explode("impact_ids").alias("impact_id"), "trip_ids").select("impact_id", F.explode("trip_ids").alias("trip_id"))

    return pairs(~F.col("several")).unionByName(pairs(F.col("several")).distinct())


def amended(stop_times: DataFrame, updates: DataFrame) -> DataFrame:
    """Stop times of trips with their updates (trip_id, rank, arrival_delay, departure_delay,
    deleted): deleted stops go, delays move times, a delay holds on for later stops until the next."""
    told = updates.select("trip_id", "rank", "arrival_delay", "departure_delay", "deleted")
    rows = stop_times.join(told, ["trip_id", "rank"], "left")
    ahead = Window.partitionBy("trip_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.coalesce(F.last("departure_delay", ignorenulls=True).over(ahead), F.lit(0))
    rows = rows.withColumn("carried", carried).where(~F.coalesce("deleted", F.lit(False)))
    return rows.withColumn("arrival", F.col("arrival") + F.coalesce("arrival_delay", "carried")).withColumn("departure", F.col("departure") + F.coalesce("departure_delay", "carried")).drop("carried", "arrival_delay", "departure_delay", "deleted")


def publishable(begin: Column, end: Column, production_begin: Column, production_end: Column) -> Column:
    """A publication that begins, and meets the production period; an open one begins before its end."""
    return begin.isNotNull() & F.when(end.isNull(), begin <= production_end).otherwise(overlaps(begin, end, production_begin, production_end))


def next_request(journeys: DataFrame, by: str) -> DataFrame:
    """One second after the latest departure among the earliest arrivals of each request."""
    best = F.min("arrival").over(Window.partitionBy(by))
    return journeys.withColumn("best", best).where("arrival = best").groupBy(by).agg((F.max("departure") + 1).alias("again_at"))


def clamped(begin: Column, duration: Column, production_begin: Column, production_end: Column) -> tuple[Column, Column]:
    """A request's period inside production; it may begin a day before it."""
    low = F.greatest(begin, production_begin - DAY)
    return low, F.greatest(F.lit(0), F.least(begin + duration, production_end) - low)


def with_admins(places: DataFrame, admins: DataFrame) -> DataFrame:
    """Label of a place: its name, and its admin's in brackets unless it is the admin."""
    named = places.join(admins.select(F.col("admin_id").alias("of_admin"), "admin_name"), F.col("admin_id") == F.col("of_admin"), "left")
    label = F.when(F.col("admin_name").isNull() | (F.col("admin_name") == F.col("name")), F.col("name")).otherwise(F.concat("name", F.lit(" ("), "admin_name", F.lit(")")))
    return named.select("id", label.alias("label"))


def layered(edges: DataFrame, modes: list[str], changes: DataFrame) -> DataFrame:
    """Edges (a, b, cost, mode) of all modes in one graph: a node stands once in each mode's layer
    as mode:id, and changes (node, from_mode, to_mode, cost) lead from layer to layer."""
    at = lambda mode, node: F.concat_ws(":", mode, node.cast("string"))
    own = edges.where(F.col("mode").isin(modes)).select(at(F.col("mode"), F.col("a")).alias("a"), at(F.col("mode"), F.col("b")).alias("b"), "cost")
    return own.unionByName(changes.select(at(F.col("from_mode"), F.col("node")).alias("a"), at(F.col("to_mode"), F.col("node")).alias("b"), "cost"))


def within_admin(objects: DataFrame, admin: int) -> DataFrame:
    """Objects that are the admin or belong to it."""
    return objects.where((F.col("id") == admin) | F.array_contains("admins", admin))


def crow_fly(objects: DataFrame, lon: float, lat: float, speed: float, most: int) -> DataFrame:
    """(id, duration) of objects (id, lon, lat) within `most` seconds as the crow flies."""
    seconds = F.floor(haversine(F.col("lon"), F.col("lat"), F.lit(lon), F.lit(lat)) / speed).cast("long")
    return objects.select("id", seconds.alias("duration")).where(F.col("duration") <= most)
