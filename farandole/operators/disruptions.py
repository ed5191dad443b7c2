"""Disruptions: impacts meet trips by period; effects, closures and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Effects, worst first.
EFFECTS = ("NO_SERVICE", "REDUCED_SERVICE", "SIGNIFICANT_DELAYS", "DETOUR", "ADDITIONAL_SERVICE", "MODIFIED_SERVICE", "OTHER_EFFECT", "UNKNOWN_EFFECT", "STOP_MOVED")


def impacted(trips: DataFrame, impacts: DataFrame, key: str, slot_hours: int = 24) -> DataFrame:
    """(id, impact_id): trips (id, key, begin, end) whose period meets an impact's (impact_id,
    key, begin, end).

    Intervals meet in the time slots that both touch, and a pair counts in the first one that
    they share, so nothing is met twice and no distinct is needed. An open end (null) reaches as far
    as any begin or end of either side does.
    """
    spans = trips.select("begin", "end").unionByName(impacts.select("begin", "end")).select(*[F.col(c).cast("timestamp_ntz").alias(c) for c in ("begin", "end")])
    reach = spans.agg(F.min(F.least("begin", "end")).alias("first"), F.max(F.greatest("begin", "end")).alias("last")).first()
    if reach["first"] is None:
        return trips.join(impacts.select("impact_id", key), key).where("false").select("id", "impact_id")
    low, high = F.lit(reach["first"]).cast("timestamp_ntz"), F.lit(reach["last"]).cast("timestamp_ntz") + F.expr("interval 1 second")
    trips, impacts = (x.withColumns({"begin": F.coalesce(F.col("begin").cast("timestamp_ntz"), low), "end": F.coalesce(F.col("end").cast("timestamp_ntz"), high)}) for x in (trips, impacts))
    slot = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / (slot_hours * 3600))
    last = lambda c: F.floor((F.unix_seconds(F.col(c).cast("timestamp")) - 1) / (slot_hours * 3600))
    left = trips.select("id", key, "begin", "end", F.explode(F.sequence(slot("begin"), F.greatest(slot("begin"), last("end")))).alias("slot"))
    right = impacts.select("impact_id", key, F.col("begin").alias("i_begin"), F.col("end").alias("i_end"), F.explode(F.sequence(slot("begin"), F.greatest(slot("begin"), last("end")))).alias("slot"))
    met = left.join(right, [key, "slot"]).where("begin < i_end and end > i_begin")
    first = F.greatest(slot("begin"), F.floor(F.unix_seconds(F.col("i_begin").cast("timestamp")) / (slot_hours * 3600)))
    return met.where(F.col("slot") == first).select("id", "impact_id")


def cancelled_days(days: DataFrame, hits: DataFrame) -> DataFrame:
    """Days (id, day) of trips that no impact hits."""
    return days.join(hits.select("id").distinct(), "id", "left_anti")


def without_closed_stops(passages: DataFrame, closures: DataFrame) -> DataFrame:
    """Passages (trip_id, stop_id, ts) that no closure (stop_id, begin, end) holds; a null begin or
    end is open."""
    of = closures.select(F.col("stop_id").alias("c_stop"), "begin", "end")
    held = (F.col("stop_id") == F.col("c_stop")) & (F.col("begin").isNull() | (F.col("ts") >= F.col("begin"))) & (F.col("end").isNull() | (F.col("ts") < F.col("end")))
    return passages.join(of, held, "left_anti")


def section_ranks(stop_times: DataFrame, start: str, end: str) -> DataFrame:
    """(trip_id, from_rank, to_rank) of the smallest ranges that begin at a stop of the start area
    and end at the next one of the end area."""
    order = Window.partitionBy("trip_id").orderBy("rank")
    ahead = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = stop_times.withColumn("from_rank", F.last(F.when(F.col("area") == start, F.col("rank")), ignorenulls=True).over(ahead)).where(F.col("area") == end).where("from_rank is not null")
    return rows.groupBy("trip_id", "from_rank").agg(F.min("rank").alias("to_rank"))


def no_service_tail(stop_times: DataFrame, area: str) -> DataFrame:
    """Stop times of a trip from its first stop in the area on."""
    first = F.min(F.when(F.col("area") == area, F.col("rank"))).over(Window.partitionBy("trip_id"))
    return stop_times.withColumn("first_rank", first).where("rank >= first_rank").drop("first_rank")


def worst_effects(rows: DataFrame, by: str) -> DataFrame:
    """The worst effect of each group."""
    ordinal = F.array_position(F.array(*map(F.lit, EFFECTS)), F.col("effect"))
    return rows.groupBy(by).agg(F.min_by("effect", ordinal).alias("effect"))


def latest(messages: DataFrame) -> DataFrame:
    """The newest message of each entity; ties go to the larger id."""
    return messages.withColumn("nth", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("ts"), F.desc("id")))).where("nth = 1").drop("nth")


def surviving(messages: DataFrame, deleted: str) -> DataFrame:
    """Entities whose newest message isn't a deletion."""
    return latest(messages).where(F.col("kind") != deleted)


def upserted(state: DataFrame, batch: DataFrame) -> DataFrame:
    """State with the batch's newest messages in the place of its entities'."""
    new = latest(batch)
    return state.join(new.select("entity_id"), "entity_id", "left_anti").unionByName(new)


def traffic_report(impacts: DataFrame) -> DataFrame:
    """One row per network: how many impacts of each kind of object, and their ids in order."""
    each = impacts.groupBy("network_id", "object_kind").agg(F.array_join(F.transform(F.sort_array(F.collect_set("impact_id")), lambda i: i.cast("string")), ",").alias("impacts"))
    return each.select("network_id", "object_kind", "impacts")


def line_report(lines: DataFrame, impacts: DataFrame) -> DataFrame:
    """Lines with an impact on themselves, their network or a route: numbers by kind."""
    n = lambda kind: F.count_distinct(F.when(F.col("object_kind") == kind, F.col("impact_id"))).alias(f"{kind}_impacts")
    return lines.join(impacts, "line_id").groupBy("line_id").agg(n("network"), n("line"), n("route"))


def equipment_report(stops: DataFrame) -> DataFrame:
    """(line_id, area, stops): stops grouped by area below their line, ids in order."""
    return stops.groupBy("line_id", "area").agg(F.array_join(F.transform(F.sort_array(F.collect_set("stop_id")), lambda i: i.cast("string")), ",").alias("stops"))


def message_ages(messages: DataFrame, now: Column) -> DataFrame:
    """Minimum, mean and maximum age in seconds of each kind's messages."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return messages.groupBy("kind").agg(F.floor(F.min(age) / 1e6).cast("long").alias("youngest"), F.floor(F.avg(age) / 1e6).cast("long").alias("mean"), F.floor(F.max(age) / 1e6).cast("long").alias("oldest"))


def least_priorities(impacts: DataFrame) -> DataFrame:
    """(line_id, priority): the smallest severity priority of each line's impacts."""
    return impacts.groupBy("line_id").agg(F.min("priority").alias("priority"))


def report_order(lines: DataFrame, impacts: DataFrame) -> DataFrame:
    """Lines (line_id, network_idx, code, name) of a traffic report in order: by network, smallest priority,
    code and name; place counts from 0 within a network."""
    order = Window.partitionBy("network_idx").orderBy(F.col("priority").asc_nulls_last(), "code", "name", "line_id")
    return lines.join(least_priorities(impacts), "line_id", "left").withColumn("place", F.row_number().over(order) - 1)


def in_order_of_change(impacts: DataFrame, by: str) -> DataFrame:
    """Surviving impacts numbered as they are applied anew: by time of change, then uri."""
    return impacts.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy("updated_at", "uri")))


def reduced_section(stop_times: DataFrame, sections: DataFrame) -> DataFrame:
    """Stop times (trip_id, rank, stop_id) without those within a trip's reduced section (trip_id, from_rank,
    to_rank, blocked: stop ids); a boundary stays unless its stop is blocked."""
    met = stop_times.join(sections, "trip_id").where("rank between from_rank and to_rank")
    edge = F.col("rank").isin(F.col("from_rank"), F.col("to_rank")) & ~F.coalesce(F.array_contains("blocked", F.col("stop_id")), F.lit(False))
    return stop_times.join(met.where(~edge).select("trip_id", "rank").distinct(), ["trip_id", "rank"], "left_anti")


def handleable(updates: DataFrame, trips: DataFrame, stops: DataFrame, add_stops: bool, add_trips: bool) -> DataFrame:
    """Ids of realtime updates (id, trip_id, added, stops: array of (stop_id, added, arrival)) that can be
    applied: kinds of change that are switched on, known trips (unless added) and stops, and no time
    before the trip's first day."""
    told = updates.withColumn("new_stops", F.exists("stops", lambda s: s["added"]))
    told = told.where((F.lit(add_trips) | ~F.col("added")) & (F.lit(add_stops) | ~F.col("new_stops")) & ~F.exists("stops", lambda s: s["arrival"] < 0))
    known = told.join(trips.select(F.col("id").alias("trip_id")).distinct(), "trip_id", "left_semi").where("not added").unionByName(told.where("added"))
    unknown = known.select("id", F.explode("stops.stop_id").alias("stop_id")).join(stops.select(F.col("id").alias("stop_id")).distinct(), "stop_id", "left_anti")
    return known.join(unknown.select("id").distinct(), "id", "left_anti").select("id")


def added_trips(messages: DataFrame, routes: DataFrame, companies: DataFrame, modes: DataFrame) -> DataFrame:
    """Added trips (id, route_id, company_id, mode_id) with defaults for what they leave out (a route and a
    line of their own); one that names an unknown company or mode is rejected, as is an unknown route."""
    out = messages
    for c, known in (("route_id", routes), ("company_id", companies), ("mode_id", modes)):
        out = out.join(known.select(F.col("id").alias(f"known_{c}"), F.lit(True).alias(f"has_{c}")).distinct(), F.col(c) == F.col(f"known_{c}"), "left").where(F.col(c).isNull() | F.col(f"has_{c}"))
    own = F.concat(F.lit("route:added:"), F.col("id").cast("string"))
    return out.select("id", F.coalesce(F.col("route_id").cast("string"), own).alias("route_id"), F.col("route_id").isNull().alias("new_route"), F.coalesce(F.col("company_id").cast("string"), F.lit("default_company")).alias("company_id"), F.coalesce(F.col("mode_id").cast("string"), F.lit("default_mode")).alias("mode_id"))


def relevant_delays(updates: DataFrame, base: DataFrame) -> DataFrame:
    """Trips of delay updates (trip_id, rank, arrival, departure) of which a stop time differs from the
    base's or isn't there."""
    told = base.select("trip_id", "rank", F.col("arrival").alias("b_arrival"), F.col("departure").alias("b_departure"))
    met = updates.join(told, ["trip_id", "rank"], "left")
    return met.where("b_arrival is null or arrival <> b_arrival or departure <> b_departure").select("trip_id").distinct()


def from_messages(messages: DataFrame) -> DataFrame:
    """One row per impact of told disruptions (id, cause, impacts: array of (id, severity, entities: array of
    (kind, id))) and informed object: disruption_id, cause, impact_id, effect, kind and object_id. A severity
    without an effect is UNKNOWN_EFFECT; entities without a kind are left out."""
    each = messages.select(F.col("id").alias("disruption_id"), "cause", F.explode("impacts").alias("i"))
    out = each.select("disruption_id", "cause", F.col("i.id").alias("impact_id"), F.coalesce("i.severity", F.lit("UNKNOWN_EFFECT")).alias("effect"), F.explode("i.entities").alias("e"))
    return out.select("disruption_id", "cause", "impact_id", "effect", F.col("e.kind").alias("kind"), F.col("e.id").alias("object_id")).where("kind is not null")


def erasable_trips(trips: DataFrame, stop_times: DataFrame, days: DataFrame) -> DataFrame:
    """Ids of trips to remove: flagged, without stop times, with a negative time, or never valid."""
    times = stop_times.groupBy(F.col("trip_id").alias("id")).agg(F.min(F.least("arrival", "departure")).alias("least"))
    valid = days.select(F.col("trip_id").alias("id"), F.lit(True).alias("valid")).distinct()
    told = trips.join(times, "id", "left").join(valid, "id", "left")
    return told.where("to_delete or least is null or least < 0 or valid is null").select("id")


def stop_area_report(impacts: DataFrame, stops: DataFrame) -> DataFrame:
    """(area, impact_id, on_area, stops): each impact of an area once, told of the area itself or of so many
    of its stops. impacts: impact_id, area, stop_id (one of the last two is null); stops: stop_id, area."""
    own = impacts.where("area is not null").select("area", "impact_id", F.lit(None).cast("long").alias("stop_id"))
    below = impacts.where("area is null").select("impact_id", "stop_id").join(stops.select("stop_id", "area").distinct(), "stop_id").select("area", "impact_id", "stop_id")
    return own.unionByName(below).groupBy("area", "impact_id").agg(F.bool_or(F.col("stop_id").isNull()).alias("on_area"), F.count_distinct("stop_id").alias("stops"))


def trip_report(impacts: DataFrame, trips: DataFrame, now: Column) -> DataFrame:
    """(network_id, trip_id, impacts, first_impact) of trips without service at an instant. impacts: impact_id,
    trip_id, effect, begin, end (null: open); trips: trip_id, network_id. Other effects aren't told."""
    valid = impacts.where((F.col("effect") == "NO_SERVICE") & (F.col("begin") <= now) & (F.col("end").isNull() | (F.col("end") > now)))
    each = valid.groupBy("trip_id").agg(F.count_distinct("impact_id").alias("impacts"), F.min("impact_id").alias("first_impact"))
    return trips.join(each, "trip_id").select("network_id", "trip_id", "impacts", "first_impact")


def impacts_of_mode(impacts: DataFrame, stop_times: DataFrame, mode: str) -> DataFrame:
    """Ids of the impacts (impact_id, trip_id) of trips that run in a mode, without a path over other entities."""
    return impacts.join(stop_times.where(F.col("mode") == mode).select("trip_id").distinct(), "trip_id", "left_semi").select("impact_id").distinct()
