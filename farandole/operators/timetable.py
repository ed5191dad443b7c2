"""Timetable queries: as-of searches, schedules, frequencies, service days, chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farandole.functions.columns import DAY



def next_passages(queries: DataFrame, passages: DataFrame, by: str, horizon: int = DAY) -> DataFrame:
    """For each query (query_id, by, since) the first passage (id, by, ts) not before since and
    less than horizon seconds later.

    As-of as one union and one ordered window per (by, time bucket): every passage also stands in
    the bucket before its own, so no window is longer than two buckets of one key.
    """
    bucket = lambda at: F.floor(F.unix_micros(F.col(at).cast("timestamp")) / (horizon * 1_000_000))
    asked = queries.select(F.col(by).alias("k"), bucket("since").alias("b"), F.col("since").alias("at"), F.lit(0).alias("side"), "query_id", F.lit(None).cast("long").alias("found"), F.lit(None).cast("timestamp_ntz").alias("found_ts"))
    held = passages.select(F.col(by).alias("k"), F.explode(F.array(bucket("ts"), bucket("ts") - 1)).alias("b"), F.col("ts").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("query_id"), F.col("id").alias("found"), F.col("ts").alias("found_ts"))
    ahead = Window.partitionBy("k", "b").orderBy(F.desc("at"), F.desc("side"), F.desc("found")).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("side") == 1, F.struct("found", "found_ts")), ignorenulls=True).over(ahead)
    out = asked.unionByName(held).withColumn("hit", last).where("side = 0")
    near = F.col("hit.found_ts") < F.col("at") + F.make_dt_interval(secs=F.lit(horizon))
    return out.select("query_id", F.when(near, F.col("hit.found")).alias("passage_id"), F.when(near, F.col("hit.found_ts")).alias("ts"))


def previous_passages(queries: DataFrame, passages: DataFrame, by: str, horizon: int = DAY) -> DataFrame:
    """The last passage not after since and less than horizon seconds earlier."""
    bucket = lambda at: F.floor(F.unix_micros(F.col(at).cast("timestamp")) / (horizon * 1_000_000))
    asked = queries.select(F.col(by).alias("k"), bucket("since").alias("b"), F.col("since").alias("at"), F.lit(1).alias("side"), "query_id", F.lit(None).cast("long").alias("found"), F.lit(None).cast("timestamp_ntz").alias("found_ts"))
    held = passages.select(F.col(by).alias("k"), F.explode(F.array(bucket("ts"), bucket("ts") + 1)).alias("b"), F.col("ts").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("query_id"), F.col("id").alias("found"), F.col("ts").alias("found_ts"))
    back = Window.partitionBy("k", "b").orderBy("at", "side", "found").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("side") == 0, F.struct("found", "found_ts")), ignorenulls=True).over(back)
    out = asked.unionByName(held).withColumn("hit", last).where("side = 1")
    near = F.col("hit.found_ts") > F.col("at") - F.make_dt_interval(secs=F.lit(horizon))
    return out.select("query_id", F.when(near, F.col("hit.found")).alias("passage_id"), F.when(near, F.col("hit.found_ts")).alias("ts"))


def first_passages(passages: DataFrame, since: Column, until: Column, k: int) -> DataFrame:
    """The k first passages in [since, until), merged over all points."""
    return passages.where((F.col("ts") >= since) & (F.col("ts") < until)).orderBy("ts", "id").limit(k)


def schedules(passages: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """The k first rows of every group, with nth from 1."""
    return passages.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("nth") <= k)


def occurrences(stop_times: DataFrame) -> DataFrame:
    """stop_times with nth: the how-manieth visit of its stop by its trip."""
    return stop_times.withColumn("nth", F.row_number().over(Window.partitionBy("trip_id", "stop_id").orderBy("rank")))


def matched_occurrences(amended: DataFrame, base: DataFrame) -> DataFrame:
    """Amended stop times with the rank of the same visit in the base trip, if it has it."""
    held = occurrences(base).select("trip_id", "stop_id", "nth", F.col("rank").alias("base_rank"))
    return occurrences(amended).join(held, ["trip_id", "stop_id", "nth"], "left")


def expanded_frequencies(rows: DataFrame, key: str) -> DataFrame:
    """(key, at) for every departure from start to end each headway; an end before the start is
    on the next day, and times come back below 24 h."""
    end = F.when(F.col("end") < F.col("start"), F.col("end") + DAY).otherwise(F.col("end"))
    return rows.select(key, F.explode(F.sequence("start", end, "headway")).alias("at")).select(key, F.pmod("at", F.lit(DAY)).alias("at"))


def service_day(ts: Column, opening: Column) -> Column:
    """The day that an instant belongs to: before the opening time it is the previous day."""
    seconds = F.unix_seconds(ts.cast("timestamp")) - F.unix_seconds(F.date_trunc("day", ts).cast("timestamp"))
    return F.when(seconds < opening - 1, F.date_sub(F.to_date(ts), 1)).otherwise(F.to_date(ts))


def first_and_last(passages: DataFrame, by: str) -> DataFrame:
    """First and last passage of every service day (opening in seconds)."""
    rows = passages.withColumn("service_day", service_day(F.col("ts"), F.col("opening")))
    return rows.groupBy(by, "service_day").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("passages"))


def cumulative_days(cells: DataFrame, by: str, order: str, reference: int) -> DataFrame:
    """Once a time of day is before the reference, it and all later cells of the row are a day on."""
    passed = F.max(F.when(F.col("time") < reference, 1).otherwise(0)).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return cells.withColumn("cumulative", F.col("time") + passed * DAY)


def chained_blocks(trips: DataFrame, block: str) -> DataFrame:
    """Each trip (id, start, end, first_stop, last_stop) with the next trip of its block, if that
    one starts after it ends, at the stop where it ends."""
    order = Window.partitionBy(block).orderBy("start", "id")
    follows = (F.lead("start").over(order) >= F.col("end")) & (F.lead("first_stop").over(order) == F.col("last_stop"))
    return trips.withColumn("next_id", F.when(follows, F.lead("id").over(order)))


def carried_headsigns(stop_times: DataFrame) -> DataFrame:
    """A headsign holds from where it is set until the next one is."""
    run = Window.partitionBy("trip_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return stop_times.withColumn("shown", F.last("headsign", ignorenulls=True).over(run))


def border_flags(stop_times: DataFrame) -> DataFrame:
    """No pick-up at a trip's last stop and no drop-off at its first."""
    trip = Window.partitionBy("trip_id")
    return stop_times.withColumn("pick_up", F.col("rank") != F.max("rank").over(trip)).withColumn("drop_off", F.col("rank") != F.min("rank").over(trip))


def longest_runs(sections: DataFrame, by: str, order: list[str], mode: str) -> DataFrame:
    """(by, mode, longest): the longest run of consecutive sections of one mode."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    within = F.row_number().over(Window.partitionBy(by, mode).orderBy(*order))
    runs = sections.withColumn("island", place - within).groupBy(by, mode, "island").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy(by, mode).agg(F.max("n").alias("longest"))


def clean_stop_times(rows: DataFrame) -> DataFrame:
    """Stop times renumbered from 0 by sequence; trips with a repeated sequence, or a time before
    the one ahead of it, are left out."""
    order = Window.partitionBy("trip_id").orderBy("sequence", "arrival", "stop_id")
    seen = rows.withColumn("rank", F.row_number().over(order) - 1).withColumn("bad", (F.lag("sequence").over(order) == F.col("sequence")) | (F.lag("departure").over(order) > F.col("arrival")) | (F.col("departure") < F.col("arrival")))
    bad = seen.where("bad").select("trip_id").distinct()
    return seen.join(bad, "trip_id", "left_anti").drop("bad")


def route_destinations(last_stops: DataFrame) -> DataFrame:
    """Most frequent last area of each route; ties go to the smaller area."""
    n = last_stops.groupBy("route_id", "area").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("route_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "area")).alias("best")).select("route_id", F.col("best.area").alias("destination"), (-F.col("best.n")).alias("trips"))


def journey_patterns(stop_times: DataFrame, trips: DataFrame) -> DataFrame:
    """(route_id, stops, trips, first_trip): trips of a route with the same stops in order."""
    stops = stop_times.groupBy("trip_id").agg(F.sort_array(F.collect_list(F.struct("rank", "stop_id"))).alias("s")).select(F.col("trip_id").alias("id"), F.array_join(F.transform("s", lambda x: x["stop_id"].cast("string")), ",").alias("stops"))
    return trips.join(stops, "id").groupBy("route_id", "stops").agg(F.count(F.lit(1)).alias("trips"), F.min("id").alias("first_trip"))


def two_day_table(days: DataFrame, times: DataFrame) -> DataFrame:
    """All passages of trips valid on a day, as (trip_id, stop_id, at): times past 24 h fall on
    the following day."""
    rows = days.join(times, "trip_id")
    shift = F.floor(F.col("departure") / DAY).cast("int")
    return rows.select("trip_id", "stop_id", F.date_add("day", shift).alias("on_day"), F.pmod("departure", F.lit(DAY)).alias("at"))


def empty_points(points: DataFrame, passages: DataFrame, key: list[str]) -> DataFrame:
    """Points without any passage."""
    return points.join(passages, key, "left_anti")


def overlaid(base: DataFrame, realtime: DataFrame, key: list[str]) -> DataFrame:
    """Passages of base, replaced by those of realtime wherever it has the key."""
    return base.join(realtime.select(*key).distinct(), key, "left_anti").unionByName(realtime)


def without_empty_siblings(points: DataFrame) -> DataFrame:
    """Points of a route's schedule (route_id, stop_id, has_times): an empty one goes if another of its route has
    times; of a route without any times one stays."""
    of = Window.partitionBy("route_id")
    told = points.withColumn("any", F.max("has_times").over(of)).withColumn("nth", F.row_number().over(of.orderBy("stop_id")))
    return told.where("has_times or (not any and nth = 1)").drop("any", "nth")


def frequency_times(frequencies: DataFrame) -> DataFrame:
    """(id, at): every departure from start to end by the headway; an end before the start is on the next
    day, and times count within a day."""
    end = F.when(F.col("end") < F.col("start"), F.col("end") + 86_400).otherwise(F.col("end"))
    return frequencies.where("headway > 0").select("id", F.explode(F.sequence("start", end, "headway")).alias("at")).withColumn("at", F.col("at") % 86_400)


def without_empty_points(points: DataFrame, by: str) -> DataFrame:
    """Schedule points (point_id, has_times, and what they are grouped by) without those that have no times where
    another of the group has some; of a group without any times, the smallest point stays."""
    group = Window.partitionBy(by)
    told = points.withColumns({"any": F.max(F.coalesce("has_times", F.lit(False))).over(group), "least": F.min("point_id").over(group)})
    return told.where("has_times or (not any and point_id = least)").drop("any", "least")
