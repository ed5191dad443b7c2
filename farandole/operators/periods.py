"""Validity days, calendars, offsets and disruption periods. Day sets are rows (key, day)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: 64-bit numbers of a day set's parities.
PARITIES = 4


def days_of(periods: DataFrame, key: str, week: Column | None = None) -> DataFrame:
    """(key, day) of each inclusive period (begin, end), on the weekdays of the mask (bit 0 is Monday)."""
    rows = periods.select(key, F.explode(F.sequence("begin", "end", F.expr("interval 1 day"))).alias("day"), *([week.alias("mask")] if week is not None else []))
    if week is not None:
        rows = rows.where(F.expr("shiftright(mask, weekday(day)) & 1 = 1"))
    return rows.select(key, "day").distinct()


def calendar_days(periods: DataFrame, exceptions: DataFrame, key: str, week: Column) -> DataFrame:
    """Days of the periods, plus exceptions of type 1, less those of type 2."""
    added, removed = (exceptions.where(F.col("type") == k).select(key, "day") for k in (1, 2))
    return days_of(periods, key, week).unionByName(added).distinct().join(removed, [key, "day"], "left_anti")


def near_days(days: DataFrame, key: str) -> DataFrame:
    """(key, day) on which the key is valid on the day, the day before or the day after."""
    return days.select(key, F.explode(F.array(F.date_sub("day", 1), F.col("day"), F.date_add("day", 1))).alias("day")).distinct()


def interned(days: DataFrame, key: str) -> DataFrame:
    """(key, pattern): equal day sets share the smallest key as their pattern."""
    sets = days.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set("day")), ",").alias("days"))
    return sets.withColumn("pattern", F.min(key).over(Window.partitionBy(F.sha2("days", 256)))).select(key, "pattern")


def similar_calendars(objects: DataFrame, calendars: DataFrame, group: str, threshold: float) -> DataFrame:
    """(object, calendar, differing) of one group whose whole day sets, rows (group, object, day) and
    (group, calendar, day), differ on at most round(threshold * days of the calendar). A calendar
    without days has no rows and matches nothing; an object without days is not matched either.

    Prefix filtering, which is complete: a matching pair shares a day among the first few of each one's
    days in one order, here the days of the fewest calendars first. Where such days meet, parities of
    the whole sets rule pairs out, and only what they leave is shuffled and compared. Above a
    threshold of 1 sets without a common day can match, so all pairs of a group meet.
    """
    offset = F.datediff("day", F.lit("1970-01-01").cast("date"))
    often = calendars.select(group, "calendar", offset.alias("d")).distinct().groupBy(group, "d").agg(F.count(F.lit(1)).alias("often"))
    left, right = (_day_sets(rows, often, group, key) for rows, key in ((objects, "object"), (calendars, "calendar")))
    n, m = F.col("o_days"), F.col("c_days")
    most = F.round(m * threshold)
    # Both sets have at least so many days in common, whatever the other one's size.
    least = F.greatest(F.lit(1), F.ceil(((n + (1 - threshold) * (n - 0.5) / (1 + threshold) - 0.5) / 2) - 1e-9)).cast("int")
    left, right = _named(left, "o"), _named(right, "c")
    if threshold <= 1:
        keys = [group, "token"]
        left_met = left.withColumn("token", F.explode(F.slice("o_order", F.lit(1), n - least + 1))).drop("o_order")
        right_met = right.withColumn("token", F.explode(F.slice("c_order", F.lit(1), F.least(m, most.cast("int") + 1)))).drop("c_order")
    else:
        keys, left_met, right_met = [group], left.drop("o_order"), right.drop("c_order")
    parity = sum((F.bit_count(F.col(f"o_{k}").bitwiseXOR(F.col(f"c_{k}"))) for k in range(PARITIES)), F.lit(0))
    near = (F.abs(n - m) <= most) & (parity <= most)
    met = left_met.join(right_met.hint("merge"), keys).where(near).select(group, "object", "calendar").distinct()
    both = met.join(left.select(group, "object", "o_days", "o_order").hint("merge"), [group, "object"]).join(right.select(group, "calendar", "c_days", "c_order").hint("merge"), [group, "calendar"])
    differing = (n + m - 2 * F.size(F.array_intersect("o_order", "c_order"))).cast("int")
    return both.where(differing <= most).select("object", "calendar", differing.alias("differing"))


def _day_sets(days: DataFrame, often: DataFrame, group: str, key: str) -> DataFrame:
    """(group, key, days, order, 0, 1, ...): how many days the key has, these in order of how often they are, and the
    parities of how many of them fall on each of 64 * PARITIES bits: two sets' parities differ in no more
    bits than the sets differ in days."""
    offset = F.datediff("day", F.lit("1970-01-01").cast("date"))
    told = days.select(group, key, offset.alias("d")).distinct().join(often.hint("merge"), [group, "d"], "left")
    at = F.pmod(F.col("d"), F.lit(64 * PARITIES))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at % 64)
    parities = [F.bit_xor(F.when(F.floor(at / 64) == k, bit).otherwise(F.lit(0).cast("long"))).alias(str(k)) for k in range(PARITIES)]
    order = F.sort_array(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "d")))
    return told.groupBy(group, key).agg(F.count(F.lit(1)).cast("int").alias("days"), F.transform(order, lambda x: x["d"]).alias("order"), *parities)


def _named(sets: DataFrame, prefix: str) -> DataFrame:
    return sets.withColumnsRenamed({c: f"{prefix}_{c}" for c in ("days", "order", *map(str, range(PARITIES)))})


def offset_periods(days: DataFrame, zone: str) -> DataFrame:
    """Runs of days with one UTC offset (minutes) at noon: begin, end (inclusive), offset."""
    noon = F.to_timestamp(F.concat(F.col("day").cast("string"), F.lit(" 12:00:00")))
    offset = ((F.unix_seconds(F.from_utc_timestamp(noon, zone)) - F.unix_seconds(noon)) / 60).cast("int")
    rows = days.select("day", offset.alias("offset"))
    island = F.datediff("day", F.lit("2000-01-01").cast("date")) - F.row_number().over(Window.partitionBy("offset").orderBy("day"))
    return rows.withColumn("island", island).groupBy("offset", "island").agg(F.min("day").alias("begin"), F.max("day").alias("end")).drop("island")


def week_pattern(days: DataFrame, key: str) -> DataFrame:
    """The week mask (bit 0 is Monday) nearest to each key's days between its first and last one:
    key, mask, cost (days that it gets wrong), begin and end; ties prefer more weekdays."""
    span = days.groupBy(key).agg(F.min("day").alias("begin"), F.max("day").alias("end"))
    held = days.groupBy(key, F.weekday("day").alias("weekday")).agg(F.count(F.lit(1)).alias("n"))
    full = span.select(key, "begin", "end", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("weekday"))
    # Occurrences of a weekday between two dates, both included.
    first = F.date_add("begin", F.pmod(F.col("weekday") - F.weekday("begin"), F.lit(7)))
    occurs = F.greatest(F.lit(0), F.floor(F.datediff("end", first) / 7) + 1)
    each = full.withColumn("occurs", occurs).join(held, [key, "weekday"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # Weekdays are independent: a bit is right if it gets at least as many days right as wrong.
    chosen = F.col("n") * 2 >= F.col("occurs")
    chosen = chosen & (F.col("occurs") > 0)
    return each.groupBy(key, "begin", "end").agg(F.sum(F.when(chosen, F.expr("shiftleft(1, weekday)")).otherwise(0)).cast("int").alias("mask"), F.sum(F.when(chosen, F.col("occurs") - F.col("n")).otherwise(F.col("n"))).cast("long").alias("cost"))


def version_precedence(days: DataFrame, trip: str = "trip_id") -> DataFrame:
    """Of (trip, day, level, version) the newest version for each day and level; the base level
    (0) keeps its own versions."""
    newest = F.row_number().over(Window.partitionBy(trip, "day", "level").orderBy(F.desc("version")))
    return days.withColumn("nth", newest).where("nth = 1 or level = 0").drop("nth")


def pattern_offset(days: DataFrame, offsets: DataFrame, key: str) -> DataFrame:
    """(key, offset): the UTC offset on most of a pattern's days (key, day), by periods of offset_periods; ties
    go to the smaller one, and 0 where no period holds a day."""
    held = days.join(offsets, (F.col("day") >= F.col("begin")) & (F.col("day") <= F.col("end"))).groupBy(key, "offset").agg(F.count(F.lit(1)).alias("n"))
    best = held.groupBy(key).agg(F.max_by("offset", F.struct("n", -F.col("offset"))).alias("offset"))
    return days.select(key).distinct().join(best, key, "left").select(key, F.coalesce("offset", F.lit(0)).alias("offset"))
