"""Entity sets: predicates, paths over relations, set algebra and pages. Sets are DataFrames of id."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farandole.functions.columns import haversine, overlaps
from farandole.plans.feed import Feed
from farandole.scratch import stored


def ids(rows: DataFrame, keep: Column | None = None) -> DataFrame:
    return (rows if keep is None else rows.where(keep)).select("id")


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "id", "left_semi").distinct()


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def without(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "id", "left_anti").distinct()


def reached(feed: Feed, found: DataFrame, path: list[str]) -> DataFrame:
    """Ids of the last entity of the path that are related, hop by hop, to ids of the first one.

    Each hop is a semi join of the relation with the ids so far, so sets never multiply rows.
    """
    for source, target in zip(path, path[1:], strict=False):
        found = feed.relation(source, target).join(found, F.col("source_id") == F.col("id"), "left_semi").select(F.col("target_id").alias("id")).distinct()
    return found


def with_codes(objects: DataFrame, codes: DataFrame, systems: list[str], value: str | None = None) -> DataFrame:
    """Ids of objects that have a code (id, system, value) of one of the systems, of that value if given."""
    told = codes.where(F.col("system").isin(systems)) if value is None else codes.where(F.col("system").isin(systems) & (F.col("value") == value))
    return objects.select("id").join(told, "id", "left_semi")


def with_any_tag(objects: DataFrame, tags: list[str], column: str = "tags") -> DataFrame:
    return ids(objects, F.arrays_overlap(column, F.array(*map(F.lit, tags))))


def between(rows: DataFrame, since: Column, until: Column) -> DataFrame:
    """Rows whose [begin, end) overlaps since to until; until counts as a whole second."""
    return rows.where(overlaps(F.col("begin"), F.col("end"), since, until + F.expr("interval 1 second")))


def within(rows: DataFrame, lon: float, lat: float, metres: float) -> DataFrame:
    """Rows (lon, lat) within so many metres: a box that the scan can use, then the distance."""
    dlat = metres / 111_000
    dlon = dlat / max(0.01, abs(math.cos(lat * 0.01745329238)))
    box = F.col("lat").between(lat - dlat, lat + dlat) & F.col("lon").between(lon - dlon, lon + dlon)
    distance = haversine(F.col("lon"), F.col("lat"), F.lit(lon), F.lit(lat))
    return rows.where(box).withColumn("distance", distance).where(F.col("distance") <= metres)


def page(rows: DataFrame, number: int, count: int, *order: str) -> DataFrame:
    return rows.orderBy(*(order or ("id",))).offset(number * count).limit(count)


def indexed(rows: DataFrame, *order: str | Column) -> DataFrame:
    """rows with idx: their place from 0 in the total order.

    A global range sort numbers rows within tasks; the tasks' totals (a row each) give offsets.
    """
    placed = stored(rows.orderBy(*order).withColumn("place", F.monotonically_increasing_id()), "indexed")
    task = F.shiftright("place", 33)
    totals = placed.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("task", ahead.alias("ahead"))
    out = placed.join(F.broadcast(offsets), task == F.col("task"))
    return out.withColumn("idx", F.col("ahead") + F.col("place").bitwiseAND((1 << 33) - 1)).drop("task", "ahead", "place")


def with_headsign(trips: DataFrame, stop_times: DataFrame, sign: str) -> DataFrame:
    """Ids of trips whose own headsign or that of one of their stop times is the sign."""
    own = trips.where(F.col("headsign") == sign).select("id")
    return own.unionByName(stop_times.where(F.col("headsign") == sign).select(F.col("trip_id").alias("id"))).distinct()


def with_disruption(trips: DataFrame, informed: DataFrame) -> DataFrame:
    """Ids of trips that an impact of effect NO_SERVICE informs (trip_id, effect)."""
    return trips.select("id").join(informed.where("effect = 'NO_SERVICE'").select(F.col("trip_id").alias("id")), "id", "left_semi")


def of_odt_level(lines: DataFrame, level: str) -> DataFrame:
    """Ids of lines (id, on_demand, zonal) of a level: scheduled has no trip on demand, with_stops none to
    zones, zonal one to zones, all is any."""
    rule = {"scheduled": ~F.col("on_demand") & ~F.col("zonal"), "with_stops": ~F.col("zonal"), "zonal": F.col("zonal"), "all": F.lit(True)}
    return lines.where(rule[level]).select("id")


def required(rows: DataFrame) -> DataFrame:
    """rows, or an error if there are none: for the edge of an API, not within plans."""
    if rows.isEmpty():
        raise LookupError("unable to find object")
    return rows
